"""Exact token counts at every prefix of a text, by dynamic programming.

For a piece of text (one match of the vocabulary's split), the encoding of a prefix is the
encoding of a shorter prefix plus one token: the only token that ends the prefix and stays
apart from the last token of that shorter prefix when the two are encoded together.  So one
pass from left to right gives the last token and the count of every prefix.  Different pieces of a slice of text go
through the program side by side, those of a length together; long ones go alone.

The stored table of a text holds its token count at every prefix that ends at a code point: how much each
code point changes the count (``deltas``, one signed byte each; -128 stands for a larger change, held in ``wide``), and
the counts themselves at every ``STEP`` -th code point and at the end (``marks``).  A cut can change how a text is
split where it falls within white space, a contraction or a special string; the table holds what the cut text has, and
so ``PrefixTable.count_at`` and ``longest_within`` answer questions about truncation and budgets by
looking up and adding, without any encoding.

Null text is taken as empty: one mark of 0.  Every input row gives one output row, repeated rows and null ids
included, and none for an empty table; very long texts are slices of their own; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Splitter, byte_alphabet
from .common import as_binary, file_bytes, slices
from .hashing import Lookup

CACHE_PIECES, CACHE_BYTES, CACHE_PAIRS = 1 << 19, 1 << 24, 1 << 20
#: Code points from one absolute count of a stored table to the next.
STEP = 256
#: The longest piece, in bytes, that is counted side by side with others.
SIDE_BY_SIDE = 48

#: Contractions that are one piece and, without their last letter, two; fixed values of the split.
CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))

_BASE = np.uint64(0x9E3779B97F4A7C15)


class PrefixCounter:
    """Prefix counts under a byte-level BPE vocabulary."""

    #: The tokeniser's split, a fixed value of the vocabulary.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, content: bytes):
        spec = json.loads(content)
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] is not None or (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) != ("ByteLevel", True, False):
            raise ValueError("this vocabulary asks for other steps than the byte-level split")
        vocab: dict[str, int] = spec["model"]["vocab"]
        back = {c: b for b, c in enumerate(byte_alphabet())}
        raw = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.bytes_of = raw
        self.id_of = {b: i for i, b in raw.items()}
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(spec["model"]["merges"])}
        #: By the last two bytes (or the only one): how long tokens are that end so, the longest first.
        lengths: dict[bytes, set[int]] = {}
        for b in self.id_of:
            lengths.setdefault(b[-2:], set()).add(len(b))
        self.lengths = {b: sorted(n, reverse=True) for b, n in lengths.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self._find = Splitter(self.PIECES)
        self._space, self._blank = regex.compile(r"\s").match, regex.compile(r"\s+").fullmatch
        self._pairs: dict[tuple[int, int], bool] = {}
        #: How much each code point of a piece changes the count (as bytes if each fits in one).
        self._changes_of: dict[str, bytes | list[int]] = {}
        #: Known pieces that need a look: white space, and such with a change beyond a byte.
        self._odd: set[str] = set()
        self._held = 0
        # For pieces side by side: token ids by a number of their bytes, and how each token was merged.
        by_size: dict[int, list[int]] = {}
        for t, b in raw.items():
            by_size.setdefault(len(b), []).append(t)
        numbers = [self._number(np.frombuffer(b"".join(raw[t] for t in own), np.uint8).reshape(-1, n)) for n, own in by_size.items()]
        self._token = Lookup(np.concatenate(numbers).view(np.int64), np.array([t for own in by_size.values() for t in own], np.int64))
        self._rank = Lookup(np.array([a << 32 | b for a, b in self.merges], np.int64), np.array([r for r, _ in self.merges.values()], np.int64))
        size = max(raw) + 1
        #: Rank at which a token is made (single bytes: -1) and the two parts it is made of (itself).
        self._made, self._left, self._right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        for (a, b), (rank, token) in self.merges.items():
            if self._made[token] < 0 and len(raw[token]) > 1:
                self._made[token], self._left[token], self._right[token] = rank, a, b
        # A token is its own encoding if its parts are, and no merge across their border comes before its own.
        self._good = np.zeros(size, bool)
        self._good[self.single] = True
        made = np.flatnonzero(self._made >= 0)
        made = made[np.argsort(self._made[made])]
        whole = self._apart_many(self._left[made], self._right[made], self._made[made])
        for t, a, b, ok in zip(made.tolist(), self._left[made].tolist(), self._right[made].tolist(), whole.tolist()):
            self._good[t] = ok and self._good[a] and self._good[b]

    @staticmethod
    def _number(raw: np.ndarray) -> np.ndarray:
        """A 64-bit number for each row of bytes."""
        h = np.zeros(len(raw), np.uint64)
        for i in range(raw.shape[1]):
            h = (h ^ (raw[:, i].astype(np.uint64) + np.uint64(1))) * _BASE
            h ^= h >> np.uint64(32)
        return h

    def _apart_many(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """``_apart`` for many pairs: undo merges at the border, latest first, and see whether a merge
        across it would have come before."""
        out = np.ones(len(left), bool)
        if limit is None:
            limit = np.full(len(left), np.iinfo(np.int64).max)
        own = np.arange(len(left))
        while len(own):
            across = self._rank(left << 32 | right)
            crossed = (across >= 0) & (across < limit)
            out[own[crossed]] = False
            a, b = self._made[left], self._made[right]
            more = ~crossed & ((a >= 0) | (b >= 0))
            # The later merge is undone; of two equal ones (one rank) the right one, made after the left.
            undo = a > b
            limit = np.where(undo, a, b + 1)
            left, right = np.where(undo, self._right[left], left), np.where(undo, right, self._left[right])
            own, left, right, limit = own[more], left[more], right[more], limit[more]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Count pieces that the cache does not hold, those of a length together."""
        if len(self._changes_of) >= CACHE_PIECES or self._held >= CACHE_BYTES:
            self._changes_of, self._odd, self._held = {}, set(), 0
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        for p in pieces.difference(self._changes_of):
            raw = p.encode()
            if len(raw) <= SIDE_BY_SIDE:
                own = by_size.get(len(raw)) or by_size.setdefault(len(raw), ([], []))
                own[0].append(p)
                own[1].append(raw)
            else:
                self._know(p, raw, self.piece_prefixes(raw))
        for size, (names, raws) in by_size.items():
            for at in range(0, len(names), 1 << 14):
                some = names[at : at + (1 << 14)]
                raw = np.frombuffer(b"".join(raws[at : at + (1 << 14)]), np.uint8).reshape(-1, size)
                counts = self.prefixes_many(raw)
                # A code point ends before each byte that does not go on with one.
                ends = np.ones(raw.shape, bool)
                ends[:, :-1] = raw[:, 1:] & 0xC0 != 0x80
                found, lengths = counts[:, 1:][ends], ends.sum(axis=1)
                starts = np.cumsum(lengths) - lengths
                found[1:] -= found[:-1].copy()
                found[starts] = counts[np.arange(len(raw)), 1 + ends.argmax(axis=1)]
                # So short a piece has changes that fit in a byte each.
                changes, starts = found.astype(np.int8).tobytes(), starts.tolist()
                self._changes_of.update([(p, changes[a:b]) for p, a, b in zip(some, starts, [*starts[1:], len(changes)])])
                self._held += size * len(some)
                for p in filter(self._look, some):
                    self._know(p, p.encode(), self.prefixes_many(np.frombuffer(p.encode(), np.uint8)[None])[0].tolist())

    @staticmethod
    def _look(piece: str) -> bool:
        return piece.isspace() or piece in CONTRACTIONS

    def _know(self, piece: str, raw: bytes, counts: list[int]) -> None:
        self._changes_of[piece] = changes = self._changes(piece, raw, counts)
        self._held += len(raw)
        if not isinstance(changes, bytes) or self._blank(piece):
            self._odd.add(piece)

    @staticmethod
    def _changes(piece: str, raw: bytes, counts: list[int]) -> bytes | list[int]:
        """How much each code point of a piece changes the count, from the counts of its byte prefixes."""
        at = counts if len(raw) == len(piece) else [0, *(counts[i] for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80)]
        if piece in CONTRACTIONS:
            at = [*at[:2], 2, *at[3:]]
        changes = [y - x for x, y in zip(at[:-1], at[1:])]
        return np.array(changes, np.int8).tobytes() if max(map(abs, changes), default=0) < 128 else changes

    def prefixes_many(self, raw: np.ndarray) -> np.ndarray:
        """Token counts of every byte prefix of pieces of one length (rows), the empty one first."""
        n, size = raw.shape
        counts, last = np.zeros((n, size + 1), np.int64), np.full((n, size + 1), -1, np.int64)
        # token[start][:, k]: the token that covers bytes start to start + k, or -1.
        tokens: list[np.ndarray] = []
        for start in range(size):
            h, found = np.zeros(n, np.uint64), np.full((n, size - start), -1, np.int64)
            for k in range(size - start):
                h = (h ^ (raw[:, start + k].astype(np.uint64) + np.uint64(1))) * _BASE
                h ^= h >> np.uint64(32)
                found[:, k] = self._token(h.view(np.int64))
            tokens.append(found)
        for end in range(1, size + 1):
            open_ = np.arange(n)
            for start in range(end):
                token = tokens[start][open_, end - start - 1]
                some = token >= 0
                if not some.any():
                    continue
                rows, token = open_[some], token[some]
                good = self._good[token] if start == 0 else self._apart_many(last[rows, start], token)
                rows, token = rows[good], token[good]
                counts[rows, end], last[rows, end] = counts[rows, start] + 1, token
                open_ = open_[last[open_, end] < 0]
                if not len(open_):
                    break
        return counts

    def _apart(self, left: int, right: int) -> bool:
        """Whether two tokens, encoded together, come out as these two."""
        known = self._pairs.get((left, right))
        if known is None:
            known = bool(self._apart_many(np.array([left]), np.array([right]))[0])
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            self._pairs[left, right] = known
        return known

    def piece_prefixes(self, raw: bytes) -> list[int]:
        """Token counts of every byte prefix of one piece, the empty one first."""
        counts, last = [0], [-1]
        id_of, single = self.id_of, self.single
        for end in range(1, len(raw) + 1):
            for n in (*self.lengths.get(raw[end - 2 : end], ()), 1) if end > 1 else (1,):
                start = end - n
                if start < 0 or (token := single[raw[start]] if n == 1 else id_of.get(raw[start:end])) is None:
                    continue
                if self._apart(last[start], token) if start else self._good[token]:
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
        return counts

    def piece(self, piece: str) -> bytes | list[int]:
        """How much each code point of a piece changes the count; all together are its tokens."""
        if piece not in self._changes_of:
            raw = piece.encode()
            self._know(piece, raw, self.piece_prefixes(raw))
        return self._changes_of[piece]

    def pieces(self, text: str) -> list[list[str] | str]:
        """The text in order: lists of pieces, and between them each special string."""
        at, found = 0, []
        for m in self._special.finditer(text):
            found += [self._find(text[at : m.start()]), m[0]]
            at = m.end()
        return [*found, self._find(text[at:] if at else text)]

    def count(self, text: str) -> int:
        """Tokens of a text."""
        return sum(1 if isinstance(p, str) else sum(_total(self.piece(q)) for q in p) for p in self.pieces(text))

    def table(self, parts: list[list[str] | str], learnt: bool = False) -> "PrefixTable":
        """The prefix table of a text from its ``pieces``; learnt: all pieces went through ``learn`` just now."""
        if not learnt:
            self.learn({p for part in parts if not isinstance(part, str) for p in part})
        out: list[bytes | list[int]] = []
        changes_of = self._changes_of.__getitem__
        base = 0
        for k, part in enumerate(parts):
            if isinstance(part, str):
                # Cut within a special string, that is plain text, split together with what comes before it.
                tail = parts[k - 1][-2:]
                before = base - sum(_total(changes_of(p)) for p in tail)
                at = [base, *(before + self.count("".join(tail) + part[:j]) for j in range(1, len(part))), base + 1]
                out.append([y - x for x, y in zip(at[:-1], at[1:])])
                base += 1
                continue
            done = 0
            for q in np.flatnonzero(np.fromiter(map(self._odd.__contains__, part), bool, len(part))).tolist() if not self._odd.isdisjoint(part) else ():
                if q < done:
                    continue
                out.append(b"".join(map(changes_of, part[done:q])))
                base += _total(out[-1])
                after = part[q + 1 : q + 3]
                if after and self._space(part[q]) and self._space(after[0]):
                    # White space goes to its own piece but for the last one; cut there, it is one run.  The next
                    # code point brings the count to that of whole pieces.
                    run = self.piece(part[q] + after[0][0])
                    actual = base + _total(run)
                    last = after[:1] if len(after[0]) > 1 else after
                    base += _total(changes_of(part[q]))
                    whole = [base + x for x in accumulate(x for p in last for x in _listed(changes_of(p)))]
                    base = whole[-1]
                    told = [actual, *whole[1:]]
                    out += [run, [y - x for x, y in zip(told[:-1], told[1:])]]
                    done = q + 1 + len(last)
                else:
                    out.append(changes_of(part[q]))
                    base += _total(out[-1])
                    done = q + 1
            out.append(b"".join(map(changes_of, part[done:])))
            base += _total(out[-1])
        return PrefixTable.made(out, base)


def _total(changes: bytes | list[int]) -> int:
    return int(np.frombuffer(changes, np.int8).sum(dtype=np.int64)) if isinstance(changes, bytes) else sum(changes)


def _listed(changes: bytes | list[int]) -> list[int]:
    return np.frombuffer(changes, np.int8).tolist() if isinstance(changes, bytes) else changes


class PrefixTable:
    """Token counts at every prefix of a text."""

    def __init__(self, deltas: bytes, wide: bytes, marks: bytes):
        self.deltas, self.wide, self.marks = deltas, wide, marks

    @classmethod
    def made(cls, changes: list[bytes | list[int]], total: int) -> "PrefixTable":
        parts, wide, at = [], [], 0
        for own in changes:
            if not isinstance(own, bytes):
                wide += [(at + i, x) for i, x in enumerate(own) if not -128 < x < 128]
                own = np.array([x if -128 < x < 128 else -128 for x in own], np.int8).tobytes()
            parts.append(own)
            at += len(own)
        out = cls(b"".join(parts), np.array(wide, "<i4").tobytes(), b"")
        counts = out.counts()
        assert int(counts[-1]) == total
        out.marks = np.append(counts[:-1:STEP], counts[-1]).astype("<u4").tobytes()
        return out

    def _values(self, start: int, end: int) -> np.ndarray:
        out = np.frombuffer(self.deltas, np.int8)[start:end].astype(np.int64)
        if self.wide:
            at, x = np.frombuffer(self.wide, "<i4").reshape(-1, 2).T
            some = (at >= start) & (at < end)
            out[at[some] - start] = x[some]
        return out

    def counts(self) -> np.ndarray:
        """The count at every prefix, the empty one first."""
        return np.concatenate([[0], np.cumsum(self._values(0, len(self.deltas)))])

    def count_at(self, n: int) -> int:
        """Tokens of the first ``n`` code points."""
        step = min(n, len(self.deltas)) // STEP
        start = step * STEP
        return int(np.frombuffer(self.marks, "<u4")[step] if start < len(self.deltas) else 0 if not self.deltas else self.total()) + int(self._values(start, n).sum())

    def total(self) -> int:
        return int(np.frombuffer(self.marks, "<u4")[-1])

    def longest_within(self, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        return int(np.flatnonzero(self.counts() <= budget)[-1])


_loaded: dict[bytes, PrefixCounter] = {}


def _worker(content: bytes) -> PrefixCounter:
    key = sha256(content).digest()
    if key not in _loaded:
        _loaded[key] = PrefixCounter(content)
    return _loaded[key]


def _tables(counter: PrefixCounter, texts: list[str | None]) -> list[PrefixTable]:
    parts = [counter.pieces(t or "") for t in texts]
    counter.learn({p for own in parts for group in own if not isinstance(group, str) for p in group})
    return [counter.table(own, learnt=True) for own in parts]


def prefix_tables(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes long, deltas, wide, marks binary) for each row; no shuffle."""
    vocab = df.sparkSession.sparkContext.broadcast(file_bytes(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker(vocab.value)
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            tables = _tables(counter, [raw.decode() if raw else None for raw in texts])
            sizes = pa.array([len(raw or b"") for raw in texts], pa.int64())
            held = [pa.array([getattr(t, c) for t in tables], pa.binary()) for c in ("deltas", "wide", "marks")]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, *held], ["doc_id", "n_bytes", "deltas", "wide", "marks"])

    return as_binary(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, deltas binary, wide binary, marks binary")


def counts(tables: DataFrame, limit: int) -> DataFrame:
    """Whole-text counts, the last mark of each stored table."""
    low_first = F.expr("hex(substring(marks, octet_length(marks) - 3, 4))")
    n = F.conv(F.concat(*(F.substring(low_first, at, 2) for at in (7, 5, 3, 1))), 16, 10).cast("long")
    return tables.select("doc_id", "n_bytes", n.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def truncated(df: DataFrame, tables: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): each text cut to its longest prefix of at most ``budget`` tokens, by stored tables
    with one row for each id; texts of other ids, and null ones, are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            cut = [
                None if raw is None or marks is None else raw.decode()[: PrefixTable(deltas, wide, marks).longest_within(budget)]
                for raw, deltas, wide, marks in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], ["doc_id", "text"])

    held = tables.select(F.col("doc_id").alias("of"), "deltas", "wide", "marks")
    rows = as_binary(df, id_col, text_col).join(held, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "deltas", "wide", "marks")
    return rows.mapInArrow(run, "doc_id long, text string")
