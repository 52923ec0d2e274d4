"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each leaf of the tree holds the merge rank of the pair that begins at a symbol, packed with
its position, so that the root is always the leftmost pair of the lowest rank.  A merge
changes three leaves, and each change climbs the tree once: a word of n symbols takes
O(n log n) however long it is.  Different words of a slice of text go through their trees side by
side, one merge of each at a time; words beyond ``SIDE_BY_SIDE`` bytes go alone.

Texts are prepared as the vocabulary file says (NFC, runs of white space to one space,
lower case character by character, split into words), special strings inside a text are
tokens of their own, and a token list is decoded by joining token strings with a space.

Letters and numbers are those of Unicode 16, which the library goes by: code points that ``regex``
knows from later versions count as neither; capitals that Python does not know yet have their lower case from a list.

Null and empty texts have no tokens and an empty decoded text.  Every input row gives one
output row, repeated rows and null ids included, and none for an empty table; a very long text is a slice of its own;
extra columns are ignored.  A vocabulary file that asks for other steps than these is refused.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_binary, file_bytes, slices
from .hashing import Lookup

#: Words held in a worker's cache before it starts anew, and the longest word it holds.
CACHE_WORDS, CACHE_CHARS = 1 << 18, 64
#: The longest word, in bytes, that is merged side by side with others.
SIDE_BY_SIDE = 64

_NONE = 1 << 62


#: Code points that are letters or numbers to ``regex`` and not in Unicode 16, fixed values: (first, last).
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Lower case of capitals that came with Unicode 16 and 17, fixed values.
LOWER_CASE = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}

_NEWER = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER)
_high = re.compile(f"[\\u{NEWER[0][0]:04x}-\U0010ffff]").search
_capital = regex.compile("[" + "".join(map(chr, LOWER_CASE)) + "]").search


class Splitter:
    """All matches of a tokeniser's split, with the letters and numbers of Unicode 16."""

    def __init__(self, pattern: str):
        self._find = regex.compile(pattern).findall
        self._odd = regex.compile(f"[{_NEWER}]").search
        known = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").replace(r"[^\s\p{L}\p{N}]", "\0")
        known = known.replace(r"\p{L}", rf"[\p{{L}}--[{_NEWER}]]").replace(r"\p{N}", rf"[\p{{N}}--[{_NEWER}]]")
        self._known = regex.compile("(?V1)" + known.replace("\0", rf"[[^\s\p{{L}}\p{{N}}]||[{_NEWER}]]")).findall

    def __call__(self, text: str) -> list[str]:
        return self._find(text) if text.isascii() or not _high(text) or not self._odd(text) else self._known(text)


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {b: chr(b) for b in own}
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + len(chars) - len(own))
    return [chars[b] for b in range(256)]


def merge_all(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges, lowest rank first and leftmost among equals, until none is left.

    ``merges`` maps a pair of symbols to (rank, merged symbol).
    """
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    leaves = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * leaves)

    def packed(left: int, right: int) -> int:
        found = merges.get((symbols[left], symbols[right]))
        return _NONE if found is None else found[0] << 32 | left

    for i in range(n - 1):
        tree[leaves + i] = packed(i, i + 1)
    for i in range(leaves - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += leaves
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low

    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while (root := tree[1]) != _NONE:
        i = root & 0xFFFFFFFF
        j = after[i]
        symbols[i] = merges[symbols[i], symbols[j]][1]
        symbols[j] = -1
        after[i] = k = after[j]
        put(j, _NONE)
        if k < n:
            before[k] = i
            put(i, packed(i, k))
        else:
            put(i, _NONE)
        if (h := before[i]) >= 0:
            put(h, packed(h, i))
    return [s for s in symbols if s >= 0]


class Forest:
    """Segment trees of many words at once: column w of every array belongs to word w."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        ranks = np.array([r for r, _ in merges.values()], np.int64)
        self.rank = Lookup(np.array([a << 32 | b for a, b in merges], np.int64), ranks)
        self.made = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, np.int64)
        self.made[ranks] = [m for _, m in merges.values()]

    def packed(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank and place of pairs of symbols; none where a symbol is negative or nothing merges."""
        rank = self.rank(left << 32 | right)
        return np.where((rank >= 0) & (left >= 0) & (right >= 0), rank << 32 | at, _NONE)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Merge words given as columns (symbols down, -1 below the last); merged-away symbols become -1."""
        height, width = symbols.shape
        if height < 2:
            return symbols
        leaves = 1 << (height - 1).bit_length()
        # One more row, always -1, stands for "no neighbour" at either end.
        held = np.full((height + 1, width), -1, np.int64)
        held[:height] = symbols
        after = np.broadcast_to(np.arange(1, height + 2)[:, None], (height + 1, width)).copy()
        before = np.broadcast_to(np.arange(-1, height)[:, None], (height + 1, width)).copy()
        tree = np.full((2 * leaves, width), _NONE, np.int64)
        places = np.arange(height - 1)[:, None]
        tree[leaves : leaves + height - 1] = self.packed(held[: height - 1], held[1:height], places)
        for i in range(leaves - 1, 0, -1):
            np.minimum(tree[2 * i], tree[2 * i + 1], out=tree[i])
        todo = np.flatnonzero(tree[1] != _NONE)

        def put(at: np.ndarray, value: np.ndarray, words: np.ndarray) -> None:
            at = at + leaves
            tree[at, words] = value
            while at[0] > 1:
                at = at >> 1
                tree[at, words] = np.minimum(tree[2 * at, words], tree[2 * at + 1, words])

        while len(todo):
            root = tree[1, todo]
            i = root & 0xFFFFFFFF
            j = after[i, todo]
            k = np.minimum(after[j, todo], height)
            new = self.made[root >> 32]
            held[i, todo], held[j, todo] = new, -1
            after[i, todo], before[k, todo] = k, i
            put(j, np.full(len(todo), _NONE), todo)
            put(i, self.packed(new, held[k, todo], i), todo)
            h = before[i, todo]
            some = h >= 0
            if some.any():
                put(h[some], self.packed(held[h[some], todo[some]], new[some], h[some]), todo[some])
            todo = todo[tree[1, todo] != _NONE]
        return held[:height]


class WordBpe:
    """Encoder and decoder of a BPE vocabulary with word ends (``</w>``)."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        first, *others = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if steps != ["NFC", "Replace", "Lowercase"] or (first.get("type"), first.get("invert")) != ("Split", True) or [x.get("use_regex") for x in others] != [False]:
            raise ValueError("this vocabulary asks for other steps than NFC, white space, lower case, split, bytes")
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.end] for c in alphabet]
        self._find = Splitter(first["pattern"]["Regex"])
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self._cache: dict[str, tuple[bytes, str]] = {}
        self._forest = Forest(self.merges)
        self._first = np.array(self.inner, np.int64)
        self._last = np.array(self.last, np.int64)

    def learn(self, words: set[str]) -> None:
        """Encode words that the cache does not hold, those of a length together."""
        if len(self._cache) >= CACHE_WORDS:
            self._cache.clear()
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words.difference(self._cache):
            raw = w.encode()
            if len(raw) <= SIDE_BY_SIDE:
                by_size.setdefault(len(raw), []).append((w, raw))
        for size, group in by_size.items():
            for at in range(0, len(group), 1 << 14):
                some = group[at : at + (1 << 14)]
                raw = np.frombuffer(b"".join(r for _, r in some), np.uint8).reshape(-1, size).T
                symbols = self._first[raw]
                symbols[-1] = self._last[raw[-1]]
                done = self._forest.merge(symbols).T
                kept = done >= 0
                packed, ends = done[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1) * 4).tolist()
                names = list(map(self.tokens.__getitem__, done[kept].tolist()))
                start = 0
                for (w, _), end in zip(some, ends):
                    self._cache[w] = packed[start:end], " ".join(names[start // 4 : end // 4])
                    start = end

    def word(self, word: str) -> tuple[bytes, str]:
        """The ids of one prepared word (packed) and its token strings (joined)."""
        raw = word.encode()
        ids = merge_all([*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]], self.merges)
        out = struct.pack(f"<{len(ids)}I", *ids), " ".join(self.tokens[i] for i in ids)
        if len(word) <= CACHE_CHARS:
            if len(self._cache) >= CACHE_WORDS:
                self._cache.clear()
            self._cache[word] = out
        return out

    @staticmethod
    def prepared(text: str) -> str:
        """NFC and lower case by single characters (a final sigma is no special case)."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return text.translate(LOWER_CASE) if _capital(text) else text

    def words(self, text: str) -> list[str | int]:
        """The words of a text, and the id of each special string in it."""
        at, found = 0, []
        for m in self._special.finditer(text):
            found += [*self._find(self.prepared(text[at : m.start()])), self.special[m[0]]]
            at = m.end()
        return found + self._find(self.prepared(text[at:] if at else text))

    def parts(self, words: list[str | int]) -> list[tuple[bytes, str]]:
        """(packed ids, joined token strings) for each word or special id."""
        get, one = self._cache.get, self.word
        return [get(w) or (one(w) if isinstance(w, str) else (struct.pack("<I", w), self.tokens[w])) for w in words]

    def encode(self, text: str) -> list[int]:
        packed = b"".join(p for p, _ in self.parts(self.words(text)))
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_loaded: dict[bytes, WordBpe] = {}


def _worker(content: bytes) -> WordBpe:
    key = sha256(content).digest()
    if key not in _loaded:
        _loaded[key] = WordBpe(content)
    return _loaded[key]


def encode_decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit, decoded string) for each row.

    The vocabulary file (a few MB, fixed) is read on the driver and broadcast, so executors
    need no copy of it.  Rows stay where they were read: no shuffle.
    """
    vocab = df.sparkSession.sparkContext.broadcast(file_bytes(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(vocab.value)
        for batch in slices(batches, 1):
            ids, decoded = [], []
            texts = [bpe.words(raw.decode()) if raw else [] for raw in batch.column(1).to_pylist()]
            bpe.learn({w for words in texts for w in words if isinstance(w, str)})
            for words in texts:
                parts = bpe.parts(words)
                ids.append(b"".join([p for p, _ in parts]))
                decoded.append(" ".join([d for _, d in parts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return as_binary(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Lengths and digests of what ``encode_decode`` returns."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
