"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a bounded slice of the documents (about ``common.SLICE_BYTES`` of text).  Its words
become numbers, and its suffixes are sorted into a suffix array by as many words as a window has; suffixes whose first word
is in no test item are left out, since no test suffix begins so.  Every test suffix is then looked for in the array of every
shard by binary search, which gives the interval of suffixes that begin with its window.  Each place found is
extended to the longest verbatim match: word by word, the interval of test suffixes (sorted themselves) that go on like the
text is narrowed by binary search, so a passage in many items and many documents is not paired out.

The test items reach the shards as blocks of at most ``BLOCK_WORDS`` words, read on the driver one after the other; a
worker that has several holds one at a time and loads the others again for its next shard, whatever the size of the
benchmark.  The documents are not shuffled.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower
case.  A window is ``window`` consecutive words of an item; an item with fewer words, but
not none, is one window.  Null and empty texts have no words; a very long text is a shard of its own.  A null item_id is written
``null``; rows that repeat an item_id are more windows of the same item.  Of equally long matches of a document the one that
stands first is told, of one place the item that is first in the order of test suffixes, then of names.  Every document
row gives one output row, null ids and repeated rows included, none for an empty table; an empty benchmark hits nothing; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_binary, in_batches, slices

WINDOW = 10
#: Words of test items in one broadcast block.
BLOCK_WORDS = 1 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_FOLD).split() if raw else []


def suffix_ranks(flat: np.ndarray, depth: int) -> np.ndarray:
    """The place of every suffix in their order by at least ``depth`` words (prefix doubling)."""
    rank = np.unique(flat, return_inverse=True)[1]
    done = 1
    while done < depth:
        after = np.append(rank[done:], np.full(min(done, len(rank)), -1)) + 1
        rank = np.unique(rank * (len(flat) + 2) + after, return_inverse=True)[1]
        done *= 2
    return rank


def bounds(values: np.ndarray, low: np.ndarray, high: np.ndarray, keys: np.ndarray, after: bool) -> np.ndarray:
    """Within each [low, high), where values ascend, the first place not below the key (after: above it)."""
    low, high = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        less = values[mid] <= keys[open_] if after else values[mid] < keys[open_]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
    return low


class Block:
    """Test items as numbered words, and the windows that begin each of their suffixes."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        items = sorted(items, key=lambda x: x[0])
        self.items = [item for item, _ in items]
        flat, rows = [], []
        for k, (_, words) in enumerate(items):
            base = len(flat)
            flat += [self.number.setdefault(w, len(self.number) + 1) for w in words]
            n = min(window, len(words))
            rows += [(base + i, n, k) for i in range(len(words) - n + 1)]
            flat.append(0)
        self.flat = np.array(flat or [0], np.int64)
        at = np.array(rows or np.zeros((0, 3)), np.int64).reshape(-1, 3)
        grams = np.concatenate([self.flat, np.zeros(window, np.int64)])[at[:, :1] + np.arange(window)]
        grams[np.arange(window) >= at[:, 1:2]] = 0
        #: Each different window once, with every (place, item) where it begins, in the order of suffixes.
        self.grams, which = np.unique(grams, axis=0, return_inverse=True) if len(grams) else (grams, np.zeros(0, np.int64))
        rank = suffix_ranks(self.flat, max((len(w) for _, w in items), default=1))
        order = np.lexsort((at[:, 2], rank[at[:, 0]], which))
        self.starts = np.searchsorted(which[order], np.arange(len(self.grams) + 1))
        self.places, self.of = at[order, 0], at[order, 2]
        self.lengths = np.count_nonzero(self.grams, axis=1)
        # Words are packed into as few 64-bit keys as hold a window; a short window ends in the least or the most.
        self.bits = (len(self.number) + 1).bit_length()
        self.each = max(1, min(window, 63 // self.bits))
        self.cuts = [min(self.each, window - i) for i in range(0, window, self.each)]
        most = np.where(np.arange(window) >= self.lengths[:, None], (1 << self.bits) - 1, self.grams)
        self.low, self.high = self._packed(self.grams), self._packed(most)

    def _packed(self, rows: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for n in self.cuts:
            key = np.zeros(len(rows), np.int64)
            for i in range(at, at + n):
                key = key << self.bits | rows[:, i]
            out.append(key)
            at += n
        return out

    def keys(self, text: np.ndarray) -> list[np.ndarray]:
        """The packed window that begins at each word of a text (which ends in at least a window of zeros)."""
        size = len(text) - self.window
        out, at = [], 0
        for n in self.cuts:
            key = np.zeros(size, np.int64)
            for i in range(at, at + n):
                key = key << self.bits | text[i : i + size]
            out.append(key)
            at += n
        return out


def suffix_array(keys: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """The given suffixes in the order of the words in their keys."""
    array = starts[np.argsort(keys[0][starts], kind="stable")]
    first = keys[0][array]
    same = first[1:] == first[:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    if len(tied) and len(keys) > 1:
        own = array[tied]
        array[tied] = own[np.lexsort([*(k[own] for k in reversed(keys[1:])), first[tied]])]
    return array


def interval(block: Block, keys: list[np.ndarray], array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the part of the suffix array that begins with it: [low, high)."""
    first = keys[0][array]
    low, high = np.searchsorted(first, block.low[0], "left"), np.searchsorted(first, block.high[0], "right")
    for k in range(1, len(keys)):
        some = np.flatnonzero((low < high) & (block.low[k - 1] == block.high[k - 1]))
        if not len(some):
            break
        values, a, b = keys[k][array], low[some], high[some]
        low[some], high[some] = bounds(values, a, b, block.low[k][some], False), bounds(values, a, b, block.high[k][some], True)
    return low, high


def longest_matches(block: Block, text: np.ndarray, where: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, item) of the longest verbatim match that begins at each place, where a window begins."""
    low, high, length = block.starts[gram], block.starts[gram + 1], block.lengths[gram].copy()
    flat = np.append(block.flat, 0)
    live = np.arange(len(where))
    while len(live):
        word = text[np.minimum(where[live] + length[live], len(text) - 1)]
        # The suffixes from low to high agree so far; those that go on with the word are a part of them.
        a, b = low[live].copy(), high[live].copy()
        for after in (False, True):
            x, y = low[live].copy(), high[live].copy()
            while (open_ := np.flatnonzero(x < y)).size:
                mid = (x[open_] + y[open_]) // 2
                there = flat[block.places[mid] + length[live[open_]]]
                less = there <= word[open_] if after else there < word[open_]
                x[open_[less]] = mid[less] + 1
                y[open_[~less]] = mid[~less]
            if after:
                b = x
            else:
                a = x
        on = (a < b) & (word > 0)
        live = live[on]
        low[live], high[live] = a[on], b[on]
        length[live] += 1
    return length, block.of[low]


def matches(block: Block, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offset of each document in the shard's word sequence, the sequence as numbers, places where windows begin, which)."""
    n_words = np.array([len(d) for d in docs], np.int64)
    # A document is followed by a number that no item has, so that no match goes past its end.
    offsets = np.concatenate([[0], np.cumsum(n_words + 1)])
    get = block.number.get
    text = np.zeros(int(offsets[-1]) + block.window, np.int64)
    for at, d in zip(offsets, docs):
        text[at : at + len(d)] = [get(w, 0) for w in d]
    starts = np.flatnonzero(text[: offsets[-1]])
    none = np.zeros(0, np.int64)
    if not len(block.grams) or not len(starts):
        return offsets, text, none, none
    keys = block.keys(text)
    array = suffix_array(keys, starts)
    low, high = interval(block, keys, array)
    hit = np.flatnonzero(high > low)
    n = (high - low)[hit]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return offsets, text, array[np.repeat(low[hit], n) + inside], np.repeat(hit, n)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test items, a bounded number of words at a time on the driver."""
    held: list[tuple[str, list[bytes]]] = []
    total = 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))
    for item, raw in rows.toLocalIterator():
        words = words_of(bytes(raw) if raw is not None else None)
        if not words:
            continue
        if held and total + len(words) > BLOCK_WORDS:
            yield held
            held, total = [], 0
        held.append((item, words))
        total += len(words)
    yield held


def _broadcast(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> list[Broadcast]:
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(Block(b, window)) for b in _blocks(benchmark, id_col, text_col)]


def _in_turn(blocks: list[Broadcast]) -> Iterator[Block]:
    """The blocks one after the other; of several, a worker holds one at a time."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            b.__dict__.pop("_value", None)


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each document: (doc_id, n_words, hits, items, longest, longest_item, longest_at).

    hits: spans [start, end) of words inside occurrences of windows, merged; items: the sorted
    items that have one; longest: the longest verbatim match in words, with its item and word.
    """
    schema = "doc_id long, n_words long, hits array<struct<start: long, end: long>>, items array<string>, longest long, longest_item string, longest_at long"
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    blocks = _broadcast(benchmark, item_col, item_text_col, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            docs = [words_of(raw) for raw in batch.column(1).to_pylist()]
            marks = [{} for _ in docs]
            best = [(0, 0, None)] * len(docs)
            items = [set() for _ in docs]
            for block in _in_turn(blocks):
                offsets, text, where, gram = matches(block, docs)
                owner = np.searchsorted(offsets, where, "right") - 1
                length, item = longest_matches(block, text, where, gram)
                for w, k, n, m, i in zip((where - offsets[owner]).tolist(), owner.tolist(), block.lengths[gram].tolist(), length.tolist(), item.tolist()):
                    marks[k][w] = max(marks[k].get(w, 0), n)
                    best[k] = min(best[k], (-m, w, block.items[i]))
                # Items of a document: each of its windows once, with the items that have that window.
                for k, g in np.unique(np.stack([owner, gram], axis=1), axis=0).tolist():
                    items[k].update([block.items[i] for i in block.of[block.starts[g] : block.starts[g + 1]].tolist()])
            hits = []
            for own in marks:
                merged: list[dict] = []
                for at in sorted(own):
                    if merged and at <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], at + own[at])
                    else:
                        merged.append({"start": at, "end": at + own[at]})
                hits.append(merged)
            columns = [
                batch.column(0),
                pa.array([len(d) for d in docs], pa.int64()), pa.array(hits, spans),
                pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                pa.array([-b[0] for b in best], pa.int64()), pa.array([b[2] for b in best], pa.string()), pa.array([b[1] if b[2] is not None else None for b in best], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "hits", "items", "longest", "longest_item", "longest_at"])

    return as_binary(documents, id_col, text_col).mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, in which no window of a test item occurs.

    The search runs beside the other columns in one pass, so nothing is joined back.
    """
    blocks = _broadcast(benchmark, "item_id", "text", window)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            docs = [words_of(None if t is None else t.encode()) for t in batch.column(at).to_pylist()]
            keep = np.ones(len(docs), bool)
            for block in _in_turn(blocks):
                offsets, _, where, _ = matches(block, docs)
                keep[np.searchsorted(offsets, where, "right") - 1] = False
            yield batch.filter(pa.array(keep))

    return in_batches(documents).mapInArrow(run, documents.schema)
