"""Language identification: script ranges, then Viterbi over per-word scores.

Fitting counts character n-grams (one to four letters, with word ends) of labelled words and
keeps, for each language, a fixed table of log probabilities (``BUCKETS`` hashed n-grams); it
uses at most ``SAMPLE_DOCS`` labelled documents, chosen by a digest of their text, so the model
and the cost of fitting have a bound.  The scripts of a language are those that hold at
least ``SCRIPT_SHARE`` of its sampled letters.

Prediction takes every word of every whole text.  A word is a run of letters of one script and of at
most ``CACHE_CHARS`` of them: a run is cut where its script changes, and a longer one goes on as the next
word, so that unspaced writing is judged over its whole length.  The script of a word narrows the
languages that may have it; a Viterbi pass over the words, with a penalty for switching,
labels the spans; the document gets the language with the most letters, and as score the
share of its letters that the language holds times the mean probability of its words.

A text whose best single language cannot be left with profit anywhere (no run of its words gains by other
languages what the switches cost) has that language throughout, which is what the Viterbi pass would say; only the other
texts walk through the pass word by word.

Texts that are null or hold no letter are ``und`` with score 0.  Of languages with equal scores the first in the order
of their names wins.  Null or repeated ids and
extra columns are no concern; every input row gives one output row, none for an empty table.  A very long text is a
slice of its own.  With no labelled document at all every text is ``und``.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_binary, in_batches, slices

#: Bounds of fitting: labelled documents, hashed n-grams; smoothing; cost of a switch (nats).
SAMPLE_DOCS, BUCKETS, SMOOTH, SWITCH = 8192, 1 << 16, 0.5, 12.0
SCRIPT_SHARE = 0.01
#: Words in a worker's cache, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 1 << 17, 48

#: Script ranges by code point, fixed values: (first, last, script).
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"), (0x0B80, 0x0BFF, "tamil"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"),
    (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0xF900, 0xFAFF, "han"), (0x20000, 0x3FFFF, "han"),
)

_runs = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
#: Runs of letters that are one word, told at a glance: short, of Latin letters and marks alone.
_plain = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0300-\u036f\u1e00-\u1eff]{1,%d}" % CACHE_CHARS).fullmatch

_STARTS = np.array([a for a, _, _ in SCRIPTS], np.int64)
_FIRSTS = [a for a, _, _ in SCRIPTS]
_ENDS = np.array([b for _, b, _ in SCRIPTS], np.int64)
NAMES = [*sorted({name for _, _, name in SCRIPTS}), "other"]
_NAMES = np.array([NAMES.index(name) for _, _, name in SCRIPTS])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter, as its place in ``NAMES``."""
    first = np.array([ord(w[0]) for w in words], np.int64)
    at = np.maximum(np.searchsorted(_STARTS, first, "right") - 1, 0)
    return np.where((first >= _STARTS[at]) & (first <= _ENDS[at]), _NAMES[at], len(NAMES) - 1)


@lru_cache(1 << 16)
def cut_run(run: str) -> tuple[str, ...]:
    """The words of a run of letters: cut where the script changes and after ``CACHE_CHARS`` characters.

    Marks, and modifier letters without a script here, go with the letter before them.
    """
    cuts, last = [0], None
    for i, c in enumerate(run):
        kind = unicodedata.category(c)
        if kind[0] == "M":
            continue
        at = bisect_right(_FIRSTS, ord(c)) - 1
        script = SCRIPTS[at][2] if at >= 0 and ord(c) <= SCRIPTS[at][1] else "other"
        if script == "other" and kind == "Lm":
            script = last
        if i and (script != last and last is not None or i - cuts[-1] >= CACHE_CHARS):
            cuts.append(i)
        last = script
    return tuple(run[a:b] for a, b in zip(cuts, [*cuts[1:], len(run)]))


def words_of(texts: list[str | None]) -> list[list[str]]:
    """The words of each text."""
    runs = [_runs(t) if t else [] for t in texts]
    odd = {r: cut_run(r) for r in set().union(*runs) if not _plain(r)}
    odd = {r: words for r, words in odd.items() if len(words) > 1}
    if not odd:
        return runs
    return [own if odd.keys().isdisjoint(own) else [w for r in own for w in odd.get(r, (r,))] for own in runs]


def grams_of(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, their hashed n-grams one row each), words of a length together.

    n-grams are of one to four characters of the lower-cased word with its ends marked.
    """
    marked = [f"<{w.lower()}>" for w in words]
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(marked):
        by_size.setdefault(len(w), []).append(i)
    for size, own in by_size.items():
        for at in range(0, len(own), 4096):
            some = own[at : at + 4096]
            codes = np.frombuffer("".join([marked[i] for i in some]).encode("utf-32-le"), np.uint32).reshape(-1, size).astype(np.uint64)
            out = []
            for k in range(1, min(4, size) + 1):
                h = np.full((len(some), size - k + 1), k, np.uint64)
                for j in range(k):
                    h = (h + codes[:, j : size - k + 1 + j]) * _BASE
                    h ^= h >> np.uint64(29)
                out.append(h * _BASE >> np.uint64(65 - BUCKETS.bit_length()))
            yield np.array(some), np.concatenate(out, axis=1).astype(np.int64)


class Model:
    """Log probabilities of n-grams by language, and the languages of each script."""

    def __init__(self, langs: list[str], table: np.ndarray, scripts: dict[str, list[int]]):
        self.langs, self.table, self.scripts = langs, table, scripts
        #: What a script adds to a score: much less for languages that do not use it.
        self._shut = np.zeros((len(NAMES), max(1, len(langs))), np.float32)
        for name, own in scripts.items():
            self._shut[NAMES.index(name)] = -40.0
            self._shut[NAMES.index(name), own] = 0
        self._place: dict[str, int] = {}
        self._held = np.zeros((0, len(langs)), np.float32)

    def learn(self, words: set[str]) -> None:
        """Score words that the cache does not hold: mean n-gram log probability by language, times
        the length of the word, less the best of them."""
        if len(self._place) >= CACHE_WORDS:
            self._place, self._held = {}, self._held[:0]
        new = list(words.difference(self._place))
        if not new:
            return
        scores = np.zeros((len(new), len(self.langs)), np.float32)
        for places, grams in grams_of(new):
            scores[places] = self.table[:, grams].mean(axis=2, dtype=np.float64).T
        scores *= np.array([len(w) + 1 for w in new], np.float32)[:, None]
        scores += self._shut[scripts_of(new)]
        scores -= scores.max(axis=1, keepdims=True)
        n = len(self._held)
        self._place.update(zip(new, range(n, n + len(new))))
        self._held = np.concatenate([self._held, scores])

    def scores(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, and all word scores after each other with their offsets."""
        words = words_of(texts)
        self.learn(set().union(*words))
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        at = np.fromiter(map(self._place.__getitem__, chain.from_iterable(words)), np.int64, int(offsets[-1]))
        return words, self._held[at], offsets

    def settled(self, scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text the language that all its words have on the best path, or -1 where switches may pay.

        Leaving the best single language for a run of words costs two switches, one at either end of the
        text; if no run gains as much by other languages, nothing is left to find.
        """
        out = np.full(len(offsets) - 1, -1, np.int64)
        some = np.flatnonzero(np.diff(offsets))
        if not len(some):
            return out
        totals = np.add.reduceat(scores, offsets[some], axis=0, dtype=np.float64)
        best = totals.argmax(axis=1)
        if len(self.langs) == 1:
            out[some] = 0
            return out
        own = np.repeat(best, np.diff(offsets)[some])
        rows = np.arange(len(scores))
        others = scores.astype(np.float64)
        mine = others[rows, own].copy()
        others[rows, own] = -np.inf
        gain = others.max(axis=1) - mine
        for k, a, b in zip(some.tolist(), offsets[some].tolist(), offsets[some + 1].tolist()):
            sums = np.cumsum(gain[a:b])
            low = np.minimum.accumulate(np.concatenate([[0.0], sums[:-1]]))
            inside, ahead, behind = (sums - low).max(), sums.max(), sums[-1] - low.min()
            if inside < 2 * SWITCH - 1e-3 and ahead < SWITCH - 1e-3 and behind < SWITCH - 1e-3:
                out[k] = 0
        out[some] = np.where(out[some] == 0, best, -1)
        return out

    def walked(self, scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The best language of each word, by the recurrence.

        Texts go through it side by side, the longest first, so that each step
        handles the texts that still have words.
        """
        n = np.diff(offsets)
        order = np.argsort(-n, kind="stable")
        starts, lengths = offsets[:-1][order], n[order]
        kind = np.min_scalar_type(len(self.langs))
        back = np.zeros((len(scores), len(self.langs)), kind)
        value = np.zeros((len(order), len(self.langs)))
        own = np.arange(len(self.langs), dtype=kind)
        longest = int(lengths[0]) if len(lengths) else 0
        alive = np.searchsorted(-lengths, -np.arange(longest), "left").tolist() if longest else []
        for t, k in enumerate(alive):
            at = starts[:k] + t
            v = value[:k]
            if t:
                switched = v.max(axis=1, keepdims=True) - SWITCH
                stay = v >= switched
                back[at] = np.where(stay, own, v.argmax(axis=1)[:, None])
                v = np.where(stay, v, switched)
            value[:k] = v + scores[at]
        path = np.zeros(len(scores), kind)
        state = value.argmax(axis=1) if len(value) else np.zeros(0, np.int64)
        for t in range(longest - 1, -1, -1):
            k = alive[t]
            at = starts[:k] + t
            path[at] = state[:k]
            state[:k] = back[at, state[:k]]
        return path

    def paths(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """(words, offsets, scores, best language of each word), all texts at once."""
        words, scores, offsets = self.scores(texts)
        whole = self.settled(scores, offsets)
        n = np.diff(offsets)
        path = np.repeat(whole, n)
        rest = np.flatnonzero((whole < 0) & (n > 0))
        if len(rest):
            at = np.flatnonzero(path < 0)
            path[at] = self.walked(scores[at], np.concatenate([[0], np.cumsum(n[rest])]))
        return words, offsets, scores, path

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans of words [start, end) by language) of each text."""
        if not self.langs:
            return [("und", 0.0, [])] * len(texts)
        words, offsets, scores, path = self.paths(texts)
        letters = np.fromiter(map(len, chain.from_iterable(words)), np.float64, len(path))
        chance = np.exp(scores[np.arange(len(path)), path]) / np.exp(scores).sum(axis=1) if len(path) else np.zeros(0)
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if a == b:
                out.append(("und", 0.0, []))
                continue
            share = np.bincount(path[a:b], letters[a:b], len(self.langs))
            best = int(share.argmax())
            mine = path[a:b] == best
            sure = float((chance[a:b] * letters[a:b])[mine].sum() / share[best])
            cuts = [0, *(np.flatnonzero(np.diff(path[a:b])) + 1).tolist(), b - a]
            spans = [(x, y, self.langs[path[a + x]]) for x, y in zip(cuts[:-1], cuts[1:])]
            out.append((self.langs[best], min(1.0, float(share[best] / share.sum()) * sure), spans))
        return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from rows with a text and a language.

    The sample: the share of the rows, by a digest of the text, that gives ``sample_docs`` of
    them on average.  Counts are made where the texts are read and summed by (language, n-gram); the
    driver gets at most ``BUCKETS`` sums for each language.
    """
    rows = in_batches(labelled).filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    n = rows.count()
    share = min(1.0, sample_docs / max(n, 1))
    slot = F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 20))
    sample = rows.filter(slot < math.ceil(share * (1 << 20))).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            seen: dict[str, Counter] = {}
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(words_of([raw.decode()])[0])
            for lang, own in seen.items():
                words, times = list(own), np.array(list(own.values()), np.int64)
                table = np.zeros(BUCKETS + len(NAMES), np.int64)
                if words:
                    for places, grams in grams_of(words):
                        np.add.at(table, grams, times[places][:, None])
                    np.add.at(table, BUCKETS + scripts_of(words), times * np.array([len(w) for w in words]))
                some = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(table[some], pa.int64())], ["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    full = np.zeros((len(langs), BUCKETS + len(NAMES)))
    full[[langs.index(x) for x in counts.column("lang").to_pylist()], counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    table, letters = full[:, :BUCKETS], full[:, BUCKETS:]
    share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    scripts = {name: np.flatnonzero(share[:, j] >= SCRIPT_SHARE).tolist() for j, name in enumerate(NAMES)}
    scripts = {name: own for name, own in scripts.items() if own}
    if langs:
        table = np.log((table + SMOOTH) / (table + SMOOTH).sum(axis=1, keepdims=True))
    return Model(langs, table, scripts)


def detect(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans) for each row; no shuffle.

    spans: runs of words of one language, [start, end) in words of letters of one script.
    """
    held = documents.sparkSession.sparkContext.broadcast((model.langs, model.table.astype(np.float32), model.scripts))
    schema = "doc_id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in slices(batches, 1):
            found = own.predict([None if raw is None else raw.decode() for raw in batch.column(1).to_pylist()])
            spans = [[{"start": a, "end": b, "lang": x} for a, b, x in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return as_binary(documents, id_col, text_col).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows kept from fitting: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_sure(documents: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows, with all their columns, whose language is known with at least this score."""
    held = documents.sparkSession.sparkContext.broadcast((model.langs, model.table.astype(np.float32), model.scripts))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in slices(batches, at):
            found = own.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score, _ in found], pa.bool_()))

    return in_batches(documents).mapInArrow(run, documents.schema)
