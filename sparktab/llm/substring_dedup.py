"""Substring dedup by Relative Lempel-Ziv parsing against indexed reference blocks.

Reference blocks.  Every document is cut into blocks at content-defined places: windows of
``window`` words that share the same smallest ``SEED`` -word fingerprint form one block.  Equal
passages are cut alike, so copies meet in the index.  The index maps a block (seed fingerprint, digest of
all its words) to its first holder and the place there; it leaves out blocks whose seed only one document
holds, since no window of theirs can occur in another one.

Parsing.  A document is factored greedily against the blocks of all documents with smaller ids.
A factor is (start, end, source, place): the words from start to end stand in the document
``source`` from word ``place`` on.  A block that an earlier document holds is copied whole.  Where it
differs from all earlier blocks of its seed in some words, a factor begins or ends within it; at such factor
boundaries the windows of the block are looked up one by one against the windows of every other
block with the same seed, so that a factor reaches exactly as far as an earlier document repeats it.  This goes
for every place at which the first holder of a block has it, in each text under its id.  A factor then
runs on as long as the next window stands at the next place of the same source, and so is
at least ``window`` words long; of several sources the earliest document is taken.  The words of
factors are the duplicate spans.  Factors from different sources may overlap.

Work and data: texts are read twice for their blocks, first for the seeds alone (8 bytes of key and an id
for about 18 words), then for the blocks whose seed is shared; only blocks
whose seed occurs with different contexts hand in windows, and texts are joined twice,
by document, with the places of those windows and with their factors.  Either join shuffles the texts of documents that
have such places or factors (told by a broadcast bitmap of their ids) and no others.  Groups (a seed, a block, a window) are
only counted and compared by their smallest document, with partial aggregation; a hot one
is never gathered.  The joins that bring the smallest document back are plain equi-joins whose hot keys
adaptive execution splits.  Every intermediate table goes as soon as it has been read.

Words are maximal runs of characters other than space and U+0009 to U+000D.  Null and empty texts have
no words, texts of fewer than ``window`` words no factors; a very long text is one row of a slice of its own.  Only a
document with a strictly smaller id makes words duplicates: repeated rows
of one id do not (each is judged by its own text), and a null id neither gives nor loses duplicates.  Ids are cast to
long; such as cannot be (under ANSI rules) end the job.  Each input row gives one output row, none for an empty table;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_binary, drop, durable, slices, split_by
from .hashing import grams, joined_words, signed, word_numbers

WINDOW, SEED = 50, 16


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < width:
        rest = width - done
        out = np.minimum(out[:-rest], out[rest:])
    return out


def lowest_seeds(joined: bytes, ends: np.ndarray, window: int, seed: int) -> np.ndarray:
    """The smallest seed fingerprint of each window of a text."""
    if len(ends) < window:
        return np.zeros(0, np.uint64)
    return sliding_min(grams(word_numbers(joined, ends), seed), window - seed + 1)


def blocks_of(raw: bytes, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(seed fingerprint, first window, last window, digest) of each block of a text."""
    joined, ends = joined_words(raw)
    low = lowest_seeds(joined, ends, window, seed)
    if not len(low):
        return low, np.zeros(0, np.int64), np.zeros(0, np.int64), []
    first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(low) - 1]])
    a = np.where(first > 0, ends[first - 1] + 1, 0)
    b = ends[last + window - 1]
    digests = [blake2b(joined[x:y], digest_size=8).digest() for x, y in zip(a.tolist(), b.tolist())]
    return low[first], first, last, digests


def _rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, fp): fp tells apart different texts under one id."""
    return as_binary(documents, id_col, text_col).withColumn("fp", F.crc32("text"))


def _seeds(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """(doc_id, seed): the seed fingerprints of each text's blocks, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            docs, found = [], []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc is not None and raw and len(low := lowest_seeds(*joined_words(raw), window, seed)):
                    found.append(np.unique(low))
                    docs.append(np.full(len(found[-1]), doc, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), signed(np.concatenate(found))], ["doc_id", "seed"])

    return rows.mapInArrow(run, "doc_id long, seed long")


def _blocks(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """Each block of each text; again: the text holds the same block further up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            parts = []
            for doc, raw, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if doc is None or not raw:
                    continue
                seeds, first, last, digests = blocks_of(raw, window, seed)
                n = len(seeds)
                if n:
                    block = np.frombuffer(b"".join(digests), np.int64)
                    again = np.ones(n, bool)
                    again[np.unique(block, return_index=True)[1]] = False
                    parts.append((np.full(n, doc, np.int64), np.full(n, fp, np.int64), seeds, block, first, last, again))
            if parts:
                doc, fp, seeds, block, first, last, again = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(fp), signed(seeds), pa.array(block), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(again)], ["doc_id", "fp", "seed", "block", "first", "last", "again"])

    return rows.mapInArrow(run, "doc_id long, fp long, seed long, block long, first int, last int, again boolean")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, fp, seed, win, at) for each window of the listed blocks of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            docs, fps, seeds, wins, ats = [], [], [], [], []
            for doc, raw, fp, todo in zip(*(c.to_pylist() for c in batch.columns)):
                joined, ends = joined_words(raw)
                ends = ends.tolist()
                for one in todo:
                    for at in range(one["first"], one["last"] + 1):
                        part = joined[ends[at - 1] + 1 if at else 0 : ends[at + window - 1]]
                        wins.append(int.from_bytes(blake2b(part, digest_size=8).digest(), "little", signed=True))
                    n = one["last"] + 1 - one["first"]
                    docs += [doc] * n
                    fps += [fp] * n
                    seeds += [one["seed"]] * n
                    ats += range(one["first"], one["last"] + 1)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(fps, pa.int64()), pa.array(seeds, pa.int64()), pa.array(wins, pa.int64()), pa.array(ats, pa.int32())], ["doc_id", "fp", "seed", "win", "at"])

    return rows.mapInArrow(run, "doc_id long, fp long, seed long, win long, at int")


_FACTORS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("place", pa.int32())]))
_FACTORS_SQL = "array<struct<start:int,end:int,source:long,place:int>>"


def parse(hits: list[dict], window: int) -> list[dict]:
    """The greedy parse: factors from looked-up windows.

    A hit says that ``n`` windows from ``at`` on stand in ``source`` from ``place`` on.  A factor takes in
    the next window as long as that stands at its source's next place.
    """
    out: list[dict] = []
    for x in sorted(hits, key=lambda x: (x["at"], -x["n"], x["source"], x["place"])):
        end = x["at"] + x["n"] - 1 + window
        if out:
            y = out[-1]
            if y["source"] == x["source"] and x["place"] - x["at"] == y["place"] - y["start"] and x["at"] <= y["end"] - window + 1:
                y["end"] = max(y["end"], end)
                continue
        out.append({"start": x["at"], "end": end, "source": x["source"], "place": x["place"]})
    return out


def spans_of(factors: list[dict]) -> list[tuple[int, int]]:
    """The words of factors as spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for x in factors:
        if out and out[-1][1] >= x["start"]:
            out[-1] = out[-1][0], max(out[-1][1], x["end"])
        else:
            out.append((x["start"], x["end"]))
    return out


def _parsed(hits: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [parse(x, window) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, _FACTORS)], ["doc_id", "fp", "factors"])

    listed = hits.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("at", "n", "source", "place")).alias("hits"))
    return listed.mapInArrow(run, f"doc_id long, fp long, factors {_FACTORS_SQL}")


def factors(documents: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, fp, factors): for documents that have some, the copy factors in order.

    factors: array of (start, end, source, place) in words, end exclusive; fp: crc32 of the
    text, for rows that share an id.
    """
    rows = _rows(documents, id_col, text_col)
    seed = min(seed, window)
    # The key of a join is written anew (~seed) wherever both sides have it from one table, so that the join
    # shuffles both itself and adaptive execution can split a hot one.
    key = F.bitwise_not("seed").alias("key")
    held_twice = durable(_seeds(rows, window, seed).groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("seed"))
    blocks = durable(_blocks(rows, window, seed).join(held_twice, "seed", "left_semi"))
    drop(held_twice)
    # The index: each block with its first holder.  min of a struct also brings the place.
    index = durable(blocks.groupBy("seed", "block").agg(F.min(F.struct("doc_id", "fp", "first", "last")).alias("holder"), F.max("doc_id").alias("latest")))
    # Whole blocks.
    held = index.filter(F.col("holder.doc_id") < F.col("latest")).select(key, "block", F.col("holder.doc_id").alias("source"), F.col("holder.first").alias("place"))
    whole = (
        blocks.select(key, "block", "doc_id", "fp", "first", "last")
        .join(held, ["key", "block"])
        .filter("doc_id > source")
        .select("doc_id", "fp", F.col("first").alias("at"), (F.col("last") - F.col("first") + 1).alias("n"), "source", "place")
    )
    # Factor boundaries: seeds that occur in more than one context.
    contexts = index.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select(key)
    opened = index.select(key, "seed", "block", "holder.*").join(contexts, "key", "left_semi")
    # The first holder may hold its block at further places: again in the same text, or in another text
    # under its id.  No earlier document covers those whole, so their windows are looked up too.
    several = blocks.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("doc_id")
    further = blocks.filter("again").unionByName(blocks.filter("not again").join(several, "doc_id", "left_semi"))
    at = ["seed", "doc_id", "fp", "first", "last"]
    # The document is part of the key, so that a block that many documents repeat is dealt out.
    places = opened.select(at).unionByName(further.join(opened, ["seed", "block", "doc_id"], "left_semi").select(at))
    ends = durable(places.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("seed", "first", "last")).alias("todo")))
    # Joined by the same plan at every size: only these documents' texts are shuffled.
    listed, _ = split_by(rows, ends)
    windows = durable(_windows(listed.join(ends.hint("merge"), ["doc_id", "fp"]).select("doc_id", "text", "fp", "todo"), window))
    earliest = windows.groupBy("seed", "win").agg(F.min(F.struct("doc_id", "at")).alias("holder"), F.max("doc_id").alias("latest")).filter("holder.doc_id < latest")
    partial = (
        windows.select(key, "win", "doc_id", "fp", "at")
        .join(earliest.select(key, "win", F.col("holder.doc_id").alias("source"), F.col("holder.at").alias("place")), ["key", "win"])
        .filter("doc_id > source")
        .select("doc_id", "fp", "at", F.lit(1).alias("n"), "source", "place")
    )
    found = durable(_parsed(whole.unionByName(partial), window))
    drop(blocks, index, ends, windows)
    return found


def dedup(documents: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept string, factors) for every row."""
    rows = _rows(documents, id_col, text_col)
    found = factors(documents, window, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            n_words, n_removed, kept = [], [], []
            for raw, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = raw.split() if raw else []
                n_words.append(len(words))
                n = 0
                for start, end in reversed(spans_of(own or [])):
                    n += end - start
                    del words[start:end]
                n_removed.append(n)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), batch.column(2)],
                ["doc_id", "n_words", "n_removed", "kept", "factors"],
            )

    some, none = split_by(rows, found)
    joined = some.join(found.hint("merge"), ["doc_id", "fp"], "left").select("doc_id", "text", "factors")
    joined = joined.unionByName(none.select("doc_id", "text", F.lit(None).cast(_FACTORS_SQL).alias("factors")))
    return joined.mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept string, factors {_FACTORS_SQL}")


def digests(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

