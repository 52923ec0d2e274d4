"""Connected components by alternating large-star and small-star steps.

Links are first contracted where they lie: a task replaces the links of a slice by stars around the
smallest id that they reach.  Every step is an aggregation of the smallest neighbour and an equi-join that brings it
back, so no node's links are gathered; the number of rounds grows with the logarithm of the longest path.
As soon as at most ``CONTRACTED`` links are left, one task settles them.  Each round is written to the shared
checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, durable

#: Links that a task contracts at once (16 MB), and up to which one task settles all that are left.
CONTRACTED = 1 << 20


def lowest_reachable(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` nodes, the smallest node reachable by the links."""
    low = np.arange(size)
    while len(a):
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) with the same connections, at most one for each node of a slice."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        a, b = (table.column(c).to_numpy() for c in ("a", "b"))
        ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        low = lowest_reachable(place[: len(a)], place[len(a) :], len(ids))
        some = low != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[low[some]])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if held and n + batch.num_rows > CONTRACTED:
            yield star(held)
            held, n = [], 0
        held.append(batch)
        n += batch.num_rows
    if held:
        yield star(held)


def _mark(edges: DataFrame) -> tuple:
    """A number of rows and sums that tell one set of links from another."""
    h, low = F.xxhash64("a", "b"), F.lit(0xFFFFFFFF)
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(low)), F.sum(F.shiftrightunsigned(h, 32))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in ``links`` (a, b) with another one, the smallest id reachable from it."""
    some = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    edges = durable(some.mapInArrow(contracted, "a long, b long").distinct())
    mark = _mark(edges)
    while mark[0]:
        if mark[0] <= CONTRACTED:
            done = durable(edges.coalesce(1).mapInArrow(contracted, "a long, b long"))
            drop(edges)
            edges = done
            break
        # Large star: link every neighbour above a node to the smallest of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low.select(F.col("a").alias("a"), "low"), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = durable(large.filter("a > b").distinct())
        # Small star: link the neighbours below a node, and itself, to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        after = durable(small.filter("a > b").distinct())
        drop(edges, large)
        edges, before = after, mark
        mark = _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
