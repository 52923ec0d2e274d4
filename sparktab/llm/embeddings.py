"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

A vector (scaled to length one) is rotated by random signs and Walsh-Hadamard transforms,
three times over; its hash is the axis on which its largest coordinate lies, with the sign.
A table joins the hashes of three rotations; a vector goes to its own bucket and, by
multiprobe, to the next likely ones, whose axes fall least short of the largest.  Two vectors
are compared, with an exact cosine in double precision, if they share a bucket of a table
and their labels are equal.

Equal vectors are joined first and count by their number.  A bucket is dealt out in blocks of
at most ``BLOCK`` vectors, every pair of blocks in a task of its own, so that a bucket of any
size is compared whole and none is gathered.  A pair that shares several buckets counts in
the first of them only, so links are counted once; what leaves a task is a count and the smallest
partner for each vector, never the pairs.

Vectors that are null, empty, zero, or hold a null or non-finite component, and rows with a null
label, link with nothing.  Vectors of different lengths are never compared.  A null id links
with nothing and is a component of its own (null); rows that repeat an id are vectors that link like
others, and count as such.  Extra columns are ignored; an empty table gives no row; vectors may be of any length, which
only the memory for two blocks of them bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .graph import components, lowest_reachable

COSINE = 0.98
#: Tables, rotations joined in a table, probes of each table, vectors in a block, and the seed of the
#: rotations.  A pair at the least cosine misses one table with probability 0.084 (64 dimensions).
TABLES, JOINED, PROBES, BLOCK, SEED = 6, 3, 4, 512, 20240607


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row (a power of two wide), in n log n steps."""
    n, width = x.shape[1], 1
    while width < n:
        x = x.reshape(len(x), -1, 2, width)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        width *= 2
    return x / np.sqrt(n)


def buckets(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """The buckets of each vector: an array (vectors, tables, probes) of numbers, the own one first."""
    n, dim = unit.shape
    wide = 1 << max(2, (dim - 1).bit_length())
    padded = np.zeros((n, wide))
    padded[:, :dim] = unit
    rng = np.random.default_rng(seed + dim)
    out = np.zeros((n, tables, probes), np.int64)
    for t in range(tables):
        code, short = np.full((n, 1), t, np.int64), np.zeros((n, 1))
        for _ in range(JOINED):
            y = padded
            for _turn in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], wide))
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
            value = np.take_along_axis(y, top, axis=1)
            # What a probe costs: how far its coordinates fall short of the largest ones.
            costs = (short[:, :, None] + (np.abs(value[:, :1]) - np.abs(value))[:, None, :] ** 2).reshape(n, -1)
            codes = (code[:, :, None] * (2 * wide) + (2 * top + (value < 0))[:, None, :]).reshape(n, -1)
            best = np.argsort(costs, axis=1, kind="stable")[:, :probes]
            code, short = np.take_along_axis(codes, best, axis=1), np.take_along_axis(costs, best, axis=1)
        out[:, t] = code
    return out


def units(vectors: list[list[float]]) -> list[np.ndarray]:
    """Each vector scaled to length one, without overflow."""
    out = []
    for v in vectors:
        x = np.array(v, np.float64)
        x = x / np.abs(x).max()
        out.append(x / np.sqrt((x * x).sum()))
    return out


def _hashed(distinct: DataFrame) -> DataFrame:
    """(h1, h2, id, label, n, unit binary, buckets) of each different vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                found = units(batch.column(5).to_pylist())
                codes: list = [None] * len(found)
                for dim in {len(u) for u in found}:
                    own = [i for i, u in enumerate(found) if len(u) == dim]
                    for i, c in zip(own, buckets(np.stack([found[i] for i in own])).reshape(len(own), -1).tolist()):
                        codes[i] = c
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([u.tobytes() for u in found], pa.binary()), pa.array(codes, pa.list_(pa.int64()))], ["h1", "h2", "id", "label", "n", "unit", "buckets"])

    return distinct.select("h1", "h2", "id", "label", "n", "embedding").mapInArrow(run, "h1 long, h2 int, id long, label string, n long, unit binary, buckets array<long>")


def _compared(bucket: int, left: tuple, right: tuple | None, least: float):
    """Pairs (i, j) of two blocks (or within one) with the cosine, counted in this bucket first.

    A block is (units, buckets as (vectors, tables, probes)).
    """
    a, codes_a = left
    b, codes_b = right or left
    rows, cols = [], []
    for at in range(0, len(a), 256):
        i, j = np.nonzero(a[at : at + 256] @ b.T >= least)
        i += at
        if right is None:
            keep = i < j
            i, j = i[keep], j[keep]
        # The first bucket that the two share is the one that counts them.
        open_ = np.arange(len(i))
        mine = np.zeros(len(i), bool)
        for t in range(codes_a.shape[1]):
            if not len(open_):
                break
            x, y = codes_a[i[open_], t], codes_b[j[open_], t]
            same = x[:, :, None] == y[:, None, :]
            first = np.where(same, x[:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2))
            mine[open_] = first == bucket
            open_ = open_[first == np.iinfo(np.int64).max]
        rows.append(i[mine])
        cols.append(j[mine])
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _links(members: DataFrame, least: float) -> DataFrame:
    """(h1, h2, id, n, root): links of a vector found in a pair of blocks, and a vector they reach.

    Rows come sorted by (label, bucket, blocks); a group of rows is at most two blocks.
    """

    def compared(key: tuple, rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows)
        unit = [np.frombuffer(u, np.float64) for u in table.column("unit").to_pylist()]
        if len(unit) < 2:
            return None
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        block = table.column("block").to_numpy()
        codes = np.array(table.column("buckets").to_pylist(), np.int64).reshape(len(unit), TABLES, -1)
        links, low = np.zeros(len(unit), np.int64), np.arange(len(unit))
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for dim in {len(u) for u in unit}:
            own = np.array([len(u) == dim for u in unit])
            one, two = (np.flatnonzero(own & (block == x)) for x in key[2:])
            if not len(one) or not len(two):
                continue
            left = np.stack([unit[i] for i in one]), codes[one]
            right = None if key[2] == key[3] else (np.stack([unit[i] for i in two]), codes[two])
            i, j = _compared(key[1], left, right, least)
            pairs.append((one[i], two[j]))
        for i, j in pairs:
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
        if not links.any():
            return None
        low = lowest_reachable(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), len(unit))
        root = np.full(len(unit), np.iinfo(np.int64).max)
        np.minimum.at(root, low, ids)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(pa.array(some)) for c in ("h1", "h2", "id")] + [pa.array(links[some]), pa.array(root[low][some])], ["h1", "h2", "id", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "bucket", "low", "high"))))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if keys[a] != key and rows:
                    if (out := compared(key, rows)) is not None:
                        yield out
                    rows = []
                key = keys[a]
                rows.append(batch.slice(a, b - a))
        if rows and (out := compared(key, rows)) is not None:
            yield out

    return members.mapInArrow(run, "h1 long, h2 int, id long, n long, root long")


def near_duplicates(embeddings: DataFrame, least: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vector.alias("embedding"), F.coalesce(good, F.lit(False)).alias("good")
    ).withColumns({"h1": F.xxhash64("label", "embedding"), "h2": F.hash("embedding", "label")})
    distinct = rows.filter("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("n"))
    vectors = durable(_hashed(distinct))
    # Buckets with at least two vectors; the key is written anew so that the join shuffles both
    # sides itself and adaptive execution can split a hot bucket.
    placed = vectors.select("h1", "h2", "label", F.explode(F.array_distinct("buckets")).alias("bucket"))
    shared = placed.groupBy("label", "bucket").agg(F.count("*").alias("size")).filter("size > 1")
    key = F.bitwise_not("bucket").alias("key")
    members = placed.select("h1", "h2", "label", "bucket", key).join(shared.select("label", key, F.ceil(F.col("size") / block).cast("int").alias("blocks")), ["label", "key"])
    dealt = (
        members.withColumn("block", F.pmod(F.col("h1"), F.col("blocks").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("h1", "h2", "label", "bucket", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    gathered = dealt.join(vectors.select("h1", "h2", "id", "n", "unit", "buckets"), ["h1", "h2"])
    # Written out partitioning: one group for each pair of blocks, sorted so that a worker streams them.
    place = ["label", "bucket", "low", "high"]
    found = durable(_links(gathered.repartition(*place).sortWithinPartitions(*place), least))
    linked = found.groupBy("h1", "h2").agg(F.sum("n").alias("others"))
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    one = (
        vectors.select("h1", "h2", "id", "n")
        .join(linked, ["h1", "h2"], "left")
        .join(parts, "id", "left")
        .select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component"))
    )
    joined = rows.select("vec_id", "good", "h1", "h2").join(one, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("good"), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
