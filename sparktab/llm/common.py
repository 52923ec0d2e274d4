"""What the operators share: durable intermediate tables, Arrow slices, file contents."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import drop, durable  # noqa: F401

#: Text handed to one step of a Python worker, in bytes; bounds what a worker holds at once.
SLICE_BYTES = 4 << 20
#: The largest table that is sent to every executor, in bytes.
BROADCAST_BYTES = 16 << 20
#: Bits of a filter: in one of its rows (as in Spark's bitmaps), for each id, and at most in all (16 MB).
FILTER_ROW, FILTER_ID, FILTER_BITS = 1 << 15, 32, 1 << 27
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Unless the session says otherwise: bytes of rows handed to a Python worker at once, and rows that a Parquet file is
#: read by (columns of long texts are held whole for so many rows).
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.parquet.columnarReaderBatchSize": "128"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _let_go() -> None:
    """Give memory that is free in this process back to the machine: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches with about ``limit`` bytes of the given binary column.

    A single row larger than the limit gets a batch of its own.
    """
    parts: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        start = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if held and held + size > limit:
                parts.append(batch.slice(start, i - start))
                yield _joined(parts)
                parts, start, held = [], i, 0
            held += size
        if start < batch.num_rows:
            parts.append(batch.slice(start))
    if parts:
        yield _joined(parts)
    _let_go()


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    parts = [p for p in parts if p.num_rows] or parts[:1]
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def broadcast_if_small(table: DataFrame, size: Column) -> DataFrame:
    """A written table with a broadcast hint if it is at most ``BROADCAST_BYTES``, by the sum of each row's ``size``.

    A larger one is joined as Spark sees fit, which gives the same rows.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(table) if total <= BROADCAST_BYTES else table


def split_by(rows: DataFrame, table: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose id may stand in a written table, and the others, whose ids do not.

    A bitmap of hashed ids is broadcast, so no row is shuffled.  It has ``FILTER_ID`` bits for each row of the table, so about
    one in that many of the other rows comes with the first (more from 4 million rows on, where it no longer grows); a join
    with the table tells these apart.
    """
    parts = -(-min(max(1, table.count() * FILTER_ID), FILTER_BITS) // FILTER_ROW)
    bit = F.pmod(F.xxhash64(id_col), F.lit(parts * FILTER_ROW).cast("long"))
    part, at = F.shiftright(bit, FILTER_ROW.bit_length() - 1), bit.bitwiseAND(FILTER_ROW - 1)
    # Dealt by their part first, so that tasks do not each send a bitmap of every part.
    bits = table.select(part.alias("_part"), at.alias("_at")).repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_there = F.coalesce(F.getbit(byte, at.bitwiseAND(7).cast("int")), F.lit(0)) == 1
    marked = rows.withColumn("_part", part).join(F.broadcast(bits), "_part", "left")
    return marked.filter(set_there).select(rows.columns), marked.filter(~set_there).select(rows.columns)


def in_batches(df: DataFrame) -> DataFrame:
    """``df``; batches in its session get closer bounds unless it has some set, since rows can be very long."""
    conf = df.sparkSession.conf
    for name, value in SETTINGS.items():
        if conf.get(name, None) is None:
            conf.set(name, value)
    return df


def as_binary(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text as UTF-8 bytes): what the Python sides of operators take.

    Ids are numbers: text that is a number is taken as one, other text ends the job under ANSI rules (Spark's own) and
    is a null id without them.
    """
    df = in_batches(df)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
