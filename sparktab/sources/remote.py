"""Payloads from web addresses."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds that a request may take, seconds between two requests to a host, and the largest answer in bytes.
TIMEOUT, PAUSE, MOST_BYTES = 30, 1.0, 64 << 20


def fetched(address: str, timeout: float = TIMEOUT) -> tuple[bytes | None, str | None]:
    """(body, error) of one address; only http and https are asked."""
    if urlsplit(address).scheme not in ("http", "https"):
        return None, "not a web address"
    try:
        request = urllib.request.Request(address, headers={"User-Agent": "sparktab", "Accept": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            body = answer.read(MOST_BYTES + 1)
        return (None, "the answer is too large") if len(body) > MOST_BYTES else (body, None)
    except (urllib.error.URLError, OSError, ValueError) as e:
        return None, f"{type(e).__name__}: {e}"[:300]


def read_addresses(addresses: DataFrame, pause: float = PAUSE, timeout: float = TIMEOUT) -> DataFrame:
    """(doc_id, raw, error) of addresses (doc_id, address): one row each, raw null where there is an error.

    The addresses of a host are one task's work, which waits ``pause`` seconds from one request to the
    next, however many hosts there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, float] = {}
        for batch in batches:
            for doc_id, address, host in zip(*(c.to_pylist() for c in batch.columns)):
                wait = last.get(host, -pause) + pause - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                last[host] = time.monotonic()
                raw, error = fetched(address or "", timeout)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.string()), pa.array([raw], pa.binary()), pa.array([error], pa.string())], ["doc_id", "raw", "error"])

    rows = addresses.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("address").cast("string").alias("address"), F.coalesce(F.parse_url("address", F.lit("HOST")), F.lit("")).alias("host"))
    return rows.repartition("host").mapInArrow(run, "doc_id string, raw binary, error string")


def saved(payloads: DataFrame, folder: str) -> DataFrame:
    """Write payloads (doc_id, raw, error) as a table under a folder; returns those that could not be had."""
    payloads.write.mode("overwrite").parquet(folder)
    return payloads.sparkSession.read.parquet(folder).filter("raw is null").select("doc_id", "error")
