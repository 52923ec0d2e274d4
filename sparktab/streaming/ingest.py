"""Structured Streaming over payload files and over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.cost import TokenModel, proxy
from ..operators.store import Store
from ..plans.compress import compress

PAYLOAD = "doc_id string, raw binary"


def payload_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of payloads (doc_id, raw) as they arrive."""
    return spark.readStream.schema(PAYLOAD).parquet(path)


def compress_stream(payloads: DataFrame, store_path: str, out_path: str, checkpoint: str, tokens: TokenModel = proxy) -> StreamingQuery:
    """Compress what is there now and end: documents to ``out_path``, stored cells to the store.

    A batch that runs again writes its own folder again and finds its objects already in the
    store, so nothing is doubled.
    """
    spark = payloads.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        done = compress(rows, with_store=True, tokens=tokens)
        Store(spark, store_path).commit(done.moved, done.ids)
        done.documents.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return payloads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events in tumbling windows, complete once the watermark has passed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
