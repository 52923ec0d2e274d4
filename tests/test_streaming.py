import json

from sparktab.operators.store import Store, broken
from sparktab.streaming import ingest


def test_payload_stream_commits_once(spark, tmp_path):
    body = "a long sentence to be stored, " * 20
    first = [("a", json.dumps([{"i": i, "b": f"{body}{i}"} for i in range(4)]).encode())]
    second = [("b", json.dumps([{"i": i + 100, "b": f"{body}{i}"} for i in range(4)]).encode())]
    where = [str(tmp_path / x) for x in ("in", "store", "out", "checkpoint")]
    for rows in (first, second):
        spark.createDataFrame(rows, ingest.PAYLOAD).write.mode("append").parquet(where[0])
        ingest.compress_stream(ingest.payload_stream(spark, where[0]), *where[1:]).awaitTermination()
    held = Store(spark, where[1])
    assert held.objects.count() == 4 and held.index.count() == 8 and broken(held.index, held.objects).isEmpty()
    assert spark.read.parquet(where[2]).count() == 2


def test_event_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = ingest.event_windows(spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/event[s].parquet"))
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("windows").agg({"n": "sum"}).first()[0] == events.count()
