import random
import re

from pyspark.sql import functions as F
from sparktab.functions.cells import content_name
from sparktab.operators import fetch


def spans(text, needle, context):
    out = []
    for m in re.finditer(re.escape(needle), text, re.I):
        a, b = max(0, m.start() - context), min(len(text), m.end() + context)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_spans_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "x", " ", "AB", "é", "😀", "İ", "a.b"]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    for needle in ("ab", "a.b"):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fetch.hit_spans(F.col("t"), needle, 3).alias("s")).collect()
        for r in got:
            assert [(x.start, x.end) for x in r.s] == spans(r.t, needle, 3), r.t


def test_whole_text_where_parts_are_no_shorter(spark):
    df = spark.createDataFrame([("hit here",), ("x" * 600 + "hit" + "y" * 600,), ("none",)], "t string")
    got = [r.p for r in df.select(fetch.matching_parts(F.col("t"), "HIT").alias("p")).collect()]
    assert got[0] == ["hit here"] and len(got[1]) == 1 and len(got[1][0]) == 483 and got[2] == []


def test_outcomes(spark):
    contents = {"0001": "a b c d", "0002": "x " * 30, "0003": "short", "0004": "never"}
    objects = spark.createDataFrame([(v,) for k, v in contents.items() if k != "0004"], "content string").select(content_name(F.col("content")).alias("name"), "content")
    index = spark.createDataFrame(list(contents.items()), "cell_id string, content string").select(F.lit("doc").alias("doc_id"), "cell_id", content_name(F.col("content")).alias("name"))
    asked = spark.createDataFrame([("r", ' "doc" ', ["1", "\\@0002[9t]", "3", "4", "77", "x"]), ("first", "doc", ["2", "3"]), ("gone", "other", ["1"])], "request string, document string, ids array<string>")
    rows = fetch.fetch(asked, index, objects, budget=12).orderBy("request", "pos").collect()
    assert [r.state for r in rows if r.request == "r"] == ["content", "deferred", "content", "missing", "unknown_id", "unknown_id"]
    first = [r for r in rows if r.request == "first"]
    assert [r.state for r in first] == ["truncated", "deferred"] and first[0].content and contents["0002"].startswith(first[0].content) and len(first[0].content) == 12
    assert [r.state for r in rows if r.request == "gone"] == ["unknown_document"]
    found = fetch.fetch(asked, index, objects, query="SHORT").filter("request = 'r'").orderBy("pos").collect()
    assert [r.state for r in found[:3]] == ["no_match", "no_match", "content"]
