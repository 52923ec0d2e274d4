import csv
import io

from pyspark.sql import functions as F

from sparktab.functions import cells, cost
from sparktab.sources.payloads import list_shape


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


def test_csv_quoting_is_that_of_the_csv_module(spark):
    values = ["", "a", "a,b", 'c"d', "x\ny", "x\r\ny", "\r", " ", "é日😀", '"', ",", "\\N"]
    out = spark.createDataFrame([(v,) for v in values], "x string").select("x", cost.csv_quoted(F.col("x")).alias("y")).collect()
    for r in out:
        buffer = io.StringIO()
        csv.writer(buffer, lineterminator="").writerow([r.x, "z"])
        assert buffer.getvalue() == r.y + ",z"


def test_proxy_counts_pieces(spark):
    assert one(spark, "Hello, 12345  x\n", "string", cost.proxy) == 8
    assert one(spark, None, "string", cost.proxy) == 0


def test_escapes_are_undone(spark):
    for v in ["", "\\", "\\N", "\\\\", "\\@0001", "plain", " "]:
        assert one(spark, v, "string", lambda x: cells.unescaped(cells.escaped(x))) == v


def test_deltas_are_undone(spark):
    for v in [[], [5], [3, 1, 2], [10**18, 10**18 + 1], [-4, -4, 7]]:
        assert one(spark, v, "array<bigint>", lambda x: cells.from_deltas(cells.deltas(x))) == v


def test_never_falls(spark):
    for v, want in [([], True), ([1], True), ([1, 1, 2], True), ([2, 1], False)]:
        assert one(spark, v, "array<bigint>", cells.never_falls) is want


def test_requested_ids(spark):
    for v in ["1", "0001", "\\@0001[142t]", " \\@1 ", "\\@0001"]:
        assert one(spark, v, "string", cells.requested_id) == "0001"
    assert one(spark, "123456", "string", cells.requested_id) == "123456"
    assert one(spark, "abc", "string", cells.requested_id) == "abc"


def test_text_after_marker(spark):
    assert one(spark, "a ### \n\n  first \nsecond", "string", lambda x: cells.after_marker_line(x, "###")) == "first"
    assert one(spark, "nothing", "string", lambda x: cells.after_marker_line(x, "###")) is None


def test_list_shapes():
    cases = {"empty": [[]], "rising": [[1], [1, 1, 5]], "ints": [[3, 1]], "strs": [["a", "b"]], "other": [[True], [1.0], ["a b"], [""], ["\\N"], [1, "x"], [None], [[1]], ["a b"]]}
    for shape, values in cases.items():
        assert [list_shape(v) for v in values] == [shape] * len(values)
