import json

from pyspark.sql import functions as F
from sparktab.functions.cost import proxy, tiktoken_model
from sparktab.operators import measure, profile, verify
from sparktab.sources import payloads
from sparktab.sources.typed import typed_cells


def frame(spark, values):
    return spark.createDataFrame([(k, json.dumps(v).encode()) for k, v in values.items()], "doc_id string, raw binary")


def told(found):
    return sorted((r.doc_id, ".".join(r.path), r.problem) for r in found.collect())


def test_payload_differences(spark):
    before = {"a": {"x": 1, "y": [1, 2], "z": {"p": 1}, "w": [[1], [2]], "t": True}, "same": [1], "kind": {"v": 1}, "deep": {"l": [{"k": 1}, {"k": 2}]}, "root": 1}
    after = {"a": {"x": 2, "y": [1, 2, 3], "n": {"q": [1]}, "w": [[1], [3]], "t": 1}, "same": [1], "kind": {"v": 1.0}, "deep": {"l": [{"k": 1}, {"k": None}]}, "root": 2}
    found = verify.payload_differences(frame(spark, before), frame(spark, after))
    assert told(found) == [
        ("a", "n", "only after"), ("a", "t", "changed"), ("a", "w.1.0", "changed"), ("a", "x", "changed"), ("a", "y", "length"), ("a", "z", "lost"),
        ("deep", "l.1.k", "changed"), ("kind", "v", "changed"), ("root", "", "changed"),
    ]
    wide = {"w": {f"k{i:02}": i for i in range(30)}}
    other = {"w": {f"k{i:02}": i + 1 for i in range(30)}}
    assert [p for _, p, _ in told(verify.payload_differences(frame(spark, wide), frame(spark, other), most=5))] == [f"k{i:02}" for i in range(5)]


def test_leaves(spark):
    found = payloads.leaves(frame(spark, {"a": {"x": [1, {"y": "s"}], "z": None}, "b": 5})).collect()
    assert {r.doc_id: r.leaves for r in found} == {"a": ["1", '"s"', "null"], "b": ["5"]}


def test_arm_tally_of_empty_arms(spark):
    rows = [("raw", True)] * 5 + [("compressed", True)] * 4 + [("compressed", False)]
    found = {r.arm: (r.n, r.verdict) for r in measure.arm_tally(spark.createDataFrame(rows, "arm string, ok boolean")).collect()}
    assert found == {"raw": (5, "pass"), "compressed": (5, "fail"), "stored": (0, "inconclusive")}
    judged = {r.arm: r.verdict for r in measure.arm_tally(spark.createDataFrame(rows, "arm string, ok boolean"), judged=True).collect()}
    assert judged["compressed"] == "pass"
    nothing = measure.arm_tally(spark.createDataFrame([], "arm string, ok boolean")).collect()
    assert {r.arm for r in nothing} == set(measure.ARMS) and {r.verdict for r in nothing} == {"inconclusive"}


def test_render_with_bare_handles(spark):
    cells = spark.createDataFrame([("d", 0, 0, "word " * 50), ("d", 1, 0, "short"), ("e", 0, 0, "x")], "doc_id string, row int, place int, cell string")
    found = {r.doc_id: r for r in measure.rendered_with_handles(cells, 20).collect()}
    assert (found["d"].n_stored, found["e"].n_stored) == (1, 0) and found["d"].before - found["d"].after == 100 - 4 and found["e"].before == found["e"].after


def test_exact_tokens(spark):
    """An exact tokeniser in the place of the pattern, from a public rank file."""
    import public_tokenizers
    import tiktoken

    model = tiktoken_model(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["", None, "hello world", "it's 1234 é😀", "  \n x"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", model(F.col("t")).alias("n")).orderBy("i").collect()
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [r.n for r in found] == [len(own.encode_ordinary(t)) if t else 0 for t in texts]


def test_dictionaries_priced_in_parts_and_whole(spark):
    """Under a model that adds up, the parts of a dictionary cost what its text costs."""
    rows = [(i, ["open, for now", 'closed "x"', "other\nline", None][i % 4], i % 3, f"v{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, s string, n int, u string").withColumn("doc", F.lit("d")).withColumn("m", F.concat(F.lit("value number "), (F.col("i") % 1200).cast("string")))
    cells = typed_cells(df, "doc", "i", ["s", "n", "u", "m"])
    profiled = profile.columns(cells, spark.createDataFrame([("d", 3000)], "doc_id string, n_rows long"))

    def whole(text):
        return proxy(text)

    sums, texts = (profile.dictionaries(cells, profiled, model, least=-10**6).select("col", "cells_cost", "dict_cost").distinct().orderBy("col").collect() for model in (proxy, whole))
    assert sums == texts and [r.col for r in sums] == ["m", "n", "s"]


def test_running_sums_of_long_arrays(spark):
    from sparktab.functions.cells import deltas, from_deltas

    for n in (0, 1, 255, 256, 257, 3000):
        v = [(i * 37) % 101 for i in range(n)]
        row = spark.createDataFrame([(v,), (None,)], "v array<bigint>").select(from_deltas(deltas(F.col("v"))).alias("w")).collect()
        assert row[0].w == v and row[1].w is None
