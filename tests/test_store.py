import json

import pytest
from pyspark.sql import functions as F
from sparktab.functions.cells import content_name
from sparktab.operators import store


@pytest.fixture
def held(spark):
    objects = spark.createDataFrame([("x",), ("y",), ("z",)], "content string").select(content_name(F.col("content")).alias("name"), "content")
    name = {r.content: r.name for r in objects.collect()}
    index = spark.createDataFrame([("d1", "0001", name["x"]), ("d1", "0002", name["y"]), ("d2", "0001", name["x"])], store.INDEX)
    return index, objects, name


def test_detectors_are_quiet_on_a_good_store(held):
    index, objects, _ = held
    assert store.missing(index, objects).isEmpty() and store.broken(index, objects).isEmpty()


def test_detectors_find_what_is_wrong(held):
    index, objects, name = held
    assert [r.cell_id for r in store.missing(index, objects.filter("content <> 'y'")).collect()] == ["0002"]
    changed = objects.withColumn("content", F.when(F.col("content") == "x", "other").otherwise(F.col("content")))
    assert sorted((r.doc_id, r.problem) for r in store.broken(index, changed.filter("content <> 'y'")).collect()) == [("d1", "content changed"), ("d1", "missing"), ("d2", "content changed")]
    assert [r.content for r in store.leaked(index, objects).collect()] == ["z"]
    assert sorted(r.content for r in store.kept(index, objects).collect()) == ["x", "y"]
    assert [r.cell_id for r in store.orphaned(index, index.filter("cell_id = '0001'").select("doc_id", "cell_id")).collect()] == ["0002"]


def test_resolving_a_broken_cell_names_the_problem(held):
    index, objects, _ = held
    changed = objects.withColumn("content", F.when(F.col("content") == "x", "other").otherwise(F.col("content"))).filter("content <> 'y'")
    found = {(r.doc_id, r.cell_id): (r.content, r.problem) for r in store.resolve(index, changed).collect()}
    assert found == {("d1", "0001"): (None, "content changed"), ("d1", "0002"): (None, "missing"), ("d2", "0001"): (None, "content changed")}
    assert store.bundles(index, objects.filter("content <> 'y'")).filter("bundle is null").first().doc_id == "d1"


def test_listings_and_single_objects(spark, held, tmp_path):
    index, objects, name = held
    own = store.Store(spark, str(tmp_path))
    assert own.documents().isEmpty() and not own.has_document("d1") and not own.has_object("x")
    own._append(objects, "objects")
    own._append(index, "store_index")
    assert [r.doc_id for r in own.documents().collect()] == ["d1", "d2"] and [r.name for r in own.names().collect()] == sorted(name.values())
    assert own.has_document("d1") and not own.has_document("d3") and own.has_object(name["x"])
    own.delete(name["y"], name["z"])
    assert not own.has_object(name["y"]) and [r.content for r in own.objects.collect()] == ["x"]
    own._append(objects.filter("content = 'z'"), "objects")
    assert own.objects.count() == 2


def test_a_rewrite_that_did_not_end_changes_nothing(spark, held, tmp_path):
    _, objects, _ = held
    own = store.Store(spark, str(tmp_path))
    own._append(objects, "objects")
    (tmp_path / "objects.1").mkdir()
    assert own.objects.count() == 3
    own.delete("none")
    assert own.objects.count() == 3 and own._generations("objects") == [1]


def test_bundles_in_parts(spark, held, tmp_path):
    _, objects, name = held
    index = spark.createDataFrame([("d", f"{i:04}", name["xyz"[i % 3]]) for i in range(1, 20)], store.INDEX)
    parts = store.bundles(index, objects, block=8)
    assert sorted((r.part, len(json.loads(r.bundle)["index"])) for r in parts.collect()) == [(0, 7), (1, 8), (2, 4)]
    other = store.Store(spark, str(tmp_path))
    assert other.import_bundles(parts).isEmpty() and other.index.count() == 19 and other.objects.count() == 3


def test_collection_is_dry_unless_told(spark, held, tmp_path):
    index, objects, _ = held
    own = store.Store(spark, str(tmp_path))
    own._append(objects, "objects")
    own._append(index, "store_index")
    assert own.collect() == 1 and own.objects.count() == 3
    assert own.collect(delete=True) == 1 and own.objects.count() == 2
    assert store.broken(own.index, own.objects).isEmpty()


def test_bundles_move_documents_between_stores(spark, held, tmp_path):
    index, objects, name = held
    texts = store.bundles(index, objects)
    other = store.Store(spark, str(tmp_path))
    assert other.import_bundles(texts).isEmpty()
    assert other.index.count() == 3 and sorted(r.content for r in other.objects.collect()) == ["x", "y"]
    one = json.loads(texts.filter("doc_id = 'd2'").first().bundle)
    bad = [{**one, "sparktab_bundle": 9}, {**one, "objects": {}}, {**one, "objects": {name["x"]: "forged"}}]
    refused = other.import_bundles(spark.createDataFrame([(json.dumps(b),) for b in bad], "bundle string"))
    assert sorted(r.problem for r in refused.collect()) == ["corrupt", "incomplete", "not a bundle"]


def test_another_content_under_a_name_is_refused(spark, held, tmp_path):
    _, objects, name = held
    own = store.Store(spark, str(tmp_path))
    own._append(objects, "objects")
    moved = spark.createDataFrame([("d", 0, "c", "0001", name["x"], "forged")], "doc_id string, row int, col string, cell_id string, name string, cell string")
    with pytest.raises(ValueError):
        own.commit(moved, spark.createDataFrame([("d", "doc")], "doc_id string, document_id string"))
