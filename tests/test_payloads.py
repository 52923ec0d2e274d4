import pytest
from sparktab.sources import payloads as p


def rows(n, **more):
    return [{"i": i, **more} for i in range(n)]


@pytest.mark.parametrize(
    "value, path",
    [
        (rows(3), ()),
        ({"hits": rows(3), "n": 3}, ("hits",)),
        ({"data": {"items": rows(2)}}, ("data", "items")),
        ({"r": {"data": {"items": rows(2)}}, "meta": rows(1)}, ("r", "data", "items")),
        ({"small": rows(2), "big": rows(3)}, ("big",)),
        ({"b": rows(2), "a": {"x": rows(2)}}, ("b",)),
        ({"b": rows(2), "a": rows(2)}, ("a",)),
        ({"a": {"b": {"c": {"d": rows(2)}}}}, ("a", "b", "c", "d")),
    ],
)
def test_chosen_records(value, path):
    assert p.best_records(value).path == path


@pytest.mark.parametrize("value", [rows(1), [], [1, 2], {"a": 1}, {"a": {"b": {"c": {"d": {"e": rows(2)}}}}}, "x", None, {"a": {"x": 1}, "b": {"y": 1}}])
def test_nothing_to_tabulate(value):
    assert p.best_records(value) is None


def test_record_map_gets_a_free_key_column():
    found = p.best_records({"a": {"_key": 1}, "b": {"_key": 2}})
    assert found.key_column == "_key2" and found.rows == [{"_key2": "a", "_key": 1}, {"_key2": "b", "_key": 2}]


def test_boilerplate_goes_at_every_depth_and_is_reported():
    value = {"url": "x", "a": [{"b_url": 1, "url": 2, "keep": {"node_id": 3, "id": 4}}]}
    plate = p.Boilerplate.of(value)
    assert plate.stripped(value) == {"a": [{"keep": {"id": 4}}]}
    assert plate.dropped == {"url", "b_url", "node_id"}


def test_bare_url_stays_without_templates():
    assert p.Boilerplate.of({"url": 1}).stripped({"url": 1}) == {"url": 1}


def test_flattening_stops_at_two_levels_and_at_dots():
    assert p.flat({"a": {"b": {"c": {"d": 1}}}, "x.y": {"z": 1}, "e": {}, "p": {"q.r": 1}}) == {"a.b.c": {"d": 1}, "x.y": {"z": 1}, "e": {}, "p": {"q.r": 1}}


def test_canonical_text_keeps_kinds_apart():
    texts = {p.canonical(x) for x in [0, 0.0, False, "0", None, "", [], {}]}
    assert len(texts) == 8
    assert p.canonical({"b": 1, "a": [1.0]}) == p.canonical({"a": [1.0], "b": 1})


def test_states(spark):
    given = {"empty": b"", "bin": b"\xff\xfe", "text": b"hello", "deep": b"[" * 100_000 + b"]" * 100_000, "one": b"5", "rec": b'[{"a":1},{"a":2}]', "twice": b'{"a":1,"a":2}'}
    df = spark.createDataFrame(list(given.items()), "doc_id string, raw binary")
    found = {r.doc_id: r for r in p.extract(df).collect()}
    assert {k: r.state for k, r in found.items()} == {"empty": "empty", "bin": "not_utf8", "text": "plain_text", "deep": "too_deep", "one": "json", "rec": "records", "twice": "json"}
    assert found["twice"].compact == '{"a":2}'


def test_nodes(spark):
    df = spark.createDataFrame([("x", b'{"a":[1,{"b":null}],"c":1.50}')], "doc_id string, raw binary")
    found = {"/".join(r.path): (r.kind, r.json, r.n_children) for r in p.nodes(df).collect()}
    assert found[""][0] == "dict" and found["a"] == ("list", None, 2) and found["a/*/b"] == ("null", "null", 0) and found["c"][:2] == ("float", "1.5")


def test_empty_input(spark):
    df = spark.createDataFrame([], "doc_id string, raw binary")
    assert p.extract(df).isEmpty() and p.nodes(df).isEmpty()
