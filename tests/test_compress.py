import json
import random

import pytest
from sparktab.operators import store
from sparktab.operators.render import LEGEND
from sparktab.plans.compress import compress, decompress
from sparktab.sources import documents, payloads

AWKWARD = [None, True, False, 0, 1, -1, 3.0, 1.5, 10**20, "", " ", "a,b", 'c"d', "x\ny", "x\r\ny", "\\N", "\\E", "\\A", "\\\\N", "\\", "\\@0001", "日本😀", "true", "null", "3.0", "[2]{i:int}"]
ARRAYS = [[], [1, 2, 3], [3, 1], [-5, -5], [10**18, 10**18 + 1], ["a", "b"], ["a b"], ["a,b"], [""], ["\\N"], [1, "x"], [[1], []], [{"k": 1}], [True]]


def alternating(v, o, n=8):
    return [{"i": i, "pad": "the same long text in every row", "a": v if i % 2 else o} for i in range(n)]


def tabulated():
    """Payloads that must come out as tables."""
    out = {f"scalar{k}": alternating(v, "other") for k, v in enumerate(AWKWARD)}
    out |= {f"array{k}": alternating(v, [7]) for k, v in enumerate(ARRAYS)}
    out |= {
        "zero": alternating(0, 0.0), "bool": alternating(True, 1), "absent": [{"i": i, "pad": "the same long text", **({"x": None} if i % 3 else {})} for i in range(9)],
        "deep": [{"i": i, "a": {"b": {"c": {"d": i}}}, "pad": "the same long text"} for i in range(6)],
        "constant": [{"a": {"x": 1, "y": [1, 2]}, "b": "the same"} for _ in range(5)],
        "wrapped": {"meta": {"n": 1}, "r": {"data": {"items": alternating("x", "y"), "more": [1]}}},
        "map": {f"k{i}": {"usd": i, "eur": i * 1.5, "name": "the same long text"} for i in range(6)},
        "clash": {f"k{i}": {"_key": i, "name": "the same long text"} for i in range(6)},
        "many": [{"i": i, "s": ["open", "closed"][i % 2], "pad": "the same long text"} for i in range(95)],
        "header": [{"i": i, "t": "[95]{i:int,t:str}\n[95]{i:int,t:str}", "u": f"x\n[95]{{i:int}}\n{i}"} for i in range(95)],
    }
    return out


def degraded():
    """Payloads that may fall back, and must survive."""
    return {
        "comma": alternating(1, 2) + [{"p,q": 1}], "newline": [{"n\nl": i, "pad": "the same long text"} for i in range(5)], "dot": [{"x.y": i, "x": 1, "pad": "the same"} for i in range(5)],
        "empty dict": alternating({}, {"a": 1}), "both": alternating({"b": 1}, 5), "scalars": {"a": 1, "b": 2.0}, "ragged map": {"a": {"x": 1}, "b": {"y": 1}}, "columns": {"h": {"t": list(range(50))}},
        "lone": 5, "text": "just text", "colon": [{"k:v": i, "pad": "the same long text"} for i in range(5)],
    }


def generated(seed, n):
    rng = random.Random(seed)
    keys = ["a", "b", "c", "k:v", "url", "node_id", "_url", "user id"]

    def family():
        return rng.choice([
            lambda i: rng.randint(-9, 9**9), lambda i: f"word{rng.randint(0, 99)}", lambda i: sorted(rng.sample(range(10**6), 4)), lambda i: rng.sample(["x", "y", "z"], 2), lambda i: {"in": i, "out": {"deep": rng.random()}},
            lambda i: rng.choice(AWKWARD), lambda i: rng.choice(ARRAYS), lambda i: ["a long repeated value", "another repeated value"][i % 2],
        ])

    out = {}
    for k in range(n):
        columns = {key: family() for key in rng.sample(keys, rng.randint(1, 5))}
        rows = [{"i": i, **{c: (f(i) if rng.random() > 0.12 else rng.choice(AWKWARD)) for c, f in columns.items() if rng.random() < 0.85}} for i in range(rng.randint(6, 20))]
        value = rows
        for depth in range(rng.randint(0, 3)):
            value = {f"level{depth}": value, "meta": rng.choice([1, "x", None, {"q": [1]}])}
        out[f"random{k}"] = value
    return out


def frame(spark, given):
    return spark.createDataFrame([(k, json.dumps(v).encode()) for k, v in given.items()], "doc_id string, raw binary")


def stripped(value):
    return payloads.Boilerplate.of(value).stripped(value)


@pytest.fixture(scope="module")
def everything(spark):
    given = {**tabulated(), **degraded(), **generated(7, 150)}
    return given, compress(frame(spark, given)).documents.collect()


def test_documents_read_back_to_the_same_value(everything):
    given, rows = everything
    assert len(rows) == len(given)
    for r in rows:
        want = given[r.doc_id] if r.status == "unchanged" else stripped(given[r.doc_id])
        assert payloads.canonical(documents.restored(r.document)) == payloads.canonical(want), r.doc_id


def test_nothing_costs_more_than_it_did(everything):
    assert all(r.after <= r.before and r.saved >= 0 for r in everything[1])


def test_tables_are_made_where_they_must_be(everything):
    rows = {r.doc_id: r for r in everything[1]}
    assert [k for k in tabulated() if rows[k].status != "table"] == []
    # The generator must reach the table, too.
    assert sum(r.status == "table" for k, r in rows.items() if k.startswith("random")) > 50
    assert not any("reads back to another" in (r.note or "") for k, r in rows.items() if k in tabulated())


def test_dropped_keys_are_reported_only_where_lost(everything):
    given, rows = everything
    for r in rows:
        if r.status == "unchanged":
            assert r.dropped is None
        else:
            plate = payloads.Boilerplate.of(given[r.doc_id])
            plate.stripped(given[r.doc_id])
            assert set(r.dropped) == plate.dropped


def test_legend_explains_what_is_there(everything):
    rows = {r.doc_id: r.document for r in everything[1]}
    told = {k: {clause for clause, text in LEGEND.items() if text in d.partition("\n")[2].partition("\n")[0]} for k, d in rows.items()}
    assert "dotted" in told["deep"] and "dotted" not in told["zero"]
    assert "keyed" in told["map"] and "#keyed" in rows["map"]
    assert "repeat" in told["many"] and "repeat" not in told["zero"]
    assert "null" in told["absent"]


def test_dictionaries(spark):
    yes = {"strings": alternating("a long value that repeats", "another value that repeats", 20), "objects": alternating({"name": "x", "code": [1, 2, 3]}, {"name": "y", "code": [4, 5]}, 20), "numbers": [{"i": i, "a": [10**15 + 0.5, 10**15 + 1][i % 2]} for i in range(60)]}
    no = {"unique": [{"i": i, "a": f"value number {i}"} for i in range(20)], "short": alternating("x", "y", 8)}
    found = {r.doc_id: r.document for r in compress(frame(spark, {**yes, **no})).documents.collect()}
    assert {k for k, d in found.items() if "\n#dict{" in d} == set(yes)


def test_types_are_backed_by_values(everything):
    for r in everything[1]:
        if r.status != "table":
            continue
        shape = documents.parsed(r.document)
        for at, (name, kind, nullable) in enumerate(shape["columns"]):
            cells = [row[at] for row in shape["records"]]
            if kind in ("ints", "dints", "strs"):
                assert any(c not in ("", "\\N", "\\A") for c in cells)
            assert (kind == "dict") == (name in shape["dict"])
            assert nullable == any(c in ("", "\\N") for c in cells)


def test_store_holds_what_documents_move_out(spark, tmp_path):
    body = "one long sentence after another, " * 20
    given = {
        "a": [{"id": i, "body": f"{body}{i}"} for i in range(8)], "b": [{"id": i + 100, "body": f"{body}{i + 1}"} for i in range(8)], "crlf": [{"id": i, "body": f"{body}\r\n\r{i}"} for i in range(3)],
        "json": [{"id": i, "m": [body, i, None]} for i in range(4)], "short": [{"id": i, "body": f"x{i}", "pad": "the same long text"} for i in range(6)],
    }
    done = compress(frame(spark, given), with_store=True)
    held = store.Store(spark, str(tmp_path / "store"))
    held.commit(done.moved, done.ids)
    n = held.objects.count()
    held.commit(done.moved, done.ids)
    assert (held.objects.count(), held.index.count()) == (n, 23) and n == 16
    rows = {r.doc_id: r for r in done.documents.collect()}
    assert rows["short"].held == 0 and "#store" not in rows["short"].document
    back = {r.doc_id: r for r in decompress(done.documents.select("doc_id", "document"), held).collect()}
    assert {k: r.canon for k, r in back.items()} == {k: payloads.canonical(v) for k, v in given.items()}
    without = {r.doc_id: r.error for r in decompress(done.documents.select("doc_id", "document")).collect()}
    assert {k for k, e in without.items() if e} == {"a", "b", "crlf", "json"}


def test_unchanged_documents_store_nothing(spark):
    done = compress(frame(spark, {"x": {"h": {"t": ["word " * 100]}}}), with_store=True)
    assert done.moved.isEmpty() and done.ids.isEmpty()


def test_no_payloads(spark):
    assert compress(spark.createDataFrame([], "doc_id string, raw binary")).documents.isEmpty()


def test_broken_documents_are_errors_and_not_values(spark):
    texts = ["#sparktab/v1", "#sparktab/v1\n[2]{a:int}\n1\n", '#sparktab/v1\n[1]{a:str}\n"x\n', "#sparktab/v1\n[1]{a:str,b:int}\nx\n", "not json"]
    rows = [(str(i), t) for i, t in enumerate(texts)]
    assert all(r.error and r.canon is None for r in decompress(spark.createDataFrame(rows, "doc_id string, document string")).collect())


def test_more_stored_values_than_ids_is_one_payloads_matter(spark):
    """A payload beyond the last id stores nothing and says so; the one beside it is stored."""
    bulk = "many words that are worth moving out of the document, all the same length and more, " * 2
    rows = [("big", json.dumps([{"i": i, "b": f"{bulk}{i}"} for i in range(10_050)])), ("small", json.dumps([{"i": i, "b": f"{bulk}{i}"} for i in range(12)]))]
    done = compress(spark.createDataFrame([(i, t.encode()) for i, t in rows], "doc_id string, raw binary"), with_store=True)
    found = {r.doc_id: r for r in done.documents.collect()}
    assert found["small"].status == "table" and found["small"].held == 12
    assert found["big"].status in ("json", "unchanged") and "more values to store" in found["big"].note and found["big"].held == 0
    assert [r.doc_id for r in done.moved.select("doc_id").distinct().collect()] == ["small"]


def test_one_broken_cell_is_one_documents_matter(spark, tmp_path):
    bulk = "many words that are worth moving out of the document, all the same length and more, " * 2
    rows = [(x, json.dumps([{"i": i, "b": f"{x} {bulk}{i}"} for i in range(12)]).encode()) for x in ("one", "two")]
    done = compress(spark.createDataFrame(rows, "doc_id string, raw binary"), with_store=True)
    own = store.Store(spark, str(tmp_path))
    own.commit(done.moved, done.ids)
    used = documents.used_cells(done.documents)
    assert used.count() == 24 and store.orphaned(own.index, used).isEmpty()
    own.delete(own.objects.filter("content like 'two%'").first().name)
    back = {r.doc_id: r for r in decompress(done.documents.select("doc_id", "document"), own).collect()}
    assert back["one"].error is None and json.loads(back["one"].canon)[3]["i"] == 3
    assert back["two"].canon is None and "stored elsewhere" in back["two"].error
