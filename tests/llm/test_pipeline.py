import random

import corpus_pipeline
from sparktab.llm import secrets as scan
from tests.llm import data
from tests.llm.test_text_operators import jaccard_brute, marked, sha, tokenizers
from sparktab.llm.queries import vocabulary


def write(spark, folder, texts, items):
    docs, rows = data.documents(spark, texts, ["en"])
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    texts = data.odd_texts()
    items = [(1, texts[24]), (2, None)]
    rows = write(spark, str(tmp_path), texts, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)

    known = steps["language"](spark, docs, str(tmp_path))
    assert known.columns == docs.columns
    kept = {r.doc_id for r in known.collect()}
    assert not kept & {0, 1, 2, 37, 38} and {9, 16, 24, 28} <= kept

    groups = jaccard_brute(rows, 5, 4, 5)
    firsts = {eval(g)[0] for g in groups if eval(g)[0] == eval(g)[2]}
    unique = steps["near_duplicates"](spark, docs, str(tmp_path))
    assert sorted((r.doc_id for r in unique.collect()), key=str) == sorted(firsts, key=str)

    grams = {tuple(marked(texts[24])[i : i + 10]) for i in range(len(marked(texts[24])) - 9)}
    leaky = {d for d, t, *_ in rows if any(tuple(marked(t)[i : i + 10]) in grams for i in range(len(marked(t))))}
    clean = steps["decontaminate"](spark, docs, str(tmp_path))
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((d for d, *_ in rows if d not in leaky), key=str) and leaky == {24, 25}

    safe = steps["secrets"](spark, docs, str(tmp_path))
    assert safe.columns == docs.columns
    assert scan.scan(safe).filter("size(spans) > 0").isEmpty()

    library = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for r in steps["tokens"](spark, docs, str(tmp_path)).collect():
        if r.doc_id is not None:
            ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert r.n_tokens == len(ids) and r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_whole_run_and_empty_tables(spark, tmp_path):
    rows = write(spark, str(tmp_path / "some"), data.odd_texts(), [(1, "nothing that occurs in any of these texts at all, not once")])
    done = corpus_pipeline.run(spark, str(tmp_path / "some"))
    assert 0 < done.count() < len(rows)
    data.no_documents(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).isEmpty()


def test_near_duplicates_by_text_and_not_by_id(spark):
    rng = random.Random(8)
    a, b, c, d, e = (data.words(rng, 60, 10**6) for _ in range(5))
    rows = [(1, a), (2, a + " more"), (2, b), (2, c), (2, c), (3, b + " more"), (4, d), (4, d + " more"), (5, None), (5, ""), (None, e), (None, e), (None, e + " more"), (None, d), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()
    named = [tuple(r) for r in kept if r.doc_id is not None]
    assert sorted((i, t or str(t)) for i, t in named if i != 4) == sorted([(1, a), (2, b), (2, c), (5, "None"), (5, "")])
    assert len([t for i, t in named if i == 4]) == 1
    unnamed = [r.text for r in kept if r.doc_id is None]
    assert len(unnamed) == 3 and {d, None} < set(unnamed) and len({e, e + " more"} & set(unnamed)) == 1
