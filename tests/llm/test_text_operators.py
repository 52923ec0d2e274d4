"""Operators on texts against brute force, on odd rows."""

import hashlib
import math
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from sparktab.llm import bpe, common, decontaminate, graph, jaccard_join, langid, licenses, substring_dedup, token_counts
from sparktab.llm import secrets as scan
from sparktab.llm.license_texts import LICENSES
from sparktab.llm.queries import vocabulary
from sparktab.sources import tables

from . import data

tokenizers = pytest.importorskip("tokenizers")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def by_row(df, *columns):
    return sorted(repr([r[c] for c in columns]) for r in df.collect())


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_substring_dedup(spark):
    docs, rows = data.documents(spark)
    for window in (50, 7):
        want, first = [], first_windows(rows, window)
        for doc, text, *_ in rows:
            own = spaced(text)
            gone = set()
            for i in range(len(own) - window + 1) if doc is not None else ():
                if doc > first[tuple(own[i : i + window])]:
                    gone.update(range(i, i + window))
            want.append(repr([doc, len(own), len(gone), sha(" ".join(w for i, w in enumerate(own) if i not in gone))]))
        done = substring_dedup.digests(substring_dedup.dedup(docs, window))
        assert by_row(done, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want)
    assert substring_dedup.dedup(data.no_documents(spark)).isEmpty()


def test_substring_dedup_at_every_place_of_a_first_holder(spark):
    """An earlier passage in another context, twice in a later text and in two texts under one id."""
    rng = random.Random(3)
    a, b, c, d, e = (data.words(rng, 40, 10**6) for _ in range(5))
    passage = data.words(rng, 60, 10**6)
    other = data.words(rng, 60, 10**6)
    again = f"{a} {passage} {b}"
    rows = [(1, f"{c} {passage} {d}"), (2, f"{again} {again} {e} {again}"), (3, f"{e} {other} {c}"), (4, f"{a} x {other} y {b}"), (4, f"z {a} x {other} y {b}"), (4, f"{a} x {other} y {b}"), (5, again)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (50, 20):
        want, first = [], first_windows(rows, window)
        for doc, text in rows:
            own = spaced(text)
            gone = {j for i in range(len(own) - window + 1) if doc > first[tuple(own[i : i + window])] for j in range(i, i + window)}
            want.append(repr([doc, len(own), len(gone), sha(" ".join(w for i, w in enumerate(own) if i not in gone))]))
        assert by_row(substring_dedup.digests(substring_dedup.dedup(docs, window)), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want)


def test_substring_dedup_shuffles_only_texts_with_repeats(spark, monkeypatch):
    """Where tables are too large to broadcast: the texts of other documents stay where they are, with any filter."""
    rng = random.Random(9)
    words = [f"{rng.getrandbits(800):0200x}" for _ in range(300 * 60)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, len(words), 60)]
    texts += [f"{texts[7]} end", f"other {texts[7]}"]
    rows = list(enumerate(texts)) + [(None, texts[7]), (300, "another text"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = [repr([i, len(spaced(t)), 60 if i in (300, 301) and t in texts else 0]) for i, t in rows]
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        path = tables.temporary(spark)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        before = shuffled()
        assert by_row(substring_dedup.dedup(docs), "doc_id", "n_words", "n_removed") == sorted(want)
        assert shuffled() - before < sum(map(len, texts)) / 10
        # A filter of one bit for each id at most, which lets many others through.
        monkeypatch.setattr(common, "FILTER_ROW", 8)
        monkeypatch.setattr(common, "FILTER_BITS", 8)
        assert by_row(substring_dedup.dedup(docs), "doc_id", "n_words", "n_removed") == sorted(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_jaccard_join_deals_many_buckets_about_the_same_components(spark, monkeypatch):
    """Two components with many common buckets: no task gets all of these, and the groups are the same."""
    rng = random.Random(12)
    base, end = data.words(rng, 200, 10**6).split(), data.words(rng, 60, 10**6).split()
    texts = []
    for start in (base, base[:140] + end):
        for _ in range(7):
            own = list(start)
            own[rng.randrange(200)] = f"x{rng.random()}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    crowds, dealt = [], jaccard_join._dealt

    def seen(buckets, signatures, every):
        if every:
            crowds.append([r["count"] for r in buckets.groupBy("about").count().collect()])
        return dealt(buckets, signatures, every)

    monkeypatch.setattr(jaccard_join, "_dealt", seen)
    for together in (10**6, 32):
        monkeypatch.setattr(jaccard_join, "TOGETHER", together, raising=False)
        assert by_row(jaccard_join.join(docs), "doc_id", "component_id") == sorted(repr([i, 0 if i < 7 else 7]) for i in range(14))
    (whole,), parts = crowds
    assert whole > 50 and sum(parts) == whole and max(parts) < whole


def test_factors_stand_in_their_sources(spark):
    """Each factor is as long as its window, stands in its source word for word, and cannot be longer there."""
    rng = random.Random(6)
    texts = data.odd_texts()
    a, b = data.words(rng, 300, 10**6).split(), data.words(rng, 200, 10**6).split()
    texts += [" ".join(a), " ".join(a[:150] + ["x"] + a[150:] + b), " ".join(b[100:] + a[20:280] + b[:90]), " ".join(a + b)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.factors for r in substring_dedup.dedup(docs, 50).collect()}
    n = len(texts)
    assert [(f.start, f.end, f.source, f.place) for f in found[n - 4] or []] == []
    assert [(f.start, f.end, f.source, f.place) for f in found[n - 3]] == [(0, 150, n - 4, 0), (151, 301, n - 4, 150)]
    assert {(f.source, f.place - f.start) for f in found[n - 2]} >= {(n - 3, 401), (n - 4, -80), (n - 3, -59)}
    for doc, own in found.items():
        for f in own or []:
            assert f.source < doc and f.end - f.start >= 50
            assert spaced(texts[doc])[f.start : f.end] == spaced(texts[f.source])[f.place : f.place + f.end - f.start]


def first_windows(rows, window):
    first = {}
    for doc, text, *_ in rows:
        own = spaced(text)
        for i in range(len(own) - window + 1) if doc is not None else ():
            key = tuple(own[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    return first


def base_spans(text):
    out = []
    for order, (kind, pattern, group, least) in enumerate((
        ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    )):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(out)


def test_secret_scan(spark):
    docs, rows = data.documents(spark)
    want = []
    for doc, text, *_ in rows:
        found = base_spans(text)
        want.append(repr([doc, *(sum(k == x for _, k, _, _ in found) for x in range(3)), sha(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found))]))
    done = scan.digests(scan.scan(docs))
    assert by_row(done, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want)
    assert done.filter("spans like '%github%' and spans like '%pem%'").count() == 1
    assert scan.scan(data.no_documents(spark)).isEmpty()


def test_trigram_queries():
    assert scan.trigram_query("abcd") == [["abc", "bcd"]]
    assert scan.trigram_query("AB(c|d)") == [["abc"], ["abd"]]
    assert scan.trigram_query("x?abc") == [["abc"]]
    assert scan.trigram_query("[0-9a-f]+") == [] and scan.trigram_query("ab|cdef") == []


def test_redaction_keeps_every_column(spark):
    docs, rows = data.documents(spark)
    done = scan.redact(docs)
    assert done.columns == docs.columns and done.count() == len(rows)
    texts = {r.doc_id: r.text for r in done.collect() if r.doc_id is not None}
    assert texts[0] is None and texts[1] == "" and texts[3] == "one"
    assert texts[28].startswith("[SECRET] and password:short, [SECRET] [SECRET]") or "24be64" not in texts[28]


def marked(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination(spark):
    docs, rows = data.documents(spark)
    texts = data.odd_texts()
    items = [(1, texts[24]), (2, "SHORT item-here"), (10, None), (11, ""), (12, "..."), (None, "nothing of the kind"), (3, texts[24]), (20, "w1"), (5, texts[16])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = {}
    for item, text in items:
        own = marked(text)
        n = min(10, len(own))
        for i in range(len(own) - n + 1) if own else ():
            grams.setdefault(tuple(own[i : i + n]), set()).add(str(item) if item is not None else "null")
    want = []
    for doc, text, *_ in rows:
        own, hit, found = marked(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(own) - n + 1):
                if (g := tuple(own[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        want.append(repr([doc, len(own), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)]))
    done = decontaminate.digests(decontaminate.find(docs, bench))
    assert by_row(done, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(w.endswith("False]") for w in want)
    assert decontaminate.find(data.no_documents(spark), bench).isEmpty()
    assert decontaminate.find(docs, bench.limit(0)).filter("size(items) > 0").isEmpty()


def test_benchmark_in_several_blocks(spark, monkeypatch):
    docs, _ = data.documents(spark)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(data.odd_texts()[16:28])], "item_id long, text string")
    whole = by_row(decontaminate.digests(decontaminate.find(docs, bench)), "doc_id", "n_hit", "items_sha256")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)
    assert by_row(decontaminate.digests(decontaminate.find(docs, bench)), "doc_id", "n_hit", "items_sha256") == whole


def test_longest_match_and_its_place(spark):
    bench = spark.createDataFrame([(7, " ".join(f"b{i}" for i in range(30)))], "item_id long, text string")
    text = "x y " + " ".join(f"b{i}" for i in range(5, 22)) + " z"
    row = decontaminate.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).first()
    assert (row.longest, row.longest_item, row.longest_at, [(h.start, h.end) for h in row.hits]) == (17, "7", 2, [(2, 19)])


def test_longest_matches_by_brute_force(spark):
    """Passages that many items and documents share, short windows, repeated items, in one and in several blocks."""
    rng = random.Random(7)
    common = data.words(rng, 30).split()
    items = [(i, " ".join(common[i : i + 18] + data.words(rng, 9, 30).split())) for i in range(12)] + [(50, "w1 w2"), (51, " ".join(common)), (51, " ".join(common[5:])), (52, " ".join(common)), (53, "w3")]
    texts = [" ".join(data.words(rng, 8, 30).split() + common[rng.randint(0, 9) :] + data.words(rng, 8, 30).split()) for _ in range(20)] + ["w1 w2 w1 w2", "w3", "w4"]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for doc, text in enumerate(texts):
        own, found = text.split(), []
        for item, t in items:
            x = t.split()
            n = min(10, len(x))
            for at in range(len(own)):
                for i in range(len(x) - n + 1):
                    m = next((m for m in range(min(len(x) - i, len(own) - at) + 1) if m == min(len(x) - i, len(own) - at) or x[i + m] != own[at + m]), 0)
                    if m >= n:
                        found.append((-m, at, str(item)))
        want[doc] = (sorted({f[2] for f in found}), -min(found)[0] if found else 0, min(found)[1] if found else None, {f[2] for f in found if f[:2] == min(found)[:2]})
    for words in (decontaminate.BLOCK_WORDS, 25):
        old, decontaminate.BLOCK_WORDS = decontaminate.BLOCK_WORDS, words
        for r in decontaminate.find(docs, bench).collect():
            names, length, at, best = want[r.doc_id]
            assert (r["items"], r.longest, r.longest_at) == (names, length, at) and (r.longest_item in best if best else r.longest_item is None)
        decontaminate.BLOCK_WORDS = old


def test_bpe(spark):
    docs, rows = data.documents(spark)
    library = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append(repr([doc, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False))]))
    done = bpe.digests(bpe.encode_decode(docs, vocabulary("word_bpe_49k.json")))
    assert by_row(done, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)
    assert bpe.encode_decode(data.no_documents(spark), vocabulary("word_bpe_49k.json")).isEmpty()


def test_every_code_point_splits_as_in_the_library():
    with open(vocabulary("word_bpe_49k.json"), "rb") as f:
        words = bpe.WordBpe(f.read())
    with open(vocabulary("byte_bpe_50k.json"), "rb") as f:
        pieces = token_counts.PrefixCounter(f.read())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 37 == 0 or 0xA000 <= c < 0xB000 or any(a <= c <= b for a, b in bpe.NEWER) or c in bpe.LOWER_CASE)]
    texts = [f"a{chr(c)}1{chr(c)}b!{chr(c)}! {chr(c)}" for c in points]
    for name, own, wanted in (("word_bpe_49k.json", words.encode, list), ("byte_bpe_50k.json", pieces.count, len)):
        library = tokenizers.Tokenizer.from_file(vocabulary(name))
        for at in range(0, len(texts), 5000):
            some = texts[at : at + 5000]
            assert [own(t) for t in some] == [wanted(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_vocabularies_are_told_apart(tmp_path):
    """Files of equal length and beginning are vocabularies of their own; other steps are refused."""
    with open(vocabulary("word_bpe_49k.json"), "rb") as f:
        content = f.read()
    other = content.replace(b"<|endoftext|>", b"<|endoftexx|>")
    assert len(other) == len(content) and bpe._worker(content).special != bpe._worker(other).special
    with open(vocabulary("byte_bpe_50k.json"), "rb") as f, pytest.raises(ValueError):
        bpe.WordBpe(f.read())
    with pytest.raises(ValueError):
        token_counts.PrefixCounter(content)


def test_token_counts(spark):
    docs, rows = data.documents(spark)
    library = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    counts = [(doc, len((text or "").encode()), len(library.encode(text or "", add_special_tokens=False).ids)) for doc, text, *_ in rows]
    done = token_counts.counts(token_counts.prefix_tables(docs, vocabulary("byte_bpe_50k.json")), 100)
    assert by_row(done, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(repr([d, b, n, n > 100]) for d, b, n in counts)
    assert token_counts.prefix_tables(data.no_documents(spark), vocabulary("byte_bpe_50k.json")).isEmpty()


PREFIX_TEXTS = [
    "", "Hello  \n\nworld's  'real'  café 日本 12345 <|endoftext|>!!<|endof", "   \n\n\t x  ", "aaaaaaaaaaaa the the  thehe", "we'll they've you're 're '' 'r I'd 'l", "a  <|endoftext|>  b\u00a0 c\u3000\u3000d",
    "!!<|endoftext|><|endoftext|>x", "--------------------------------------------------------------------------------- =", "\n \n  \n   end", "é" * 40 + " ﬁ\u0301\u0301 😀😀", "\r\n\r\n1 2  3", "'", " 'll", "x" + " " * 150 + "y" + "\n" * 70,
]


def test_every_prefix_and_budget():
    with open(vocabulary("byte_bpe_50k.json"), "rb") as f:
        own = token_counts.PrefixCounter(f.read())
    library = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for text in PREFIX_TEXTS:
        table = own.table(own.pieces(text))
        whole = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert table.counts().tolist() == whole, text
        assert [table.count_at(k) for k in range(len(text) + 1)] == whole
        for budget in range(max(whole) + 2):
            assert table.longest_within(budget) == max(k for k, n in enumerate(whole) if n <= budget)
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["a", "the", " ", "  ", "\n", "'", "'ll", "re", "1", "!", "é", "日", "<|", "<|endoftext|>", "\t"]) for _ in range(rng.randint(1, 25)))
        whole = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert own.table(own.pieces(text)).counts().tolist() == whole, text


def test_one_very_long_piece():
    """Counts of a piece without any break, in time that grows with its length."""
    with open(vocabulary("byte_bpe_50k.json"), "rb") as f:
        own = token_counts.PrefixCounter(f.read())
    library = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(1)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))
    table = own.table(own.pieces(text))
    assert len(table.deltas) == len(text)
    for k in (1, 255, 256, 257, 1000, 4321, 20_000):
        assert table.count_at(k) == len(library.encode(text[:k], add_special_tokens=False).ids)


def test_large_changes_are_kept():
    table = token_counts.PrefixTable.made([bytes(5), [300, -299, 1], b"\x01\xff" * 300], 2)
    assert table.counts().tolist()[5:9] == [0, 300, 1, 2] and table.count_at(6) == 300 and table.count_at(7) == 1 and table.total() == table.count_at(608) == 2
    assert table.longest_within(1) == 7 and table.longest_within(2) == 608


def test_truncation(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PREFIX_TEXTS)] + [(None, "a b c d"), (99, None)], "doc_id long, text string")
    tables = token_counts.prefix_tables(docs, vocabulary("byte_bpe_50k.json"))
    library = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for r in token_counts.truncated(docs, tables, 3).collect():
        text = "a b c d" if r.doc_id is None else None if r.doc_id == 99 else PREFIX_TEXTS[r.doc_id]
        if text is None:
            assert r.text is None
        else:
            fits = [k for k in range(len(text) + 1) if len(library.encode(text[:k], add_special_tokens=False).ids) <= 3]
            assert r.text == text[: max(fits)]


def test_piece_programs_agree():
    with open(vocabulary("byte_bpe_50k.json"), "rb") as f:
        own = token_counts.PrefixCounter(f.read())
    import numpy as np

    pieces = [b" erating", b"abcdefgh", b"thethethe"[:8], b"\xe6\x97\xa5\xe6\x9c\xac  "]
    together = own.prefixes_many(np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, 8))
    assert together.tolist() == [own.piece_prefixes(p) for p in pieces]


def jaccard_brute(rows, width, num, den):
    sets = []
    for doc, text, *_ in rows:
        own = spaced("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        n = min(width, len(own))
        sets.append((doc, {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()))
    low = {doc: doc for doc, _ in sets if doc is not None}
    for again in range(len(low)):
        before = dict(low)
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                    low[a] = low[b] = min(low[a], low[b])
        if before == low:
            break
    return sorted(repr([doc, len(x), low.get(doc)]) for doc, x in sets)


@pytest.mark.parametrize("width, num, den", [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_jaccard_join(spark, width, num, den):
    docs, rows = data.documents(spark)
    assert by_row(jaccard_join.join(docs, width, num, den), "doc_id", "n_shingles", "component_id") == jaccard_brute(rows, width, num, den)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.join(data.no_documents(spark)).isEmpty()


@pytest.mark.parametrize("part", [8, 512])
def test_jaccard_join_through_parts_and_trees(spark, monkeypatch, part):
    """Chains and common passages, in buckets cut into parts and whole ones."""
    import random

    rng = random.Random(5)
    monkeypatch.setattr(jaccard_join, "PART", part)
    common = data.words(rng, 30, 10**6).split()
    texts = []
    for _ in range(30):
        texts.append(" ".join(common + data.words(rng, 12, 10**6).split()))
    chain = data.words(rng, 80, 10**6).split()
    for i in range(30):
        chain[(i * 7) % 80] = f"c{i}"
        texts.append(" ".join(chain))
    docs, rows = data.documents(spark, texts)
    assert by_row(jaccard_join.join(docs, 4, 80, 100), "doc_id", "n_shingles", "component_id") == jaccard_brute(rows, 4, 80, 100)


def test_tree_traversal_loses_nothing():
    """Every similar pair comes out of the trees, whatever the widths of the bitmaps, and few others do."""
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(rng.choice(base, rng.integers(20, 200), replace=False)) for _ in range(60)] + [np.unique(rng.integers(0, 2**63, 90).astype(np.uint64)) for _ in range(20)]
    sets += [np.unique(np.append(s[:-2], base[:2])) for s in sets[:20]]
    for size in (31, 32, 33, 64, 65, 127, 130, 600):
        own = rng.integers(0, 2**63, size).astype(np.uint64)
        sets += [np.unique(own), np.unique(own[: size - 2]), np.unique(np.append(own, own[:3] + np.uint64(1)))]
    sizes, bits = np.array([len(s) for s in sets]), [jaccard_join.folded(jaccard_join.bitmap(s), 64) for s in sets]
    assert len({len(x) for x in bits}) > 3
    every = np.arange(len(sets))
    i, j, score = jaccard_join.pairs_of_parts(sizes, bits, every, None, 4, 5)
    found = {frozenset(p) for p in zip(i.tolist(), j.tolist())}
    x, y, _ = jaccard_join.pairs_of_parts(sizes, bits, every[:33], every[33:], 4, 5)
    across = {frozenset(p) for p in zip(x.tolist(), y.tolist())}
    for a in range(len(sets)):
        for b in range(a):
            same = len(np.intersect1d(sets[a], sets[b]))
            if 5 * same >= 4 * (len(sets[a]) + len(sets[b]) - same):
                assert frozenset((a, b)) in found
                assert (b < 33 <= a) <= (frozenset((a, b)) in across)
                assert jaccard_join.possible(len(sets[a]), jaccard_join.bitmap(sets[a]), len(sets[b]), jaccard_join.bitmap(sets[b]), 4, 5)
    assert len(found) == len(i) < 3 * len(sets)
    # The forest connects what the pairs connect, with the fewest pairs.
    kept = jaccard_join.likeliest(i, j, score, len(sets))
    whole, some = (graph.lowest_reachable(p, q, len(sets)) for p, q in ((i, j), (i[kept], j[kept])))
    assert (whole == some).all() and len(kept) == len(sets) - len(set(whole.tolist()))


def test_links_come_from_the_trees(spark):
    """All links between different sets are found by traversal; they are true, and connect what is linked."""
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        own = data.words(rng, 90, 10**6).split()
        for k in range(5):
            own[rng.randrange(90)] = f"c{k}"
            texts.append(" ".join(own))
    docs, rows = data.documents(spark, texts + data.odd_texts())
    classes, named, linked = jaccard_join.links(docs, 4, 80, 100)
    assert classes.count() == len(rows) and named.select("set").distinct().count() == named.count()
    first = {r.set: r["first"] for r in named.collect()}
    text = {r[0]: r[1] for r in reversed(rows)}
    found = [(text[first[r.a]], text[first[r.b]]) for r in linked.collect()]
    assert len(found) >= 40
    for a, b in found:
        x, y = ({tuple(spaced(t.lower())[i : i + 4]) for i in range(len(spaced(t)) - 3)} for t in (a, b))
        assert 100 * len(x & y) >= 80 * len(x | y) and x != y


def test_sets_of_one_number_stay_apart(spark):
    """Different sets whose 64-bit numbers agree get new numbers."""
    rows = [(i, bytes([i // 2] * 16), i % 3, 5, [1, 2], b"x", None) for i in range(12)]
    classes = spark.createDataFrame(rows, "doc_id long, digest binary, number long, n long, prefix array<long>, sig binary, bits binary").withColumn("number", F.when(F.col("doc_id") < 9, 1).otherwise(F.col("doc_id")).cast("long"))
    named = jaccard_join._numbered(classes).collect()
    assert len(named) == 6 == len({r.set for r in named}) and sorted(r["first"] for r in named) == [0, 2, 4, 6, 8, 10]


def test_licenses(spark):
    mit = LICENSES["MIT"].replace("<year> <holder>", "2019-2024 Some One\nCopyright © 2025 Another")
    texts = [mit, mit.upper().replace(", ", " ,\n\n  "), "intro " + mit, None, "", "!!", LICENSES["BSD-3-Clause"].replace("Redistribution and", "redistribution AND") + "\nAll rights reserved.", LICENSES["Unlicense"].replace("non-commercial", "noncommercial")]
    docs, rows = data.documents(spark, texts)
    found = {r.doc_id: (r.license_id, r.digest) for r in licenses.scan(docs).collect()}
    assert [found[i][0] for i in range(len(texts))] == ["MIT", "MIT", None, None, None, None, "BSD-3-Clause", "Unlicense"]
    assert found[3][1] is None and found[4][1] == found[5][1] == sha("")
    assert licenses.scan(docs).count() == len(rows) and licenses.scan(data.no_documents(spark)).isEmpty()


def test_licenses_on_one_line_and_their_notices(spark):
    """Notices go without the text beside them; hostile lines take no long time; long texts match by digest."""
    import os
    import time

    mit = LICENSES["MIT"]
    line = " ".join(mit.replace("<year> <holder>", "2020 Some One and Others").split())
    texts = [
        line, mit.replace("<year> <holder>", "Some One"), mit.replace("Copyright (c) <year> <holder>", "© 2019, 2020 X\n(C) Copyright 2021 Y GmbH. All Rights Reserved."), "Copyright (c) 2020 Some One",
        " ".join(LICENSES["BSD-2-Clause"].replace("<year> <holder>", "1999 X. All rights reserved.").split()), "(c) " * 60_000, "(c) 2020 " * 30_000, "copyright " * 30_000, mit.replace("Permission is hereby granted", "Permission is not granted"),
        "Copyright (c) " + "x" * 300 + " " + mit, "The MIT License (MIT)\n" + LICENSES["MIT, untitled"],
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert time.time() - began < 30
    assert [found[i].license_id for i in range(len(texts))] == ["MIT", "MIT", "MIT", None, "BSD-2-Clause", None, None, None, None, None, "MIT, titled 'The MIT License (MIT)'"]
    assert found[3].digest == sha("") != found[5].digest
    folder = "/usr/share/common-licenses"
    if os.path.isdir(folder):
        for name, file in (("GPL-3.0", "GPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0")):
            with open(f"{folder}/{file}") as f:
                text = f.read()
            own = spark.createDataFrame([(1, text), (2, " ".join(text.upper().split())), (3, text + " more")], "doc_id long, text string")
            assert sorted((r.doc_id, r.license_id) for r in licenses.scan(own).collect() if r.license_id) == [(1, name), (2, name)]


def test_license_table(spark):
    """A table of licences, with nulls, an empty text and two names of one text."""
    table = spark.createDataFrame([("A", "my own terms"), ("B", "My own, terms!"), ("C", None), ("D", "..."), (None, "no name")], "license_id string, text string")
    docs = spark.createDataFrame([(1, "MY OWN TERMS"), (2, "!!"), (3, None), (4, "no name")], "doc_id long, text string")
    assert sorted((r.doc_id, r.license_id) for r in licenses.scan(docs, licenses=table).collect()) == [(1, "A"), (2, None), (3, None), (4, None)]


def test_language_id(spark):
    english, french = "the cat sat on the mat and then it ran away from them", "le chat est sur la table et puis il est parti avec nous"
    texts = [english, french, "ЖЖЖ это русский текст", None, "", "123 !!", f"{english} {english} {french} {french} {french}", english, french, "это ещё один текст", english, french] * 2
    docs, rows = data.documents(spark, texts, ["en", "fr", "ru", None, None, None, None, "en", "fr", "ru", "en", "fr"])
    assert [r.h for r in docs.filter("doc_id is not null").orderBy("doc_id").select(langid.held_out().alias("h")).distinct().collect()] and docs.filter("doc_id is null").select(langid.held_out().alias("h")).first().h is False
    ids = {r.doc_id: r.h for r in docs.filter("doc_id is not null").select("doc_id", langid.held_out().alias("h")).collect()}
    assert ids == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}
    model = langid.fit(docs)
    found = {r.doc_id: r for r in langid.detect(docs, model).collect()}
    assert [found[i].lang_pred for i in range(7)] == ["en", "fr", "ru", "und", "und", "und", "fr"]
    assert found[3].score == 0 and {s.lang for s in found[6].spans} == {"en", "fr"} and len(found[6].spans) == 2
    assert langid.detect(docs, model).count() == len(rows)
    assert model.scripts["cyrillic"] == [model.langs.index("ru")]
    kept = langid.keep_sure(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.filter("text is null or text = ''").isEmpty()
    nothing = langid.fit(data.no_documents(spark))
    assert nothing.langs == [] and {r.lang_pred for r in langid.detect(docs, nothing).collect()} == {"und"}
    assert langid.detect(data.no_documents(spark), model).isEmpty()


def test_language_of_unspaced_runs(spark):
    """A run of letters is judged over its whole length and in each of its scripts."""
    assert langid.cut_run("abcЖЖ漢字かな") == ("abc", "ЖЖ", "漢字", "かな")
    assert langid.cut_run("e\u0301te\u0301Ж\u0301") == ("e\u0301te\u0301", "Ж\u0301") and langid.cut_run("Hawaiʻi") == ("Hawaiʻi",)
    long = "あ" * 40 + "い" * 100
    assert "".join(langid.cut_run(long)) == long and max(map(len, langid.cut_run(long))) == 48
    assert langid.words_of(["one twoЖ", None, "x" * 100]) == [["one", "two", "Ж"], [], ["x" * 48, "x" * 48, "xxxx"]]
    texts = ["the cat sat on the mat", "это русский текст", "これはひらがなのぶんしょうです", "ゐゑゐゑゐゑゐゑゐゑゐゑゐゑ"] * 3
    docs, _ = data.documents(spark, texts, ["en", "ru", "ja", "xx"])
    model = langid.fit(docs)
    mixed = "the" + "этотекст" * 20
    late = "これはひらがなのぶん" * 5 + "ゐゑ" * 200
    found = model.predict([mixed, late])
    assert [f[0] for f in found] == ["ru", "xx"] and [s[2] for s in found[1][2]] == ["ja", "xx"]


def viterbi_brute(model, text):
    """(language, score, spans) by the plain recurrence in Python floats."""
    words, scores, _ = model.scores([text])
    words, n = words[0], len(model.langs)
    if not words:
        return "und", 0.0, []
    value, back = [float(x) for x in scores[0]], []
    for row in scores[1:]:
        best = max(range(n), key=lambda k: value[k])
        came = [k if value[k] >= value[best] - langid.SWITCH else best for k in range(n)]
        value = [max(value[k], value[best] - langid.SWITCH) + float(row[k]) for k in range(n)]
        back.append(came)
    at = max(range(n), key=lambda k: value[k])
    path = [at]
    for came in reversed(back):
        path.append(came[path[-1]])
    path.reverse()
    letters = [sum(len(w) for w, p in zip(words, path) if p == k) for k in range(n)]
    best = max(range(n), key=lambda k: letters[k])
    sure = sum(len(w) * math.exp(float(row[best])) / sum(math.exp(float(x)) for x in row) for w, p, row in zip(words, path, scores) if p == best) / letters[best]
    cuts = [0] + [i for i in range(1, len(path)) if path[i] != path[i - 1]] + [len(path)]
    return model.langs[best], letters[best] / sum(letters) * sure, [(a, b, model.langs[path[a]]) for a, b in zip(cuts[:-1], cuts[1:])]


def test_language_path_and_score_by_brute_force(spark):
    rng = random.Random(4)
    stock = {"en": "the cat sat on a mat and then it ran away from them all".split(), "fr": "le chat est sur la table et puis il est parti avec nous tous".split(), "de": "die katze sitzt auf der matte und dann ist sie weg von uns".split()}
    texts = [" ".join(rng.choice(own) for _ in range(12)) for own in stock.values() for _ in range(6)]
    docs, _ = data.documents(spark, texts, [x for x in stock for _ in range(6)])
    model = langid.fit(docs)
    mixed = []
    for _ in range(60):
        parts = [(rng.choice(list(stock)), rng.randint(1, 14)) for _ in range(rng.randint(1, 6))]
        mixed.append(" ".join(rng.choice(stock[x] if rng.random() < 0.9 else rng.choice(list(stock.values()))) for x, n in parts for _ in range(n)))
    mixed += ["xyz", "la " * 3000, "the cat " * 2000 + "le chat est " * 900, None, "", "1 2 3"]
    found = model.predict(mixed)
    settled = 0
    for text, (lang, score, spans) in zip(mixed, found):
        want = viterbi_brute(model, text)
        assert (lang, spans) == (want[0], want[2]) and abs(score - want[1]) < 1e-4
        settled += len(spans) == 1
    assert 5 < settled < len(mixed) - 5


def test_many_languages():
    import numpy as np

    langs = [f"l{i:03}" for i in range(300)]
    table = np.full((300, langid.BUCKETS), -9.0)
    for i in (130, 260):
        for _, grams in langid.grams_of([f"word{i}".replace("1", "a").replace("2", "b").replace("3", "c").replace("6", "d").replace("0", "e")]):
            table[i, grams] = -1.0
    found = langid.Model(langs, table, {}).predict(["wordace " * 9 + "wordbde " * 20])
    assert found[0][0] == "l260" and found[0][2] == [(0, 9, "l130"), (9, 29, "l260")]


def test_other_licenses(spark):
    docs, _ = data.documents(spark, ["GNU General  Public License, the text", LICENSES["ISC"], "my own"])
    own = {**LICENSES, "GPL-x": "GNU general public license - the text.", "Mine": "My own!", "Mine, again": "my OWN"}
    found = licenses.scan(docs.filter("doc_id < 3"), licenses=own)
    assert sorted((r.doc_id, r.license_id) for r in found.collect()) == [(0, "GPL-x"), (1, "ISC"), (2, "Mine")]
    assert licenses.scan(docs, licenses={}).filter("license_id is not null").isEmpty()
