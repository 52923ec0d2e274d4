"""The operators applied to their whole tables, with the SQL that gives the same rows.

``QUERIES`` and ``SQL`` are what ``__spark_entry__.py`` registers.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, embeddings, jaccard_join, langid, licenses, substring_dedup, token_counts, warc
from . import secrets as secret_scan
from .common import read

TOKEN_LIMIT = 1024


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file: in the folder that SPARKTAB_TOKENIZERS names, or in the package of them."""
    if folder := os.environ.get("SPARKTAB_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.dedup(read(spark, sf_dir, "documents"), window=50))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(read(spark, sf_dir, "documents")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.resolve(warc.captures(read(spark, sf_dir, "pages"))))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(token_counts.prefix_tables(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")), TOKEN_LIMIT)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"), least=0.98)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = langid.fit(documents.filter(~langid.held_out()))
    found = langid.detect(documents, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_bpe": op5_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_license_scan": op8_license_scan,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_language_id": op10_language_id,
}

_SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h FROM w, unnest(range(1, len(ws) - 48)) AS t(i)),
firsts AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
cov AS (SELECT DISTINCT doc_id, j FROM win JOIN firsts USING (h), unnest(range(i, i + 50)) AS u(j) WHERE doc_id > m),
k AS (SELECT w.doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p) ANTI JOIN cov ON cov.doc_id = w.doc_id AND cov.j = p),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM k GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def _both_cases(pattern: str) -> str:
    """(?i:...) spelt out for ASCII letters alone."""
    head, rest = pattern.split("(?i:", 1)
    inner, tail = rest.split(")", 1)
    return head + "(?:" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in inner) + ")" + tail


def secrets_sql(rules: tuple[secret_scan.Rule, ...] = secret_scan.RULES) -> str:
    parts = []
    for order, r in enumerate(rules):
        p = (_both_cases(r.pattern) if "(?i:" in r.pattern else r.pattern).replace("'", "''")
        parts.append(f"""
SELECT doc_id, {order} AS k, '{r.kind}' AS kind, i, s + list_sum(lens[:i-1])::BIGINT AS a, s + list_sum(lens[:i])::BIGINT AS b, n
FROM (SELECT doc_id, i, lens, list_sum(gaps[:i])::BIGINT AS s, meas[i] AS n FROM
  (SELECT doc_id, list_transform(regexp_extract_all(text, '{p}'), lambda x: length(x)) AS lens,
     list_transform(regexp_extract_all(text, '({p})', {r.measured + 1}), lambda x: length(x)) AS meas,
     list_transform(string_split_regex(text, '{p}'), lambda x: length(x)) AS gaps
   FROM d WHERE regexp_matches(text, '{p}')), unnest(range(1, len(lens) + 1)) AS t(i))
WHERE n >= {r.least}""")
    spans = " UNION ALL ".join(parts).replace("list_sum(lens[:i-1])", "coalesce(list_sum(lens[:i-1]), 0)")
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{rules[k].kind}" for k in range(secret_scan.BASE))
    names = [f"n_{rules[k].kind}" for k in range(secret_scan.BASE)]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({spans}),
g AS (SELECT doc_id, {counts}, string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, k) FILTER (WHERE k < {secret_scan.BASE}) AS base,
  string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce({n}, 0)::BIGINT AS {n}" for n in names)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAK_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i+least(len(ws), 10)-1], ' ') AS g FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS t(i) WHERE len(ws) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i+n-1], ' ') AS g FROM d, ns, unnest(range(1, len(ws) - n + 2)) AS t(i)),
m AS (SELECT doc_id, item_id, n, i FROM dw JOIN iw USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM m, unnest(range(i, i + n)) AS u(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_COSINE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL
  AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98 ELSE false END),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.c),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, m.component_id = e.vec_id AS kept
FROM embeddings e JOIN m USING (vec_id) LEFT JOIN n ON n.a = e.vec_id
"""

_JACCARD_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""

_TRACKING = warc.TRACKING
_WARC_SQL = rf"""
WITH t AS (SELECT page_id, html, trim(url) AS u, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS x FROM pages),
h AS (SELECT *, split_part(x, '?', 1) AS head, CASE WHEN contains(x, '?') THEN regexp_replace(x, '^[^?]*\?', '') ELSE '' END AS q FROM t),
c AS (SELECT page_id, html, CASE WHEN u <> '' THEN
    regexp_replace(regexp_replace(regexp_replace(lower(split_part(head, '/', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '')
    || regexp_replace(regexp_replace(head, '^[^/]*', ''), '/+$', '')
    || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END END AS k, substr(sha256(html), 1, 16) AS tag
  FROM (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '{_TRACKING}'))) AS ps FROM h)),
s AS (SELECT r.page_id, r.k, r.tag AS rtag, max(p.page_id) AS src FROM c r LEFT JOIN c p ON p.k = r.k AND 2 * p.page_id < 2 * r.page_id + 7 GROUP BY r.page_id, r.k, r.tag),
f AS (SELECT s.*, c.html, c.tag FROM s LEFT JOIN c ON c.page_id = s.src),
g AS (SELECT *, CASE WHEN k IS NULL THEN 'no-url' WHEN src IS NULL THEN 'no-response' WHEN rtag IS NULL OR tag IS NULL THEN 'no-validator' WHEN rtag <> tag THEN 'mismatch' ELSE 'resolved' END AS state FROM f)
SELECT page_id, state, CASE WHEN state = 'resolved' THEN src END AS source_id,
  CASE WHEN state = 'resolved' THEN concat('age: ', page_id, '; cache-control: max-age=600; content-length: ', strlen(html), '; content-type: text/html') END AS headers,
  CASE WHEN state = 'resolved' THEN sha256(html) END AS payload_sha256
FROM g
"""


def license_sql() -> str:
    def canonical(x: str) -> str:
        x = f"lower({x})"
        for _ in range(2):
            x = f"regexp_replace({x}, '{licenses.COPYRIGHT}', chr(10) || '\\1', 'g')"
        for old, new in licenses.SPELLINGS:
            x = f"replace({x}, '{old}', '{new}')"
        return f"sha256(trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g')))"

    texts = ", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in sorted(licenses.LICENSES.items()))
    digests = ", ".join(f"('{k}', '{v}')" for k, v in sorted(licenses.DIGESTS.items()))
    return f"""
WITH named AS (SELECT license_id, {canonical("text")} AS digest FROM (VALUES {texts}) AS t(license_id, text) UNION ALL SELECT * FROM (VALUES {digests}) AS t(license_id, digest)),
known AS (SELECT digest, min(license_id) AS license_id FROM named WHERE digest <> sha256('') GROUP BY digest),
d AS (SELECT doc_id, {canonical("text")} AS digest FROM documents)
SELECT doc_id, d.digest, license_id FROM d LEFT JOIN known ON known.digest = d.digest
"""


SQL = {
    "op4_warc_revisits": _WARC_SQL,
    "op8_license_scan": license_sql(),
    "op7_jaccard_join": _JACCARD_SQL,
    "op9_embedding_dedup": _COSINE_SQL,
    "op1_substring_dedup": _SUBSTRING_SQL,
    "op2_secret_scan": secrets_sql(),
    "op3_decontaminate": _LEAK_SQL,
}
