"""The query workload over the driver's tables, with the SQL that gives the same rows.

Each query applies operators of this package to whole tables.  ``QUERIES`` holds the Spark side,
``SQL`` the DuckDB side; a query without SQL decides by the text of whole documents.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as cell_functions
from ..functions.cost import csv_cost, csv_quoted, proxy
from ..operators import encode, fetch, measure, profile, questions, store, verify
from ..operators.render import header_of, rows_as_csv
from ..sources.documents import HEADER_EVERY, header_columns
from ..sources.payloads import extract, from_column, from_rows, leaves, nodes
from ..sources.tables import durable
from ..sources.typed import typed_cells
from .compress import compress, decompress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, table reader) under its name, with its SQL."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _tok(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[A-Za-z]+|[0-9]{{1,3}}|[^A-Za-z0-9\s]|\s+'))"


def _csv(x: str) -> str:
    return f"""CASE WHEN regexp_matches({x}, '[,"\\n\\r]') THEN concat('"', replace({x}, '"', '""'), '"') ELSE {x} END"""


def _md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


# Columns and their profile


@query("""
SELECT source AS doc_id, 'lang' AS col, min(lang) AS value FROM documents GROUP BY source HAVING count(DISTINCT lang) = 1 AND count(lang) = count(*)
UNION ALL SELECT source, 'source', source FROM documents GROUP BY source
UNION ALL SELECT source, 'n_chars', min(n_chars)::VARCHAR FROM documents GROUP BY source HAVING count(DISTINCT n_chars) = 1 AND count(n_chars) = count(*)
""")
def const_columns_documents(spark, read):
    cells = typed_cells(read("documents"), "source", "doc_id", ["source", "lang", "n_chars"])
    counts = read("documents").groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("n_rows"))
    found = profile.constants(profile.columns(cells, counts))
    return found.select("doc_id", "col", F.regexp_replace("json", '^"|"$', "").alias("value"))


@query("SELECT 'k' AS key, 'int' AS kind, count(*) AS n FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') HAVING count(*) > 0")
def column_types_events(spark, read):
    found = nodes(from_column(read("events"), "event_id", "props")).filter("size(path) = 1")
    return found.groupBy("key", "kind").agg(F.count("*").alias("n"))


_KIND = "CASE WHEN {0} IN ('DOUBLE', 'FLOAT') OR {0} LIKE 'DECIMAL%' THEN 'float' WHEN {0} IN ('INTEGER', 'BIGINT') THEN 'int' WHEN {0} = 'VARCHAR' THEN 'str' WHEN {0} = 'BOOLEAN' THEN 'bool' END"


@query("\nUNION ALL ".join(f"""SELECT l_linestatus AS doc_id, '{c}' AS col, CASE WHEN count({c}) = 0 THEN 'null' ELSE any_value({_KIND.format(f"typeof({c})")}) END AS type, count({c}) AS n
FROM lineitem GROUP BY l_linestatus""" for c in ("l_quantity", "l_linenumber", "l_returnflag")))
def column_types_lineitem(spark, read):
    cells = typed_cells(read("lineitem"), "l_linestatus", "l_orderkey", ["l_quantity", "l_linenumber", "l_returnflag"])
    return cells.groupBy("doc_id", "col").agg(profile.column_type().alias("type"), F.count_if(F.col("kind") != "null").alias("n"))


@query("""
WITH k AS (SELECT source, unnest(['chars' || (n_chars % 7)::VARCHAR, 'lang', 'text' || (doc_id % 3)::VARCHAR]) AS key FROM documents)
SELECT source AS doc_id, key, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, key) - 1 AS place FROM k GROUP BY source, key
""")
def presence_order(spark, read):
    """Columns of records with keys that come and go, by how many records have them and then by name."""
    keys = F.array(F.concat(F.lit("chars"), (F.col("n_chars") % 7).cast("string")), F.lit("lang"), F.concat(F.lit("text"), (F.col("doc_id") % 3).cast("string")))
    found = read("documents").select(F.col("source").alias("doc_id"), F.explode(keys).alias("col")).groupBy("doc_id", "col").agg(F.count("*").alias("n_present"))
    ordered = profile.column_order(found)
    return ordered.select("doc_id", F.col("col").alias("key"), F.col("n_present").alias("n"), F.col("place").cast("long").alias("place"))


@query("""
WITH j AS (SELECT d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source AS doc_id, 'quality' AS col, count(*) AS n_present, count(*) - count(quality) AS n_null, count(*) > count(quality) AS nullable FROM j GROUP BY source
UNION ALL SELECT source, 'toxic', count(*), count(*) - count(toxic), count(*) > count(toxic) FROM j GROUP BY source
""")
def nullability(spark, read):
    joined = read("documents").select("doc_id", "source").join(read("labels"), "doc_id", "left")
    cells = typed_cells(joined, "source", "doc_id", ["quality", "toxic"])
    counts = joined.groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("n_rows"))
    return profile.columns(cells, counts).select("doc_id", "col", "n_present", "n_null", "nullable")


_SEEN = """
v AS (SELECT o_orderstatus AS doc_id, o_orderpriority AS value, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL),
k AS (SELECT doc_id, value, n, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::VARCHAR AS key FROM v)
"""


def _priorities(read) -> DataFrame:
    return typed_cells(read("orders"), "o_orderstatus", "o_orderkey", ["o_orderpriority"])


@query(f"WITH {_SEEN} SELECT doc_id, value, n, key FROM k")
def distinct_first_seen(spark, read):
    return profile.distinct_values(_priorities(read)).select("doc_id", F.regexp_replace("json", '^"|"$', "").alias("value"), "n", "key")


def _dictionary(cells: DataFrame) -> DataFrame:
    return profile.distinct_values(cells).select("doc_id", "col", "kind", "canon", "key", "json")


@query(f"WITH {_SEEN} SELECT doc_id, key, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders JOIN k ON doc_id = o_orderstatus AND value = o_orderpriority GROUP BY doc_id, key")
def dict_encode(spark, read):
    cells = _priorities(read)
    return encode.to_keys(cells, _dictionary(cells)).groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.sum("row").alias("keys"))


@query("SELECT o_orderstatus AS doc_id, o_orderpriority AS value, count(*) AS n, sum(o_orderkey)::BIGINT AS rows FROM orders GROUP BY ALL")
def dict_decode_roundtrip(spark, read):
    """Cells as dictionary keys and back: the values that come back, and the rows they come back in."""
    cells = _priorities(read)
    entries = _dictionary(cells)
    keyed = encode.to_keys(cells, entries).withColumn("canon", F.lit(None).cast("string"))
    back = encode.from_keys(keyed, entries)
    return back.groupBy("doc_id", F.regexp_replace("canon", '^"|"$', "").alias("value")).agg(F.count("*").alias("n"), F.sum("row").alias("rows"))


@query(rf"""
WITH c AS (SELECT o_orderstatus AS doc_id, o_orderpriority AS value, o_orderkey AS row FROM orders WHERE o_orderpriority IS NOT NULL),
v AS (SELECT doc_id, value, count(*) AS n, min(row) AS first FROM c GROUP BY ALL),
k AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::VARCHAR AS key FROM v),
e AS (SELECT doc_id, count(*) AS d, sum(n) AS n, avg({_tok("key")}) AS per, sum(n * {_tok("value")})::BIGINT AS cells_cost,
  {_tok('''concat('{"o_orderpriority":{', string_agg(concat('"', key, '":"', value, '"'), ',' ORDER BY first), '}}')''')} AS text_cost FROM k GROUP BY doc_id)
SELECT doc_id, 'o_orderpriority' AS col, cells_cost, (text_cost + round_even(per * n, 0))::BIGINT AS dict_cost FROM e
WHERE n >= 2 AND d >= 2 AND d < n AND cells_cost - (text_cost + round_even(per * n, 0)) >= 20
""")
def dict_cost_gate(spark, read):
    cells = _priorities(read)
    counts = read("orders").groupBy(F.col("o_orderstatus").alias("doc_id")).agg(F.count("*").alias("n_rows"))
    return profile.dictionaries(cells, profile.columns(cells, counts)).select("doc_id", "col", "cells_cost", "dict_cost").distinct()


# Arrays


def _id_lists(read) -> DataFrame:
    """Event ids of each user, in order of time, and the same by value (so that some fall)."""
    listed = lambda *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, "event_id"))), lambda x: x["event_id"])
    return read("events").groupBy("user_id").agg(listed("ts").alias("ids"), listed("value").alias("by_value"))


_IDS = "l AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids, list(event_id ORDER BY value, event_id) AS by_value FROM events GROUP BY user_id)"


@query(f"WITH {_IDS} SELECT user_id, array_to_string([ids[1]] || list_transform(range(2, len(ids) + 1), lambda i: ids[i] - ids[i-1]), ' ') AS steps FROM l")
def delta_encode(spark, read):
    return _id_lists(read).select("user_id", F.array_join(cell_functions.deltas(F.col("ids")), " ").alias("steps"))


@query(f"WITH {_IDS} SELECT user_id, array_to_string(by_value, ' ') AS back FROM l")
def delta_decode(spark, read):
    back = cell_functions.from_deltas(cell_functions.deltas(F.col("by_value")))
    return _id_lists(read).select("user_id", F.array_join(back, " ").alias("back"))


@query(f"""
WITH {_IDS}, a AS (SELECT user_id, 'ids' AS col, ids AS v FROM l UNION ALL SELECT user_id, 'by_value', by_value FROM l),
t AS (SELECT user_id, col, len(v) AS n, list_bool_and(list_transform(range(2, len(v) + 1), lambda i: v[i] >= v[i-1])) AS up FROM a)
SELECT user_id::VARCHAR AS doc_id, col, CASE WHEN n = 0 THEN 'json' WHEN coalesce(up, true) THEN 'dints' ELSE 'ints' END AS type FROM t
""")
def array_type_class(spark, read):
    cells = typed_cells(_id_lists(read).withColumn("doc", F.col("user_id").cast("string")), "doc", "user_id", ["ids", "by_value"])
    return cells.groupBy("doc_id", "col").agg(profile.column_type().alias("type"))


@query("SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS cell FROM events GROUP BY user_id")
def space_join_strs(spark, read):
    listed = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    words = read("events").groupBy(F.col("user_id")).agg(F.transform(listed, lambda x: x["event_type"]).alias("words"))
    cells = typed_cells(words, "user_id", "user_id", ["words"]).withColumn("type", F.when(F.col("shape") == "strs", "strs").otherwise("json"))
    return cells.select(F.col("doc_id").cast("long").alias("user_id"), encode.written().alias("cell"))


# Text of cells


@query(rf"SELECT doc_id, md5({_csv('text')}) AS quoted, {_tok(_csv('text'))} AS tokens FROM documents")
def csv_quote_cells(spark, read):
    return read("documents").select("doc_id", _md5(csv_quoted(F.col("text"))).alias("quoted"), csv_cost(F.col("text")).alias("tokens"))


_ODD = """CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN '\\' || role WHEN 2 THEN '\\N' ELSE text END"""


@query(rf"""
WITH c AS (SELECT conv_id, turn, {_ODD} AS v FROM conversations),
e AS (SELECT *, CASE WHEN v = '' THEN '\E' WHEN starts_with(v, '\') THEN '\' || v ELSE v END AS cell FROM c)
SELECT conv_id, turn, md5(cell) AS cell, md5(v) AS back FROM e
""".replace("\\\\", "\\"))
def escape_sentinels(spark, read):
    odd = F.when(F.col("turn") % 4 == 0, F.lit("")).when(F.col("turn") % 4 == 1, F.concat(F.lit("\\"), F.col("role"))).when(F.col("turn") % 4 == 2, F.lit("\\N")).otherwise(F.col("text"))
    cell = cell_functions.escaped(F.col("v"))
    return read("conversations").withColumn("v", odd).select("conv_id", "turn", _md5(cell).alias("cell"), _md5(cell_functions.unescaped(cell)).alias("back"))


#: Documents in documents of bounded size: those of a source whose ids have the same thousands.
_BLOCK = "source || '/' || (doc_id // 1000)::VARCHAR"


def _blocks(read) -> DataFrame:
    return read("documents").withColumn("block", F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 1000).cast("string")))


@query(f"""
WITH r AS (SELECT {_BLOCK} AS source, doc_id, lang, row_number() OVER (PARTITION BY {_BLOCK} ORDER BY doc_id) - 1 AS row FROM documents)
SELECT source AS doc_id, count(*) AS lines, count(*) FILTER (WHERE row > 0 AND row % {HEADER_EVERY} = 0) AS headers, md5(string_agg(lang, chr(10) ORDER BY row)) AS body FROM r GROUP BY source
""")
def header_repeat_rows(spark, read):
    cells = typed_cells(_blocks(read), "block", "doc_id", ["lang"], numbered=True).withColumn("type", F.lit("str"))
    shown = cells.select("doc_id", "row", F.lit(0).alias("place"), encode.written().alias("shown"))
    size = cells.groupBy("doc_id").agg((F.max("row") + 1).alias("n_rows")).withColumn("n_cols", F.lit(1))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n")
    again = F.count_if((F.col("row") > 0) & (F.col("row") % HEADER_EVERY == 0))
    return rows_as_csv(shown, size).groupBy("doc_id").agg(F.count("*").alias("lines"), again.alias("headers"), _md5(body).alias("body"))


@query("SELECT source || ':str' || CASE WHEN count(*) > count(lang) THEN '?' ELSE '' END AS spec, count(*) AS n FROM documents GROUP BY source")
def header_specs(spark, read):
    """A header line as it is written, read back by the reader of documents."""
    cols = F.array(F.struct(F.lit(0).alias("place"), F.col("source").alias("col"), F.lit("str").alias("type"), (F.col("n_rows") > F.col("m")).alias("nullable")))
    made = read("documents").groupBy("source").agg(F.count("*").alias("n_rows"), F.count("lang").alias("m")).withColumn("cols", cols).select(header_of().alias("line"))

    def run(batches):
        for batch in batches:
            found = [header_columns(line) for line in batch.column(0).to_pylist()]
            specs = [",".join(f"{name}:{kind}{'?' if nullable else ''}" for name, kind, nullable in columns) for _, columns in found]
            yield pa.RecordBatch.from_arrays([pa.array(specs, pa.string()), pa.array([n for n, _ in found], pa.int64())], ["spec", "n"])

    return made.mapInArrow(run, "spec string, n long")


# The store


def _priced(read) -> DataFrame:
    cells = typed_cells(_blocks(read), "block", "doc_id", ["lang", "text"]).withColumn("type", F.lit("str")).withColumn("place", F.when(F.col("col") == "lang", 0).otherwise(1))
    return durable(store.priced(cells.select("doc_id", "row", "col", "place", encode.written().alias("cell"))))


_CELL = r"CASE WHEN v = '' THEN '\E' WHEN starts_with(v, '\') THEN '\' || v ELSE v END"
_STASH = rf"""
r AS (SELECT {_BLOCK} AS source, doc_id AS row, lang, text FROM documents),
u AS (SELECT source, row, 0 AS place, lang AS v FROM r UNION ALL SELECT source, row, 1, text FROM r),
e AS (SELECT source, row, place, {_CELL} AS cell FROM u),
p AS (SELECT *, {_tok('cell')} AS size, {_tok(_csv('cell'))} - {_tok(f"concat('{chr(92)}@0001[', {_tok('cell')}, 't]')")} AS gain FROM e),
s AS (SELECT source AS doc_id, lpad((row_number() OVER (PARTITION BY source ORDER BY row, place))::VARCHAR, 4, '0') AS cell_id, substr(sha256(cell), 1, 24) AS name, size, cell FROM p WHERE gain >= 20)
"""


@query(f"WITH {_STASH} SELECT doc_id, cell_id, name, concat('\\@', cell_id, '[', size, 't]') AS handle FROM s")
def stash_cells(spark, read):
    return store.moved_out(_priced(read))[0].select("doc_id", "cell_id", "name", "handle")


@query("SELECT substr(sha256(text), 1, 24) AS name, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY text")
def content_hash_dedup(spark, read):
    named = read("documents").filter("text is not null").select("doc_id", cell_functions.content_name(F.col("text")).alias("name"))
    return named.groupBy("name").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def _index(read) -> DataFrame:
    """A store's index over the documents: their source as document, their id as cell."""
    return read("documents").filter("text is not null").select(F.col("source").alias("doc_id"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("cell_id"), cell_functions.content_name(F.col("text")).alias("name"))


def _objects(read) -> DataFrame:
    """Its objects, with faults: names that begin with 0 are missing, with 1 changed, and pages are leaked."""
    own = read("documents").filter("text is not null").select(cell_functions.content_name(F.col("text")).alias("name"), F.col("text").alias("content")).dropDuplicates(["name"])
    faulty = own.filter(~F.col("name").startswith("0")).withColumn("content", F.when(F.col("name").startswith("1"), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    extra = read("pages").select(cell_functions.content_name(F.col("url")).alias("name"), F.col("url").alias("content")).dropDuplicates(["name"])
    return faulty.unionByName(extra)


_STORE = """
i AS (SELECT source AS doc_id, lpad(doc_id::VARCHAR, 8, '0') AS cell_id, substr(sha256(text), 1, 24) AS name, text FROM documents WHERE text IS NOT NULL),
o AS (SELECT DISTINCT name FROM i WHERE NOT starts_with(name, '0') UNION SELECT DISTINCT substr(sha256(url), 1, 24) FROM pages)
"""


@query(f"WITH {_STORE} SELECT doc_id, count(*) AS cells, sum(length(text))::BIGINT AS chars FROM i GROUP BY doc_id")
def index_resolve(spark, read):
    objects = read("documents").filter("text is not null").select(cell_functions.content_name(F.col("text")).alias("name"), F.col("text").alias("content")).dropDuplicates(["name"])
    return store.resolve(_index(read), objects).groupBy("doc_id").agg(F.count("*").alias("cells"), F.sum(F.char_length("content")).alias("chars"))


@query(f"WITH {_STORE} SELECT doc_id, cell_id, name FROM i WHERE starts_with(name, '0')")
def missing_handles(spark, read):
    return store.missing(_index(read), _objects(read))


@query(f"WITH {_STORE} SELECT i.doc_id, cell_id, name FROM i JOIN documents d ON lpad(d.doc_id::VARCHAR, 8, '0') = cell_id WHERE d.lang <> 'en' OR d.lang IS NULL")
def orphaned_ids(spark, read):
    used = read("documents").filter("lang = 'en'").select(F.col("source").alias("doc_id"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("cell_id"))
    return store.orphaned(_index(read), used)


@query(f"WITH {_STORE} SELECT doc_id, cell_id, name, CASE WHEN starts_with(name, '0') THEN 'missing' ELSE 'content changed' END AS problem FROM i WHERE name < '2'")
def broken_objects(spark, read):
    return store.broken(_index(read), _objects(read))


@query(f"WITH {_STORE} SELECT DISTINCT substr(sha256(url), 1, 24) AS name, url AS content FROM pages WHERE substr(sha256(url), 1, 24) NOT IN (SELECT name FROM i)")
def leaked_objects(spark, read):
    return store.leaked(_index(read), _objects(read)).select("name", "content")


@query(f"WITH {_STORE} SELECT DISTINCT name FROM i")
def reachable_objects(spark, read):
    return store.reachable(_index(read))


@query(f"WITH {_STORE} SELECT name FROM o INTERSECT SELECT name FROM i")
def gc_keep_set(spark, read):
    return store.kept(_index(read), _objects(read)).select("name")


@query(f"""
WITH {_STORE}, h AS (SELECT doc_id, count(*) AS entries, count(DISTINCT name) AS objects, count(DISTINCT cell_id::BIGINT // 256) AS parts FROM i WHERE name >= '1' GROUP BY doc_id)
SELECT doc_id, entries, objects, parts, 0::BIGINT AS refused FROM h
""")
def bundle_roundtrip(spark, read):
    """Indexes of intact objects, bundled as JSON in parts and read back."""
    good = read("documents").filter("text is not null").select(cell_functions.content_name(F.col("text")).alias("name"), F.col("text").alias("content")).dropDuplicates(["name"])
    texts = durable(store.bundles(_index(read).filter("name >= '1'"), good))
    index, objects, refused = store.unbundled(texts)
    found = index.join(objects.select("name"), "name").groupBy("doc_id").agg(F.count("*").alias("entries"), F.count_distinct("name").alias("objects"))
    bad = refused.groupBy("doc_id").agg(F.count("*").alias("n"))
    parts = texts.groupBy("doc_id").agg(F.count("bundle").alias("parts"))
    return found.join(parts, "doc_id").join(bad, "doc_id", "left").select("doc_id", "entries", "objects", "parts", F.coalesce("n", F.lit(0)).cast("long").alias("refused"))


# Retrieval


#: Requests of bounded size: the documents of a source whose ids have the same hundreds.
_REQUEST = "source || '/' || (doc_id // 100)::VARCHAR"
_BUDGET = rf"""
c AS (SELECT {_REQUEST} AS request, row_number() OVER (PARTITION BY {_REQUEST} ORDER BY doc_id) - 1 AS pos, doc_id, text, {_tok('text')} AS cost FROM documents WHERE text IS NOT NULL),
w AS (SELECT request, pos, doc_id, text, cost, CASE WHEN cost <= 8000 THEN cost ELSE 8000 END AS spent, CASE WHEN cost <= 8000 THEN 'content' ELSE 'truncated' END AS state FROM c WHERE pos = 0
  UNION ALL SELECT c.request, c.pos, c.doc_id, c.text, c.cost, CASE WHEN w.spent + c.cost <= 8000 THEN w.spent + c.cost WHEN w.spent > 0 THEN w.spent ELSE 8000 END,
    CASE WHEN w.spent + c.cost <= 8000 THEN 'content' WHEN w.spent > 0 THEN 'deferred' ELSE 'truncated' END FROM w JOIN c ON c.request = w.request AND c.pos = w.pos + 1)
"""


def _requests(read) -> DataFrame:
    request = F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"))
    return read("documents").filter("text is not null").withColumn("request", request)


@query(rf"""
WITH RECURSIVE {_BUDGET}
SELECT request, pos, lpad(doc_id::VARCHAR, 8, '0') AS cell_id, cost AS tokens, state, CASE WHEN state = 'content' THEN md5(text) END AS body FROM w
""")
def fetch_batch(spark, read):
    """Every cell of every document, asked for by its bare number: its state under the budget, its cost and what comes."""
    asked = _requests(read).groupBy("request", F.col("source").alias("of")).agg(F.array_sort(F.collect_list("doc_id")).cast("array<string>").alias("ids"))
    index = _index(read).withColumn("cell_id", F.regexp_replace("cell_id", "^0+(?=[0-9]{4})", ""))
    texts = read("documents").filter("text is not null").select(cell_functions.content_name(F.col("text")).alias("name"), F.col("text").alias("content")).dropDuplicates(["name"])
    found = fetch.fetch(asked.withColumn("document", F.concat(F.lit(' "'), "of", F.lit('" '))), index, texts)
    return found.select("request", "pos", F.lpad("cell_id", 8, "0").alias("cell_id"), "tokens", "state", F.when(F.col("state") == "content", _md5(F.col("content"))).alias("body"))


@query(rf"WITH RECURSIVE {_BUDGET} SELECT request, state, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM w GROUP BY request, state")
def fetch_budget(spark, read):
    """States of all texts of a request under one budget, in order."""
    priced = _requests(read).select("request", F.col("doc_id").alias("pos"), proxy(F.col("text")).alias("cost"), F.lit(None).cast("string").alias("state"))
    return fetch.greedy_budget(priced).groupBy("request", F.col("outcome").alias("state")).agg(F.count("*").alias("n"), F.sum("pos").alias("ids"))


@query(rf"""
WITH t AS (SELECT doc_id, text, {_tok('text')} AS cost FROM documents WHERE text IS NOT NULL)
SELECT doc_id, cost > 300 AS cut, CASE WHEN cost <= 300 THEN md5(text) END AS whole FROM t
""")
def clip_to_budget(spark, read):
    """Texts cut to 300 tokens: whole where they fit, else never beyond the budget nor far below it."""
    clipped = read("documents").filter("text is not null").select("doc_id", "text", fetch.clipped(F.col("text"), F.lit(300)).alias("part"))
    priced = clipped.select("doc_id", "text", "part", proxy(F.col("part")).alias("n"), proxy(F.col("text")).alias("cost"))
    sound = F.col("text").startswith(F.col("part")) & (F.col("n") <= 300) & ((F.col("part") == F.col("text")) | (F.col("n") >= 280))
    return priced.select("doc_id", F.when(sound, F.col("cost") > 300).alias("cut"), F.when(F.col("part") == F.col("text"), _md5(F.col("part"))).alias("whole"))


@query(r"""
WITH t AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '(?i)licen'), lambda x: length(x)) AS hits, list_transform(string_split_regex(text, '(?i)licen'), lambda x: length(x)) AS gaps
  FROM documents WHERE regexp_matches(text, '(?i)licen')),
h AS (SELECT doc_id, text, i, (list_sum(gaps[:i]) + coalesce(list_sum(hits[:i-1]), 0))::BIGINT AS a, hits[i] AS n FROM t, unnest(range(1, len(hits) + 1)) AS u(i)),
s AS (SELECT doc_id, text, i, greatest(0, a - 240) AS l, least(length(text), a + n + 240) AS r FROM h),
m AS (SELECT *, CASE WHEN l <= max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM m),
p AS (SELECT doc_id, text, island, min(l) AS l, max(r) AS r FROM g GROUP BY doc_id, text, island),
q AS (SELECT doc_id, text, count(*) AS n, sum(r - l) AS shown FROM p GROUP BY doc_id, text)
SELECT doc_id, CASE WHEN shown >= length(text) THEN 1 ELSE n END::BIGINT AS parts, CASE WHEN shown >= length(text) THEN length(text) ELSE shown END::BIGINT AS chars FROM q
""")
def fetch_query_hits(spark, read):
    parts = fetch.matching_parts(F.col("text"), "licen")
    found = read("documents").filter(F.col("text").rlike("(?i)licen")).select("doc_id", parts.alias("parts"))
    return found.select("doc_id", F.size("parts").cast("long").alias("parts"), F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + F.char_length(x)).alias("chars"))


# Payloads: boilerplate, records, nesting


def _page_payloads(read) -> DataFrame:
    """Each page as an API answer with link keys at two depths."""
    inner = F.struct(F.col("url").alias("avatar_url"), F.col("page_id").alias("id"), F.lit("x").alias("node_id"))
    whole = F.struct("page_id", "url", F.col("url").alias("html_url"), inner.alias("user"))
    return read("pages").select(F.col("page_id").cast("string").alias("doc_id"), F.to_json(whole).cast("binary").alias("raw"))


@query("""
WITH p AS (SELECT page_id, json_object('page_id', page_id, 'url', url, 'html_url', url, 'user', json_object('avatar_url', url, 'id', page_id, 'node_id', 'x')) AS j FROM pages WHERE url IS NOT NULL),
k AS (SELECT page_id, unnest(json_keys(j) || json_keys(j, '$.user')) AS key FROM p),
g AS (SELECT page_id, bool_or(key LIKE '%\\_url' ESCAPE '\\') AS api FROM k GROUP BY page_id)
SELECT page_id::VARCHAR AS doc_id, string_agg(DISTINCT key, ',' ORDER BY key) FILTER (WHERE key LIKE '%\\_url' ESCAPE '\\' OR key IN ('node_id', 'gravatar_id') OR (key = 'url' AND api)) AS dropped,
  any_value(concat('{"page_id":', page_id, ',"user":{"id":', page_id, '}}')) AS kept FROM k JOIN g USING (page_id) GROUP BY page_id
""".replace("\\\\", "\\"))
def strip_url_keys(spark, read):
    return extract(_page_payloads(read)).select("doc_id", F.array_join("dropped", ",").alias("dropped"), F.col("compact").alias("kept"))


@query("SELECT user_id::VARCHAR AS doc_id, 'props.k' AS col, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY user_id")
def flatten_nested(spark, read):
    payloads = from_rows(read("events").withColumn("props", F.from_json("props", "k bigint")), "user_id", "event_id", ["event_id", "props"])
    cells = extract(payloads).select("doc_id", F.explode("cells").alias("c")).select("doc_id", "c.*").filter("col = 'props.k'")
    return cells.groupBy("doc_id", "col").agg(F.count("*").alias("n"), F.sum(F.col("text").cast("long")).alias("total"))


@query("SELECT n_regionkey::VARCHAR AS doc_id, n_name AS key, n_nationkey::BIGINT AS nationkey FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(*) > 1)")
def record_map_rows(spark, read):
    """Nations as an object keyed by name, taken back into rows."""
    record = F.map_from_entries(F.collect_list(F.struct("n_name", F.struct("n_nationkey", "n_regionkey"))))
    payloads = read("nation").groupBy(F.col("n_regionkey").cast("string").alias("doc_id")).agg(F.to_json(record).cast("binary").alias("raw"))
    cells = extract(payloads).filter("key_column = '_key'").select("doc_id", F.explode("cells").alias("c")).select("doc_id", "c.*")
    wide = cells.groupBy("doc_id", "row").agg(F.max(F.when(F.col("col") == "_key", F.col("text"))).alias("key"), F.max(F.when(F.col("col") == "n_nationkey", F.col("text"))).cast("long").alias("nationkey"))
    return wide.select("doc_id", "key", "nationkey")


@query("""
WITH n AS (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1)
SELECT r::VARCHAR AS doc_id, CASE WHEN n < 2 AND n < 2 THEN NULL WHEN r % 2 = 0 THEN 'data,nations' ELSE 'b' END AS path, n::INTEGER AS n_rows FROM n WHERE n >= 2
""")
def largest_record_array(spark, read):
    """Of two record lists in a payload the one with more cells; of equals the shallower."""
    grouped = read("nation").groupBy(F.col("n_regionkey")).agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("all"))
    slim = F.transform("all", lambda x: F.struct(x["n_name"].alias("n")))
    even = F.to_json(F.struct(slim.alias("small"), F.struct(F.col("all").alias("nations")).alias("data")))
    odd = F.to_json(F.struct(F.col("all").alias("b"), F.struct(F.col("all").alias("nations")).alias("a")))
    payloads = grouped.select(F.col("n_regionkey").cast("string").alias("doc_id"), F.when(F.col("n_regionkey") % 2 == 0, even).otherwise(odd).cast("binary").alias("raw"))
    return extract(payloads).filter("state = 'records'").select("doc_id", F.array_join("path", ",").alias("path"), "n_rows")


@query("""
WITH r AS (SELECT 'even' AS doc_id, json_object('event_id', event_id, 'k', json_extract(props, '$.k')) AS j FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT 'odd', json_object('event_id', event_id, 'user_id', user_id, 'value', value) FROM events WHERE event_id % 2 = 1),
k AS (SELECT doc_id, unnest(json_keys(j)) AS key FROM r) SELECT doc_id, string_agg(DISTINCT key, ',' ORDER BY key) AS cols, count(*) AS n FROM k GROUP BY doc_id
""")
def union_schema(spark, read):
    """Rows of two shapes under one schema: the columns that each shape has, and how many cells."""
    a = read("events").filter("event_id % 2 = 0").select(F.lit("even").alias("doc"), "event_id", F.get_json_object("props", "$.k").alias("k"))
    b = read("events").filter("event_id % 2 = 1").select(F.lit("odd").alias("doc"), "event_id", "user_id", "value")
    both = a.unionByName(b, allowMissingColumns=True)
    cells = typed_cells(both, "doc", "event_id", ["event_id", "k", "user_id", "value"]).filter("kind <> 'null'")
    return cells.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("col")), ",").alias("cols"), F.count("*").alias("n"))


@query("""
SELECT count(*) FILTER (WHERE doc_id % 3 < 2) AS present, count(*) FILTER (WHERE doc_id % 3 = 0) AS held, count(*) FILTER (WHERE doc_id % 3 = 2) AS absent FROM documents
""")
def presence_vs_null(spark, read):
    """A key with a value, a key with null, and no key."""
    row = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("id"), F.lit("1"), F.lit("merged"), F.lit("yes"))).when(F.col("doc_id") % 3 == 1, F.create_map(F.lit("id"), F.lit("1"), F.lit("merged"), F.lit(None).cast("string")))
    return questions.key_presence(read("documents").select(F.coalesce(row, F.create_map(F.lit("id"), F.lit("1"))).alias("row_")), "row_", "merged")


@query("""
SELECT n_regionkey::VARCHAR AS doc_id, concat('[', string_agg(concat('{"n_name":"', n_name, '","n_nationkey":', n_nationkey, ',"n_regionkey":', n_regionkey, '}'), ',' ORDER BY n_nationkey), ']') AS back
FROM nation GROUP BY n_regionkey
""")
def compress_roundtrip(spark, read):
    """Nations by region as payloads, compressed and read back: the JSON that comes back, keys in order."""
    payloads = from_rows(read("nation"), "n_regionkey", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"])
    return decompress(compress(payloads).documents.select("doc_id", "document")).select("doc_id", F.col("canon").alias("back"))


@query()
def compress_conversations(spark, read):
    """Conversations as payloads of turns, compressed with a store: what each gate decided."""
    payloads = from_rows(read("conversations"), "conv_id", "turn", ["turn", "role", "text"])
    return compress(payloads, with_store=True).documents.select("doc_id", "status", "note", "before", "after", "saved", "held")


# Questions


@query("SELECT o_totalprice, o_orderpriority FROM orders WHERE o_orderkey = 42")
def point_lookup(spark, read):
    return questions.lookup(read("orders"), "o_orderkey", 42, "o_totalprice", "o_orderpriority")


@query("SELECT count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n FROM orders")
def filtered_count(spark, read):
    return questions.count_where(read("orders"), F.col("o_orderpriority") == "1-URGENT")


@query("SELECT sum(n_chars)::BIGINT AS total FROM documents")
def sum_total(spark, read):
    return questions.total(read("documents"), "n_chars")


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def count_distinct(spark, read):
    return questions.distinct_count(read("orders"), "o_custkey")


@query("SELECT string_agg(DISTINCT role, ',' ORDER BY role) AS found FROM conversations")
def distinct_sorted(spark, read):
    return questions.distinct_sorted(read("conversations"), "role")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 1")
def argmax_first_tie(spark, read):
    return questions.arg_max(read("orders"), F.col("o_totalprice"), "o_orderkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) = 1")
def argmax_per_group(spark, read):
    return questions.arg_max_per(read("orders"), "o_custkey", F.col("o_totalprice"), "o_orderkey", "o_orderkey", "o_totalprice")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def group_count(spark, read):
    return questions.group_count(read("lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT min(o_orderkey) = 0 AND max(o_orderkey) = count(*) - 1 AND count(DISTINCT o_orderkey) = count(*) AS contiguous FROM orders")
def contiguous_ids(spark, read):
    return questions.contiguous(read("orders"), "o_orderkey", 0)


@query("SELECT doc_id, length(text)::INTEGER AS chars FROM documents ORDER BY length(text) DESC NULLS LAST, doc_id LIMIT 1")
def longest_text(spark, read):
    return questions.arg_max(read("documents").withColumn("chars", F.char_length("text")), F.col("chars"), "doc_id", "doc_id", "chars")


@query("SELECT array_to_string(list_sort(json_keys(props)), ',') AS keyset, count(*) AS n FROM events GROUP BY 1")
def distinct_keysets(spark, read):
    return questions.keysets(read("events").select(F.from_json("props", "map<string,string>").alias("row")), "row")


@query("SELECT count(DISTINCT list_sort(json_keys(props))) <= 1 AS uniform FROM events")
def uniform_records(spark, read):
    return questions.uniform(read("events").select(F.from_json("props", "map<string,string>").alias("row")), "row")


@query("SELECT count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def null_values(spark, read):
    return questions.count_where(read("documents").join(read("labels"), "doc_id", "left"), F.col("quality").isNull())


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 3")
def array_len_filter(spark, read):
    return questions.longer_than(read("conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("turns")), "turns", 3, "conv_id")


@query("SELECT user_id FROM events GROUP BY user_id HAVING list_contains(list(event_type), 'error')")
def multi_value_filter(spark, read):
    return questions.having_element(read("events").groupBy("user_id").agg(F.collect_set("event_type").alias("types")), "types", "error", "user_id")


@query("SELECT doc_id FROM documents WHERE coalesce(CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE text END, '') = ''")
def blank_texts(spark, read):
    """Texts that are null or empty, which some are made here."""
    some = F.when(F.col("doc_id") % 9 == 0, F.lit("")).when(F.col("doc_id") % 9 != 1, F.col("text"))
    return questions.blank(read("documents").withColumn("text", some), "text", "doc_id")


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def map_projection(spark, read):
    joined = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def keyed_lookup(spark, read):
    """A record found in an object by a key that another record names."""
    regions = read("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return read("nation").join(regions, "n_regionkey").select("n_name", "r_name")


@query("SELECT c_mktsegment, count(*) AS n, min(c_custkey) AS first FROM customer WHERE c_acctbal < 0 GROUP BY c_mktsegment")
def sign_filter(spark, read):
    return read("customer").filter("c_acctbal < 0").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


@query("SELECT user_id, event_id AS label FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) = 1")
def parallel_arrays_argmax(spark, read):
    listed = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    arrays = read("events").groupBy("user_id").agg(listed.alias("all")).select("user_id", F.transform("all", lambda x: x["event_id"]).alias("labels"), F.transform("all", lambda x: x["value"]).alias("vals"))
    return arrays.select("user_id", questions.parallel_arg_max(arrays, "labels", "vals").alias("label"))


@query("SELECT user_id, arg_min(event_id, ts) AS first, arg_max(event_id, ts) AS last FROM events GROUP BY user_id")
def first_last(spark, read):
    return _id_lists(read).select("user_id", *questions.first_and_last("ids"))


@query("SELECT user_id, min(event_id) FILTER (WHERE event_type = 'error') AS first_error FROM events GROUP BY user_id")
def first_match(spark, read):
    arrays = read("events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("all"))
    return arrays.select("user_id", questions.first_match("all", lambda x: x["event_type"] == "error")["event_id"].alias("first_error"))


@query("SELECT doc_id, trim(list_filter(string_split(substr(text, instr(text, chr(10)) + 1), chr(10)), lambda x: trim(x) <> '')[1]) AS line FROM documents WHERE contains(text, chr(10))")
def text_after_marker(spark, read):
    return read("documents").filter(F.contains("text", F.lit("\n"))).select("doc_id", cell_functions.after_marker_line(F.col("text"), "\n").alias("line"))


# Reports


@query(rf"""
WITH {_STASH}, a AS (SELECT source, sum({_tok(_csv('cell'))})::BIGINT AS before FROM e GROUP BY source),
h AS (SELECT doc_id, sum({_tok(_csv('cell'))} - {_tok(f"concat('{chr(92)}@', cell_id, '[', size, 't]')")})::BIGINT AS gain FROM s GROUP BY doc_id),
t AS (SELECT source, before, before - coalesce(gain, 0) AS after FROM a LEFT JOIN h ON doc_id = source)
SELECT coalesce(source, 'TOTAL') AS source, sum(before)::BIGINT AS before, sum(after)::BIGINT AS after, round(100.0 * (sum(before) - sum(after)) / sum(before), 1) AS percent FROM t GROUP BY ROLLUP (source)
""")
def savings_report(spark, read):
    cells = _priced(read)
    moved = store.moved_out(cells)[0].select("doc_id", "row", "col", csv_cost(F.col("handle")).alias("instead"))
    priced = cells.join(moved, ["doc_id", "row", "col"], "left").select(F.col("doc_id").alias("source"), F.col("whole").alias("before"), F.coalesce("instead", "whole").alias("after"))
    return measure.totals(priced.groupBy("source").agg(F.sum("before").alias("before"), F.sum("after").alias("after")), "source")


@query(rf"""
WITH g AS (SELECT {_tok(_csv('text'))} - {_tok(f"'{chr(92)}@0001'")} AS gain FROM documents), b AS (SELECT unnest([1, 5, 10, 20, 50, 100, 200]) AS bar)
SELECT bar, count(*) FILTER (WHERE gain >= bar) AS n_stored, coalesce(sum(gain) FILTER (WHERE gain >= bar), 0)::BIGINT AS saved FROM g, b GROUP BY bar
""")
def threshold_sweep(spark, read):
    return measure.threshold_sweep(measure.priced_cells(read("documents"), "text"))


@query(rf"""
WITH f AS (SELECT text, concat('hex-', w) AS form, concat('{chr(92)}@', substr(sha256(text), 1, w)) AS h FROM documents, (SELECT unnest([4, 6, 8, 12, 16]) AS w) UNION ALL SELECT text, 'ordinal', '{chr(92)}@0001' FROM documents),
g AS (SELECT form, {_tok(_csv('text'))} - {_tok('h')} AS gain FROM f)
SELECT form, count(*) FILTER (WHERE gain >= 20) AS n_stored, coalesce(sum(gain) FILTER (WHERE gain >= 20), 0)::BIGINT AS saved FROM g GROUP BY form
""")
def encoding_sweep(spark, read):
    return measure.encoding_sweep(read("documents"), "text")


@query(rf"""
WITH f AS (SELECT text, k AS lure, concat('{chr(92)}@0001', CASE WHEN sized THEN concat('[', {_tok('text')}, 't] ') ELSE '' END, substr(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'), 1, n)) AS h
  FROM documents, (VALUES ('bare', 0, false), ('size', 0, true), ('text_32', 32, false), ('size_text_32', 32, true), ('size_text_48', 48, true), ('size_text_80', 80, true)) AS v(k, n, sized)),
g AS (SELECT lure, {_tok(_csv('text'))} - {_tok(_csv('h'))} AS gain FROM f)
SELECT lure, count(*) FILTER (WHERE gain >= 20) AS n_stored, coalesce(sum(gain) FILTER (WHERE gain >= 20), 0)::BIGINT AS saved FROM g GROUP BY lure
""")
def lure_sweep(spark, read):
    return measure.lure_sweep(read("documents"), "text")


def _answers(read) -> DataFrame:
    """Labels as graded answers of three readers."""
    arms = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), ok.alias("ok")) for a, ok in (("raw", F.lit(True)), ("compressed", F.col("quality") >= 0), ("stored", F.col("toxic") == 0)))))
    return read("labels").select("doc_id", arms.alias("a")).select("doc_id", "a.*")


_ANSWERS = "a AS (SELECT doc_id, 'raw' AS arm, true AS ok FROM labels UNION ALL SELECT doc_id, 'compressed', quality >= 0 FROM labels UNION ALL SELECT doc_id, 'stored', toxic = 0 FROM labels)"


@query(f"""
WITH {_ANSWERS}, t AS (SELECT arm, count(*) AS n, count(*) FILTER (WHERE ok) AS ok FROM a GROUP BY arm), r AS (SELECT n AS rn, ok AS rok FROM t WHERE arm = 'raw')
SELECT arm, n, ok, rok - ok AS gap, CASE WHEN n <> rn OR rok < 0.8 * rn THEN 'inconclusive' WHEN rok - ok <= 0 THEN 'pass' ELSE 'fail' END AS verdict FROM t, r
""")
def arm_tally(spark, read):
    return measure.arm_tally(_answers(read))


@query(f"WITH {_ANSWERS} SELECT arm, doc_id % 5 AS replicate, count(ok) AS answered, count(*) FILTER (WHERE NOT ok) AS missed, sum(doc_id % 2)::BIGINT AS fetches FROM a GROUP BY ALL")
def miss_tally(spark, read):
    return measure.miss_tally(_answers(read).withColumn("replicate", F.col("doc_id") % 5).withColumn("fetched", F.col("doc_id") % 2))


@query(f"SELECT lang AS arm, sum({_tok('text')})::BIGINT AS tokens, round(sum({_tok('text')}) * 3.0 / 1e6, 6) AS cost FROM documents GROUP BY lang")
def cost_estimate(spark, read):
    return measure.cost_estimate(read("documents").withColumn("arm", F.col("lang")), "text", 3.0)


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 1 THEN 'lost' WHEN o_orderkey % 50 = 2 THEN 'changed' END AS problem FROM orders WHERE o_orderkey % 50 IN (1, 2)
UNION ALL SELECT o_orderkey + 100000000, 'only after' FROM orders WHERE o_orderkey % 1000 = 0
""")
def diff_paths(spark, read):
    """A copy of the orders with rows lost, changed and added, against the orders."""
    before = read("orders").select("o_orderkey", "o_orderpriority")
    kept = before.filter("o_orderkey % 50 <> 1").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 50 == 2, F.lit("other")).otherwise(F.col("o_orderpriority")))
    after = kept.unionByName(before.filter("o_orderkey % 1000 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100000000))
    return verify.differences(before, after, ["o_orderkey"], "o_orderpriority").select("o_orderkey", "problem")


@query("SELECT doc_id AS label, toxic = 0 AS same FROM labels")
def answers_compared(spark, read):
    truth = read("labels").select(F.col("doc_id").alias("label"), F.lit(0).alias("answer"))
    return verify.answers_compared(truth, read("labels").select(F.col("doc_id").alias("label"), F.col("toxic").alias("answer")))


@query(rf"SELECT event_id, {_tok('props')} AS total, {_tok('''json_extract_string(props, '$.k')''')} AS in_values, {_tok('props')} - {_tok('''json_extract_string(props, '$.k')''')} AS structure FROM events")
def token_split(spark, read):
    """Tokens of payloads, in their scalars and in what is around them."""
    found = leaves(from_column(read("events"), "event_id", "props")).select(F.col("doc_id").cast("long").alias("event_id"), "leaves")
    return read("events").join(found, "event_id").select("event_id", measure.token_split(F.col("props"), F.col("leaves")).alias("s")).select("event_id", "s.*")


# The flagship: what compression of the documents of each source would save


_OWN = f"""
u AS (SELECT source, 'source' AS col, source AS v, false AS num FROM documents UNION ALL SELECT source, 'lang', lang, false FROM documents
  UNION ALL SELECT source, 'n_chars', n_chars::VARCHAR, true FROM documents UNION ALL SELECT source, 'text', text, false FROM documents),
w AS (SELECT source, col, v, num, count(*) AS n, CASE WHEN v IS NULL THEN '{chr(92)}N' WHEN num THEN v ELSE {_CELL} END AS cell,
  CASE WHEN num THEN v ELSE to_json(v)::VARCHAR END AS j FROM u GROUP BY source, col, v, num),
p AS (SELECT *, {_tok('cell')} AS size, {_tok(_csv('cell'))} AS whole, {_tok('j')} AS json_cost FROM w),
q AS (SELECT *, {_tok(f"concat('{chr(92)}@0001[', size, 't]')")} AS handle FROM p)
"""


@query(f"""
WITH {_OWN},
c AS (SELECT source, col, sum(n) AS n_rows, count(*) AS n_kinds, count(*) FILTER (WHERE v IS NOT NULL) AS d, coalesce(sum(n) FILTER (WHERE v IS NOT NULL), 0) AS m, sum(n * whole) AS raw,
  sum(json_cost) FILTER (WHERE v IS NOT NULL) AS json_cost, sum(n * size) FILTER (WHERE v IS NOT NULL) AS cells_cost, sum(n * CASE WHEN whole - handle >= 20 THEN handle ELSE whole END) AS stashed, sum(n) FILTER (WHERE whole - handle >= 20) AS n_stored
  FROM q GROUP BY source, col),
k AS (SELECT *, n_kinds = 1 AS const, d + greatest(d - 1000, 0) + greatest(d - 1000000, 0) AS keys FROM c),
e AS (SELECT *, CASE WHEN NOT const AND m >= 2 AND d >= 2 AND d < m THEN {_tok("concat('{\"', col, '\":{}}')")} + json_cost + keys + 4 * d - 1 + round_even(keys::DOUBLE / d * m, 0)::BIGINT END AS dict_cost FROM k),
f AS (SELECT *, cells_cost - dict_cost >= 20 AS dict FROM e)
SELECT source, max(n_rows)::BIGINT AS n_rows, sum(raw)::BIGINT AS raw_cost, sum(CASE WHEN const THEN 0 WHEN dict THEN dict_cost ELSE stashed END)::BIGINT AS out_cost,
  sum(CASE WHEN const OR dict THEN 0 ELSE coalesce(n_stored, 0) END)::BIGINT AS n_stored, sum(raw)::BIGINT - sum(CASE WHEN const THEN 0 WHEN dict THEN dict_cost ELSE stashed END)::BIGINT AS saved
FROM f GROUP BY source
""".replace("\\\"", '"'))
def savings_by_source(spark, read):
    """(source, n_rows, raw_cost, out_cost, n_stored, saved): constants, dictionaries and stored cells priced.

    Every text is priced once as a cell and once as JSON where it is read; what is shuffled are costs, and different values
    by themselves or a digest.
    """
    columns = {"source": "str", "lang": "str", "n_chars": "int", "text": "str"}

    def priced(name: str, kind: str) -> Column:
        value = F.col(name).cast("string")
        cell = F.when(value.isNull(), F.lit(cell_functions.NULL)).otherwise(cell_functions.escaped(value) if kind == "str" else value)
        json = profile.json_string(name) if kind == "str" else value
        return F.struct(F.lit(name).alias("col"), profile.short(value).alias("value"), proxy(cell).alias("size"), csv_cost(cell).alias("whole"), proxy(json).alias("json_cost"))

    cells = read("documents").select("source", F.explode(F.array(*(priced(*c) for c in columns.items()))).alias("c")).select("source", "c.*")
    kinds = cells.groupBy("source", "col", "value").agg(F.count("*").alias("n"), F.min("size").alias("size"), F.min("whole").alias("whole"), F.min("json_cost").alias("json_cost"))
    handle = csv_cost(cell_functions.handle(F.lit("0001"), F.col("size")))
    kinds = kinds.withColumn("handle", handle).withColumn("goes", F.col("whole") - F.col("handle") >= store.LEAST_SAVING)
    some = F.col("value").isNotNull()
    per_column = kinds.groupBy(F.col("source").alias("doc_id"), "col").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_kinds"), F.count("value").alias("n_distinct"), F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("n_values"),
        F.sum(F.when(some, F.col("json_cost"))).alias("json_cost"), F.sum(F.when(some, F.col("n") * F.col("size"))).alias("cells_cost"), F.sum(F.col("n") * F.col("whole")).alias("raw"),
        F.sum(F.col("n") * F.when(F.col("goes"), F.col("handle")).otherwise(F.col("whole"))).alias("stashed"), F.coalesce(F.sum(F.when(F.col("goes"), F.col("n"))), F.lit(0)).alias("n_stored"),
    )
    const = F.col("n_kinds") == 1
    dicts = profile.worthwhile(per_column.filter(~const), proxy).select("doc_id", "col", "dict_cost")
    whole = per_column.join(dicts, ["doc_id", "col"], "left")
    out = F.when(const, F.lit(0)).otherwise(F.coalesce("dict_cost", "stashed"))
    stored = F.when(const | F.col("dict_cost").isNotNull(), F.lit(0)).otherwise(F.col("n_stored"))
    summed = whole.groupBy(F.col("doc_id").alias("source")).agg(F.max("n_rows").alias("n_rows"), F.sum("raw").alias("raw_cost"), F.sum(out).alias("out_cost"), F.sum(stored).alias("n_stored"))
    return summed.withColumn("saved", F.col("raw_cost") - F.col("out_cost"))
