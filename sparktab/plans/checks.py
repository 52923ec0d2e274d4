"""Questions about payloads, each asked of what was given and of what came back from a document.

Payloads are made of the driver's tables in the shapes that API answers have: a list under a wrapper, an
object of records, an object of scalars, parallel arrays.  An ``arm`` is ``raw`` (the payload without its link
keys) or ``back`` (its document, read back); the SQL says what both must answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import content_name
from ..operators import encode, measure, profile, questions, store, verify
from ..sources.payloads import decoded, extract, from_column, nodes
from ..sources.tables import durable, temporary
from ..sources.typed import typed_cells
from .compress import compress, decompress
from .workload import _BLOCK, _blocks, _csv, _tok, query

_ARMS = "arms AS (SELECT unnest(['raw', 'back']) AS arm)"


def arms(payloads: DataFrame) -> DataFrame:
    """(doc_id, arm, text): the JSON of each payload, keys in order, as it was and as it came back."""
    payloads = durable(payloads)
    raw = extract(payloads).select("doc_id", F.lit("raw").alias("arm"), F.col("canon").alias("text"))
    back = decompress(compress(payloads, with_store=False).documents.select("doc_id", "document"))
    return durable(raw.unionByName(back.select("doc_id", F.lit("back").alias("arm"), F.col("canon").alias("text"))))


def _listed(read) -> DataFrame:
    """Customers of each nation under a wrapper, with nested objects, arrays of objects, and keys that come and go."""
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    tags = F.array(F.struct(F.substring("c_mktsegment", 1, 3).alias("code"), F.col("c_mktsegment").alias("name")), F.struct(F.lit("A").alias("code"), F.col("c_name").alias("name")))
    some = F.when(F.col("c_custkey") % 3 == 0, F.to_json(F.struct(F.col("c_custkey").alias("merged")))).when(F.col("c_custkey") % 3 == 1, F.lit('{"merged":null}')).otherwise(F.lit("{}"))
    record = F.to_json(F.struct(F.col("c_custkey").alias("id"), cents.alias("cents"), F.struct(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("at")).alias("seg"), tags.alias("tags"), F.lit("http://x/").alias("html_url")))
    joined = F.when(some == "{}", record).otherwise(F.concat(F.regexp_replace(record, r"\}$", ","), F.substr(some, F.lit(2))))
    rows = read("customer").select("c_nationkey", "c_custkey", joined.alias("record"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "record"))), lambda x: x["record"]), ",")
    text = F.concat(F.lit('{"nbHits":'), F.count("*").cast("string"), F.lit(',"page":'), F.col("c_nationkey").cast("string"), F.lit(',"data":{"items":['), listed, F.lit("]}}"))
    return rows.groupBy("c_nationkey").agg(text.alias("text")).select(F.col("c_nationkey").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("raw"))


_ITEM = "struct<id: bigint, cents: bigint, seg: struct<at: bigint, name: string>, tags: array<struct<code: string, name: string>>>"


def _items(read) -> DataFrame:
    kind = f"struct<data: struct<items: array<{_ITEM}>>>"
    return arms(_listed(read)).select("arm", F.explode(F.from_json("text", kind)["data"]["items"]).alias("x")).select("arm", "x.*")


@query(f"WITH {_ARMS} SELECT c_nationkey::VARCHAR AS doc_id, arm, count(*) AS hits, c_nationkey::BIGINT AS page FROM customer, arms GROUP BY c_nationkey, arm")
def check_wrapper_scalars(spark, read):
    """Scalars beside the list of records."""
    found = F.from_json("text", "struct<nbHits: bigint, page: bigint>")
    return arms(_listed(read)).select("doc_id", "arm", found["nbHits"].alias("hits"), found["page"].alias("page"))


@query(f"WITH {_ARMS} SELECT DISTINCT c_nationkey::VARCHAR AS doc_id, arm, 'data,nbHits,page' AS keys, 'items' AS inner_keys FROM customer, arms")
def check_envelope_keys(spark, read):
    """The keys of the payload and of the object that holds the list."""
    keys = lambda c: F.array_join(F.array_sort(F.json_object_keys(c)), ",")
    return arms(_listed(read)).select("doc_id", "arm", keys("text").alias("keys"), keys(F.get_json_object("text", "$.data")).alias("inner_keys"))


@query(f"""
WITH {_ARMS} SELECT c_custkey AS id, arm, concat('{{"at":', c_nationkey, ',"name":"', c_mktsegment, '"}}') AS seg,
  concat('[{{"code":"', c_mktsegment[1:3], '","name":"', c_mktsegment, '"}},{{"code":"A","name":"', c_name, '"}}]') AS tags FROM customer, arms
""")
def check_nested_objects(spark, read):
    """A nested object and an array of objects, whole."""
    return _items(read).select("id", "arm", F.to_json("seg").alias("seg"), F.to_json("tags").alias("tags"))


@query(f"WITH {_ARMS} SELECT c_custkey AS id, arm, concat(c_mktsegment, ',', c_name) AS names, concat('A,', c_mktsegment[1:3]) AS codes, 2 AS n FROM customer, arms")
def check_array_projection(spark, read):
    """A field of each element of an array of objects, in their order and sorted."""
    return _items(read).select("id", "arm", F.array_join(F.transform("tags", lambda t: t["name"]), ",").alias("names"), F.array_join(F.array_sort(F.transform("tags", lambda t: t["code"])), ",").alias("codes"), F.size("tags").alias("n"))


@query(f"WITH {_ARMS} SELECT arm, count(*) FILTER (WHERE c_custkey % 3 < 2) AS present, count(*) FILTER (WHERE c_custkey % 3 = 0) AS held, count(*) FILTER (WHERE c_custkey % 3 = 2) AS absent FROM customer, arms GROUP BY arm")
def check_key_presence(spark, read):
    """A key with a value, with null, and no key at all, before and after."""
    kind = "struct<data: struct<items: array<map<string, string>>>>"
    rows = arms(_listed(read)).select("arm", F.explode(F.from_json("text", kind)["data"]["items"]).alias("row"))
    return rows.groupBy("arm").agg(*questions.presence("row", "merged"))


@query("SELECT 'given' AS arm, count(*) AS n FROM customer UNION ALL SELECT 'raw', 0 UNION ALL SELECT 'back', 0")
def check_absence_flips(spark, read):
    """A link key is there in what was given and gone in both arms."""
    payloads = durable(_listed(read))
    given = decoded(payloads).select(F.lit("given").alias("arm"), "doc_id", F.col("text").cast("binary").alias("raw"))
    every = given.unionByName(arms(payloads).select("arm", "doc_id", F.col("text").cast("binary").alias("raw")))
    found = nodes(every.select(F.concat_ws(":", "arm", "doc_id").alias("doc_id"), "raw"))
    return found.groupBy(F.split_part("doc_id", F.lit(":"), F.lit(1)).alias("arm")).agg(F.count_if(F.col("key") == "html_url").alias("n"))


def _maps(read) -> DataFrame:
    """Nations of a region as an object of records, and their numbers of customers as an object of scalars."""
    counted = read("nation").join(read("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey", "n_name", "n_nationkey").agg(F.count("c_custkey").alias("n"))
    record = F.struct(F.col("n_nationkey").alias("key"), (F.col("n") - 60).alias("change"), (F.col("n") / 4).alias("share"), (F.col("n") > 60).alias("many"))
    coins = F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", record.alias("record")))))
    rates = F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "n"))))
    grouped = counted.groupBy("n_regionkey").agg(coins.alias("coins"), rates.alias("rates"), F.min("n_name").alias("base"))
    return grouped.select(F.col("n_regionkey").cast("string").alias("doc_id"), F.to_json(F.struct("base", "coins", "rates")).cast("binary").alias("raw"))


_COUNTED = "c AS (SELECT n_regionkey, n_name, n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)"


@query(f"WITH {_ARMS}, {_COUNTED} SELECT n_regionkey::VARCHAR AS doc_id, arm, count(*)::INTEGER AS n, string_agg(n_name, ',' ORDER BY n_name) AS keys, min(n) FILTER (WHERE n_name = low)::BIGINT AS of_base FROM (SELECT *, min(n_name) OVER (PARTITION BY n_regionkey) AS low FROM c), arms GROUP BY n_regionkey, arm")
def check_map_size_and_keys(spark, read):
    """How many entries a map has, its keys in order, and the entry whose key another field names."""
    held = F.from_json("text", "struct<base: string, rates: map<string, bigint>>")
    return arms(_maps(read)).select("doc_id", "arm", F.size(held["rates"]).alias("n"), F.array_join(F.array_sort(F.map_keys(held["rates"])), ",").alias("keys"), F.element_at(held["rates"], held["base"]).alias("of_base"))


@query(f"WITH {_ARMS}, {_COUNTED} SELECT n_regionkey::VARCHAR AS doc_id, arm, n_name AS key, n - 60 AS change FROM c, arms WHERE n < 60")
def check_map_sign_filter(spark, read):
    """Records of a map by the sign of a field."""
    held = F.from_json("text", "struct<coins: map<string, struct<change: bigint>>>")["coins"]
    negative = F.map_filter(F.transform_values(held, lambda k, v: v["change"]), lambda k, v: v < 0)
    return arms(_maps(read)).select("doc_id", "arm", F.explode(negative).alias("key", "change"))


@query(f"""
WITH {_ARMS}, {_COUNTED}, k AS (SELECT n_regionkey, unnest(['key', 'change', 'share', 'many']) AS field, unnest(['int', 'int', 'float', 'bool']) AS kind FROM c)
SELECT n_regionkey::VARCHAR AS doc_id, arm, field, kind, count(*) AS n FROM k, arms GROUP BY ALL
""")
def check_map_types(spark, read):
    """The kinds of the values of each field of a map's records."""
    every = arms(_maps(read)).select(F.concat_ws(":", "arm", "doc_id").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    found = nodes(every).filter((F.size("path") == 3) & (F.get("path", F.lit(0)) == "coins"))
    part = lambda n: F.split_part("doc_id", F.lit(":"), F.lit(n))
    return found.groupBy(part(2).alias("doc_id"), part(1).alias("arm"), F.col("key").alias("field"), "kind").agg(F.count("*").alias("n"))


@query(f"WITH {_ARMS}, {_COUNTED} SELECT n_regionkey::VARCHAR AS doc_id, arm, concat('{{', string_agg(concat('\"', n_name, '\":', n), ',' ORDER BY n_name), '}}') AS rates FROM c, arms GROUP BY n_regionkey, arm")
def check_whole_map(spark, read):
    """A whole map, by its JSON with keys in order."""
    return arms(_maps(read)).select("doc_id", "arm", F.get_json_object("text", "$.rates").alias("rates"))


def _columnar(read) -> DataFrame:
    """Events of each user as parallel arrays."""
    listed = F.array_sort(F.collect_list(F.struct("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))))
    grouped = read("events").groupBy("user_id").agg(listed.alias("all"))
    arrays = F.struct(F.transform("all", lambda x: x["event_id"]).alias("ids"), F.transform("all", lambda x: x["k"]).alias("k"))
    return grouped.select(F.col("user_id").cast("string").alias("doc_id"), F.to_json(F.struct(F.lit("s").alias("unit"), arrays.alias("hourly"))).cast("binary").alias("raw"))


@query(f"""
WITH {_ARMS} SELECT user_id::VARCHAR AS doc_id, arm, count(*)::INTEGER AS n, true AS equal, min(event_id) AS low, concat('[', string_agg(event_id::VARCHAR, ',' ORDER BY event_id), ']') AS ids
FROM events, arms GROUP BY user_id, arm
""")
def check_parallel_arrays(spark, read):
    """Lengths of parallel arrays, whether all are equal, the smallest element, and an array as it is, types and all."""
    held = F.from_json("text", "struct<hourly: struct<ids: array<bigint>, k: array<bigint>>>")["hourly"]
    return arms(_columnar(read)).select("doc_id", "arm", F.size(held["ids"]).alias("n"), (F.size(held["ids"]) == F.size(held["k"])).alias("equal"), F.array_min(held["ids"]).alias("low"), F.get_json_object("text", "$.hourly.ids").alias("ids"))


@query("""
SELECT event_id::VARCHAR AS doc_id, 'changed' AS problem, 'k' AS path, json_extract(props, '$.k')::VARCHAR AS before, (json_extract(props, '$.k')::BIGINT + 1)::VARCHAR AS after FROM events WHERE event_id % 7 = 0
UNION ALL SELECT event_id::VARCHAR, 'lost', 'k', json_extract(props, '$.k')::VARCHAR, NULL FROM events WHERE event_id % 7 = 1
UNION ALL SELECT event_id::VARCHAR, 'only after', 'more', NULL, 'dict' FROM events WHERE event_id % 7 = 2
UNION ALL SELECT event_id::VARCHAR, 'length', 'list', 'list', 'list' FROM events WHERE event_id % 7 = 3
""")
def json_differences(spark, read):
    """Where payloads differ from changed copies of themselves: a value, a key lost, an object added, a longer list."""
    events = read("events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("m", F.col("event_id") % 7)
    one, two = F.array(F.struct(F.lit(1).alias("a"))), F.array(F.struct(F.lit(2).alias("a")), F.struct(F.lit(3).alias("a")))
    before = events.withColumn("text", F.to_json(F.struct("k", one.alias("list"))))
    k = F.when(F.col("m") == 0, F.col("k") + 1).when(F.col("m") != 1, F.col("k"))
    more = F.when(F.col("m") == 2, F.struct(F.lit(1).alias("x"), F.struct(F.lit(2).alias("z")).alias("y")))
    after = events.withColumn("text", F.to_json(F.struct(k.alias("k"), F.when(F.col("m") == 3, two).otherwise(one).alias("list"), more.alias("more"))))
    found = verify.payload_differences(from_column(before, "event_id", "text"), from_column(after, "event_id", "text"), most=5)
    return found.select("doc_id", "problem", F.array_join("path", ".").alias("path"), "before", "after")


# Gates, the store on disk, and what reads back


@query(r"""
SELECT doc_id::VARCHAR AS doc_id, CASE doc_id % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'not_utf8' WHEN 2 THEN 'plain_text' ELSE 'json' END AS state,
  CASE WHEN doc_id % 4 = 3 THEN concat('{"id":', doc_id, '}') END AS compact FROM documents
""")
def payload_states(spark, read):
    """What bytes turn out to be: nothing, no UTF-8, no JSON, or JSON."""
    bad, text = F.concat(F.unhex(F.lit("FF")), F.coalesce(F.col("text"), F.lit("")).cast("binary")), F.concat(F.lit("text: "), F.coalesce("text", F.lit(""))).cast("binary")
    raw = F.when(F.col("doc_id") % 4 == 0, F.lit("").cast("binary")).when(F.col("doc_id") % 4 == 1, bad).when(F.col("doc_id") % 4 == 2, text)
    made = raw.otherwise(F.concat(F.lit('{ "id" : '), F.col("doc_id").cast("string"), F.lit(" }")).cast("binary"))
    return extract(read("documents").select(F.col("doc_id").cast("string").alias("doc_id"), made.alias("raw"))).select("doc_id", "state", "compact")


@query("""
SELECT n_nationkey::VARCHAR AS doc_id, CASE n_nationkey % 4 WHEN 0 THEN 'table' WHEN 2 THEN 'json' ELSE 'unchanged' END AS status, n_nationkey % 4 = 0 AS legend,
  CASE n_nationkey % 4 WHEN 1 THEN concat('{"a":', n_nationkey, '}') WHEN 2 THEN concat('{"a":', n_nationkey, ',"b":"', n_name, '"}') WHEN 3 THEN concat('text of ', n_name) END AS document,
  CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'no record array found; no improvement; the input is returned as it was' WHEN 2 THEN 'no record array found'
    ELSE 'plain_text; no improvement; the input is returned as it was' END AS note FROM nation
""")
def compress_outcomes(spark, read):
    """What each kind of payload becomes: records a table with a legend, spaced JSON compact, the rest as it came."""
    record = lambda i: F.concat(F.lit('{"i":'), i.cast("string"), F.lit(',"name":"'), F.col("n_name"), F.lit('","tags":[1,2,'), (i + 3).cast("string"), F.lit("]}"))
    rows = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), record), ","), F.lit("]"))
    key, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    raw = (
        F.when(F.col("n_nationkey") % 4 == 0, rows).when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit('{"a":'), key, F.lit("}")))
        .when(F.col("n_nationkey") % 4 == 2, F.concat(F.lit('{ "a" : '), key, F.lit(' , "b" : "'), name, F.lit('" }'))).otherwise(F.concat(F.lit("text of "), name))
    )
    done = compress(read("nation").select(key.alias("doc_id"), raw.cast("binary").alias("raw"))).documents
    return done.select("doc_id", "status", F.contains("document", F.lit("\n#legend ")).alias("legend"), F.when(F.col("status") != "table", F.col("document")).alias("document"), "note")


@query("SELECT source AS doc_id, 'lang' AS col, lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT source, 'source', source, count(*) FROM documents GROUP BY source")
def const_roundtrip(spark, read):
    """Cells without their constant columns, and with them again."""
    cells = typed_cells(read("documents"), "source", "doc_id", ["source", "lang"])
    counts = read("documents").groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("n_rows"))
    consts = profile.constants(profile.columns(cells, counts))
    rest = encode.without_constants(cells, consts).select("doc_id", "row", "col", "json")
    back = rest.unionByName(encode.with_constants(cells, consts).select("doc_id", "row", "col", "json"))
    value = F.when(F.col("json") != "null", F.regexp_replace("json", '^"|"$', ""))
    return back.groupBy("doc_id", "col", value.alias("value")).agg(F.count("*").alias("n"))


@query(f"""
WITH i AS (SELECT source AS doc_id, lpad(doc_id::VARCHAR, 8, '0') AS cell_id, substr(sha256(text), 1, 24) AS name, text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, cell_id, name, length(text) AS chars FROM i
""")
def store_sweep(spark, read):
    """A store on disk: cells committed, objects without a reader added and swept away, and what can be read after."""
    own = read("documents").filter("text is not null")
    cells = own.select(F.col("source").alias("doc_id"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("cell_id"), content_name(F.col("text")).alias("name"), F.col("text").alias("cell"))
    held = store.Store(spark, temporary(spark))
    held.commit(cells, own.select(F.col("source").alias("doc_id"), F.col("source").alias("document_id")).distinct())
    held._append(read("pages").select(content_name(F.col("html")).alias("name"), F.col("html").alias("content")).dropDuplicates(["name"]), "objects")
    held.collect(delete=True)
    extra = store.leaked(held.index, held.objects).select(F.lit("leaked").alias("doc_id"), F.lit(None).cast("string").alias("cell_id"), "name", F.char_length("content").cast("long").alias("chars"))
    return store.resolve(held.index, held.objects).select("doc_id", "cell_id", "name", F.char_length("content").cast("long").alias("chars")).unionByName(extra)


@query(f"""
WITH g AS (SELECT {_BLOCK} AS doc_id, {_tok(_csv('text'))} AS whole, {_tok(f"'{chr(92)}@0001'")} AS bare FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) FILTER (WHERE whole - bare >= 20) AS n_stored, sum(whole)::BIGINT AS before, sum(CASE WHEN whole - bare >= 20 THEN bare ELSE whole END)::BIGINT AS after FROM g GROUP BY doc_id
""")
def bare_handles(spark, read):
    """What documents would cost with cells under bare handles."""
    cells = _blocks(read).filter("text is not null").select(F.col("block").alias("doc_id"), F.col("doc_id").alias("row"), F.lit(0).alias("place"), F.col("text").alias("cell"))
    return measure.rendered_with_handles(cells, 20)
