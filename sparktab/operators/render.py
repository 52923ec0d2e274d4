"""Documents as text: preamble, header, and CSV rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import EMPTY_ARRAY, EMPTY_STRING, NULL
from ..functions.cost import csv_quoted
from ..sources.documents import HEADER_EVERY, MARKER, PREAMBLE
from .profile import json_string

#: What the legend says of each encoding, in its order.
LEGEND = {
    "dints": "dints columns list whole numbers as a start followed by steps, so 7 1 5 reads 7, 8, 13",
    "lists": "ints and strs columns list their elements with a blank in between",
    "null": r"\N reads null",
    "empty_string": r"\E reads as the empty string",
    "empty_array": r"\A reads as the empty list",
    "handle": r"\@nnnn[Nt] is a value of N tokens held in the store: ask for nnnn of the document named on the #store line",
    "absent": "where nothing stands, the record lacks that key",
    "repeat": f"after {HEADER_EVERY} rows the header line comes once more, and the table goes on",
    "dict": "dict columns give a number, whose value the #dict line tells",
    "keyed": "the column on the #keyed line holds the name under which each record stood",
    "dotted": "a column a.b is b within a",
}


def legend(flags: dict[str, Column]) -> Column:
    """The clauses whose flag is set, in order."""
    return F.array_join(F.array_compact(F.array(*(F.when(flags[k], F.lit(v)) for k, v in LEGEND.items()))), "; ")


def header_of() -> Column:
    """``[N]{name:type?,...}`` from n_rows and the sorted array ``cols`` of (place, col, type, nullable)."""
    one = F.transform("cols", lambda c: F.concat(c["col"], F.lit(":"), c["type"], F.when(c["nullable"], F.lit("?")).otherwise("")))
    return F.concat(F.lit("["), F.col("n_rows").cast("string"), F.lit("]{"), F.array_join(one, ","), F.lit("}"))


def rows_as_csv(cells: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, row, line, fields): CSV lines of all rows, those without a cell included.

    cells: (doc_id, row, place, shown); documents: (doc_id, n_rows, n_cols).
    """
    held = cells.groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("place", "shown"))).alias("held"))
    grid = documents.select("doc_id", "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"))
    places = F.when(F.col("n_cols") > 0, F.sequence(F.lit(0), F.col("n_cols") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    fields = F.transform(places, lambda p: F.coalesce(F.try_element_at(F.col("held"), p), F.lit("")))
    line = F.when((F.col("n_cols") == 1) & (F.get("fields", F.lit(0)) == ""), F.lit('""')).otherwise(F.array_join(F.transform("fields", csv_quoted), ","))
    return grid.join(held, ["doc_id", "row"], "left").withColumn("fields", fields).select("doc_id", "row", "fields", line.alias("line"))


def render(cells: DataFrame, ordered: DataFrame, constants: DataFrame, dictionaries: DataFrame, parts: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, document).

    cells: (doc_id, row, place, shown); ordered: columns with place, type and nullable; constants: (doc_id,
    col, json); dictionaries: (doc_id, col, key, json); parts: what ``extract`` gave; ids: (doc_id,
    document_id) of documents with stored cells.
    """

    def by_document(rows: DataFrame, name: str, text: Column, *order: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(*order, text.alias("text"))))
        return rows.groupBy("doc_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(listed, lambda x: x["text"]), ","), F.lit("}")).alias(name))

    consts = by_document(constants, "consts", F.concat(json_string("col"), F.lit(":"), F.col("json")), "col")
    entries = F.array_sort(F.collect_list(F.struct(F.col("key").cast("int").alias("n"), F.concat(F.lit('"'), F.col("key"), F.lit('":'), F.col("json")).alias("text"))))
    per_column = dictionaries.groupBy("doc_id", "col").agg(F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda x: x["text"]), ","), F.lit("}")).alias("json"))
    dicts = by_document(per_column, "dicts", F.concat(json_string("col"), F.lit(":"), F.col("json")), "col")
    cols = ordered.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "col", "type", "nullable"))).alias("cols"))
    dotted = constants.filter(F.contains("col", F.lit("."))).select("doc_id").distinct().withColumn("dotted_const", F.lit(True))
    whole = (
        parts.select("doc_id", "path", "key_column", "wrapper", "n_rows")
        .join(cols, "doc_id", "left").join(consts, "doc_id", "left").join(dicts, "doc_id", "left").join(ids, "doc_id", "left").join(dotted, "doc_id", "left")
        .withColumn("cols", F.coalesce("cols", F.expr("cast(array() as array<struct<place:int,col:string,type:string,nullable:boolean>>)")))
        .withColumn("n_cols", F.size("cols"))
    )
    lines = rows_as_csv(cells, whole.select("doc_id", "n_rows", "n_cols"))
    seen = lambda mark: F.bool_or(F.array_contains("fields", mark))
    body = lines.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("row", "line"))).alias("lines"),
        seen(NULL).alias("null"), seen(EMPTY_STRING).alias("empty_string"), seen(EMPTY_ARRAY).alias("empty_array"), seen("").alias("absent"),
        F.bool_or(F.exists("fields", lambda x: x.startswith("\\@"))).alias("handle"),
    )
    has = lambda *types: F.exists("cols", lambda c: c["type"].isin(*types))
    flags = {
        "dints": has("dints"), "lists": has("ints", "strs"), "null": F.col("null"), "empty_string": F.col("empty_string"), "empty_array": F.col("empty_array"),
        "handle": F.col("handle"), "absent": F.col("absent"), "repeat": F.col("n_rows") > HEADER_EVERY, "dict": F.col("dicts").isNotNull(), "keyed": F.col("key_column").isNotNull(),
        "dotted": F.coalesce("dotted_const", F.lit(False)) | F.exists("cols", lambda c: F.contains(c["col"], F.lit("."))),
    }
    told = legend(flags)
    header = header_of()
    printed = F.transform("lines", lambda x: F.when((x["row"] > 0) & (x["row"] % HEADER_EVERY == 0), F.concat(F.col("header"), F.lit("\n"), x["line"])).otherwise(x["line"]))
    top = F.array_compact(
        F.array(
            F.lit(MARKER),
            F.when(told != "", F.concat(F.lit(PREAMBLE["legend"]), told)),
            F.when(F.size("path") > 0, F.concat(F.lit(PREAMBLE["path"]), F.to_json("path"))),
            F.when(F.col("key_column").isNotNull(), F.concat(F.lit(PREAMBLE["keyed"]), json_string("key_column"))),
            F.when(F.col("wrapper") != "{}", F.concat(F.lit(PREAMBLE["wrap"]), F.col("wrapper"))),
            F.when(F.col("consts").isNotNull(), F.concat(F.lit(PREAMBLE["const"]), F.col("consts"))),
            F.when(F.col("dicts").isNotNull(), F.concat(F.lit(PREAMBLE["dict"]), F.col("dicts"))),
            F.when(F.col("document_id").isNotNull(), F.concat(F.lit(PREAMBLE["store"]), F.lit('"'), F.col("document_id"), F.lit('"'))),
            F.col("header"),
        )
    )
    text = F.concat(F.array_join(top, "\n"), F.lit("\n"), F.array_join(printed, "\n"), F.lit("\n"))
    return whole.join(body, "doc_id").withColumn("header", header).select("doc_id", text.alias("document"))
