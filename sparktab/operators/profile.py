"""What the columns of each document hold: presence, constants, distinct values, types, order.

Cells are (doc_id, row, col, kind, json, canon, text, shape, steps); absent cells have no row,
null cells have kind ``null``.  All work is keyed by (doc_id, col), so a document with many
columns is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cost import TokenModel, proxy

#: Tokens that a dictionary must save, a fixed value of the format.
LEAST_DICT_SAVING = 20


def json_string(column: str):
    """A string column as JSON text, in quotes."""
    return F.expr(f"substring(to_json(struct({column} as c)), 6, length(to_json(struct({column} as c))) - 6)")


def column_type(kind="kind", shape="shape"):
    """The type of a column from its values that are not null, as an aggregate."""
    kind, shape = F.col(kind), F.col(shape)
    some = F.count(F.when(kind != "null", 1)) > 0

    def all_are(*kinds: str):
        return F.coalesce(F.bool_and(F.when(kind != "null", kind.isin(*kinds))), F.lit(False))

    def shapes(*names: str):
        return F.coalesce(F.bool_and(F.when(kind != "null", (kind == "list") & shape.isin("empty", *names))), F.lit(False))

    filled = F.coalesce(F.bool_or(F.when(kind == "list", shape != "empty")), F.lit(False))
    return (
        F.when(~some, "null")
        .when(all_are("bool"), "bool")
        .when(all_are("int"), "int")
        .when(all_are("float"), "float")
        .when(all_are("int", "float"), "num")
        .when(all_are("str"), "str")
        .when(filled & shapes("rising"), "dints")
        .when(filled & shapes("rising", "ints"), "ints")
        .when(filled & shapes("strs"), "strs")
        .otherwise("json")
    )


def short(text):
    """A text, or the digest of a long one, to tell values apart by."""
    return F.when(F.length(text) > 64, F.sha2(text.cast("binary"), 256)).otherwise(text)


def columns(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, col, n_present, n_null, n_distinct, type, nullable, n_rows).

    counts: (doc_id, n_rows).  n_distinct is over all present values, null as one of them.
    """
    found = cells.groupBy("doc_id", "col").agg(
        F.count("*").alias("n_present"), F.count(F.when(F.col("kind") == "null", 1)).alias("n_null"), F.count_distinct(F.struct("kind", short(F.col("canon")))).alias("n_distinct"), column_type().alias("type"), F.min("json").alias("any_json")
    )
    return found.join(counts, "doc_id").withColumn("nullable", (F.col("n_present") < F.col("n_rows")) | (F.col("n_null") > 0))


def constants(profile: DataFrame) -> DataFrame:
    """(doc_id, col, json): columns present in every row with one and the same value."""
    return profile.filter((F.col("n_present") == F.col("n_rows")) & (F.col("n_distinct") == 1)).select("doc_id", "col", F.col("any_json").alias("json"))


def distinct_values(cells: DataFrame) -> DataFrame:
    """(doc_id, col, kind, canon, json, n, first_row, key): values that are not null, numbered by first sight."""
    found = cells.filter("kind <> 'null'").groupBy("doc_id", "col", "kind", "canon").agg(F.count("*").alias("n"), F.min("row").alias("first_row"), F.min_by("json", "row").alias("json"))
    return found.withColumn("key", (F.row_number().over(W.partitionBy("doc_id", "col").orderBy("first_row")) - 1).cast("string"))


def dictionaries(cells: DataFrame, profile: DataFrame, tokens: TokenModel = proxy, least: int = LEAST_DICT_SAVING) -> DataFrame:
    """(doc_id, col, canon, kind, key, json) of columns that are cheaper as keys into a dictionary.

    A column's cells are priced as they would be written; its dictionary as the JSON object of its
    entries, and the mean cost of a key for each cell (rounded half to even).  Under a model that does not add up
    the entries of a column are put together in one row to be priced: for documents of bounded size.
    """
    from .encode import written

    values = distinct_values(cells)
    if getattr(tokens, "additive", False):
        found = values.groupBy("doc_id", "col").agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_values"), F.sum(tokens(F.col("json"))).alias("json_cost"))
        typed = cells.filter("kind <> 'null'").join(profile.select("doc_id", "col", "type"), ["doc_id", "col"])
        prices = typed.groupBy("doc_id", "col").agg(F.sum(tokens(written())).alias("cells_cost"))
        chosen = worthwhile(found.join(prices, ["doc_id", "col"]), tokens, least)
        return values.join(chosen, ["doc_id", "col"]).select("doc_id", "col", "kind", "canon", "key", "json", "cells_cost", "dict_cost")
    typed = cells.filter("kind <> 'null'").join(profile.select("doc_id", "col", "type"), ["doc_id", "col"])
    prices = typed.groupBy("doc_id", "col").agg(F.sum(tokens(written())).alias("cells_cost"), F.count("*").alias("n_values"))
    entry = F.concat(F.lit('"'), F.col("key"), F.lit('":'), F.col("json"))
    listed = values.groupBy("doc_id", "col").agg(
        F.count("*").alias("n_distinct"),
        F.avg(tokens(F.col("key"))).alias("key_cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_row", entry.alias("entry")))), lambda x: x["entry"]), ",").alias("entries"),
    )
    text = F.concat(F.lit("{"), json_string("col"), F.lit(":{"), F.col("entries"), F.lit("}}"))
    chosen = (
        listed.join(prices, ["doc_id", "col"])
        .filter("n_values >= 2 and n_distinct >= 2 and n_distinct < n_values")
        .withColumn("dict_cost", tokens(text) + F.bround(F.col("key_cost") * F.col("n_values"), 0).cast("long"))
        .filter(F.col("cells_cost") - F.col("dict_cost") >= least)
        .select("doc_id", "col", "cells_cost", "dict_cost")
    )
    return values.join(chosen, ["doc_id", "col"]).select("doc_id", "col", "kind", "canon", "key", "json", "cells_cost", "dict_cost")


def worthwhile(columns: DataFrame, tokens: TokenModel, least: int = LEAST_DICT_SAVING) -> DataFrame:
    """(doc_id, col, cells_cost, dict_cost) of columns that a dictionary makes cheaper, under a model that adds up.

    columns: (doc_id, col, n_distinct, n_values, json_cost: of the different values as JSON, cells_cost).  Keys
    are the numbers from 0, one token for three digits; an entry has two quotes and a colon beside, and a comma
    but for the last.
    """
    n = F.col("n_distinct")
    keys = n + sum((F.greatest(n - 10**d, F.lit(0)) for d in (3, 6, 9, 12)), F.lit(0))
    ends = tokens(F.concat(F.lit("{"), json_string("col"), F.lit(":{}}")))
    cost = ends + F.col("json_cost") + keys + 4 * n - 1 + F.bround(keys / n * F.col("n_values"), 0).cast("long")
    able = columns.filter("n_values >= 2 and n_distinct >= 2 and n_distinct < n_values").withColumn("dict_cost", cost)
    return able.filter(F.col("cells_cost") - F.col("dict_cost") >= least).select("doc_id", "col", "cells_cost", "dict_cost")


def column_order(profile: DataFrame) -> DataFrame:
    """The profile with ``place``: columns by presence, most first, then by name."""
    return profile.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n_present"), "col")) - 1)
