"""Cells as the text of a document, and joins that put dictionaries and constants in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import EMPTY_ARRAY, NULL, escaped


def written() -> Column:
    """The text of a cell from its columns and its column's ``type``.

    A mixed column is JSON throughout; everything else is as plain as its type allows.
    """
    bare = F.when(F.col("kind") == "str", escaped(F.col("text"))).when(F.col("kind").isin("bool", "int", "float"), F.col("text"))
    listed = F.when(F.col("shape") == "empty", F.lit(EMPTY_ARRAY)).when(F.col("type") == "dints", F.col("steps")).when(F.col("type").isin("ints", "strs"), F.col("text"))
    return (
        F.when(F.col("kind") == "null", F.lit(NULL))
        .when(F.col("type") == "dict", F.col("text"))
        .when(F.col("type").isin("json", "num"), F.col("json"))
        .otherwise(F.coalesce(bare, F.when(F.col("kind") == "list", listed), F.col("json")))
    )


def without_constants(cells: DataFrame, constants: DataFrame) -> DataFrame:
    return cells.join(constants.select("doc_id", "col"), ["doc_id", "col"], "left_anti")


def with_constants(rows: DataFrame, constants: DataFrame) -> DataFrame:
    """(doc_id, row) joined with the constants of the document: the cells that were taken out."""
    return rows.select("doc_id", "row").distinct().join(constants, "doc_id")


def to_keys(cells: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """Cells of dictionary columns with the key of their value in ``key``; nulls and others without."""
    return cells.join(dictionaries.select("doc_id", "col", "kind", "canon", "key"), ["doc_id", "col", "kind", "canon"], "left")


def from_keys(keyed: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """The inverse of ``to_keys``: the value of each key, or what the cell held itself."""
    values = dictionaries.select("doc_id", "col", "key", F.col("canon").alias("of_canon"))
    return keyed.join(values, ["doc_id", "col", "key"], "left").withColumn("canon", F.coalesce("of_canon", "canon")).drop("of_canon")


def encoded(cells: DataFrame, ordered: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """(doc_id, row, col, place, type, cell): every varying cell as text.

    ordered: the profile of varying columns with their place and final type.
    """
    keyed = to_keys(cells, dictionaries).withColumn("text", F.coalesce("key", "text"))
    typed = keyed.join(ordered.select("doc_id", "col", "place", "type"), ["doc_id", "col"])
    return typed.select("doc_id", "row", "col", "place", "type", written().alias("cell"))
