"""Typed tables as cells, with no JSON in between: kinds come from the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import deltas, never_falls
from ..operators.profile import json_string


def _parts(name: str, kind: T.DataType) -> Column:
    """(col, kind, json, canon, text, shape, steps) of a column."""
    c, none = F.col(f"`{name}`"), F.lit(None).cast("string")
    shape = steps = none
    if isinstance(kind, T.BooleanType):
        tag, text = "bool", c.cast("string")
    elif isinstance(kind, T.IntegralType):
        tag, text = "int", c.cast("string")
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        tag, text = "float", c.cast("string")
    elif isinstance(kind, T.ArrayType):
        tag, text = "list", F.array_join(c.cast("array<string>"), " ")
        if isinstance(kind.elementType, T.IntegralType):
            longs = c.cast("array<bigint>")
            shape = F.when(F.size(c) == 0, "empty").when(never_falls(longs), "rising").otherwise("ints")
            steps = F.array_join(deltas(longs), " ")
        else:
            word = lambda x: (x != "") & ~x.startswith("\\") & ~x.rlike(r"[\p{IsWhite_Space}\x1c-\x1f]")
            shape = F.when(F.size(c) == 0, "empty").when(F.forall(c.cast("array<string>"), word), "strs").otherwise("other")
    elif isinstance(kind, (T.StructType, T.MapType)):
        tag, text = "dict", none
    else:
        tag, text = "str", c.cast("string")
    json = F.to_json(c) if tag in ("list", "dict") else json_string(f"cast(`{name}` as string)") if tag == "str" else text
    gone = c.isNull()
    tagged = F.when(gone, F.lit("null")).otherwise(F.lit(tag))
    written = F.when(gone, F.lit("null")).otherwise(json)
    return F.struct(
        F.lit(name).alias("col"), tagged.alias("kind"), written.alias("json"), written.alias("canon"), text.alias("text"),
        (shape if shape is none else F.when(~gone, shape)).cast("string").alias("shape"), steps.cast("string").alias("steps"),
    )


def typed_cells(df: DataFrame, id_col: str, order_col: str, columns: list[str], numbered: bool = False) -> DataFrame:
    """Cells (doc_id, row, col, kind, json, canon, text, shape, steps): a document for each value of ``id_col``.

    row is the value of an integer column by which a document's rows are ordered and told apart; that needs no
    shuffle.  With ``numbered`` it counts from 0, which sorts each document in a task of its own: for
    documents of bounded size.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    row = F.row_number().over(W.partitionBy(id_col).orderBy(order_col)) - 1 if numbered else F.col(order_col).cast("long")
    cells = F.explode(F.array(*(_parts(c, kinds[c]) for c in columns))).alias("c")
    return df.select(F.col(id_col).cast("string").alias("doc_id"), row.alias("row"), *dict.fromkeys(columns)).select("doc_id", "row", cells).select("doc_id", "row", "c.*")
