"""Comparison of what was with what came back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.payloads import nodes


def differences(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, before, after, problem): ``lost``, ``only after`` or ``changed``; null-safe."""
    a = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("in_before"))
    b = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("in_after"))
    problem = F.when(F.col("in_after").isNull(), "lost").when(F.col("in_before").isNull(), "only after").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return a.join(b, keys, "full_outer").withColumn("problem", problem).filter("problem is not null").select(*keys, "before", "after", "problem")


def payload_differences(before: DataFrame, after: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, path, problem, before, after) of two sets of payloads, value by value.

    problem: ``lost``, ``only after``, ``length`` (lists of other lengths) or ``changed`` (another kind or value); a
    path names keys, and list elements by number.  What lies below a value that is told, a list of another length
    included, is not told again.  most: only the first so many of each payload, in the order of their places.
    """

    def side(payloads: DataFrame, name: str) -> DataFrame:
        steps = F.transform(F.arrays_zip("path", "place"), lambda x: F.when(x["path"] == "*", x["place"].cast("string")).otherwise(x["path"]))
        found = nodes(payloads).select("doc_id", steps.alias("path"), "place", "kind", "json", "n_children")
        return found.select("doc_id", "path", F.struct("place", "kind", "json", "n_children").alias(name))

    both = side(before, "a").join(side(after, "b"), ["doc_id", "path"], "full_outer")
    a, b = F.col("a"), F.col("b")
    problem = (
        F.when(b.isNull(), "lost").when(a.isNull(), "only after").when(a["kind"] != b["kind"], "changed")
        .when((a["kind"] == "list") & (a["n_children"] != b["n_children"]), "length").when(~a["json"].eqNullSafe(b["json"]), "changed")
    )
    found = both.withColumn("problem", problem).filter("problem is not null")
    # Told already: a value under one that is told (under a list of another length: lost or added elements).
    told = found.select("doc_id", F.col("path").alias("above"))
    below = found.filter("size(path) > 0").withColumn("up", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("path") - 1, F.lit(0))), lambda n: F.slice("path", F.lit(1), n))))
    below = below.join(told, (below.doc_id == told.doc_id) & (F.col("up") == F.col("above"))).select(below.doc_id, "path").distinct()
    left = found.join(below, ["doc_id", "path"], "left_anti")
    shown = left.select("doc_id", "path", "problem", F.coalesce("a.place", "b.place").alias("place"), F.coalesce("a.json", "a.kind").alias("before"), F.coalesce("b.json", "b.kind").alias("after"))
    if most is not None:
        shown = shown.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("place", "path"))).filter(F.col("n") <= most).drop("n")
    return shown.drop("place")


def answers_compared(truth: DataFrame, given: DataFrame) -> DataFrame:
    """(label, same): answers (label, answer) by exact equality, a missing one counts as wrong."""
    return truth.join(given.withColumnRenamed("answer", "got"), "label", "left").select("label", F.col("answer").eqNullSafe(F.col("got")).alias("same"))
