"""Questions about records, as DataFrame queries with parameters.

One function for each form that questions about API payloads take; records are DataFrames, order
is an explicit column, and ties go to the first record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup(df: DataFrame, key: str, value, *wanted: str) -> DataFrame:
    """Fields of the records with a key (nested fields by their dotted name)."""
    return df.filter(F.col(key) == value).select(*(F.col(w).alias(w.replace(".", "_")) for w in wanted))


def count_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("n"))


def total(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.sum(column).alias("total"))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("n"))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """The different values as one text, in order."""
    return df.agg(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), ",").alias("found"))


def having_element(df: DataFrame, array: str, value, wanted: str) -> DataFrame:
    """A field of records whose array holds a value."""
    return df.filter(F.array_contains(array, value)).select(wanted)


def longer_than(df: DataFrame, array: str, n: int, wanted: str) -> DataFrame:
    """A field of records whose array has more than n elements."""
    return df.filter(F.size(array) > n).select(wanted)


def blank(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """A field of records where a text is absent, null or empty."""
    return df.filter(F.coalesce(F.col(column), F.lit("")) == "").select(wanted)


def key_presence(df: DataFrame, row: str, key: str) -> DataFrame:
    """(present, held, absent): rows (maps) that have a key, have it with a value, and lack it.

    A key with a null value is present.
    """
    return df.agg(*presence(row, key))


def presence(row: str, key: str) -> list[Column]:
    """The counts of ``key_presence`` as aggregates."""
    has = F.map_contains_key(F.col(row), key)
    return [F.count_if(has).alias("present"), F.count_if(has & F.element_at(row, key).isNotNull()).alias("held"), F.count_if(~has).alias("absent")]


def arg_max(df: DataFrame, by: Column, order: str, *wanted: str) -> DataFrame:
    """Fields of the record with the largest value, the first of equals."""
    # A global top-1 rather than a window over everything.
    return df.orderBy(by.desc_nulls_last(), order).limit(1).select(*wanted)


def arg_max_per(df: DataFrame, group: str, by: Column, order: str, *wanted: str) -> DataFrame:
    first = W.partitionBy(group).orderBy(by.desc_nulls_last(), order)
    return df.withColumn("rank_", F.row_number().over(first)).filter("rank_ = 1").select(group, *wanted)


def group_count(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def contiguous(df: DataFrame, column: str, start: int) -> DataFrame:
    """Whether the values are start, start + 1, ... without gap or repeat."""
    n = F.count("*")
    return df.agg(((F.min(column) == start) & (F.max(column) == start + n - 1) & (F.count_distinct(column) == n)).alias("contiguous"))


def keysets(df: DataFrame, row: str) -> DataFrame:
    """The different sets of keys of rows (maps), with their counts."""
    return df.groupBy(F.array_join(F.array_sort(F.map_keys(row)), ",").alias("keyset")).agg(F.count("*").alias("n"))


def uniform(df: DataFrame, row: str) -> DataFrame:
    return keysets(df, row).agg((F.count("*") <= 1).alias("uniform"))


def parallel_arg_max(df: DataFrame, labels: str, values: str) -> Column:
    """The label beside the largest value of two parallel arrays, the first of equals."""
    pairs = F.arrays_zip(F.col(labels).alias("label"), F.col(values).alias("value"))
    top = F.filter(pairs, lambda p: p["value"] == F.array_max(F.transform(pairs, lambda q: q["value"])))
    return F.get(top, F.lit(0))["label"]


def first_and_last(array: str) -> list[Column]:
    return [F.get(array, F.lit(0)).alias("first"), F.try_element_at(F.col(array), F.lit(-1)).alias("last")]


def first_match(array: str, condition) -> Column:
    """The first element that meets a condition, or null."""
    return F.get(F.filter(array, condition), F.lit(0))


def keyed(array: str, key: str, value: str) -> Column:
    """An array of records as a map."""
    return F.map_from_entries(F.transform(array, lambda x: F.struct(x[key].alias("key"), x[value].alias("value"))))
