"""A corpus pipeline over ``documents``, in stages that each call one operator of ``sparktab.llm``.

1. language: documents of no known language go, null and empty texts among them.
2. near_duplicates: of each group of similar texts (five-word shingles, similarity 0.8) the one with
   the smallest id stays, and of rows that repeat an id and its text, one.  Different texts under an id
   are judged each for itself.  Rows without an id are judged among each other.
3. decontaminate: documents that hold a ten-word passage of a benchmark item go.
4. secrets: secrets are replaced by a mark.
5. tokens: token ids of what is left.

Every stage takes empty tables and very long texts, decides row by row (repeated ids and null ids are rows of their own)
and hands on the columns of documents, whatever they are called, but for the last, which returns ids, counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.llm import bpe, decontaminate, jaccard_join, langid
from sparktab.llm import secrets as secret_scan
from sparktab.llm.common import broadcast_if_small, drop, durable, read
from sparktab.llm.queries import vocabulary

#: Documents whose language is less certain than this are rejected.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_sure(docs, langid.fit(docs.filter(~langid.held_out())), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    unnamed = docs.filter("doc_id is null")
    named = _one_of_each(docs.filter("doc_id is not null"))
    return named if unnamed.isEmpty() else named.unionByName(_one_of_each(unnamed))


def _one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of similar texts, that with the smallest id; a text under an id has a key of its own."""
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    groups = jaccard_join.join(keyed, width=5, num=4, den=5, id_col="row_key").withColumnRenamed("doc_id", "row_key")
    linked = durable(groups.filter("row_key <> component_id").select("row_key", "component_id"))
    members = linked.unionByName(linked.select(F.col("component_id").alias("row_key"), "component_id")).distinct()
    first = members.join(keyed.select("row_key", "doc_id"), "row_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "row_key"))["row_key"].alias("row_key"))
    others = durable(members.join(first, "row_key", "left_anti").select("row_key"))
    kept = keyed.join(broadcast_if_small(others, F.lit(16)), "row_key", "left_anti")
    # Rows that repeat a text under an id are few, if any; only they are gathered to leave one of each.
    twice = durable(keyed.groupBy("row_key").agg(F.count("*").alias("n")).filter("n > 1").select("row_key"))
    if not twice.isEmpty():
        repeated = kept.join(twice, "row_key", "left_semi").dropDuplicates(["row_key"])
        kept = kept.join(twice, "row_key", "left_anti").unionByName(repeated)
    drop(linked)
    return kept.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), window=10)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"))
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Language scores and token ids cannot be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
    return docs
