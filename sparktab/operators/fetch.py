"""Retrieval of stored values: by id, by what they contain, within a budget of tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import content_name, requested_document, requested_id
from ..functions.cost import TokenModel, proxy
from ..sources.tables import durable

#: Tokens of one answer, and characters shown on either side of a match: fixed values.
MOST_TOKENS, CONTEXT = 8_000, 240
_SPANS = "cast(array() as array<struct<start:int,end:int>>)"


def hit_spans(text: Column, needle: str, context: int = CONTEXT) -> Column:
    """Spans (start, end) around each hit of a literal, letters in any case, overlaps and touches merged.

    Places are in the text as it is, so characters whose lower case is longer do not shift them.
    """
    pattern = "(?iu)" + re.escape(needle).replace("/", "\\/")
    size = F.char_length(text)
    hits = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda x: F.char_length(x))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    walked = F.aggregate(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit")),
        F.struct(F.lit(0).alias("at"), F.expr(_SPANS).alias("out")),
        lambda s, x: F.struct((s["at"] + x["gap"] + x["hit"]).alias("at"), _with_span(s["out"], F.greatest(F.lit(0), s["at"] + x["gap"] - context), F.least(size, s["at"] + x["gap"] + x["hit"] + context)).alias("out")),
        lambda s: s["out"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(F.expr(_SPANS))


def _with_span(out: Column, start: Column, end: Column) -> Column:
    last = F.try_element_at(out, F.lit(-1))
    longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end")))
    return F.when((F.size(out) > 0) & (start <= last["end"]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), longer)).otherwise(F.concat(out, F.array(F.struct(start.alias("start"), end.alias("end")))))


def matching_parts(text: Column, needle: str, context: int = CONTEXT) -> Column:
    """The parts of a text around the hits; the whole text where they are not shorter; none without a hit."""
    spans = hit_spans(text, needle, context)
    shown = F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["start"])
    parts = F.transform(spans, lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"]))
    return F.when(F.size(spans) == 0, F.expr("cast(array() as array<string>)")).when(shown >= F.char_length(text), F.array(text)).otherwise(parts)


def clipped(text: Column, budget: Column, tokens: TokenModel = proxy) -> Column:
    """A prefix of a text within a budget, found by halving, as often as the text's length asks for."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.char_length(text) + 1)).cast("int"))
    state = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("low"), F.char_length(text).alias("high")),
        lambda s, _: F.when(
            tokens(F.substr(text, F.lit(1), ((s["low"] + s["high"] + 1) / 2).cast("int"))) <= budget,
            F.struct(((s["low"] + s["high"] + 1) / 2).cast("int").alias("low"), s["high"].alias("high")),
        ).otherwise(F.struct(s["low"].alias("low"), F.greatest(s["low"], ((s["low"] + s["high"] + 1) / 2).cast("int") - 1).alias("high"))),
    )
    return F.substr(text, F.lit(1), state["low"])


def greedy_budget(items: DataFrame, budget: int = MOST_TOKENS) -> DataFrame:
    """(request, pos, outcome) of items (request, pos, state, cost; cost null where there is no content).

    In order of pos, an item that fits is ``content`` and takes from the budget; one that does not is ``deferred``
    and takes nothing, unless it is the first with content: that one is ``truncated`` and takes all.  Items without
    content keep their state.  A request's items stream through one task; nothing of them is held but what is spent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, spent = object(), 0
        for batch in batches:
            outcomes = []
            for request, state, cost in zip(*(batch.column(c).to_pylist() for c in ("request", "state", "cost"))):
                if request != current:
                    current, spent = request, 0
                if cost is None:
                    outcomes.append(state)
                elif spent + cost <= budget:
                    spent += cost
                    outcomes.append("content")
                elif spent:
                    outcomes.append("deferred")
                else:
                    spent = budget
                    outcomes.append("truncated")
            yield pa.RecordBatch.from_arrays([batch.column("request"), batch.column("pos"), pa.array(outcomes, pa.string())], ["request", "pos", "outcome"])

    rows = items.select("request", F.col("pos").cast("long").alias("pos"), "state", F.col("cost").cast("long").alias("cost"))
    return rows.repartition("request").sortWithinPartitions("request", "pos").mapInArrow(run, "request string, pos long, outcome string")


def fetch(requests: DataFrame, index: DataFrame, objects: DataFrame, query: str | None = None, budget: int = MOST_TOKENS, tokens: TokenModel = proxy) -> DataFrame:
    """(request, pos, asked, cell_id, state, content, tokens) for requests (request, document, ids array).

    state: content, truncated, deferred, no_match, missing, changed, unknown_id or unknown_document.
    """
    asked = requests.select("request", requested_document(F.col("document")).alias("doc_id"), F.posexplode("ids").alias("pos", "asked")).withColumn("cell_id", requested_id(F.col("asked")))
    known = index.select("doc_id").distinct().withColumn("known", F.lit(True))
    found = asked.join(known, "doc_id", "left").join(index, ["doc_id", "cell_id"], "left").join(objects, "name", "left")
    whole = F.col("content")
    parts = F.array(whole) if query is None else matching_parts(whole, query)
    body = F.when(F.size(parts) > 0, F.array_join(parts, "\n…\n"))
    state = (
        F.when(F.col("known").isNull(), "unknown_document").when(F.col("name").isNull(), "unknown_id").when(whole.isNull(), "missing")
        .when(content_name(whole) != F.col("name"), "changed").when(body.isNull(), "no_match")
    )
    priced = found.withColumn("state", state).withColumn("body", F.when(F.col("state").isNull(), body))
    # Missing content and missed queries cost nothing; the rest is dealt with in the order asked.
    priced = durable(priced.withColumn("cost", tokens(F.col("body"))).withColumn("cost", F.when(F.col("body").isNotNull(), F.col("cost"))).select(F.col("request").cast("string").alias("request"), F.col("pos").cast("long").alias("pos"), "asked", "cell_id", "state", "body", "cost"))
    # Bodies do not go where the budget is dealt out, only what they cost.
    dealt = priced.drop("state").join(greedy_budget(priced, budget), ["request", "pos"])
    content = F.when(F.col("outcome") == "content", F.col("body")).when(F.col("outcome") == "truncated", clipped(F.col("body"), F.lit(budget), tokens))
    return dealt.select("request", "pos", "asked", "cell_id", F.col("outcome").alias("state"), content.alias("content"), F.col("cost").alias("tokens"))
