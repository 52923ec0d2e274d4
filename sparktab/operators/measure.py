"""Reports: what was saved and where, sweeps over thresholds and encodings, tallies of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import HANDLE, content_name
from ..functions.cost import TokenModel, csv_cost, proxy

#: Bars of the threshold sweep and forms of a handle, fixed values.
BARS = (1, 5, 10, 20, 50, 100, 200)
HEX_WIDTHS = (4, 6, 8, 12, 16)
LURES = {"bare": (0, False), "size": (0, True), "text_32": (32, False), "size_text_32": (32, True), "size_text_48": (48, True), "size_text_80": (80, True)}
#: The least share of raw answers that must be right for a comparison to say anything, and allowed gaps.
RAW_LEAST, GRADED_GAP, JUDGED_GAP = 0.8, 0, 1
ARMS = ("raw", "compressed", "stored")


def token_split(text: Column, leaves: Column, tokens: TokenModel = proxy) -> Column:
    """(total, values, structure): tokens of a JSON text, of its scalars (joined by spaces), and the rest."""
    total, values = tokens(text), tokens(F.array_join(leaves, " "))
    return F.struct(total.alias("total"), values.alias("in_values"), (total - values).alias("structure"))


def totals(savings: DataFrame, name: str) -> DataFrame:
    """Sums of before and after by name and for all (name ``TOTAL``), with percent saved."""
    summed = savings.rollup(name).agg(F.sum("before").alias("before"), F.sum("after").alias("after"), F.grouping(name).alias("all"))
    label = F.when(F.col("all") == 1, "TOTAL").otherwise(F.col(name))
    percent = F.when(F.col("before") > 0, F.round(100.0 * (F.col("before") - F.col("after")) / F.col("before"), 1)).otherwise(0.0)
    return summed.select(label.alias(name), "before", "after", percent.alias("percent"))


def priced_cells(cells: DataFrame, text: str, tokens: TokenModel = proxy, shown: Column | None = None) -> DataFrame:
    """``cells`` with gain: what a cell costs less when a handle stands for it."""
    stand_in = F.lit(f"{HANDLE}0001") if shown is None else shown
    return cells.withColumn("gain", csv_cost(F.col(text), tokens) - csv_cost(stand_in, tokens))


def threshold_sweep(priced: DataFrame, bars: tuple[int, ...] = BARS) -> DataFrame:
    """(bar, n_stored, saved) for each bar: cells whose gain reaches it."""
    return priced.select("gain", F.explode(F.array(*map(F.lit, bars))).alias("bar")).groupBy("bar").agg(F.count_if(F.col("gain") >= F.col("bar")).alias("n_stored"), F.coalesce(F.sum(F.when(F.col("gain") >= F.col("bar"), F.col("gain"))), F.lit(0)).alias("saved"))


def encoding_sweep(cells: DataFrame, text: str, tokens: TokenModel = proxy, least: int = 20) -> DataFrame:
    """(form, n_stored, saved): handles of hex digits of several widths, and of an ordinal."""
    name = content_name(F.col(text))
    forms = [F.struct(F.lit(f"hex-{w}").alias("form"), F.concat(F.lit(HANDLE), F.substring(name, 1, w)).alias("handle")) for w in HEX_WIDTHS]
    forms.append(F.struct(F.lit("ordinal").alias("form"), F.lit(f"{HANDLE}0001").alias("handle")))
    spread = cells.select(text, F.explode(F.array(*forms)).alias("f")).select(text, "f.*")
    return _stored(spread, "form", csv_cost(F.col(text), tokens) - csv_cost(F.col("handle"), tokens), least)


def lure_sweep(cells: DataFrame, text: str, tokens: TokenModel = proxy, least: int = 20) -> DataFrame:
    """(lure, n_stored, saved): bare handles, handles with the size, with a beginning of the text (blanks as one
    space), and with both."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), r"\s+", " "), "^ | $", "")
    priced = cells.select(tokens(F.col(text)).alias("size"), csv_cost(F.col(text), tokens).alias("whole"), F.substring(plain, 1, max(n for n, _ in LURES.values())).alias("head"))

    def form(lure: str, n: int, sized: bool) -> Column:
        size = F.concat(F.lit("["), F.col("size").cast("string"), F.lit("t] ")) if sized else F.lit("")
        return F.struct(F.lit(lure).alias("lure"), F.concat(F.lit(f"{HANDLE}0001"), size, F.substring("head", 1, n)).alias("handle"))

    spread = priced.select("whole", F.explode(F.array(*(form(k, *v) for k, v in LURES.items()))).alias("f")).select("whole", "f.*")
    return _stored(spread, "lure", F.col("whole") - csv_cost(F.col("handle"), tokens), least)


def _stored(spread: DataFrame, by: str, gain: Column, least: int) -> DataFrame:
    g = F.col("gain")
    return spread.withColumn("gain", gain).groupBy(by).agg(F.count_if(g >= least).alias("n_stored"), F.coalesce(F.sum(F.when(g >= least, g)), F.lit(0)).alias("saved"))


def rendered_with_handles(encoded: DataFrame, bar: int, tokens: TokenModel = proxy) -> DataFrame:
    """(doc_id, n_stored, before, after) of encoded cells (doc_id, row, place, cell) if cells that a bare handle
    makes cheaper by the bar were stored under one."""
    bare = csv_cost(F.lit(f"{HANDLE}0001"), tokens)
    whole = csv_cost(F.col("cell"), tokens)
    priced = encoded.select("doc_id", whole.alias("whole"), bare.alias("bare")).withColumn("goes", F.col("whole") - F.col("bare") >= bar)
    return priced.groupBy("doc_id").agg(F.count_if("goes").alias("n_stored"), F.sum("whole").alias("before"), F.sum(F.when(F.col("goes"), F.col("bare")).otherwise(F.col("whole"))).alias("after"))


def arm_tally(answers: DataFrame, raw: str = "raw", arms: tuple[str, ...] = ARMS, judged: bool = False) -> DataFrame:
    """(arm, n, ok, gap, verdict) of answers (arm, ok boolean), graded or judged, one row for each arm named or seen.

    gap: how many fewer right answers than the raw arm.  verdict: ``inconclusive`` if an arm is empty or has
    another number of answers than raw, or raw itself is empty or below ``RAW_LEAST``; else pass (the gap is allowed) or fail.
    """
    seen = answers.groupBy("arm").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"))
    named = answers.sparkSession.createDataFrame([(x,) for x in arms], "arm string")
    none = F.lit(0).cast("long")
    tally = named.join(seen, "arm", "full_outer").select("arm", F.coalesce("n", none).alias("n"), F.coalesce("ok", none).alias("ok"))
    base = tally.filter(F.col("arm") == raw).select(F.lit(1).alias("one"), F.col("n").alias("raw_n"), F.col("ok").alias("raw_ok"))
    gap = F.col("raw_ok") - F.col("ok")
    unclear = (F.col("n") == 0) | F.coalesce(F.col("raw_n") == 0, F.lit(True)) | (F.col("n") != F.col("raw_n")) | (F.col("raw_ok") < RAW_LEAST * F.col("raw_n"))
    verdict = F.when(unclear, "inconclusive").when(gap <= (JUDGED_GAP if judged else GRADED_GAP), "pass").otherwise("fail")
    return tally.withColumn("one", F.lit(1)).join(F.broadcast(base), "one", "left").select("arm", "n", "ok", gap.alias("gap"), verdict.alias("verdict"))


def miss_tally(answers: DataFrame) -> DataFrame:
    """(arm, replicate, answered, missed, fetches) of answers (arm, replicate, ok or null, fetched)."""
    return answers.groupBy("arm", "replicate").agg(F.count("ok").alias("answered"), F.count_if(~F.col("ok")).alias("missed"), F.coalesce(F.sum("fetched"), F.lit(0)).alias("fetches"))


def cost_estimate(prompts: DataFrame, text: str, price_per_million: float, tokens: TokenModel = proxy) -> DataFrame:
    """(arm, tokens, cost): what reading every prompt of an arm costs."""
    return prompts.groupBy("arm").agg(F.sum(tokens(F.col(text))).alias("tokens")).withColumn("cost", F.round(F.col("tokens") * price_per_million / 1e6, 6))
