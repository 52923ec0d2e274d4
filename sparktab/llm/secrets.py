"""Secret scans through a trigram inverted index, in DataFrame and SQL functions alone.

From each rule's pattern a Boolean trigram query is derived: every text that matches holds
all trigrams of one of its clauses.  The index has a posting (document, trigram) for each
trigram that any query names; postings of a document are intersected clause by clause, and
only documents that pass are joined back (by broadcast where they are few) and verified with the rule's pattern.  A rule whose
pattern has no mandatory trigram is matched against every text where it is read.

Trigrams are taken of lower-cased texts, so that a query also holds for letters in either
case.  Spans are (kind, start, end) in code points, end exclusive, leftmost and not
overlapping within a kind.

Null text is taken as empty.  Every input row gives one output row, none for an empty table: rows that repeat an id
are told apart by their texts, null ids are joined null-safely, extra columns are ignored.  The work for a very long text
grows with its length and a little with the square of its matches (a block of 256 at a time).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import from_deltas
from .common import broadcast_if_small, durable


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern (Java and Python syntax alike), and what a match needs.

    least: code points that ``measured`` (a group number) must have at least.
    """

    kind: str
    pattern: str
    measured: int = 0
    least: int = 0


#: The three base kinds of the contract, in their order, then what this scan adds.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    # Runs are matched as far as they go, so shorter ones need no match of their own to be dropped.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE = 3

#: A set of strings that a part of a pattern can match is followed while it has at most so many.
EXACT = 24

Clauses = frozenset[frozenset[str]]
_ANY: Clauses = frozenset([frozenset()])


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _and(a: Clauses, b: Clauses) -> Clauses:
    return _least(frozenset(x | y for x in a for y in b))


def _or(a: Clauses, b: Clauses) -> Clauses:
    return _least(a | b)


def _least(clauses: Clauses) -> Clauses:
    """Without clauses that another clause implies."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _strings(node) -> set[str] | None:
    """All strings (lower case) that a parsed part can match, if they are few."""
    op, arg = node
    if op is ops.LITERAL:
        return {chr(arg).lower()}
    if op is ops.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is ops.LITERAL:
                out.add(chr(value).lower())
            elif kind is ops.RANGE and value[1] - value[0] < EXACT:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= EXACT else None
    if op is ops.BRANCH:
        parts = [_sequence(b) for b in arg[1]]
        return None if any(p is None for p in parts) else _few(set().union(*parts))
    if op is ops.SUBPATTERN:
        return _sequence(arg[-1])
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[1] <= 2:
        once = _sequence(arg[2])
        return None if once is None else _few({"".join(p) for n in range(arg[0], arg[1] + 1) for p in itertools.product(once, repeat=n)})
    return None


def _few(strings: set[str]) -> set[str] | None:
    return strings if len(strings) <= EXACT else None


def _sequence(nodes) -> set[str] | None:
    out: set[str] | None = {""}
    for node in nodes:
        own = _strings(node)
        out = None if own is None else _few({a + b for a in out for b in own})
        if out is None:
            return None
    return out


def _query(nodes) -> Clauses:
    """Clauses (each a set of trigrams that must all occur), one of which every match satisfies."""
    clauses, run = _ANY, {""}

    def closed(clauses: Clauses, run: set[str]) -> Clauses:
        return _and(clauses, reduce(_or, (frozenset([_trigrams(s)]) for s in run)))

    for node in nodes:
        own = _strings(node)
        joined = None if own is None else _few({a + b for a in run for b in own})
        if joined is not None:
            run = joined
            continue
        clauses, run = closed(clauses, run), {""}
        op, arg = node
        if own is not None:
            run = own
        elif op is ops.BRANCH:
            clauses = _and(clauses, reduce(_or, (_query(b) for b in arg[1])))
        elif op is ops.SUBPATTERN:
            clauses = _and(clauses, _query(arg[-1]))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[0] > 0:
            clauses = _and(clauses, _query(arg[2]))
    return closed(clauses, run)


def trigram_query(pattern: str) -> list[list[str]]:
    """The Boolean trigram query of a pattern as OR of ANDs; empty if it has no mandatory trigram."""
    clauses = _query(parser.parse(pattern))
    return [] if frozenset() in clauses else sorted(sorted(c) for c in clauses)


_NONE = "cast(array() as array<struct<start:int,kind_order:int,end:int,kind:string>>)"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind) of a rule's matches in a text.

    One pass finds the matches; where there are some, a second splits the text at them, and running sums of the lengths
    of what lies between and of the matches give the places.
    """

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)), lambda x: F.char_length(x))
        lengths = F.flatten(F.zip_with(gaps, found, lambda gap, x: F.array(gap.cast("bigint"), F.char_length(x).cast("bigint"))))

        def spans(at: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                one = F.struct(F.get(at, 2 * i).cast("int").alias("start"), F.lit(order).alias("kind_order"), F.get(at, 2 * i + 1).cast("int").alias("end"), F.lit(rule.kind).alias("kind"))
                enough = F.char_length(F.regexp_extract(x, rule.pattern, rule.measured)) >= rule.least if rule.least else F.lit(True)
                return F.when(enough, one)

            return F.array_compact(F.transform(found, span))

        return F.when(F.size(found) == 0, F.expr(_NONE)).otherwise(_let(from_deltas(lengths), spans))

    return _let(F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1)), placed)


def postings(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index over the trigrams that the rules' queries name: (trigram, doc_id, fp)."""
    named = sorted({t for r in rules for clause in trigram_query(r.pattern) for t in clause})
    low = rows.select("doc_id", "fp", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.col("low").contains(t), F.lit(t)) for t in named)))
    return low.select("doc_id", "fp", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, fp, kinds): the rules whose query a document's intersected postings satisfy."""
    by_doc = index.groupBy("doc_id", "fp").agg(F.collect_set("trigram").alias("held"))
    passed = []
    for r in rules:
        if query := trigram_query(r.pattern):
            met = reduce(Column.__or__, (F.size(F.array_except(F.array(*map(F.lit, clause)), "held")) == 0 for clause in query))
            passed.append(F.when(met, F.lit(r.kind)))
    return by_doc.select("doc_id", "fp", F.array_compact(F.array(*passed)).alias("kinds")).filter(F.size("kinds") > 0)


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """(doc_id, text, spans) for every row, and ``kept``: the column given as ``keep``, if any.

    spans: array of (start, kind_order, end, kind), by start and then by the order of the rules.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    more = [] if keep is None else [keep.alias("kept")]
    rows = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("fp"), *more)
    found = durable(candidates(postings(rows, rules), rules).withColumnsRenamed({"doc_id": "hit_id", "fp": "hit_fp"}))
    found = broadcast_if_small(found, F.lit(128))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("fp") == F.col("hit_fp")), "left")
    none = F.expr(_NONE)
    every = []
    for order, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, order)
        if trigram_query(rule.pattern):
            spans = F.when(F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)), spans).otherwise(none)
        every.append(spans)
    return joined.select("doc_id", "text", F.array_sort(F.concat(*every)).alias("spans"), *(["kept"] if more else []))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind_order"] < BASE)

    def n_of(order: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind_order"] == order)).cast("long").alias(f"n_{rules[order].kind}")

    counted = [n_of(order) for order in range(BASE)]
    return found.select("doc_id", *counted, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redact(documents: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The documents, with all their columns, each secret in their texts replaced by ``mark``.

    Overlapping spans of several kinds are replaced as one.
    """
    # The other columns travel as one struct, so their names cannot clash with the scan's own.
    others = [c for c in documents.columns if c != "text"]
    found = scan(documents, rules, keep=F.struct(F.col("text").isNull().alias("was_null"), F.struct(*others).alias("row")))
    pieces = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda done, s: F.when(s["end"] <= done["at"], done)
        .when(s["start"] < done["at"], F.struct(s["end"].alias("at"), done["out"].alias("out")))
        .otherwise(F.struct(s["end"].alias("at"), F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"]), F.lit(mark)).alias("out"))),
        lambda done: F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.char_length("text"))),
    )
    text = F.when(F.col("kept.was_null"), F.lit(None).cast("string")).when(F.size("spans") == 0, F.col("text")).otherwise(pieces)
    return found.select(*(text.alias("text") if c == "text" else F.col(f"kept.row.`{c}`").alias(c) for c in documents.columns))
