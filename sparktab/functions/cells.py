"""Cell encodings and their inverses, identifiers, and small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that stand for whole cells, fixed values of the format.
NULL, EMPTY_STRING, EMPTY_ARRAY, HANDLE = "\\N", "\\E", "\\A", "\\@"
#: Digits of a cell id; ids end at 9999.
ID_WIDTH, MAX_IDS = 4, 10_000
#: Hex digits of a content name.
NAME_WIDTH = 24
#: Elements that are summed up at once.
RUN = 256


def escaped(text: Column) -> Column:
    """A string as a cell: empty has a mark, a leading backslash is doubled."""
    return F.when(text == "", F.lit(EMPTY_STRING)).when(text.startswith("\\"), F.concat(F.lit("\\"), text)).otherwise(text)


def unescaped(cell: Column) -> Column:
    return F.when(cell == EMPTY_STRING, F.lit("")).when(cell.startswith("\\\\"), F.substr(cell, F.lit(2))).otherwise(cell)


def deltas(numbers: Column) -> Column:
    """First value, then differences."""
    return F.transform(numbers, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(numbers, i - 1)))


def from_deltas(numbers: Column) -> Column:
    """Running sums, in blocks: an array that grows is copied for each element of a block and each block."""
    none = F.expr("cast(array() as array<bigint>)")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(numbers) - 1, F.lit(0)), F.lit(RUN)), lambda at: F.slice(numbers, at + 1, RUN))

    def run(start: Column, block: Column) -> Column:
        return F.aggregate(block, none, lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), start) + x)))

    summed = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("bigint").alias("so_far"), F.expr("cast(array() as array<array<bigint>>)").alias("out")),
        lambda s, b: F.struct((s["so_far"] + F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("so_far"), F.concat(s["out"], F.array(run(s["so_far"], b))).alias("out")),
        lambda s: F.flatten(s["out"]),
    )
    return F.when(F.size(numbers) == 0, none).when(numbers.isNotNull(), summed)


def never_falls(numbers: Column) -> Column:
    """Whether no element is smaller than the one before it."""
    return F.forall(F.transform(numbers, lambda x, i: F.when(i == 0, F.lit(True)).otherwise(x >= F.get(numbers, i - 1))), lambda x: x)


def content_name(text: Column) -> Column:
    """The name of a stored text: the first digits of its SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, NAME_WIDTH)


def cell_id(n: Column) -> Column:
    """A number as a cell id; null beyond the last one."""
    return F.when(n < MAX_IDS, F.lpad(n.cast("string"), ID_WIDTH, "0"))


def requested_id(text: Column) -> Column:
    r"""What a reader may write for a cell (``1``, ``0001``, ``\@0001[142t]``) as a cell id."""
    bare = F.trim(F.split_part(F.regexp_replace(F.trim(text), r"^[\\@]+", ""), F.lit("["), F.lit(1)))
    return F.when(bare.rlike("^[0-9]+$") & (F.length(bare) < ID_WIDTH), F.lpad(bare, ID_WIDTH, "0")).otherwise(bare)


def requested_document(text: Column) -> Column:
    """A document id without the quotes and blanks around it."""
    return F.trim(F.regexp_replace(F.trim(text), '^"+|"+$', ""))


def handle(identifier: Column, tokens: Column) -> Column:
    return F.concat(F.lit(HANDLE), identifier, F.lit("["), tokens.cast("string"), F.lit("t]"))


def after_marker_line(text: Column, marker: str) -> Column:
    """The first line that is not blank after a marker; null without marker or line."""
    rest = F.substr(text, F.instr(text, marker) + len(marker))
    line = F.get(F.filter(F.split(rest, "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    return F.when(F.contains(text, F.lit(marker)), F.trim(line))
