"""License scans by canonical digest, in DataFrame and SQL functions alone.

A text is put into canonical form (case, copyright notices, equivalent spellings, punctuation, white
space), digested, and hash-joined with the digests of known licences.  A match means that the whole text is
the licence, however it is set; a licence within a longer text is no match.

A copyright notice is the word or sign with a year, a placeholder of one or another sign, up to the end of
its line or to where the licence itself begins, so a licence set on one line keeps its text.  A notice of more
than ``NOTICE`` characters stays, and its text does not match.

The known licences are those of ``license_texts`` (texts, and digests of long ones), or texts that the caller gives as
a mapping or a table.  The first two are few and broadcast; a table is joined as Spark sees fit.  Texts of one canonical form
under several names match the first name.  Null text has a null
digest and no match; a text without any letter or digit has the digest of the empty form and no match.  Every
input row gives one output row, null and repeated ids included, none for an empty table; the work for a very long text grows
with its length; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import DIGESTS, LICENSES

#: The longest notice after its year or sign, in characters.
NOTICE = 200
_YEAR = r"(?:[0-9][0-9][0-9][0-9]|<year>|\[year\]|\{year\}|yyyy|\[yyyy\])"
#: A copyright notice: its beginning, its holder (as few characters as will do), and what ends it.
COPYRIGHT = (
    rf"(?:copyright[ \t]*(?:\(c\)|©)|(?:copyright|\(c\)|©)[ \t,:]*{_YEAR}|(?:\(c\)|©)[ \t]*copyright)[^\n]{{0,{NOTICE}}}?"
    r"(\n|$|all rights reserved|permission is |permission to |redistribution and |licensed under |this software is |this program |everyone is permitted |copyright[ \t]*\(c\)|copyright[ \t]*©)"
)

#: Spellings held for equal, fixed values: (pattern, canonical word).
SPELLINGS = (
    ("licence", "license"), ("sub-licens", "sublicens"), ("sub licens", "sublicens"), ("non-commercial", "noncommercial"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("fulfil ", "fulfill "), ("merchantibility", "merchantability"), ("organisation", "organization"), ("organise", "organize"),
    ("copyright owner", "copyright holder"), ("initialise", "initialize"), ("per cent", "percent"), ("whilst", "while"), ("all rights reserved", " "),
)


def canonical(text: Column) -> Column:
    """The canonical form: lower-case words of ASCII letters and digits, one space apart."""
    x = F.lower(text)
    # The pattern is tried only where its words occur; twice, since one notice may end where the next begins.
    noticed = x.rlike(r"copyright|\(c\)|©")
    for _ in range(2):
        x = F.when(noticed, F.regexp_replace(x, COPYRIGHT, "\n$1")).otherwise(x)
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark, licenses: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """(digest, license_id) of the known licences, one row for each digest."""
    given = LICENSES if licenses is None else licenses
    texts = given if isinstance(given, DataFrame) else spark.createDataFrame(sorted(given.items()), "license_id string, text string")
    rows = texts.select(digest(F.col("text").cast("string")).alias("digest"), F.col("license_id").cast("string").alias("license_id"))
    if licenses is None:
        rows = rows.unionByName(spark.createDataFrame(sorted((d, name) for name, d in DIGESTS.items()), "digest string, license_id string"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return rows.filter((F.col("digest") != empty) & F.col("license_id").isNotNull()).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", licenses: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license_id) for every row; licenses: the known texts by name, or a table (license_id, text)."""
    rows = documents.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col).cast("string")).alias("digest"))
    own = known(documents.sparkSession, licenses)
    return rows.join(own if isinstance(licenses, DataFrame) else F.broadcast(own), "digest", "left").select("doc_id", "digest", "license_id")
