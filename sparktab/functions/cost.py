"""The token model that every choice is priced with, and what follows from it.

The default model counts pieces of a fixed pattern, as one Catalyst expression; an exact
tokeniser can be put in its place as any function from a string column to an integer column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, up to three digits, one other visible character, or white space: one token each.
PIECE = r"[A-Za-z]+|[0-9]{1,3}|[^A-Za-z0-9\s]|\s+"

TokenModel = Callable[[Column], Column]


def proxy(text: Column) -> Column:
    """Tokens of a text under the default model; null has none.

    The pieces leave nothing of a text out, so they are counted by writing one character for each.
    """
    return F.coalesce(F.char_length(F.regexp_replace(text, PIECE, "x")), F.lit(0)).cast("long")


#: Punctuation is a token of its own, so a list of parts costs what the parts and the marks between them cost.
proxy.additive = True


def tiktoken_model(path: str, pattern: str) -> TokenModel:
    """An exact model from a rank file, as a pandas UDF; the file is read on the driver."""
    with open(path, "rb") as f:
        content = f.read()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        own = _encoding(content, pattern)
        return texts.map(lambda t: len(own.encode_ordinary(t)) if t else 0).astype("int64")

    return count


@lru_cache(4)
def _encoding(content: bytes, pattern: str):
    """The encoder of a rank file, made once for a process."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def csv_quoted(text: Column) -> Column:
    """A CSV field under minimal quoting."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\\n\\r]'), quoted).otherwise(text)


def csv_cost(text: Column, tokens: TokenModel = proxy) -> Column:
    """Tokens of a value as a CSV field."""
    if getattr(tokens, "additive", False):
        # Each quote is a token: two around the text, and one more for each within it.
        quotes = F.char_length(text) - F.char_length(F.replace(text, F.lit('"')))
        return tokens(text) + F.when(text.rlike('[,"\n\r]'), 2 + quotes).otherwise(0)
    return tokens(csv_quoted(text))


def saving_percent(before: Column, after: Column) -> Column:
    """Percent saved, never below zero, to one place."""
    return F.when(before > 0, F.round(F.greatest(F.lit(0.0), 100.0 * (before - after) / before), 1)).otherwise(F.lit(0.0))
