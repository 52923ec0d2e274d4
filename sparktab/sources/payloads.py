"""Payloads: read, decoded, checked, and taken apart into cells.

The JSON edge is the one place where a payload is handled as a whole, in Arrow batches of a Python
worker; what leaves it is relational.  ``extract`` gives one row for each payload with the parts that the
later stages need; ``nodes`` gives one row for each value in the payload.

States: ``empty``, ``not_utf8``, ``plain_text`` (no JSON), ``too_deep``, ``json`` (no record array) and
``records``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Depths and sizes of the search, and keys held for boilerplate: fixed values of the format.
SEARCH_DEPTH, FLATTEN_DEPTH, LEAST_ROWS, LEAST_IN_MAP = 4, 2, 2, 2
NOISE_KEYS = ("node_id", "gravatar_id")

COMPACT = (",", ":")
#: Payload text that a worker takes apart at once, in bytes.
SLICE_BYTES = 1 << 20


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Files as payloads: (doc_id, raw), exact bytes."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.col("content").alias("raw"))


def from_column(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A string column as payloads."""
    return df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))


def from_rows(df: DataFrame, id_col: str, order_col: str, columns: list[str]) -> DataFrame:
    """Groups of rows as payloads: one JSON list of records for each value of ``id_col``."""
    record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    listed = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("at"), record.alias("record"))))
    text = F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["record"]), ","), F.lit("]"))
    return df.groupBy(F.col(id_col).cast("string").alias("doc_id")).agg(text.cast("binary").alias("raw"))


def decoded(payloads: DataFrame) -> DataFrame:
    """(doc_id, raw, text, state): text is null unless the bytes are UTF-8."""
    text = F.try_validate_utf8(F.col("raw").cast("string"))
    state = F.when(F.octet_length("raw") == 0, "empty").when(text.isNull(), "not_utf8").otherwise("text")
    return payloads.select("doc_id", "raw", text.alias("text"), state.alias("state"))


def kind_of(value: Any) -> str:
    """null, bool, int, float, str, list or dict; a bool is no int."""
    if value is None:
        return "null"
    return type(value).__name__


def compact(value: Any) -> str:
    return json.dumps(value, separators=COMPACT)


def canonical(value: Any) -> str:
    """Text that is equal exactly for equal JSON values: 1, 1.0 and true differ, key order does not."""
    return json.dumps(value, separators=COMPACT, sort_keys=True)


@dataclass
class Boilerplate:
    """Which keys of one payload go: links, link templates and node ids."""

    bare_url: bool = False
    dropped: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, value: Any) -> Boilerplate:
        return cls(any(key.endswith("_url") for key in every_key(value)))

    def goes(self, key: str) -> bool:
        return key.endswith("_url") or key in NOISE_KEYS or (key == "url" and self.bare_url)

    def stripped(self, value: Any) -> Any:
        if isinstance(value, list):
            return [self.stripped(x) for x in value]
        if not isinstance(value, dict):
            return value
        self.dropped.update(filter(self.goes, value))
        return {k: self.stripped(v) for k, v in value.items() if not self.goes(k)}


def every_key(value: Any) -> Iterator[str]:
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            yield from x
            todo += x.values()
        elif isinstance(x, list):
            todo += x


@dataclass
class Records:
    """A candidate for the table: rows, where they are, and the column that holds their keys."""

    path: tuple[str, ...]
    rows: list[dict]
    key_column: str | None = None

    @property
    def rank(self) -> tuple:
        return -sum(map(len, self.rows)), len(self.path), self.path


def candidates(value: Any, path: tuple[str, ...] = ()) -> Iterator[Records]:
    """Record lists and record maps, through keys of objects, to the search depth."""
    if isinstance(value, list):
        if value and all(isinstance(x, dict) for x in value):
            yield Records(path, value)
        return
    if not isinstance(value, dict):
        return
    inner = list(value.values())
    if len(inner) >= LEAST_IN_MAP and all(isinstance(x, dict) and x for x in inner) and len({frozenset(x) for x in inner}) == 1:
        name = free_name(inner)
        yield Records(path, [{name: k, **x} for k, x in value.items()], name)
    if len(path) < SEARCH_DEPTH:
        for k, x in value.items():
            yield from candidates(x, (*path, k))


def free_name(records: list[dict], wanted: str = "_key") -> str:
    taken = set().union(*records)
    tries = (wanted if n == 1 else f"{wanted}{n}" for n in range(1, len(taken) + 2))
    return next(x for x in tries if x not in taken)


def best_records(value: Any) -> Records | None:
    """The candidate with the most cells; then the shallowest, then the first by name."""
    found = [c for c in candidates(value) if len(c.rows) >= LEAST_ROWS]
    return min(found, key=lambda c: c.rank) if found else None


def without(value: Any, path: tuple[str, ...]) -> Any:
    """The payload without what is at the path; siblings on the way stay."""
    if not path:
        return {}
    rest = {k: v for k, v in value.items() if k != path[0]}
    return rest if len(path) == 1 else {**rest, path[0]: without(value[path[0]], path[1:])}


def flat(row: dict, depth: int = FLATTEN_DEPTH) -> dict:
    """Nested objects as dotted names, to the flatten depth; names that hold a dot stay closed."""
    out = {}
    for key, value in row.items():
        if depth and isinstance(value, dict) and value and "." not in key and not any("." in k for k in value):
            out |= {f"{key}.{k}": v for k, v in flat(value, depth - 1).items()}
        else:
            out[key] = value
    return out


def list_shape(value: list) -> str:
    """empty, rising (integers that never fall), ints, strs (words without blanks), or other."""
    if not value:
        return "empty"
    if all(type(x) is int for x in value):
        return "rising" if all(a <= b for a, b in zip(value, value[1:])) else "ints"
    if all(isinstance(x, str) and x and x[0] != "\\" and not any(map(str.isspace, x)) for x in value):
        return "strs"
    return "other"


def cell(row: int, col: str, value: Any) -> dict:
    """A value as the relational stages take it.

    text: how it is written bare (strings as they are, scalars and lists of scalars space-joined);
    steps: a list of integers as its first value and differences.
    """
    kind = kind_of(value)
    shape = list_shape(value) if kind == "list" else None
    text = steps = None
    if kind == "str":
        text = value
    elif kind in ("bool", "int", "float"):
        text = compact(value)
    elif shape in ("rising", "ints", "strs"):
        text = " ".join(map(str, value))
        if shape != "strs":
            steps = " ".join(map(str, [value[0], *(b - a for a, b in zip(value, value[1:]))]))
    return {"row": row, "col": col, "kind": kind, "json": compact(value), "canon": canonical(value), "text": text, "shape": shape, "steps": steps}


CELL = "row int, col string, kind string, json string, canon string, text string, shape string, steps string"
EXTRACT = f"doc_id string, state string, compact string, canon string, dropped array<string>, path array<string>, key_column string, wrapper string, n_rows int, cells array<struct<{', '.join(x.replace(' ', ': ', 1) for x in CELL.split(', '))}>>"


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def taken_apart(doc_id: str, text: str | None) -> dict:
    """What ``extract`` returns for one payload."""
    out = dict.fromkeys(("compact", "canon", "dropped", "path", "key_column", "wrapper", "n_rows", "cells"))
    out |= {"doc_id": doc_id, "state": "plain_text"}
    if text is None:
        return out
    try:
        value = json.loads(text)
    except RecursionError:
        return out | {"state": "too_deep"}
    except ValueError:
        return out
    try:
        plate = Boilerplate.of(value)
        value = plate.stripped(value)
        out |= {"state": "json", "compact": compact(value), "canon": canonical(value), "dropped": sorted(plate.dropped)}
        found = best_records(value)
        if found is not None:
            cells = [cell(i, k, v) for i, row in enumerate(found.rows) for k, v in flat(row).items()]
            out |= {"state": "records", "path": list(found.path), "key_column": found.key_column, "wrapper": compact(without(value, found.path)), "n_rows": len(found.rows), "cells": cells}
    except RecursionError:
        out |= {"state": "too_deep"}
    return out


def extract(payloads: DataFrame) -> DataFrame:
    """One row for each payload, in the columns of ``EXTRACT``."""
    schema = _arrow(EXTRACT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            held = [taken_apart(doc_id, text) | ({} if state == "text" else {"state": state}) for doc_id, text, state in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return decoded(payloads).select("doc_id", "text", "state").mapInArrow(run, EXTRACT)


def in_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of a text column; a longer one is a batch of its own."""
    for batch in batches:
        start = held = 0
        for i, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if held and held + (size or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)


NODE = "doc_id string, path array<string>, place array<int>, key string, kind string, json string, n_children int, keyset string"


def nodes(payloads: DataFrame) -> DataFrame:
    """Every value of every payload: its path (list elements as ``*``) and place among its siblings,
    its kind, its compact JSON (scalars only), its number of children and sorted keys."""
    schema = _arrow(NODE)

    def walk(doc_id: str, value: Any) -> Iterator[dict]:
        todo = [((), (), None, value)]
        while todo:
            path, place, key, x = todo.pop()
            kind = kind_of(x)
            inner = list(x.items()) if kind == "dict" else [("*", y) for y in x] if kind == "list" else []
            yield {
                "doc_id": doc_id, "path": list(path), "place": list(place), "key": key, "kind": kind,
                "json": None if kind in ("dict", "list") else compact(x), "n_children": len(inner), "keyset": ",".join(sorted(x)) if kind == "dict" else None,
            }
            todo += [((*path, k), (*place, i), k, y) for i, (k, y) in reversed(list(enumerate(inner)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            for doc_id, text, _ in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    value = json.loads(text) if text is not None else None
                except (ValueError, RecursionError):
                    continue
                if text is None:
                    continue
                held = []
                for one in walk(doc_id, value):
                    held.append(one)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return decoded(payloads).select("doc_id", "text", "state").mapInArrow(run, NODE)


def leaves(payloads: DataFrame) -> DataFrame:
    """(doc_id, leaves): the JSON of every scalar of each payload, depth first."""
    found = nodes(payloads).filter(~F.col("kind").isin("dict", "list"))
    listed = F.array_sort(F.collect_list(F.struct("place", "json")))
    return found.groupBy("doc_id").agg(F.transform(listed, lambda x: x["json"]).alias("leaves"))
