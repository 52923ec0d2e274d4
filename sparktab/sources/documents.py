"""Rendered documents, read back: text to table shape to JSON value."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import EMPTY_ARRAY, EMPTY_STRING, HANDLE, NULL
from .payloads import canonical

#: Lines of the format, fixed values; in this order before the header.
MARKER = "#sparktab/v1"
PREAMBLE = {"legend": "#legend ", "path": "#path", "keyed": "#keyed ", "wrap": "#wrap", "const": "#const", "dict": "#dict", "store": "#store"}
HEADER_EVERY = 40


class Unreadable(ValueError):
    """A text that is no document, or one that cannot be rebuilt."""


def header_columns(line: str) -> tuple[int, list[tuple[str, str, bool]]]:
    """``[30]{a:int,b:str?}`` as the row count and (name, type, nullable) of each column."""
    if not line.startswith("[") or "]{" not in line or not line.endswith("}"):
        raise Unreadable(f"no header: {line[:80]!r}")
    count, inner = line[1:-1].split("]{", 1)
    columns = []
    for part in inner.split(",") if inner else []:
        name, _, kind = part.rpartition(":")
        columns.append((name, kind.removesuffix("?"), kind.endswith("?")))
    return int(count), columns


def csv_records(text: str, skipped: str) -> Iterator[list[str]]:
    """Records of a CSV body.  A line equal to ``skipped`` is passed over where the writer repeats
    the header, and only there, so a cell that looks like it is safe."""
    at, n = 0, 0
    while at < len(text):
        if n and n % HEADER_EVERY == 0 and text.startswith(skipped + "\n", at):
            at += len(skipped) + 1
        fields, done = [], False
        while not done:
            if text.startswith('"', at):
                end, part = at + 1, []
                while True:
                    close = text.find('"', end)
                    if close < 0:
                        raise Unreadable("a quoted cell does not end")
                    part.append(text[end:close])
                    if not text.startswith('""', close):
                        break
                    part.append('"')
                    end = close + 2
                fields.append("".join(part))
                at = close + 1
            else:
                stops = [x for x in (text.find(",", at), text.find("\n", at)) if x >= 0]
                stop = min(stops, default=len(text))
                fields.append(text[at:stop])
                at = stop
            done = not text.startswith(",", at)
            at += 1
        yield fields
        n += 1


_ABSENT = object()


def cell_value(text: str, kind: str, entries: Mapping[str, Any] | None, stored: Mapping[str, str] | None) -> Any:
    """The value of a cell, by the declared type of its column and never by its looks."""
    if text == "":
        return _ABSENT
    if text.startswith(HANDLE):
        digits = text[len(HANDLE) :].split("[")[0]
        if not digits.isdigit():
            raise Unreadable(f"a handle without id: {text!r}")
        if stored is None or digits not in stored:
            raise Unreadable(f"{digits} is stored elsewhere; a store that holds it is needed")
        return cell_value(stored[digits], kind, entries, None)
    if text in (NULL, EMPTY_STRING, EMPTY_ARRAY):
        return {NULL: None, EMPTY_STRING: "", EMPTY_ARRAY: []}[text]
    match kind:
        case "dict":
            return (entries or {})[text]
        case "str":
            return text[1:] if text.startswith("\\\\") else text
        case "strs":
            return text.split(" ")
        case "ints":
            return [int(x) for x in text.split(" ")]
        case "dints":
            out: list[int] = []
            for x in text.split(" "):
                out.append(int(x) + (out[-1] if out else 0))
            return out
        case _:
            return json.loads(text)


def parsed(text: str) -> dict[str, Any]:
    """The table shape of a document."""
    lines = text.split("\n")
    if lines[0] != MARKER:
        raise Unreadable(f"not a {MARKER} document")
    shape: dict[str, Any] = {"path": [], "keyed": None, "wrap": {}, "const": {}, "dict": {}, "store": None}
    at = 1
    for name, prefix in PREAMBLE.items():
        if at < len(lines) and lines[at].startswith(prefix):
            if name != "legend":
                shape[name] = json.loads(lines[at][len(prefix) :])
            at += 1
    if at >= len(lines):
        raise Unreadable("no header")
    shape["count"], shape["columns"] = header_columns(lines[at])
    shape["records"] = [[] for _ in range(shape["count"])] if not shape["columns"] else list(csv_records("\n".join(lines[at + 1 :]), lines[at]))
    return shape


def nested(row: dict[str, Any]) -> dict[str, Any]:
    """Dotted names as nested objects again."""
    out: dict[str, Any] = {}
    inner: dict[str, dict] = {}
    for key, value in row.items():
        head, dot, rest = key.partition(".")
        if dot:
            inner.setdefault(head, {})[rest] = value
        else:
            out[key] = value
    if clash := out.keys() & inner.keys():
        raise Unreadable(f"{sorted(clash)[0]!r} is both a value and a parent")
    return out | {k: nested(v) for k, v in inner.items()}


def restored(text: str, stored: Mapping[str, str] | None = None) -> Any:
    """The JSON value that a document stands for."""
    if not text.startswith(MARKER + "\n"):
        return json.loads(text)
    shape = parsed(text)
    if shape["store"] is not None and stored is None:
        raise Unreadable(f"the document needs the store index {shape['store']}")
    if len(shape["records"]) != shape["count"]:
        raise Unreadable(f"{len(shape['records'])} rows where the header says {shape['count']}")
    rows = []
    for fields in shape["records"]:
        if len(fields) != len(shape["columns"]):
            raise Unreadable("a row with another number of cells than the header")
        values = ((name, cell_value(x, kind, shape["dict"].get(name), stored)) for x, (name, kind, _) in zip(fields, shape["columns"]))
        rows.append(nested({name: v for name, v in values if v is not _ABSENT} | shape["const"]))
    held: Any = rows
    if shape["keyed"] is not None:
        held = {row.pop(shape["keyed"]): row for row in rows}
    for depth in range(len(shape["path"]) - 1, -1, -1):
        around = shape["wrap"]
        for key in shape["path"][:depth]:
            around = around[key]
        held = {**around, shape["path"][depth]: held}
    return held


def restore(documents: DataFrame) -> DataFrame:
    """(doc_id, canon, error) of documents (doc_id, document, stored map or null): canonical JSON text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], []
            for text, stored in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    values.append(None if text is None else canonical(restored(text, None if stored is None else dict(stored))))
                    errors.append(None)
                except (ValueError, KeyError, IndexError, RecursionError, TypeError) as e:
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:300])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string()), pa.array(errors, pa.string())], ["doc_id", "canon", "error"])

    rows = documents.select("doc_id", "document", F.col("stored").cast("map<string,string>").alias("stored"))
    return rows.mapInArrow(run, "doc_id string, canon string, error string")


def used_cells(documents: DataFrame) -> DataFrame:
    """(doc_id, cell_id) of the handles in documents (document), each once, doc_id being the document's own in the
    store.  Texts that are no documents, or cannot be read, use none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, cells = [], []
            for text in batch.column(0).to_pylist():
                try:
                    shape = parsed(text or "")
                except (ValueError, RecursionError):
                    continue
                if shape["store"] is None:
                    continue
                found = {x[len(HANDLE) :].split("[")[0] for fields in shape["records"] for x in fields if x.startswith(HANDLE)}
                cells += sorted(found)
                docs += [shape["store"]] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(cells, pa.string())], ["doc_id", "cell_id"])

    return documents.select("document").mapInArrow(run, "doc_id string, cell_id string").distinct()
