"""Counting the paths of JSON payloads, in one walk per payload.

Higher-order functions would build every level of a deep payload anew and describe each
object with all that lies below it; a decoded payload is walked once. Spark's own parser
decides which payloads are valid, so only those are decoded here.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Different (path, kind) that a task holds before it passes their counts on.
HELD = 100_000

# Only the kind of a number counts.
_DECODER = json.JSONDecoder(parse_int=float)
_KINDS = {
    dict: "object", list: "array", str: "string", float: "number", bool: "boolean", type(None): "null",
}


def _text(key: str) -> str:
    """A key as Spark stores it: halves of surrogate pairs become question marks."""
    return key.encode("utf-8", "replace").decode()


def _order(member: tuple[str, object]) -> bytes:
    return member[0].encode("utf-16-be", "surrogatepass")


def nodes(payload: str) -> Iterable[tuple[str, str]]:
    """(path, kind) of the members of an object, by level; arrays are not entered.

    A path that occurs twice keeps its first kind, of keys in sorted order.
    """
    start = len(payload) - len(payload.lstrip(" \t\r\n"))
    if payload[start : start + 1] != "{":
        return []
    root = _DECODER.raw_decode(payload, start)[0]
    found, level, plain = [], [("", root)], "\\u" not in payload
    for path, members in level:
        prefix = f"{path}." if path else ""
        for key, value in members.items():
            below = prefix + (key if plain else _text(key))
            found.append((below, _KINDS[type(value)]))
            if type(value) is dict:
                level.append((below, value))
    if len({path for path, _ in found}) == len(found):
        return found
    first: dict[str, str] = {}
    level = [("", root)]
    for path, members in level:
        prefix = f"{path}." if path else ""
        for key, value in sorted(members.items(), key=_order):
            below = prefix + _text(key)
            first.setdefault(below, _KINDS[type(value)])
            if type(value) is dict:
                level.append((below, value))
    return first.items()


def count_nodes(events: DataFrame, payload: str = "data") -> DataFrame:
    """(path, kind, n): payloads that have the path with the kind, added up per task."""

    def rows(counts: Counter) -> pa.RecordBatch:
        columns = [pa.array([p for p, _ in counts], pa.string()), pa.array([k for _, k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["path", "kind", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(nodes(text.as_py().decode("utf-8", "replace")))
                if len(counts) > HELD:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)

    valid = events.where(F.try_parse_json(F.col(payload)).isNotNull())
    return valid.select(F.col(payload).cast("binary").alias("payload")).mapInArrow(run, "path string, kind string, n long")
