"""Facet filters: a flat sequence of clauses read as a disjunction of conjunctions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("eq", "in", "exists", "gt", "gte", "lt", "lte", "contains")

# Display names of paths and the stored path they mean.
PATH_ALIASES = {
    "durationMs": "duration_ms",
    "endedAt": "end_time",
    "parentSpanId": "parent_span_id",
    "spanId": "span_id",
    "startedAt": "start_time",
    "traceId": "trace_id",
}

_SEGMENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\[\])?$")


def facet_path(path: str) -> str:
    """The stored path: aliases resolved, dashes as dots, checked."""
    if path in PATH_ALIASES:
        return PATH_ALIASES[path]
    stored = path.strip().replace("-", ".")
    if not all(_SEGMENT.match(part) for part in stored.split(".")):
        raise ValueError(f"facets cannot name the path {stored!r}")
    return stored


def scope_of_path(path: str) -> str | None:
    """Up to the last array a path runs through, as a plain dotted path."""
    inside = re.match(r"(.+)\[\](?:\.|$)", path)
    return inside[1].replace("[]", "") if inside else None


@dataclass(frozen=True)
class Facet:
    """One clause. ``join="or"`` starts a new branch; ``scope`` names an array whose
    single elements must satisfy all clauses of the branch with that scope."""

    path: str
    op: str = "eq"
    value: str = ""
    values: tuple[str, ...] = ()
    negated: bool = False
    join: str = "and"
    scope: str = ""

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise ValueError(f"unsupported facet operator: {self.op}")
        if self.join not in ("and", "or"):
            raise ValueError(f"unsupported facet join: {self.join}")
        facet_path(self.path)
        if self.op in ("gt", "gte", "lt", "lte"):
            self.number()

    def stored_path(self) -> str:
        return facet_path(self.path)

    def array_scope(self) -> str | None:
        if self.scope.strip():
            return facet_path(self.scope)
        return scope_of_path(self.stored_path())

    def wanted(self) -> list[str]:
        if self.op == "in":
            return [v for v in self.values if v]
        return [self.value] if self.value else []

    def number(self) -> float:
        try:
            return float(self.value)
        except ValueError:
            raise ValueError(
                f"numeric facet operator requires a numeric value: {self.value}"
            ) from None


def branches(facets: Sequence[Facet]) -> list[list[Facet]]:
    """Split the clauses at each ``or``."""
    result: list[list[Facet]] = [[]]
    for facet in facets:
        if facet.join == "or" and result[-1]:
            result.append([])
        result[-1].append(facet)
    return [branch for branch in result if branch]


Getter = Callable[[str], Column]


def _exact(value: str, get: Getter) -> Column:
    """Index rows equal to the value as a string, number, boolean or null."""
    found = (get("value_type") == "string") & (get("string_value") == value)
    try:
        number = float(value)
    except ValueError:
        number = math.nan
    if math.isfinite(number):
        found = found | ((get("value_type") == "number") & (get("number_value") == number))
    flag = {"true": True, "1": True, "false": False, "0": False}.get(value.strip().lower())
    if flag is not None:
        found = found | ((get("value_type") == "bool") & (get("bool_value") == flag))
    if value.lower() == "null":
        found = found | (get("value_type") == "null")
    return found


def value_condition(facet: Facet, get: Getter = F.col) -> Column:
    """Condition on the value of an index row or of a leaf (``get`` reads its parts)."""
    if facet.op == "exists":
        return F.lit(True)
    if facet.op in ("eq", "in"):
        result = F.lit(False)
        for value in facet.wanted():
            result = result | _exact(value, get)
        return result
    number = get("number_value")
    limit = facet.number()
    compared = {
        "gt": number > limit,
        "gte": number >= limit,
        "lt": number < limit,
        "lte": number <= limit,
    }[facet.op]
    return (get("value_type") == "number") & compared


def leaf_condition(facet: Facet, get: Getter = F.col, scoped: bool = True) -> Column:
    """Path, value and (if the path runs through an array) scope of one clause."""
    result = (get("path") == facet.stored_path()) & value_condition(facet, get)
    scope = facet.array_scope()
    if scoped and scope is not None:
        result = result & (get("scope_path") == scope)
    return result
