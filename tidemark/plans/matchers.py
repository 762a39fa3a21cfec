"""Predicates over payload paths compiled to boolean columns.

Two dialects share the path layer: definition matchers (conjunction of
``exists``, ``eq``, ``neq``, ``is_number``, ``in``) and alert conditions
(``all``/``any`` with more operators).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.events import is_error
from tidemark.functions.paths import Fields, check_path, number_from_text
from tidemark.plans.exprs import scalar_text
from tidemark.plans.shapes import lit

DEFINITION_OPS = ("exists", "eq", "neq", "is_number", "in")
ALERT_OPS = (
    "exists", "not_exists", "eq", "ne", "neq", "contains", "gt", "gte", "lt", "lte",
    "regex", "is_number", "is_error",
)

# Event attributes alert paths may name besides payload paths.
ENVELOPE_PATHS = (
    "tenant_id", "event_id", "timestamp", "observed_timestamp", "ingested_timestamp",
    "source_file", "event_type", "signal", "trace_id", "span_id",
)


def _all(conditions: list[Column]) -> Column:
    result = F.lit(True)
    for condition in conditions:
        result = result & condition
    return result


def _any(conditions: list[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def _equals(fields: Fields, path: str, expected: Any) -> Column:
    """Equal as JSON, or equal string forms. Null, objects and arrays have the
    empty string form, so they equal each other and the empty string."""
    if isinstance(expected, str) and expected == "":
        expected = None
    if expected is None or isinstance(expected, (dict, list)):
        return F.coalesce(fields.variant(path).isNotNull(), F.lit(False)) & (
            fields.string(path) == ""
        )
    return fields.string(path) == lit(scalar_text(expected))


def predicate(fields: Fields, spec: dict[str, Any]) -> Column:
    """One definition predicate; never NULL."""
    path = check_path(spec["path"])
    op = spec.get("op", "eq")
    if op == "exists":
        return fields.present(path)
    if op == "is_number":
        return fields.number(path).isNotNull()
    if op not in DEFINITION_OPS:
        raise ValueError(f"matchers have no operator {op!r}")
    if op == "in":
        values = spec.get("value")
        if not isinstance(values, list):
            return F.lit(False)
        plain = [scalar_text(v) for v in values if scalar_text(v) != ""]
        choices = [fields.string(path).isin(*plain)] if plain else []
        if any(scalar_text(v) == "" for v in values):
            choices.append(_equals(fields, path, None))
        return _any(choices)
    if "value" not in spec:
        return F.lit(False)
    equal = _equals(fields, path, spec["value"])
    if op == "eq":
        return equal
    known = (fields.string(path) != "") | F.coalesce(fields.variant(path).isNotNull(), F.lit(False))
    return known & ~equal


def matcher(fields: Fields, match: Any) -> Column:
    """``{"all": [...]}`` as one boolean column; no predicates match everything."""
    specs = match.get("all") if isinstance(match, dict) else None
    return _all([predicate(fields, spec) for spec in specs or []])


class AlertFields:
    """Paths as alert rules read them: nested traversal, envelope attributes first."""

    def __init__(self, df: DataFrame):
        self.columns = set(df.columns)
        self.fields = Fields(df, flat=False, nested_only=True)

    def text(self, path: str) -> Column:
        """String form of the value (JSON text for objects and arrays), NULL if absent."""
        path = path.strip()
        if path == "data":
            return F.col("data")
        if path.startswith("data."):
            return self.fields.raw(path.removeprefix("data."))
        if path in ENVELOPE_PATHS and path in self.columns:
            column = F.col(path)
            if path.endswith("timestamp"):
                column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
            return column
        return self.fields.raw(path)


def _number_of(value: Any) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def alert_condition(df: DataFrame, fields: AlertFields, spec: dict[str, Any]) -> Column:
    """One alert condition; never NULL."""
    op = spec.get("op", "eq")
    if op == "is_error":
        return is_error(df, "alert")
    if op not in ALERT_OPS:
        raise ValueError(f"alerts have no operator {op!r}")
    text = fields.text(spec["path"])
    value = spec.get("value")
    if op == "exists":
        return text.isNotNull()
    if op == "not_exists":
        return text.isNull()
    if op in ("eq", "ne", "neq"):
        expected = lit(scalar_text(value))
        equal = F.coalesce(text == expected, F.lit(False)) if value is not None else text.isNull()
        return equal if op == "eq" else ~equal
    if op == "contains":
        return F.coalesce(F.contains(text, F.lit(scalar_text(value))), F.lit(False))
    if op == "regex":
        return F.coalesce(text.rlike(str(spec.get("value") or "")), F.lit(False))
    number = number_from_text(text)
    if op == "is_number":
        return number.isNotNull()
    limit = _number_of(value)
    if limit is None:
        return F.lit(False)
    compared = {
        "gt": number > limit,
        "gte": number >= limit,
        "lt": number < limit,
        "lte": number <= limit,
    }[op]
    return F.coalesce(compared, F.lit(False))


def alert_matcher(df: DataFrame, match: dict[str, Any] | None) -> Column:
    """``all`` must hold, and one of ``any`` if there are any."""
    match = match or {}
    fields = AlertFields(df)
    result = _all([alert_condition(df, fields, c) for c in match.get("all") or []])
    if match.get("any"):
        result = result & _any([alert_condition(df, fields, c) for c in match["any"]])
    return result
