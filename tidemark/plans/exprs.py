"""Output expressions of definitions compiled to columns.

A string is a literal, a number or boolean printed, or ``{"path", "default"}``;
a number is a literal, numeric text or ``{"path"}``.
"""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.paths import Fields, check_path
from tidemark.plans.shapes import lit


def path_of(spec: Any) -> str | None:
    """The path of a ``{"path": ...}`` spec, or None."""
    if isinstance(spec, dict):
        path = spec.get("path")
        if isinstance(path, str) and path.strip():
            return check_path(path)
    return None


def scalar_text(value: Any) -> str:
    """A scalar as printed in JSON; empty for null, lists and objects."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        return json.dumps(value)
    return ""


def string_expr(fields: Fields, spec: Any, fallback: str | None = None) -> Column | None:
    """A string column, the fallback literal when the spec is absent, or None."""
    if isinstance(spec, dict):
        path = path_of(spec)
        if path is None:
            return None if fallback is None else lit(fallback)
        return fields.string(path, scalar_text(spec.get("default")))
    if isinstance(spec, (str, int, float, bool)):
        return lit(scalar_text(spec))
    return None if fallback is None else lit(fallback)


def number_expr(fields: Fields, spec: Any) -> Column | None:
    path = path_of(spec)
    if path is not None:
        return fields.number(path)
    if isinstance(spec, bool) or isinstance(spec, dict) or spec is None:
        return None
    try:
        value = float(spec)
    except (TypeError, ValueError):
        return None
    return F.lit(value) if math.isfinite(value) else None


def named_values(fields: Fields, specs: Any) -> list[tuple[str, Column]]:
    """Dimensions ``[{"name", "value"}]`` as (name, string column); bad entries are skipped."""
    pairs = []
    for spec in specs if isinstance(specs, list) else []:
        if not isinstance(spec, dict) or not isinstance(spec.get("name"), str):
            continue
        name = spec["name"].strip()
        value = string_expr(fields, spec.get("value"))
        if name and value is not None:
            pairs.append((name, value))
    return pairs


PAIR = "array<struct<name:string,value:string>>"


def dimension_pairs(pairs: list[tuple[str, Column]]) -> Column:
    """Non-empty dimensions as an array of (name, value) structs, in declared order."""
    if not pairs:
        return F.array().cast(PAIR)
    items = [F.struct(F.lit(name).alias("name"), value.alias("value")) for name, value in pairs]
    return F.filter(F.array(*items), lambda item: item["value"] != "").cast(PAIR)


def dimension_map(pairs: list[tuple[str, Column]]) -> Column:
    """Non-empty dimensions as MAP<STRING,STRING> with keys in order; later wins."""
    unique = dict(pairs)
    ordered = [(name, unique[name]) for name in sorted(unique)]
    return F.map_from_entries(dimension_pairs(ordered))


def paths_in(config: Any) -> set[str]:
    """All payload paths a config refers to, at any depth."""
    found: set[str] = set()
    if isinstance(config, dict):
        for key, value in config.items():
            if key in ("path", "entity_id_path", "dimension") and isinstance(value, str):
                if value.strip():
                    found.add(check_path(value))
            else:
                found |= paths_in(value)
    elif isinstance(config, list):
        for item in config:
            found |= paths_in(item)
    return found
