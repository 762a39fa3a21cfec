"""What an output of a definition must hold, by kind and mode: a table and its reader."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from typing import Any

from tidemark.functions.paths import check_path

Problems = Iterable[str]
Check = Callable[[Any], Problems]

# Bounds of a cube output.
MOST_SETS, MOST_DIMENSIONS = 8, 6
REPORT_OPS = ("count", "error_count", "count_errors", "sum")


def _path(value: Any) -> Problems:
    try:
        check_path(value)
    except (ValueError, AttributeError):
        yield "needs a payload path"


def text(value: Any) -> Problems:
    """A literal that is not blank, or a path."""
    if isinstance(value, dict):
        yield from _path(value.get("path"))
    elif not (isinstance(value, (int, float, bool)) or (isinstance(value, str) and value.strip())):
        yield "needs a literal or a path"


def number(value: Any) -> Problems:
    if isinstance(value, dict):
        yield from _path(value.get("path"))
        return
    try:
        finite = not isinstance(value, bool) and math.isfinite(float(value))
    except (TypeError, ValueError):
        finite = False
    if not finite:
        yield "needs a number or a path"


def anything(value: Any) -> Problems:
    if value is None:
        yield "is missing"
    elif isinstance(value, dict):
        yield from _path(value.get("path"))


def name(value: Any) -> Problems:
    if not isinstance(value, str) or not value.strip():
        yield "needs a name"


def one_of(*choices: str) -> Check:
    def check(value: Any) -> Problems:
        if value not in choices:
            yield f"is none of {', '.join(choices)}"

    return check


def listed(fields: dict[str, Check], unique: str = "", least: int = 0, most: int | None = None) -> Check:
    """A list of objects with these fields, told apart by the one called ``unique``."""

    def check(value: Any) -> Problems:
        if not isinstance(value, list) or not all(isinstance(item, dict) for item in value):
            yield "needs a list of objects"
            return
        if len(value) < least or (most is not None and len(value) > most):
            yield f"needs {least} to {most if most is not None else 'any number of'} entries"
        for place, item in enumerate(value):
            for key, inner in fields.items():
                yield from (f"[{place}].{key} {problem}" for problem in inner(item.get(key)))
        names = [str(item.get(unique)).strip() for item in value] if unique else []
        if len(set(names)) < len(names):
            yield f"has two entries of one {unique}"

    return check


def _match(value: Any) -> Problems:
    if value is not None and not isinstance(value, dict):
        yield "needs an object"
    for spec in (value or {}).get("all") or [] if isinstance(value, dict) else []:
        yield from _path(spec.get("path") if isinstance(spec, dict) else None)


def _metrics(value: Any) -> Problems:
    yield from listed({"name": name})(value)
    for place, item in enumerate(value if isinstance(value, list) else []):
        if isinstance(item, dict):
            op = item.get("op", "count")
            yield from (f"[{place}].op {problem}" for problem in one_of(*REPORT_OPS)(op))
            if op == "sum":
                yield from (f"[{place}].value {problem}" for problem in number(item.get("value")))


DIMENSIONS = listed({"name": name, "value": text})
STEPS = listed({"name": name, "match": _match}, least=1)
SETS = listed(
    {"id": name, "dimensions": listed({"name": name, "value": text}, "name", 1, MOST_DIMENSIONS)}, "id", 1, MOST_SETS
)

# (kind, target, modes; all if empty): what must be there, and what may. A name that the
# definition's own stands in for may be left out.
Rule = tuple[str, str, tuple[str, ...], dict[str, Check], dict[str, Check]]
RULES: list[Rule] = [
    ("field", "field_index", (), {"value": anything}, {"field_name": text, "mode": one_of("facet", "lookup"), "value_type": name}),
    ("measure", "event_measures", (), {"value": number}, {"measure_name": text, "unit": text, "dimensions": DIMENSIONS}),
    ("measure", "measure_cube_rollups", ("cube",), {"value": number, "dimension_sets": SETS}, {"measure_name": text, "unit": text}),
    ("rollup", "event_measures", (), {"value": number}, {"measure_name": text, "unit": text, "dimensions": DIMENSIONS}),
    ("metric_rollup", "metric_rollups", (), {"value": number},
     {"metric_name": text, "measure_name": text, "metric_kind": text, "dimensions": DIMENSIONS}),
    ("state", "entity_state_updates", (), {"entity_type": text, "entity_id": text, "value": text}, {"state_name": text, "value_type": name}),
    ("report", "report_results", ("", "summary"), {}, {"report_id": text, "dimensions": DIMENSIONS, "metrics": _metrics}),
    ("report", "report_results", ("trace_summary",), {}, {"report_id": text, "dimensions": DIMENSIONS}),
    ("report", "report_results", ("retention",), {"cohort_id": text, "entity_type": text, "entity_id": text},
     {"report_id": text, "dimensions": DIMENSIONS}),
    ("cohort", "cohort_memberships", (), {"entity_type": text, "entity_id": text}, {"cohort_id": text}),
    ("sequence", "sequence_report_results", (), {"entity_id": text, "steps": STEPS}, {"report_id": text, "dimensions": DIMENSIONS, "segment": DIMENSIONS}),
]


def problems(kind: str, mode: str, output: dict[str, Any]) -> list[str]:
    """What is wrong with an output; nothing for kinds that have no outputs of their own."""
    of_kind = [rule for rule in RULES if rule[0] == kind]
    if not of_kind:
        return []
    target = output.get("target") or ("measure_cube_rollups" if mode == "cube" else of_kind[0][1])
    aimed = [rule for rule in of_kind if rule[1] == target]
    if not aimed:
        return [f"target {target!r} is none of {kind}'s"]
    fitting = [rule for rule in aimed if not rule[2] or mode in rule[2]]
    if not fitting:
        return [f"target {target} needs mode {aimed[0][2][0]}"]
    _, _, _, needed, optional = fitting[0]
    found = [f"{key} {problem}" for key, check in needed.items() for problem in check(output.get(key))]
    given = ((key, check) for key, check in optional.items() if output.get(key) not in (None, ""))
    return found + [f"{key} {problem}" for key, check in given for problem in check(output[key])]
