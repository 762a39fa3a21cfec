"""Definitions: what users declare to be extracted from events."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import Fields, shred
from tidemark.plans.exprs import paths_in
from tidemark.plans.matchers import ALERT_OPS, DEFINITION_OPS
from tidemark.plans.outputs import problems
from tidemark.plans.shapes import PINS, SHAPE, Shaping, lit
from tidemark.schema import FLAT_STRINGS

# The kinds of definition and the modes each may have.
KINDS = {
    "field": ("facet", "lookup"),
    "measure": ("measure", "cube"),
    "rollup": ("managed", "rollup"),
    "metric_rollup": ("managed", "metric_rollup"),
    "state": ("state",),
    "search": ("search",),
    "report": ("summary", "retention", "trace_summary"),
    "sequence": ("funnel",),
    "cohort": ("cohort",),
    "alert": ("alert",),
}

# Up to so many definitions are compiled each by itself; more are filed by shape.
PER_SCAN = 64
# Shapes evaluated in one pass over the events.
SHAPES_PER_SCAN = 256


@dataclass(frozen=True)
class Definition:
    """One version of a definition. ``config`` holds ``match`` and ``outputs``."""

    definition_id: str
    kind: str
    config: dict[str, Any] = field(hash=False)
    tenant_id: str = ""
    name: str = ""
    mode: str = ""
    version: int = 1

    def of_mode(self, mode: str) -> bool:
        """Whether it is of this mode; a definition without one fits every builder of its kind."""
        return self.mode in ("", mode)

    def outputs(self, target: str) -> list[dict[str, Any]]:
        """Outputs aimed at a table; one that names no target fits every table."""
        outputs = self.config.get("outputs")
        return [
            output
            for output in (outputs if isinstance(outputs, list) else [])
            if isinstance(output, dict) and output.get("target") in (None, target)
        ]


def validate(definition: Definition) -> Definition:
    """Reject unknown kinds, modes, operators and incomplete outputs."""
    if definition.kind not in KINDS:
        raise ValueError(f"unknown definition kind: {definition.kind}")
    modes = KINDS[definition.kind]
    if definition.mode and definition.mode not in modes:
        raise ValueError(f"unknown mode for {definition.kind}: {definition.mode}")
    if not definition.definition_id.strip():
        raise ValueError("a definition needs an id")
    if not isinstance(definition.config, dict):
        raise ValueError("config must be an object")
    operators = ALERT_OPS if definition.kind == "alert" else DEFINITION_OPS
    match = definition.config.get("match") or {}
    if not isinstance(match, dict):
        raise ValueError("match must be an object")
    for group in ("all", "any"):
        for spec in match.get(group) or []:
            if spec.get("op", "eq") not in operators:
                raise ValueError(f"unsupported operator: {spec.get('op')}")
            if spec.get("op") != "is_error" and not str(spec.get("path") or "").strip():
                raise ValueError("a predicate needs a path")
    outputs = definition.config.get("outputs")
    if outputs is not None and not isinstance(outputs, list):
        raise ValueError("outputs must be a list")
    for output in outputs or []:
        if not isinstance(output, dict):
            raise ValueError("an output must be an object")
        seconds = output.get("bucket_seconds")
        if seconds is not None and (not isinstance(seconds, int) or seconds <= 0):
            raise ValueError("bucket_seconds must be a positive whole number")
        wrong = problems(definition.kind, definition.mode, output)
        if wrong:
            raise ValueError(f"output of {definition.definition_id}: {'; '.join(wrong)}")
    paths_in(definition.config)
    return definition


def bucket_seconds(output: dict[str, Any], default: int, key: str = "bucket_seconds") -> int:
    value = output.get(key)
    return value if isinstance(value, int) and not isinstance(value, bool) and value > 0 else default


def latest_definitions(df: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """Newest version of each definition, if enabled and not deleted."""
    if kinds is not None:
        df = df.where(F.col("kind").isin(*kinds))
    rest = [c for c in df.columns if c not in ("tenant_id", "definition_id")]
    newest = df.groupBy("tenant_id", "definition_id").agg(
        F.max_by(F.struct(*rest), F.col("version")).alias("row")
    )
    return newest.select("tenant_id", "definition_id", "row.*").where(
        F.col("enabled") & F.col("deleted_at").isNull()
    )


def load_definitions(df: DataFrame, kinds: Iterable[str] | None = None) -> list[Definition]:
    """The latest definitions as objects, ready to be compiled into columns.

    Definitions are control rows that people write, so they fit the driver; ``df`` may be
    cut to some tenants beforehand.
    """
    rows = latest_definitions(df, kinds).collect()
    return [
        validate(
            Definition(
                definition_id=row["definition_id"],
                kind=row["kind"],
                config=json.loads(row["config"]),
                tenant_id=row["tenant_id"],
                name=row["name"] or "",
                mode=row["mode"] or "",
                version=int(row["version"]),
            )
        )
        for row in sorted(rows, key=lambda r: (r["tenant_id"], r["definition_id"]))
    ]


def of_tenant(definition: Definition) -> Column:
    return F.col("tenant_id") == lit(definition.tenant_id)


Rule = tuple[Column, list[Column]]


Rules = Callable[[DataFrame, Fields, Definition], list[Rule]]


def emit(
    events: DataFrame,
    definitions: Sequence[Definition],
    rules: Rules,
    keep: Sequence[str | Column],
) -> DataFrame | None:
    """Evaluate many definitions in one pass over the events.

    ``rules`` gives, per definition, (condition, output columns) pairs with the
    same output columns throughout, literals of the definition by ``lit``. Every event
    yields one row per rule that holds. The payload is parsed once for all paths. None if
    there are no rules. More than ``PER_SCAN`` definitions are compiled by shape and
    looked up by tenant and pinned value.
    """
    if len(definitions) > PER_SCAN:
        return _emit_filed(events, definitions, rules, keep)
    parsed = shred(events, set().union(*(paths_in(d.config) for d in definitions)))
    fields = Fields(parsed)
    found = [rule for d in definitions for rule in rules(parsed, fields, d)]
    if not found:
        return None
    if len(found) == 1:
        condition, columns = found[0]
        return parsed.where(condition).select(*keep, *columns)
    return _unfolded(parsed, _hits(found), keep)


def _hits(found: Sequence[Rule]) -> Column:
    """The output rows of the rules that hold."""
    return F.array_compact(F.array(*[F.when(condition, F.struct(*columns)) for condition, columns in found]))


def _unfolded(rows: DataFrame, hits: Column, keep: Sequence[str | Column]) -> DataFrame:
    rows = rows.select(*keep, F.explode(hits).alias("__row"))
    return rows.select(*[c for c in rows.columns if c != "__row"], "__row.*")


def _emit_filed(
    events: DataFrame, definitions: Sequence[Definition], rules: Rules, keep: Sequence[str | Column]
) -> DataFrame | None:
    flat = [c for c in PINS if c in FLAT_STRINGS and c in events.columns]
    shaping, kinds = Shaping(flat), {}
    for d in definitions:
        literals = {"tenant_id": d.tenant_id, "definition_id": d.definition_id, "version": str(d.version), "name": d.name}
        shaping.add(d.tenant_id, literals, d.config, [d.kind, d.mode])
        kinds.setdefault(shaping.rows[-1][3], d)
    events = events.where(F.col("tenant_id").isin(shaping.tenants()))
    result = None
    for start in range(0, len(shaping.shapes), SHAPES_PER_SCAN):
        numbers = range(start, min(start + SHAPES_PER_SCAN, len(shaping.shapes)))
        parsed = shred(events, set().union(*(paths_in(kinds[n].config) for n in numbers)))
        fields, found = Fields(parsed), {}
        for n in numbers:
            slots, config = shaping.shapes[n]
            found[n] = rules(parsed, fields, replace(kinds[n], config=config, **slots))
        found = {n: some for n, some in found.items() if some}
        if not found:
            continue
        hits = None
        for n, some in found.items():
            here = F.col(SHAPE) == n
            hits = F.when(here, _hits(some)) if hits is None else hits.when(here, _hits(some))
        part = _unfolded(shaping.candidates(parsed, list(found)), hits, keep)
        result = part if result is None else result.unionByName(part)
    return result
