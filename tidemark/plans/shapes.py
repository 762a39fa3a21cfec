"""Definitions as data: shapes with slots, and an index of what each event may match.

Definitions of many tenants mostly differ in a few literals. Their shape, the config
with slots in place of those literals, is compiled once; the literals become the
parameters of a row that is filed under the tenant and the equality its matcher
pins (an event type, say). An event meets only the rows filed under its own values, by one
hash join, so the plan grows with the shapes and the scan is one however many
definitions there are.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAMS, SHAPE = "__params", "__shape"
# Equalities worth filing by, the most selective first.
PINS = ("event_type", "name", "service", "signal", "environment")
# Literals of an output that may be slots: they are only ever turned into columns.
SLOTTED = ("measure_name", "metric_name", "unit", "report_id", "cohort_id", "entity_type", "state_name")
# Filed definitions are broadcast up to this many bytes; beyond, Spark chooses the join.
BROADCAST_BYTES = 64 << 20


class Slot(str):
    """Stands for a literal that differs between definitions of one shape."""

    number: int

    def __new__(cls, number: int) -> Slot:
        slot = super().__new__(cls, f"\0{number}")
        slot.number = number
        return slot


def lit(value: Any) -> Column:
    """A literal, or the parameter a slot stands for."""
    return F.get(F.col(PARAMS), F.lit(value.number)) if isinstance(value, Slot) else F.lit(value)


def _plain(value: Any) -> str:
    """Text that an equality compares with, empty if it is not a plain scalar."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return json.dumps(value)
    return value if isinstance(value, str) else ""


class Shaping:
    """Collects definitions by shape; ``pins`` are the columns to file them by."""

    def __init__(self, pins: Sequence[str]):
        self.pins = [p for p in PINS if p in pins]
        self.numbers: dict[str, int] = {}
        self.shapes: list[tuple[dict[str, Any], dict[str, Any]]] = []
        self.rows: list[tuple[str, str, str, int, list[str]]] = []

    def add(self, tenant: str, literals: Mapping[str, str], config: Mapping[str, Any], rest: Any = None) -> None:
        """File a definition by its config; ``literals`` are texts of it kept beside the config, of
        which empty ones stay part of the shape, like ``rest``."""
        params: list[str] = []

        def slot(text: str) -> str:
            params.append(text)
            return Slot(len(params) - 1)

        slots = {name: slot(text) if text else "" for name, text in sorted(literals.items())}
        pin = ("", "")
        match = dict(config.get("match") or {})
        for group in ("all", "any"):
            specs = []
            for spec in match.get(group) or []:
                text = _plain(spec.get("value"))
                if spec.get("op", "eq") in ("eq", "neq", "ne") and text:
                    path = str(spec.get("path")).strip()
                    if group == "all" and spec.get("op", "eq") == "eq" and path in self.pins:
                        if not pin[0] or self.pins.index(path) < self.pins.index(pin[0]):
                            pin = (path, text)
                    spec = {**spec, "value": slot(text)}
                specs.append(spec)
            if specs:
                match[group] = specs
        shaped = {**config, **({"match": match} if match else {})}
        if isinstance(config.get("outputs"), list):
            shaped["outputs"] = [
                {k: slot(v) if k in SLOTTED and isinstance(v, str) and v else v for k, v in sorted(output.items())}
                if isinstance(output, dict) else output
                for output in config["outputs"]
            ]
        key = json.dumps([slots, shaped, rest], sort_keys=True, default=str)
        if key not in self.numbers:
            self.numbers[key] = len(self.shapes)
            self.shapes.append((slots, shaped))
        self.rows.append((tenant, *pin, self.numbers[key], params))

    def candidates(self, events: DataFrame, numbers: Sequence[int]) -> DataFrame:
        """``events`` once per definition of these shapes that is filed under its values, with shape and parameters."""
        wanted = set(numbers)
        rows = [r for r in self.rows if r[3] in wanted]
        index = events.sparkSession.createDataFrame(
            rows, f"__tenant string, __pin string, __value string, {SHAPE} int, {PARAMS} array<string>"
        )
        if sum(len(r[0]) + len(r[2]) + sum(map(len, r[4])) + 64 for r in rows) <= BROADCAST_BYTES:
            index = F.broadcast(index)
        filed = sorted({r[1] for r in rows})
        keys = F.array(
            *[F.struct(F.lit(p).alias("pin"), (F.coalesce(F.col(p), F.lit("")) if p else F.lit("")).alias("value")) for p in filed]
        )
        met = events.withColumn("__key", F.explode(keys))
        found = (met["tenant_id"] == index["__tenant"]) & (F.col("__key.pin") == index["__pin"]) & (
            F.col("__key.value") == index["__value"]
        )
        return met.join(index, found).drop("__key", "__tenant", "__pin", "__value")

    def tenants(self) -> list[str]:
        return sorted({r[0] for r in self.rows})
