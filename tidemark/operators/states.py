"""Entity state: change rows, latest values, values as of a time, transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import Fields
from tidemark.operators.filters import Time, instant
from tidemark.plans.definitions import Definition, Rule, emit, of_tenant
from tidemark.plans.exprs import string_expr
from tidemark.plans.matchers import matcher
from tidemark.plans.shapes import lit

STATE_KEY = ["tenant_id", "entity_type", "entity_id", "state_name"]


def _outputs(d: Definition) -> list[dict]:
    outputs = d.outputs("entity_state_updates")
    if outputs:
        return outputs
    config = {k: str(d.config.get(k) or "").strip() for k in ("path", "entity_type", "entity_id_path")}
    if not all(config.values()):
        return []
    return [
        {
            "entity_type": config["entity_type"],
            "entity_id": {"path": config["entity_id_path"]},
            "value": {"path": config["path"]},
            "value_type": str(d.config.get("value_type") or "").strip() or "string",
        }
    ]


def state_updates(events: DataFrame, definitions: Sequence[Definition]) -> DataFrame:
    """One row per event that sets a state of an entity."""

    def rules(_: DataFrame, fields: Fields, d: Definition) -> list[Rule]:
        found = []
        for output in _outputs(d):
            parts = {
                "entity_type": string_expr(fields, output.get("entity_type")),
                "entity_id": string_expr(fields, output.get("entity_id")),
                "state_name": string_expr(fields, output.get("state_name"), d.name),
                "value": string_expr(fields, output.get("value")),
            }
            if any(part is None for part in parts.values()):
                continue
            holds = of_tenant(d) & matcher(fields, d.config.get("match"))
            for part in parts.values():
                holds = holds & (part != "")
            columns = [
                lit(d.definition_id).alias("definition_id"),
                lit(d.version).cast("bigint").alias("definition_version"),
                *[part.alias(name) for name, part in parts.items()],
                F.lit(str(output.get("value_type") or "string")).alias("value_type"),
            ]
            found.append((holds, columns))
        return found

    rows = emit(
        events, definitions, rules, ["tenant_id", "timestamp", "event_id", "event_type", "signal"]
    )
    if rows is None:
        raise ValueError("no state definitions")
    return rows


def state_current(updates: DataFrame) -> DataFrame:
    """Latest value per entity and state; equal times are settled by event id."""
    newest = F.struct("timestamp", "event_id")
    return (
        updates.groupBy(*STATE_KEY)
        .agg(F.max_by(F.struct("value", "value_type", "timestamp", "event_id"), newest).alias("s"))
        .select(*STATE_KEY, "s.*")
    )


def state_query(
    updates: DataFrame,
    entity_type: str,
    state_name: str,
    *,
    entity_id: str = "",
    as_of: Time | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Latest values of one state, now or as of a time (inclusive), by entity.

    All entities without a limit.
    """
    rows = updates.where(
        (F.col("entity_type") == entity_type) & (F.col("state_name") == state_name)
    )
    if entity_id:
        rows = rows.where(F.col("entity_id") == entity_id)
    if as_of is not None:
        rows = rows.where(F.col("timestamp") <= instant(as_of))
    current = state_current(rows).withColumnRenamed("timestamp", "updated_at").orderBy("entity_id")
    return current if limit is None else current.limit(limit)


def state_trend(updates: DataFrame, state_name: str, unit: str = "week") -> DataFrame:
    """Transitions and distinct entities per value and calendar unit.

    Weeks start on Sunday.
    """
    time = F.col("timestamp")
    if unit == "week":
        start = F.date_trunc("week", time + F.expr("INTERVAL 1 DAY")) - F.expr("INTERVAL 1 DAY")
    else:
        start = F.date_trunc(unit, time)
    return (
        updates.where(F.col("state_name") == state_name)
        .groupBy(start.alias("period"), "value")
        .agg(
            F.count(F.lit(1)).alias("transitions"),
            F.countDistinct("entity_type", "entity_id").alias("entities"),
        )
    )
