"""Summary reports declared by definitions, and reading stored report rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.events import bucket, is_error
from tidemark.functions.paths import Fields
from tidemark.operators.filters import Time, TimeRange, filter_dimensions, in_time
from tidemark.plans.definitions import Definition, Rule, bucket_seconds, emit, of_tenant
from tidemark.plans.exprs import dimension_map, named_values, number_expr, string_expr
from tidemark.plans.matchers import matcher
from tidemark.plans.shapes import lit

REPORT_KEYS = ["tenant_id", "report_id", "report_version", "bucket_time", "dimensions"]

_METRIC_OPS = {"count": "count", "error_count": "errors", "count_errors": "errors", "sum": "sum"}


def report_metrics(output: dict) -> list[tuple[str, str, object]]:
    """(name, op, value spec) of a report's metrics; events and errors by default."""
    metrics = []
    for spec in output.get("metrics") or []:
        name = str(spec.get("name") or "").strip() if isinstance(spec, dict) else ""
        op = _METRIC_OPS.get(spec.get("op", "count")) if name else None
        if op:
            metrics.append((name, op, spec.get("value")))
    return metrics or [("events", "count", None), ("errors", "errors", None)]


def _increments(events: DataFrame, fields: Fields, output: dict) -> dict[str, Column]:
    """What one event adds to each metric; NULL adds nothing. Metrics of the same
    name add up."""
    found: dict[str, list[Column]] = {}
    for name, op, spec in report_metrics(output):
        if op == "count":
            value = F.lit(1.0)
        elif op == "errors":
            value = is_error(events).cast("double")
        else:
            value = number_expr(fields, spec)
            value = F.lit(None).cast("double") if value is None else value
        found.setdefault(name, []).append(value)
    merged = {}
    for name, values in found.items():
        total = values[0]
        for value in values[1:]:
            total = F.coalesce(total + value, total, value)
        merged[name] = total
    return merged


def report_summary(events: DataFrame, definitions: Sequence[Definition]) -> DataFrame:
    """Counts, errors and sums per bucket and dimensions, with the number of source
    events and the bucket width among the metrics.

    Metrics are aggregated as positional columns and named afterwards, so events
    are not multiplied by the number of metrics.
    """
    layouts = []

    def rules(parsed: DataFrame, fields: Fields, d: Definition) -> list[Rule]:
        found = []
        for output in d.outputs("report_results") if d.of_mode("summary") else []:
            report = string_expr(fields, output.get("report_id"), d.name)
            increments = _increments(parsed, fields, output)
            layouts.append(list(increments))
            seconds = bucket_seconds(output, 60)
            columns = [
                report.alias("report_id"),
                lit(d.version).cast("bigint").alias("report_version"),
                bucket(F.col("timestamp"), seconds).alias("bucket_time"),
                dimension_map(named_values(fields, output.get("dimensions"))).alias("dimensions"),
                F.lit(len(layouts) - 1).alias("layout"),
                F.lit(float(seconds)).alias("bucket_seconds"),
                F.array(*increments.values()).alias("increments"),
            ]
            holds = of_tenant(d) & matcher(fields, d.config.get("match"))
            found.append((holds & (report != ""), columns))
        return found

    rows = emit(events, definitions, rules, ["tenant_id"])
    if rows is None:
        raise ValueError("no report definitions")
    width = max(len(layout) for layout in layouts)
    grouped = rows.groupBy(*REPORT_KEYS, "layout").agg(
        F.count(F.lit(1)).cast("double").alias("source_events"),
        F.first("bucket_seconds").alias("bucket_seconds"),
        *[F.sum(F.get("increments", F.lit(i))).alias(f"m{i}") for i in range(width)],
    )
    names = F.array(
        *[
            F.array(*[F.lit(n) for n in layout + [""] * (width - len(layout))])
            for layout in layouts
        ]
    )
    name = lambda i: F.get(F.get(names, F.col("layout")), F.lit(i))
    entries = [F.struct(name(i).alias("key"), F.col(f"m{i}").alias("value")) for i in range(width)]
    fixed = [
        F.struct(F.lit(n).alias("key"), F.col(n).alias("value"))
        for n in ("source_events", "bucket_seconds")
    ]
    declared = F.filter(
        F.array(*entries),
        lambda e: (e["key"] != "")
        & e["value"].isNotNull()
        & ~e["key"].isin("source_events", "bucket_seconds"),
    )
    return grouped.select(
        *REPORT_KEYS, F.map_from_entries(F.concat(declared, F.array(*fixed))).alias("metrics")
    )


def report_query(
    results: DataFrame,
    report_id: str,
    *,
    version: int | None = None,
    start: Time | None = None,
    end: Time | None = None,
    filters: dict[str, str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Stored rows of one report by time and dimensions, oldest first; all without a limit."""
    rows = results.where(F.col("report_id") == report_id)
    if version is not None:
        rows = rows.where(F.col("report_version") == version)
    rows = in_time(rows, TimeRange(start, end), column="bucket_time")
    rows = filter_dimensions(rows, filters or {})
    order = [F.col("bucket_time").asc(), F.to_json("dimensions").asc()]
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def catalogue(results: DataFrame, kind: str) -> DataFrame:
    """What a serving table holds: first and last time, rows, keys, versions.

    ``kind``: report, sequence, cohort, measure, cube, state.
    """
    id_column, time, version = {
        "report": ("report_id", "bucket_time", "report_version"),
        "sequence": ("report_id", "bucket_time", "report_version"),
        "cohort": ("cohort_id", "first_seen", "cohort_version"),
        "measure": ("measure_name", "bucket_time", "definition_version"),
        "cube": ("measure_name", "bucket_time", "definition_version"),
        "state": ("state_name", "timestamp", "definition_version"),
    }[kind]
    last = "last_seen" if kind == "cohort" else time
    columns = [
        F.min(time).alias("first_time"),
        F.max(last).alias("last_time"),
        F.count(F.lit(1)).alias("rows"),
        F.max(version).alias("latest_version"),
    ]
    if kind == "cohort":
        columns.append(F.countDistinct("entity_type", "entity_id").alias("entities"))
    if kind == "state":
        columns.append(F.countDistinct("entity_type", "entity_id").alias("entities"))
        columns.append(F.countDistinct("value").alias("distinct_values"))
    if kind == "sequence":
        columns.append(F.array_sort(F.collect_set("step_name")).alias("steps"))
    if kind == "report":
        columns.append(
            F.array_sort(F.collect_set(F.array_join(F.map_keys("dimensions"), ","))).alias(
                "dimension_names"
            )
        )
    if kind in ("measure", "cube"):
        name = "dimension_name" if kind == "measure" else "dimension_set_id"
        columns.append(F.array_sort(F.collect_set(name)).alias("dimension_names"))
    return results.groupBy("tenant_id", F.col(id_column).alias("id")).agg(*columns)


def definition_catalogue(definitions: DataFrame) -> DataFrame:
    """Active definitions counted by tenant, kind and mode."""
    from tidemark.plans.definitions import latest_definitions

    return (
        latest_definitions(definitions)
        .groupBy("tenant_id", "kind", "mode")
        .agg(
            F.count(F.lit(1)).alias("definitions"),
            F.max("version").alias("latest_version"),
        )
    )
