"""Numeric measures declared by definitions: rows per event, rollups, cubes, metrics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.events import bucket
from tidemark.functions.paths import Fields
from tidemark.functions.quantiles import (
    PERCENTILES,
    exact_percentiles,
    merge_sketches,
    sketch,
    sketch_percentiles,
)
from tidemark.operators.filters import Time, filter_cube_dimensions, instant
from tidemark.plans.definitions import Definition, Rule, bucket_seconds, emit, of_tenant
from tidemark.plans.exprs import (
    dimension_map,
    dimension_pairs,
    named_values,
    number_expr,
    string_expr,
)
from tidemark.plans.matchers import matcher
from tidemark.plans.shapes import lit

EVENT_PART = ["tenant_id", "timestamp", "event_id", "event_type", "signal"]


def _head(definition: Definition, name: Column, value: Column, unit: Column) -> list[Column]:
    return [
        lit(definition.definition_id).alias("definition_id"),
        lit(definition.version).cast("bigint").alias("definition_version"),
        name.alias("measure_name"),
        value.alias("value"),
        unit.alias("unit"),
    ]


def _bucketed(output: dict, default: int) -> list[Column]:
    seconds = bucket_seconds(output, default)
    return [
        bucket(F.col("timestamp"), seconds).alias("bucket_time"),
        F.lit(seconds).alias("bucket_seconds"),
    ]


def _measure_outputs(definition: Definition) -> list[dict]:
    outputs = definition.outputs("event_measures")
    if outputs:
        return outputs
    path = str(definition.config.get("path") or "").strip()
    if not path:
        return []
    output = {"value": {"path": path}, "unit": str(definition.config.get("unit") or "").strip()}
    dimension = str(definition.config.get("dimension") or "").strip()
    if dimension:
        output["dimensions"] = [{"name": dimension, "value": {"path": dimension}}]
    return [output]


def event_measures(events: DataFrame, definitions: Sequence[Definition]) -> DataFrame:
    """One row per event, measure and non-empty dimension; a blank dimension if none."""

    def rules(_: DataFrame, fields: Fields, d: Definition) -> list[Rule]:
        found = []
        for output in _measure_outputs(d):
            value = number_expr(fields, output.get("value"))
            if value is None:
                continue
            name = string_expr(fields, output.get("measure_name"), d.name)
            unit = string_expr(fields, output.get("unit"), "")
            holds = of_tenant(d) & matcher(fields, d.config.get("match"))
            columns = [
                *_head(d, name, value, unit),
                *_bucketed(output, 300),
                dimension_pairs(named_values(fields, output.get("dimensions"))).alias("dims"),
            ]
            found.append((holds & value.isNotNull() & (name != ""), columns))
        return found

    rows = emit(events, definitions, rules, EVENT_PART)
    if rows is None:
        raise ValueError("no measure definitions")
    blank = F.array(F.struct(F.lit("").alias("name"), F.lit("").alias("value")))
    return rows.withColumn(
        "dim", F.explode(F.when(F.size("dims") > 0, F.col("dims")).otherwise(blank))
    ).select(
        "tenant_id", "definition_id", "definition_version", "measure_name", "value", "unit",
        "timestamp", "bucket_time", "bucket_seconds", "event_id", "event_type", "signal",
        F.col("dim.name").alias("dimension_name"), F.col("dim.value").alias("dimension_value"),
    )


def measure_cube_points(events: DataFrame, definitions: Sequence[Definition]) -> DataFrame:
    """One row per event and dimension set of which every dimension has a value."""

    def rules(_: DataFrame, fields: Fields, d: Definition) -> list[Rule]:
        if d.kind != "measure" or d.mode != "cube":
            return []
        found = []
        for output in d.outputs("measure_cube_rollups"):
            value = number_expr(fields, output.get("value"))
            sets = []
            for spec in output.get("dimension_sets") or []:
                pairs = named_values(fields, spec.get("dimensions"))
                if str(spec.get("id") or "").strip() and pairs:
                    sets.append((spec["id"].strip(), pairs))
            if output.get("target") != "measure_cube_rollups" or value is None or not sets:
                continue
            name = string_expr(fields, output.get("measure_name"), d.name)
            unit = string_expr(fields, output.get("unit"), "")
            structs = [
                F.struct(
                    F.lit(set_id).alias("id"),
                    F.array(*[F.lit(n) for n, _ in pairs]).alias("names"),
                    F.array(*[v for _, v in pairs]).alias("values"),
                )
                for set_id, pairs in sets
            ]
            complete = F.filter(
                F.array(*structs), lambda s: ~F.array_contains(s["values"], "")
            )
            holds = of_tenant(d) & matcher(fields, d.config.get("match"))
            columns = [*_head(d, name, value, unit), *_bucketed(output, 300), complete.alias("sets")]
            found.append((holds & value.isNotNull() & (name != ""), columns))
        return found

    rows = emit(events, definitions, rules, EVENT_PART)
    if rows is None:
        raise ValueError("no cube definitions")
    return rows.withColumn("s", F.explode("sets")).select(
        "tenant_id", "definition_id", "definition_version", "measure_name", "value", "unit",
        "timestamp", "bucket_time", "bucket_seconds", "event_id", "event_type", "signal",
        F.col("s.id").alias("dimension_set_id"),
        F.col("s.names").alias("dimension_names"),
        F.col("s.values").alias("dimension_values"),
    )


MEASURE_KEYS = [
    "tenant_id", "definition_id", "bucket_time", "bucket_seconds", "measure_name", "unit",
    "dimension_name", "dimension_value",
]
CUBE_KEYS = [
    "tenant_id", "definition_id", "bucket_time", "bucket_seconds", "measure_name", "unit",
    "dimension_set_id", "dimension_names", "dimension_values",
]


def _basic(value: str = "value") -> list[Column]:
    return [
        F.max("definition_version").alias("definition_version"),
        F.count(F.lit(1)).alias("count"),
        F.sum(value).alias("sum"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]


def _rollup(points: DataFrame, keys: list[str], quantiles: str) -> DataFrame:
    if quantiles == "sketch":
        return points.groupBy(*keys).agg(*_basic(), sketch("value").alias("quantiles_state"))
    rolled = points.groupBy(*keys).agg(*_basic())
    if quantiles == "none":
        return rolled
    if quantiles == "exact":
        return rolled.join(exact_percentiles(points, keys, "value"), keys)
    raise ValueError(f"unknown quantiles: {quantiles}")


def measure_rollups(measures: DataFrame, quantiles: str = "sketch") -> DataFrame:
    """Mergeable state per bucket, measure and dimension value.

    ``quantiles``: ``sketch`` keeps a mergeable KLL state, ``exact`` adds final
    p50/p90/p95/p99 columns, ``none`` leaves them out.
    """
    return _rollup(measures, MEASURE_KEYS, quantiles)


def measure_cube_rollups(points: DataFrame, quantiles: str = "sketch") -> DataFrame:
    """As ``measure_rollups``, per dimension set."""
    return _rollup(points, CUBE_KEYS, quantiles)


def merge_rollups(rollups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combine partial states of equal keys, or of coarser ones."""
    states = [
        F.max("definition_version").alias("definition_version"),
        F.sum("count").alias("count"),
        F.sum("sum").alias("sum"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    ]
    if "quantiles_state" in rollups.columns:
        states.append(merge_sketches("quantiles_state").alias("quantiles_state"))
    return rollups.groupBy(*keys).agg(*states)


def measure_query(
    cube_rollups: DataFrame,
    measure_name: str,
    start: Time,
    end: Time,
    group_by: Sequence[str],
    filters: dict[str, str] | None = None,
    seconds: int = 300,
) -> DataFrame:
    """A measure over time from the stored dimension set that equals ``group_by``.

    Bounds are inclusive; filters must be part of the set. ``resolve_dimension_set``
    tells beforehand whether such a set is declared.
    """
    group_by, filters = list(group_by), dict(filters or {})
    unknown = [name for name in filters if name not in group_by]
    if unknown:
        raise ValueError(f"filters outside the dimension set: {unknown}")
    rows = cube_rollups.where(
        (F.col("measure_name") == measure_name)
        & (F.col("bucket_seconds") == seconds)
        & (F.col("dimension_names") == F.array(*[F.lit(n) for n in group_by]))
        & (F.col("bucket_time") >= instant(start))
        & (F.col("bucket_time") <= instant(end))
    )
    rows = filter_cube_dimensions(rows, filters)
    merged = merge_rollups(rows, ["bucket_time", "dimension_names", "dimension_values"])
    quantiles = []
    if "quantiles_state" in merged.columns:
        quantiles = sketch_percentiles("quantiles_state")
    return merged.select(
        "bucket_time",
        F.map_from_arrays("dimension_names", "dimension_values").alias("dimensions"),
        "count",
        "sum",
        "min",
        "max",
        (F.col("sum") / F.col("count")).alias("avg"),
        *quantiles,
    )


def resolve_dimension_set(
    definitions: Sequence[Definition],
    measure_name: str,
    group_by: Sequence[str],
    definition_id: str = "",
) -> tuple[str, int, str]:
    """(definition, version, set id) of the declared set with exactly these names in
    this order; raises with the sets that are available otherwise."""
    available = []
    for d in definitions:
        if d.kind != "measure" or d.mode != "cube" or definition_id not in ("", d.definition_id):
            continue
        for output in d.outputs("measure_cube_rollups"):
            if output.get("measure_name", d.name) != measure_name:
                continue
            for spec in output.get("dimension_sets") or []:
                names = [dim["name"] for dim in spec.get("dimensions") or []]
                if names == list(group_by):
                    return d.definition_id, d.version, spec["id"]
                available.append(names)
    raise ValueError(f"requested measure grouping is not materialized; available: {available}")


def measure_window(
    measures: DataFrame, measure_name: str, seconds: int, keys: Iterable[str] = (), quantiles: str = "exact"
) -> DataFrame:
    """Average and p95 over short windows straight from the measure rows.

    ``quantiles="sketch"`` estimates p95 in the same aggregation (KLL).
    """
    if quantiles not in ("exact", "sketch"):
        raise ValueError(f"quantiles are exact or by sketch, not {quantiles!r}")
    rows = measures.where(F.col("measure_name") == measure_name).withColumn(
        "bucket_time", bucket(F.col("timestamp"), seconds)
    )
    keys = ["bucket_time", *keys]
    if quantiles == "sketch":
        states = rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("count"), F.avg("value").alias("avg"), sketch("value").alias("state")
        )
        return states.select(*keys, "count", "avg", *sketch_percentiles("state", [0.95]))
    averages = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("avg")
    )
    return averages.join(exact_percentiles(rows, keys, "value", [0.95]), keys)


METRIC_KEYS = [
    "tenant_id", "definition_id", "definition_version", "metric_name", "unit", "bucket_time",
    "bucket_seconds", "dimensions",
]


def metric_kind(kind: Column) -> Column:
    """gauge, histogram or timing as named (any case), everything else a counter."""
    clean = F.lower(F.trim(kind))
    return F.when(clean.isin("gauge", "histogram", "timing"), clean).otherwise(F.lit("counter"))


def metric_points(events: DataFrame, definitions: Sequence[Definition]) -> DataFrame:
    """One row per event and metric definition, with its kind and dimension map."""

    def rules(_: DataFrame, fields: Fields, d: Definition) -> list[Rule]:
        found = []
        for output in d.outputs("metric_rollups"):
            value = number_expr(fields, output.get("value"))
            if value is None:
                continue
            name = string_expr(fields, output.get("metric_name"))
            if name is None:
                name = string_expr(fields, output.get("measure_name"), d.name)
            kind = string_expr(fields, output.get("metric_kind"))
            if kind is None:
                kind = fields.string("metric_type", "counter")
            holds = of_tenant(d) & matcher(fields, d.config.get("match"))
            columns = [
                lit(d.definition_id).alias("definition_id"),
                lit(d.version).cast("bigint").alias("definition_version"),
                name.alias("metric_name"),
                metric_kind(kind).alias("metric_kind"),
                value.alias("value"),
                string_expr(fields, output.get("unit"), "").alias("unit"),
                *_bucketed(output, 60),
                dimension_map(named_values(fields, output.get("dimensions"))).alias("dimensions"),
            ]
            found.append((holds & value.isNotNull() & (name != ""), columns))
        return found

    rows = emit(events, definitions, rules, ["tenant_id", "timestamp", "event_id"])
    if rows is None:
        raise ValueError("no metric definitions")
    return rows


def _metric_rollup(points: DataFrame, kinds: Sequence[str], extra: list[Column]) -> DataFrame:
    return (
        points.where(F.col("metric_kind").isin(*kinds))
        .groupBy(*METRIC_KEYS)
        .agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum"), *extra)
    )


def counter_rollup(points: DataFrame) -> DataFrame:
    """Count and sum of counters."""
    return _metric_rollup(points, ["counter"], [])


def gauge_rollup(points: DataFrame) -> DataFrame:
    """Count, sum, min, max and the last value (ties settled by event id)."""
    last = F.max_by("value", F.struct("timestamp", "event_id")).alias("last")
    return _metric_rollup(
        points, ["gauge"], [F.min("value").alias("min"), F.max("value").alias("max"), last]
    )


def histogram_rollup(points: DataFrame) -> DataFrame:
    """Count, sum, min and max of histograms and timings."""
    return _metric_rollup(
        points, ["histogram", "timing"], [F.min("value").alias("min"), F.max("value").alias("max")]
    )


def metric_rollups(events: DataFrame, definitions: Sequence[Definition]) -> dict[str, DataFrame]:
    """All three metric tables, each routed by kind."""
    points = metric_points(events, definitions)
    return {
        "counter": counter_rollup(points),
        "gauge": gauge_rollup(points),
        "histogram": histogram_rollup(points),
    }
