"""Counts over time and by field value: density, field rollups, groups, summary, latest.

All aggregations combine map-side on small keys (second, value), so a hot
tenant or value costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.distinct import distinct_state, estimate, united
from tidemark.functions.events import bucket, is_error
from tidemark.functions.paths import Fields, shred
from tidemark.plans.facets import facet_path

# Fields with maintained rollups, fields the raw table can be
# grouped by, and interval widths for histograms in milliseconds.
CORE_FIELDS = ("signal", "event_type", "name", "service", "environment", "is_error")

RAW_FIELDS = (
    "signal", "event_type", "name", "service", "environment", "is_error",
    "http.method", "http.route", "http.status_code", "http.response.status_code",
    "severity_text", "severity_number", "llm.model", "llm.provider", "tool_name",
    "plan", "country", "region", "user_group", "user_id", "account_id", "anonymous_id",
    "session_id", "group_id", "organization_id", "thread_id", "conversation_id",
    "request_id", "duration_ms", "metric_name", "metric_type", "metric_unit",
    "metric_value", "revenue", "currency",
)

TRACE_LIKE = ("trace_id", "span_id", "request_id", "session_id", "thread_id", "conversation_id")

INTERVALS_MS = (
    1, 2, 5, 10, 20, 50, 100, 200, 500,
    1_000, 2_000, 5_000, 10_000, 15_000, 30_000,
    60_000, 120_000, 300_000, 600_000, 900_000, 1_800_000,
    3_600_000, 7_200_000, 21_600_000, 43_200_000, 86_400_000, 604_800_000,
)


def _count() -> Column:
    return F.count(F.lit(1))


def event_density(events: DataFrame, seconds: int = 1, variant: str = "view") -> DataFrame:
    """Events and errors per tenant and interval."""
    return (
        events.select(
            "tenant_id",
            bucket(F.col("timestamp"), seconds).alias("bucket_time"),
            is_error(events, variant).alias("error"),
        )
        .groupBy("tenant_id", "bucket_time")
        .agg(_count().alias("count"), F.count_if("error").alias("error_count"))
    )


def field_rollups(events: DataFrame, resolutions: Sequence[int] = (1, 60)) -> DataFrame:
    """Counts, per-signal counts and durations by core field value and interval.

    The finest interval is aggregated first and the coarser ones are rolled up
    from it; Spark reuses the exchange of the first step, so the events are read
    and fanned out once.
    """
    finest, *coarser = sorted(resolutions)
    error = is_error(events, "view").cast("bigint")
    duration = F.coalesce(F.col("duration_ms"), F.lit(0.0))
    values = {
        "signal": F.col("signal"),
        "event_type": F.col("event_type"),
        "name": F.col("name"),
        "service": F.col("service"),
        "environment": F.col("environment"),
        "is_error": error.cast("string"),
    }
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("field_name"), values[name].alias("value"))
            for name in CORE_FIELDS
        ]
    )
    rows = events.select(
        "tenant_id",
        F.explode(F.filter(pairs, lambda pair: pair["value"] != "")).alias("pair"),
        bucket(F.col("timestamp"), finest).alias("bucket_time"),
        error.alias("error"),
        "signal",
        duration.alias("duration"),
    ).select("tenant_id", "pair.*", "bucket_time", "error", "signal", "duration")
    base = rows.groupBy("tenant_id", "field_name", "value", "bucket_time").agg(
        _count().alias("count"),
        F.sum("error").alias("error_count"),
        *[
            F.count_if(F.col("signal") == kind).alias(f"{kind}_count")
            for kind in ("trace", "log", "metric", "analytics")
        ],
        F.count_if(F.col("duration") > 0).alias("duration_count"),
        F.sum("duration").alias("duration_sum"),
    )
    sums = [c for c in base.columns if c.endswith("_count") or c in ("count", "duration_sum")]
    result = base.withColumn("bucket_seconds", F.lit(finest))
    for seconds in coarser:
        rolled = base.groupBy(
            "tenant_id",
            "field_name",
            "value",
            bucket(F.col("bucket_time"), seconds).alias("bucket_time"),
        ).agg(*[F.sum(c).alias(c) for c in sums])
        result = result.unionByName(rolled.withColumn("bucket_seconds", F.lit(seconds)))
    return result


def nice_interval(target: Column) -> Column:
    """Smallest interval of the list that is at least ``target`` milliseconds."""
    fits = F.filter(
        F.array(*[F.lit(i).cast("bigint") for i in INTERVALS_MS]), lambda i: i >= target
    )
    return F.when(F.size(fits) > 0, F.element_at(fits, 1)).otherwise(
        F.lit(INTERVALS_MS[-1]).cast("bigint")
    )


def density(
    source: DataFrame,
    buckets: int = 120,
    floor_ms: int | None = None,
    variant: str = "milliseconds",
) -> DataFrame:
    """Histogram over time with a readable interval that gives about ``buckets`` bars.

    ``source`` is the event table or a density/rollup table (``bucket_time``,
    ``count``, ``error_count``). The range is found by a scalar subquery, so one
    plan does both steps. ``variant="seconds"`` truncates times to whole seconds
    before dividing.
    """
    rolled = "bucket_time" in source.columns and "count" in source.columns
    if rolled:
        floor_ms = 1_000 if floor_ms is None else floor_ms
        rows = source.select(
            F.unix_millis("bucket_time").alias("ms"), "count", F.col("error_count").alias("errors")
        )
    else:
        floor_ms = 1 if floor_ms is None else floor_ms
        rows = source.select(
            F.unix_millis("timestamp").alias("ms"),
            F.lit(1).cast("bigint").alias("count"),
            is_error(source, "query").cast("bigint").alias("errors"),
        )
    span = F.greatest(F.max("ms") - F.min("ms"), F.lit(1))
    target = F.greatest(F.floor(span / F.lit(max(buckets, 1))), F.lit(max(floor_ms, 1)))
    width = rows.agg(
        F.greatest(nice_interval(target), F.lit(max(floor_ms, 1))).alias("width")
    ).scalar()
    ms = F.expr("ms div 1000 * 1000") if variant == "seconds" else F.col("ms")
    return (
        rows.select((ms - F.pmod(ms, width)).alias("bucket"), "count", "errors")
        .groupBy("bucket")
        .agg(
            F.sum("count").cast("bigint").alias("count"),
            F.sum("errors").cast("bigint").alias("error_count"),
        )
    )


def group_order(path: str, sort: str = "count") -> list[Column]:
    """Ordering of group rows with ties settled by value."""
    value, count = F.col("value").asc(), F.col("count").desc()
    errors = F.col("error_count").desc()
    if sort == "value":
        return [value]
    if sort == "duration":
        return [F.col("duration_ms").desc(), count, errors, value]
    if sort == "recent" and path in TRACE_LIKE:
        return [F.col("ended_at").desc(), count, errors, value]
    if sort in ("count", "recent"):
        return [count, errors, value]
    raise ValueError(f"unknown group order: {sort}")


def groups(
    source: DataFrame,
    path: str,
    sort: str = "count",
    search: str = "",
    limit: int = 100,
    offset: int = 0,
    has_more: bool = False,
) -> DataFrame:
    """Per value of a field: first and last time, span, events and errors.

    ``source`` is the field rollups, the field index, the identifier index or the
    raw events; the columns tell which. With ``has_more`` one extra row reveals
    that another page exists.
    """
    path = facet_path(path)
    columns = set(source.columns)
    if {"field_name", "bucket_seconds"} <= columns:
        rows = source.where((F.col("field_name") == path) & (F.col("bucket_seconds") == 60))
        time, count, errors = F.col("bucket_time"), F.sum("count"), F.sum("error_count")
    elif "field_name" in columns:
        rows = source.where((F.col("field_name") == path) & (F.col("value") != ""))
        time, errors = F.col("timestamp"), F.sum("is_error")
        count = F.countDistinct("event_id") if "mode" in columns else _count()
    else:
        rows = source.select(
            Fields(source, derived_signal=True).string(path).alias("value"),
            "timestamp",
            is_error(source, "query").cast("bigint").alias("is_error"),
        ).where(F.col("value") != "")
        time, count, errors = F.col("timestamp"), _count(), F.sum("is_error")
    if search:
        rows = rows.where(F.col("value") == search)
    grouped = rows.groupBy("value").agg(
        F.min(time).alias("started_at"),
        F.max(time).alias("ended_at"),
        (F.unix_millis(F.max(time)) - F.unix_millis(F.min(time))).alias("duration_ms"),
        count.cast("bigint").alias("count"),
        errors.cast("bigint").alias("error_count"),
    )
    page = grouped.orderBy(*group_order(path, sort))
    return page.offset(offset).limit(limit + 1 if has_more else limit)


def group_options(spark, definitions: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Paths that can be grouped by, with the best table that serves each.

    Built-in rollups come before identifiers, declared fields and raw paths.
    """
    from tidemark.operators.indexes import IDENTIFIERS

    schema = (
        "path string, value_type string, source string, serving_mode string,"
        " aggregate_enabled boolean, index_enabled boolean, priority int"
    )
    builtin = (
        [(p, "string", "builtin", "rollup", True, False, 1) for p in CORE_FIELDS]
        + [(p, "string", "builtin", "index", False, True, 2) for p in IDENTIFIERS]
        + [(p, "string", "raw", "raw", False, False, 4) for p in RAW_FIELDS]
    )
    options = spark.createDataFrame(builtin, schema)
    if definitions is not None:
        declared = definitions.where(
            (F.col("kind") == "field") & F.col("enabled") & F.col("deleted_at").isNull()
        )
        value_type = F.coalesce(F.get_json_object("config", "$.value_type"), F.lit("string"))
        outputs = F.from_json(
            F.get_json_object("config", "$.outputs"),
            "array<struct<field_name:string,value_type:string>>",
        )
        for named in (
            declared.select(F.col("name").alias("path"), value_type.alias("value_type")),
            declared.select(F.explode(outputs).alias("o")).select(
                F.col("o.field_name").alias("path"),
                F.coalesce("o.value_type", F.lit("string")).alias("value_type"),
            ),
        ):
            options = options.unionByName(
                named.where(F.coalesce("path", F.lit("")) != "").select(
                    "path",
                    "value_type",
                    F.lit("definition").alias("source"),
                    F.lit("index").alias("serving_mode"),
                    F.lit(True).alias("aggregate_enabled"),
                    F.lit(True).alias("index_enabled"),
                    F.lit(3).alias("priority"),
                )
            )
    best = lambda c: F.min_by(c, "priority").alias(c)
    found = (
        options.groupBy("path")
        .agg(
            best("value_type"),
            best("source"),
            best("serving_mode"),
            F.max("aggregate_enabled").alias("aggregate_enabled"),
            F.max("index_enabled").alias("index_enabled"),
        )
        .orderBy("path")
    )
    return found if limit is None else found.limit(limit)


def summary(source: DataFrame, path: str | None = None, value: str | None = None) -> DataFrame:
    """Number of events, from raw events (count rows) or a rollup (sum counts)."""
    columns = set(source.columns)
    if {"field_name", "bucket_seconds"} <= columns:
        source = source.where(
            (F.col("field_name") == path) & (F.col("value") == value) & (F.col("bucket_seconds") == 60)
        )
    elif path is not None and "field_name" in columns:
        source = source.where((F.col("field_name") == path) & (F.col("value") == value))
    elif path is not None:
        source = source.where(Fields(source, derived_signal=True).string(facet_path(path)) == value)
    if "count" in columns:
        return source.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("count"))
    return source.agg(_count().alias("count"))


def latest(source: DataFrame, path: str | None = None, value: str | None = None) -> DataFrame:
    """Newest time seen, from events, an index or a rollup, optionally of one group."""
    columns = set(source.columns)
    rolled = {"field_name", "bucket_seconds"} <= columns
    if path is not None and "field_name" in columns:
        source = source.where((F.col("field_name") == path) & (F.col("value") == value))
        if rolled:
            source = source.where(F.col("bucket_seconds") == 60)
    elif path is not None:
        source = source.where(Fields(source, derived_signal=True).string(facet_path(path)) == value)
    time = "bucket_time" if rolled or "timestamp" not in columns else "timestamp"
    return source.agg(F.max(time).alias("last_created_at"))


def distinct_rollups(events: DataFrame, paths: Sequence[str], seconds: int = 86_400) -> DataFrame:
    """How many different values each path takes, per tenant and interval, as states that merge.

    One pass for all paths; a state is of bounded size, so a hot tenant or value leaves one
    small row per task.
    """
    parsed = shred(events, paths)
    fields = Fields(parsed)
    pairs = F.array(*[F.struct(F.lit(p).alias("field_name"), fields.string(p).alias("value")) for p in paths])
    rows = parsed.select(
        "tenant_id", bucket(F.col("timestamp"), seconds).alias("bucket_time"),
        F.explode(F.filter(pairs, lambda pair: pair["value"] != "")).alias("pair"),
    ).select("tenant_id", "bucket_time", "pair.*")
    return rows.groupBy("tenant_id", "field_name", "bucket_time").agg(
        _count().alias("count"), distinct_state("value").alias("state")
    )


def distinct_over(rollups: DataFrame, seconds: int, keys: Sequence[str] = ("tenant_id", "field_name")) -> DataFrame:
    """Different values over wider intervals (or fewer keys), from the states alone.

    ``distinct_values`` is an estimate within ``ERROR_BOUND`` of the count.
    """
    wide = rollups.withColumn("bucket_time", bucket(F.col("bucket_time"), seconds))
    return wide.groupBy(*keys, "bucket_time").agg(F.sum("count").alias("count"), united("state").alias("state")).select(
        *keys, "bucket_time", "count", estimate("state").alias("distinct_values"), "state"
    )
