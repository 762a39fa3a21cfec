"""The standard dashboard pack: named summary reports and funnels by entity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.events import bucket, is_error
from tidemark.functions.paths import Fields, shred
from tidemark.functions.quantiles import exact_percentiles, sketch, sketch_percentiles
from tidemark.operators.sequences import Step, funnel


@dataclass(frozen=True)
class Report:
    """A metric per bucket and dimensions. ``metric``: count, error_count, error_rate,
    trace_count, count_distinct (of the dimension) or ``path.sum|p95|p99``."""

    name: str
    group_by: tuple[str, ...]
    metric: str
    bucket: str = "5m"


_SECONDS = {"1s": 1, "1m": 60, "5m": 300, "1h": 3600, "1d": 86_400}

# The standard reports.
STANDARD_REPORTS = (
    Report("Event Volume Over Time", ("signal",), "count"),
    Report("Error Rate Over Time", ("service",), "error_rate"),
    Report("Top Services", ("service",), "count"),
    Report("Top Event Types", ("event_type",), "count"),
    Report("Top Names", ("name",), "count"),
    Report("Top Environments", ("environment",), "count"),
    Report("Global Density Histogram", (), "count", "1s"),
    Report("Error Density Histogram", (), "error_count", "1s"),
    Report("Trace Count Over Time", ("service",), "trace_count"),
    Report("Erroring Traces Over Time", ("service",), "error_count"),
    Report("Span Duration P95 By Service", ("service",), "duration_ms.p95"),
    Report("Span Duration P99 By Service", ("service",), "duration_ms.p99"),
    Report("Span Duration P95 By Name", ("name",), "duration_ms.p95"),
    Report("Status Code Distribution", ("http.response.status_code",), "count"),
    Report("Request Volume By Route", ("http.route",), "count"),
    Report("Request Volume By Method", ("http.method",), "count"),
    Report("Error Rate By Route", ("http.route",), "error_rate"),
    Report("Log Volume By Severity", ("severity_text",), "count"),
    Report("Log Volume By Logger", ("logger.name",), "count"),
    Report("Metric Volume By Metric Name", ("metric_name",), "count"),
    Report("Metric Value P95 By Metric Name", ("metric_name",), "metric_value.p95"),
    Report("Active Users Over Time", ("user_id",), "count_distinct", "1h"),
    Report("Active Sessions Over Time", ("session_id",), "count_distinct", "1h"),
    Report("Events By Page Path", ("page_path",), "count"),
    Report("Events By Screen Name", ("screen_name",), "count"),
    Report("Revenue Over Time", ("currency",), "revenue.sum", "1h"),
    Report("Revenue By Product", ("product_id",), "revenue.sum", "1h"),
    Report("Variant Split", ("experiment_id", "variant"), "count", "1h"),
    Report("Error Rate By Variant", ("experiment_id", "variant"), "error_rate", "1h"),
    Report("Volume By Country", ("country",), "count", "1h"),
    Report("Volume By Device Type", ("device_type",), "count", "1h"),
    Report("Volume By Browser", ("browser",), "count", "1h"),
    Report("Volume By OS", ("os",), "count", "1h"),
)

# The entities a standard funnel exists for.
STANDARD_ENTITIES = {
    "User": "user_id",
    "Session": "session_id",
    "Account": "account_id",
    "Device": "device_id",
    "Trace": "trace_id",
}


def report_named(name: str) -> Report:
    return next(report for report in STANDARD_REPORTS if report.name == name)


def run_report(
    events: DataFrame, report: Report, seconds: int | None = None, quantiles: str = "exact"
) -> DataFrame:
    """One standard report: ``bucket_time``, the dimensions (dots as underscores) and
    ``value``. Rows where a dimension is missing are left out.

    ``quantiles="sketch"`` estimates percentiles in one aggregation (KLL), which suits
    thousands of small groups.
    """
    if quantiles not in ("exact", "sketch"):
        raise ValueError(f"quantiles are exact or by sketch, not {quantiles!r}")
    path, _, statistic = report.metric.rpartition(".")
    width = seconds or _SECONDS[report.bucket]
    parsed = shred(events, [*report.group_by, *([path] if path else [])])
    fields = Fields(parsed, derived_signal=True)
    names = {p: p.replace(".", "_") for p in report.group_by}
    columns = [
        "tenant_id",
        bucket(F.col("timestamp"), width).alias("bucket_time"),
        *[fields.string(p).alias(names[p]) for p in report.group_by],
        is_error(events).cast("bigint").alias("error"),
        F.col("trace_id").alias("trace"),
    ]
    if path:
        columns.append(fields.number(path).alias("measured"))
    rows = parsed.select(*columns)
    for name in names.values():
        rows = rows.where(F.col(name) != "")
    keys = ["tenant_id", "bucket_time", *names.values()]
    if report.metric == "count_distinct":
        return rows.groupBy("tenant_id", "bucket_time").agg(
            F.countDistinct(*names.values()).alias("value")
        )
    if statistic in ("p95", "p99"):
        p = {"p95": 0.95, "p99": 0.99}[statistic]
        if quantiles == "sketch":
            states = rows.where(F.col("measured").isNotNull()).groupBy(*keys).agg(sketch("measured").alias("state"))
            return states.select(*keys, *[q.alias("value") for q in sketch_percentiles("state", [p])])
        result = exact_percentiles(rows, keys, "measured", [p])
        return result.withColumnRenamed(statistic, "value")
    if report.metric == "trace_count":
        value = F.countDistinct(F.nullif("trace", F.lit("")))
    else:
        value = {
            "count": F.count(F.lit(1)),
            "error_count": F.sum("error"),
            "error_rate": F.sum("error") / F.count(F.lit(1)),
            "sum": F.sum("measured") if path else None,
        }[statistic]
    grouped = rows.groupBy(*keys).agg(value.alias("value"))
    return grouped.where(F.col("value").isNotNull())


def standard_funnel(
    events: DataFrame, entity: str, steps: list[Step], seconds: int | None = None
) -> DataFrame:
    """The standard funnel for one of the five entities."""
    return funnel(events, steps, STANDARD_ENTITIES[entity], bucket_seconds=seconds)
