"""The reports and funnels of the standard dashboard pack that need more fields than the stream table has.

The fields are derived from the events' own columns, in the payload here and in the SQL there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dashboards
from tidemark.sources.star import events
from workload.registry import big, ms, query
from workload.reports import STEPS, _funnel_sql

# Field: (values by a remainder of the event's or user's number, of which, only for these events).
FIELDS = {
    "http.method": (("GET", "POST", "PUT"), "n", ""),
    "severity_text": (("INFO", "WARN", "ERROR", ""), "n", ""),
    "logger.name": (("app", "db"), "n", "n % 3 = 0"),
    "metric_name": (("latency", "load", "depth", "rate", "size"), "n", "n % 4 <> 1"),
    "page_path": (("/", "/buy", "/help"), "n", "event_type = 'view'"),
    "screen_name": (("home", "cart"), "n", "event_type = 'click'"),
    "product_id": (("p0", "p1", "p2", "p3", "p4", "p5"), "n", "event_type = 'purchase'"),
    "experiment_id": (("e1", "e2", ""), "u", ""),
    "variant": (("control", "test"), "u", "u % 5 <> 0"),
    "device_type": (("phone", "desktop", "tablet"), "u", ""),
    "browser": (("one", "two", "three", ""), "u", ""),
    "os": (("x", "y"), "u", ""),
    "device_id": (tuple(f"d{k}" for k in range(37)), "u", ""),
}


def _name(field: str) -> str:
    return field.replace(".", "_")


def pack_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the pack's fields in their payloads; a field is missing where its condition fails."""
    rows = events(spark, sf_dir)
    number = {"n": F.col("source_offset"), "u": F.regexp_extract(F.get_json_object("data", "$.user_id"), r"(\d+)", 1).cast("bigint")}
    rows = rows.withColumns(number)

    def member(field: str) -> Column:
        values, which, only = FIELDS[field]
        chosen = F.get(F.array(*map(F.lit, values)), F.pmod(which, F.lit(len(values))).cast("int"))
        return (F.when(F.expr(only), chosen) if only else chosen).alias(field)

    extra = F.to_json(F.struct(*[member(field) for field in FIELDS]))
    data = F.concat(F.expr("left(data, length(data) - 1)"), F.lit(","), extra.substr(F.lit(2), F.length(extra)))
    return rows.withColumn("data", data).drop("n", "u")


def _member_sql(field: str) -> str:
    values, which, only = FIELDS[field]
    chosen = f"[{', '.join(repr(v) for v in values)}][{which} % {len(values)} + 1]"
    return f"{f'CASE WHEN {only} THEN {chosen} END' if only else chosen} AS {_name(field)}"


_FIELDS_SQL = "e AS (SELECT *, " + ", ".join(_member_sql(f) for f in FIELDS) + " FROM (SELECT *, CAST(substr(user_id, 2) AS BIGINT) AS u FROM ev))"


def _report(name: str, report: str, sql: str, seconds: int = 86_400) -> None:
    wanted = dashboards.report_named(report)
    dims = [_name(p) for p in wanted.group_by]
    keys = ", ".join(["tenant_id", *dims])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dashboards.run_report(pack_events(spark, sf_dir), wanted, seconds)
        value = F.round(F.col("value").cast("double"), 6).alias("value")
        return rows.select("tenant_id", ms("bucket_time").alias("bucket_ms"), *dims, value)

    width = seconds * 1000
    filled = "".join(f" AND {d} <> ''" for d in dims)
    query(
        name,
        f"""WITH {{EV}}, {_FIELDS_SQL}, grouped AS (
          SELECT {keys}, ms // {width} * {width} AS bucket_ms, round(CAST({sql} AS DOUBLE), 6) AS value
          FROM e WHERE TRUE{filled} GROUP BY {keys}, ms // {width})
        SELECT * FROM grouped WHERE value IS NOT NULL""",
    )(run)


_FAILED = "count(*) FILTER (failed)"
_report("dashboard_erroring_traces", "Erroring Traces Over Time", _FAILED)
_report("dashboard_method_volume", "Request Volume By Method", "count(*)", 3600)
_report("dashboard_severities", "Log Volume By Severity", "count(*)", 3600)
_report("dashboard_loggers", "Log Volume By Logger", "count(*)", 3600)
_report("dashboard_metric_volume", "Metric Volume By Metric Name", "count(*)", 3600)
_report("dashboard_metric_p95", "Metric Value P95 By Metric Name", "quantile_cont(value, 0.95)")
_report("dashboard_pages", "Events By Page Path", "count(*)", 3600)
_report("dashboard_screens", "Events By Screen Name", "count(*)", 3600)
_report("dashboard_product_revenue", "Revenue By Product", "sum(value) FILTER (event_type = 'purchase')", 3600)
_report("dashboard_variants", "Variant Split", "count(*)", 3600)
_report("dashboard_variant_errors", "Error Rate By Variant", f"{_FAILED} / count(*)")
_report("dashboard_device_types", "Volume By Device Type", "count(*)", 3600)
_report("dashboard_browsers", "Volume By Browser", "count(*)", 3600)
_report("dashboard_systems", "Volume By OS", "count(*)", 3600)


def _funnel(name: str, entity: str) -> None:
    column = dashboards.STANDARD_ENTITIES[entity]
    sql = _funnel_sql("tenant_id", "0", "tenant_id").replace("tenant_id, user_id", f"tenant_id, {column}")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dashboards.standard_funnel(pack_events(spark, sf_dir), entity, STEPS).select(
            "tenant_id", big("step_index").alias("step_index"), "step_name", "entity_count", "conversion_count"
        )

    query(name, sql.replace("FROM ev", "FROM e").replace("WITH {EV},", f"WITH {{EV}}, {_FIELDS_SQL},"))(run)


_funnel("dashboard_user_funnel", "User")
_funnel("dashboard_account_funnel", "Account")
_funnel("dashboard_device_funnel", "Device")
_funnel("dashboard_trace_funnel", "Trace")
