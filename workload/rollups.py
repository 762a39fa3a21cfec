"""Density, field rollups, groups, summaries, latest values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import indexes, rollups
from tidemark.sources.star import events, flat_events, load
from workload.filters import field_definitions
from workload.registry import big, money, ms, query


@query(
    "event_density_1s",
    """WITH {EV} SELECT tenant_id, ms // 1000 * 1000 AS bucket_ms, count(*) AS count,
    count(*) FILTER (flagged) AS error_count FROM ev GROUP BY ALL""",
)
def event_density_1s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.event_density(flat_events(spark, sf_dir)).select(
        "tenant_id", ms("bucket_time").alias("bucket_ms"), "count", "error_count"
    )


@query(
    "event_density_daily",
    """WITH {EV} SELECT tenant_id, strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS count,
    count(*) FILTER (failed) AS error_count FROM ev GROUP BY ALL""",
)
def event_density_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = rollups.event_density(flat_events(spark, sf_dir), 86_400, "materializer")
    return daily.select(
        "tenant_id", F.date_format("bucket_time", "yyyy-MM-dd").alias("day"), "count", "error_count"
    )


@query(
    "field_rollups",
    """WITH {EV}, d AS (
      SELECT tenant_id, ms, flagged, signal, value AS v, unnest([
        {'f': 'signal', 'v': signal}, {'f': 'event_type', 'v': event_type},
        {'f': 'name', 'v': name}, {'f': 'service', 'v': service},
        {'f': 'environment', 'v': environment},
        {'f': 'is_error', 'v': CAST(CAST(flagged AS INTEGER) AS VARCHAR)}]) AS x FROM ev),
    r AS (SELECT *, unnest([1, 60]) AS bucket_seconds FROM d)
    SELECT tenant_id, x.f AS field_name, x.v AS value, CAST(bucket_seconds AS BIGINT) AS bucket_seconds,
      ms // (bucket_seconds * 1000) * (bucket_seconds * 1000) AS bucket_ms,
      count(*) AS count, count(*) FILTER (flagged) AS error_count,
      count(*) FILTER (signal = 'analytics') AS analytics_count,
      count(*) FILTER (v > 0) AS duration_count, round(sum(v), 4) AS duration_sum
    FROM r GROUP BY ALL""",
)
def field_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.field_rollups(flat_events(spark, sf_dir)).select(
        "tenant_id", "field_name", "value", big("bucket_seconds").alias("bucket_seconds"),
        ms("bucket_time").alias("bucket_ms"), "count", "error_count", "analytics_count",
        "duration_count", money("duration_sum").alias("duration_sum"),
    )


_NICE = """[1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 15000, 30000, 60000,
  120000, 300000, 600000, 900000, 1800000, 3600000, 7200000, 21600000, 43200000, 86400000,
  604800000]"""
_WIDTH = f"""w AS (SELECT list_filter({_NICE}, lambda i: i >= greatest(span // 120, floor_ms))[1] AS width
  FROM (SELECT greatest(max(ms) - min(ms), 1) AS span, any_value(floor_ms) AS floor_ms FROM src))"""


@query(
    "density_histogram",
    "WITH {EV}, src AS (SELECT ms, failed, 1 AS floor_ms FROM ev), " + _WIDTH + """
    SELECT ms // width * width AS bucket, count(*) AS count,
      count(*) FILTER (failed) AS error_count FROM src, w GROUP BY ms // width * width""",
)
def density_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.density(flat_events(spark, sf_dir), 120)


@query(
    "density_histogram_from_rollup",
    """WITH {EV}, src AS (SELECT ms // 1000 * 1000 AS ms, flagged, 1000 AS floor_ms FROM ev), """
    + _WIDTH
    + """
    SELECT ms // width * width AS bucket, count(*) AS count,
      count(*) FILTER (flagged) AS error_count FROM src, w GROUP BY ms // width * width""",
)
def density_histogram_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.density(rollups.event_density(flat_events(spark, sf_dir)), 120)


def _shape(df: DataFrame) -> DataFrame:
    return df.select(
        "value", ms("started_at").alias("started_ms"), ms("ended_at").alias("ended_ms"),
        "duration_ms", "count", "error_count",
    )


@query(
    "groups_raw",
    """WITH {EV} SELECT session_id AS value, min(ms) AS started_ms, max(ms) AS ended_ms,
    max(ms) - min(ms) AS duration_ms, count(*) AS count, count(*) FILTER (failed) AS error_count
    FROM ev GROUP BY session_id ORDER BY count DESC, error_count DESC, value LIMIT 100""",
)
def groups_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(rollups.groups(events(spark, sf_dir), "session_id"))


@query(
    "groups_identifier_index",
    """WITH {EV} SELECT trace_id AS value, min(ms) AS started_ms, max(ms) AS ended_ms,
    max(ms) - min(ms) AS duration_ms, count(*) AS count, count(*) FILTER (flagged) AS error_count
    FROM ev GROUP BY trace_id ORDER BY ended_ms DESC, count DESC, error_count DESC, value
    LIMIT 50 OFFSET 20""",
)
def groups_identifier_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = indexes.field_values(events(spark, sf_dir))
    return _shape(rollups.groups(values, "traceId", "recent", limit=50, offset=20))


@query(
    "groups_field_index",
    """WITH {EV}, t AS (
      SELECT plan AS value, event_id, ms, failed FROM ev WHERE NOT flagged
      UNION ALL SELECT event_type, event_id, ms, failed FROM ev WHERE NOT flagged)
    SELECT value, min(ms) AS started_ms, max(ms) AS ended_ms, max(ms) - min(ms) AS duration_ms,
      count(DISTINCT event_id) AS count, count(*) FILTER (failed) AS error_count
    FROM t GROUP BY value""",
)
def groups_field_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indexes.field_index(events(spark, sf_dir), field_definitions())
    return _shape(rollups.groups(index, "tag", "duration"))


@query(
    "groups_rollup",
    """WITH {EV} SELECT service AS value, min(ms // 60000 * 60000) AS started_ms,
    max(ms // 60000 * 60000) AS ended_ms,
    max(ms // 60000 * 60000) - min(ms // 60000 * 60000) AS duration_ms,
    count(*) AS count, count(*) FILTER (flagged) AS error_count FROM ev GROUP BY service""",
)
def groups_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(rollups.groups(rollups.field_rollups(flat_events(spark, sf_dir)), "service", "value"))


# Declared fields come from the parts: every brand is a field definition.
@query(
    "group_options",
    """WITH fixed AS (
      SELECT unnest(['signal', 'event_type', 'name', 'service', 'environment', 'is_error']) AS path,
        'builtin' AS source, 'rollup' AS mode, TRUE AS agg, FALSE AS idx, 1 AS p
      UNION ALL SELECT unnest(['trace_id', 'span_id', 'request_id', 'user_id', 'anonymous_id',
        'account_id', 'session_id', 'group_id', 'organization_id', 'thread_id',
        'conversation_id']), 'builtin', 'index', FALSE, TRUE, 2
      UNION ALL SELECT unnest(['signal', 'event_type', 'name', 'service', 'environment', 'is_error',
        'http.method', 'http.route', 'http.status_code', 'http.response.status_code',
        'severity_text', 'severity_number', 'llm.model', 'llm.provider', 'tool_name', 'plan',
        'country', 'region', 'user_group', 'user_id', 'account_id', 'anonymous_id', 'session_id',
        'group_id', 'organization_id', 'thread_id', 'conversation_id', 'request_id', 'duration_ms',
        'metric_name', 'metric_type', 'metric_unit', 'metric_value', 'revenue', 'currency']),
        'raw', 'raw', FALSE, FALSE, 4
      UNION ALL SELECT DISTINCT p_brand, 'definition', 'index', TRUE, TRUE, 3 FROM part
      UNION ALL SELECT DISTINCT 'brand.' || p_size, 'definition', 'index', TRUE, TRUE, 3 FROM part)
    SELECT path, arg_min(source, p) AS source, arg_min(mode, p) AS serving_mode,
      bool_or(agg) AS aggregate_enabled, bool_or(idx) AS index_enabled
    FROM fixed GROUP BY path""",
)
def group_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    output = F.struct(
        F.concat(F.lit("brand."), F.col("p_size").cast("string")).alias("field_name"),
        F.lit("number").alias("value_type"),
    )
    definitions = part.select(
        F.lit("field").alias("kind"),
        F.col("p_brand").alias("name"),
        F.to_json(F.struct(F.array(output).alias("outputs"))).alias("config"),
        F.lit(True).alias("enabled"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    return rollups.group_options(spark, definitions, limit=100_000).select(
        "path", "source", "serving_mode", "aggregate_enabled", "index_enabled"
    )


@query(
    "summary",
    """WITH {EV} SELECT 'all' AS what, count(*) AS count FROM ev
    UNION ALL SELECT 'service', count(*) FROM ev WHERE service = 'svc1'
    UNION ALL SELECT 'country', count(*) FROM ev WHERE country = 'FR'
    UNION ALL SELECT 'density', count(*) FROM ev""",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    parts = {
        "all": rollups.summary(e),
        "service": rollups.summary(rollups.field_rollups(e), "service", "svc1"),
        "country": rollups.summary(e, "country", "FR"),
        "density": rollups.summary(rollups.event_density(e)),
    }
    result = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("what"), "count")
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "latest",
    """WITH {EV} SELECT 'all' AS what, max(ms) AS ms FROM ev
    UNION ALL SELECT 'rollup', max(ms // 60000 * 60000) FROM ev WHERE service = 'svc2'
    UNION ALL SELECT 'index', max(ms) FROM ev WHERE user_id = 'u7'
    UNION ALL SELECT 'raw', max(ms) FROM ev WHERE plan = 'pro'""",
)
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    parts = {
        "all": rollups.latest(e),
        "rollup": rollups.latest(rollups.field_rollups(e), "service", "svc2"),
        "index": rollups.latest(indexes.field_values(e), "user_id", "u7"),
        "raw": rollups.latest(e, "plan", "pro"),
    }
    result = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("what"), ms("last_created_at").alias("ms"))
        result = part if result is None else result.unionByName(part)
    return result
