"""Reports, traces, funnels, cohorts, retention, state, dashboards, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import (
    alerts,
    cohorts,
    dashboards,
    measures,
    pages,
    reports,
    sequences,
    states,
    traces,
    usage,
)
from tidemark.plans.definitions import Definition
from tidemark.sources.star import events, flat_events, order_events, span_events, turn_events
from workload.measures import DAY, cube_definitions, dimension, measure_definitions, path
from workload.registry import TENANTS, big, money, ms, query


def report_definitions() -> list[Definition]:
    found = []
    for tenant in TENANTS:
        found.append(
            Definition(
                "r.sales",
                "report",
                {
                    "match": {"all": [{"path": "event_type", "op": "in", "value": ["purchase", "click"]}]},
                    "outputs": [
                        {
                            "report_id": "sales",
                            "dimensions": [dimension("plan", "plan"), dimension("currency", "currency")],
                            "metrics": [
                                {"name": "orders", "op": "count"},
                                {"name": "failed", "op": "error_count"},
                                {"name": "revenue", "op": "sum", "value": path("revenue")},
                            ],
                            "bucket_seconds": DAY,
                        }
                    ],
                },
                tenant,
                "sales",
                "summary",
                4,
            )
        )
        found.append(
            Definition(
                "r.errors",
                "report",
                {"outputs": [{"dimensions": [dimension("service", "service")], "bucket_seconds": DAY}]},
                tenant,
                "errors",
                "summary",
                1,
            )
        )
    return found


def _report_rows(rows: DataFrame) -> DataFrame:
    dims, metrics = F.col("dimensions"), F.col("metrics")
    text = lambda c: F.coalesce(dims[c], F.lit(""))
    number = lambda c: F.round(metrics[c], 4).alias(c)
    return rows.select(
        "tenant_id", "report_id", big("report_version").alias("version"),
        ms("bucket_time").alias("bucket_ms"), text("plan").alias("plan"),
        text("currency").alias("currency"), text("service").alias("service"),
        *[number(c) for c in ("orders", "failed", "revenue", "events", "errors",
                              "source_events", "bucket_seconds")],
    )


_REPORTS = """r AS (
  SELECT tenant_id, 'sales' AS report_id, 4 AS version, ms // 86400000 * 86400000 AS bucket_ms, plan,
    currency, '' AS service, CAST(count(*) AS DOUBLE) AS orders,
    CAST(count(*) FILTER (failed) AS DOUBLE) AS failed,
    round(sum(value) FILTER (currency <> ''), 4) AS revenue, CAST(NULL AS DOUBLE) AS events,
    CAST(NULL AS DOUBLE) AS errors, CAST(count(*) AS DOUBLE) AS source_events,
    CAST(86400 AS DOUBLE) AS bucket_seconds
  FROM ev WHERE event_type IN ('purchase', 'click') GROUP BY tenant_id, ms // 86400000, plan, currency
  UNION ALL SELECT tenant_id, 'errors', 1, ms // 86400000 * 86400000, '', '', service, NULL, NULL,
    NULL, count(*), count(*) FILTER (failed), count(*), 86400
  FROM ev GROUP BY tenant_id, ms // 86400000, service)"""


@query(
    "report_summary",
    "WITH {EV}, " + _REPORTS + " SELECT * REPLACE (CAST(version AS BIGINT) AS version) FROM r",
)
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_rows(reports.report_summary(events(spark, sf_dir), report_definitions()))


@query(
    "report_query",
    "WITH {EV}, " + _REPORTS + """ SELECT tenant_id, bucket_ms, currency, orders, revenue FROM r
    WHERE report_id = 'sales' AND plan = 'pro'
      AND bucket_ms >= epoch_ms(TIMESTAMP '2024-01-10')""",
)
def report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = reports.report_summary(events(spark, sf_dir), report_definitions())
    rows = reports.report_query(
        stored, "sales", version=4, start="2024-01-10T00:00:00Z", filters={"plan": "pro"},
    )
    return _report_rows(rows).select("tenant_id", "bucket_ms", "currency", "orders", "revenue")


@query(
    "result_dimension_filter",
    "WITH {EV}, " + _REPORTS + """ SELECT report_id, tenant_id, bucket_ms, plan, source_events
    FROM r WHERE currency = 'EUR'""",
)
def result_dimension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.filters import filter_dimensions

    stored = reports.report_summary(events(spark, sf_dir), report_definitions())
    return _report_rows(filter_dimensions(stored, {"currency": "EUR"})).select(
        "report_id", "tenant_id", "bucket_ms", "plan", "source_events"
    )


@query(
    "report_catalogue",
    "WITH {EV}, " + _REPORTS + """ SELECT tenant_id, report_id AS id, min(bucket_ms) AS first_ms,
    max(bucket_ms) AS last_ms, count(*) AS rows, CAST(max(version) AS BIGINT) AS latest_version
    FROM r GROUP BY tenant_id, report_id""",
)
def report_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = reports.report_summary(events(spark, sf_dir), report_definitions())
    return reports.catalogue(stored, "report").select(
        "tenant_id", "id", ms("first_time").alias("first_ms"), ms("last_time").alias("last_ms"),
        "rows", "latest_version",
    )


# Traces.
def trace_definitions() -> list[Definition]:
    return [
        Definition(
            "r.traces", "report",
            {"outputs": [{"report_id": "traces", "bucket_seconds": 3600,
                          "dimensions": [dimension("plan", "plan")]}]},
            tenant, "traces", "trace_summary", 1,
        )
        for tenant in TENANTS
    ]


@query(
    "trace_summary",
    """WITH {EV} SELECT tenant_id, trace_id, ms // 3600000 * 3600000 AS bucket_ms,
    arg_min(plan, timestamp) AS plan,
    coalesce(max(name) FILTER (parent_span_id = ''), '') AS root_name,
    coalesce(max(service) FILTER (parent_span_id = ''), '') AS root_service,
    CAST(max(ms) - min(ms) AS DOUBLE) AS duration_ms, CAST(count(*) AS DOUBLE) AS event_count,
    CAST(count(*) FILTER (failed) AS DOUBLE) AS errors
    FROM ev GROUP BY tenant_id, trace_id, ms // 3600000""",
)
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces.trace_summary(events(spark, sf_dir), trace_definitions())
    dims, metrics = F.col("dimensions"), F.col("metrics")
    return rows.select(
        "tenant_id", dims["trace_id"].alias("trace_id"), ms("bucket_time").alias("bucket_ms"),
        dims["plan"].alias("plan"),
        F.coalesce(dims["root_name"], F.lit("")).alias("root_name"),
        F.coalesce(dims["root_service"], F.lit("")).alias("root_service"),
        metrics["duration_ms"].alias("duration_ms"), metrics["event_count"].alias("event_count"),
        metrics["errors"].alias("errors"),
    )


_SPANS = """sp AS (
  SELECT event_id AS n, 't' || (event_id // 8 % 4) AS tenant_id, 't' || (event_id // 8) AS trace_id,
    's' || event_id AS span_id, CASE WHEN event_id % 8 <> 0 THEN 's' || (event_id - 1) ELSE '' END
      AS parent_span_id, 'svc' || (event_id % 5) AS service, event_type AS name, ts,
    event_id % 3 = 0 AS open, CAST(round(value * 1000000) AS BIGINT) AS us,
    epoch_us(ts) AS start_us, event_type = 'error' AS bad FROM events)"""


@query(
    "merged_spans",
    "WITH " + _SPANS + """ SELECT tenant_id, trace_id, span_id, parent_span_id, service, name,
    start_us // 1000 AS started_ms, CASE WHEN open THEN NULL ELSE (start_us + us) // 1000 END
      AS ended_ms, open, CASE WHEN open THEN NULL ELSE us / 1000.0 END AS duration_ms,
    (bad AND NOT open) AS is_error,
    CASE WHEN open THEN 'start' ELSE 'end' END AS phase, TRUE AS begun FROM sp""",
)
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.merge_spans(span_events(spark, sf_dir)).select(
        "tenant_id", "trace_id", "span_id", "parent_span_id", "service", "name",
        ms("started_at").alias("started_ms"), ms("ended_at").alias("ended_ms"), "open",
        "duration_ms", "is_error", F.get_json_object("data", "$.phase").alias("phase"),
        (F.get_json_object("data", "$.begun") == "true").alias("begun"),
    )


@query(
    "span_depth",
    """WITH {EV} SELECT tenant_id, span_id, CAST(depth AS BIGINT) AS depth FROM (
      SELECT tenant_id, span_id,
        -- a parent in another tenant is unknown: depth restarts there
        n - max(CASE WHEN n % 8 = 0 OR prev <> tenant_id THEN n END)
          OVER (PARTITION BY trace_id ORDER BY n) AS depth
      FROM (SELECT *, lag(tenant_id) OVER (PARTITION BY trace_id ORDER BY n) AS prev FROM ev))""",
)
def span_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.span_depth(flat_events(spark, sf_dir)).select(
        "tenant_id", "span_id", big("depth").alias("depth")
    )


@query(
    "trace_timeline",
    """WITH {EV} SELECT event_id, ms, span_id, parent_span_id, name, value AS duration_ms,
    '' AS start_time FROM ev WHERE trace_id = 't7'""",
)
def trace_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.trace_timeline(events(spark, sf_dir), "t7").select(
        "event_id", ms("timestamp").alias("ms"), "span_id", "parent_span_id", "name",
        "duration_ms", "start_time",
    )


@query(
    "flamegraph",
    "WITH " + _SPANS + """, ends AS (
      SELECT *, max(greatest(start_us // 1000, CASE WHEN open THEN 0 ELSE (start_us + us) // 1000 END))
        OVER (PARTITION BY trace_id) AS newest FROM sp),
    bars AS (SELECT *, start_us // 1000 AS start_ms,
      CASE WHEN open THEN newest ELSE (start_us + us) // 1000 END AS end_ms FROM ends)
    SELECT tenant_id, trace_id, span_id, name AS label, start_ms, end_ms, FALSE AS marker,
      CAST(n % 8 AS BIGINT) AS lane, min(start_ms) OVER (PARTITION BY trace_id) AS min_start_ms,
      max(end_ms) OVER (PARTITION BY trace_id) AS max_end_ms
    FROM bars WHERE end_ms > start_ms""",
)
def flamegraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.flamegraph(span_events(spark, sf_dir)).select(
        "tenant_id", "trace_id", "span_id", "label", "start_ms", "end_ms", "marker",
        big("lane").alias("lane"), "min_start_ms", "max_end_ms",
    )


@query(
    "conversation_timelines",
    """SELECT CAST(conv_id AS VARCHAR) AS trace_id, CAST(turn AS BIGINT) AS depth, role, count(*) AS events
    FROM conversations GROUP BY conv_id, turn, role""",
)
def conversation_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_events(spark, sf_dir)
    depth = traces.span_depth(turns)
    return (
        turns.join(depth, traces.SPAN_KEY)
        .groupBy("trace_id", big("depth").alias("depth"), F.col("name").alias("role"))
        .agg(F.count(F.lit(1)).alias("events"))
    )


# Funnels. The SQL walks the greedy steps as a chain of earliest later times.
STEPS = [
    sequences.Step(name, {"all": [{"path": "event_type", "value": name}]})
    for name in ("view", "click", "purchase")
]


def _funnel_sql(keys: str, bucket_sql: str, names: str) -> str:
    using = f"{keys}, user_id"
    return f"""WITH {{EV}}, b AS (SELECT *, {bucket_sql} AS bucket_ms FROM ev),
    s0 AS (SELECT {using}, min(timestamp) AS t FROM b WHERE event_type = 'view' GROUP BY ALL),
    s1 AS (SELECT {using}, min(timestamp) AS t FROM b JOIN s0 USING ({using})
      WHERE event_type = 'click' AND timestamp >= s0.t GROUP BY ALL),
    s2 AS (SELECT {using}, min(timestamp) AS t FROM b JOIN s1 USING ({using})
      WHERE event_type = 'purchase' AND timestamp >= s1.t GROUP BY ALL),
    c AS (SELECT {keys}, 0 AS i, 'view' AS step_name, count(*) AS n FROM s0 GROUP BY ALL
      UNION ALL SELECT {keys}, 1, 'click', count(*) FROM s1 GROUP BY ALL
      UNION ALL SELECT {keys}, 2, 'purchase', count(*) FROM s2 GROUP BY ALL)
    SELECT {names}, CAST(i AS BIGINT) AS step_index, step_name, n AS entity_count,
      coalesce(lead(n) OVER (PARTITION BY {keys} ORDER BY i), n) AS conversion_count FROM c"""


@query(
    "funnel_by_day",
    _funnel_sql("tenant_id, bucket_ms, plan", "ms // 86400000 * 86400000", "tenant_id, bucket_ms, plan"),
)
def funnel_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.funnel(
        events(spark, sf_dir), STEPS, "user_id", {"plan": "plan"}, bucket_seconds=DAY
    ).select(
        "tenant_id", ms("bucket_time").alias("bucket_ms"), "plan",
        big("step_index").alias("step_index"), "step_name", "entity_count", "conversion_count",
    )


@query(
    "funnel_whole_range",
    _funnel_sql("tenant_id, country", "0", "tenant_id, country"),
)
def funnel_whole_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.funnel(
        events(spark, sf_dir), STEPS, "user_id", {"country": "country"}
    ).select(
        "tenant_id", "country", big("step_index").alias("step_index"), "step_name",
        "entity_count", "conversion_count",
    )


def sequence_definitions() -> list[Definition]:
    return [
        Definition(
            "s.buy",
            "sequence",
            {
                "match": {"all": [{"path": "user_id", "op": "exists"}]},
                "outputs": [
                    {
                        "report_id": "buy",
                        "entity_id": path("user_id"),
                        "dimensions": [dimension("plan", "plan")],
                        "steps": [{"name": s.name, "match": s.match} for s in STEPS],
                        "bucket_seconds": DAY,
                    }
                ],
            },
            tenant,
            "buy",
            "funnel",
            1,
        )
        for tenant in TENANTS
    ]


@query(
    "sequence_report",
    _funnel_sql(
        "tenant_id, bucket_ms, plan", "ms // 86400000 * 86400000",
        "tenant_id, 'buy' AS report_id, bucket_ms, plan",
    ),
)
def sequence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.sequence_report(events(spark, sf_dir), sequence_definitions())
    return rows.select(
        "tenant_id", "report_id", ms("bucket_time").alias("bucket_ms"),
        F.col("segment")["plan"].alias("plan"), big("step_index").alias("step_index"),
        "step_name", "entity_count", "conversion_count",
    )


@query(
    "funnel_query",
    "SELECT bucket_ms, step_index, step_name, CAST(sum(entity_count) AS BIGINT) AS entity_count,"
    " CAST(sum(conversion_count) AS BIGINT) AS conversion_count FROM ("
    + _funnel_sql(
        "tenant_id, bucket_ms, plan", "ms // 86400000 * 86400000", "tenant_id, bucket_ms, plan"
    )
    + """) WHERE plan = 'free' AND bucket_ms <= epoch_ms(TIMESTAMP '2024-01-15')
    GROUP BY bucket_ms, step_index, step_name""",
)
def funnel_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sequences.sequence_report(events(spark, sf_dir), sequence_definitions())
    rows = sequences.funnel_query(
        stored, "buy", version=1, end="2024-01-15T00:00:00Z", filters={"plan": "free"}
    )
    return rows.select(
        ms("bucket_time").alias("bucket_ms"), big("step_index").alias("step_index"), "step_name",
        "entity_count", "conversion_count",
    )


# Cohorts and retention.
def cohort_definitions() -> list[Definition]:
    return [
        Definition(
            "c.buyers",
            "cohort",
            {
                "match": {"all": [{"path": "event_type", "value": "purchase"}]},
                "outputs": [{"entity_type": "user", "entity_id": path("user_id")}],
            },
            tenant,
            "buyers",
            "cohort",
            2,
        )
        for tenant in TENANTS
    ]


@query(
    "cohort_members",
    """WITH {EV} SELECT tenant_id, user_id AS entity_id, min(ms) AS first_ms, max(ms) AS last_ms
    FROM ev WHERE event_type = 'purchase' GROUP BY tenant_id, user_id""",
)
def cohort_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.cohort(events(spark, sf_dir), cohort_definitions()).select(
        "tenant_id", "entity_id", ms("first_seen").alias("first_ms"), ms("last_seen").alias("last_ms")
    )


@query(
    "cohort_query",
    """WITH {EV} SELECT user_id AS entity_id, min(ms) AS first_ms FROM ev
    WHERE event_type = 'purchase' GROUP BY tenant_id, user_id
    ORDER BY min(timestamp), user_id LIMIT 25""",
)
def cohort_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = cohorts.cohort(events(spark, sf_dir), cohort_definitions())
    rows = cohorts.cohort_query(members, "buyers", version=2, entity_type="user", limit=25)
    return rows.select("entity_id", ms("first_seen").alias("first_ms"))


@query(
    "retention",
    """WITH {EV}, m AS (SELECT tenant_id, user_id, min(timestamp) AS joined FROM ev
      WHERE event_type = 'purchase' GROUP BY ALL),
    sizes AS (SELECT tenant_id, count(*) AS size FROM m GROUP BY tenant_id),
    a AS (SELECT ev.tenant_id, ev.user_id, plan, ms // 86400000 * 86400000 AS bucket_ms,
        -- whole seconds, rounded towards zero
        CAST(trunc((epoch_us(timestamp) - epoch_us(joined)) / 1000000.0) AS BIGINT) AS elapsed
      FROM ev JOIN m USING (tenant_id, user_id))
    SELECT tenant_id, bucket_ms, plan, CAST(elapsed // 259200 AS VARCHAR) AS retention_bucket,
      CAST(count(DISTINCT user_id) AS DOUBLE) AS retained, CAST(any_value(size) AS DOUBLE) AS cohort_size,
      round(count(DISTINCT user_id) / any_value(size), 6) AS rate
    FROM a JOIN sizes USING (tenant_id) WHERE elapsed >= 0
    GROUP BY tenant_id, bucket_ms, plan, elapsed // 259200""",
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    definitions = [
        Definition(
            "r.retention",
            "report",
            {
                "outputs": [
                    {
                        "report_id": "retention",
                        "cohort_id": "buyers",
                        "entity_type": "user",
                        "entity_id": path("user_id"),
                        "dimensions": [dimension("plan", "plan")],
                        "bucket_seconds": DAY,
                        "retention_bucket_seconds": 3 * DAY,
                    }
                ]
            },
            tenant,
            "retention",
            "retention",
            1,
        )
        for tenant in TENANTS
    ]
    rows = cohorts.retention(e, definitions, cohorts.cohort(e, cohort_definitions()))
    dims, metrics = F.col("dimensions"), F.col("metrics")
    return rows.select(
        "tenant_id", ms("bucket_time").alias("bucket_ms"), dims["plan"].alias("plan"),
        dims["retention_bucket"].alias("retention_bucket"),
        metrics["retained_users"].alias("retained"), metrics["cohort_size"].alias("cohort_size"),
        F.round(metrics["retention_rate"], 6).alias("rate"),
    )


# Entity state: the status of a customer's newest order.
def state_definitions() -> list[Definition]:
    return [
        Definition(
            "st.order", "state",
            {"path": "order.status", "entity_type": "customer", "entity_id_path": "account_id"},
            tenant, "order_status", "state", 1,
        )
        for tenant in TENANTS
    ]


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.state_updates(order_events(spark, sf_dir), state_definitions())


@query(
    "state_updates",
    """SELECT CAST(o_orderkey AS VARCHAR) AS event_id, 'c' || o_custkey AS entity_id,
    o_orderstatus AS value, epoch_ms(o_orderdate) AS ms FROM orders""",
)
def state_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updates(spark, sf_dir).select(
        "event_id", "entity_id", "value", ms("timestamp").alias("ms")
    )


_NEWEST = "{'t': o_orderdate, 'e': CAST(o_orderkey AS VARCHAR)}"


@query(
    "state_current",
    f"""SELECT 'c' || o_custkey AS entity_id, arg_max(o_orderstatus, {_NEWEST}) AS value,
    epoch_ms(max(o_orderdate)) AS ms FROM orders GROUP BY o_custkey""",
)
def state_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.state_current(_updates(spark, sf_dir)).select(
        "entity_id", "value", ms("timestamp").alias("ms")
    )


@query(
    "state_as_of",
    f"""SELECT 'c' || o_custkey AS entity_id, arg_max(o_orderstatus, {_NEWEST}) AS value,
    arg_max(CAST(o_orderkey AS VARCHAR), {_NEWEST}) AS event_id FROM orders
    WHERE o_orderdate <= TIMESTAMP '1997-06-30' GROUP BY o_custkey
    ORDER BY entity_id""",
)
def state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = states.state_query(
        _updates(spark, sf_dir), "customer", "order_status", as_of="1997-06-30T00:00:00Z",
    )
    return rows.select("entity_id", "value", "event_id")


@query(
    "state_trend",
    """SELECT epoch_ms(date_trunc('week', o_orderdate + INTERVAL 1 DAY) - INTERVAL 1 DAY) AS week_ms,
    o_orderstatus AS value, count(*) AS transitions, count(DISTINCT o_custkey) AS entities
    FROM orders GROUP BY ALL""",
)
def state_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.state_trend(_updates(spark, sf_dir), "order_status").select(
        ms("period").alias("week_ms"), "value", "transitions", "entities"
    )


@query(
    "state_catalogue",
    """SELECT 't' || (o_custkey % 4) AS tenant_id, 'order_status' AS id,
    epoch_ms(min(o_orderdate)) AS first_ms, epoch_ms(max(o_orderdate)) AS last_ms,
    count(*) AS rows, count(DISTINCT o_custkey) AS entities,
    count(DISTINCT o_orderstatus) AS distinct_values FROM orders GROUP BY o_custkey % 4""",
)
def state_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.catalogue(_updates(spark, sf_dir), "state").select(
        "tenant_id", "id", ms("first_time").alias("first_ms"), ms("last_time").alias("last_ms"),
        "rows", "entities", "distinct_values",
    )


# The standard dashboard pack, where the data has the fields.
def _dashboard(name: str, report: str, seconds: int, sql: str) -> None:
    dims = [p.replace(".", "_") for p in dashboards.report_named(report).group_by]
    keys = ", ".join(["tenant_id", *dims])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dashboards.run_report(
            events(spark, sf_dir), dashboards.report_named(report), seconds
        )
        value = F.round(F.col("value").cast("double"), 6).alias("value")
        kept = [c for c in dims if c in rows.columns]
        return rows.select("tenant_id", ms("bucket_time").alias("bucket_ms"), *kept, value)

    width = seconds * 1000
    distinct = "DISTINCT" in sql and "trace" not in sql
    keys = "tenant_id" if distinct else keys
    filled = "".join(f" AND {d} <> ''" for d in dims)
    query(
        name,
        f"""WITH {{EV}}, e AS (SELECT *, '/r' || (k % 10) AS http_route,
          CAST(200 + (k % 4) * 100 AS VARCHAR) AS http_response_status_code FROM ev)
        SELECT {keys}, ms // {width} * {width} AS bucket_ms,
          round(CAST({sql} AS DOUBLE), 6) AS value FROM e WHERE TRUE{filled}
        GROUP BY {keys}, ms // {width}""",
    )(run)


_dashboard("dashboard_event_volume", "Event Volume Over Time", 300, "count(*)")
_dashboard("dashboard_error_rate", "Error Rate Over Time", 3600, "count(*) FILTER (failed) / count(*)")
_dashboard("dashboard_top_services", "Top Services", 300, "count(*)")
_dashboard("dashboard_top_event_types", "Top Event Types", 300, "count(*)")
_dashboard("dashboard_top_names", "Top Names", 300, "count(*)")
_dashboard("dashboard_top_environments", "Top Environments", 300, "count(*)")
_dashboard("dashboard_global_density", "Global Density Histogram", 1, "count(*)")
_dashboard("dashboard_error_density", "Error Density Histogram", 1, "count(*) FILTER (failed)")
_dashboard("dashboard_trace_count", "Trace Count Over Time", 3600, "count(DISTINCT trace_id)")
_dashboard(
    "dashboard_duration_p95_by_service", "Span Duration P95 By Service", DAY,
    "quantile_cont(value, 0.95)",
)
_dashboard("dashboard_duration_p99_by_service", "Span Duration P99 By Service", DAY, "quantile_cont(value, 0.99)")
_dashboard("dashboard_duration_p95_by_name", "Span Duration P95 By Name", DAY, "quantile_cont(value, 0.95)")
_dashboard("dashboard_status_codes", "Status Code Distribution", 3600, "count(*)")
_dashboard("dashboard_route_volume", "Request Volume By Route", 3600, "count(*)")
_dashboard("dashboard_route_error_rate", "Error Rate By Route", DAY, "count(*) FILTER (failed) / count(*)")
_dashboard("dashboard_active_users", "Active Users Over Time", 3600, "count(DISTINCT user_id)")
_dashboard("dashboard_active_sessions", "Active Sessions Over Time", 3600, "count(DISTINCT session_id)")
_dashboard("dashboard_revenue", "Revenue Over Time", 3600, "sum(value)")
_dashboard("dashboard_country_volume", "Volume By Country", 3600, "count(*)")


@query(
    "dashboard_session_funnel",
    _funnel_sql("tenant_id", "0", "tenant_id").replace("user_id", "session_id", 0)
    .replace("tenant_id, user_id", "tenant_id, session_id"),
)
def dashboard_session_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.standard_funnel(events(spark, sf_dir), "Session", STEPS).select(
        "tenant_id", big("step_index").alias("step_index"), "step_name", "entity_count",
        "conversion_count",
    )


# Top entities and thresholds.
@query(
    "top_plans_by_day",
    """WITH {EV}, s AS (SELECT ms // 86400000 * 86400000 AS bucket_ms, plan, sum(value) AS total,
      count(*) AS count FROM ev GROUP BY ALL)
    SELECT bucket_ms, plan, round(total, 4) AS total, count, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY bucket_ms ORDER BY total DESC, plan) AS rank FROM s)
    WHERE rank <= 2""",
)
def top_plans_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = measures.event_measures(events(spark, sf_dir), measure_definitions())
    top = usage.top_entities(points.where(F.col("dimension_name") == "plan"), "latency", DAY, 2)
    return top.select(
        ms("bucket_time").alias("bucket_ms"), F.col("dimension_value").alias("plan"),
        money("total").alias("total"), "count", big("rank").alias("rank"),
    )


@query(
    "error_bursts",
    """WITH {EV} SELECT service, ms // 3600000 * 3600000 AS bucket_ms, count(*) AS count FROM ev
    WHERE flagged GROUP BY service, ms // 3600000 HAVING count(*) >= 2""",
)
def error_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = usage.threshold_windows(
        flat_events(spark, sf_dir), F.col("event_type") == "error", 3600, 2, ["service"]
    )
    return found.select("service", ms("bucket_time").alias("bucket_ms"), "count")


# Alerts with suppression, as a batch.
def alert_rules() -> list[alerts.AlertRule]:
    rules = []
    for tenant in TENANTS:
        rules.append(
            alerts.alert_rule(
                Definition(
                    "a.slow",
                    "alert",
                    {
                        "match": {"all": [{"path": "duration_ms", "op": "gt", "value": 60}]},
                        "severity": "critical",
                        "dedupe_seconds": 3600,
                        "dedupe_key": "service",
                        "message": "slow",
                        "webhook_url": "https://example.com/hook",
                    },
                    tenant,
                    "Slow",
                    "alert",
                    1,
                )
            )
        )
        rules.append(
            alerts.alert_rule(
                Definition(
                    "a.error",
                    "alert",
                    {"match": {"all": [{"op": "is_error", "path": ""}]}, "dedupe_seconds": 0},
                    tenant,
                    "Error",
                    "alert",
                    1,
                )
            )
        )
    return rules


_ALERTS = """al AS (
  SELECT tenant_id, 'a.slow' AS alert_id, service AS key, ms // 3600000 AS slot,
    arg_min(event_id, {'t': timestamp, 'e': event_id}) AS event_id, 'critical' AS severity
  FROM ev WHERE value > 60 GROUP BY tenant_id, service, ms // 3600000
  UNION ALL SELECT tenant_id, 'a.error', event_id, ms, event_id, 'warning' FROM ev WHERE flagged)"""


@query(
    "alert_events",
    "WITH {EV}, " + _ALERTS + " SELECT tenant_id, alert_id, event_id, severity FROM al",
)
def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_events(events(spark, sf_dir), alert_rules()).select(
        "tenant_id", "alert_id", "event_id", "severity"
    )


@query(
    "alert_notifications",
    "WITH {EV}, " + _ALERTS + """ SELECT sha256(tenant_id || chr(0) || alert_id || chr(0) || '1'
      || chr(0) || 'webhook' || chr(0) || tenant_id || ':' || alert_id || ':' || key || ':' || slot
      || chr(0) || event_id) AS notification_id, alert_id, event_id, 'pending' AS status,
      'https://example.com/hook' AS target FROM al WHERE alert_id = 'a.slow'""",
)
def alert_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alerts.alert_events(events(spark, sf_dir), alert_rules())
    return alerts.notification_outbox(found, alert_rules()).select(
        "notification_id", "alert_id", "event_id", "status", "target"
    )


@query(
    "recent_alerts",
    "WITH {EV}, " + _ALERTS + """ SELECT al.alert_id, al.event_id, ev.ms FROM al
    JOIN ev USING (tenant_id, event_id) WHERE al.severity = 'critical'
    ORDER BY ev.timestamp DESC, event_id LIMIT 20""",
)
def recent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alerts.alert_events(events(spark, sf_dir), alert_rules())
    return pages.recent_alerts(found, 20, severity="critical").select(
        "alert_id", "event_id", ms("triggered_at").alias("ms")
    )


# What the serving tables hold.
@query(
    "measure_catalogue",
    """WITH {EV} SELECT ev.tenant_id, 'latency' AS id, min(ms // 86400000 * 86400000) AS first_ms,
      max(ms // 86400000 * 86400000) AS last_ms,
      CASE WHEN max(currency) <> '' THEN 'currency,plan,plan_route' ELSE 'plan,plan_route' END
        AS names,
      CAST(2 * count(*) + count(*) FILTER (currency <> '') AS BIGINT) AS rows
    FROM ev GROUP BY ev.tenant_id""",
)
def measure_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = measures.measure_cube_points(events(spark, sf_dir), cube_definitions())
    return reports.catalogue(points, "cube").select(
        "tenant_id", "id", ms("first_time").alias("first_ms"), ms("last_time").alias("last_ms"),
        F.array_join("dimension_names", ",").alias("names"), "rows",
    )


@query(
    "cohort_catalogue",
    """WITH {EV} SELECT tenant_id, 'buyers' AS id, min(ms) AS first_ms, max(ms) AS last_ms,
    count(DISTINCT user_id) AS rows, count(DISTINCT user_id) AS entities,
    CAST(2 AS BIGINT) AS latest_version FROM ev WHERE event_type = 'purchase'
    GROUP BY tenant_id""",
)
def cohort_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = cohorts.cohort(events(spark, sf_dir), cohort_definitions())
    return reports.catalogue(members, "cohort").select(
        "tenant_id", "id", ms("first_time").alias("first_ms"), ms("last_time").alias("last_ms"),
        "rows", "entities", "latest_version",
    )


@query(
    "sequence_catalogue",
    "SELECT tenant_id, 'buy' AS id, min(bucket_ms) AS first_ms, max(bucket_ms) AS last_ms,"
    " count(*) AS rows, array_to_string(list_sort(list_distinct(list(step_name))), ',') AS steps"
    " FROM ("
    + _funnel_sql(
        "tenant_id, bucket_ms, plan", "ms // 86400000 * 86400000", "tenant_id, bucket_ms, plan"
    )
    + ") GROUP BY tenant_id",
)
def sequence_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sequences.sequence_report(events(spark, sf_dir), sequence_definitions())
    return reports.catalogue(stored, "sequence").select(
        "tenant_id", "id", ms("first_time").alias("first_ms"), ms("last_time").alias("last_ms"),
        "rows", F.array_join("steps", ",").alias("steps"),
    )
