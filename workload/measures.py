"""Measures, cubes and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_percentiles, sketch_percentiles
from tidemark.operators import indexes, measures
from tidemark.operators.cohorts import cohort
from tidemark.plans.definitions import Definition
from tidemark.sources.star import events, load
from workload.registry import TENANTS, money, ms, query

DAY = 86_400
HOUR = 3600


def path(name: str, default: str | None = None) -> dict:
    return {"path": name} if default is None else {"path": name, "default": default}


def dimension(name: str, where: str) -> dict:
    return {"name": name, "value": path(where)}


def measure_definitions(seconds: int = HOUR) -> list[Definition]:
    return [
        Definition(
            "m.latency",
            "measure",
            {
                "match": {"all": [{"path": "metric_value", "op": "is_number"}]},
                "outputs": [
                    {
                        "target": "event_measures",
                        "measure_name": "latency",
                        "value": path("metric_value"),
                        "unit": "ms",
                        "dimensions": [dimension("plan", "plan"), dimension("currency", "currency")],
                        "bucket_seconds": seconds,
                    }
                ],
            },
            tenant,
            "latency",
            "measure",
            3,
        )
        for tenant in TENANTS
    ] + [
        # No dimension that has a value: one row with blanks.
        Definition(
            "m.k", "measure", {"path": "props.k", "unit": "n"}, "t0", "k", "measure", 1
        )
    ]


_MEASURES = """m AS (
  SELECT tenant_id, 'm.latency' AS definition_id, 'latency' AS measure_name, value, ms, event_id,
    3600 AS width, unnest(CASE WHEN currency = '' THEN [{'n': 'plan', 'v': plan}]
      ELSE [{'n': 'plan', 'v': plan}, {'n': 'currency', 'v': currency}] END) AS d FROM ev
  UNION ALL SELECT tenant_id, 'm.k', 'k', CAST(k AS DOUBLE), ms, event_id, 300,
    {'n': '', 'v': ''} FROM ev WHERE tenant_id = 't0')"""


@query(
    "event_measures",
    "WITH {EV}, " + _MEASURES + """ SELECT event_id, definition_id, measure_name, value,
    d.n AS dimension_name, d.v AS dimension_value,
    ms // (width * 1000) * (width * 1000) AS bucket_ms FROM m""",
)
def event_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.event_measures(events(spark, sf_dir), measure_definitions()).select(
        "event_id", "definition_id", "measure_name", "value", "dimension_name", "dimension_value",
        ms("bucket_time").alias("bucket_ms"),
    )


def _percentile_sql(column: str) -> str:
    return ", ".join(
        f"round(quantile_cont({column}, {p}), 6) AS {n}"
        for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))
    )


def _percentiles() -> list:
    return [F.round(p, 6).alias(p) for p in ("p50", "p90", "p95", "p99")]


@query(
    "measure_rollups_exact",
    "WITH {EV}, " + _MEASURES + f""" SELECT tenant_id, measure_name, d.n AS dimension_name,
    d.v AS dimension_value, ms // (width * 1000) * (width * 1000) AS bucket_ms, count(*) AS count,
    round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, {_percentile_sql("value")}
    FROM m GROUP BY tenant_id, measure_name, d.n, d.v, width, ms // (width * 1000)""",
)
def measure_rollups_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = measures.event_measures(events(spark, sf_dir), measure_definitions())
    return measures.measure_rollups(points, "exact").select(
        "tenant_id", "measure_name", "dimension_name", "dimension_value",
        ms("bucket_time").alias("bucket_ms"), "count", money("sum").alias("sum"), "min", "max",
        *_percentiles(),
    )


# Approximate quantiles from mergeable sketches: no SQL counterpart.
@query("measure_rollups_sketch")
def measure_rollups_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = measures.event_measures(events(spark, sf_dir), measure_definitions())
    rolled = measures.measure_rollups(points, "sketch")
    return rolled.select(
        "tenant_id", "measure_name", "dimension_name", "dimension_value",
        ms("bucket_time").alias("bucket_ms"), "count", *sketch_percentiles("quantiles_state"),
    )


def cube_definitions(seconds: int = DAY) -> list[Definition]:
    return [
        Definition(
            "m.cube",
            "measure",
            {
                "outputs": [
                    {
                        "target": "measure_cube_rollups",
                        "measure_name": "latency",
                        "value": path("metric_value"),
                        "dimension_sets": [
                            {"id": "plan", "dimensions": [dimension("plan", "plan")]},
                            {
                                "id": "plan_route",
                                "dimensions": [
                                    dimension("plan", "plan"),
                                    dimension("route", "http.route"),
                                ],
                            },
                            {"id": "currency", "dimensions": [dimension("currency", "currency")]},
                        ],
                        "bucket_seconds": seconds,
                    }
                ]
            },
            tenant,
            "latency",
            "cube",
            2,
        )
        for tenant in TENANTS
    ]


_CUBE = """c AS (
  SELECT tenant_id, event_id, value, ms // 86400000 * 86400000 AS bucket_ms, timestamp, unnest(
    [{'id': 'plan', 'n': 'plan', 'v': plan},
     {'id': 'plan_route', 'n': 'plan,route', 'v': plan || ',/r' || (k % 10)}]
    || CASE WHEN currency = '' THEN [] ELSE [{'id': 'currency', 'n': 'currency', 'v': currency}] END)
    AS d FROM ev)"""


@query(
    "measure_cube_points",
    "WITH {EV}, " + _CUBE + """ SELECT event_id, d.id AS dimension_set_id, d.n AS names,
    d.v AS \"values\", value, bucket_ms FROM c""",
)
def measure_cube_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.measure_cube_points(events(spark, sf_dir), cube_definitions()).select(
        "event_id", "dimension_set_id", F.array_join("dimension_names", ",").alias("names"),
        F.array_join("dimension_values", ",").alias("values"), "value",
        ms("bucket_time").alias("bucket_ms"),
    )


@query(
    "measure_cube_rollups_exact",
    "WITH {EV}, " + _CUBE + f""" SELECT tenant_id, d.id AS dimension_set_id, d.v AS \"values\",
    bucket_ms, count(*) AS count, round(sum(value), 4) AS sum, min(value) AS min,
    max(value) AS max, {_percentile_sql("value")} FROM c
    GROUP BY tenant_id, d.id, d.v, bucket_ms""",
)
def measure_cube_rollups_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = measures.measure_cube_points(events(spark, sf_dir), cube_definitions())
    return measures.measure_cube_rollups(points, "exact").select(
        "tenant_id", "dimension_set_id", F.array_join("dimension_values", ",").alias("values"),
        ms("bucket_time").alias("bucket_ms"), "count", money("sum").alias("sum"), "min", "max",
        *_percentiles(),
    )


@query("measure_cube_rollups_sketch")
def measure_cube_rollups_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = measures.measure_cube_points(events(spark, sf_dir), cube_definitions())
    return measures.measure_cube_rollups(points, "sketch").select(
        "tenant_id", "dimension_set_id", F.array_join("dimension_values", ",").alias("values"),
        ms("bucket_time").alias("bucket_ms"), "count", *sketch_percentiles("quantiles_state"),
    )


@query(
    "measure_query",
    "WITH {EV}, " + _CUBE + """ SELECT bucket_ms, split_part(d.v, ',', 1) AS plan,
    split_part(d.v, ',', 2) AS route, count(*) AS count, round(sum(value), 4) AS sum,
    min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM c
    WHERE d.id = 'plan_route' AND split_part(d.v, ',', 1) = 'pro'
      AND bucket_ms BETWEEN epoch_ms(TIMESTAMP '2024-01-05') AND epoch_ms(TIMESTAMP '2024-01-20')
    GROUP BY bucket_ms, d.v""",
)
def measure_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    definitions = cube_definitions()
    measures.resolve_dimension_set(definitions, "latency", ["plan", "route"])
    points = measures.measure_cube_points(events(spark, sf_dir), definitions)
    rows = measures.measure_query(
        measures.measure_cube_rollups(points, "none"),
        "latency",
        "2024-01-05T00:00:00Z",
        "2024-01-20T00:00:00Z",
        ["plan", "route"],
        {"plan": "pro"},
        seconds=DAY,
    )
    return rows.select(
        ms("bucket_time").alias("bucket_ms"),
        F.col("dimensions")["plan"].alias("plan"),
        F.col("dimensions")["route"].alias("route"),
        "count", money("sum").alias("sum"), "min", "max", money("avg", 6).alias("avg"),
    )


@query("measure_query_sketch")
def measure_query_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = measures.measure_cube_points(events(spark, sf_dir), cube_definitions())
    rows = measures.measure_query(
        measures.measure_cube_rollups(points),
        "latency",
        "2024-01-01T00:00:00Z",
        "2024-12-31T00:00:00Z",
        ["plan"],
        seconds=DAY,
    )
    return rows.select(
        ms("bucket_time").alias("bucket_ms"), F.col("dimensions")["plan"].alias("plan"), "count",
        "p50", "p90", "p95", "p99",
    )


@query(
    "measure_short_window",
    """WITH {EV} SELECT ms // 900000 * 900000 AS bucket_ms, plan, count(*) AS count,
    round(avg(value), 6) AS avg, round(quantile_cont(value, 0.95), 6) AS p95 FROM ev
    GROUP BY ms // 900000, plan""",
)
def measure_short_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = measures.event_measures(events(spark, sf_dir), measure_definitions())
    plans = points.where(F.col("dimension_name") == "plan")
    return measures.measure_window(plans, "latency", 900, ["dimension_value"]).select(
        ms("bucket_time").alias("bucket_ms"), F.col("dimension_value").alias("plan"), "count",
        money("avg", 6).alias("avg"), money("p95", 6).alias("p95"),
    )


@query(
    "exact_percentiles_of_prices",
    f"""SELECT l_returnflag, {_percentile_sql("l_extendedprice")} FROM lineitem
    GROUP BY l_returnflag""",
)
def exact_percentiles_of_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    return exact_percentiles(lines, ["l_returnflag"], "l_extendedprice").select(
        "l_returnflag", *_percentiles()
    )


def metric_definitions() -> list[Definition]:
    found = []
    for tenant in TENANTS:
        for kind, types in (
            ("counter", ["view", "click"]),
            ("Gauge ", ["purchase"]),
            ("timing", ["signup"]),
            ("histogram", ["error"]),
        ):
            found.append(
                Definition(
                    f"metric.{kind.strip().lower()}",
                    "metric_rollup",
                    {
                        "match": {"all": [{"path": "event_type", "op": "in", "value": types}]},
                        "outputs": [
                            {
                                "target": "metric_rollups",
                                "metric_name": path("event_type"),
                                "metric_kind": kind,
                                "value": path("metric_value"),
                                "unit": "ms",
                                "dimensions": [
                                    dimension("country", "country"),
                                    dimension("currency", "currency"),
                                ],
                                "bucket_seconds": DAY,
                            }
                        ],
                    },
                    tenant,
                    f"metric.{kind}",
                    "managed",
                    1,
                )
            )
    return found


def _metric_shape(rolled: DataFrame, *extra: str) -> DataFrame:
    return rolled.select(
        "tenant_id", "metric_name", F.coalesce(F.col("dimensions")["country"]).alias("country"),
        F.coalesce(F.col("dimensions")["currency"], F.lit("")).alias("currency"),
        ms("bucket_time").alias("bucket_ms"), "count", money("sum").alias("sum"), *extra,
    )


def _metric_sql(types: str, extra: str) -> str:
    return f"""WITH {{EV}} SELECT tenant_id, event_type AS metric_name, country, currency,
    ms // 86400000 * 86400000 AS bucket_ms, count(*) AS count, round(sum(value), 4) AS sum{extra}
    FROM ev WHERE event_type IN ({types})
    GROUP BY tenant_id, event_type, country, currency, ms // 86400000"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.metric_points(events(spark, sf_dir), metric_definitions())


@query("counter_rollup", _metric_sql("'view', 'click'", ""))
def counter_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric_shape(measures.counter_rollup(_points(spark, sf_dir)))


@query(
    "gauge_rollup",
    _metric_sql(
        "'purchase'",
        """, min(value) AS min, max(value) AS max,
    arg_max(value, {'t': timestamp, 'e': event_id}) AS last""",
    ),
)
def gauge_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric_shape(measures.gauge_rollup(_points(spark, sf_dir)), "min", "max", "last")


@query(
    "histogram_rollup",
    _metric_sql("'signup', 'error'", ", min(value) AS min, max(value) AS max"),
)
def histogram_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric_shape(measures.histogram_rollup(_points(spark, sf_dir)), "min", "max")


# Measure points of the accounts in a cohort, through the account path of the index.
@query(
    "cohort_restricted_measure",
    """WITH {EV}, c AS (SELECT DISTINCT tenant_id, account_id FROM ev
      WHERE event_type = 'purchase' AND plan = 'pro')
    SELECT plan, count(*) AS count, round(sum(value), 4) AS sum FROM ev
    JOIN c USING (tenant_id, account_id) GROUP BY plan""",
)
def cohort_restricted_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    definitions = [
        Definition(
            "c.pro",
            "cohort",
            {
                "match": {
                    "all": [
                        {"path": "event_type", "value": "purchase"},
                        {"path": "plan", "value": "pro"},
                    ]
                },
                "outputs": [{"entity_type": "account", "entity_id": path("account_id")}],
            },
            tenant,
            "pro_buyers",
        )
        for tenant in TENANTS
    ]
    members = cohort(e, definitions).select("tenant_id", F.col("entity_id").alias("account"))
    accounts = indexes.kv_index(e).where(F.col("path") == "account_id")
    accounts = accounts.select("tenant_id", "event_id", F.col("string_value").alias("account"))
    points = measures.event_measures(e, measure_definitions()).where(
        F.col("dimension_name") == "plan"
    )
    return (
        points.join(accounts, ["tenant_id", "event_id"])
        .join(members, ["tenant_id", "account"], "left_semi")
        .groupBy(F.col("dimension_value").alias("plan"))
        .agg(F.count(F.lit(1)).alias("count"), money(F.sum("value")).alias("sum"))
    )
