"""Estimates from states that merge, with whether they lie within their bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.distinct import ERROR_BOUND
from tidemark.functions.quantiles import PERCENTILES, merge_sketches, percentile_name, sketch, sketch_percentiles
from tidemark.operators import measures, rollups
from tidemark.sources.star import events, flat_events
from workload.registry import ms, query

WEEK = 7 * 86_400
# Rank errors of the quantile states, with some room.
RANK_BOUND = 0.02


def _close(estimated: Column, exact: Column) -> Column:
    return F.abs(estimated - exact) <= F.greatest(exact * ERROR_BOUND, F.lit(0.5))


@query(
    "weekly_active_users",
    """WITH {EV} SELECT tenant_id, epoch_us(timestamp) // 604800000000 * 604800000 AS week_ms, count(*) AS events,
      count(DISTINCT user_id) AS users, true AS within_bound
    FROM ev GROUP BY ALL""",
)
def weekly_active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users per tenant and week, estimated from daily states, beside the exact count."""
    source = events(spark, sf_dir)
    weekly = rollups.distinct_over(rollups.distinct_rollups(source, ["user_id"]), WEEK)
    week = F.timestamp_seconds(F.floor(F.unix_seconds("timestamp") / WEEK) * WEEK)
    exact = source.groupBy("tenant_id", week.alias("bucket_time")).agg(
        F.countDistinct(F.get_json_object("data", "$.user_id")).alias("users")
    )
    return weekly.join(exact, ["tenant_id", "bucket_time"]).select(
        "tenant_id", ms("bucket_time").alias("week_ms"), F.col("count").alias("events"), "users",
        _close(F.col("distinct_values"), F.col("users")).alias("within_bound"),
    )


@query(
    "distinct_traces_of_all_days",
    """WITH {EV} SELECT count(*) AS events, count(DISTINCT trace_id) AS traces, count(DISTINCT span_id) AS spans,
      true AS traces_within, true AS spans_within FROM ev""",
)
def distinct_traces_of_all_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many different values: traces and spans of all tenants, from states by hour."""
    source = flat_events(spark, sf_dir)
    states = rollups.distinct_rollups(source.withColumn("data", F.lit("{}")), ["trace_id", "span_id"], 3600)
    year = rollups.distinct_over(states, 366 * 86_400, ["field_name"])
    found = year.groupBy().pivot("field_name", ["trace_id", "span_id"]).agg(F.first("distinct_values"))
    exact = source.agg(
        F.count("*").alias("events"), F.countDistinct("trace_id").alias("traces"), F.countDistinct("span_id").alias("spans")
    )
    return exact.join(found).select(
        "events", "traces", "spans", _close(F.col("trace_id"), F.col("traces")).alias("traces_within"),
        _close(F.col("span_id"), F.col("spans")).alias("spans_within"),
    )


def _ranks_hold(points: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the number of values, and whether each estimate's rank is near what it stands for."""
    value, checks = F.col("value"), []
    joined = points.join(estimates, keys)
    counts = [
        f(value, F.col(percentile_name(p))).alias(f"{side}_{percentile_name(p)}")
        for p in PERCENTILES
        for side, f in (("below", lambda v, q: F.count_if(v < q)), ("upto", lambda v, q: F.count_if(v <= q)))
    ]
    ranked = joined.groupBy(*keys).agg(F.count("*").alias("n"), *counts)
    for p in PERCENTILES:
        name = percentile_name(p)
        room = F.greatest(F.col("n") * RANK_BOUND, F.lit(1.0))
        checks += [F.col(f"below_{name}") <= F.col("n") * p + room, F.col(f"upto_{name}") >= F.col("n") * p - room]
    within = checks[0]
    for check in checks[1:]:
        within = within & check
    return ranked.select(*keys, "n", within.alias("within_bound"))


@query(
    "quantile_ranks_of_merged_days",
    "WITH {EV} SELECT tenant_id, event_type, count(*) AS n, true AS within_bound FROM ev GROUP BY ALL",
)
def quantile_ranks_of_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of all days from states by day, held against the ranks of the values themselves."""
    points = flat_events(spark, sf_dir).select("tenant_id", "event_type", F.to_date("timestamp").alias("day"), F.col("duration_ms").alias("value"))
    daily = points.groupBy("tenant_id", "event_type", "day").agg(sketch("value").alias("state"))
    merged = daily.groupBy("tenant_id", "event_type").agg(merge_sketches("state").alias("state"))
    keys = ["tenant_id", "event_type"]
    return _ranks_hold(points, merged.select(*keys, *sketch_percentiles("state")), keys)


@query(
    "measure_window_by_sketch",
    """WITH {EV} SELECT ms // 3600000 * 3600000 AS hour_ms, count(*) AS count, round(avg(value), 6) AS avg, true AS within_bound
    FROM ev WHERE event_type = 'purchase' GROUP BY 1""",
)
def measure_window_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows with p95 by sketch: its rank lies within the bound."""
    source = flat_events(spark, sf_dir).where("event_type = 'purchase'")
    points = source.select("timestamp", F.col("duration_ms").alias("value"), F.lit("latency").alias("measure_name"))
    hourly = measures.measure_window(points, "latency", 3600, quantiles="sketch")
    hour = F.timestamp_seconds(F.floor(F.unix_seconds("timestamp") / 3600) * 3600).alias("bucket_time")
    ranked = points.select(hour, "value").join(hourly, "bucket_time").groupBy("bucket_time", "count", "avg").agg(
        F.count_if(F.col("value") < F.col("p95")).alias("below"), F.count_if(F.col("value") <= F.col("p95")).alias("upto")
    )
    room = F.greatest(F.col("count") * RANK_BOUND, F.lit(1.0))
    near = (F.col("below") <= F.col("count") * 0.95 + room) & (F.col("upto") >= F.col("count") * 0.95 - room)
    return ranked.select(ms("bucket_time").alias("hour_ms"), "count", F.round("avg", 6).alias("avg"), near.alias("within_bound"))
