"""Distinct counts that merge, and reports by sketch."""

from pyspark.sql import functions as F

from tidemark.functions.distinct import ERROR_BOUND
from tidemark.operators import dashboards, measures, rollups


def test_daily_states_give_weekly_counts(make_events):
    events = make_events(*[(k, f"2024-01-{1 + k % 7:02d}T00:00:00Z", {"user": f"u{k % 700}", "plan": ["pro", ""][k % 2]}) for k in range(2100)])
    daily = rollups.distinct_rollups(events, ["user", "plan", "missing"])
    assert {r["field_name"] for r in daily.collect()} == {"user", "plan"}
    weekly = {r["field_name"]: r for r in rollups.distinct_over(daily, 10**9).collect()}
    assert abs(weekly["user"]["distinct_values"] - 700) <= 700 * ERROR_BOUND and weekly["plan"]["distinct_values"] == 1
    assert weekly["user"]["count"] == 2100 and weekly["plan"]["count"] == 1050
    # Uniting in steps, or values counted twice, adds no values.
    halves = rollups.distinct_over(daily, 4 * 86_400).drop("distinct_values")
    twice = {r["field_name"]: r["distinct_values"] for r in rollups.distinct_over(halves.unionByName(halves), 10**9).collect()}
    assert abs(twice["user"] - 700) <= 700 * ERROR_BOUND and twice["plan"] == 1


def test_no_events_have_no_states(make_events):
    events = make_events((1, "2024-01-01T00:00:00Z", {})).where("false")
    assert rollups.distinct_over(rollups.distinct_rollups(events, ["user"]), 86_400).isEmpty()


def test_percentiles_by_sketch_are_near_exact_ones(spark, make_events):
    events = make_events(*[(k, "2024-01-01T00:00:00Z", {"event_type": "e", "service": f"s{k % 3}", "duration_ms": float(k)}) for k in range(900)])
    report = next(r for r in dashboards.STANDARD_REPORTS if r.metric.endswith("p95") and not set(r.group_by) - {"service", "event_type", "name"})
    exact = {tuple(r[:-1]): r["value"] for r in dashboards.run_report(events, report).collect()}
    near = {tuple(r[:-1]): r["value"] for r in dashboards.run_report(events, report, quantiles="sketch").collect()}
    assert exact.keys() == near.keys() and all(abs(near[k] - v) <= 0.05 * 900 for k, v in exact.items())
    points = spark.range(1000).select(F.lit("m").alias("measure_name"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.col("id").cast("double").alias("value"))
    row = measures.measure_window(points, "m", 60, quantiles="sketch").first()
    assert row["count"] == 1000 and abs(row["p95"] - 950) < 25
