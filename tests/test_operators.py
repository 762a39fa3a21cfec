"""Measures, reports, funnels, cohorts, retention, state, traces, rollups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_percentiles, sketch, sketch_percentiles
from tidemark.operators import (
    cohorts,
    measures,
    reports,
    rollups,
    sequences,
    states,
    traces,
    usage,
)
from tidemark.plans.definitions import Definition, validate

T0 = "2024-01-01T00:00:00Z"


def at(seconds):
    return f"2024-01-01T{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}Z"


def interpolated(values, p):
    values = sorted(values)
    exact = p * (len(values) - 1)
    low, high = math.floor(exact), math.ceil(exact)
    return values[low] + (values[high] - values[low]) * (exact - low)


@pytest.mark.parametrize("kind", ["skewed", "few", "wide", "tiny"])
def test_exact_percentiles(spark, kind):
    rng = random.Random(kind)
    draw = {
        "skewed": lambda: rng.expovariate(1),
        "few": lambda: float(rng.randint(-2, 2)),
        "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300),
        "tiny": lambda: 1.0 + rng.randint(0, 50) * 2**-52,
    }[kind]
    # One group holds most of the rows, one a single row, one only NULLs.
    rows = [("hot", draw()) for _ in range(3000)] + [(f"g{i % 7}", draw()) for i in range(70)]
    rows += [("one", draw()), ("null", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    ps = (0.0, 0.5, 0.9, 0.99, 1.0)
    got = {r["k"]: tuple(r)[1:] for r in exact_percentiles(df, ["k"], "v", ps).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        want = tuple(interpolated(values, p) for p in ps)
        assert got[k] == pytest.approx(want, rel=1e-12)


def test_sketch_is_close_and_merges(spark):
    df = spark.range(20_000).select((F.col("id") % 4).alias("g"), F.col("id").cast("double").alias("v"))
    parts = df.groupBy("g").agg(sketch("v").alias("quantiles_state"))
    from tidemark.functions.quantiles import merge_sketches

    whole = parts.agg(merge_sketches("quantiles_state").alias("s"))
    p50, p90, p95, p99 = whole.select(*sketch_percentiles("s")).first()
    for got, want in ((p50, 10_000), (p90, 18_000), (p95, 19_000), (p99, 19_800)):
        assert abs(got - want) < 0.03 * 20_000


def test_measures_with_and_without_dimensions(make_events):
    events = make_events(
        (1, T0, {"v": "2.5", "plan": "pro", "c": ""}), (2, T0, {"v": 1}), (3, T0, {"v": "x"})
    )
    config = {
        "outputs": [
            {"value": {"path": "v"}, "dimensions": [
                {"name": "plan", "value": {"path": "plan"}}, {"name": "c", "value": {"path": "c"}}]}
        ]
    }
    rows = measures.event_measures(events, [Definition("d", "measure", config, "t", "m")])
    got = sorted(
        (r["event_id"], r["value"], r["dimension_name"], r["dimension_value"]) for r in rows.collect()
    )
    assert got == [("1", 2.5, "plan", "pro"), ("2", 1.0, "", "")]


def test_legacy_measure_definition(make_events):
    events = make_events((1, T0, {"lat": 7, "route": "/a"}))
    d = Definition("d", "measure", {"path": "lat", "dimension": "route", "unit": "ms"}, "t", "m")
    row = measures.event_measures(events, [d]).first()
    assert (row["value"], row["unit"], row["dimension_value"]) == (7.0, "ms", "/a")


def test_rollup_of_rollups_equals_direct(make_events):
    events = make_events(*[(i, at(i * 37), {"v": i, "plan": "p"}) for i in range(50)])
    config = {"outputs": [{"value": {"path": "v"}, "bucket_seconds": 60}]}
    points = measures.event_measures(events, [Definition("d", "measure", config, "t", "m")])
    rolled = measures.measure_rollups(points, "none")
    again = measures.merge_rollups(rolled, ["tenant_id"]).first()
    assert (again["count"], again["sum"], again["min"], again["max"]) == (50, 1225.0, 0.0, 49.0)


def test_metric_kinds_are_routed(make_events):
    def metric(i, kind, value):
        return (i, at(i), {"event_type": "metric", "metric_name": "m", "metric_type": kind,
                           "metric_value": value})

    events = make_events(
        metric(1, "Gauge", 5), metric(2, "gauge ", 3), metric(3, "timing", 9), metric(4, "odd", 1),
        metric(5, "", 2),
    )
    config = {"outputs": [{"metric_name": {"path": "metric_name"}, "value": {"path": "metric_value"}}]}
    tables = measures.metric_rollups(events, [Definition("d", "metric_rollup", config, "t")])
    gauge = tables["gauge"].first()
    assert (gauge["count"], gauge["sum"], gauge["min"], gauge["max"], gauge["last"]) == (2, 8, 3, 5, 3)
    assert tables["histogram"].first()["sum"] == 9
    assert (tables["counter"].first()["count"], tables["counter"].first()["sum"]) == (2, 3)


def test_report_metrics(make_events):
    events = make_events(
        (1, T0, {"p": "a", "v": 2}), (2, T0, {"p": "a", "v": "bad", "is_error": True}), (3, T0, {})
    )
    config = {
        "outputs": [
            {"report_id": "r", "dimensions": [{"name": "p", "value": {"path": "p"}}],
             "metrics": [{"name": "n"}, {"name": "e", "op": "error_count"},
                         {"name": "s", "op": "sum", "value": {"path": "v"}},
                         {"name": "s", "op": "sum", "value": 1}]}
        ]
    }
    rows = reports.report_summary(events, [Definition("d", "report", config, "t", "r")]).collect()
    got = {tuple(sorted(r["dimensions"].items())): r["metrics"] for r in rows}
    assert got[(("p", "a"),)] == {
        "n": 2.0, "e": 1.0, "s": 4.0, "source_events": 2.0, "bucket_seconds": 60.0,
    }
    assert got[()]["s"] == 1.0


def greedy(matches, steps):
    reached = 0
    for _, step in sorted(matches):
        if step == reached:
            reached += 1
    return reached


def test_funnel_matches_brute_force(make_events):
    rng = random.Random(11)
    names = ["a", "b", "c"]
    rows, matches = [], {}
    for i in range(600):
        # One user makes most of the events, and many share a second.
        user = "hot" if rng.random() < 0.6 else f"u{rng.randint(0, 20)}"
        second = rng.randint(0, 8000)
        name = rng.choice(names + ["other"])
        rows.append((i, at(second), {"user": user, "event_type": name}))
        if name in names:
            matches.setdefault(user, []).append((second, names.index(name)))
    steps = [sequences.Step(n, {"all": [{"path": "event_type", "value": n}]}) for n in names]
    events = make_events(*rows)
    got = {r["step_index"]: (r["entity_count"], r["conversion_count"])
           for r in sequences.funnel(events, steps, "user").collect()}
    reached = [greedy(m, 3) for m in matches.values()]
    counts = [sum(r > i for r in reached) for i in range(max(reached))]
    want = {i: (n, counts[i + 1] if i + 1 < len(counts) else n) for i, n in enumerate(counts)}
    assert got == want
    # Per bucket.
    bucketed = sequences.funnel(events, steps, "user", bucket_seconds=600)
    by_bucket = {}
    for user, found in matches.items():
        for second, step in found:
            by_bucket.setdefault((second // 600, user), []).append((second, step))
    total = sum(greedy(m, 3) > 0 for m in by_bucket.values())
    first = bucketed.where("step_index = 0").agg(F.sum("entity_count")).first()[0]
    assert first == total


def test_one_event_may_advance_several_steps(make_events):
    steps = [sequences.Step("s0", {"all": [{"path": "x", "op": "exists"}]}),
             sequences.Step("s1", {"all": [{"path": "x", "op": "exists"}]})]
    events = make_events((1, T0, {"x": 1, "u": "a"}))
    rows = sequences.funnel(events, steps, "u").collect()
    assert [(r["step_name"], r["entity_count"]) for r in sorted(rows)] == [("s0", 1), ("s1", 1)]


def cohort_of(name, match, tenant="t"):
    config = {"match": match, "outputs": [{"entity_type": "user", "entity_id": {"path": "u"}}]}
    return Definition("c", "cohort", config, tenant, name)


def test_retention(make_events):
    events = make_events(
        (1, "2024-01-01T00:00:00Z", {"u": "a", "event_type": "join"}),
        (2, "2024-01-01T00:00:00Z", {"u": "b", "event_type": "join"}),
        (3, "2024-01-02T00:00:00Z", {"u": "a", "event_type": "act"}),
        (4, "2024-01-02T00:00:10Z", {"u": "a", "event_type": "act"}),
        (5, "2023-12-31T00:00:00Z", {"u": "b", "event_type": "act"}),
        (6, "2024-01-02T00:00:00Z", {"u": "z", "event_type": "act"}),
    )
    members = cohorts.cohort(events, [cohort_of("new", {"all": [{"path": "event_type", "value": "join"}]})])
    config = {
        "match": {"all": [{"path": "event_type", "value": "act"}]},
        "outputs": [{"report_id": "r", "cohort_id": "new", "entity_type": "user",
                     "entity_id": {"path": "u"}, "bucket_seconds": 86400}],
    }
    rows = cohorts.retention(events, [Definition("r", "report", config, "t")], members).collect()
    (row,) = rows
    assert row["dimensions"] == {"retention_bucket": "1"}
    assert row["metrics"] == {
        "retained_users": 1.0, "cohort_size": 2.0, "retention_rate": 0.5, "source_events": 1.0,
    }


def test_state_as_of_and_ties(make_events):
    events = make_events(
        (1, at(0), {"id": "x", "s": "new"}), (2, at(10), {"id": "x", "s": "old"}),
        (3, at(10), {"id": "x", "s": "tie"}), (4, at(20), {"id": "x", "s": ""}),
    )
    d = Definition("d", "state", {"path": "s", "entity_type": "e", "entity_id_path": "id"}, "t", "st")
    updates = states.state_updates(events, [d])
    assert updates.count() == 3
    assert states.state_query(updates, "e", "st").first()["value"] == "tie"
    assert states.state_query(updates, "e", "st", as_of=at(9)).first()["value"] == "new"


def test_span_depth_with_cycle_and_missing_parent(make_events):
    def span(i, parent):
        return (i, T0, {"trace_id": "tr", "span_id": f"s{i}", "parent_span_id": parent})

    chain = [span(i, f"s{i - 1}" if i else "") for i in range(20)]
    odd = [span(50, "s51"), span(51, "s50"), span(52, "s51"), span(60, "nowhere"), span(61, "s60")]
    rows = traces.span_depth(make_events(*chain, *odd)).collect()
    depth = {r["span_id"]: (r["depth"], r["overflow"]) for r in rows}
    assert all(depth[f"s{i}"] == (i, False) for i in range(20))
    assert depth["s60"] == (0, False) and depth["s61"] == (1, False)
    assert depth["s50"] == depth["s51"] == depth["s52"] == (0, True)


def test_merge_spans(make_events):
    events = make_events(
        (1, at(0), {"event_type": "span_start", "trace_id": "a", "span_id": "x", "k": 1, "m": "start"}),
        (2, at(5), {"event_type": "span_end", "trace_id": "a", "span_id": "x", "m": "end",
                    "end_time": at(5), "is_error": 1}),
        (3, at(1), {"event_type": "span_start", "trace_id": "a", "span_id": "y"}),
        (4, at(1), {"event_type": "log", "trace_id": "a", "span_id": "x"}),
    )
    rows = {r["span_id"]: r for r in traces.merge_spans(events).collect()}
    assert (rows["x"]["duration_ms"], rows["x"]["open"], rows["x"]["is_error"]) == (5000.0, False, True)
    assert rows["y"]["open"] and rows["y"]["duration_ms"] is None
    merged = rows["x"]["data"]
    assert '"m":"end"' in merged and '"k":1' in merged


def test_trace_summary_takes_root_attributes(make_events):
    events = make_events(
        (1, at(1), {"trace_id": "a", "parent_span_id": "p", "name": "child", "service": "c"}),
        (2, at(2), {"trace_id": "a", "name": "root", "service": "s", "is_error": 1,
                    "start_time": at(0), "end_time": at(9)}),
    )
    d = Definition("d", "report", {"outputs": [{}]}, "t", "traces", "trace_summary")
    row = traces.trace_summary(events, [d]).first()
    assert row["dimensions"] == {"root_name": "root", "root_service": "s", "trace_id": "a"}
    assert (row["metrics"]["duration_ms"], row["metrics"]["errors"]) == (9000.0, 1.0)


def test_density_and_groups(make_events):
    events = make_events(*[(i, at(i * 10), {"service": f"s{i % 3}", "is_error": i % 2}) for i in range(30)])
    bars = rollups.density(events, 10).collect()
    assert sum(b["count"] for b in bars) == 30 and sum(b["error_count"] for b in bars) == 15
    top = rollups.groups(events, "service", limit=2, has_more=True).collect()
    assert [r["value"] for r in top] == ["s0", "s1", "s2"]
    assert rollups.groups(events, "service", search="s1").first()["count"] == 10
    rolled = rollups.field_rollups(events)
    assert rollups.summary(rolled, "service", "s1").first()[0] == 10


def test_density_of_nothing(make_events):
    events = make_events((1, T0, {})).where("event_id = 'x'")
    assert rollups.density(events).count() == 0


def test_top_entities_over_many_values(spark, make_events):
    events = make_events(*[(i, T0, {"v": i, "who": f"w{i}"}) for i in range(300)])
    config = {"outputs": [{"value": {"path": "v"}, "dimensions": [{"name": "who", "value": {"path": "who"}}]}]}
    points = measures.event_measures(events, [Definition("d", "measure", config, "t", "m")])
    rows = usage.top_entities(points, "m", 3600, 3).orderBy("rank").collect()
    assert [r["dimension_value"] for r in rows] == ["w299", "w298", "w297"]


def test_definitions_are_validated():
    with pytest.raises(ValueError):
        validate(Definition("d", "nothing", {}))
    with pytest.raises(ValueError):
        validate(Definition("d", "field", {}, mode="cube"))
    with pytest.raises(ValueError):
        validate(Definition("d", "field", {"match": {"all": [{"path": "a", "op": "like"}]}}))
    with pytest.raises(ValueError):
        validate(Definition("d", "report", {"outputs": [{"bucket_seconds": 0}]}))
    with pytest.raises(ValueError):
        measures.resolve_dimension_set([], "m", ["a"])
