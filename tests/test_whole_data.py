"""Nothing is cut off: long values, many values, long texts and long chains of spans."""

from pyspark.sql import functions as F

from tidemark.operators import filters, indexes, normalize, search, traces
from tidemark.plans.definitions import Definition
from tidemark.plans.facets import Facet

AT = "2026-01-01T00:00:00Z"


def test_long_values_are_found_with_and_without_an_index(make_events):
    events = make_events(("1", AT, {"note": "x" * 1500}), ("2", AT, {"other": 1}))
    for index in (indexes.kv_index(events), None):
        for negated, want in ((False, ["1"]), (True, ["2"])):
            facet = Facet("note", "exists", negated=negated)
            assert [r["event_id"] for r in filters.filter_facets(events, [facet], index).collect()] == want


def test_every_leaf_is_indexed(make_events):
    events = make_events(("1", AT, {f"k{n:05d}": n for n in range(3000)}))
    index = indexes.kv_index(events)
    assert index.where(F.col("path").startswith("k")).count() == 3000
    assert indexes.kv_index(events, max_rows=10).count() == 10


def test_the_end_of_a_long_text_is_searched(make_events):
    events = make_events(("1", AT, {"text": "word " * 40_000 + "needle"}))
    assert search.search(indexes.text_index(events), events, "needle").count() == 1
    assert indexes.text_index(events, max_bytes=100).select(F.octet_length("text")).first()[0] <= 100


def test_chains_of_any_length_have_their_depth(spark):
    spans = spark.range(1500).select(
        F.lit("t").alias("tenant_id"), F.lit("one").alias("trace_id"),
        F.concat(F.lit("s"), "id").alias("span_id"),
        F.when(F.col("id") > 0, F.concat(F.lit("s"), F.col("id") - 1)).otherwise("").alias("parent_span_id"),
    )
    got = {r["span_id"]: (r["depth"], r["overflow"]) for r in traces.span_depth(spans).collect()}
    assert got == {f"s{k}": (k, False) for k in range(1500)}


def test_a_cycle_overflows(spark):
    rows = [("t", "one", "a", "b"), ("t", "one", "b", "a"), ("t", "one", "c", "")]
    got = traces.span_depth(spark.createDataFrame(rows, "tenant_id string, trace_id string, span_id string, parent_span_id string"))
    assert {r["span_id"]: r["overflow"] for r in got.collect()} == {"a": True, "b": True, "c": False}


def test_arrays_inside_arrays_are_one_scope(make_events):
    events = make_events(
        ("1", AT, {"items": [{"subs": [{"x": 1, "y": 2}]}]}), ("2", AT, {"items": [{"subs": [{"x": 1}, {"y": 2}]}]})
    )
    facets = [Facet("items[].subs[].x", "eq", "1"), Facet("items[].subs[].y", "eq", "2")]
    for index in (indexes.kv_index(events), None):
        assert [r["event_id"] for r in filters.filter_facets(events, facets, index).collect()] == ["1"]


def nested(levels, value):
    for _ in range(levels):
        value = {"a": value}
    return value


def test_deep_leaves_are_found(make_events):
    for levels in (11, 45):
        events = make_events(("1", AT, nested(levels, 7)), ("2", AT, {"other": 1}))
        path = ".".join("a" * levels)
        for index in (indexes.kv_index(events), None):
            for negated, want in ((False, ["1"]), (True, ["2"])):
                facet = Facet(path, "exists", negated=negated)
                assert [r["event_id"] for r in filters.filter_facets(events, [facet], index).collect()] == want
        assert f"{path}:7" in indexes.text_index(events).where("event_id = '1'").first()["text"]


def test_metrics_have_their_deep_dimensions(make_events):
    payload = {"event_type": "metric", "metric_name": "m", "metric_value": 1, "deep": nested(12, "x")}
    config = normalize.discover_metric_definitions(make_events(("1", AT, payload))).first()
    assert "deep." + ".".join("a" * 12) in str(config)


def test_deep_arrays_are_indexed_by_field(make_events):
    def listed(levels, value):
        for _ in range(levels):
            value = [value]
        return value

    events = make_events(("1", AT, {"tags": ["top", listed(5, "five"), listed(40, "forty"), {"no": 1}]}), ("2", AT, {"tags": "plain"}))
    config = {"outputs": [{"field_name": "tag", "value": {"path": "tags"}}]}
    rows = indexes.field_index(events, [Definition("d", "field", config, "t", "tags")])
    assert sorted(r["value"] for r in rows.collect()) == ["five", "forty", "plain", "top"]
