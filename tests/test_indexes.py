"""Flattening, text, fields."""

import json
import random

from pyspark.sql import functions as F

from tidemark.operators import indexes
from tidemark.operators.normalize import (
    discover_metric_definitions,
    field_inference,
    rename_keys,
    typed_payload,
)
from tidemark.plans.definitions import Definition, load_definitions

T0 = "2024-01-01T00:00:00Z"


def flatten(value, path="", scope=("", -1)):
    """Brute force: the leaves of a JSON value in key order."""
    if isinstance(value, dict):
        for key in sorted(value):
            yield from flatten(value[key], f"{path}.{key}" if path else key, scope)
    elif isinstance(value, list):
        for i, item in enumerate(value):
            if isinstance(item, dict):
                yield from flatten(item, path + "[]", (path, i))
            elif isinstance(item, list):
                yield from flatten(item, path + "[]", scope)
            else:
                yield from flatten(item, path, scope)
    else:
        yield path, value, scope


def as_row(path, value, scope):
    kind = "null" if value is None else "bool" if isinstance(value, bool) else (
        "string" if isinstance(value, str) else "number")
    return (
        path,
        kind,
        value if kind == "string" else "",
        float(value) if kind == "number" else None,
        value if kind == "bool" else None,
        *scope,
    )


def rows_of(index):
    names = ["path", "value_type", "string_value", "number_value", "bool_value",
             "scope_path", "scope_index"]
    return [tuple(r) for r in index.select(*names).collect()]


def random_json(rng, depth):
    roll = rng.random()
    if depth == 0 or roll < 0.5:
        return rng.choice([None, True, False, 1, 2.5, "x", "y", ""])
    if roll < 0.75:
        return [random_json(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice("abcde"): random_json(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def test_kv_index_matches_brute_force(make_events):
    rng = random.Random(7)
    payloads = [{f"k{j}": random_json(rng, 5) for j in range(5)} for _ in range(60)]
    events = make_events(*[(i, T0, p) for i, p in enumerate(payloads)])
    got = {}
    for row in indexes.kv_index(events).collect():
        got.setdefault(int(row["event_id"]), []).append(
            (row["path"], row["value_type"], row["string_value"], row["number_value"],
             row["bool_value"], row["scope_path"], row["scope_index"])
        )
    for i, payload in enumerate(payloads):
        want = []
        for leaf in flatten({"tenant_id": "t", **payload}):
            row = as_row(*leaf)
            if row not in want:
                want.append(row)
        assert got[i] == want, payload


def test_kv_caps(make_events):
    events = make_events((1, T0, {"b": list(range(10)), "a": "x" * 2000, "z": 1}))
    rows = rows_of(indexes.kv_index(events, max_rows=4, max_string=1024))
    assert [(r[0], r[3]) for r in rows] == [("b", 0.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)]


def test_depth_overflow_is_reported(make_events):
    deep = {"a": {"b": {"c": {"d": 1}}}}
    events = make_events((1, T0, deep), (2, T0, {"a": 1}))
    assert tuple(indexes.too_deep(events, depth=3).first()) == (1, 1)
    assert tuple(indexes.too_deep(events).first()) == (0, 0)


def test_text_index(make_events):
    payload = {"event_type": "log", "trace_id": "tr", "m": {"k": [1, "ü", {"q": None}]}}
    events = make_events(("e1", T0, payload))
    text = indexes.text_index(events).first()["text"]
    assert text == (
        "event_id:e1 event_type:log signal:log trace_id:tr"
        " event_type:log m.k:1 m.k:ü m.k.q:null tenant_id:t trace_id:tr"
    )
    clipped = indexes.text_index(events, max_bytes=text.encode().index("ü".encode()) + 1)
    assert clipped.first()["text"] == text[: text.index("ü")]


def test_field_index_fans_out_and_removes_repeats(make_events):
    events = make_events(
        (1, T0, {"tags": ["a", "b", "a", ["c"], {"no": 1}], "plan": "a"}), (2, T0, {"tags": None})
    )
    config = {"outputs": [{"field_name": "tag", "value": {"path": "tags"}}]}
    definitions = [
        Definition("d1", "field", config, "t", "tags"),
        Definition("d2", "field", {"outputs": [{"field_name": "tag", "value": {"path": "plan"}}]}, "t"),
        Definition("d3", "field", config, "other"),
    ]
    rows = indexes.field_index(events, definitions).select("value", "definition_id").collect()
    assert sorted(map(tuple, rows)) == [("a", "d1"), ("b", "d1"), ("c", "d1")]


def test_field_stats(make_events):
    events = make_events(*[(i, T0, {"v": i % 3} if i % 2 else {}) for i in range(12)])
    assert tuple(indexes.field_stats(events, "v", exact=True).first()) == (6, 3)
    assert tuple(indexes.field_stats(events, "v").first()) == (6, 3)


def test_field_inference(make_events):
    events = make_events((1, T0, {"a": {"b": 1}, "l": [{"x": 1}]}), (2, T0, {"a": "s", "a.b": True}))
    found = {r["path"]: (r["count"], r["types"]) for r in field_inference(events).collect()}
    assert found == {
        "tenant_id": (2, ["string"]),
        "a": (2, ["object", "string"]),
        "a.b": (2, ["boolean", "number"]),
        "l": (1, ["array"]),
    }


def test_rename_keys(spark):
    df = spark.createDataFrame([('{"traceId":"x","spanId":"y","span_id":"z","other":1}',)], "d string")
    renamed = json.loads(df.select(rename_keys(F.col("d"))).first()[0])
    assert renamed == {"trace_id": "x", "span_id": "z", "other": 1}


def test_discovered_metric_definitions(spark, make_events):
    metric = {"event_type": "metric", "metric_name": 'req "x"', "metric_value": 3, "metric_type": "gauge"}
    events = make_events(
        (1, T0, {**metric, "http": {"route": "/a"}, "tags": ["no"], "blank": ""}),
        (2, T0, {**metric, "host": "h", "bad-key": 1}),
        (3, T0, {"event_type": "log", "metric_name": "other"}),
    )
    found = discover_metric_definitions(events)
    (definition,) = load_definitions(found)
    output = definition.config["outputs"][0]
    assert [d["name"] for d in output["dimensions"]] == ["host", "http.route"]
    assert output["metric_name"] == 'req "x"'
    assert definition.name == "metric.req__x"
    assert definition.definition_id.startswith("sdk_managed_metric_rollup_")


def test_typed_payload(make_events):
    events = make_events(
        (1, T0, {"severity_number": "9", "is_error": True, "start_time": T0, "http.method": "GET",
                 "revenue": "x"})
    )
    row = typed_payload(events).first()
    assert (row["severity_number"], row["is_error"], row["http_method"]) == (9, 1, "GET")
    assert row["start_time"] is not None and row["revenue"] is None


def test_discovered_names_and_paths_are_whole(make_events):
    long = "m" * 120
    payloads = [{"event_type": "metric", "metric_name": long + end, "p" * 200: 1} for end in "ab"]
    found = discover_metric_definitions(make_events(*[(i, T0, p) for i, p in enumerate(payloads)])).collect()
    assert {r["name"] for r in found} == {f"metric.{long}a", f"metric.{long}b"}
    assert all("p" * 200 in r["config"] for r in found)
