"""Payloads are unfolded as deep as each row goes, in one pass."""

import json
import random
import time

from pyspark.sql import functions as F

from tidemark.operators import filters, indexes, normalize
from tidemark.plans.facets import Facet

AT = "2026-01-01T00:00:00Z"


def nested(levels, value, key="a"):
    for _ in range(levels):
        value = {key: value}
    return value


def brute_kinds(payload):
    """Path and kind by level, the first of a path counts."""
    found, level = {}, [("", payload)]
    while level:
        after = []
        for path, value in level:
            if isinstance(value, dict):
                after += [(f"{path}.{k}" if path else k, value[k]) for k in sorted(value)]
        for path, value in after:
            kind = ("null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float))
                    else "string" if isinstance(value, str) else "object" if isinstance(value, dict) else "array")
            found.setdefault(path, kind)
        level = after
    return found


def test_inference_of_any_depth_keeps_first_kinds(make_events):
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(8 if depth else 6)
        if kind >= 6:
            return {rng.choice(["a", "b", "a.b", "c.c"]): value(depth - 1) for _ in range(rng.randint(0, 3))}
        return [None, True, 1.5, "x", [1, {"in": 2}], {}][kind]

    payloads = [nested(14, 1), nested(45, {"x": [1], "y": None}), {"a.b": 1, "a": {"b": "text"}}, {}]
    payloads += [{rng.choice("pqr"): value(6), "a": value(3)} for _ in range(40)]
    events = make_events(*[(k, AT, p) for k, p in enumerate(payloads)])
    want = {}
    for payload in payloads:
        for path, kind in brute_kinds({"tenant_id": "t", **payload}).items():
            count, kinds = want.setdefault(path, [0, set()])
            want[path] = [count + 1, kinds | {kind}]
    got = {r["path"]: (r["count"], sorted(r["types"])) for r in normalize.field_inference(events).collect()}
    assert got == {path: (count, sorted(kinds)) for path, (count, kinds) in want.items()}


def test_inference_of_many_paths_is_linear(make_events):
    def seconds(paths):
        wide = {f"k{n:05d}": {"v": n} for n in range(paths // 2)}
        events = make_events(("1", AT, nested(45, wide)))
        normalize.field_inference(events).count()
        started = time.perf_counter()
        assert normalize.field_inference(events).count() == paths + 45 + 1
        return time.perf_counter() - started

    assert seconds(20_000) < 8 * seconds(5_000) + 1


def test_rows_go_as_deep_as_they_are(make_events):
    payloads = {"flat": {"x": 1}, "11": nested(11, 7), "45": nested(45, 7), "list": {"items": [[[[[[[[[[[[{"y": 5}]]]]]]]]]]]]}, "brackets": {"x": "[{" * 500}}
    events = make_events(*[(k, AT, p) for k, p in payloads.items()])
    found = {(r["event_id"], r["path"]) for r in indexes.kv_index(events).collect() if r["path"] != "tenant_id"}
    assert found >= {("flat", "x"), ("11", ".".join("a" * 11)), ("45", ".".join("a" * 45)), ("brackets", "x")}
    assert any(event == "list" and path.endswith("y") for event, path in found) and len(found) == 5
    assert indexes.kv_index(events, depth=12).where(F.col("path").startswith("a.")).count() == 1


def test_a_stream_is_indexed_as_a_batch_is(spark, make_events, tmp_path):
    events = make_events(*[(k, AT, nested(k, {"v": k})) for k in range(1, 30)])
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = indexes.kv_index(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(availableNow=True).start(out).awaitTermination()
    want = indexes.kv_index(events)
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, want.collect()))


def test_elements_meet_only_in_their_own_array(make_events):
    rows = [("1", {"items": [{"a": 1, "b": 2}]}), ("2", {"items": [{"a": 1}, {"b": 2}]}), ("3", {"items": [{"a": n, "b": 3 - n} for n in range(200)]})]
    events = make_events(*[(k, AT, p) for k, p in rows])
    facets = [Facet("items[].a", "eq", "1"), Facet("items[].b", "eq", "2")]
    for index in (indexes.kv_index(events), None):
        assert sorted(r["event_id"] for r in filters.filter_facets(events, facets, index).collect()) == ["1", "3"]


def test_field_index_keeps_first_definition_of_equal_values(make_events):
    from tidemark.plans.definitions import Definition

    events = make_events(("1", AT, {"tags": ["x", "y", "x"], "other": "x"}))
    made = [Definition(f"d{k}", "field", {"outputs": [{"field_name": "f", "value": {"path": p}}]}, "t", f"n{k}") for k, p in enumerate(["tags", "other"])]
    rows = [(r["value"], r["definition_id"]) for r in indexes.field_index(events, made).collect()]
    assert sorted(rows) == [("x", "d0"), ("y", "d0")] and json.dumps(rows)
