"""Incomplete outputs are refused; report builders take their own mode."""

import json

import pytest

from tidemark.operators import cohorts, reports, traces
from tidemark.plans.definitions import Definition, load_definitions, validate

P = {"path": "a.b"}
GOOD = [
    ("field", "facet", {"field_name": "f", "value": P}),
    ("field", "", {"value": "literal"}),
    ("measure", "measure", {"value": P, "measure_name": "m", "dimensions": [{"name": "d", "value": P}]}),
    ("measure", "cube", {"target": "measure_cube_rollups", "value": "1.5", "dimension_sets": [{"id": "s", "dimensions": [{"name": "d", "value": P}]}]}),
    ("metric_rollup", "managed", {"value": P, "metric_name": "m", "metric_kind": {"path": "k", "default": "counter"}}),
    ("state", "state", {"entity_type": "user", "entity_id": P, "value": P}),
    ("report", "summary", {"metrics": [{"name": "n"}, {"name": "s", "op": "sum", "value": P}]}),
    ("report", "retention", {"cohort_id": "c", "entity_type": "user", "entity_id": P}),
    ("report", "trace_summary", {}),
    ("cohort", "cohort", {"entity_type": "user", "entity_id": P}),
    ("sequence", "funnel", {"entity_id": P, "steps": [{"name": "one"}, {"name": "two", "match": {"all": [{"path": "x", "value": 1}]}}]}),
]
BAD = [
    ("field", "facet", {"field_name": "f"}, "value is missing"),
    ("field", "facet", {"value": P, "mode": "cube"}, "mode"),
    ("field", "facet", {"value": P, "target": "event_measures"}, "target"),
    ("measure", "measure", {"value": "abc"}, "number"),
    ("measure", "measure", {"value": True}, "number"),
    ("measure", "measure", {"value": P, "dimensions": [{"value": P}]}, "dimensions"),
    ("measure", "measure", {"value": P, "target": "measure_cube_rollups", "dimension_sets": []}, "cube"),
    ("measure", "cube", {"target": "measure_cube_rollups", "value": P, "dimension_sets": []}, "entries"),
    ("measure", "cube", {"target": "measure_cube_rollups", "value": P, "dimension_sets": [{"dimensions": [{"name": "d", "value": P}]}]}, "id needs a name"),
    ("measure", "cube", {"target": "measure_cube_rollups", "value": P, "dimension_sets": [{"id": "s", "dimensions": [{"name": "d", "value": P}]}] * 2}, "one id"),
    ("metric_rollup", "managed", {"metric_name": "m"}, "value"),
    ("state", "state", {"entity_type": " ", "entity_id": P, "value": P}, "entity_type"),
    ("state", "state", {"entity_type": "user", "entity_id": {"path": "a['b"}, "value": P}, "entity_id"),
    ("report", "summary", {"metrics": [{"name": "s", "op": "sum"}]}, "value"),
    ("report", "summary", {"metrics": [{"name": "s", "op": "median"}]}, "op"),
    ("report", "retention", {"entity_type": "user", "entity_id": P}, "cohort_id"),
    ("cohort", "cohort", {"entity_type": "user"}, "entity_id"),
    ("sequence", "funnel", {"entity_id": P}, "steps"),
    ("sequence", "funnel", {"entity_id": P, "steps": []}, "steps"),
    ("sequence", "funnel", {"entity_id": P, "steps": [{"match": {}}]}, "name"),
]


@pytest.mark.parametrize("kind, mode, output", GOOD)
def test_complete_outputs_pass(kind, mode, output):
    validate(Definition("d", kind, {"outputs": [output]}, mode=mode))


@pytest.mark.parametrize("kind, mode, output, said", BAD)
def test_incomplete_outputs_raise(kind, mode, output, said):
    with pytest.raises(ValueError, match=said):
        validate(Definition("d", kind, {"outputs": [output]}, mode=mode))


def test_each_report_builder_takes_its_mode(spark, make_events):
    rows = [
        ("t", f"r-{mode}", "report", mode, mode, json.dumps({"outputs": [{"report_id": mode, "bucket_seconds": 60, **more}]}), 1, True, None)
        for mode, more in (("summary", {}), ("trace_summary", {}), ("retention", {"cohort_id": "c", "entity_type": "user", "entity_id": {"path": "u"}}))
    ]
    schema = "tenant_id string, definition_id string, kind string, mode string, name string, config string, version int, enabled boolean, deleted_at timestamp"
    found = load_definitions(spark.createDataFrame(rows, schema), ["report"])
    events = make_events(*[(k, "2024-01-01T00:00:00Z", {"trace_id": "r", "u": "ann"}) for k in range(3)])
    members = spark.createDataFrame([("t", "c", "user", "ann", "2023-12-31 00:00:00")], "tenant_id string, cohort_id string, entity_type string, entity_id string, at string")
    members = members.selectExpr("*", "cast(at as timestamp) as first_seen")
    made = (("summary", reports.report_summary(events, found)), ("trace_summary", traces.trace_summary(events, found)), ("retention", cohorts.retention(events, found, members)))
    for mode, table in made:
        assert {r["report_id"] for r in table.collect()} == {mode}
