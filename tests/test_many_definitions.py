"""Definitions filed by shape, tenant and pinned value against compiling each by itself."""

import pytest

from tidemark.operators import alerts, cohorts, measures, reports, states, traces
from tidemark.plans import definitions as plans
from tidemark.plans.definitions import Definition

T0 = "2024-01-01T00:00:00Z"
KINDS = ("view", "buy", "error", "login")


@pytest.fixture
def source(spark, make_events):
    rows = []
    for k in range(240):
        data = {"tenant_id": f"t{k % 6}", "event_type": KINDS[k % 4], "service": f"s{k % 3}", "user": f"u{k % 11}",
                "amount": k / 2, "plan": ["free", "pro", ""][k % 3], "trace_id": f"r{k // 5}", "http": {"status": 200 + k % 2}}
        rows.append((k, f"2024-01-01T00:{k % 60:02d}:{k % 7:02d}Z", data))
    return make_events(*rows)


def made(kind, mode, output, n=120, **config):
    found = []
    for k in range(n):
        match = [
            {"all": [{"path": "event_type", "value": KINDS[k % 4]}, {"path": "plan", "op": "neq", "value": "free"}]},
            {"all": [{"path": "http.status", "value": 200 + k % 2}, {"path": "service", "value": f"s{k % 3}"}]},
            {"all": [{"path": "plan", "op": "in", "value": ["pro", "free"]}, {"path": "plan", "value": ["", "pro"][k % 2]}]},
            {},
        ][k % 5 % 4]
        shown = {key: (value.format(k=k) if isinstance(value, str) else value) for key, value in output.items()}
        found.append(Definition(f"d{k}", kind, {"match": match, "outputs": [shown], **config}, f"t{k % 7}", f"name{k}", mode, 1 + k % 3))
    return found


AMOUNT, USER = {"path": "amount"}, {"path": "user"}
CASES = {
    "measures": (measures.event_measures, made("measure", "measure", {"value": AMOUNT, "measure_name": "m{k}", "unit": "EUR"})),
    "cubes": (measures.measure_cube_points, made("measure", "cube", {
        "target": "measure_cube_rollups", "value": AMOUNT, "dimension_sets": [{"id": "a", "dimensions": [{"name": "p", "value": {"path": "plan"}}]}]})),
    "metrics": (measures.metric_points, made("metric_rollup", "managed", {"value": AMOUNT, "metric_name": "x{k}", "dimensions": [{"name": "u", "value": USER}]})),
    "states": (states.state_updates, made("state", "state", {"entity_type": "user{k}", "entity_id": USER, "value": {"path": "plan"}})),
    "cohorts": (cohorts.cohort, made("cohort", "cohort", {"entity_type": "user", "entity_id": USER})),
    "reports": (reports.report_summary, made("report", "summary", {"bucket_seconds": 60, "metrics": [{"name": "total", "op": "sum", "value": AMOUNT}]})),
    "traces": (traces.trace_summary, made("report", "trace_summary", {"bucket_seconds": 300, "report_id": "r{k}"})),
}


def alert_rules(n=120):
    found = []
    for k in range(n):
        match = [{"all": [{"path": "event_type", "op": "eq", "value": KINDS[k % 4]}]},
                 {"any": [{"path": "plan", "op": "eq", "value": "pro"}, {"path": "amount", "op": "gt", "value": 50}]}][k % 2]
        config = {"match": match, "severity": ["info", "critical"][k % 2], "dedupe_seconds": [0, 60][k % 2], "dedupe_key": "user",
                  "notifications": {"webhooks": [{"url": f"https://x/{k}"}] * (k % 3)}, **({"text": "login"} if k % 5 == 0 else {})}
        found.append(alerts.alert_rule(Definition(f"a{k}", "alert", config, f"t{k % 7}", f"alert {k}")))
    return found


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("case", sorted(CASES))
def test_filed_definitions_give_the_same_rows(source, monkeypatch, case):
    run, definitions = CASES[case]
    filed = rows_of(run(source, definitions))
    monkeypatch.setattr(plans, "PER_SCAN", 10**6)
    assert filed == rows_of(run(source, definitions)) and len(filed) > 50


def test_filed_alert_rules_give_the_same_rows(source, monkeypatch):
    rules = alert_rules()
    filed = alerts.alert_events(source, rules)
    sent = rows_of(alerts.notification_outbox(filed, rules))
    filed = rows_of(filed)
    monkeypatch.setattr(alerts, "PER_SCAN", 10**6)
    whole = alerts.alert_events(source, rules)
    assert filed == rows_of(whole) and sent == rows_of(alerts.notification_outbox(whole, rules)) and len(sent) > 50


def test_twenty_thousand_definitions_are_one_scan(spark, source, tmp_path, monkeypatch):
    source.write.parquet(str(tmp_path / "events"))
    stored = spark.read.schema(source.schema).parquet(str(tmp_path / "events"))
    many = [
        Definition(f"d{k}", "measure", {"match": {"all": [{"path": "event_type", "value": KINDS[k % 4]}]},
                   "outputs": [{"value": AMOUNT, "measure_name": f"m{k}"}]}, f"t{k // 20}", f"n{k}", "measure")
        for k in range(20_000)
    ]
    found = measures.event_measures(stored, many)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "tenant_id IN (" in plan or "tenant_id#" in plan and "INSET" in plan
    assert "BroadcastHashJoin" in plan
    # Six tenants have events, each 20 definitions of which a quarter fits each event.
    assert found.count() == 240 * 5
