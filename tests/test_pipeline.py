"""Ingest, stores, streams, alerts, backfill, freshness, tenants."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts, cohorts, filters, freshness, indexes, normalize, pages, rollups, search
from tidemark.operators.filters import filter_facets
from tidemark.plans.definitions import Definition
from tidemark.plans.facets import Facet
from tidemark.sources import events as sources
from tidemark.sources import sql, tables
from tidemark.streaming import alerting, ingest, materialize
from tidemark.workspace import Workspace

T0 = "2024-01-01T00:00:00Z"


def event(i, time=T0, **data):
    return {"event_id": str(i), "timestamp": time, "data": data}


def raw_rows(spark, *items):
    rows = [("t", x if isinstance(x, str) else json.dumps(x)) for x in items]
    return spark.createDataFrame(rows, "tenant_id string, raw string")


def test_normalize_reasons(spark):
    raw = raw_rows(
        spark,
        {**event(" 1 "), "observed_timestamp": "2024-01-01T00:00:01Z"},
        "[1]",
        {**event(2), "event_id": "  "},
        {**event(3), "event_id": 3},
        {**event(4), "timestamp": ""},
        {**event(5), "data": [1]},
        {**event(6), "data": {"big": "x" * 3000}},
        {**event(7), "timestamp": "yesterday"},
    )
    valid, invalid = normalize.normalize(raw, max_event_bytes=2000)
    assert [r["event_id"] for r in valid.collect()] == ["1"]
    reasons = sorted(r["reason"] for r in invalid.collect())
    assert reasons == sorted(
        [
            "event must be a JSON object",
            "event_id must be a non-empty string",
            "event_id must be a non-empty string",
            "timestamp must be a non-empty string",
            "data must be a JSON object",
            "event is too large",
            "timestamp is not a time",
        ]
    )


def test_tenant_is_stamped(spark):
    raw = raw_rows(spark, event(1, tenant_id="evil", organization_id=7, a=1))
    valid, _ = normalize.normalize(raw, organization='o"1')
    data = json.loads(valid.first()["data"])
    assert data == {"tenant_id": "t", "organization_id": 'o"1', "a": 1}
    canonical = sources.to_canonical(valid).first()
    assert canonical["tenant_id"] == "t" and canonical["signal"] == "other"


def test_read_event_batches(spark, tmp_path):
    bodies = {
        "a": json.dumps(event(1)),
        "b": json.dumps([event(2), event(3)], indent=1),
        "c": "[]",
        "d": "{not json",
    }
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    rows = sources.read_event_batches(spark, str(tmp_path)).collect()
    errors = sorted(r["body_error"] for r in rows if r["body_error"])
    assert errors == ["batch must contain at least one event", "invalid JSON body"]
    good = [json.loads(r["raw"])["event_id"] for r in rows if not r["body_error"]]
    assert sorted(good) == ["1", "2", "3"]


def test_kafka_headers_and_batch_records(spark):
    record = {"batch_id": "b", "tenant_id": "t", "events": [{**event(1, a={"b": 1}), "source_offset": 5}]}
    messages = spark.createDataFrame(
        [(json.dumps(record).encode(), "raw", 2, 9, dt.datetime(2024, 1, 1),
          [("tenant-id", b"t9"), ("received-at", T0.encode())])],
        "value binary, topic string, partition int, offset bigint, timestamp timestamp,"
        " headers array<struct<key:string,value:binary>>",
    )
    body = sources.kafka_bodies(messages).first()
    assert body["tenant_id"] == "t9" and body["received_at"] == dt.datetime(2024, 1, 1)
    rows = sources.explode_batch_records(
        messages.select(F.col("value").cast("string").alias("value"), "partition", "offset")
    ).collect()
    assert rows[0]["sequence"] == (2 << 48) | 9
    assert json.loads(rows[0]["data"]) == {"a": {"b": 1}} and rows[0]["source_offset"] == 5


def test_append_is_idempotent(make_events, spark, tmp_path):
    root = str(tmp_path / "store")
    first = tables.append_batch(make_events((1, T0, {}), (2, T0, {})), root, "b1")
    again = tables.append_batch(make_events((9, T0, {})), root, "b1")
    assert again["sequence"] == first["sequence"] == 1 and again["row_count"] == 2
    tables.append_batch(make_events((3, "2024-01-02T00:00:00Z", {})), root, "b2")
    assert tables.read_committed(spark, root).count() == 3
    assert tables.read_committed(spark, root, after_sequence=1).count() == 1
    ledger = tables.read_ledger(spark, root)
    metrics = {r["metric"]: r["value"] for r in tables.audit_files(spark, f"{root}/data", ledger).collect()}
    assert metrics["commit_count"] == 2 and metrics["data_file_count"] >= 2
    assert metrics["missing_data_file_count"] == 0 and metrics["small_data_file_count"] >= 2


def test_upsert(spark, tmp_path):
    def rows(*values):
        return spark.createDataFrame(values, "k string, v int, day string")

    plain, parted = str(tmp_path / "plain"), str(tmp_path / "parted")
    for changes in (
        rows(("a", 1, "d1"), ("b", 1, "d2")), rows(("a", 2, "d1"), ("b", 0, "d2")),
        rows(("a", 2, "d1"), ("b", 0, "d2")),
    ):
        tables.upsert(changes, plain, ["k"], "v")
        tables.upsert(changes, parted, ["k", "day"], "v", partition_by="day")
    want = {("a", 2), ("b", 1)}
    assert {(r["k"], r["v"]) for r in tables.read_table(spark, plain).collect()} == want
    assert {(r["k"], r["v"]) for r in spark.read.parquet(parted).collect()} == want


def test_compact_keeps_rows(make_events, spark, tmp_path):
    path = str(tmp_path / "events")
    for i in range(4):
        sources.write_events(make_events((i, T0, {"n": i})), path)
    before = sources.read_events(spark, path).count()
    result = tables.compact(spark, path)
    assert result["compacted"] and result["input_files"] == 4 and result["rows"] == before
    assert sources.read_events(spark, path).count() == 4
    assert not tables.compact(spark, path)["compacted"]


def test_events_round_trip_with_pruning(make_events, spark, tmp_path):
    path = str(tmp_path / "events")
    made = make_events((1, T0, {"a": 1}), (2, "2024-01-03T00:00:00Z", {"event_type": "log"}))
    sources.write_events(made, path)
    back = sources.read_events(spark, path).where("event_date = DATE '2024-01-03'")
    assert back.select("event_id", "signal").collect() == [("2", "log")]
    plan = back.select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "data#" not in plan.split("ReadSchema")[1]


def test_export_and_sql(make_events, spark, tmp_path):
    events = make_events((1, T0, {"u": "x"}), (2, "2024-01-02T00:00:00Z", {"u": "y"}))
    out = str(tmp_path / "out")
    sources.export_events(events, out, end="2024-01-02T00:00:00Z", limit=5)
    (row,) = spark.read.json(out).collect()
    assert row["event_id"] == "1" and row["data"]["u"] == "x"
    spark.createDataFrame([("x", 5)], "u string, v int").write.parquet(str(tmp_path / "ext"))
    specs = sql.parse_table_specs(f"ext={tmp_path}/ext")
    joined = sql.query(
        spark,
        "SELECT v FROM ev JOIN ext ON ext.u = get_json_object(ev.data, '$.u')",
        {"ev": events, **specs},
    )
    assert [r[0] for r in joined.collect()] == [5]
    for bad in ("a=x;a=y", "1a=x", "a="):
        with pytest.raises(ValueError):
            sql.parse_table_specs(bad)


def test_dedupe_keeps_first(make_events):
    events = make_events((1, T0, {"v": 1})).unionByName(make_events((1, T0, {"v": 2}), offset=5))
    assert '"v":1' in normalize.dedupe_events(events).collect()[0]["data"].replace(" ", "")


# Alerts.
def rule(**config):
    return alerts.alert_rule(Definition("a", "alert", config, "t", "Name", "alert", 3))


def test_alert_dedupe_and_outbox(make_events):
    slow = rule(
        match={"all": [{"path": "ms", "op": "gt", "value": 5}]}, dedupe_seconds=60, dedupe_key="svc",
        notifications={"webhooks": [{"url": "http://a", "headers": {"k": "v"}, "max_attempts": 99}]},
        webhook_url="http://b",
    )
    events = make_events(
        (1, "2024-01-01T00:00:10Z", {"ms": 9, "svc": "x"}),
        (2, "2024-01-01T00:00:20Z", {"ms": 9, "svc": "x"}),
        (3, "2024-01-01T00:00:20Z", {"ms": 9, "svc": "y"}),
        (4, "2024-01-01T00:01:20Z", {"ms": 9, "svc": "x"}),
        (5, "2024-01-01T00:01:20Z", {"ms": 1, "svc": "x"}),
    )
    found = alerts.alert_events(events, [slow])
    assert sorted(r["event_id"] for r in found.collect()) == ["1", "3", "4"]
    outbox = alerts.notification_outbox(found, [slow])
    rows = outbox.collect()
    assert len(rows) == 6 and len({r["notification_id"] for r in rows}) == 6
    assert {r["max_attempts"] for r in rows} == {5, 20}
    assert json.loads(rows[0]["payload"])["alert"]["message"] == "Name"


def test_alert_text_regex_any(make_events):
    events = make_events((1, T0, {"m": "Boom"}), (2, T0, {"m": "calm"}), (3, T0, {"m": "Doom"}))
    text = rule(text="BOOM", dedupe_seconds=0)
    regex = rule(regex='"m":"[BD]oom"', dedupe_seconds=0)
    either = rule(match={"any": [{"path": "m", "value": "calm"}, {"path": "m", "value": "Doom"}]})
    names = lambda r: sorted(x["event_id"] for x in alerts.alert_events(events, [r]).collect())
    assert names(text) == ["1"] and names(regex) == ["1", "3"] and names(either) == ["2", "3"]
    with pytest.raises(ValueError):
        rule(severity="loud")


def test_notification_steps(spark):
    rows = [(0, 5, True, ""), (0, 5, False, "e"), (4, 5, False, "e"), (9, 20, False, "e")]
    df = spark.createDataFrame(rows, "attempt int, max_attempts int, ok boolean, error string")
    for column in ("next_attempt_at", "updated_at", "delivered_at"):
        df = df.withColumn(column, F.lit(None).cast("timestamp"))
    df = df.withColumn("status", F.lit("pending")).withColumn("last_error", F.lit(""))
    now = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    got = alerts.after_attempt(df, now).select("status", "attempt", F.unix_seconds("next_attempt_at") - F.unix_seconds(now)).collect()
    assert [tuple(r) for r in got] == [
        ("delivered", 1, None), ("retry", 1, 60), ("failed", 5, 0), ("retry", 10, 30 * 64),
    ]


# Streams.
def write_bodies(folder, name, *bodies):
    lines = [json.dumps({"tenant_id": "t", "received_at": T0, "body": json.dumps(b)}) for b in bodies]
    (folder / name).write_text("\n".join(lines))


def test_normalize_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    root, checkpoint = str(tmp_path / "store"), str(tmp_path / "cp")

    def run():
        bodies = sources.stream_bodies(spark, str(inbox))
        ingest.normalize_stream(bodies, root, checkpoint, once=True).awaitTermination()

    write_bodies(inbox, "1.json", [event(1, event_type="log"), {"bad": 1}], event(2))
    run()
    run()  # nothing new
    write_bodies(inbox, "2.json", event(3))
    run()
    stored = tables.read_committed(spark, root)
    assert sorted(r["event_id"] for r in stored.collect()) == ["1", "2", "3"]
    assert spark.read.parquet(f"{root}/invalid").count() == 1
    assert tables.read_ledger(spark, root).count() == 2


def test_streams_and_checkpoints_share_a_store(spark, tmp_path):
    root = str(tmp_path / "store")
    for number, inbox in ((1, "a"), (2, "b"), (3, "c")):
        folder = tmp_path / inbox
        folder.mkdir()
        write_bodies(folder, "1.json", event(number), {"bad": number})
        bodies = sources.stream_bodies(spark, str(folder))
        ingest.normalize_stream(bodies, root, str(tmp_path / f"cp-{inbox}"), once=True).awaitTermination()
    assert sorted(r["event_id"] for r in tables.read_committed(spark, root).collect()) == ["1", "2", "3"]
    assert spark.read.parquet(f"{root}/invalid").count() == 3
    ledger = tables.read_ledger(spark, root)
    assert sorted(r["sequence"] for r in ledger.collect()) == [1, 2, 3]


def test_alert_streams_share_a_folder(spark, make_events, tmp_path):
    every = rule(match={"all": [{"path": "ms", "op": "gt", "value": 5}]}, dedupe_key="svc", webhook_url="http://b")
    root = str(tmp_path / "alerts")
    for name in ("a", "b"):
        events = make_events((name, T0, {"ms": 9, "svc": name}))
        stream = alerting.alert_stream(stream_of(spark, events, str(tmp_path / name)), [every])
        alerting.write_alerts(stream, [every], root, str(tmp_path / f"cp-{name}"), once=True).awaitTermination()
    assert sorted(r["event_id"] for r in alerting.read_alerts(spark, root).collect()) == ["a", "b"]
    assert spark.read.parquet(f"{root}/alert_notifications").count() == 2


def test_retry_leaves_no_days_of_a_broken_attempt(spark, make_events, tmp_path):
    root = str(tmp_path / "store")
    folder = hashlib.sha256(b"b1").hexdigest()[:32]
    sources.write_events(make_events((8, "2024-01-05T00:00:00Z", {})), f"{root}/data/batch={folder}")
    tables.append_batch(make_events((1, T0, {})), root, "b1")
    assert [r["event_id"] for r in tables.read_committed(spark, root).collect()] == ["1"]
    with pytest.raises(ValueError):
        tables.compact(spark, f"{root}/data")


def partition_filters(df):
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [line for line in plan.splitlines() if line.startswith("PartitionFilters")]


def test_windows_pages_and_search_read_only_their_days(spark, make_events, tmp_path):
    path = str(tmp_path / "events")
    made = [(n, f"2024-01-{n:02d}T23:59:59Z", {"message": f"word {n}"}) for n in range(1, 10)]
    sources.write_events(make_events(*made), path)
    events = sources.read_events(spark, path)
    start, end = "2024-01-03T00:00:00Z", "2024-01-05T23:59:59Z"
    for kept, ids in (
        (filters.in_time(events, after=start, before=end), "345"),
        (filters.in_time(events, filters.TimeRange(after=end)), "56789"),
        (filters.in_window(events, start, end), "34"),
        (pages.page(events, cursor=pages.Cursor("before", end), limit=2), "34"),
        (search.search(indexes.text_index(events), events, "word", time_range=filters.TimeRange(start, end), limit=2), "45"),
    ):
        assert any("event_date" in line for line in partition_filters(kept))
        assert sorted(r["event_id"] for r in kept.collect()) == list(ids)


def stream_of(spark, events, path):
    events.write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).parquet(path)


def run_to_memory(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_density_stream_equals_batch(spark, make_events, tmp_path):
    rows = [(i, f"2024-01-01T00:00:{i:02d}Z", {"is_error": i % 3 == 0}) for i in range(40)]
    late = (99, "2024-01-01T02:00:00Z", {})
    events = make_events(*rows, late)
    stream = stream_of(spark, events, str(tmp_path / "e"))
    got = run_to_memory(spark, ingest.density_stream(stream, 10, "1 minute"), "dens")
    batch = rollups.event_density(events, 10).where("bucket_time < TIMESTAMP '2024-01-01 01:00:00'")
    assert {tuple(r) for r in got} == {tuple(r) for r in batch.collect()}


def test_dedupe_stream(spark, make_events, tmp_path):
    path = str(tmp_path / "e")
    stream_of(spark, make_events((1, T0, {}), (2, T0, {})), path)
    stream = stream_of(spark, make_events((1, T0, {}), (3, T0, {})), path)
    got = run_to_memory(spark, ingest.dedupe_stream(stream, "1 hour"), "dedup")
    assert sorted(r["event_id"] for r in got) == ["1", "2", "3"]


def test_alert_stream(spark, make_events, tmp_path):
    slow = rule(match={"all": [{"path": "ms", "op": "gt", "value": 5}]}, dedupe_key="svc",
                webhook_url="http://b")
    events = make_events(*[(i, f"2024-01-01T00:00:{i:02d}Z", {"ms": 9, "svc": f"s{i % 2}"}) for i in range(8)])
    stream = stream_of(spark, events, str(tmp_path / "e"))
    root = str(tmp_path / "alerts")
    alerting.write_alerts(
        alerting.alert_stream(stream, [slow]), [slow], root, str(tmp_path / "cp"), once=True
    ).awaitTermination()
    stored = alerting.read_alerts(spark, root)
    assert stored.count() == 2
    assert spark.read.parquet(f"{root}/alert_notifications").count() == 2


# Derived tables.
def density_table():
    return materialize.DerivedTable("density", lambda e: rollups.event_density(e, 60))


def test_materialize_is_incremental_and_idempotent(spark, make_events, tmp_path):
    root = str(tmp_path / "store")
    day1 = make_events((1, T0, {}), (2, T0, {}))
    day2 = make_events((3, "2024-01-02T00:00:00Z", {}), (2, T0, {}))
    late = make_events((4, "2024-01-01T00:00:30Z", {"is_error": 1}))
    for name, batch in (("a", day1), ("b", day2), ("c", late), ("a", day1)):
        tables.append_batch(batch, root, name)
        materialize.materialize(spark, root, [density_table()])
    materialize.materialize(spark, root, [density_table()])
    got = sorted(tuple(r) for r in materialize.read_derived(spark, root, "density")
                 .select("bucket_time", "count", "error_count").collect())
    whole = rollups.event_density(normalize.dedupe_events(tables.read_committed(spark, root)), 60)
    assert got == sorted(tuple(r) for r in whole.select("bucket_time", "count", "error_count").collect())
    assert [r[1] for r in got] == [3, 1]
    marks = materialize.read_watermarks(spark, root)
    ledger = tables.read_ledger(spark, root)
    freshness.ensure_fresh(ledger, marks, ["density"])
    assert freshness.freshness(ledger, marks).first()["fresh"]
    tables.append_batch(make_events((9, T0, {})), root, "d")
    with pytest.raises(freshness.StaleTable):
        freshness.ensure_fresh(tables.read_ledger(spark, root), marks, ["density"])


def test_members_seen_on_several_days_stay_one_row(spark, make_events, tmp_path):
    match = {"all": [{"path": "event_type", "value": "visit"}]}
    config = {"match": match, "outputs": [{"entity_type": "user", "entity_id": {"path": "user"}}]}
    definition = Definition("seen", "cohort", config, "t", "visitors")
    table = materialize.DerivedTable(
        "members", lambda e: cohorts.cohort(e, [definition]),
        group={"tenant_id": lambda e: e["tenant_id"], "entity_id": lambda e: F.get_json_object(e["data"], "$.user")},
    )

    def visit(i, day, user, offset):
        return make_events((i, f"2024-01-{day:02d}T00:00:00Z", {"event_type": "visit", "user": user}), offset=offset)

    root = str(tmp_path / "store")
    # The last delivery of event 4 comes first by position and names another user and day.
    batches = [visit(1, 5, "ann", 1), visit(2, 1, "ann", 2), visit(3, 3, "bob", 3), visit(4, 9, "bob", 4), visit(4, 8, "eve", 0)]
    for number, batch in enumerate(batches):
        tables.append_batch(batch, root, f"b{number}")
        materialize.materialize(spark, root, [table])
        got = materialize.read_derived(spark, root, "members")
        whole = cohorts.cohort(normalize.dedupe_events(tables.read_committed(spark, root)), [definition])
        assert sorted(map(tuple, got.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert sorted((r["entity_id"], r["first_seen"].day, r["last_seen"].day) for r in got.collect()) == [
        ("ann", 1, 5), ("bob", 3, 3), ("eve", 8, 8),
    ]


def test_chunks_cover_the_window():
    start, end = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 2, 30)
    chunks = materialize.chunk_windows(start, end)
    assert [(c.start.hour, c.end.hour, c.end.minute) for c in chunks] == [(0, 1, 0), (1, 2, 0), (2, 2, 30)]
    with pytest.raises(ValueError):
        materialize.chunk_windows(start, start)
    with pytest.raises(ValueError):
        materialize.chunk_windows(start, dt.datetime(2034, 1, 1), 60)


def test_backfill_retries_and_matches_whole(spark, make_events, tmp_path):
    events = make_events(*[(i, f"2024-01-01T0{i % 3}:00:0{i % 7}Z", {}) for i in range(21)])
    calls, out = [], str(tmp_path / "out")

    def write(rows, chunk):
        calls.append(chunk.index)
        if calls.count(1) == 1 and chunk.index == 1:
            raise RuntimeError("lost")
        rows.write.mode("overwrite").parquet(f"{out}/chunk={chunk.index}")
        return rows.count()

    status = materialize.backfill(
        events, lambda e: rollups.event_density(e, 60), write,
        start=dt.datetime(2024, 1, 1), end=dt.datetime(2024, 1, 1, 3), job_id="j",
    )
    rows = {r["chunk_index"]: r for r in status.collect()}
    assert {r["status"] for r in rows.values()} == {"completed"} and rows[1]["attempt"] == 2
    got = spark.read.parquet(out).agg(F.sum("count")).first()[0]
    assert got == 21

    def broken(rows, chunk):
        raise RuntimeError("never")

    status = materialize.backfill(
        events, lambda e: e, broken, start=dt.datetime(2024, 1, 1),
        end=dt.datetime(2024, 1, 1, 2), job_id="j", max_attempts=2, done=[0],
    )
    assert [r["status"] for r in status.orderBy("chunk_index").collect()] == ["completed", "failed"]


def test_active_version(spark):
    now = dt.datetime(2024, 1, 1)
    versions = spark.createDataFrame(
        [("t", "report", "r", 2, True, now), ("t", "report", "r", 5, False, now)],
        "tenant_id string, target_type string, target_id string, target_version bigint,"
        " active boolean, updated_at timestamp",
    )
    serving = spark.createDataFrame([("t", "r", 7)], "tenant_id string, report_id string, report_version bigint")

    def pick(target, requested=0):
        return freshness.active_version(
            versions, serving, "t", "report", target, id_column="report_id",
            version_column="report_version", requested=requested,
        )

    assert pick("r", 9) == (9, "requested")
    assert pick("r") == (2, "active_version")
    serving = serving.withColumn("report_id", F.lit("q"))
    assert pick("q") == (7, "serving_table_latest")


def test_workspace_isolation(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, v int")
    secret = spark.createDataFrame([(1,)], "v int")
    scoped = Workspace({"events": table, "secret": secret}, "a")
    assert [r["v"] for r in scoped["events"].collect()] == [1]
    assert scoped.sql("SELECT sum(v) AS s FROM {events}").first()["s"] == 1
    with pytest.raises(PermissionError):
        scoped["secret"]
    with pytest.raises(KeyError):
        scoped["other"]
    with pytest.raises(ValueError):
        Workspace({}, " ")
    assert Workspace.admin({"events": table})["events"].count() == 2


def test_stored_index_answers_the_same(spark, make_events, tmp_path):
    events = make_events(*[(i, f"2024-01-0{1 + i % 3}T00:00:00Z", {"a": i % 4}) for i in range(30)])
    path = str(tmp_path / "kv")
    index = indexes.kv_index(events)
    indexes.write_kv_index(index, path)
    stored = spark.read.parquet(path)
    facets = [Facet("a", "eq", "3")]
    got = filter_facets(events, facets, stored)
    assert {r["event_id"] for r in got.collect()} == {str(i) for i in range(30) if i % 4 == 3}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "path" in plan.split("PushedFilters: [")[1]


def test_emptied_day_is_removed(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "d1"), (2, "d2")], "v int, day string")
    tables.replace_groups(rows, path, "day", ["d1", "d2"])
    tables.replace_groups(rows.where("v = 1"), path, "day", ["d1", "d2"])
    assert [r["v"] for r in spark.read.parquet(path).collect()] == [1]
