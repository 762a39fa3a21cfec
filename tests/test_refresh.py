"""Refreshes that read what they touch, progress as a set, backfills in one job."""

import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohorts, normalize, rollups
from tidemark.plans.definitions import Definition
from tidemark.sources import events as sources
from tidemark.sources import tables
from tidemark.streaming import ingest, materialize

VISITS = Definition(
    "seen", "cohort",
    {"match": {"all": [{"path": "event_type", "value": "visit"}]},
     "outputs": [{"entity_type": "user", "entity_id": {"path": "user"}}]},
    "t", "visitors",
)


def members(slots=64):
    return materialize.DerivedTable(
        "members", lambda e: cohorts.cohort(e, [VISITS]), slots=slots,
        group={"tenant_id": lambda e: e["tenant_id"], "entity_id": lambda e: F.get_json_object(e["data"], "$.user")},
    )


@pytest.fixture
def visit(make_events):
    def make(*rows):
        parts = [
            make_events((i, f"2024-{1 + day // 28:02d}-{1 + day % 28:02d}T00:00:00Z", {"event_type": "visit", "user": user}), offset=offset)
            for i, day, user, offset in rows
        ]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    return make


def same_as_whole(spark, root):
    whole = cohorts.cohort(normalize.dedupe_events(tables.read_committed(spark, root)), [VISITS])
    got = materialize.read_derived(spark, root, "members").select(*whole.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_a_refresh_reads_only_the_places_of_its_groups(spark, visit, tmp_path, monkeypatch):
    root, files = str(tmp_path / "store"), []
    read = tables.read_events
    monkeypatch.setattr(tables, "read_events", lambda s, path: files.append(len(path)) or read(s, path))

    def step(name, rows):
        tables.append_batch(rows, root, name)
        files.clear()
        materialize.materialize(spark, root, [members()])
        return list(files)

    step("first", visit((0, 0, "ann", 0)))
    small = step("second", visit((1, 3, "ann", 1)))
    # The store grows by days of other people; what a visit of ann's makes it read does not.
    tables.append_batch(visit(*[(100 + k, 5 + k, f"p{k}", 100 + k) for k in range(40)]), root, "others")
    materialize.materialize(spark, root, [members()])
    large = step("third", visit((2, 3, "ann", 2)))
    assert max(large) <= max(small) + 1 < 5
    same_as_whole(spark, root)
    # A delivery that comes first by position moves event 104 from p4 to ann, days away.
    moved = step("fourth", visit((104, 60, "ann", -1)))
    assert max(moved) < 8
    same_as_whole(spark, root)
    got = {r["entity_id"] for r in materialize.read_derived(spark, root, "members").collect()}
    assert "p4" not in got and {"ann", "p3", "p5"} <= got


def test_only_slots_of_touched_groups_are_rewritten(spark, visit, tmp_path):
    root = str(tmp_path / "store")
    tables.append_batch(visit(*[(k, 0, f"p{k}", k) for k in range(30)]), root, "a")
    materialize.materialize(spark, root, [members(slots=16)])
    path = f"{root}/tables/members"
    before = {r["slot"]: r["step"] for r in tables._pointers(spark, path).collect()}
    tables.append_batch(visit((99, 1, "p7", 99)), root, "b")
    materialize.materialize(spark, root, [members(slots=16)])
    after = {r["slot"]: r["step"] for r in tables._pointers(spark, path).collect()}
    assert len(before) > 8 and sum(before.get(k) != v for k, v in after.items()) == 1
    same_as_whole(spark, root)


def test_commits_of_the_same_number_are_all_taken_in(spark, visit, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    tables.append_batch(visit((1, 0, "ann", 1)), root, "a")
    materialize.materialize(spark, root, [members()])
    # A second writer that saw the store before the first commit gives its own the same number.
    ledger = tables.read_ledger
    with monkeypatch.context() as patch:
        patch.setattr(tables, "read_ledger", lambda s, r: ledger(s, r).where("false"))
        assert tables.append_batch(visit((2, 1, "bob", 2)), root, "b")["sequence"] == 1
    assert ledger(spark, root).count() == 2
    materialize.materialize(spark, root, [members()])
    same_as_whole(spark, root)
    assert materialize.read_derived(spark, root, "members").count() == 2
    assert materialize.new_commits(spark, root, "members").isEmpty()


def test_a_store_from_before_goes_on_from_its_watermark(spark, visit, tmp_path):
    root = str(tmp_path / "store")
    tables.append_batch(visit((1, 0, "ann", 1)), root, "a")
    materialize._advance(spark, root, "old", 1)
    tables.append_batch(visit((2, 0, "bob", 2)), root, "b")
    assert [r["batch_id"] for r in materialize.new_commits(spark, root, "old").collect()] == ["b"]


def test_two_streams_at_once_lose_no_batch(spark, tmp_path):
    root = str(tmp_path / "store")
    for inbox in ("one", "two"):
        (tmp_path / inbox).mkdir()
        for n in range(3):
            body = {"event_id": f"{inbox}{n}", "timestamp": f"2024-01-0{n + 1}T00:00:00Z", "data": {"event_type": "visit"}}
            row = {"tenant_id": "t", "received_at": "2024-01-01T00:00:00Z", "body": json.dumps(body)}
            (tmp_path / inbox / f"{n}.json").write_text(json.dumps(row))
    density = materialize.DerivedTable("density", lambda e: rollups.event_density(e, 60))

    def run(inbox, failed):
        try:
            bodies = sources.stream_bodies(spark, str(tmp_path / inbox), max_files=1)
            ingest.normalize_stream(bodies, root, str(tmp_path / f"cp-{inbox}"), once=True).awaitTermination()
        except Exception as problem:  # noqa: BLE001
            failed.append(problem)

    failed = []
    threads = [threading.Thread(target=run, args=(inbox, failed)) for inbox in ("one", "two")]
    for thread in threads:
        thread.start()
    while any(t.is_alive() for t in threads):
        if tables.exists(spark, f"{root}/commits"):
            materialize.materialize(spark, root, [density])
        threads[0].join(0.5)
    for thread in threads:
        thread.join()
    assert not failed
    materialize.materialize(spark, root, [density])
    got = materialize.read_derived(spark, root, "density").agg(F.sum("count")).first()[0]
    assert got == tables.read_committed(spark, root).count() == 6


def test_backfill_of_a_thousand_chunks_is_one_job(spark, make_events, tmp_path):
    start = dt.datetime(2024, 1, 1)
    times = [start + dt.timedelta(hours=k % 1000, seconds=k) for k in range(1500)]
    events = make_events(*[(k, t.isoformat() + "Z", {}) for k, t in enumerate(times)])
    built = []

    def build(rows):
        built.append(1)
        return rollups.event_density(rows, 60)

    table = materialize.DerivedTable("density", build)
    out, window = str(tmp_path / "out"), {"start": start, "end": start + dt.timedelta(hours=1000), "job_id": "j"}
    status = materialize.backfill_table(events, table, out, **window).collect()
    assert len(built) == 1 and len(status) == 1000
    assert {(r["status"], r["attempt"]) for r in status} == {("completed", 1)}
    whole = rollups.event_density(events, 60)
    assert sum(r["rows_scanned"] for r in status) == 1500 and sum(r["rows_written"] for r in status) == whole.count()
    got = spark.read.parquet(out).select(*whole.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    again = materialize.backfill_table(events, table, out, **window, done=range(990)).collect()
    assert [r["attempt"] for r in again if r["attempt"]] == [1] * 10 and spark.read.parquet(out).count() == whole.count()


def test_only_failed_chunks_run_again(spark, make_events, tmp_path):
    events = make_events(*[(k, f"2024-01-01T{k % 8:02d}:00:0{k % 7}Z", {"bad": int(k % 8 == 5)}) for k in range(40)])

    def build(rows):
        broken = F.when(F.get_json_object("data", "$.bad") == "1", F.raise_error(F.lit("poison"))).otherwise(F.lit(0)).cast("long")
        return rows.select("event_id", F.col("timestamp").alias("bucket_time"), broken.alias("x"))

    table = materialize.DerivedTable("rows", build)
    window = {"start": dt.datetime(2024, 1, 1), "end": dt.datetime(2024, 1, 1, 8), "job_id": "j", "max_attempts": 2}
    status = {r["chunk_index"]: r for r in materialize.backfill_table(events, table, str(tmp_path / "out"), **window).collect()}
    assert {k for k, r in status.items() if r["status"] == "failed"} == {5} and "poison" in status[5]["error"]
    assert status[5]["rows_written"] == 0 and status[0]["rows_written"] == 5 and status[0]["attempt"] == 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == 35


def test_first_deliveries_are_chosen_before_rows_are_read(spark, make_events, tmp_path):
    rows = [(k % 40, f"2024-01-01T00:00:{k % 7:02d}Z", {"text": f"delivery {k}", "n": k}) for k in range(200)]
    path = str(tmp_path / "events")
    for n, offset in enumerate((5, 0, 5)):
        make_events(*rows[n * 60 : n * 60 + 80], offset=offset).write.mode("append").parquet(path)
    stored = spark.read.schema(make_events(*rows).schema).parquet(path)
    found = normalize.dedupe_stored(stored)
    key = lambda r: (r["event_id"], r["source_file"], r["source_offset"], r["timestamp"])
    got = sorted(map(key, found.collect()))
    assert got == sorted(map(key, normalize.dedupe_events(stored).collect())) and len(got) == 40
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("SortAggregate" in line and "data" in line for line in plan.splitlines())
    assert "ShuffledHashJoin" in plan and not any(line.strip(" +-:").startswith("Sort [__file") for line in plan.splitlines())
    assert found.columns == stored.columns
