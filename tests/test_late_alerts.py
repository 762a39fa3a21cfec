"""Alerts of streams out of order against the batch."""

import random

from pyspark.sql import functions as F

from tidemark.operators import alerts
from tidemark.plans.definitions import Definition
from tidemark.streaming import alerting

MATCH = {"all": [{"path": "ms", "op": "gt", "value": 5}]}


def rules():
    config = {"match": MATCH, "dedupe_key": "svc", "webhook_url": "http://b"}
    return [alerts.alert_rule(Definition(f"a{s}", "alert", {**config, "dedupe_seconds": s}, "t", f"every {s}")) for s in (0, 60, 50_000, 300_000)]


def run(spark, events, root, tmp_path, name="cp"):
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(events.path)
    alerting.write_alerts(alerting.alert_stream(stream, rules()), rules(), root, str(tmp_path / name), once=True).awaitTermination()


def rows_of(df, columns):
    return sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))


def test_a_stream_out_of_order_gives_the_alerts_of_a_batch(spark, make_events, tmp_path):
    rng = random.Random(1)
    rows = []
    for k in range(120):
        day, hour, second = rng.randrange(1, 9), rng.randrange(24), rng.randrange(60)
        rows.append((k, f"2024-01-{day:02d}T{hour:02d}:{k % 3:02d}:{second:02d}Z", {"ms": k % 10, "svc": f"s{k % 2}"}))
    events = make_events(*rows)
    path, root = str(tmp_path / "in"), str(tmp_path / "alerts")
    for at in range(0, 120, 30):
        make_events(*rows[at : at + 30]).coalesce(1).write.mode("append").parquet(path)
    events.path = path
    run(spark, events, root, tmp_path)
    whole = alerts.alert_events(events, rules())
    stored = alerting.read_alerts(spark, root)
    assert rows_of(stored, whole.columns) == rows_of(whole, whole.columns)
    # Every key was announced once, each change of mind is a correction that names what it replaces.
    log = spark.read.parquet(f"{root}/alert_events")
    assert log.where("change = 'new'").count() == whole.count() and log.where("change = 'correction'").count() > 0
    assert log.where("change = 'correction' and corrects is null").isEmpty()
    sent = spark.read.parquet(f"{root}/alert_notifications")
    corrected = spark.read.parquet(f"{root}/alert_corrections")
    assert sent.count() == whole.count() and corrected.count() == log.where("change = 'correction'").count()


def test_a_rerun_batch_does_not_suppress_itself(spark, make_events, tmp_path):
    events = make_events((1, "2024-01-01T00:00:01Z", {"ms": 9, "svc": "a"}), (2, "2024-01-01T00:00:02Z", {"ms": 9, "svc": "a"}))
    path, root = str(tmp_path / "in"), str(tmp_path / "alerts")
    events.coalesce(1).write.parquet(path)
    events.path = path
    run(spark, events, root, tmp_path)
    first = spark.read.parquet(f"{root}/alert_notifications").count()
    # The commit of the batch is lost, so it runs again under the same number.
    commit = next((tmp_path / "cp" / "commits").glob("0"))
    commit.rename(tmp_path / "lost-commit")
    for crc in (tmp_path / "cp" / "commits").glob(".0*"):
        crc.rename(tmp_path / "lost-crc")
    run(spark, events, root, tmp_path)
    assert spark.read.parquet(f"{root}/alert_notifications").count() == first == 5
    assert spark.read.parquet(f"{root}/alert_events").select(F.sum(F.lit(1))).first()[0] == 5


def test_long_suppression_is_obeyed(spark, make_events):
    config = {"match": MATCH, "dedupe_key": "svc", "dedupe_seconds": 400_000, "notifications": {"webhooks": [{"url": "http://b", "max_attempts": 50}]}}
    made = [alerts.alert_rule(Definition("a", "alert", config, "t", "n"))]
    assert made[0].dedupe_seconds == 400_000 and made[0].targets[0].max_attempts == 20
    events = make_events(*[(d, f"2024-01-{d:02d}T00:00:00Z", {"ms": 9, "svc": "a"}) for d in range(1, 5)])
    assert alerts.alert_events(events, made).count() < 4
