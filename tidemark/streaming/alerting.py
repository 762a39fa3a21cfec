"""Alerts on a stream of events."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.alerts import AlertRule, alert_candidates, earliest_alerts, notification_outbox
from tidemark.sources.tables import exists
from tidemark.streaming.ingest import stream_id


KEY = ["tenant_id", "alert_id", "dedupe_key"]
ORDER = ("event_timestamp", "event_id")


def alert_stream(events: DataFrame, rules: Sequence[AlertRule]) -> DataFrame:
    """Every match of a stream, before suppression, which ``write_alerts`` settles with what is stored."""
    return alert_candidates(events, rules)


def _stored(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/alert_events")


def settled(matches: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The earliest match per rule, key and slot, where it is news, with ``change`` and ``corrects``.

    ``new`` has no stored alert of its key; a ``correction`` comes before the stored one by
    time and id, whose event it names. Matches after a stored alert are suppressed by it.
    """
    first = earliest_alerts(matches)
    if stored is None:
        return first.withColumns({"change": F.lit("new"), "corrects": F.lit(None).cast("string")})
    known = stored.groupBy(*KEY).agg(F.min(F.struct(*ORDER)).alias("__known"))
    news = F.col("__known").isNull() | (F.struct(*ORDER) < F.col("__known"))
    return first.join(known, KEY, "left").where(news).select(
        *first.columns,
        F.when(F.col("__known").isNull(), "new").otherwise("correction").alias("change"),
        F.col("__known.event_id").alias("corrects"),
    )


def write_alerts(
    alerts: DataFrame,
    rules: Sequence[AlertRule],
    root: str,
    checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """Store the alerts of a stream of matches and their pending notifications.

    The state of suppression is what is stored: each batch is compared with the alerts of
    its own days and of those that a slot can reach, so a match counts however late it
    comes, and events out of order give the same alerts as in order. A match before a stored alert is
    written as its correction, with pending rows in ``alert_corrections``. A rerun batch
    replaces itself only and does not compare itself with its earlier attempt; folders
    carry the query's own id, so several streams may write to one root.
    """
    reach = max((math.ceil(rule.dedupe_seconds / 86_400) for rule in rules), default=0)

    def write(batch: DataFrame, number: int) -> None:
        spark, stream = batch.sparkSession, stream_id(batch)
        part = f"stream={stream}/batch_number={number}"
        batch = batch.persist()
        try:
            days = [r[0] for r in batch.select(F.to_date("event_timestamp")).distinct().collect() if r[0]]
            stored = None
            if exists(spark, f"{root}/alert_events"):
                near = sorted({d + dt.timedelta(days=k) for d in days for k in range(-reach, reach + 1)})
                other = (F.col("stream") != stream) | (F.col("batch_number") != number)
                stored = _stored(spark, root).where(F.col("event_date").isin(near) & other)
            found = settled(batch, stored).withColumn("event_date", F.to_date("event_timestamp"))
            found.write.mode("overwrite").partitionBy("event_date").parquet(f"{root}/alert_events/{part}")
            kept = spark.read.schema(found.schema).parquet(f"{root}/alert_events/{part}")
            for change, table in (("new", "alert_notifications"), ("correction", "alert_corrections")):
                rows = kept.where(F.col("change") == change)
                if change == "new" or not rows.isEmpty():
                    notification_outbox(rows, rules).write.mode("overwrite").parquet(f"{root}/{table}/{part}")
        finally:
            batch.unpersist()

    writer = alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_alerts(spark: SparkSession, root: str) -> DataFrame:
    """Stored alerts, each once, as the latest correction has it."""
    extra = ("stream", "batch_number", "event_date", "change", "corrects")
    return earliest_alerts(_stored(spark, root).drop(*extra))
