"""Derived tables kept by refreshes and backfills, compared with computing them at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.rollups import event_density
from tidemark.session import shared_folder
from tidemark.sources.star import events, load
from tidemark.sources.tables import append_batch
from tidemark.streaming.materialize import DerivedTable, backfill_table, materialize, read_derived
from workload.registry import big, ms, query


def _user(rows: DataFrame) -> Column:
    return F.get_json_object(rows["data"], "$.user_id")


def _members(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tenant_id", _user(rows).alias("user_id")).agg(
        F.count("*").alias("events"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.sum("source_offset").alias("offsets"),
    )


@query(
    "refreshed_members",
    """WITH {EV} SELECT tenant_id, user_id, count(*) AS events, epoch_us(min(timestamp)) // 1000 AS first_ms,
      epoch_us(max(timestamp)) // 1000 AS last_ms, sum(n)::BIGINT AS offsets
    FROM ev GROUP BY tenant_id, user_id""",
)
def refreshed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of all days after three commits, each followed by a refresh of the users it touches.

    The second commit delivers a fifth of the first's events again, for other users and a day
    later, at later positions: the first deliveries stay.
    """
    source, store = events(spark, sf_dir), shared_folder(spark, "members")
    place = F.col("event_id").cast("bigint")
    again = source.where(place % 20 == 0).withColumns({
        "data": F.lit('{"user_id":"nobody"}'), "timestamp": F.col("timestamp") + F.expr("interval 1 day"), "source_file": F.lit("events-again"),
    })
    table = DerivedTable("members", _members, group={"tenant_id": lambda e: e["tenant_id"], "user_id": _user})
    batches = [source.where(place % 4 < 3), again, source.where(place % 4 == 3)]
    for number, rows in enumerate(batches):
        append_batch(rows, store, f"batch {number}")
        materialize(spark, store, [table])
    return read_derived(spark, store, "members").select(
        "tenant_id", "user_id", "events", ms("first").alias("first_ms"), ms("last").alias("last_ms"), big("offsets").alias("offsets")
    )


def _backfilled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """All days of the events in chunks of six hours."""
    source, path = events(spark, sf_dir), shared_folder(spark, "backfill")
    first, last = load(spark, sf_dir, "events").agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    window = {
        "start": dt.datetime.combine(first, dt.time()),
        "end": dt.datetime.combine(last, dt.time()) + dt.timedelta(days=1),
    }
    table = DerivedTable("density", lambda rows: event_density(rows, 60, "materializer"))
    return backfill_table(source, table, path, **window, job_id="fill", chunk_seconds=6 * 3600), path


@query(
    "backfilled_density",
    """WITH {EV} SELECT tenant_id, ms // 60000 * 60000 AS bucket_ms, count(*) AS events,
      count(*) FILTER (failed) AS errors, (epoch_us(timestamp) - epoch_us(d.start)) // 21600000000 AS chunk
    FROM ev, (SELECT min(timestamp)::DATE::TIMESTAMP AS start FROM ev) d GROUP BY ALL""",
)
def backfilled_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and errors by minute, built by one job."""
    _, path = _backfilled(spark, sf_dir)
    rows = spark.read.parquet(path)
    return rows.select(
        "tenant_id", ms("bucket_time").alias("bucket_ms"), F.col("count").alias("events"), F.col("error_count").alias("errors"),
        big("chunk").alias("chunk"),
    )


@query(
    "backfill_status",
    """WITH {EV}, chunks AS (
      SELECT (epoch_us(timestamp) - epoch_us(d.start)) // 21600000000 AS chunk, count(*) AS scanned,
        count(DISTINCT (tenant_id, ms // 60000)) AS written
      FROM ev, (SELECT min(timestamp)::DATE::TIMESTAMP AS start FROM ev) d GROUP BY 1)
    SELECT 'fill:chunk:' || n AS chunk_id, n AS chunk_index, 'completed' AS status, 1 AS attempt,
      coalesce(scanned, 0) AS rows_scanned, coalesce(written, 0) AS rows_written
    FROM (SELECT unnest(range(4 * (date_diff('day', min(timestamp), max(timestamp)) + 1))) AS n FROM ev) LEFT JOIN chunks ON chunk = n""",
)
def backfill_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, _ = _backfilled(spark, sf_dir)
    return status.select(
        "chunk_id", big("chunk_index").alias("chunk_index"), "status", "attempt", "rows_scanned", "rows_written"
    )
