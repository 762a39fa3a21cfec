"""Streams run to their end, compared with the same work on the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.freshness import active_version
from tidemark.operators.traces import merged_timeline
from tidemark.session import shared_folder
from tidemark.sources.events import stream_bodies
from tidemark.sources.star import events, flat_events, load, span_events
from tidemark.sources.tables import read_committed
from tidemark.streaming.ingest import density_stream, normalize_stream
from workload.registry import ms, query


@query(
    "streamed_bodies",
    """SELECT 't' || (user_id % 4) AS tenant_id, event_type, count(*) AS events, sum(event_id)::BIGINT AS ids
    FROM events GROUP BY ALL""",
)
def streamed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies, each an array of a tenant's events of an hour, streamed from files into a store in
    several batches and read through its commits."""
    root = shared_folder(spark, "streamed")
    event = F.struct(
        F.col("event_id").cast("string").alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.struct("event_type").alias("data"),
    )
    tenant = F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string"))
    bodies = load(spark, sf_dir, "events").groupBy(tenant.alias("tenant_id"), F.date_trunc("hour", "ts").alias("received_at")).agg(
        F.to_json(F.collect_list(event)).alias("body")
    )
    bodies.repartition(4).write.json(f"{root}/bodies")
    stream = stream_bodies(spark, f"{root}/bodies", max_files=1)
    normalize_stream(stream, f"{root}/store", f"{root}/checkpoint", once=True).awaitTermination()
    stored = read_committed(spark, f"{root}/store")
    return stored.groupBy("tenant_id", "event_type").agg(
        F.count("*").alias("events"), F.sum(F.col("event_id").cast("bigint")).alias("ids")
    )


@query(
    "streamed_density",
    """WITH {EV}, ends AS (SELECT max(ms) - 3600000 AS mark FROM ev)
    SELECT tenant_id, ms // 3600000 * 3600000 AS bucket_ms, count(*) AS count,
      count(*) FILTER (event_type = 'error') AS error_count
    FROM ev, ends WHERE ms // 3600000 * 3600000 + 3600000 <= mark GROUP BY ALL""",
)
def streamed_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour that an hour of watermark has passed."""
    root = shared_folder(spark, "density")
    source = flat_events(spark, sf_dir).withColumn("data", F.lit("{}"))
    source = source.withColumn("is_error", (F.col("event_type") == "error").cast("bigint")).drop("span_status_code")
    source.write.parquet(f"{root}/events")
    stream = spark.readStream.schema(source.schema).parquet(f"{root}/events")
    counted = density_stream(stream.withColumn("span_status_code", F.lit("")), 3600, "1 hour")
    writer = counted.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{root}/out").select(
        "tenant_id", ms("bucket_time").alias("bucket_ms"), "count", "error_count"
    )


@query(
    "active_versions",
    """SELECT t.target AS target_id, coalesce(a.version, s.version, 0)::BIGINT AS version,
      CASE WHEN a.version IS NOT NULL THEN 'active_version' ELSE 'serving_table_latest' END AS chosen
    FROM (SELECT DISTINCT o_orderpriority AS target FROM orders) t
    LEFT JOIN (SELECT o_orderpriority AS target, arg_max(o_custkey, (o_orderdate, o_custkey)) AS version
      FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '2-HIGH' GROUP BY 1) a USING (target)
    LEFT JOIN (SELECT o_orderpriority AS target, max(o_orderkey) AS version FROM orders GROUP BY 1) s USING (target)""",
)
def active_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each priority the newest active customer as version, else the greatest order."""
    orders = load(spark, sf_dir, "orders")
    versions = orders.select(
        F.lit("t").alias("tenant_id"), F.lit("report").alias("target_type"), F.col("o_orderpriority").alias("target_id"),
        F.col("o_custkey").alias("target_version"), F.col("o_orderdate").alias("updated_at"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") != "2-HIGH")).alias("active"),
    )
    serving = orders.select(F.lit("t").alias("tenant_id"), F.col("o_orderpriority").alias("report_id"), F.col("o_orderkey").alias("report_version"))
    # A handful of priorities.
    targets = [r[0] for r in orders.select("o_orderpriority").distinct().collect()]
    chosen = [
        (t, *active_version(versions, serving, "t", "report", t, id_column="report_id", version_column="report_version")) for t in targets
    ]
    return spark.createDataFrame(chosen, "target_id string, version long, chosen string")


@query(
    "merged_timeline",
    """WITH {EV}, every AS (
      SELECT tenant_id, event_type, 1 AS spans, value AS duration, event_id FROM ev
      UNION ALL SELECT 't' || (event_id // 8 % 4), 'span', 1, CASE WHEN event_id % 3 <> 0 THEN round(value * 1000000) / 1000 END, NULL FROM events)
    SELECT tenant_id, event_type, count(*) AS events, round(sum(duration), 2) AS duration FROM every GROUP BY ALL""",
)
def merged_timeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span starts and ends among all other events: pairs become one row, the others stay."""
    every = span_events(spark, sf_dir).unionByName(events(spark, sf_dir))
    rows = merged_timeline(every)
    return rows.groupBy("tenant_id", "event_type").agg(
        F.count("*").alias("events"), F.round(F.sum("duration_ms"), 2).alias("duration")
    )
