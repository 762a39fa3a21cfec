"""Reading event batches and the canonical event table; writing and exporting events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.events import promote_columns
from tidemark.operators.filters import Time, by_day, filter_whole_text, instant
from tidemark.schema import BATCH_RECORD, EVENT_COLUMNS, EVENTS


def read_event_batches(spark: SparkSession, path: str) -> DataFrame:
    """Request bodies, one per file: a JSON object or a non-empty array of events.

    Gives one row per event (``raw``, ``source_file``, ``position``); a body that
    cannot be read gives one row with ``body_error``.
    """
    bodies = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("body"), F.col("_metadata.file_path").alias("source_file")
    )
    return split_bodies(bodies)


def split_bodies(bodies: DataFrame) -> DataFrame:
    """Rows (``body``, ``source_file``, ...) to one row per event in the body.

    What a body holds is found once, before its events are told apart: columns beside a
    generator would be worked out for each row it makes.
    """
    rest = [c for c in bodies.columns if c != "body"]

    def read(parsed: Column) -> Column:
        document, elements = parsed["document"], parsed["elements"]
        error = F.when(document.isNull(), F.lit("invalid JSON body")).when(
            F.size(elements) == 0, F.lit("batch must contain at least one event")
        )
        texts = F.transform(F.coalesce(elements, F.array(document)), lambda v: F.to_json(v))
        none = document.isNull() | (F.coalesce(F.size(elements), F.lit(1)) == 0)
        return F.struct(error.alias("body_error"), F.when(none, F.array(F.col("body"))).otherwise(texts).alias("__events"))

    # The lambdas name document and elements, so the body is parsed once.
    parsed = F.transform(
        F.array(F.try_parse_json("body")),
        lambda v: F.struct(v.alias("document"), F.try_variant_get(v, "$", "array<variant>").alias("elements")),
    )
    found = bodies.select(*rest, F.inline(F.transform(parsed, read)))
    return found.select(*rest, "body_error", F.posexplode("__events").alias("position", "raw"))


def stream_bodies(
    spark: SparkSession,
    source: str,
    *,
    kafka_servers: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """A stream of request bodies with tenant and receive time.

    With ``kafka_servers``, ``source`` is a topic and tenant and receive time come
    from the message headers ``tenant-id`` and ``received-at``. Otherwise it is a
    folder of files of JSON records ``{"tenant_id", "received_at", "body"}``.
    """
    if kafka_servers:
        messages = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", kafka_servers)
            .option("subscribe", source)
            .option("includeHeaders", "true")
            .load()
        )
        return kafka_bodies(messages)
    reader = spark.readStream.schema("tenant_id string, received_at timestamp, body string")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(source).withColumn("source_file", F.lit("stream"))


def kafka_bodies(messages: DataFrame) -> DataFrame:
    """Kafka messages with headers to bodies."""
    headers = F.map_from_entries(
        F.transform(
            F.coalesce("headers", F.expr("cast(array() as array<struct<key:string,value:binary>>)")),
            lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value")),
        )
    )
    return messages.select(
        F.coalesce(headers["tenant-id"], F.lit("")).alias("tenant_id"),
        F.coalesce(F.try_to_timestamp(headers["received-at"]), F.col("timestamp")).alias(
            "received_at"
        ),
        F.col("value").cast("string").alias("body"),
        F.concat_ws("/", "topic", F.col("partition").cast("string")).alias("source_file"),
    )


def sequence_number(partition: Column, offset: Column) -> Column:
    """One ordering number from a partition and an offset."""
    return F.shiftleft(partition.cast("bigint"), 48).bitwiseOR(offset.cast("bigint"))


def explode_batch_records(records: DataFrame) -> DataFrame:
    """Batch records (``value`` JSON, ``partition``, ``offset``) to event rows.

    ``events[].data`` may be any JSON object and stays text.
    """
    rows = records.select(
        F.from_json("value", BATCH_RECORD).alias("r"),
        sequence_number(F.col("partition"), F.col("offset")).alias("sequence"),
    ).select("r.batch_id", F.col("r.tenant_id").alias("batch_tenant"), "sequence",
             F.explode("r.events").alias("e"))
    return rows.select(
        "batch_id",
        "sequence",
        F.coalesce("e.tenant_id", "batch_tenant").alias("tenant_id"),
        "e.event_id",
        F.try_to_timestamp("e.timestamp").alias("timestamp"),
        F.try_to_timestamp("e.observed_timestamp").alias("observed_timestamp"),
        F.coalesce("e.source_file", F.lit("")).alias("source_file"),
        F.coalesce("e.source_offset", F.lit(0)).cast("bigint").alias("source_offset"),
        F.coalesce("e.source_length", F.lit(0)).cast("bigint").alias("source_length"),
        "e.data",
    )


def read_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The canonical event table (with its ``event_date`` partition, if stored)."""
    schema = T.StructType([*EVENTS.fields, T.StructField("event_date", T.DateType())])
    return spark.read.schema(schema).parquet(*([path] if isinstance(path, str) else path))


def to_canonical(rows: DataFrame) -> DataFrame:
    """Rows with ``event_id``, ``timestamp`` and ``data`` as canonical events."""
    return promote_columns(rows).select(*EVENT_COLUMNS)


def write_events(events: DataFrame, path: str, mode: str = "append", all_days: bool = False) -> None:
    """Store events by day, sorted by tenant and time.

    The rebalance hint lets AQE cut a large day into files of the advisory size
    and put small ones together, so one huge day (or tenant) is never one task.
    With ``all_days`` an overwrite replaces the whole folder, else the days it has.
    """
    (
        events.select(*EVENT_COLUMNS)
        .withColumn("event_date", F.to_date("timestamp"))
        .hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "tenant_id", "timestamp")
        .write.mode(mode)
        .option("partitionOverwriteMode", "static" if all_days else "dynamic")
        .option("parquet.bloom.filter.enabled#event_id", "true")
        .option("parquet.bloom.filter.enabled#trace_id", "true")
        .partitionBy("event_date")
        .parquet(path)
    )


EXPORT_COLUMNS = [
    "event_id", "timestamp", "observed_timestamp", "ingested_timestamp",
    "source_file", "source_offset", "source_length",
]


def export_rows(
    events: DataFrame,
    *,
    tenant: str = "",
    event_type: str = "",
    start: Time | None = None,
    end: Time | None = None,
    text: str | None = None,
    regex: str | None = None,
    limit: int = 0,
) -> DataFrame:
    """Filtered events with their lineage; half-open time window."""
    if tenant:
        events = events.where(F.col("tenant_id") == tenant)
    if event_type:
        events = events.where(F.col("event_type") == event_type)
    events = by_day(events, *[None if t is None else instant(t) for t in (start, end)])
    if start is not None:
        events = events.where(F.col("timestamp") >= instant(start))
    if end is not None:
        events = events.where(F.col("timestamp") < instant(end))
    events = filter_whole_text(events, text, regex)
    lineage = [c for c in events.columns if c in ("batch_id", "sequence", "data_file")]
    rows = events.select(*EXPORT_COLUMNS, *lineage, F.try_parse_json("data").alias("data"))
    return rows.limit(limit) if limit > 0 else rows


def export_events(events: DataFrame, path: str, **filters) -> None:
    """Write ``export_rows`` as NDJSON."""
    rows = export_rows(events, **filters)
    rows.write.mode("overwrite").option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    ).json(path)


def write_invalid(invalid: DataFrame, path: str) -> None:
    """Append rejected rows by day."""
    invalid.withColumn("observed_date", F.to_date("observed_at")).write.mode("append").partitionBy(
        "observed_date"
    ).parquet(path)
