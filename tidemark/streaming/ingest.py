"""Streams: normalising raw bodies, event de-duplication, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.events import is_error
from tidemark.operators.normalize import MAX_EVENT_BYTES, checked, invalid_rows, valid_rows
from tidemark.sources.events import split_bodies, to_canonical
from tidemark.sources.tables import append_batch


def stream_id(batch: DataFrame) -> str:
    """Id of the query that runs a micro-batch; it is kept in the query's checkpoint.

    Batch numbers start anew with each checkpoint, so only both together name a batch.
    """
    found = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not found:
        raise RuntimeError("not called from a micro-batch of a stream")
    return found


def normalize_stream(
    bodies: DataFrame,
    root: str,
    checkpoint: str,
    *,
    max_event_bytes: int = MAX_EVENT_BYTES,
    once: bool = False,
    on_commit: Callable[[dict], None] | None = None,
) -> StreamingQuery:
    """Split a stream of bodies into committed events and rejects.

    Each micro-batch is appended under an id made of the query's own id and the
    batch's number, so a batch that is run again after a failure is not stored twice,
    and several streams (or a new checkpoint) may feed one store; offsets advance
    only after both sinks are written.
    """

    def write(batch: DataFrame, number: int) -> None:
        stream = stream_id(batch)
        rows = checked(split_bodies(batch), max_event_bytes).persist()
        try:
            commit = append_batch(to_canonical(valid_rows(rows)), root, f"stream:{stream}:{number}")
            invalid = invalid_rows(rows).withColumn("batch", F.lit(number))
            # One folder per batch, overwritten on a rerun.
            invalid.write.mode("overwrite").parquet(f"{root}/invalid/stream={stream}/batch_number={number}")
        finally:
            rows.unpersist()
        if on_commit is not None:
            on_commit(commit)

    writer = bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def dedupe_stream(events: DataFrame, delay: str) -> DataFrame:
    """Drop repeated deliveries of an event that arrive within ``delay``.

    State is kept for the delay only.
    """
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(
        ["tenant_id", "event_id"]
    )


def density_stream(events: DataFrame, seconds: int, watermark: str) -> DataFrame:
    """Events and errors per tenant and tumbling window, final once the watermark
    has passed. Later events are dropped and counted in the query's progress
    (``numRowsDroppedByWatermark``)."""
    return (
        events.withColumn("error", is_error(events, "view"))
        .withWatermark("timestamp", watermark)
        .groupBy("tenant_id", F.window("timestamp", f"{seconds} seconds").alias("window"))
        .agg(F.count(F.lit(1)).alias("count"), F.count_if("error").alias("error_count"))
        .select("tenant_id", F.col("window.start").alias("bucket_time"), "count", "error_count")
    )


