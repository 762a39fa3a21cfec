"""Keeping derived tables current: by commit, by time chunk.

A derived table is a function of events. Rows of most belong to a day
(``bucket_date``) and depend on that day's events only; the days a batch touches are
recomputed whole from the committed events and replaced. Rows that depend on events
of several days (cohort members, traces, current state, retention) belong to a group
instead, such as an entity, a trace or a tenant; the touched groups are recomputed
from all their events. Running the same step again therefore gives the same table.

Which commits a table has taken in is kept as a set, so writers may number commits as
they like. Two narrow inverted tables, one from events and one from groups to the
places (days of batches) that hold them, tell a refresh what to read.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.filters import EVENT_KEY, in_window, instant
from tidemark.operators.normalize import dedupe_events, dedupe_stored
from tidemark.session import shared_folder
from tidemark.sources.tables import (
    exists,
    read_committed,
    read_ledger,
    read_slots,
    read_table,
    replace_groups,
    replace_slots,
)

Build = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class DerivedTable:
    """A table computed from events, kept by day or by group.

    ``time`` is the column that gives a row's day, if its day's events are all it
    depends on. Otherwise ``group`` names columns of the rows and gives for each the
    column of the events; events that agree in them are all a row depends on, and
    events with a null among them count for no row. Such a table is stored in ``slots``
    by a hash of the group; a refresh rewrites the slots of the touched groups.
    """

    name: str
    build: Build
    time: str = "bucket_time"
    group: Mapping[str, Callable[[DataFrame], Column]] | None = None
    slots: int = 64


def read_watermarks(spark: SparkSession, root: str) -> DataFrame:
    """(serving_table, source_sequence) rows, one per advance."""
    path = f"{root}/watermarks"
    if not exists(spark, path):
        return spark.createDataFrame([], "serving_table string, source_sequence bigint")
    return spark.read.parquet(path)


def _advance(spark: SparkSession, root: str, table: str, sequence: int) -> None:
    row = [(table, sequence)]
    spark.createDataFrame(row, "serving_table string, source_sequence bigint").coalesce(
        1
    ).write.mode("append").parquet(f"{root}/watermarks")


PROGRESS = "serving_table string, batch_id string"


def read_progress(spark: SparkSession, root: str) -> DataFrame:
    """(serving_table, batch_id) of the commits that each table has taken in."""
    path = f"{root}/progress"
    if not exists(spark, path):
        return spark.createDataFrame([], PROGRESS)
    return spark.read.schema(PROGRESS).option("recursiveFileLookup", "true").parquet(path)


def new_commits(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Ledger rows that ``table`` has not taken in; the order and numbers of commits play no part."""
    done = read_progress(spark, root).where(F.col("serving_table") == table).select("batch_id")
    ledger = read_ledger(spark, root)
    if done.isEmpty():
        # A store from before progress was a set has only numbers.
        marks = read_watermarks(spark, root).where(F.col("serving_table") == table)
        ledger = ledger.where(F.col("sequence") > (marks.agg(F.max("source_sequence")).first()[0] or 0))
    return ledger.join(done, "batch_id", "left_anti").select(*ledger.columns)


def _take_in(spark: SparkSession, root: str, table: str, commits: DataFrame) -> None:
    rows = commits.select(F.lit(table).alias("serving_table"), "batch_id")
    rows.write.parquet(f"{root}/progress/{uuid.uuid4().hex}")
    _advance(spark, root, table, commits.agg(F.max("sequence")).first()[0])


class _Work:
    """Intermediate tables of one refresh, in a shared folder of its own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_folder(spark, "refresh")

    def kept(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")


def materialize(spark: SparkSession, root: str, tables: Sequence[DerivedTable]) -> dict[str, int]:
    """Bring every table up to all commits there are; returns the newest sequence.

    Only tables with commits still to take in are written, and each one records them
    after its own write; a step that breaks before is done again, with the same rows.
    """
    latest = read_ledger(spark, root).agg(F.max("sequence")).first()[0] or 0
    result = {}
    for table in tables:
        work = _Work(spark)
        fresh = work.kept(new_commits(spark, root, table.name), "commits")
        if not fresh.isEmpty():
            (_refresh_groups if table.group else _refresh)(spark, root, table, fresh, work)
            _take_in(spark, root, table.name, fresh)
        result[table.name] = latest
    return result


def _refresh(spark: SparkSession, root: str, table: DerivedTable, commits: DataFrame, work: _Work) -> None:
    fresh = read_committed(spark, root, commits=commits)
    days = [r[0] for r in fresh.select(F.to_date("timestamp").alias("d")).distinct().collect()]
    if not days:
        return
    # Files hold one day each, so only the touched days are read.
    day = F.to_date("timestamp")
    events = dedupe_stored(read_committed(spark, root, days=days).where(day.isin(days)))
    rows = table.build(events).withColumn("bucket_date", F.to_date(table.time))
    replace_groups(rows, f"{root}/tables/{table.name}", "bucket_date", days)


# The name under which the index of events records its commits.
EVENT_PLACES = "_event_places"


def _event_hash() -> Column:
    return F.xxhash64(*EVENT_KEY).alias("event")


def _index(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/index/{name}")


def _add_to_index(rows: DataFrame, root: str, name: str) -> None:
    """Rows that are there already do no harm, so a step may be done again."""
    rows.distinct().write.parquet(f"{root}/index/{name}/{uuid.uuid4().hex}")


def index_event_places(spark: SparkSession, root: str) -> DataFrame:
    """(event, place): where the deliveries of each event lie, by a hash of its key, brought up to date.

    A row is a hash and a place; a hash that two events share makes a refresh read a
    place too many and nothing else.
    """
    work = _Work(spark)
    fresh = work.kept(new_commits(spark, root, EVENT_PLACES), "commits")
    if not fresh.isEmpty():
        events = read_committed(spark, root, commits=fresh, with_place=True)
        _add_to_index(events.select(_event_hash(), "place"), root, EVENT_PLACES)
        _take_in(spark, root, EVENT_PLACES, fresh)
    return _index(spark, root, EVENT_PLACES)


def _refresh_groups(spark: SparkSession, root: str, table: DerivedTable, commits: DataFrame, work: _Work) -> None:
    """Recompute the groups that the commits touch from the places that hold their events.

    A new delivery can take the place of one in another group, so the groups of all
    copies are touched; and a touched group is built from the first deliveries of its
    events, so their copies are read too, wherever they lie.
    """
    names = list(table.group)
    on = [f"__{name}" for name in names]

    def keyed(events: DataFrame) -> DataFrame:
        return events.withColumns({f"__{name}": table.group[name](events) for name in names})

    def matching(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
        return rows.join(keys.select(*by).distinct(), by, "left_semi")

    def places_of(index: DataFrame, keys: DataFrame, by: list[str], name: str) -> DataFrame:
        return work.kept(matching(index, keys, by).select("place").distinct(), name)

    fresh = read_committed(spark, root, commits=commits, with_place=True)
    by_event = index_event_places(spark, root)
    _add_to_index(keyed(fresh).dropna(subset=on).select(*on, "place"), root, table.name)
    by_group = _index(spark, root, table.name)

    delivered = work.kept(fresh.select(*EVENT_KEY, _event_hash()).distinct(), "delivered")
    near = read_committed(spark, root, places=places_of(by_event, delivered, ["event"], "delivered-places"))
    touched = work.kept(
        keyed(matching(near, delivered, list(EVENT_KEY))).select(*on).dropna().distinct(), "touched"
    )
    held = read_committed(spark, root, places=places_of(by_group, touched, on, "touched-places"))
    members = work.kept(matching(keyed(held), touched, on).select(*EVENT_KEY, _event_hash()).distinct(), "members")
    copies = read_committed(spark, root, places=places_of(by_event, members, ["event"], "member-places"))
    first = dedupe_events(matching(copies, members, list(EVENT_KEY)))
    rows = table.build(matching(keyed(first), touched, on).drop(*on))
    gone = touched.select(*[F.col(f"__{name}").alias(name) for name in names])
    replace_slots(rows, gone, f"{root}/tables/{table.name}", names, table.slots)


def read_derived(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = f"{root}/tables/{name}"
    rows = read_slots(spark, path)
    return (read_table(spark, path) if rows is None else rows).drop("bucket_date")


MAX_CHUNKS = 10_000


@dataclass(frozen=True)
class Chunk:
    """A half-open piece of a backfill window."""

    index: int
    start: dt.datetime
    end: dt.datetime


def chunk_windows(start: dt.datetime, end: dt.datetime, seconds: int = 3600) -> list[Chunk]:
    """Cut ``[start, end)`` into chunks of at most ``seconds``."""
    if end <= start or seconds <= 0:
        raise ValueError("a backfill needs a window and a positive chunk width")
    count = -(-(end - start) // dt.timedelta(seconds=seconds))
    if count > MAX_CHUNKS:
        raise ValueError(f"more than {MAX_CHUNKS} chunks")
    step = dt.timedelta(seconds=seconds)
    return [
        Chunk(i, start + i * step, min(start + (i + 1) * step, end)) for i in range(int(count))
    ]


CHUNK_SCHEMA = (
    "tenant_id string, job_id string, chunk_id string, chunk_index int, source_start timestamp,"
    " source_end timestamp, status string, attempt int, rows_scanned bigint, rows_written bigint,"
    " error string"
)


def backfill(
    events: DataFrame,
    build: Build,
    write: Callable[[DataFrame, Chunk], int],
    *,
    start: dt.datetime,
    end: dt.datetime,
    job_id: str,
    tenant: str = "",
    chunk_seconds: int = 3600,
    max_attempts: int = 5,
    done: Sequence[int] = (),
) -> DataFrame:
    """Build a table chunk by chunk and return one status row per chunk.

    Each chunk is one bounded Spark job over its time window, retried up to
    ``max_attempts``; ``done`` lists chunks finished by an earlier run. ``write``
    stores a chunk's rows (idempotently) and returns how many there were.
    """
    rows = []
    for chunk in chunk_windows(start, end, chunk_seconds):
        status, attempt, scanned, written, error = "pending", 0, 0, 0, ""
        if chunk.index in done:
            status = "completed"
        while status not in ("completed", "failed"):
            attempt += 1
            try:
                window = in_window(events, chunk.start, chunk.end)
                scanned = window.count()
                written = write(build(window), chunk)
                status, error = "completed", ""
            except Exception as problem:  # noqa: BLE001 - any failure of the job counts
                error = str(problem)[:1000]
                status = "failed" if attempt >= max_attempts else "retry"
        rows.append(
            (
                tenant, job_id, f"{job_id}:chunk:{chunk.index}", chunk.index, chunk.start,
                chunk.end, status, attempt, scanned, written, error,
            )
        )
    return events.sparkSession.createDataFrame(rows, CHUNK_SCHEMA)


def _chunk_of(time: Column, start: dt.datetime, seconds: int) -> Column:
    """The number of the chunk a time lies in; what is before the window counts to the first."""
    past = F.unix_micros(time) - F.unix_micros(instant(start))
    return F.greatest(F.floor(past / (seconds * 1_000_000)), F.lit(0)).cast("int")


def backfill_table(
    events: DataFrame,
    table: DerivedTable,
    path: str,
    *,
    start: dt.datetime,
    end: dt.datetime,
    job_id: str,
    tenant: str = "",
    chunk_seconds: int = 3600,
    max_attempts: int = 5,
    done: Sequence[int] = (),
) -> DataFrame:
    """Build a table kept by time over a window in one job; returns one status row per chunk.

    The chunk is a column: of an event by its time, of a row by ``table.time``. All
    pending chunks are built by one plan over one scan of the window and stored at
    ``path``, partitioned by ``chunk``, each replaced whole, so that a rerun does no harm. Should the
    job fail, its chunks are halved and each half runs again, down to the chunks that fail
    alone, which are tried ``max_attempts`` times; ``attempt`` counts the runs a chunk
    took part in. ``done`` lists chunks that an earlier run finished.
    """
    spark = events.sparkSession
    chunks = chunk_windows(start, end, chunk_seconds)
    window = in_window(events, start, end)
    outcome = {c.index: ("completed", 0, "") for c in chunks if c.index in set(done)}
    waiting = [[c.index for c in chunks if c.index not in outcome]]
    tried: dict[int, int] = {}
    alone: dict[int, int] = {}
    while waiting:
        group = waiting.pop()
        if not group:
            continue
        tried.update({k: tried.get(k, 0) + 1 for k in group})
        first, last = chunks[group[0]], chunks[group[-1]]
        part = in_window(window, first.start, last.end).where(_chunk_of(F.col("timestamp"), start, chunk_seconds).isin(group))
        try:
            rows = table.build(part).withColumn("chunk", _chunk_of(F.col(table.time), start, chunk_seconds))
            replace_groups(rows, path, "chunk", group)
        except Exception as problem:  # noqa: BLE001 - any failure of the job counts
            if len(group) > 1:
                waiting += [group[: len(group) // 2], group[len(group) // 2 :]]
                continue
            alone[group[0]] = alone.get(group[0], 0) + 1
            if alone[group[0]] < max_attempts:
                waiting.append(group)
            else:
                outcome[group[0]] = ("failed", tried[group[0]], str(problem)[:1000])
        else:
            outcome.update({k: ("completed", tried[k], "") for k in group})
    # One row per chunk of the window at most.
    by_chunk = window.groupBy(_chunk_of(F.col("timestamp"), start, chunk_seconds).alias("chunk"))
    scanned = {r["chunk"]: r["n"] for r in by_chunk.agg(F.count("*").alias("n")).collect()}
    stored = {}
    if exists(spark, path):
        counted = spark.read.parquet(path).groupBy("chunk").agg(F.count("*").alias("n"))
        stored = {int(r["chunk"]): r["n"] for r in counted.collect()}
    rows = [
        (
            tenant, job_id, f"{job_id}:chunk:{c.index}", c.index, c.start, c.end, outcome[c.index][0], outcome[c.index][1],
            scanned.get(c.index, 0), stored.get(c.index, 0) if outcome[c.index][0] == "completed" else 0, outcome[c.index][2],
        )
        for c in chunks
    ]
    return spark.createDataFrame(rows, CHUNK_SCHEMA)
