"""Upkeep of stored tables: idempotent appends, keyed upserts, compaction, audit.

Only Parquet is assumed. An append writes its files to a folder of its own and
becomes visible by one commit row; readers take their file list from the
commits. Upserts rewrite the touched partitions only (dynamic overwrite) or, for
unpartitioned tables, write a new version folder and switch a pointer. Tables of
groups are kept in slots by a hash of the group, each with a pointer of its own.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.schema import COMMITS, EVENTS
from tidemark.sources.events import read_events, write_events

SMALL_FILE_BYTES = 128 * 1024 * 1024
TARGET_FILE_BYTES = 512 * 1024 * 1024
MIN_SMALL_FILES = 2


def _hadoop(spark: SparkSession, path: str):
    """File system and path object of a location."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def exists(spark: SparkSession, path: str) -> bool:
    files, location = _hadoop(spark, path)
    return files.exists(location)


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Commit rows of an event store."""
    path = f"{root}/commits"
    if not exists(spark, path):
        return spark.createDataFrame([], COMMITS)
    return spark.read.schema(COMMITS).option("recursiveFileLookup", "true").parquet(path)


def append_batch(
    events: DataFrame, root: str, batch_id: str, committed_at: dt.datetime | None = None
) -> dict:
    """Append events once per ``batch_id`` and return the commit.

    A known id returns the earlier commit without writing. An attempt that failed
    half way leaves only uncommitted files, which the retry overwrites, days it no
    longer has included. Writers of different batches may work at once: data and commit
    row of a batch have folders of their own. Two such commits may get the same
    ``sequence``, which only orders them roughly; readers that must not miss one keep
    the set of batch ids they have taken in.
    """
    spark = events.sparkSession
    ledger = read_ledger(spark, root)
    known = ledger.where(F.col("batch_id") == batch_id).limit(1).collect()
    if known:
        return known[0].asDict()
    folder = hashlib.sha256(batch_id.encode()).hexdigest()[:32]
    data = f"{root}/data/batch={folder}"
    seen = Observation()
    write_events(events.observe(seen, F.count(F.lit(1)).alias("rows")), data, mode="overwrite", all_days=True)
    files = sorted(
        row["path"]
        for row in _listing(spark, data).where(F.col("path").endswith(".parquet")).collect()
    )
    last = ledger.agg(F.max("sequence")).first()[0] or 0
    row = {
        "batch_id": batch_id,
        "sequence": last + 1,
        "committed_at": committed_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
        "row_count": int(seen.get["rows"]),
        "data_files": files,
    }
    commit = spark.createDataFrame([tuple(row[f.name] for f in COMMITS.fields)], COMMITS)
    commit.coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/{folder}")
    return row


def committed_files(ledger: DataFrame) -> DataFrame:
    """Every data file of the commits once, with the first commit that has it."""
    return (
        ledger.select("sequence", "batch_id", F.explode("data_files").alias("data_file"))
        .groupBy("data_file")
        .agg(F.min_by(F.struct("sequence", "batch_id"), "sequence").alias("c"))
        .select("data_file", "c.*")
    )


_PLACE = r"(batch=[^/]+/event_date=[^/]+)/"


def read_committed(
    spark: SparkSession,
    root: str,
    after_sequence: int = 0,
    days: Sequence[dt.date] | None = None,
    commits: DataFrame | None = None,
    places: DataFrame | None = None,
    with_place: bool = False,
) -> DataFrame:
    """Events of all commits (or those after a sequence number), each file once.

    ``days`` keeps only the files of these days; files hold one day each. ``commits`` are
    ledger rows to read instead of all, ``places`` rows (place) that name the days of
    batches to read; ``with_place`` adds that column.
    """
    ledger = commits if commits is not None else read_ledger(spark, root)
    found = committed_files(ledger.where(F.col("sequence") > after_sequence)).select("data_file")
    if days is not None:
        day = F.regexp_extract("data_file", r"event_date=(\d{4}-\d{2}-\d{2})", 1)
        found = found.where(day.isin([d.isoformat() for d in days]))
    if places is not None:
        found = found.withColumn("place", F.regexp_extract("data_file", _PLACE, 1)).join(places, "place", "left_semi")
    files = [row["data_file"] for row in found.collect()]
    if not files:
        nothing = spark.createDataFrame([], EVENTS)
        return nothing.withColumn("place", F.lit("")) if with_place else nothing
    events = read_events(spark, files).drop("event_date")
    return events.withColumn("place", F.regexp_extract("_metadata.file_path", _PLACE, 1)) if with_place else events


def _ordered(order_col: str | None) -> Column:
    # Rows that arrive later win when the order column ties.
    parts = [F.col(order_col)] if order_col else []
    return F.struct(*parts, F.col("__new"))


def merge_latest(
    current: DataFrame | None, changes: DataFrame, keys: Sequence[str], order_col: str | None
) -> DataFrame:
    """One row per key: the one with the highest order column, changes winning ties."""
    rows = changes.withColumn("__new", F.lit(1))
    if current is not None:
        rows = current.withColumn("__new", F.lit(0)).unionByName(rows)
    rest = [c for c in changes.columns if c not in keys]
    merged = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), _ordered(order_col)).alias("__row"))
    return merged.select(*keys, "__row.*").select(*changes.columns)


def upsert(
    changes: DataFrame,
    path: str,
    keys: Sequence[str],
    order_col: str | None = None,
    partition_by: str | None = None,
) -> None:
    """Replace rows by key; applying the same changes twice gives the same table.

    With ``partition_by`` (a column of every key's row that never changes, such as
    the day of the bucket) only the touched partitions are read and rewritten.
    """
    spark = changes.sparkSession
    if partition_by is not None:
        touched = [r[0] for r in changes.select(partition_by).distinct().collect()]
        current = None
        if exists(spark, path):
            current = spark.read.parquet(path).where(F.col(partition_by).isin(touched))
            current = current.select(*changes.columns)
        (
            merge_latest(current, changes, keys, order_col)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(partition_by)
            .parquet(path)
        )
        return
    version = current_version(spark, path)
    current = read_table(spark, path) if version else None
    merged = merge_latest(current, changes, keys, order_col)
    publish(merged, path, version + 1)


def replace_groups(
    rows: DataFrame, path: str, partition_by: str, touched: Sequence[object] | None = None
) -> None:
    """Overwrite whole partitions with recomputed rows; other partitions stay.

    ``touched`` lists the recomputed partitions; those that come out empty are
    removed. Which ones were written is observed during the write itself.
    """
    spark = rows.sparkSession
    seen = Observation()
    (
        rows.observe(seen, F.collect_set(F.col(partition_by).cast("string")).alias("written"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_by)
        .parquet(path)
    )
    written = set(seen.get["written"])
    for value in touched or []:
        files, location = _hadoop(spark, f"{path}/{partition_by}={value}")
        if str(value) not in written and files.exists(location):
            files.delete(location, True)


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the published version of an unpartitioned table, 0 if none."""
    pointer = f"{path}/_current"
    if not exists(spark, pointer):
        return 0
    return int(spark.read.text(pointer).agg(F.max(F.col("value").cast("int"))).first()[0] or 0)


def publish(rows: DataFrame, path: str, version: int) -> None:
    """Write a version of an unpartitioned table, then make it the current one."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/v={version}")
    spark.createDataFrame([(str(version),)], "value string").coalesce(1).write.mode("append").text(
        f"{path}/_current"
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The published version of a table written by ``upsert``."""
    version = current_version(spark, path)
    if version:
        return spark.read.parquet(f"{path}/v={version}")
    return spark.read.parquet(path)


_POINTERS = "number bigint, slot int, step string, filled boolean, slots int, columns string"


def _slot(keys: Sequence[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(slots)).cast("int")


def _pointers(spark: SparkSession, path: str) -> DataFrame:
    """The newest pointer of each slot: at most as many rows as the table has slots."""
    rows = spark.createDataFrame([], _POINTERS)
    if exists(spark, f"{path}/_slots"):
        rows = spark.read.schema(_POINTERS).option("recursiveFileLookup", "true").parquet(f"{path}/_slots")
    rest = F.struct("number", "step", "filled", "slots", "columns")
    return rows.groupBy("slot").agg(F.max_by(rest, "number").alias("p")).select("slot", "p.*")


def replace_slots(rows: DataFrame, gone: DataFrame, path: str, keys: Sequence[str], slots: int) -> list[int]:
    """Put ``rows`` in place of all rows of the groups ``gone`` (``keys``); returns the slots rewritten.

    A group's slot is a hash of its keys. Only slots of such groups are read and written,
    into a folder of the step's own; one pointer row per slot, all in one file, then
    makes them current, so readers see the step whole or not at all.
    """
    spark = rows.sparkSession
    known = _pointers(spark, path).collect()
    slots = known[0]["slots"] if known else slots
    number = max((p["number"] for p in known), default=0) + 1
    touched = [r["slot"] for r in gone.select(_slot(keys, slots).alias("slot")).distinct().collect()]
    current = read_slots(spark, path, touched) if known else None
    if current is not None:
        rows = current.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(*rows.columns).unionByName(rows)
    step, seen = uuid.uuid4().hex, Observation()
    placed = rows.withColumn("__slot", _slot(keys, slots)).hint("rebalance", "__slot")
    placed.observe(seen, F.collect_set("__slot").alias("filled")).write.partitionBy("__slot").parquet(f"{path}/step={step}")
    filled, columns = set(seen.get["filled"]), json.dumps(rows.schema.jsonValue())
    pointers = [(number, slot, step, slot in filled, slots, columns) for slot in touched]
    if pointers:
        spark.createDataFrame(pointers, _POINTERS).coalesce(1).write.parquet(f"{path}/_slots/{step}")
    return touched


def read_slots(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame | None:
    """The current rows of a table kept by ``replace_slots``, or of some slots of it; None before its first step."""
    pointers = _pointers(spark, path).collect()
    if not pointers:
        return None
    schema = StructType.fromJson(json.loads(max(pointers, key=lambda p: p["number"])["columns"]))
    wanted = [p for p in pointers if p["filled"] and (only is None or p["slot"] in set(only))]
    folders = [f"{path}/step={p['step']}/__slot={p['slot']}" for p in wanted]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path with their sizes; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select("path", F.col("length").alias("bytes"))
    )


def compact(
    spark: SparkSession,
    path: str,
    small_bytes: int = SMALL_FILE_BYTES,
    target_bytes: int = TARGET_FILE_BYTES,
    min_small_files: int = MIN_SMALL_FILES,
    partition_by: str = "event_date",
) -> dict:
    """Rewrite the partitions that have too many small files; rows are preserved.

    Files are cut by range over (partition, tenant, time) into about the target
    size, so a large day is rewritten by many tasks. A store with a ledger is refused:
    its commits name their files.
    """
    if any(exists(spark, f"{at}/commits") for at in (path, f"{path}/..")):
        raise ValueError("the files of a store with commits cannot be rewritten")
    sizes = _listing(spark, path).withColumn(
        "part", F.regexp_extract("path", rf"{partition_by}=([^/]+)", 1)
    )
    per_part = (
        sizes.groupBy("part")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("bytes").alias("bytes"),
            F.count_if(F.col("bytes") < small_bytes).alias("small"),
        )
        .where(F.col("small") >= min_small_files)
        .collect()
    )
    result = {"compacted": False, "partitions": 0, "input_files": 0, "rows": 0}
    if not per_part:
        return result
    touched = [row["part"] for row in per_part]
    total = sum(row["bytes"] for row in per_part)
    table = spark.read.parquet(path).where(F.col(partition_by).cast("string").isin(touched))
    before = table.count()
    order = [c for c in (partition_by, "tenant_id", "timestamp") if c in table.columns]
    seen = Observation()
    (
        table.repartitionByRange(max(len(touched), math.ceil(total / target_bytes)), *order)
        .sortWithinPartitions(*order)
        .observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_by)
        .parquet(path)
    )
    if seen.get["rows"] != before:
        raise RuntimeError(f"compaction changed the row count: {before} to {seen.get['rows']}")
    return {
        "compacted": True,
        "partitions": len(touched),
        "input_files": sum(row["files"] for row in per_part),
        "rows": before,
    }


# URL schemes that mean object storage.
OBJECT_STORES = ("s3://", "s3a://", "gs://", "abfs://", "abfss://")


def audit_files(
    spark: SparkSession, path: str, ledger: DataFrame, small_bytes: int = SMALL_FILE_BYTES
) -> DataFrame:
    """Metrics of a store as (metric, value) rows: commits, sequences, files, bytes."""
    commits = ledger.agg(
        F.count(F.lit(1)).alias("commit_count"),
        F.coalesce(F.min("sequence"), F.lit(0)).alias("first_sequence"),
        F.coalesce(F.max("sequence"), F.lit(0)).alias("last_sequence"),
    )
    remote = F.lit(False)
    for scheme in OBJECT_STORES:
        remote = remote | F.lower("data_file").startswith(scheme)
    listed = _listing(spark, path).select(F.col("path").alias("data_file"), "bytes")
    files = (
        committed_files(ledger)
        .join(listed, "data_file", "left")
        .agg(
            F.count(F.lit(1)).alias("data_file_count"),
            F.coalesce(F.sum("bytes"), F.lit(0)).alias("known_data_file_bytes"),
            F.count_if(F.col("bytes") < small_bytes).alias("small_data_file_count"),
            F.count_if(remote).alias("object_store_data_file_count"),
            F.count_if(F.col("bytes").isNull()).alias("missing_data_file_count"),
        )
    )
    parts = []
    for metrics in (commits, files):
        pairs = F.array(
            *[
                F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value"))
                for c in metrics.columns
            ]
        )
        parts.append(metrics.select(F.inline(pairs)))
    return parts[0].unionByName(parts[1])
