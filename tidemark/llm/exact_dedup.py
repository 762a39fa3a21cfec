"""Exact deduplication with streaming state, checked on full bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_folder, stored, written

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # Else each partition of the state reserves some megabytes for its manifest.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def arrivals(docs: DataFrame, id_col: str, text_col: str, digest=sha256) -> DataFrame:
    """(digest, id, file, row) of each document: its digest, identifier and content locator.

    ``docs`` is a batch or stream that reads files; the locator is the file and the
    row's place in it.
    """
    return docs.select(
        digest(F.coalesce(docs[text_col], F.lit(""))).alias("digest"),
        docs[id_col].cast("long").alias("id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def update_state(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Take all waiting arrivals into the state and return it: (digest, n, id, file, row).

    The state is kept on disk by key, without expiry: for each digest how many
    documents had it, and identifier and locator of the one that stays, which is that
    with the largest id (of equal ids the last locator). A later call with the same
    checkpoint goes on where this one ended. Arrivals are combined before the shuffle,
    so a text that fills a third of the table is one row of each task.
    """
    held = stream.groupBy("digest").agg(
        F.count("*").alias("n"), F.max(F.struct("id", "file", "row")).alias("keep")
    )
    query = (
        held.writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    state = stream.sparkSession.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType.names
    return state.select(
        "key.digest",
        F.col(f"value.{value[0]}").alias("n"),
        F.col(f"value.{value[1]}.id").alias("id"),
        F.col(f"value.{value[1]}.file").alias("file"),
        F.col(f"value.{value[1]}.row").alias("row"),
    )


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session on the same cluster whose streams keep their state in RocksDB."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    for key, value in STATE_STORE.items():
        session.conf.set(key, value)
    return session


def duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """(id, file, row, digest, keep_id, group_size, kept) of every row of ``docs``.

    ``docs`` reads files. Its arrivals are staged as a narrow log, which a stream
    takes into the state; arrivals joined with the state are the decisions. All
    members of a digest with more than one are hits: their full texts are fetched by
    locator and compared, and should texts of one digest differ, its rows are grouped
    anew by text. Null and empty texts are equal; rows without an id are the first to
    be dropped; of rows with the same id and text one stays. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = stored(arrivals(docs, id_col, text_col, digest), "arrivals")
    log = spark.read.parquet(path)
    options = {"maxFilesPerTrigger": files_per_trigger} if files_per_trigger else {}
    stream = stateful_session(spark).readStream.schema(log.schema).options(**options).parquet(path)
    state = update_state(stream, shared_folder(spark, "state"))
    groups = state.select(
        "digest", F.col("n").alias("group_size"), F.col("id").alias("keep_id"),
        F.col("file").alias("keep_file"), F.col("row").alias("keep_row"),
    )
    decided = written(
        log.join(groups, "digest").select(
            "id", "file", "row", "digest", "keep_id", "group_size",
            ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        ),
        "decisions",
    )
    hits = written(decided.where("group_size > 1").select("file", "row", "digest", "id"), "hits")
    text = docs.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
    )
    # Hits grow with the input, so they are never broadcast; the texts are shuffled once.
    content = text.join(hits.hint("merge"), ["file", "row"])
    different = written(
        content.select("digest", "text").distinct().groupBy("digest").count().where("count > 1").select("digest"),
        "collisions",
    )
    if different.isEmpty():
        return decided
    apart = content.join(different, "digest")
    regrouped = apart.groupBy("digest", "text").agg(
        F.count("*").alias("group_size"), F.max(F.struct("id", "file", "row")).alias("keep")
    )
    anew = apart.join(regrouped, ["digest", "text"]).select(
        "id", "file", "row", "digest", F.col("keep.id").alias("keep_id"), "group_size",
        ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"),
    )
    return decided.join(different, "digest", "left_anti").select(*anew.columns).unionByName(anew)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each text, that with the largest id; all columns stay as they are."""
    gone = duplicates(docs, id_col, text_col).where(~F.col("kept")).select("file", "row")
    located = docs.select(
        F.struct(*docs.columns).alias("_doc"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    return located.join(written(gone, "copies"), ["file", "row"], "left_anti").select("_doc.*")
