"""Bookkeeping tables: query usage, promotion advice, job progress, output versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.events import bucket
from tidemark.functions.quantiles import sketch


def usage_hot_shapes(
    usage: DataFrame,
    min_runs: int = 3,
    min_bytes: int = 1_000_000_000,
    min_p95_ms: float = 1000.0,
    limit: int | None = None,
) -> DataFrame:
    """Query shapes that run often, read much or are slow; all of them, or the ``limit`` that read most.

    Expects ``query_hash``, ``query_shape``, ``read_bytes``, ``read_rows``,
    ``elapsed_ms``, ``source_tables`` (array), ``observed_at``. The p95 is a
    sketch (as the shape's own log may be large); table names are few and are
    combined as sets.
    """
    tables = (
        usage.select("query_hash", F.explode_outer("source_tables").alias("table"))
        .groupBy("query_hash")
        .agg(F.array_sort(F.collect_set("table")).alias("source_tables"))
    )
    shapes = usage.groupBy("query_hash").agg(
        F.max_by("query_shape", "observed_at").alias("query_shape"),
        F.count(F.lit(1)).alias("runs"),
        F.sum("read_bytes").alias("read_bytes"),
        F.sum("read_rows").alias("read_rows"),
        F.kll_sketch_get_quantile_double(sketch(F.col("elapsed_ms").cast("double")), F.lit(0.95))
        .alias("p95_ms"),
        F.max("observed_at").alias("last_seen"),
    )
    hot = shapes.where(
        (F.col("runs") >= min_runs)
        | (F.col("read_bytes") > min_bytes)
        | (F.col("p95_ms") > min_p95_ms)
    )
    ranked = hot.join(tables, "query_hash").orderBy(F.col("read_bytes").desc(), F.col("query_hash").asc())
    return ranked if limit is None else ranked.limit(limit)


# What to advise, as data: where a rule looks, when it holds, and what it says.
_PATH = "f.path <> ''"
_UNINDEXED = f"f.strategy = 'raw_expression' and {_PATH}"
_GENERIC = f"f.strategy in ('kv_index', 'scoped_kv_index') and {_PATH}"
_ORDERED = "f.operator in ('gt', 'gte', 'lt', 'lte')"
_FILTER_ADVICE = (
    # condition, target, table, why, whether the operator is told
    (f"{_UNINDEXED} and f.operator = 'contains'", "search", "event_text_index", "substring looked up in payloads", False),
    (f"{_UNINDEXED} and f.operator <> 'contains'", "field", "field_index", "field read from payloads", False),
    (_GENERIC, "field", "field_index", "field without an index of its own", False),
    (f"{_UNINDEXED} and {_ORDERED}", "measure", "event_measures", "number compared in payloads", True),
    (f"{_GENERIC} and {_ORDERED}", "measure", "event_measures", "number compared in the general index", True),
)
_SCANS = "('raw_events', 'raw_text_scan', 'table_scan')"
_QUERY_ADVICE = (
    # condition, kind, target, table, why, source, group_by
    ("plan_kind = 'raw_text_scan'", "route", "search", "event_text_index", "text looked up in payloads", "null", "null"),
    (f"surface = 'events' and size(group_by) > 0 and (plan_kind in {_SCANS} or plan_kind in ('kv_index_join', 'mixed'))",
     "materialization", "report", "report_results", "groups counted from events each time",
     "coalesce(event_view, 'events')", "array_join(group_by, ',')"),
    (f"surface = 'sql' and plan_kind in {_SCANS} and array_contains(source_tables, 'events')",
     "materialization", "report", "report_results", "SQL reads the event table itself", "null", "null"),
)


def _advice(holds: str, kind: str, target: str, table: str, why: str, **told: str) -> str:
    told = {name: told.get(name, "null") for name in ("path", "source", "operator", "group_by")}
    fields = "".join(f", '{name}', cast({value} as string)" for name, value in told.items())
    return (
        f"if({holds}, named_struct('kind', '{kind}', 'target_type', '{target}', 'target_table', '{table}',"
        f" 'reason', '{why}'{fields}), null)"
    )


def recommendations(usage: DataFrame) -> DataFrame:
    """What to promote, from a usage log.

    Expects ``query_hash``, ``surface``, ``plan_kind``, ``event_view``,
    ``source_tables`` (array), ``group_by`` (array) and ``filters``, an array of
    (path, operator, strategy, role). One row per query hash and distinct advice, with
    the number of queries it is for. The rules are the tables above.
    """
    of_query = [
        _advice(holds, kind, target, table, why, source=source, group_by=group_by)
        for holds, kind, target, table, why, source, group_by in _QUERY_ADVICE
    ]
    of_filter = [
        _advice(
            holds, "promotion", target, table, why,
            path="f.path", source="coalesce(f.role, 'facet')", operator="f.operator" if told else "null",
        )
        for holds, target, table, why, told in _FILTER_ADVICE
    ]
    every = (
        f"concat(array({', '.join(of_query)}), flatten(transform(filters, f -> array({', '.join(of_filter)}))))"
    )
    found = usage.select("query_hash", F.expr(f"explode(array_distinct(array_compact({every})))").alias("a"))
    found = found.select("query_hash", "a.*")
    return found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("queries"))


def job_progress(chunks: DataFrame) -> DataFrame:
    """Status of each job from its chunks."""
    done, failed = F.col("completed_chunks"), F.col("failed_chunks")
    return (
        chunks.groupBy("tenant_id", "job_id")
        .agg(
            F.count_if(F.col("status") == "completed").alias("completed_chunks"),
            F.count_if(F.col("status") == "failed").alias("failed_chunks"),
            F.sum("rows_scanned").alias("rows_scanned"),
            F.sum("rows_written").alias("rows_written"),
            F.count(F.lit(1)).alias("total_chunks"),
        )
        .withColumn(
            "status",
            F.when(failed > 0, F.lit("failed"))
            .when(done >= F.col("total_chunks"), F.lit("completed"))
            .otherwise(F.lit("running")),
        )
    )


def output_versions(rows: DataFrame, id_column: str, version_column: str, time: str) -> DataFrame:
    """Rows and covered time of every materialised output version."""
    return rows.groupBy(
        "tenant_id",
        F.col(id_column).alias("target_id"),
        F.col(version_column).alias("target_version"),
    ).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(time).alias("window_start"),
        F.max(time).alias("window_end"),
    )


def top_entities(
    measures: DataFrame, measure_name: str, seconds: int, n: int = 10
) -> DataFrame:
    """The n dimension values with the largest sums per bucket.

    Sums come first (map-side), so the ranking sees one row per value; only
    values that can still be in the top n of their salt group go on to the final
    ranking, which keeps a bucket with very many values off a single task.
    """
    from pyspark.sql import Window

    sums = (
        measures.where(F.col("measure_name") == measure_name)
        .groupBy(
            bucket(F.col("timestamp"), seconds).alias("bucket_time"),
            "dimension_name",
            "dimension_value",
        )
        .agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("count"))
        .withColumn("salt", F.pmod(F.xxhash64("dimension_value"), F.lit(64)))
    )
    group = ["bucket_time", "dimension_name"]
    order = [F.col("total").desc(), F.col("dimension_value").asc()]
    local = Window.partitionBy(*group, "salt").orderBy(*order)
    ranked = Window.partitionBy(*group).orderBy(*order)
    return (
        sums.withColumn("rank", F.row_number().over(local))
        .where(F.col("rank") <= n)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= n)
        .drop("salt")
    )


def threshold_windows(
    events: DataFrame, condition: Column, seconds: int, threshold: int, keys: list[str]
) -> DataFrame:
    """Windows in which at least ``threshold`` events satisfy a condition."""
    return (
        events.where(condition)
        .groupBy(*keys, bucket(F.col("timestamp"), seconds).alias("bucket_time"))
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") >= threshold)
    )
