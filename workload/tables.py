"""Definitions, keyed tables, export, offline SQL, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.filters import filter_facets
from tidemark.operators.freshness import covering_versions
from tidemark.operators.indexes import kv_index
from tidemark.operators.reports import definition_catalogue
from tidemark.operators.usage import job_progress, output_versions, recommendations, usage_hot_shapes
from tidemark.plans.definitions import latest_definitions
from tidemark.plans.facets import Facet
from tidemark.sources.events import export_rows, sequence_number
from tidemark.sources.sql import query as run_sql
from tidemark.sources.star import events, load
from tidemark.sources.tables import merge_latest
from workload.registry import big, ms, query


# Orders as versions of definitions: per customer and priority the newest counts.
def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return orders.select(
        F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")).alias("tenant_id"),
        F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("definition_id"),
        F.col("o_orderstatus").alias("name"),
        F.lit("field").alias("kind"),
        F.lit("facet").alias("mode"),
        F.lit("{}").alias("config"),
        F.col("o_orderkey").alias("version"),
        (F.col("o_orderstatus") != "F").alias("enabled"),
        F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderdate")).alias("deleted_at"),
    )


@query(
    "latest_definitions",
    """SELECT o_custkey || '/' || o_orderpriority AS definition_id, max(o_orderkey) AS version,
    arg_max(o_orderstatus, o_orderkey) AS name FROM orders GROUP BY o_custkey, o_orderpriority
    HAVING arg_max(o_orderstatus, o_orderkey) <> 'F' AND max(o_orderkey) % 10 <> 0""",
)
def active_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_definitions(_definitions(spark, sf_dir), ["field"]).select(
        "definition_id", "version", "name"
    )


@query(
    "latest_by_key",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER
      (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return merge_latest(None, orders, ["o_custkey"], "o_orderkey")


@query(
    "keyed_upsert",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END
      AS o_orderstatus FROM orders""",
)
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changes = current.where(F.col("o_orderkey") % 3 == 0).withColumn("o_orderstatus", F.lit("X"))
    return merge_latest(current, changes, ["o_orderkey"], None)


@query(
    "first_and_last_by_key",
    """SELECT o_custkey, arg_min(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS first_order,
    arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS last_order
    FROM orders GROUP BY o_custkey""",
)
def first_and_last_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("o_orderdate", "o_orderkey")
    return (
        load(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.min_by("o_orderkey", order).alias("first_order"),
            F.max_by("o_orderkey", order).alias("last_order"),
        )
    )


@query(
    "offline_sql",
    """SELECT n.n_name, e.event_type, count(*) AS events, round(sum(e.value), 4) AS value
    FROM events e JOIN customer c ON c.c_custkey = e.user_id
    JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name, e.event_type""",
)
def offline_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        "wide_events": events(spark, sf_dir),
        "customers": f"{sf_dir}/customer.parquet",
        "nations": [f"{sf_dir}/nation.parquet"],
    }
    return run_sql(
        spark,
        """SELECT n.n_name, e.event_type, count(*) AS events, round(sum(e.duration_ms), 4) AS value
        FROM wide_events e
        JOIN customers c ON c.c_custkey = cast(substring(get_json_object(e.data, '$.user_id'), 2) AS bigint)
        JOIN nations n ON n.n_nationkey = c.c_nationkey
        GROUP BY n.n_name, e.event_type""",
        tables,
    )


@query(
    "exported_events",
    """WITH {EV} SELECT event_id, ms, n AS source_offset, plan FROM ev
    WHERE tenant_id = 't1' AND event_type = 'purchase'
      AND timestamp >= TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-25'
      AND currency = 'USD'""",
)
def exported_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export_rows(
        events(spark, sf_dir), tenant="t1", event_type="purchase",
        start="2024-01-03T00:00:00Z", end="2024-01-25T00:00:00Z", text='"currency":"usd"',
    )
    return rows.select(
        "event_id", ms("timestamp").alias("ms"), "source_offset",
        F.try_variant_get("data", "$.plan", "string").alias("plan"),
    )


@query(
    "sequence_numbers",
    """SELECT l_orderkey, l_linenumber,
    CAST(l_linenumber AS BIGINT) * 281474976710656 + l_orderkey AS sequence FROM lineitem""",
)
def sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        sequence_number(F.col("l_linenumber"), F.col("l_orderkey")).alias("sequence"),
    )


# The union of alternatives gives each event once.
@query(
    "branch_union",
    """WITH {EV} SELECT event_id FROM ev WHERE plan = 'pro' OR country = 'DE' OR k = 5""",
)
def branch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return filter_facets(
        e,
        [
            Facet("plan", "eq", "pro"),
            Facet("country", "eq", "DE", join="or"),
            Facet("props.k", "eq", "5", join="or"),
        ],
        kv_index(e),
    ).select("event_id")


# Order lines as a query log: every part is a query shape.
def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    operator = F.element_at(
        F.array(*map(F.lit, ("eq", "gt", "contains"))), (F.col("l_linenumber") % 3 + 1).cast("int")
    )
    strategy = F.when(F.col("l_returnflag") == "R", F.lit("raw_expression")).otherwise(
        F.lit("kv_index")
    )
    return lines.select(
        F.col("l_partkey").alias("query_hash"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("query_shape"),
        (F.col("l_quantity") * 1_000_000).cast("bigint").alias("read_bytes"),
        F.col("l_quantity").cast("bigint").alias("read_rows"),
        (F.col("l_discount") * 1000).alias("elapsed_ms"),
        F.array(F.col("l_returnflag"), F.lit("events")).alias("source_tables"),
        F.col("l_shipdate").alias("observed_at"),
        F.when(F.col("l_linestatus") == "O", F.lit("sql")).otherwise(F.lit("events")).alias("surface"),
        F.when(F.col("l_returnflag") == "A", F.lit("raw_text_scan")).otherwise(
            F.lit("raw_events")
        ).alias("plan_kind"),
        F.lit("groups").alias("event_view"),
        F.array(F.lit("plan")).alias("group_by"),
        F.array(
            F.struct(
                F.lit("country").alias("path"), operator.alias("operator"),
                strategy.alias("strategy"), F.lit("facet").alias("role"),
            )
        ).alias("filters"),
    )


@query(
    "usage_hot_shapes",
    """SELECT l_partkey AS query_hash, count(*) AS runs,
    CAST(sum(CAST(l_quantity * 1000000 AS BIGINT)) AS BIGINT) AS read_bytes,
    array_to_string(list_sort(list_distinct(list(l_returnflag) || ['events'])), ',') AS tables
    FROM lineitem GROUP BY l_partkey HAVING count(*) >= 20
      OR sum(CAST(l_quantity * 1000000 AS BIGINT)) > 800000000
    ORDER BY read_bytes DESC, query_hash LIMIT 50""",
)
def hot_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = usage_hot_shapes(_usage(spark, sf_dir), 20, 800_000_000, 1e9, limit=50)
    return hot.select(
        "query_hash", "runs", "read_bytes", F.array_join("source_tables", ",").alias("tables")
    )


@query(
    "promotion_advice",
    """WITH u AS (SELECT l_partkey AS query_hash, l_linestatus = 'O' AS is_sql,
        l_returnflag = 'A' AS text_scan, ['eq', 'gt', 'contains'][l_linenumber % 3 + 1] AS op,
        l_returnflag = 'R' AS raw FROM lineitem),
    a AS (
      SELECT query_hash, 'route' AS kind, 'search' AS target_type FROM u WHERE text_scan
      UNION ALL SELECT query_hash, 'materialization', 'report' FROM u WHERE NOT is_sql
      UNION ALL SELECT query_hash, 'materialization', 'report' FROM u WHERE is_sql
      UNION ALL SELECT query_hash, 'promotion', CASE WHEN raw AND op = 'contains' THEN 'search'
        ELSE 'field' END FROM u
      UNION ALL SELECT query_hash, 'promotion', 'measure' FROM u WHERE op = 'gt')
    SELECT query_hash, kind, target_type, count(*) AS queries FROM a GROUP BY ALL""",
)
def promotion_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recommendations(_usage(spark, sf_dir))
    return found.groupBy("query_hash", "kind", "target_type").agg(
        F.sum("queries").alias("queries")
    )


@query(
    "job_progress",
    """SELECT l_orderkey AS job_id, count(*) FILTER (l_returnflag = 'N') AS completed_chunks,
    count(*) FILTER (l_returnflag = 'R') AS failed_chunks, count(*) AS total_chunks,
    CAST(sum(l_partkey) AS BIGINT) AS rows_scanned,
    CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'failed'
      WHEN count(*) FILTER (l_returnflag = 'N') >= count(*) THEN 'completed' ELSE 'running' END
      AS status FROM lineitem GROUP BY l_orderkey""",
)
def chunk_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    status = (
        F.when(F.col("l_returnflag") == "N", F.lit("completed"))
        .when(F.col("l_returnflag") == "R", F.lit("failed"))
        .otherwise(F.lit("pending"))
    )
    chunks = lines.select(
        F.lit("t0").alias("tenant_id"), F.col("l_orderkey").alias("job_id"),
        status.alias("status"), F.col("l_partkey").alias("rows_scanned"),
        F.col("l_suppkey").alias("rows_written"),
    )
    return job_progress(chunks).select(
        "job_id", "completed_chunks", "failed_chunks", "total_chunks", "rows_scanned", "status"
    )


@query(
    "output_versions",
    """SELECT o_orderpriority AS target_id, o_custkey % 10 AS target_version, count(*) AS row_count,
    epoch_ms(min(o_orderdate)) AS start_ms, epoch_ms(max(o_orderdate)) AS end_ms FROM orders
    GROUP BY ALL""",
)
def versions_of_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select(
        F.lit("t0").alias("tenant_id"), "o_orderpriority",
        (F.col("o_custkey") % 10).alias("v"), "o_orderdate",
    )
    return output_versions(rows, "o_orderpriority", "v", "o_orderdate").select(
        "target_id", big("target_version").alias("target_version"), "row_count",
        ms("window_start").alias("start_ms"), ms("window_end").alias("end_ms"),
    )


@query(
    "covering_versions",
    """SELECT DISTINCT o_orderpriority AS target_id, o_custkey AS target_version FROM orders
    WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1995-01-01'""",
)
def versions_covering_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = load(spark, sf_dir, "orders").select(
        F.lit("t0").alias("tenant_id"), F.lit("report").alias("target_type"),
        F.col("o_orderpriority").alias("target_id"), F.col("o_custkey").alias("target_version"),
        F.when(F.col("o_orderstatus") == "O", F.lit("completed")).otherwise(F.lit("pending"))
        .alias("status"),
        F.col("o_orderdate").alias("window_start"),
        (F.col("o_orderdate") + F.expr("INTERVAL 10 YEARS")).alias("window_end"),
    )
    return covering_versions(
        marks, "t0", "report", "1995-01-01T00:00:00Z", "1996-01-01T00:00:00Z"
    )


@query(
    "definition_catalogue",
    """SELECT 't' || (c % 4) AS tenant_id, 'field' AS kind, count(*) AS definitions,
    max(v) AS latest_version FROM (
      SELECT o_custkey AS c, max(o_orderkey) AS v, arg_max(o_orderstatus, o_orderkey) AS s
      FROM orders GROUP BY o_custkey, o_orderpriority) WHERE s <> 'F' AND v % 10 <> 0
    GROUP BY c % 4""",
)
def active_definition_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definition_catalogue(_definitions(spark, sf_dir)).select(
        "tenant_id", "kind", "definitions", "latest_version"
    )
