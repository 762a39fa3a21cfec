"""Request bodies, batch records, payload clean-up, appends, deliveries, tenant scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.alerts import after_attempt, due_notifications
from tidemark.operators.normalize import discover_metric_definitions, normalize, rename_keys, typed_payload
from tidemark.session import shared_folder
from tidemark.sources.events import explode_batch_records, split_bodies, write_invalid
from tidemark.sources.star import events, load
from tidemark.sources.tables import append_batch, read_committed
from tidemark.workspace import Workspace
from workload.registry import big, ms, query


def _key() -> Column:
    return F.col("o_orderkey")


def _tenant() -> Column:
    return F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string"))


def _iso(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _event(prefix: str, **changes: Column) -> Column:
    """An order as an event; its payload claims another tenant."""
    members = {
        "event_id": F.concat(F.lit(prefix), _key().cast("string")),
        "timestamp": _iso("o_orderdate"),
        "data": F.struct(F.col("o_orderstatus").alias("status"), F.lit("forged").alias("tenant_id")),
        **changes,
    }
    return F.struct(*[value.alias(name) for name, value in members.items()])


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies: of eleven orders six send an unusable one, the others a batch of two."""
    one = lambda **changes: F.to_json(F.array(_event("o", **changes)))
    body = (
        F.when(_key() % 11 == 0, F.lit("[]"))
        .when(_key() % 11 == 1, F.concat(F.lit('{"event_id": '), _key().cast("string")))
        .when(_key() % 11 == 2, one(event_id=F.lit(" ")))
        .when(_key() % 11 == 3, one(data=F.col("o_orderstatus")))
        .when(_key() % 11 == 4, one(timestamp=F.lit("soon")))
        .when(_key() % 11 == 5, F.lit("7"))
        .otherwise(F.to_json(F.array(_event("o"), _event("p"))))
    )
    return load(spark, sf_dir, "orders").select(
        _tenant().alias("tenant_id"),
        F.date_trunc("year", "o_orderdate").alias("received_at"),
        F.col("o_orderpriority").alias("source_file"),
        body.alias("body"),
    )


@query(
    "normalized_events",
    """SELECT 't' || (o_custkey % 4) AS tenant_id, p.prefix || o_orderkey AS event_id,
      epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS ms, p.place AS source_offset,
      o_orderstatus AS status, 't' || (o_custkey % 4) AS owner, 't' || (o_custkey % 4) AS organization
    FROM orders, (VALUES ('o', 0::BIGINT), ('p', 1::BIGINT)) p(prefix, place) WHERE o_orderkey % 11 > 5""",
)
def normalized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = normalize(split_bodies(_bodies(spark, sf_dir)))
    payload = lambda name: F.get_json_object("data", f"$.{name}")
    return valid.select(
        "tenant_id", "event_id", ms("timestamp").alias("ms"), "source_offset",
        payload("status").alias("status"), payload("tenant_id").alias("owner"),
        payload("organization_id").alias("organization"),
    )


@query(
    "stored_rejects",
    """SELECT 't' || (o_custkey % 4) AS tenant_id, strftime(o_orderdate, '%Y-01-01') AS day,
      ['batch must contain at least one event', 'invalid JSON body', 'event_id must be a non-empty string',
       'data must be a JSON object', 'timestamp is not a time', 'event must be a JSON object'][o_orderkey % 11 + 1] AS reason,
      count(*) AS rejects
    FROM orders WHERE o_orderkey % 11 <= 5 GROUP BY ALL""",
)
def stored_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, invalid = normalize(split_bodies(_bodies(spark, sf_dir)))
    folder = shared_folder(spark, "rejects")
    write_invalid(invalid, folder)
    day = F.date_format("observed_date", "yyyy-MM-dd").alias("day")
    return spark.read.parquet(folder).groupBy("tenant_id", day, "reason").agg(F.count("*").alias("rejects"))


@query(
    "batch_records",
    """SELECT 'b' || o_orderkey AS batch_id, (o_custkey % 8) * 281474976710656 + o_orderkey AS sequence,
      CASE WHEN p.prefix = 'p' THEN 'own' ELSE 't' || (o_custkey % 4) END AS tenant_id,
      p.prefix || o_orderkey AS event_id, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS ms, o_orderstatus AS status
    FROM orders, (VALUES ('o'), ('p')) p(prefix)""",
)
def batch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    record = F.struct(
        F.concat(F.lit("b"), _key().cast("string")).alias("batch_id"),
        _tenant().alias("tenant_id"),
        F.array(_event("o", tenant_id=none), _event("p", tenant_id=F.lit("own"))).alias("events"),
    )
    records = load(spark, sf_dir, "orders").select(
        F.to_json(record).alias("value"), (F.col("o_custkey") % 8).alias("partition"), _key().alias("offset")
    )
    return explode_batch_records(records).select(
        "batch_id", "sequence", "tenant_id", "event_id", ms("timestamp").alias("ms"),
        F.get_json_object("data", "$.status").alias("status"),
    )


def _payloads(spark: SparkSession, sf_dir: str, **members: Column) -> DataFrame:
    """The stream table with a payload of the given members; nulls are left out."""
    data = F.to_json(F.struct(*[value.alias(name) for name, value in members.items()]))
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").alias("timestamp"),
        F.lit("metric").alias("event_type"),
        data.alias("data"),
    )


@query(
    "renamed_keys",
    """SELECT CAST(event_id AS VARCHAR) AS event_id,
      CASE WHEN event_id % 3 = 0 THEN 'own' ELSE 'u' || user_id END AS user_id,
      't' || (event_id // 8) AS trace_id, event_type AS other, 3::BIGINT AS members FROM events""",
)
def renamed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _payloads(
        spark, sf_dir,
        userId=F.concat(F.lit("u"), F.col("user_id").cast("string")),
        user_id=F.when(F.col("event_id") % 3 == 0, F.lit("own")),
        traceId=F.concat(F.lit("t"), F.floor(F.col("event_id") / 8).cast("string")),
        other=F.col("event_type"),
    ).select("event_id", rename_keys(F.col("data")).alias("data"))
    return rows.select(
        "event_id",
        *[F.get_json_object("data", f"$.{name}").alias(name) for name in ("user_id", "trace_id", "other")],
        big(F.size(F.json_object_keys("data"))).alias("members"),
    )


@query(
    "typed_payloads",
    """SELECT CAST(event_id AS VARCHAR) AS event_id,
      CASE WHEN event_id % 7 <> 0 THEN event_id % 25 END AS severity_number,
      CASE WHEN event_type = 'error' THEN 1::BIGINT ELSE 0::BIGINT END AS is_error,
      round(value, 4) AS duration_ms, epoch_ms(date_trunc('second', ts)) AS start_ms,
      event_type AS country FROM events""",
)
def typed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    rows = _payloads(
        spark, sf_dir,
        severity_number=F.when(event % 7 == 0, F.lit("high")).otherwise((event % 25).cast("string")),
        is_error=F.col("event_type") == "error",
        duration_ms=F.col("value"),
        start_time=_iso("ts"),
        country=F.col("event_type"),
    )
    return typed_payload(rows).select(
        "event_id", big("severity_number").alias("severity_number"), big("is_error").alias("is_error"),
        F.round("duration_ms", 4).alias("duration_ms"), ms("start_time").alias("start_ms"), "country",
    )


@query(
    "discovered_metrics",
    """SELECT 't' || (user_id % 4) AS tenant_id, event_type AS metric_name,
      'sdk_managed_metric_rollup_' || substr(sha256('metric_rollup.' || event_type), 1, 16) AS definition_id,
      'metric.' || event_type AS name,
      CASE WHEN bool_or(event_id % 5 = 0) THEN 'deep.er,plan' ELSE 'plan' END AS dimensions
    FROM events GROUP BY user_id % 4, event_type""",
)
def discovered_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _payloads(
        spark, sf_dir,
        metric_name=F.col("event_type"),
        metric_type=F.lit("gauge"),
        metric_value=F.col("value"),
        plan=F.lit("pro"),
        tags=F.array(F.lit("x")),
        deep=F.when(F.col("event_id") % 5 == 0, F.struct(F.lit("y").alias("er"))),
    )
    names = "from_json(get_json_object(config, '$.outputs[0].dimensions'), 'array<struct<name: string>>').name"
    return discover_metric_definitions(rows).select(
        "tenant_id", F.get_json_object("config", "$.metric_name").alias("metric_name"), "definition_id", "name",
        F.array_join(F.expr(names), ",").alias("dimensions"),
    )


@query(
    "delivery_steps",
    """WITH tried AS (
      SELECT o_orderkey, o_orderkey % 7 + 1 AS attempt, o_orderkey % 3 = 0 AS ok FROM orders
      WHERE o_orderkey % 10 <> 0 AND o_orderdate <= TIMESTAMP '1997-01-01'
    )
    SELECT o_orderkey, attempt, ok AS delivered,
      CASE WHEN ok THEN 'delivered' WHEN attempt >= 5 THEN 'failed' ELSE 'retry' END AS status,
      CASE WHEN ok OR attempt >= 5 THEN 0 ELSE 30 * CAST(pow(2, attempt) AS BIGINT) END AS wait_seconds,
      CASE WHEN ok THEN '' ELSE 'refused' END AS last_error
    FROM tried""",
)
def delivery_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("1997-01-01 00:00:00").cast("timestamp")
    outbox = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(_key() % 10 == 0, F.lit("delivered")).when(_key() % 7 == 0, F.lit("pending"))
        .otherwise(F.lit("retry")).alias("status"),
        (_key() % 7).alias("attempt"),
        F.lit(5).alias("max_attempts"),
        F.col("o_orderdate").cast("timestamp").alias("next_attempt_at"),
    )
    tried = due_notifications(outbox, now).select("*", (_key() % 3 == 0).alias("ok"), F.lit("refused").alias("error"))
    wait = F.unix_seconds("next_attempt_at") - F.unix_seconds(now)
    return after_attempt(tried, now).select(
        "o_orderkey", big("attempt").alias("attempt"), F.col("delivered_at").isNotNull().alias("delivered"), "status",
        F.when(F.col("status") == "delivered", F.lit(0)).otherwise(wait).cast("bigint").alias("wait_seconds"),
        "last_error",
    )


@query(
    "committed_batches",
    """WITH {EV} SELECT tenant_id, event_type, count(*) AS events, round(sum(value), 4) AS value
    FROM ev GROUP BY tenant_id, event_type""",
)
def committed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, one of them delivered twice, read through the commits."""
    source = events(spark, sf_dir)
    store = shared_folder(spark, "store")
    even = F.col("event_id").cast("bigint") % 2 == 0
    for batch, rows in (("even", even), ("odd", ~even), ("even", even)):
        append_batch(source.where(rows), store, batch)
    return (
        read_committed(spark, store)
        .groupBy("tenant_id", "event_type")
        .agg(F.count("*").alias("events"), F.round(F.sum("duration_ms"), 4).alias("value"))
    )


_BY_TYPE = "SELECT tenant_id, event_type, count(*) AS events FROM {events} GROUP BY tenant_id, event_type"


@query(
    "tenant_scope",
    "WITH {EV} SELECT tenant_id, event_type, count(*) AS events FROM ev WHERE tenant_id = 't1' GROUP BY ALL",
)
def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workspace({"events": events(spark, sf_dir)}, "t1").sql(_BY_TYPE)


@query("admin_scope", "WITH {EV} SELECT tenant_id, event_type, count(*) AS events FROM ev GROUP BY ALL")
def admin_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workspace.admin({"events": events(spark, sf_dir)}).sql(_BY_TYPE)
