"""Business tables as events: a generic stream table mapped to canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.events import signal
from tidemark.schema import EVENT_COLUMNS
from tidemark.session import spread


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables; times without a zone are read as UTC."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoned = [f.name for f in table.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    for column in zoned:
        table = table.withColumn(column, F.col(column).cast("timestamp"))
    return table


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])


def adapt_events(table: DataFrame) -> DataFrame:
    """The stream table (event_id, ts, user_id, event_type, value, props) as canonical
    events: tenants, traces of eight spans, sessions by day, and a nested payload."""
    event, user = F.col("event_id"), F.col("user_id")
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("bigint")
    explicit = F.when(kind != "error", F.lit("analytics"))
    status = F.when(event % 97 == 0, F.lit("error")).otherwise(F.lit("ok"))
    plan = F.element_at(F.array(*map(F.lit, ("free", "pro", "enterprise"))), (user % 3 + 1).cast("int"))
    country = F.element_at(
        F.array(*map(F.lit, ("DE", "FR", "JP", "US"))), (user % 4 + 1).cast("int")
    )
    values = {
        "tenant_id": _text("t", user % 4),
        "event_type": kind,
        "signal": explicit,
        "name": kind,
        "service": _text("svc", event % 5),
        "environment": F.when(event % 10 < 7, F.lit("prod")).otherwise(F.lit("dev")),
        "user_id": _text("u", user),
        "account_id": _text("a", user % 20),
        "session_id": _text(user, "-", F.date_format("ts", "yyyy-MM-dd")),
        "trace_id": _text("t", F.expr("event_id div 8")),
        "span_id": _text("s", event),
        "parent_span_id": F.when(event % 8 != 0, _text("s", event - 1)),
        "duration_ms": F.col("value"),
        "is_error": (kind == "error").cast("bigint"),
        "span_status_code": status,
        "metric_value": F.col("value"),
        "plan": plan,
        "country": country,
        "revenue": F.when(kind == "purchase", F.col("value")),
        "currency": F.when(kind == "purchase", F.when(user % 2 == 0, F.lit("EUR")).otherwise(F.lit("USD"))),
    }
    nested = {
        "props": F.struct(k.alias("k")),
        "http.route": _text("/r", k % 10),
        "http": F.struct(
            F.struct((F.lit(200) + (k % 4) * 100).alias("status_code")).alias("response")
        ),
        "tags": F.array(plan, kind, plan),
        "items": F.array(
            F.struct((k % 7).alias("sku"), (event % 3).alias("qty")),
            F.struct((k % 5).alias("sku"), (event % 4).alias("qty")),
        ),
    }
    members = {**values, **nested}
    data = F.to_json(F.struct(*[v.alias(n) for n, v in members.items()]))
    blank = lambda n: F.coalesce(values[n], F.lit("")).alias(n)
    columns = {
        "event_id": event.cast("string"),
        "timestamp": F.col("ts"),
        "observed_timestamp": F.lit(None).cast("timestamp"),
        "ingested_timestamp": F.col("ts"),
        "signal": signal(explicit, kind),
        "duration_ms": values["duration_ms"],
        "is_error": values["is_error"],
        "source_file": F.lit("events"),
        "source_offset": event,
        "source_length": F.lit(0).cast("bigint"),
        "data": data,
    }
    return table.select(
        *[columns[c].alias(c) if c in columns else blank(c) for c in EVENT_COLUMNS]
    )


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream table as events, for queries that do not read the payload: it is
    then never built."""
    return adapt_events(spread(load(spark, sf_dir, "events")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream table as events, for queries on the payload."""
    return _built(adapt_events(spread(load(spark, sf_dir, "events"))))


def _built(rows: DataFrame) -> DataFrame:
    """Build the payload once per row, as if it had been stored.

    It passes through a generator; otherwise the optimizer would repeat building
    it in every filter and projection that reads it.
    """
    rest = [c for c in rows.columns if c != "data"]
    return rows.select(*rest, F.explode(F.array("data")).alias("data"))


def _canonical(rows: DataFrame, data: dict[str, Column]) -> DataFrame:
    """Rows with ``event_id``, ``timestamp``, ``tenant_id`` and payload members."""
    text = {"trace_id", "span_id", "parent_span_id", "service", "environment", "name", "event_type"}
    columns = []
    for c in EVENT_COLUMNS:
        if c in ("event_id", "timestamp", "tenant_id"):
            value = F.col(c)
        elif c == "data":
            value = F.to_json(F.struct(*[v.alias(n) for n, v in data.items()]))
        elif c == "signal":
            value = signal(data.get("signal", F.lit("")), data["event_type"])
        elif c == "ingested_timestamp":
            value = F.col("timestamp")
        elif c in text or c == "span_status_code":
            value = F.coalesce(data[c], F.lit("")) if c in data else F.lit("")
        elif c in data:
            value = data[c]
        else:
            kinds = {"source_file": "string", "observed_timestamp": "timestamp"}
            kinds |= {"duration_ms": "double"}
            value = F.lit(None).cast(kinds.get(c, "bigint"))
        columns.append(value.alias(c))
    return _built(rows.select(*columns))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ``order.placed`` events of their customers."""
    orders = spread(load(spark, sf_dir, "orders"))
    rows = orders.select(
        "*",
        F.col("o_orderkey").cast("string").alias("event_id"),
        F.col("o_orderdate").alias("timestamp"),
        _text("t", F.col("o_custkey") % 4).alias("tenant_id"),
    )
    return _canonical(
        rows,
        {
            "event_type": F.lit("order.placed"),
            "name": F.lit("order"),
            "account_id": _text("c", F.col("o_custkey")),
            "order": F.struct(
                F.col("o_orderstatus").alias("status"),
                F.col("o_totalprice").alias("price"),
                F.col("o_orderpriority").alias("priority"),
            ),
        },
    )


def document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log events, one a second, with their whole text."""
    documents = spread(load(spark, sf_dir, "documents"))
    rows = documents.select(
        "*",
        F.col("doc_id").cast("string").alias("event_id"),
        F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("timestamp"),
        _text("t", F.col("doc_id") % 4).alias("tenant_id"),
    )
    return _canonical(
        rows,
        {
            "event_type": F.lit("log"),
            "lang": F.col("lang"),
            "source": F.col("source"),
            "text": F.col("text"),
        },
    )


def turn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as events of one trace per conversation."""
    turns = spread(load(spark, sf_dir, "conversations"))
    rows = turns.select(
        "*",
        _text(F.col("conv_id"), "/", F.col("turn")).alias("event_id"),
        F.timestamp_seconds(F.col("turn") * 60 + 1_700_000_000).alias("timestamp"),
        F.lit("t0").alias("tenant_id"),
    )
    return _canonical(
        rows,
        {
            "event_type": F.lit("agent.turn"),
            "name": F.col("role"),
            "trace_id": F.col("conv_id").cast("string"),
            "span_id": _text(F.col("conv_id"), "/", F.col("turn")),
            "parent_span_id": F.when(F.col("turn") > 0, _text(F.col("conv_id"), "/", F.col("turn") - 1)),
            "role": F.col("role"),
            "text": F.col("text"),
        },
    )


def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream table as pairs of span start and end events.

    A span lasts as many seconds as its value; every third one never ends.
    """
    table = spread(load(spark, sf_dir, "events"))
    event = F.col("event_id")
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    end = F.timestamp_micros(
        F.unix_micros("ts") + F.round(F.col("value") * 1_000_000).cast("bigint")
    )
    base = table.select(
        "ts",
        event.alias("n"),
        "event_type",
        end.alias("end"),
        _text("t", F.expr("event_id div 8 % 4")).alias("tenant_id"),
    )
    common = {
        "trace_id": _text("t", F.expr("n div 8")),
        "span_id": _text("s", F.col("n")),
        "parent_span_id": F.when(F.col("n") % 8 != 0, _text("s", F.col("n") - 1)),
        "service": _text("svc", F.col("n") % 5),
        "name": F.col("event_type"),
    }
    starts = _canonical(
        base.select("*", _text(F.col("n"), ":start").alias("event_id"), F.col("ts").alias("timestamp")),
        {
            **common,
            "event_type": F.lit("span_start"),
            "start_time": F.date_format("ts", iso),
            "phase": F.lit("start"),
            "begun": F.lit(True),
        },
    )
    ends = _canonical(
        base.where(F.col("n") % 3 != 0).select(
            "*", _text(F.col("n"), ":end").alias("event_id"), F.col("end").alias("timestamp")
        ),
        {
            **common,
            "event_type": F.lit("span_end"),
            "end_time": F.date_format("end", iso),
            "phase": F.lit("end"),
            "is_error": (F.col("event_type") == "error").cast("bigint"),
        },
    )
    return starts.unionByName(ends)
