"""From raw event JSON to valid canonical rows, rejects, and what events contain."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.leaves import scalar_paths
from tidemark.functions.nodes import count_nodes

MAX_EVENT_BYTES = 1_048_576

# SDK field names and the payload keys they are stored under.
KEY_NAMES = {
    "tenantId": "tenant_id",
    "serviceNamespace": "service.namespace",
    "serviceInstanceId": "service.instance.id",
    "serviceVersion": "service_version",
    "hostName": "host.name",
    "hostId": "host.id",
    "traceId": "trace_id",
    "spanId": "span_id",
    "parentSpanId": "parent_span_id",
    "spanKind": "span_kind",
    "spanStatusCode": "span_status_code",
    "spanStatusMessage": "span_status_message",
    "isError": "is_error",
    "userId": "user_id",
    "anonymousId": "anonymous_id",
    "sessionId": "session_id",
    "accountId": "account_id",
    "groupId": "group_id",
    "organizationId": "organization_id",
    "requestId": "request_id",
    "threadId": "thread_id",
    "conversationId": "conversation_id",
    "durationMs": "duration_ms",
    "startTime": "start_time",
    "endTime": "end_time",
    "statusCode": "status_code",
    "loggerName": "logger.name",
    "threadName": "thread.name",
    "metricName": "metric_name",
    "metricType": "metric_type",
    "metricValue": "metric_value",
    "metricUnit": "metric_unit",
    "metricTemporality": "metric.temporality",
    "metricIsMonotonic": "metric.is_monotonic",
    "productId": "product_id",
    "revenueType": "revenue_type",
    "experimentId": "experiment_id",
    "featureFlag": "feature_flag",
    "llmModel": "llm.model",
    "llmProvider": "llm.provider",
    "toolName": "tool_name",
}

# Payload paths that are never metric dimensions.
NOT_DIMENSIONS = (
    "tenant_id", "organization_id", "event_type", "signal", "metric_value", "duration_ms",
    "start_time", "end_time", "span_status_message", "metric_name", "metric_type", "metric_unit",
)


def _members(column: Column | str) -> Column:
    return F.try_variant_get(column, "$", "map<string,variant>")


def _is_kind(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _trimmed_string(members: Column, key: str) -> Column:
    """A member that is a JSON string and not blank, trimmed; else NULL."""
    value = F.element_at(members, key)
    text = F.trim(value.cast("string"))
    return F.when(_is_kind(value, "STRING") & (text != ""), text)


def _as_json(text: Column) -> Column:
    """Text as a JSON string literal (through an array, to get the escaping right)."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def stamp_tenant(data: Column, tenant: Column, organization: Column | None = None) -> Column:
    """Payload members (MAP<STRING,VARIANT>) with the authenticated tenant put in."""
    organization = tenant if organization is None else organization
    stamp = F.create_map(
        F.lit("tenant_id"), F.parse_json(_as_json(tenant)),
        F.lit("organization_id"), F.parse_json(_as_json(organization)),
    )
    rest = F.map_filter(data, lambda k, _: ~k.isin("tenant_id", "organization_id"))
    return F.map_concat(rest, stamp)


# The reasons that stored rejects carry.
NO_OBJECT = "event must be a JSON object"
NO_ID = "event_id must be a non-empty string"
NO_TIME = "timestamp must be a non-empty string"
NO_DATA = "data must be a JSON object"
TOO_LARGE = "event is too large"
ODD_TIME = "timestamp is not a time"


def checked(
    raw: DataFrame, max_event_bytes: int = MAX_EVENT_BYTES, organization: str | None = None
) -> DataFrame:
    """Parse raw event rows and give each a ``reason`` (NULL if it is valid).

    Expects ``raw`` (JSON text) and ``tenant_id`` (authenticated), and optionally
    ``organization_id``, ``source_file``, ``position``, ``received_at``,
    ``body_error``.
    """
    optional = {
        "organization_id": F.lit(organization) if organization else F.col("tenant_id"),
        "source_file": F.lit(""),
        "position": F.lit(0),
        "received_at": F.current_timestamp(),
        "body_error": F.lit(None).cast("string"),
    }
    for name, default in optional.items():
        if name not in raw.columns:
            raw = raw.withColumn(name, default)
    rows = raw.withColumn("__event", _members(F.try_parse_json("raw")))
    event = F.col("__event")
    data = F.element_at(event, "data")
    rows = rows.select(
        "tenant_id",
        "received_at",
        "source_file",
        "position",
        "raw",
        "body_error",
        event.isNull().alias("__no_object"),
        _trimmed_string(event, "event_id").alias("event_id"),
        _trimmed_string(event, "timestamp").alias("__time"),
        _trimmed_string(event, "observed_timestamp").alias("__observed"),
        F.when(
            _is_kind(data, "OBJECT"),
            stamp_tenant(_members(data), F.col("tenant_id"), F.col("organization_id")),
        ).alias("__data"),
    )
    line = F.octet_length(
        F.to_json(
            F.struct(
                "tenant_id", "event_id", F.col("__time").alias("timestamp"),
                F.col("__observed").alias("observed_timestamp"), "source_file",
                F.col("position").alias("source_offset"), F.lit(0).alias("source_length"),
                F.col("__data").alias("data"),
            )
        )
    )
    rows = rows.withColumn("source_length", line.cast("bigint") + 1)
    reason = (
        F.when(F.col("body_error").isNotNull(), F.col("body_error"))
        .when(F.col("__no_object"), F.lit(NO_OBJECT))
        .when(F.col("event_id").isNull(), F.lit(NO_ID))
        .when(F.col("__time").isNull(), F.lit(NO_TIME))
        .when(F.col("__data").isNull(), F.lit(NO_DATA))
        .when(F.col("source_length") > max_event_bytes, F.lit(TOO_LARGE))
        .when(F.try_to_timestamp("__time").isNull(), F.lit(ODD_TIME))
    )
    return rows.withColumn("reason", reason)


def normalize(
    raw: DataFrame, max_event_bytes: int = MAX_EVENT_BYTES, organization: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): rows ready for ``to_canonical``, and rejects with a reason."""
    rows = checked(raw, max_event_bytes, organization)
    return valid_rows(rows), invalid_rows(rows)


def valid_rows(rows: DataFrame) -> DataFrame:
    """Valid rows of ``checked`` with the tenant-stamped payload as JSON text."""
    return rows.where(F.col("reason").isNull()).select(
        "tenant_id",
        "event_id",
        F.try_to_timestamp("__time").alias("timestamp"),
        F.try_to_timestamp("__observed").alias("observed_timestamp"),
        F.col("received_at").alias("ingested_timestamp"),
        "source_file",
        F.col("position").cast("bigint").alias("source_offset"),
        "source_length",
        F.to_json("__data").alias("data"),
    )


def invalid_rows(rows: DataFrame) -> DataFrame:
    """Rejected rows of ``checked``."""
    return rows.where(F.col("reason").isNotNull()).select(
        "tenant_id", F.col("received_at").alias("observed_at"), "reason", "raw"
    )


def dedupe_events(events: DataFrame) -> DataFrame:
    """One row per (tenant, event id): the first by source position.

    The choice is an aggregate, so copies are dropped before the shuffle and a
    key with very many copies is harmless.
    """
    key = ["tenant_id", "event_id"]
    rest = [c for c in events.columns if c not in key]
    first = F.struct("source_file", "source_offset", "timestamp")
    return (
        events.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), first).alias("__row"))
        .select(*key, "__row.*")
        .select(*events.columns)
    )


def dedupe_stored(events: DataFrame) -> DataFrame:
    """``dedupe_events`` for events that are read from files: winners first, rows later.

    The first delivery is found on narrow columns with its place (file and row); whole rows then
    meet the places once, by hash, so payloads are neither aggregated nor sorted. Of
    deliveries at one position the first by place stays.
    """
    located = events.withColumns({"__file": F.xxhash64("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    order = F.struct("source_file", "source_offset", "timestamp", "__file", "__row")
    winners = located.groupBy("tenant_id", "event_id").agg(F.min(order).alias("w")).select("w.__file", "w.__row")
    return located.join(winners.hint("shuffle_hash"), ["__file", "__row"], "left_semi").drop("__file", "__row")


def rename_keys(data: Column, mapping: dict[str, str] | None = None) -> Column:
    """Payload members with SDK names replaced by stored names (JSON text in and out).

    When both names are present the stored name's own value wins.
    """
    mapping = KEY_NAMES if mapping is None else mapping
    table = F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])
    members = _members(F.try_parse_json(data))
    kept = F.map_filter(
        members,
        lambda k, _: ~(
            F.coalesce(F.map_contains_key(table, k), F.lit(False))
            & F.coalesce(F.map_contains_key(members, table[k]), F.lit(False))
        ),
    )
    return F.to_json(F.transform_keys(kept, lambda k, _: F.coalesce(table[k], k)))


def field_inference(events: DataFrame) -> DataFrame:
    """Every payload path with the number of events that have it and its JSON types."""
    return (
        count_nodes(events)
        .groupBy("path")
        .agg(
            F.sum("n").alias("count"),
            F.array_sort(F.collect_set("kind")).alias("types"),
        )
    )


def _safe_name(value: Column) -> Column:
    name = F.regexp_replace(F.trim(value), r"[^A-Za-z0-9_.-]", "_")
    name = F.regexp_replace(name, r"^[_.-]+|[_.-]+$", "")
    return F.when(name == "", F.lit("auto")).otherwise(name)


def discover_metric_definitions(events: DataFrame) -> DataFrame:
    """A rollup definition per tenant and metric name found in metric events.

    Dimensions are the scalar paths seen with the metric, minus the fixed
    attributes. Distinct (metric, path) pairs are combined map-side; the paths of
    one metric are limited by the shape of its payload, not by its volume.
    """
    metrics = events.where(F.col("event_type") == "metric")
    usable = lambda leaf: (
        leaf["value_type"].isin("number", "bool", "string")
        & ~leaf["in_array"]
        & ~leaf["blank"]
        & leaf["path"].rlike(r"^[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*$")
        & ~leaf["path"].isin(*NOT_DIMENSIONS)
    )
    rows = metrics.select(
        "tenant_id",
        F.trim(F.get_json_object("data", "$.metric_name")).alias("metric_name"),
        F.transform(F.filter(scalar_paths(), usable), lambda leaf: leaf["path"]).alias("paths"),
    ).where(F.col("metric_name") != "")
    found = (
        rows.select("tenant_id", "metric_name", F.explode_outer("paths").alias("path"))
        .groupBy("tenant_id", "metric_name")
        .agg(F.array_sort(F.collect_set("path")).alias("paths"))
    )
    quoted = _as_json(F.col("metric_name"))
    dimensions = F.to_json(
        F.transform(
            "paths",
            lambda p: F.struct(p.alias("name"), F.struct(p.alias("path")).alias("value")),
        )
    )
    # Config and id prefix of a discovered definition, as stored ones have them.
    head = {
        "managed_by": "sdk",
        "definition_source": "sdk_metric",
        "metric_name": "@name",
        "match": {
            "all": [
                {"path": "event_type", "op": "eq", "value": "metric"},
                {"path": "metric_name", "op": "eq", "value": "@name"},
                {"path": "metric_value", "op": "is_number"},
            ]
        },
        "outputs": [
            {
                "target": "metric_rollups",
                "metric_name": "@name",
                "metric_kind": {"path": "metric_type", "default": "counter"},
                "value": {"path": "metric_value"},
                "unit": {"path": "metric_unit", "default": ""},
                "dimensions": "@dimensions",
                "bucket_seconds": 60,
            }
        ],
    }
    config = F.replace(F.lit(json.dumps(head)), F.lit('"@name"'), quoted)
    config = F.replace(config, F.lit('"@dimensions"'), dimensions)
    key = F.concat(F.lit("metric_rollup."), F.col("metric_name"))
    return found.select(
        "tenant_id",
        F.concat(
            F.lit("sdk_managed_metric_rollup_"), F.substring(F.sha2(key, 256), 1, 16)
        ).alias("definition_id"),
        _safe_name(F.concat(F.lit("metric."), _safe_name(F.col("metric_name")))).alias("name"),
        F.lit("metric_rollup").alias("kind"),
        F.lit("managed").alias("mode"),
        config.alias("config"),
        F.lit(1).cast("bigint").alias("version"),
        F.lit(True).alias("enabled"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )


# Payload paths with a known type.
TYPED_PATHS = {
    **{
        path: "string"
        for path in (
            "tenant_id", "event_type", "signal", "name", "user_id", "anonymous_id", "account_id",
            "session_id", "group_id", "service", "environment", "http.method", "http.route",
            "http.status_code", "http.response.status_code", "severity_text", "llm.model",
            "llm.provider", "tool_name", "trace_id", "span_id", "parent_span_id", "request_id",
            "organization_id", "thread_id", "conversation_id", "metric_name", "metric_type",
            "metric_unit", "currency", "user_group", "plan", "country", "region",
        )
    },
    "severity_number": "int",
    "start_time": "timestamp",
    "end_time": "timestamp",
    "duration_ms": "double",
    "is_error": "int",
    "metric_value": "double",
    "revenue": "double",
    "joined_at": "timestamp",
}


def typed_payload(events: DataFrame, hints: dict[str, str] | None = None) -> DataFrame:
    """Hinted payload paths as typed columns (dots become underscores); values that do
    not fit their type are NULL. The payload is parsed once."""
    from tidemark.functions.paths import Fields, shred

    hints = TYPED_PATHS if hints is None else hints
    parsed = shred(events.select("tenant_id", "event_id", "timestamp", "data"), hints)
    fields = Fields(parsed, flat=False)
    columns = []
    for path, kind in hints.items():
        raw = fields.raw(path)
        if kind == "int":
            value = F.when(F.lower(raw) == "true", 1).when(F.lower(raw) == "false", 0)
            value = F.coalesce(value, raw.try_cast("int"))
        elif kind == "timestamp":
            value = F.try_to_timestamp(raw)
        else:
            value = raw.try_cast(kind)
        columns.append(value.alias(path.replace(".", "_") if path != "tenant_id" else "data_tenant"))
    return parsed.select("tenant_id", "event_id", "timestamp", *columns)
