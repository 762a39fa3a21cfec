"""Normalisation, projections, indexes, filters, paging and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.events import bucket, event_context, is_error, promote_columns
from tidemark.functions.events import signal as signal_of
from tidemark.functions.paths import Fields
from tidemark.operators import filters as flt
from tidemark.operators import indexes, normalize, pages, search
from tidemark.operators.filters import TimeRange
from tidemark.plans.definitions import Definition
from tidemark.plans.facets import Facet
from tidemark.plans.matchers import alert_matcher, matcher
from tidemark.session import shared_folder
from tidemark.sources.star import document_events, events, flat_events, load
from workload.registry import ORACLES, TENANTS, big, ms, query

FROM, TO = "2024-01-08T00:00:00Z", "2024-01-20T12:00:00Z"
TS_FROM, TS_TO = "TIMESTAMP '2024-01-08 00:00:00'", "TIMESTAMP '2024-01-20 12:00:00'"


def ids(df: DataFrame) -> DataFrame:
    return df.select("event_id")


# Columns of the event table from the payload alone.
@query(
    "promoted_columns",
    """WITH {EV} SELECT event_id, tenant_id, event_type, signal, trace_id, span_id, parent_span_id,
    service, environment, name, value AS duration_ms, CAST(flagged AS BIGINT) AS is_error, ms
    FROM ev""",
)
def promoted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = events(spark, sf_dir).select("event_id", "timestamp", "data")
    return promote_columns(raw).select(
        "event_id", "tenant_id", "event_type", "signal", "trace_id", "span_id", "parent_span_id",
        "service", "environment", "name", "duration_ms", "is_error", ms("timestamp").alias("ms"),
    )


@query(
    "signal_counts",
    """SELECT signal, count(*) AS events FROM (
      SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'custom'
        WHEN kind IN ('span', 'span_start', 'span_end') THEN 'trace'
        WHEN kind IN ('metric', 'log') THEN kind
        WHEN kind IN ('page', 'track', 'identify') THEN 'analytics' ELSE 'other' END AS signal
      FROM (SELECT o_orderpriority, ['span', 'metric', 'log', 'page', 'track', 'identify',
        'span_end', 'signup'][o_orderkey % 8 + 1] AS kind FROM orders)) GROUP BY signal""",
)
def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["span", "metric", "log", "page", "track", "identify", "span_end", "signup"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    explicit = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("custom"))
    orders = load(spark, sf_dir, "orders")
    return (
        orders.select(signal_of(explicit, kind).alias("signal"))
        .groupBy("signal")
        .agg(F.count(F.lit(1)).alias("events"))
    )


@query(
    "error_rules",
    """WITH {EV} SELECT service, count(*) FILTER (failed) AS materializer,
    count(*) FILTER (failed) AS query, count(*) FILTER (flagged) AS view,
    count(*) FILTER (flagged) AS alert FROM ev GROUP BY service""",
)
def error_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    rules = ("materializer", "query", "view", "alert")
    return e.groupBy("service").agg(*[F.count_if(is_error(e, r)).alias(r) for r in rules])


@query(
    "time_buckets",
    """WITH {EV} SELECT ms // 60000 * 60000 AS minute, ms // 900000 * 900000 AS quarter,
    count(*) AS events FROM ev GROUP BY ALL""",
)
def time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flat_events(spark, sf_dir)
    time = F.col("timestamp")
    return e.groupBy(
        ms(bucket(time, 60)).alias("minute"), ms(bucket(time, 900)).alias("quarter")
    ).agg(F.count(F.lit(1)).alias("events"))


@query(
    "payload_paths",
    """WITH {EV} SELECT event_id, country, '/r' || (k % 10) AS route,
    CAST(200 + (k % 4) * 100 AS DOUBLE) AS status, CAST(k AS DOUBLE) AS k,
    CASE WHEN currency = '' THEN 'none' ELSE currency END AS currency, '' AS tags,
    currency <> '' AS has_revenue FROM ev""",
)
def payload_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    fields = Fields(e)
    return e.select(
        "event_id",
        fields.string("country").alias("country"),
        fields.string("http.route").alias("route"),
        fields.number("http.response.status_code").alias("status"),
        fields.number("props.k").alias("k"),
        fields.string("currency", "none").alias("currency"),
        fields.string("tags").alias("tags"),
        fields.present("revenue").alias("has_revenue"),
    )


@query(
    "event_contexts",
    """WITH {EV} SELECT event_id, tenant_id, trace_id, ms // 60000 * 60000 AS bucket_ms, failed,
    value AS duration_ms FROM ev""",
)
def event_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_context(flat_events(spark, sf_dir)).select(
        "event_id", "tenant_id", "trace_id", ms("bucket_time").alias("bucket_ms"),
        F.col("error").alias("failed"), "duration_ms",
    )


# Every event delivered twice, purchases three times.
@query(
    "deduplicated_events",
    """WITH {EV} SELECT tenant_id, event_id, n AS source_offset, event_type FROM ev""",
)
def deduplicated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    late = e.withColumn("source_offset", F.col("source_offset") + 1_000_000_000)
    later = late.where(F.col("event_type") == "purchase").withColumn("source_file", F.lit("retry"))
    return normalize.dedupe_events(e.unionByName(late).unionByName(later)).select(
        "tenant_id", "event_id", "source_offset", "event_type"
    )


@query(
    "field_inference",
    """WITH {EV}, paths AS (
      SELECT unnest(['tenant_id', 'event_type', 'name', 'service', 'environment', 'user_id',
        'account_id', 'session_id', 'trace_id', 'span_id', 'span_status_code', 'plan', 'country',
        'http.route']) AS path, 'string' AS types, 1 AS f
      UNION ALL SELECT unnest(['duration_ms', 'is_error', 'metric_value', 'props.k',
        'http.response.status_code']), 'number', 1
      UNION ALL SELECT unnest(['props', 'http', 'http.response']), 'object', 1
      UNION ALL SELECT unnest(['tags', 'items']), 'array', 1)
    SELECT path, types, (SELECT count(*) FROM ev) AS count FROM paths
    UNION ALL SELECT 'signal', 'string', count(*) FROM ev WHERE NOT flagged
    UNION ALL SELECT 'parent_span_id', 'string', count(*) FROM ev WHERE parent_span_id <> ''
    UNION ALL SELECT 'revenue', 'number', count(*) FROM ev WHERE currency <> ''
    UNION ALL SELECT 'currency', 'string', count(*) FROM ev WHERE currency <> ''""",
)
def field_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalize.field_inference(events(spark, sf_dir))
    return found.select("path", F.array_join("types", ",").alias("types"), "count")


_KV = """kv AS (
  SELECT event_id, tenant_id, timestamp, unnest([
    {'p': 'tenant_id', 't': 'string', 's': tenant_id, 'n': NULL, 'sp': '', 'si': -1},
    {'p': 'event_type', 't': 'string', 's': event_type, 'n': NULL, 'sp': '', 'si': -1},
    {'p': 'name', 't': 'string', 's': name, 'n': NULL, 'sp': '', 'si': -1},
    {'p': 'service', 't': 'string', 's': service, 'n': NULL, 'sp': '', 'si': -1},
    {'p': 'environment', 't': 'string', 's': environment, 'n': NULL, 'sp': '', 'si': -1},
    {'p': 'user_id', 't': 'string', 's': user_id, 'n': NULL, 'sp': '', 'si': -1},
    {'p': 'account_id', 't': 'string', 's': account_id, 'n': NULL, 'sp': '', 'si': -1},
    {'p': 'session_id', 't': 'string', 's': session_id, 'n': NULL, 'sp': '', 'si': -1},
    {'p': 'trace_id', 't': 'string', 's': trace_id, 'n': NULL, 'sp': '', 'si': -1},
    {'p': 'span_id', 't': 'string', 's': span_id, 'n': NULL, 'sp': '', 'si': -1},
    {'p': 'duration_ms', 't': 'number', 's': '', 'n': value, 'sp': '', 'si': -1},
    {'p': 'is_error', 't': 'number', 's': '', 'n': CAST(flagged AS DOUBLE), 'sp': '', 'si': -1},
    {'p': 'span_status_code', 't': 'string', 's': CASE WHEN n % 97 = 0 THEN 'error' ELSE 'ok' END, 'n': NULL, 'sp': '', 'si': -1},
    {'p': 'metric_value', 't': 'number', 's': '', 'n': value, 'sp': '', 'si': -1},
    {'p': 'plan', 't': 'string', 's': plan, 'n': NULL, 'sp': '', 'si': -1},
    {'p': 'country', 't': 'string', 's': country, 'n': NULL, 'sp': '', 'si': -1},
    {'p': 'props.k', 't': 'number', 's': '', 'n': CAST(k AS DOUBLE), 'sp': '', 'si': -1},
    {'p': 'http.route', 't': 'string', 's': '/r' || (k % 10), 'n': NULL, 'sp': '', 'si': -1},
    {'p': 'http.response.status_code', 't': 'number', 's': '', 'n': CAST(200 + (k % 4) * 100 AS DOUBLE), 'sp': '', 'si': -1},
    {'p': 'tags', 't': 'string', 's': plan, 'n': NULL, 'sp': '', 'si': -1},
    {'p': 'tags', 't': 'string', 's': event_type, 'n': NULL, 'sp': '', 'si': -1},
    {'p': 'items[].sku', 't': 'number', 's': '', 'n': CAST(k % 7 AS DOUBLE), 'sp': 'items', 'si': 0},
    {'p': 'items[].qty', 't': 'number', 's': '', 'n': CAST(n % 3 AS DOUBLE), 'sp': 'items', 'si': 0},
    {'p': 'items[].sku', 't': 'number', 's': '', 'n': CAST(k % 5 AS DOUBLE), 'sp': 'items', 'si': 1},
    {'p': 'items[].qty', 't': 'number', 's': '', 'n': CAST(n % 4 AS DOUBLE), 'sp': 'items', 'si': 1}
  ]) AS x FROM ev
  UNION ALL SELECT event_id, tenant_id, timestamp, {'p': 'signal', 't': 'string', 's': signal, 'n': NULL, 'sp': '', 'si': -1} FROM ev WHERE NOT flagged
  UNION ALL SELECT event_id, tenant_id, timestamp, {'p': 'parent_span_id', 't': 'string', 's': parent_span_id, 'n': NULL, 'sp': '', 'si': -1} FROM ev WHERE parent_span_id <> ''
  UNION ALL SELECT event_id, tenant_id, timestamp, {'p': 'revenue', 't': 'number', 's': '', 'n': value, 'sp': '', 'si': -1} FROM ev WHERE currency <> ''
  UNION ALL SELECT event_id, tenant_id, timestamp, {'p': 'currency', 't': 'string', 's': currency, 'n': NULL, 'sp': '', 'si': -1} FROM ev WHERE currency <> ''
)"""  # fmt: skip


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.kv_index(events(spark, sf_dir))


@query(
    "kv_index",
    "WITH {EV}, " + _KV + """ SELECT event_id, x.p AS path, x.t AS value_type, x.s AS string_value,
    CAST(x.n AS DOUBLE) AS number_value, x.sp AS scope_path, CAST(x.si AS BIGINT) AS scope_index
    FROM kv""",
)
def kv_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select(
        "event_id", "path", "value_type", "string_value", "number_value", "scope_path",
        big("scope_index").alias("scope_index"),
    )


_TEXT = """txt AS (
  SELECT *, 'event_id:' || event_id || ' event_type:' || event_type || ' signal:' || signal
    || ' trace_id:' || trace_id || ' span_id:' || span_id || ' account_id:' || account_id
    || ' country:' || country || CASE WHEN currency <> '' THEN ' currency:' || currency ELSE '' END
    || ' duration_ms:' || num || ' environment:' || environment || ' event_type:' || event_type
    || ' http.response.status_code:' || (200 + (k % 4) * 100) || ' http.route:/r' || (k % 10)
    || ' is_error:' || CAST(flagged AS INTEGER)
    || ' items.qty:' || (n % 3) || ' items.sku:' || (k % 7)
    || ' items.qty:' || (n % 4) || ' items.sku:' || (k % 5)
    || ' metric_value:' || num || ' name:' || name
    || CASE WHEN parent_span_id <> '' THEN ' parent_span_id:' || parent_span_id ELSE '' END
    || ' plan:' || plan || ' props.k:' || k
    || CASE WHEN currency <> '' THEN ' revenue:' || num ELSE '' END
    || ' service:' || service || ' session_id:' || session_id
    || CASE WHEN NOT flagged THEN ' signal:' || signal ELSE '' END
    || ' span_id:' || span_id
    || ' span_status_code:' || CASE WHEN n % 97 = 0 THEN 'error' ELSE 'ok' END
    || ' tags:' || plan || ' tags:' || event_type || ' tags:' || plan
    || ' tenant_id:' || tenant_id || ' trace_id:' || trace_id || ' user_id:' || user_id AS text
  FROM (SELECT *, regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS num FROM ev)
)"""


@query("text_index", "WITH {EV}, " + _TEXT + " SELECT event_id, signal, text FROM txt")
def text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.text_index(events(spark, sf_dir)).select("event_id", "signal", "text")


_FIELD_VALUES = """fv AS (
  SELECT event_id, tenant_id, flagged, timestamp, unnest([
    {'f': 'trace_id', 'v': trace_id}, {'f': 'span_id', 'v': span_id},
    {'f': 'user_id', 'v': user_id}, {'f': 'account_id', 'v': account_id},
    {'f': 'session_id', 'v': session_id}]) AS x FROM ev)"""


@query(
    "field_values",
    "WITH {EV}, " + _FIELD_VALUES + """ SELECT event_id, x.f AS field_name, x.v AS value,
    CAST(flagged AS BIGINT) AS is_error, epoch_us(timestamp) // 60000000 * 60000 AS bucket_ms
    FROM fv""",
)
def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.field_values(events(spark, sf_dir)).select(
        "event_id", "field_name", "value", "is_error", ms("bucket_time").alias("bucket_ms")
    )


def field_definitions() -> list[Definition]:
    found = []
    for tenant in TENANTS:
        known = {"all": [{"path": "event_type", "op": "neq", "value": "error"}]}
        found.append(
            Definition("f.country", "field", {"path": "country"}, tenant, "country", "facet", 1)
        )
        found.append(
            Definition(
                "f.tags", "field",
                {"match": known, "outputs": [{"field_name": "tag", "value": {"path": "tags"}}]},
                tenant, "tags", "lookup", 2,
            )
        )
    return found


@query(
    "field_index",
    """WITH {EV}, f AS (
      SELECT event_id, 'facet' AS mode, 'country' AS field_name, country AS value,
        'f.country' AS definition_id, failed FROM ev
      UNION ALL SELECT event_id, 'lookup', 'tag', plan, 'f.tags', failed FROM ev WHERE NOT flagged
      UNION ALL SELECT event_id, 'lookup', 'tag', event_type, 'f.tags', failed FROM ev
        WHERE NOT flagged)
    SELECT event_id, mode, field_name, value, definition_id, CAST(failed AS BIGINT) AS is_error
    FROM f""",
)
def field_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.field_index(events(spark, sf_dir), field_definitions()).select(
        "event_id", "mode", "field_name", "value", "definition_id", "is_error"
    )


@query(
    "field_stats",
    """WITH {EV} SELECT count(*) AS rows_matched, count(DISTINCT session_id) AS distinct_values
    FROM ev""",
)
def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.field_stats(events(spark, sf_dir), "session_id", exact=True)


# Time windows.
@query(
    "time_range_inclusive",
    f"WITH {{EV}} SELECT event_id FROM ev WHERE timestamp BETWEEN {TS_FROM} AND {TS_TO}",
)
def time_range_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(flt.in_time(flat_events(spark, sf_dir), TimeRange(FROM, TO)))


@query(
    "time_window_half_open",
    f"WITH {{EV}} SELECT event_id FROM ev WHERE timestamp >= {TS_FROM} AND timestamp < {TS_TO}",
)
def time_window_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(flt.in_window(flat_events(spark, sf_dir), FROM, TO))


# Facets over the scalar index; the answer is the list of events.
def _facets(*facets: Facet, time_range: TimeRange | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = _index(spark, sf_dir)
        return ids(flt.filter_facets(flat_events(spark, sf_dir), facets, index, time_range))

    return run


def _facets_in_rows(*facets: Facet):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ids(flt.filter_facets(flat_events(spark, sf_dir), facets))

    return run


def _ids_where(condition: str) -> str:
    return f"WITH {{EV}} SELECT event_id FROM ev WHERE {condition}"


query("facet_eq_string", _ids_where("country = 'DE'"))(_facets(Facet("country", "eq", "DE")))
query("facet_eq_number", _ids_where("k = 7"))(_facets(Facet("props-k", "eq", "7")))
query("facet_in", _ids_where("k IN (1, 2, 3) OR FALSE"))(
    _facets(Facet("props.k", "in", values=("1", "2", "3")))
)
query("facet_in_empty", _ids_where("FALSE"))(_facets(Facet("props.k", "in")))
query("facet_exists", _ids_where("currency <> ''"))(_facets(Facet("revenue", "exists")))
query("facet_range", _ids_where("value > 50 AND value <= 80"))(
    _facets(Facet("durationMs", "gt", "50"), Facet("duration_ms", "lte", "80"))
)
query("facet_contains", _ids_where("lower(user_id) LIKE '%u1%'"))(
    _facets(Facet("user_id", "contains", "U1"))
)
query("facet_negated", _ids_where("NOT coalesce(currency = 'EUR', FALSE)"))(
    _facets(Facet("currency", "eq", "EUR", negated=True))
)
query(
    "facet_or_branches",
    _ids_where(
        "(country = 'DE' AND value >= 60) OR (currency = 'USD') OR (plan = 'pro' AND NOT (k = 3))"
    ),
)(
    _facets(
        Facet("country", "eq", "DE"),
        Facet("duration_ms", "gte", "60"),
        Facet("currency", "eq", "USD", join="or"),
        Facet("plan", "eq", "pro", join="or"),
        Facet("props.k", "eq", "3", negated=True),
    )
)
query(
    "facet_with_raw_contains",
    _ids_where("(country = 'DE' AND lower(session_id) LIKE '%-01-1%') OR plan = 'enterprise'"),
)(
    _facets(
        Facet("country", "eq", "DE"),
        Facet("session_id", "contains", "-01-1"),
        Facet("plan", "eq", "enterprise", join="or"),
    )
)
_SAME_ELEMENT = _ids_where("(k % 7 = 2 AND n % 3 >= 1) OR (k % 5 = 2 AND n % 4 >= 1)")
_same_element = (Facet("items[].sku", "eq", "2"), Facet("items[].qty", "gte", "1"))
query("facet_same_element", _SAME_ELEMENT)(_facets(*_same_element))
query("facet_same_element_in_rows", _SAME_ELEMENT)(_facets_in_rows(*_same_element))
query("facet_rows_or", _ids_where("(country = 'FR' AND k < 50) OR plan = 'pro'"))(
    _facets_in_rows(
        Facet("country", "eq", "FR"),
        Facet("props.k", "lt", "50"),
        Facet("plan", "eq", "pro", join="or"),
    )
)
query(
    "facet_in_time_range",
    _ids_where(f"country = 'US' AND timestamp BETWEEN {TS_FROM} AND {TS_TO}"),
)(_facets(Facet("country", "eq", "US"), time_range=TimeRange(FROM, TO)))


@query("text_filter", _ids_where("country = 'JP'"))
def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return ids(flt.filter_text(e, " Country:jp ", indexes.text_index(e)))


@query("selected_group_value", _ids_where("NOT flagged AND (plan = 'pro' OR event_type = 'pro')"))
def selected_group_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    promoted = indexes.field_index(e, field_definitions())
    return ids(flt.filter_group_value(e, "tag", "pro", field_index=promoted))


@query("selected_group_value_kv", _ids_where("session_id = '8-2024-01-01'"))
def selected_group_value_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    index = _index(spark, sf_dir)
    return ids(flt.filter_group_value(e, "session_id", "8-2024-01-01", kv_index=index))


@query(
    "definition_matcher",
    _ids_where(
        "event_type IN ('click', 'purchase') AND country <> 'US' AND environment = 'prod' AND k = 30"
        " OR FALSE"
    ),
)
def definition_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    match = {
        "all": [
            {"path": "event_type", "op": "in", "value": ["click", "purchase"]},
            {"path": "country", "op": "neq", "value": "US"},
            {"path": "environment", "value": "prod"},
            {"path": "props.k", "op": "eq", "value": 30},
            {"path": "http.route", "op": "exists"},
            {"path": "metric_value", "op": "is_number"},
        ]
    }
    return ids(e.where(matcher(Fields(e), match)))


@query(
    "definition_matcher_neq_needs_presence",
    _ids_where("currency NOT IN ('', 'EUR')"),
)
def definition_matcher_neq(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    match = {"all": [{"path": "currency", "op": "neq", "value": "EUR"}]}
    return ids(e.where(matcher(Fields(e), match)))


@query(
    "alert_conditions",
    _ids_where(
        "user_id LIKE '%1%' AND value > 20 AND NOT flagged AND currency = ''"
        " AND (regexp_matches(service, '^svc[12]$') OR value >= 90 OR n % 5 = 4)"
    ),
)
def alert_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    match = {
        "all": [
            {"path": "data.user_id", "op": "contains", "value": "1"},
            {"path": "duration_ms", "op": "gt", "value": 20},
            {"path": "is_error", "op": "ne", "value": 1},
            {"path": "revenue", "op": "not_exists"},
            {"path": "metric_value", "op": "is_number"},
            {"path": "event_id", "op": "exists"},
        ],
        "any": [
            {"path": "service", "op": "regex", "value": "^svc[12]$"},
            {"path": "metric_value", "op": "gte", "value": "90"},
            {"path": "service", "op": "eq", "value": "svc4"},
        ],
    }
    return ids(e.where(alert_matcher(e, match)))


@query(
    "whole_event_text",
    _ids_where("plan = 'pro' AND regexp_matches(session_id, '-2024-01-(0[1-9])$')"),
)
def whole_event_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return ids(
        flt.filter_whole_text(
            e, text='"PLAN":"pro"', regex=r'"session_id":"\d+-2024-01-(0[1-9])"'
        )
    )


# Searching the documents: whole texts, no cap.
@query(
    "document_text_filter",
    """SELECT lang, source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars
    FROM documents WHERE contains(lower(text), 'license') GROUP BY lang, source""",
)
def document_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = document_events(spark, sf_dir)
    index = indexes.text_index(e, max_bytes=None)
    hits = flt.filter_text(e, "License", index)
    documents = load(spark, sf_dir, "documents")
    found = documents.join(
        hits.select(F.col("event_id").cast("bigint").alias("doc_id")), "doc_id", "left_semi"
    )
    return found.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars")
    )


# Pages.
@query(
    "page_newest_first",
    """WITH {EV} SELECT event_id, ms, event_type FROM ev
    ORDER BY timestamp DESC, event_id DESC LIMIT 100""",
)
def page_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page(flat_events(spark, sf_dir), limit=100).select(
        "event_id", ms("timestamp").alias("ms"), "event_type"
    )


@query(
    "page_after_cursor",
    f"""WITH {{EV}} SELECT event_id, ms, event_type FROM ev WHERE timestamp > {TS_FROM}
    ORDER BY timestamp, event_id LIMIT 50""",
)
def page_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursor = pages.Cursor("after", FROM)
    return pages.page(flat_events(spark, sf_dir), "desc", cursor, 50).select(
        "event_id", ms("timestamp").alias("ms"), "event_type"
    )


@query(
    "page_around_event",
    """WITH {EV} SELECT e.event_id, e.ms FROM ev e,
      (SELECT timestamp AS t, event_id AS i FROM ev WHERE n = 1234 % (SELECT count(*) FROM ev)) c
    WHERE (e.timestamp, e.event_id) <= (c.t, c.i)
    ORDER BY e.timestamp DESC, e.event_id DESC LIMIT 25""",
)
def page_around_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flat_events(spark, sf_dir)
    number = 1234 % e.count()
    at = e.where(F.col("event_id") == str(number)).select(F.max("timestamp")).scalar()
    cursor = pages.Cursor("around", at, str(number))
    return pages.page(e, "desc", cursor, 25).select("event_id", ms("timestamp").alias("ms"))


@query(
    "late_hydration",
    """WITH {EV} SELECT event_id, country FROM ev ORDER BY timestamp, event_id LIMIT 40""",
)
def late_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    keys = pages.page_keys(e, "asc", limit=40)
    full = pages.hydrate(e, keys)
    return full.select("event_id", Fields(full).string("country").alias("country"))


@query(
    "event_by_id",
    "WITH {EV} SELECT event_id, tenant_id, name, value AS duration_ms FROM ev WHERE event_id = '42'",
)
def event_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.event_by_id(flat_events(spark, sf_dir), "42").select(
        "event_id", "tenant_id", "name", "duration_ms"
    )


@query(
    "search_phrase",
    "WITH {EV}, " + _TEXT + """ SELECT event_id, ms, event_type,
    substr(text, greatest(instr(lower(text), 'country:de currency') - 80, 1), 240) AS snippet
    FROM txt WHERE contains(lower(text), 'country:de currency')
    ORDER BY timestamp DESC, event_id LIMIT 30 OFFSET 10""",
)
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    hits = search.search(
        indexes.text_index(e), e, "Country:DE Currency", limit=30, offset=10
    )
    return hits.select("event_id", ms("timestamp").alias("ms"), "event_type", "snippet")


def _posted(spark: SparkSession, index):
    """The postings of the whole text index, stored."""
    path = shared_folder(spark, "postings")
    search.write_postings(search.postings(index), path)
    return spark.read.parquet(path)


@query("search_postings", ORACLES["search_phrase"])
def search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search, narrowed by postings."""
    e = events(spark, sf_dir)
    index = indexes.text_index(e)
    hits = search.search(index, e, "Country:DE Currency", limit=30, offset=10, postings=_posted(spark, index))
    return hits.select("event_id", ms("timestamp").alias("ms"), "event_type", "snippet")


@query(
    "search_two_characters",
    "WITH {EV}, " + _TEXT + """ SELECT event_type, count(*) AS events, min(event_id) AS least
    FROM txt WHERE contains(lower(text), 'u7') GROUP BY event_type""",
)
def search_two_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indexes.text_index(events(spark, sf_dir))
    near = search.narrowed(index, _posted(spark, index), "U7")
    return (
        near.where(F.contains(F.lower("text"), F.lit("u7")))
        .groupBy("event_type")
        .agg(F.count("*").alias("events"), F.min("event_id").alias("least"))
    )


@query(
    "gram_postings",
    "WITH {EV}, " + _TEXT + """, grams AS (
      SELECT event_id, timestamp::DATE AS day, z.n AS size,
        len(list_distinct(list_transform(range(1, len(text) - z.n + 2), lambda i: substr(lower(text), i, z.n)))) AS grams
      FROM txt, (VALUES (2), (3)) z(n))
    SELECT day, size, sum(grams)::BIGINT AS postings, count(*) AS events FROM grams GROUP BY ALL""",
)
def gram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = search.postings(indexes.text_index(events(spark, sf_dir)))
    return posted.groupBy(F.col("event_date").alias("day"), "size").agg(
        F.count("*").alias("postings"), F.countDistinct("event_id").alias("events")
    )


# Joins with the indexes.
@query("index_semi_join", _ids_where("country = 'DE'"))
def index_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(
        flt.filter_facets(
            events(spark, sf_dir), [Facet("country", "eq", "DE")], _index(spark, sf_dir)
        )
    )


@query("index_anti_join", _ids_where("currency = ''"))
def index_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(
        flt.filter_facets(
            events(spark, sf_dir),
            [Facet("currency", "exists", negated=True)],
            _index(spark, sf_dir),
        )
    )


@query(
    "identifier_drilldown",
    """WITH {EV} SELECT account_id AS value, event_type, count(*) AS events,
    count(*) FILTER (failed) AS errors FROM ev GROUP BY account_id, event_type""",
)
def identifier_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    values = indexes.field_values(e).where(F.col("field_name") == "account_id")
    full = e.select("tenant_id", "event_id", is_error(e).alias("error"))
    return (
        values.join(full, ["tenant_id", "event_id"])
        .groupBy("value", "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.count_if("error").alias("errors"))
    )
