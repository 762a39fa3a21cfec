"""Event-level columns: signal, error flag, time buckets, promoted columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import Fields, shred
from tidemark.schema import EVENT_COLUMNS

# Event types and the signal they imply when none is given.
SIGNAL_OF_TYPE = {
    "span": "trace",
    "span_start": "trace",
    "span_end": "trace",
    "metric": "metric",
    "log": "log",
    "analytics": "analytics",
    "track": "analytics",
    "page": "analytics",
    "screen": "analytics",
    "identify": "analytics",
    "group": "analytics",
    "alias": "analytics",
}

ERROR_VARIANTS = ("materializer", "query", "view", "alert")


def signal(explicit: Column, event_type: Column) -> Column:
    """The explicit signal, else the one implied by the event type, else ``other``."""
    derived = F.lit("other")
    for implied in ("analytics", "log", "metric", "trace"):
        types = [kind for kind, value in SIGNAL_OF_TYPE.items() if value == implied]
        derived = F.when(event_type.isin(*types), F.lit(implied)).otherwise(derived)
    return F.when(F.coalesce(explicit, F.lit("")) != "", explicit).otherwise(derived)


def boolish(text: Column, words: tuple[str, ...] = ("1", "true", "yes")) -> Column:
    """Flag text as a whole number: numbers as they are, the words as 1, others 0;
    NULL if absent."""
    whole = F.when(text.rlike("^-?[0-9]+$"), text.try_cast("bigint"))
    return F.coalesce(whole, F.lower(text).isin(*words).cast("bigint"))


def is_error(df: DataFrame, variant: str = "materializer") -> Column:
    """The error flag in one of the four rules the components use.

    ``materializer`` (default): flag set, or span status ``error``, or the type
    ends in ``_error``. ``query``: the flag must be 1 or true. ``view``: span
    status is ignored. ``alert``: as ``view``, and the flag may read ``error``.
    """
    if variant not in ERROR_VARIANTS:
        raise ValueError(f"unknown error rule: {variant}")
    fields = Fields(df)
    if "is_error" in df.columns:
        flag = F.col("is_error") > 0
        if variant == "query":
            flag = F.col("is_error") == 1
        if variant == "alert":
            flag = flag | (F.col("is_error").isNull() & (F.lower(fields.raw("is_error")) == "error"))
    else:
        words = {
            "query": ("1", "true"),
            "alert": ("1", "true", "yes", "error"),
        }.get(variant, ("1", "true", "yes"))
        text = fields.raw("is_error")
        flag = F.lower(text).isin(*words) if variant == "query" else boolish(text, words) > 0
    result = F.coalesce(flag, F.lit(False))
    if variant in ("materializer", "query"):
        result = result | (F.lower(fields.string("span_status_code")) == "error")
    return result | F.lower(fields.string("event_type")).endswith("_error")


def bucket(timestamp: Column, seconds: int) -> Column:
    """Start of the interval of ``seconds`` that holds the timestamp (UTC epoch aligned)."""
    width = int(seconds) * 1_000_000
    if width <= 0:
        raise ValueError("bucket seconds must be positive")
    micros = F.unix_micros(timestamp)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(width)))


def promote_columns(df: DataFrame, payload: str = "data") -> DataFrame:
    """Add the flat columns of the event table from the JSON payload.

    Expects at least ``event_id``, ``timestamp`` and the payload; keeps source
    columns that exist and fills the others with defaults.
    """
    names = [
        "tenant_id", "event_type", "signal", "trace_id", "span_id", "parent_span_id",
        "service", "environment", "name", "duration_ms", "is_error", "span_status_code",
    ]
    kept = [c for c in df.columns if c not in names]
    parsed = shred(df.select(*kept), names, payload)
    fields = Fields(parsed, payload=payload, flat=False)
    event_type = fields.string("event_type")
    values = {
        "tenant_id": fields.string("tenant_id"),
        "event_type": event_type,
        "signal": signal(fields.string("signal"), event_type),
        "trace_id": fields.string("trace_id"),
        "span_id": fields.string("span_id"),
        "parent_span_id": fields.string("parent_span_id"),
        "service": fields.string("service"),
        "environment": fields.string("environment"),
        "name": fields.string("name"),
        "duration_ms": fields.number("duration_ms"),
        "is_error": boolish(fields.raw("is_error")),
        "span_status_code": fields.string("span_status_code"),
    }
    defaults = {
        "observed_timestamp": F.lit(None).cast("timestamp"),
        "ingested_timestamp": F.current_timestamp(),
        "source_file": F.lit(""),
        "source_offset": F.lit(0).cast("bigint"),
        "source_length": F.lit(0).cast("bigint"),
    }
    for name, default in defaults.items():
        values[name] = F.col(name) if name in kept else default
    rest = [F.col(c) for c in kept if c not in EVENT_COLUMNS]
    return parsed.select(
        *[values[c].alias(c) if c in values else F.col(c) for c in EVENT_COLUMNS], *rest
    )


CONTEXT = [
    "tenant_id", "timestamp", "event_id", "event_type", "signal",
    "trace_id", "span_id", "parent_span_id", "name", "duration_ms",
]


def event_context(df: DataFrame) -> DataFrame:
    """The columns every materialiser uses: ids, times, duration, error flag, minute."""
    fields = Fields(df)
    return df.select(
        *CONTEXT,
        F.try_to_timestamp(fields.string("start_time")).alias("start_time"),
        F.try_to_timestamp(fields.string("end_time")).alias("end_time"),
        bucket(F.col("timestamp"), 60).alias("bucket_time"),
        is_error(df).alias("error"),
    )
