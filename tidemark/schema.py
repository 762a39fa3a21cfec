"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


STRING, LONG, DOUBLE, TIME = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

# The wire envelope; ``data`` stays JSON text.
ENVELOPE = _schema(
    ("event_id", STRING),
    ("timestamp", STRING),
    ("observed_timestamp", STRING),
    ("data", STRING),
)

# The canonical event table. The flat columns repeat payload fields so that
# queries on them never read ``data``. ``span_status_code`` is flat as well
# because the error flag needs it.
EVENTS = _schema(
    ("tenant_id", STRING),
    ("event_id", STRING),
    ("timestamp", TIME),
    ("observed_timestamp", TIME),
    ("ingested_timestamp", TIME),
    ("event_type", STRING),
    ("signal", STRING),
    ("trace_id", STRING),
    ("span_id", STRING),
    ("parent_span_id", STRING),
    ("service", STRING),
    ("environment", STRING),
    ("name", STRING),
    ("duration_ms", DOUBLE),
    ("is_error", LONG),
    ("span_status_code", STRING),
    ("source_file", STRING),
    ("source_offset", LONG),
    ("source_length", LONG),
    ("data", STRING),
)

INVALID_EVENTS = _schema(
    ("tenant_id", STRING),
    ("observed_at", TIME),
    ("reason", STRING),
    ("raw", STRING),
)

DEFINITIONS = _schema(
    ("tenant_id", STRING),
    ("definition_id", STRING),
    ("name", STRING),
    ("kind", STRING),
    ("mode", STRING),
    ("config", STRING),
    ("version", LONG),
    ("enabled", T.BooleanType()),
    ("deleted_at", TIME),
)

BATCH_RECORD = T.StructType(
    [
        T.StructField("batch_id", STRING),
        T.StructField("tenant_id", STRING),
        T.StructField(
            "events",
            T.ArrayType(
                _schema(
                    ("tenant_id", STRING),
                    ("event_id", STRING),
                    ("timestamp", STRING),
                    ("observed_timestamp", STRING),
                    ("source_file", STRING),
                    ("source_offset", LONG),
                    ("source_length", LONG),
                    ("data", STRING),
                )
            ),
        ),
    ]
)

COMMITS = T.StructType(
    [
        T.StructField("batch_id", STRING),
        T.StructField("sequence", LONG),
        T.StructField("committed_at", TIME),
        T.StructField("row_count", LONG),
        T.StructField("data_files", T.ArrayType(STRING)),
    ]
)

EVENT_COLUMNS = [field.name for field in EVENTS.fields]
FLAT_STRINGS = [
    "tenant_id",
    "event_type",
    "trace_id",
    "span_id",
    "parent_span_id",
    "service",
    "environment",
    "name",
    "span_status_code",
]
