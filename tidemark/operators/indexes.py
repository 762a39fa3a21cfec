"""Index tables derived from events: scalar leaves, text, identifiers, promoted fields.

All builders are narrow: one pass over the events, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.events import bucket, is_error
from tidemark.functions.leaves import UNROLLED, containers_left, first_of_each, index_rows, text_terms
from tidemark.functions.paths import Fields, shred
from tidemark.plans.definitions import Definition, of_tenant
from tidemark.plans.exprs import path_of, paths_in, scalar_text, string_expr
from tidemark.plans.matchers import matcher

# The payload paths served as identifiers.
IDENTIFIERS = (
    "trace_id", "span_id", "request_id", "user_id", "anonymous_id", "account_id",
    "session_id", "group_id", "organization_id", "thread_id", "conversation_id",
)


def _identified(events: DataFrame) -> DataFrame:
    return events.where((F.col("tenant_id") != "") & (F.col("event_id") != ""))


def kv_index(
    events: DataFrame,
    max_rows: int | None = None,
    max_string: int | None = None,
    depth: int | None = None,
) -> DataFrame:
    """One row per distinct scalar of each event, typed, with its array scope.

    Whole events are indexed, as deep as they are nested unless ``depth`` is given. A caller may choose a smaller index: strings over
    ``max_string`` bytes are then skipped, and at most ``max_rows`` rows of an event
    are kept in key order; such an index answers for what it holds only.
    """
    events = _identified(events)
    rows = index_rows(max_rows, max_string, depth=depth)
    return events.select(
        "tenant_id",
        "timestamp",
        "event_id",
        "event_type",
        "signal",
        F.explode(rows).alias("leaf"),
        "source_file",
    ).select(
        "tenant_id",
        "timestamp",
        "event_id",
        "event_type",
        "signal",
        "leaf.*",
        "source_file",
    )


def too_deep(events: DataFrame, depth: int = UNROLLED) -> DataFrame:
    """How many events and containers lie deeper than ``depth`` and were not flattened."""
    return events.select(containers_left(depth=depth).alias("left")).agg(
        F.count_if(F.col("left") > 0).alias("events"),
        F.coalesce(F.sum("left"), F.lit(0)).cast("bigint").alias("containers"),
    )


def _clip_bytes(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes, never cutting a character."""
    head = F.make_valid_utf8(F.substring(text.cast("binary"), 1, limit).cast("string"))
    return F.when(F.octet_length(text) <= limit, text).otherwise(
        F.rtrim(head, F.lit("�"))
    )


def text_index(
    events: DataFrame, max_bytes: int | None = None, depth: int | None = None
) -> DataFrame:
    """One searchable text per event: ``path:value`` terms, ids first.

    Texts are whole unless the caller sets ``max_bytes``, and hold all levels unless
    ``depth`` is given.
    """
    events = _identified(events)
    ids = F.array(
        *[
            F.struct(F.lit(name).alias("path"), F.col(name).alias("text"))
            for name in ("event_id", "event_type", "signal", "trace_id", "span_id")
        ]
    )
    words = F.transform(
        F.filter(F.concat(ids, text_terms(depth=depth)), lambda term: term["text"] != ""),
        lambda term: F.concat(
            F.replace(term["path"], F.lit("[]"), F.lit("")), F.lit(":"), term["text"]
        ),
    )
    # Through a generator, so that later uses of the text do not repeat building it.
    built = events.select(
        "tenant_id",
        "timestamp",
        "event_id",
        "event_type",
        "signal",
        "trace_id",
        "span_id",
        F.explode(F.array(F.array_join(words, " "))).alias("text"),
        "source_file",
    )
    if max_bytes is None:
        return built
    return built.withColumn("text", _clip_bytes(F.col("text"), max_bytes))


def field_values(events: DataFrame) -> DataFrame:
    """One row per non-empty identifier of each event."""
    parsed = shred(events, IDENTIFIERS)
    fields = Fields(parsed)
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("field_name"), fields.string(name).alias("value"))
            for name in IDENTIFIERS
        ]
    )
    return parsed.select(
        "tenant_id",
        F.explode(F.filter(pairs, lambda pair: pair["value"] != "")).alias("pair"),
        "timestamp",
        bucket(F.col("timestamp"), 60).alias("bucket_time"),
        "event_id",
        "event_type",
        "signal",
        is_error(events, "view").cast("bigint").alias("is_error"),
        "trace_id",
        "span_id",
        "name",
    ).select(
        "tenant_id", "pair.*", "timestamp", "bucket_time", "event_id", "event_type",
        "signal", "is_error", "trace_id", "span_id", "name",
    )


def _scalar_texts(fields: Fields, path: str) -> Column:
    """The value's text, or the texts of all scalars in an array, however deep they are nested in others."""
    unnest = lambda items: F.flatten(
        F.transform(
            items, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
        )
    )
    def holds_arrays(items: Column) -> Column:
        return F.exists(items, lambda v: F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("ARRAY"))

    def state(items: Column) -> Column:
        # The lambda names the items, so they are unnested once.
        named = F.transform(F.array(items), lambda v: F.struct(v.alias("items"), holds_arrays(v).alias("more")))
        return F.element_at(named, 1)

    # As many rounds as the value has brackets at most; once no array is left a round does no work.
    raw = F.coalesce(fields.raw(path), F.lit(""))
    items = F.aggregate(
        F.sequence(F.lit(1), F.length(raw) - F.length(F.replace(raw, F.lit("["), F.lit(""))) + 1),
        F.struct(F.array(fields.variant(path)).alias("items"), F.lit(True).alias("more")),
        lambda s, _: F.when(s["more"], state(unnest(s["items"]))).otherwise(s),
        lambda s: s["items"],
    )
    scalars = F.filter(
        items,
        lambda v: ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).rlike("^(OBJECT|ARRAY|VOID)"),
    )
    return F.when(
        fields.is_container(path), F.transform(scalars, lambda v: v.cast("string"))
    ).otherwise(F.array(fields.string(path)))


def _field_outputs(definition: Definition) -> list[dict]:
    outputs = [o for o in definition.outputs("field_index") if o.get("value") is not None]
    if outputs:
        return outputs
    path = str(definition.config.get("path") or "").strip()
    if not path:
        return []
    output = {"field_name": definition.name, "value": {"path": path}}
    if definition.config.get("value_type"):
        output["value_type"] = definition.config["value_type"]
    return [output]


def field_index(events: DataFrame, definitions: Sequence[Definition]) -> DataFrame:
    """Rows for declared fields: one per distinct value, arrays fan out.

    Within an event a (mode, field, type, value) appears once, from the first
    definition that gives it; this is settled inside the row. Arrays are unnested as
    deep as the payloads go, like those of the scalar index.
    """
    by_tenant: dict[str, list[Definition]] = {}
    for definition in definitions:
        by_tenant.setdefault(definition.tenant_id, []).append(definition)
    groups: list[list[Definition]] = []
    for chunk in by_tenant.values():
        if groups and len(groups[-1]) + len(chunk) <= 64:
            groups[-1].extend(chunk)
        else:
            groups.append(list(chunk))
    result = None
    for group in groups:
        part = _field_index_part(events, group)
        result = part if result is None else result.unionByName(part)
    if result is None:
        raise ValueError("no field definitions")
    return result


def _field_structs(
    texts: Column, mode: str, name: Column, kind: str, definition: Definition
) -> Column:
    return F.transform(
        F.filter(texts, lambda text: text != ""),
        lambda text: F.struct(
            F.lit(mode).alias("mode"),
            name.alias("field_name"),
            text.alias("value"),
            F.lit(kind).alias("value_type"),
            F.lit(definition.definition_id).alias("definition_id"),
            F.lit(definition.version).cast("bigint").alias("definition_version"),
        ),
    )


def _field_index_part(events: DataFrame, group: list[Definition]) -> DataFrame:
    paths = set().union(*(paths_in(d.config) for d in group)) | {"start_time", "end_time"}
    parsed = shred(events, paths)
    fields = Fields(parsed)
    arrays = []
    for definition in group:
        mode = "lookup" if definition.mode == "lookup" else "facet"
        for output in _field_outputs(definition):
            path = path_of(output["value"])
            texts = (
                _scalar_texts(fields, path)
                if path
                else F.array(F.lit(scalar_text(output["value"])))
            )
            name = string_expr(fields, output.get("field_name"), definition.name)
            kind = str(output.get("value_type") or "string")
            holds = of_tenant(definition) & matcher(fields, definition.config.get("match"))
            rows = _field_structs(texts, mode, name, kind, definition)
            arrays.append(F.when(holds & (name != ""), rows))
    # Through a generator, so that the rows are built once.
    rest = parsed.columns
    built = parsed.select(*rest, F.explode(F.array(F.flatten(F.array_compact(F.array(*arrays))))).alias("__rows"))
    first_only = F.expr(first_of_each("__rows", "r.mode, r.field_name, r.value_type, r.value"))
    return built.select(
        "tenant_id",
        F.explode(first_only).alias("row"),
        "timestamp",
        bucket(F.col("timestamp"), 60).alias("bucket_time"),
        "event_id",
        "event_type",
        "signal",
        is_error(events).cast("bigint").alias("is_error"),
        "trace_id",
        "span_id",
        "parent_span_id",
        "name",
        F.try_to_timestamp(fields.string("start_time")).alias("start_time"),
        F.try_to_timestamp(fields.string("end_time")).alias("end_time"),
        "duration_ms",
    ).select(
        "tenant_id", "row.mode", "row.field_name", "row.value", "row.value_type", "timestamp",
        "bucket_time", "event_id", "event_type", "signal", "is_error", "trace_id", "span_id",
        "parent_span_id", "name", "start_time", "end_time", "duration_ms",
        "row.definition_id", "row.definition_version",
    )


def field_stats(events: DataFrame, path: str, exact: bool = False) -> DataFrame:
    """Events that have the path, and how many different values it takes."""
    value = Fields(events).string(path)
    present = events.select(value.alias("value")).where(F.col("value") != "")
    distinct = F.countDistinct("value") if exact else F.approx_count_distinct("value", 0.01)
    return present.agg(
        F.count(F.lit(1)).alias("rows_matched"), distinct.alias("distinct_values")
    )


def write_kv_index(index: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store the index clustered by (path, value) so that Parquet statistics prune
    lookups; range partitioning by value and time splits a path or value that
    holds a large share of the rows. Without ``partitions`` the session's number
    applies and AQE puts small ranges together."""
    order = ["path", "value_type", "string_value", "number_value", "timestamp"]
    dated = index.withColumn("event_date", F.to_date("timestamp"))
    if partitions is None:
        ranged = dated.repartitionByRange("event_date", *order)
    else:
        ranged = dated.repartitionByRange(partitions, "event_date", *order)
    (
        ranged.sortWithinPartitions("event_date", *order)
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#event_id", "true")
        .partitionBy("event_date")
        .parquet(path)
    )
