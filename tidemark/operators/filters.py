"""Filtering events by time, facets and text.

Facets are answered from the scalar index in one pass: each clause becomes a
flag, flags are combined per event (with map-side aggregation), the whole
boolean expression is evaluated once, and a single semi or anti join picks the
events. Without an index the same clauses are evaluated inside each event row.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.leaves import index_rows
from tidemark.functions.paths import Fields
from tidemark.plans.facets import Facet, branches, facet_path, leaf_condition

EVENT_KEY = ["tenant_id", "event_id"]

Time = str | dt.datetime | Column


def instant(value: Time) -> Column:
    """A time given as RFC 3339 text, datetime or column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        value = value.isoformat() + "Z"
    return F.to_timestamp(F.lit(value))


@dataclass(frozen=True)
class TimeRange:
    """Inclusive bounds, or the last ``lookback_minutes`` (which win over bounds)."""

    after: Time | None = None
    before: Time | None = None
    lookback_minutes: int = 0

    def bounds(self) -> tuple[Column | None, Column | None]:
        """First and last time of the range, None where it is open."""
        if self.lookback_minutes > 0:
            back = F.expr(f"INTERVAL {int(self.lookback_minutes)} MINUTES")
            return F.current_timestamp() - back, None
        return (
            None if self.after is None else instant(self.after),
            None if self.before is None else instant(self.before),
        )

    def condition(self, column: str = "timestamp") -> Column:
        first, last = self.bounds()
        result = F.lit(True)
        if first is not None:
            result = result & (F.col(column) >= first)
        if last is not None:
            result = result & (F.col(column) <= last)
        return result


def by_day(
    df: DataFrame, first: Column | None = None, last: Column | None = None, column: str = "timestamp"
) -> DataFrame:
    """Keep the days from ``first`` to ``last``, so a scan of a table stored by day skips the others.

    Tables without ``event_date``, the day of ``timestamp`` in UTC, stay as they are.
    """
    if "event_date" not in df.columns or column != "timestamp":
        return df
    if first is not None:
        df = df.where(F.col("event_date") >= F.to_date(first))
    if last is not None:
        df = df.where(F.col("event_date") <= F.to_date(last))
    return df


def in_time(
    df: DataFrame,
    time_range: TimeRange | None = None,
    *,
    after: Time | None = None,
    before: Time | None = None,
    column: str = "timestamp",
) -> DataFrame:
    """Inclusive window. Explicit filter bounds replace the range altogether."""
    if after is not None or before is not None:
        time_range = TimeRange(after, before)
    if time_range is None:
        return df
    return by_day(df, *time_range.bounds(), column).where(time_range.condition(column))


def in_window(df: DataFrame, start: Time, end: Time, column: str = "timestamp") -> DataFrame:
    """Half-open window ``start <= t < end``, for exports and chunked jobs."""
    inside = (F.col(column) >= instant(start)) & (F.col(column) < instant(end))
    return by_day(df, instant(start), instant(end), column).where(inside)


class _Flags:
    """Numbers the index conditions of a facet expression.

    ``plain`` clauses hold if any index row of the event satisfies them;
    ``scoped`` ones are groups of clauses that one array element must satisfy
    together. ``expression`` combines the per-event flags, which ``flag``
    supplies as columns.
    """

    def __init__(self, facets: Sequence[Facet], fields: Fields):
        self.plain: list[Facet] = []
        self.scoped: list[tuple[str, list[Facet]]] = []
        self.on_events = False
        self._fields = fields
        self._tree = [self._branch(branch) for branch in branches(facets)]

    def _branch(self, branch: list[Facet]) -> list[tuple[str, object, bool]]:
        tests: list[tuple[str, object, bool]] = []
        together: dict[str, list[Facet]] = {}
        for facet in branch:
            scope = facet.array_scope()
            if facet.op == "contains":
                self.on_events = True
                tests.append(("event", facet, facet.negated))
            elif scope is not None and not facet.negated:
                together.setdefault(scope, []).append(facet)
            else:
                tests.append(("plain", len(self.plain), facet.negated))
                self.plain.append(facet)
        for scope, members in sorted(together.items()):
            if len(members) == 1:
                tests.append(("plain", len(self.plain), False))
                self.plain.append(members[0])
            else:
                tests.append(("scoped", len(self.scoped), False))
                self.scoped.append((scope, members))
        return tests

    def expression(self, flag: Callable[[str, int], Column]) -> Column:
        result = F.lit(False)
        for tests in self._tree:
            branch = F.lit(True)
            for kind, which, negated in tests:
                if kind == "event":
                    found = contains(self._fields, which)
                else:
                    found = F.coalesce(flag(kind, which), F.lit(False))
                branch = branch & (~found if negated else found)
            result = result | branch
        return result


def contains(fields: Fields, facet: Facet) -> Column:
    """Case-insensitive substring of the value's text."""
    return F.contains(F.lower(fields.string(facet.stored_path())), F.lit(facet.value.lower()))


def _flag_column(kind: str, which: int) -> Column:
    return F.col(f"{kind}_{which}")


def _flag_rows(index: DataFrame, flags: _Flags) -> DataFrame:
    """Per-event flags for the events with at least one hit."""
    wanted = F.lit(False)
    for facet in flags.plain:
        wanted = wanted | leaf_condition(facet)
    for scope, members in flags.scoped:
        for facet in members:
            wanted = wanted | (
                (plain_scope(F.col("scope_path")) == scope) & leaf_condition(facet, scoped=False)
            )
    hits = index.where(wanted)
    plain = [F.bool_or(leaf_condition(f)).alias(f"plain_{i}") for i, f in enumerate(flags.plain)]
    if not flags.scoped:
        return hits.groupBy(*EVENT_KEY).agg(*plain)
    # First per array element, then per event; the first step already shrinks an
    # event's rows to one per element.
    elements, scoped = [], []
    for i, (scope, members) in enumerate(flags.scoped):
        every = F.lit(True)
        for j, facet in enumerate(members):
            test = (plain_scope(F.col("scope_path")) == scope) & leaf_condition(facet, scoped=False)
            elements.append(F.bool_or(test).alias(f"element_{i}_{j}"))
            every = every & F.col(f"element_{i}_{j}")
        scoped.append(F.bool_or(every).alias(f"scoped_{i}"))
    per_element = hits.groupBy(*EVENT_KEY, "scope_path", "scope_index").agg(*plain, *elements)
    again = [F.bool_or(f"plain_{i}").alias(f"plain_{i}") for i in range(len(flags.plain))]
    return per_element.groupBy(*EVENT_KEY).agg(*again, *scoped)


def _holds_without_hits(facets: Sequence[Facet]) -> bool:
    """Whether an event with no index hit at all satisfies the expression."""
    return any(all(facet.negated for facet in branch) for branch in branches(facets))


def filter_facets(
    events: DataFrame,
    facets: Sequence[Facet],
    index: DataFrame | None = None,
    time_range: TimeRange | None = None,
    depth: int | None = None,
) -> DataFrame:
    """Events that satisfy the facet clauses.

    ``index`` is the scalar index; ``time_range`` is applied to both sides so
    that each prunes its own files. Without an index the clauses are evaluated
    on the payload of each row, which needs no shuffle and suits scans that
    read most of the table anyway; they see all levels of it unless ``depth`` is given.
    """
    if time_range is not None:
        events = in_time(events, time_range)
    if not branches(facets):
        return events
    flags = _Flags(facets, Fields(events, derived_signal=True))
    if not flags.plain and not flags.scoped:
        return events.where(flags.expression(_flag_column))
    if index is None:
        return _filter_rows(events, flags, depth)
    if time_range is not None:
        index = in_time(index, time_range)
    per_event = _flag_rows(index, flags)
    holds = flags.expression(_flag_column)
    if flags.on_events:
        # Clauses on the event itself mix with indexed ones: bring the flags to
        # the event and decide there.
        columns = events.columns
        return events.join(per_event, EVENT_KEY, "left").where(holds).select(*columns)
    if _holds_without_hits(facets):
        return events.join(per_event.where(~holds), EVENT_KEY, "left_anti")
    return events.join(per_event.where(holds), EVENT_KEY, "left_semi")


def plain_scope(scope_path: Column) -> Column:
    """The array a leaf is in as facets spell it, without brackets of outer arrays."""
    return F.replace(scope_path, F.lit("[]"), F.lit(""))


def _filter_rows(events: DataFrame, flags: _Flags, depth: int | None) -> DataFrame:
    def part(leaf: Column) -> Callable[[str], Column]:
        return lambda name: leaf[name]

    def elements(leaves: Column, scope: str, facet: Facet) -> Column:
        """The elements of the scope's arrays that have a leaf for the facet."""
        fitting = F.filter(
            leaves,
            lambda leaf: (plain_scope(leaf["scope_path"]) == scope) & leaf_condition(facet, part(leaf), False),
        )
        return F.transform(fitting, lambda leaf: F.concat_ws("#", leaf["scope_index"].cast("string"), leaf["scope_path"]))

    def holds(leaves: Column) -> Column:
        def flag(kind: str, which: int) -> Column:
            if kind == "plain":
                facet = flags.plain[which]
                return F.exists(leaves, lambda leaf: leaf_condition(facet, part(leaf)))
            scope, members = flags.scoped[which]
            # Elements are intersected by hash, so no leaf meets all others.
            common = elements(leaves, scope, members[0])
            for facet in members[1:]:
                common = F.array_intersect(common, elements(leaves, scope, facet))
            return F.size(common) > 0

        return flags.expression(flag)

    # The lambda names the leaves, so the payload is flattened once per row.
    rows = index_rows(depth=depth)
    return events.where(F.exists(F.array(rows), holds))


def filter_text(
    events: DataFrame,
    text: str,
    text_index: DataFrame,
    time_range: TimeRange | None = None,
) -> DataFrame:
    """Events whose text document contains the text, ignoring case."""
    if time_range is not None:
        text_index = in_time(text_index, time_range)
    hits = text_index.where(F.contains(F.lower("text"), F.lit(text.strip().lower())))
    return events.join(hits.select(*EVENT_KEY), EVENT_KEY, "left_semi")


def filter_group_value(
    events: DataFrame,
    path: str,
    value: str,
    *,
    field_index: DataFrame | None = None,
    kv_index: DataFrame | None = None,
    time_range: TimeRange | None = None,
) -> DataFrame:
    """Events of a chosen group: through the promoted field index if it is given,
    else the scalar index, else the payload."""
    if time_range is not None:
        events = in_time(events, time_range)
    if field_index is not None:
        hits = field_index.where(
            (F.col("field_name") == facet_path(path)) & (F.col("value") == value)
        )
        if time_range is not None:
            hits = in_time(hits, time_range)
        return events.join(hits.select(*EVENT_KEY), EVENT_KEY, "left_semi")
    return filter_facets(events, [Facet(path, "eq", value)], kv_index, time_range)


def whole_event_text(events: DataFrame) -> Column:
    """The serialised event: envelope attributes and payload as JSON text."""
    names = [
        c
        for c in ("tenant_id", "event_id", "timestamp", "observed_timestamp", "source_file")
        if c in events.columns
    ]
    head = F.to_json(
        F.struct(*names), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"}
    )
    return F.concat(
        F.regexp_replace(head, r"\}$", ""),
        F.lit(',"data":'),
        F.col("data"),
        F.lit("}"),
    )


def filter_whole_text(
    events: DataFrame, text: str | None = None, regex: str | None = None
) -> DataFrame:
    """Substring (ignoring case) and regular expression over the serialised event."""
    document = whole_event_text(events)
    if text:
        events = events.where(F.contains(F.lower(document), F.lit(text.lower())))
    if regex:
        events = events.where(document.rlike(regex))
    return events


def filter_dimensions(
    df: DataFrame, filters: dict[str, str], column: str = "dimensions"
) -> DataFrame:
    """Equality on keys of a dimension map; a missing key counts as empty."""
    for name, value in filters.items():
        df = df.where(F.coalesce(F.col(column)[name], F.lit("")) == value)
    return df


def filter_cube_dimensions(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Equality on positional cube dimensions (name and value arrays)."""
    for name, value in filters.items():
        position = F.array_position("dimension_names", name).cast("int")
        df = df.where(
            (position > 0) & (F.try_element_at("dimension_values", position) == value)
        )
    return df
