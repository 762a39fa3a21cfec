"""Funnels: how many entities get through an ordered list of steps.

An entity advances greedily: its matching events in (time, step) order move it on
whenever they match the step it waits for. Instead of collecting an entity's
events, the walk is treated as what it is: a function from "steps reached
before" to "steps reached after". Such functions are computed for short slices
of time and composed slice by slice, so an entity with a third of all events is
spread over as many groups as it has active slices, and every group is bounded
by the number of distinct (time, step) pairs a slice can hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.events import bucket
from tidemark.functions.paths import Fields, shred
from tidemark.operators.filters import Time, TimeRange, filter_dimensions, in_time
from tidemark.plans.definitions import Definition, Rule, bucket_seconds, emit, of_tenant
from tidemark.plans.exprs import dimension_map, named_values, path_of, paths_in, string_expr
from tidemark.plans.matchers import matcher
from tidemark.plans.shapes import lit

# Widths in seconds of the slices a walk is composed from, finest first. Each level
# merges at most 240 parts of the one below.
SLICES = (15, 3600, 864_000)

SEQUENCE_KEYS = ["tenant_id", "report_id", "report_version", "bucket_time", "segment"]


@dataclass(frozen=True)
class Step:
    """A named step and the match its events must satisfy."""

    name: str
    match: dict = field(default_factory=dict, hash=False)


def _standing(steps: int | Column) -> Column:
    """The walk that leads nowhere."""
    if isinstance(steps, int):
        return F.array(*[F.lit(r) for r in range(steps + 1)])
    return F.sequence(F.lit(0), steps)


def _walk(steps: int | Column) -> Column:
    """The walk over one slice as an array: entry r is where an entity ends that
    enters with r steps reached."""
    return F.aggregate(
        F.array_sort("matches"),
        _standing(steps),
        lambda state, match: F.transform(
            state, lambda r: F.when(r == match["step"], r + 1).otherwise(r)
        ),
    )


def _compose(steps: int | Column) -> Column:
    """Walks of consecutive slices chained into one."""
    return F.aggregate(
        F.array_sort("walks"),
        _standing(steps),
        lambda state, part: F.transform(state, lambda r: F.get(part["walk"], r)),
    )


def reached_steps(matches: DataFrame, keys: Sequence[str], steps: int | Column) -> DataFrame:
    """Steps reached per key from rows (keys, ``timestamp``, ``step``); ``steps`` may depend on the key.

    Two shuffles: one spreads keys over their hours, in which walks are composed to the
    hour, one brings the hourly walks of a key together for the levels above.
    """
    finest, hour, *_ = SLICES
    seconds = F.unix_seconds("timestamp")
    dealt = matches.withColumns({"hour": F.floor(seconds / hour), "slice": F.floor(seconds / finest)}).repartition(*keys, "hour")
    walks = (
        dealt.groupBy(*keys, "hour", "slice")
        .agg(F.collect_set(F.struct("timestamp", "step")).alias("matches"))
        .select(*keys, "hour", "slice", _walk(steps).alias("walk"))
        .groupBy(*keys, "hour")
        .agg(F.collect_list(F.struct("slice", "walk")).alias("walks"))
        .select(*keys, F.col("hour").alias("slice"), _compose(steps).alias("walk"))
        .repartition(*keys)
    )
    for finer, coarser in zip(SLICES[1:], SLICES[2:], strict=False):
        walks = (
            walks.groupBy(*keys, F.floor(F.col("slice") / (coarser // finer)).alias("coarse"))
            .agg(F.collect_list(F.struct("slice", "walk")).alias("walks"))
            .select(*keys, F.col("coarse").alias("slice"), _compose(steps).alias("walk"))
        )
    return (
        walks.groupBy(*keys)
        .agg(F.collect_list(F.struct("slice", "walk")).alias("walks"))
        .select(*keys, F.get(_compose(steps), F.lit(0)).alias("reached"))
        .where(F.col("reached") > 0)
    )


def step_counts(reached: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Entities per step, and how many go on. The last step anyone reached repeats
    its own count as conversions."""
    total = len(names)
    counted = reached.groupBy(*keys).agg(
        F.max("reached").alias("deepest"),
        F.array(*[F.count_if(F.col("reached") > i) for i in range(total)]).alias("counts"),
    )
    labels = F.array(*[F.lit(name) for name in names])
    return _unfolded(counted, keys, labels)


def _unfolded(counted: DataFrame, keys: Sequence[str], labels: Column) -> DataFrame:
    return counted.select(
        *keys, "deepest", "counts", F.posexplode(F.slice("counts", 1, F.col("deepest")))
    ).select(
        *keys,
        F.col("pos").alias("step_index"),
        F.get(labels, F.col("pos")).alias("step_name"),
        F.col("col").alias("entity_count"),
        F.when(F.col("pos") + 1 < F.col("deepest"), F.get("counts", F.col("pos") + 1))
        .otherwise(F.col("col"))
        .alias("conversion_count"),
    )


def _step_matches(fields: Fields, steps: Sequence[Step]) -> Column:
    """Indices of the steps the event matches."""
    return F.array_compact(
        F.array(*[F.when(matcher(fields, s.match), F.lit(i)) for i, s in enumerate(steps)])
    )


def funnel(
    events: DataFrame,
    steps: Sequence[Step],
    entity: str,
    segment: dict[str, str] | None = None,
    bucket_seconds: int | None = None,
    match: dict | None = None,
) -> DataFrame:
    """An ad-hoc funnel over payload paths.

    ``segment`` maps dimension names to paths. With ``bucket_seconds`` all steps
    must fall into one bucket; without, the whole range counts and
    ``bucket_time`` is left out.
    """
    segment = segment or {}
    paths = {entity, *segment.values()} | paths_in([s.match for s in steps]) | paths_in(match)
    parsed = shred(events, paths)
    fields = Fields(parsed)
    names = sorted(segment)
    keys = ["tenant_id", *names]
    columns = [
        "tenant_id",
        "timestamp",
        fields.string(entity).alias("entity_id"),
        *[fields.string(segment[name]).alias(name) for name in names],
        _step_matches(fields, steps).alias("steps"),
    ]
    if bucket_seconds:
        columns.append(bucket(F.col("timestamp"), bucket_seconds).alias("bucket_time"))
        keys.insert(1, "bucket_time")
    rows = parsed.where(matcher(fields, match)).select(*columns)
    rows = rows.where((F.col("entity_id") != "") & (F.size("steps") > 0))
    matches = rows.select(*keys, "entity_id", "timestamp", F.explode("steps").alias("step"))
    reached = reached_steps(matches, [*keys, "entity_id"], len(steps))
    return step_counts(reached, keys, [s.name for s in steps])


def sequence_report(events: DataFrame, definitions: Sequence[Definition]) -> DataFrame:
    """Funnels declared by definitions, per bucket and segment.

    All funnels are walked together: one scan gives the matches of every definition, and
    the number of steps is part of the key, so walks of any width are composed side by side.
    """
    layouts: list[list[str]] = []

    def rules(_: DataFrame, fields: Fields, d: Definition) -> list[Rule]:
        found = []
        for output in d.outputs("sequence_report_results"):
            steps = [
                Step(str(spec["name"]).strip(), spec.get("match") or {})
                for spec in output.get("steps") or []
                if isinstance(spec, dict) and str(spec.get("name") or "").strip()
            ]
            entity = string_expr(fields, output.get("entity_id"))
            if not steps or entity is None:
                continue
            report = string_expr(fields, output.get("report_id"), d.name)
            # A report id read from the event is not known when steps are named.
            generic = path_of(output.get("report_id")) is not None
            layouts.append([f"step_{i}" if generic else step.name for i, step in enumerate(steps)])
            matched = _step_matches(fields, steps)
            holds = of_tenant(d) & matcher(fields, d.config.get("match"))
            columns = [
                report.alias("report_id"),
                lit(d.version).cast("bigint").alias("report_version"),
                bucket(F.col("timestamp"), bucket_seconds(output, 60)).alias("bucket_time"),
                dimension_map(named_values(fields, output.get("dimensions"))).alias("segment"),
                entity.alias("entity_id"),
                F.lit(len(layouts) - 1).alias("layout"),
                F.lit(len(steps)).alias("size"),
                matched.alias("steps"),
            ]
            found.append((holds & (report != "") & (entity != ""), columns))
        return found

    rows = emit(events, definitions, rules, ["tenant_id", "timestamp"])
    if rows is None:
        raise ValueError("no sequence definitions")
    keys = [*SEQUENCE_KEYS, "layout", "size"]
    # As entries, since grouping by a map rewrites it and would shuffle once more each time.
    rows = rows.withColumn("segment", F.map_entries("segment"))
    matches = rows.select(*keys, "entity_id", "timestamp", F.explode("steps").alias("step"))
    reached = reached_steps(matches, [*keys, "entity_id"], F.col("size"))
    widest = max(len(layout) for layout in layouts)
    counted = reached.groupBy(*keys).agg(
        F.max("reached").alias("deepest"),
        F.array(*[F.count_if(F.col("reached") > i) for i in range(widest)]).alias("counts"),
    )
    names = F.array(*[F.array(*[F.lit(n) for n in layout]) for layout in layouts])
    done = _unfolded(counted, keys, F.get(names, F.col("layout"))).drop("layout", "size")
    return done.withColumn("segment", F.map_from_entries("segment"))


def funnel_query(
    results: DataFrame,
    report_id: str,
    *,
    version: int | None = None,
    start: Time | None = None,
    end: Time | None = None,
    filters: dict[str, str] | None = None,
) -> DataFrame:
    """Stored step counts summed by bucket, segment and step."""
    rows = results.where(F.col("report_id") == report_id)
    if version is not None:
        rows = rows.where(F.col("report_version") == version)
    rows = in_time(rows, TimeRange(start, end), column="bucket_time")
    rows = filter_dimensions(rows, filters or {}, "segment")
    return (
        rows.groupBy("bucket_time", "segment", "step_index", "step_name")
        .agg(
            F.sum("entity_count").alias("entity_count"),
            F.sum("conversion_count").alias("conversion_count"),
        )
        .withColumnRenamed("segment", "dimensions")
        .orderBy("bucket_time", "step_index")
    )
