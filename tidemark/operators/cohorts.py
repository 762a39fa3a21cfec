"""Cohorts (sets of entities) and retention of their members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.events import bucket
from tidemark.functions.paths import Fields
from tidemark.plans.definitions import Definition, Rule, bucket_seconds, emit, of_tenant
from tidemark.plans.exprs import dimension_map, named_values, string_expr
from tidemark.plans.matchers import matcher
from tidemark.plans.shapes import lit

COHORT_KEYS = ["tenant_id", "cohort_id", "cohort_version", "entity_type", "entity_id"]
MEMBER_KEY = ["tenant_id", "cohort_id", "entity_type", "entity_id"]
REPORT_KEYS = ["tenant_id", "report_id", "report_version", "bucket_time", "dimensions"]


def cohort(events: DataFrame, definitions: Sequence[Definition]) -> DataFrame:
    """Members with first and last time seen."""

    def rules(_: DataFrame, fields: Fields, d: Definition) -> list[Rule]:
        found = []
        for output in d.outputs("cohort_memberships"):
            parts = [
                string_expr(fields, output.get("cohort_id"), d.name),
                string_expr(fields, output.get("entity_type")),
                string_expr(fields, output.get("entity_id")),
            ]
            if any(part is None for part in parts):
                continue
            holds = of_tenant(d) & matcher(fields, d.config.get("match"))
            for part in parts:
                holds = holds & (part != "")
            columns = [
                parts[0].alias("cohort_id"),
                lit(d.version).cast("bigint").alias("cohort_version"),
                parts[1].alias("entity_type"),
                parts[2].alias("entity_id"),
            ]
            found.append((holds, columns))
        return found

    rows = emit(events, definitions, rules, ["tenant_id", "timestamp"])
    if rows is None:
        raise ValueError("no cohort definitions")
    return rows.groupBy(*COHORT_KEYS).agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )


def cohort_query(
    members: DataFrame,
    cohort_id: str,
    *,
    version: int | None = None,
    entity_type: str = "",
    limit: int | None = None,
) -> DataFrame:
    """Members of a cohort by first time seen; all of them without a limit."""
    rows = members.where(F.col("cohort_id") == cohort_id)
    if version is not None:
        rows = rows.where(F.col("cohort_version") == version)
    if entity_type:
        rows = rows.where(F.col("entity_type") == entity_type)
    order = [F.col("first_seen").asc(), F.col("entity_id").asc()]
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def retention(
    events: DataFrame, definitions: Sequence[Definition], members: DataFrame
) -> DataFrame:
    """Members active again, per activity bucket, dimensions and elapsed bucket.

    ``cohort_size`` counts all known members; ``source_events`` repeats the number
    of retained members. Activity is reduced to one row per entity, second and
    dimensions before it meets the members, so a very active entity does not
    carry its raw events through the join.
    """

    def rules(_: DataFrame, fields: Fields, d: Definition) -> list[Rule]:
        found = []
        for output in d.outputs("report_results") if d.of_mode("retention") else []:
            report = string_expr(fields, output.get("report_id"), d.name)
            parts = [
                string_expr(fields, output.get(n)) for n in ("cohort_id", "entity_type", "entity_id")
            ]
            if any(part is None for part in parts):
                continue
            holds = of_tenant(d) & matcher(fields, d.config.get("match"))
            for part in [report, *parts]:
                holds = holds & (part != "")
            fallback = bucket_seconds(output, 86_400)
            columns = [
                report.alias("report_id"),
                lit(d.version).cast("bigint").alias("report_version"),
                parts[0].alias("cohort_id"),
                parts[1].alias("entity_type"),
                parts[2].alias("entity_id"),
                bucket(F.col("timestamp"), bucket_seconds(output, 60)).alias("bucket_time"),
                dimension_map(named_values(fields, output.get("dimensions"))).alias("dims"),
                F.lit(bucket_seconds(output, fallback, "retention_bucket_seconds")).alias("width"),
            ]
            found.append((holds, columns))
        return found

    rows = emit(events, definitions, rules, ["tenant_id", "timestamp"])
    if rows is None:
        raise ValueError("no retention definitions")
    # Whole seconds passed since joining only depend on the second of the activity
    # relative to the join time, so keep the earliest and latest instant of each
    # second; both together give every elapsed second that occurs.
    second = bucket(F.col("timestamp"), 1)
    activity_keys = [
        "tenant_id", "report_id", "report_version", "cohort_id", "entity_type", "entity_id",
        "bucket_time", "dims", "width",
    ]
    activity = (
        rows.groupBy(*activity_keys, second.alias("second"))
        .agg(F.array(F.min("timestamp"), F.max("timestamp")).alias("at"))
        .select(*activity_keys, F.explode(F.array_distinct("at")).alias("activity_at"))
    )
    joined_at = members.groupBy(*MEMBER_KEY).agg(F.min("first_seen").alias("joined_at"))
    elapsed = F.expr("(unix_micros(activity_at) - unix_micros(joined_at)) div 1000000")
    retained = (
        activity.join(joined_at, MEMBER_KEY)
        .withColumn("elapsed", elapsed)
        .where(F.col("elapsed") >= 0)
        .withColumn("elapsed_bucket", F.expr("elapsed div width"))
    )
    report_keys = ["tenant_id", "report_id", "report_version", "bucket_time", "dims"]
    cohort_key = ["tenant_id", "cohort_id", "entity_type"]
    # The cohort is part of the key of its size only; a report reads one cohort.
    counted = retained.groupBy(*report_keys, "elapsed_bucket", "cohort_id", "entity_type").agg(
        F.countDistinct("entity_id").alias("retained_users")
    )
    sizes = members.groupBy(*cohort_key).agg(F.countDistinct("entity_id").alias("cohort_size"))
    number = lambda c: F.col(c).cast("double")
    return counted.join(sizes, cohort_key).select(
        "tenant_id",
        "report_id",
        "report_version",
        "bucket_time",
        F.map_concat(
            F.map_filter("dims", lambda k, _: k != "retention_bucket"),
            F.create_map(F.lit("retention_bucket"), F.col("elapsed_bucket").cast("string")),
        ).alias("dimensions"),
        F.create_map(
            F.lit("retained_users"), number("retained_users"),
            F.lit("cohort_size"), number("cohort_size"),
            F.lit("retention_rate"), number("retained_users") / number("cohort_size"),
            F.lit("source_events"), number("retained_users"),
        ).alias("metrics"),
    )
