"""Whether serving tables are up to date, and which output version to read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.filters import Time, instant


class StaleTable(Exception):
    """A serving table lags behind the newest commit."""


def freshness(ledger: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Per serving table: its sequence, the newest commit, and whether it is fresh.

    ``watermarks``: (``serving_table``, ``source_sequence``), any number of rows
    per table.
    """
    newest = ledger.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("latest")).scalar()
    return (
        watermarks.groupBy("serving_table")
        .agg(F.max("source_sequence").alias("serving_sequence"))
        .withColumn("latest_sequence", newest)
        .withColumn("fresh", F.col("serving_sequence") >= F.col("latest_sequence"))
    )


def ensure_fresh(ledger: DataFrame, watermarks: DataFrame, tables: Sequence[str]) -> None:
    """Raise if any of the tables lags. A store without commits is fresh."""
    latest = ledger.agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]
    if latest == 0:
        return
    rows = (
        watermarks.where(F.col("serving_table").isin(*tables))
        .groupBy("serving_table")
        .agg(F.max("source_sequence").alias("s"))
        .collect()
    )
    reached = {row["serving_table"]: row["s"] for row in rows}
    for table in tables:
        if reached.get(table, 0) < latest:
            raise StaleTable(
                f"serving table {table} is stale: at {reached.get(table, 0)}, newest is {latest}"
            )


def fresh_or(
    serving: DataFrame, fallback: DataFrame, ledger: DataFrame, watermarks: DataFrame, table: str
) -> DataFrame:
    """The serving table if it is up to date, else the fallback over raw events."""
    try:
        ensure_fresh(ledger, watermarks, [table])
    except StaleTable:
        return fallback
    return serving


def covering_versions(
    watermarks: DataFrame, tenant: str, target_type: str, start: Time, end: Time
) -> DataFrame:
    """Definition versions materialised over the whole query window.

    ``watermarks``: (``tenant_id``, ``target_type``, ``target_id``,
    ``target_version``, ``status``, ``window_start``, ``window_end``).
    """
    return (
        watermarks.where(
            (F.col("tenant_id") == tenant)
            & (F.col("target_type") == target_type)
            & F.col("status").isin("active", "completed", "materialized", "ready")
            & (F.col("window_start") <= instant(start))
            & (F.col("window_end") >= instant(end))
        )
        .select("target_id", "target_version")
        .distinct()
    )


def active_version(
    versions: DataFrame,
    serving: DataFrame,
    tenant: str,
    target_type: str,
    target_id: str,
    *,
    id_column: str,
    version_column: str,
    requested: int = 0,
) -> tuple[int, str]:
    """(version, how it was chosen): as requested, else the newest active one, else
    the newest in the serving table."""
    if requested > 0:
        return requested, "requested"
    active = (
        versions.where(
            (F.col("tenant_id") == tenant)
            & (F.col("target_type") == target_type)
            & (F.col("target_id") == target_id)
            & F.col("active")
        )
        .agg(F.max_by("target_version", F.struct("updated_at", "target_version")))
        .first()[0]
    )
    if active is not None:
        return active, "active_version"
    newest = (
        serving.where((F.col("tenant_id") == tenant) & (F.col(id_column) == target_id))
        .agg(F.max(version_column))
        .first()[0]
    )
    return newest or 0, "serving_table_latest"
