"""Quantiles that stay bounded per task however large a group is.

Sketch states (KLL) are small, merge across buckets and are what serving tables
keep. ``exact_percentiles`` gives interpolated percentiles exactly without ever
bringing a group together: the position of each wanted rank is narrowed down
from counts per bin, level by level, so no window sees more than about 65,000
rows of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (0.5, 0.9, 0.95, 0.99)
BINS = 65_535


def percentile_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def sketch(value: Column | str) -> Column:
    """KLL state of a numeric column; merges with ``merge_sketches``."""
    return F.kll_sketch_agg_double(value)


def merge_sketches(state: Column | str) -> Column:
    return F.kll_merge_agg_double(state)


def sketch_percentiles(state: Column | str, ps: Sequence[float] = PERCENTILES) -> list[Column]:
    return [
        F.kll_sketch_get_quantile_double(state, F.lit(float(p))).alias(percentile_name(p))
        for p in ps
    ]


def _log_bin(value: Column) -> Column:
    """Monotone bin of any finite double: sign, then sixteenths of an octave.

    At most 67,200 bins; within one, values differ by a factor of 2^(1/16) at most.
    """
    octaves = F.floor(F.log2(F.abs(value)) * 16) + 20_000
    return (
        F.when(value > 0, octaves).when(value < 0, -octaves).otherwise(F.lit(0)).cast("bigint")
    )


def _linear_bin(value: Column) -> Column:
    """Monotone bin of a value between the bounds ``lo`` and ``hi`` of its parent bin."""
    width = F.col("hi") - F.col("lo")
    return F.when(
        width > 0, F.floor((value - F.col("lo")) / width * BINS).cast("bigint")
    ).otherwise(F.lit(0).cast("bigint"))


def _finite(value: Column) -> Column:
    """The value, with one zero; bins and interpolation have no place for infinities."""
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(odd, F.raise_error(F.lit("percentiles need finite values")).cast("double")).otherwise(value + F.lit(0.0))


def _ranks(total: Column, ps: Sequence[float]) -> Column:
    """The two neighbouring ranks of each percentile and the weight of the upper one."""
    items = []
    for i, p in enumerate(ps):
        exact = F.lit(float(p)) * (total - 1)
        for side, rank in ((0, F.floor(exact)), (1, F.ceil(exact))):
            items.append(
                F.struct(
                    F.lit(i).alias("p"),
                    F.lit(side).alias("side"),
                    rank.cast("bigint").alias("rank"),
                    (exact - F.floor(exact)).alias("weight"),
                )
            )
    return F.array(*items)


def _hits(ranked: DataFrame) -> DataFrame:
    """Rows whose span of ranks holds a wanted rank; ranks become relative to the row."""
    before = F.col("upto") - F.col("n")
    inside = F.filter(
        "ranks", lambda r: (r["rank"] >= F.col("upto") - F.col("n")) & (r["rank"] < F.col("upto"))
    )
    relative = F.transform(
        inside,
        lambda r: F.struct(
            r["p"].alias("p"), r["side"].alias("side"),
            (r["rank"] - before).alias("rank"), r["weight"].alias("weight"),
        ),
    )
    return ranked.withColumn("ranks", relative).where(F.size("ranks") > 0).drop("upto", "n")


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ps: Sequence[float] = PERCENTILES,
) -> DataFrame:
    """One row per key with interpolated percentiles, equal to SQL PERCENTILE_CONT.

    NULL values are ignored; values that are not finite raise. Equal values are counted
    map-side first, and every level reads those counts (Spark reuses their
    exchange), so the input is scanned once.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .select(*keys, _finite(F.col(value).cast("double")).alias("v"))
        .groupBy(*keys, "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    sums = [F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    rows = counts.withColumn("bin0", _log_bin(F.col("v")))
    path = ["bin0"]
    whole = Window.partitionBy(*keys)
    running = whole.orderBy("bin0").rowsBetween(Window.unboundedPreceding, 0)
    chosen = _hits(
        rows.groupBy(*keys, "bin0")
        .agg(*sums)
        .withColumn("upto", F.sum("n").over(running))
        .withColumn("ranks", _ranks(F.sum("n").over(whole), ps))
    )
    for level in (1, 2):
        name = f"bin{level}"
        rows = (
            rows.join(chosen.select(*keys, *path, "lo", "hi"), [*keys, *path])
            .withColumn(name, _linear_bin(F.col("v")))
            .drop("lo", "hi")
        )
        within = Window.partitionBy(*keys, *path).orderBy(name)
        chosen = _hits(
            rows.groupBy(*keys, *path, name)
            .agg(*sums)
            .join(chosen.drop("lo", "hi"), [*keys, *path])
            .withColumn("upto", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        )
        path.append(name)
    within = Window.partitionBy(*keys, *path).orderBy("v")
    found = _hits(
        rows.join(chosen.drop("lo", "hi"), [*keys, *path])
        .withColumnRenamed("c", "n")
        .withColumn("upto", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    )
    ends = found.select(*keys, "v", F.explode("ranks").alias("r"))
    results = []
    for i, p in enumerate(ps):
        mine = F.col("r.p") == i
        low = F.max(F.when(mine & (F.col("r.side") == 0), F.col("v")))
        high = F.max(F.when(mine & (F.col("r.side") == 1), F.col("v")))
        weight = F.max(F.when(mine, F.col("r.weight")))
        results.append((low + (high - low) * weight).alias(percentile_name(p)))
    return ends.groupBy(*keys).agg(*results)
