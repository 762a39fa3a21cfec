"""Connected components by alternating stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); component is the smallest node reached.

    Each round links all larger neighbours of a node to its smallest neighbour
    (large star), then all smaller neighbours to the smallest of them (small star),
    until the edges are stars already. Smallest neighbours are found by aggregates
    with map-side combining; the join that hands them to the edges of a node is left
    to the skew splitting of adaptive execution, so that a hub is no single task.
    Every round is written to the shared folder. Loops and rows with a null end are
    ignored; nodes without an edge are not returned; an empty input gives no rows.
    """
    edges = written(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("low"))
        large = (
            both.where("v > u")
            .join(lowest, "u")
            .select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        )
        large = written(large.distinct(), "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u").select(
            F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"),
            F.col("low").alias("v"),
        )
        # A node whose only smaller neighbour is the lowest keeps that edge; one with
        # more also needs its own edge to the lowest, which the first branch gives.
        edges = written(small.where("u <> v").distinct(), "small-star")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
