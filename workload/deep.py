"""Payloads nested 45 levels deep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import filters, indexes, normalize
from tidemark.plans.facets import Facet
from tidemark.sources.star import events
from workload.registry import query

LEVELS = 45
PATH = ".".join("a" * LEVELS)


def deep_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with payloads of a type and a number below 45 objects."""
    inner = F.concat(
        F.lit('{"a":' * (LEVELS - 1) + '{"a":'), (F.col("source_offset") % 7).cast("string"), F.lit("}" * LEVELS)
    )
    data = F.concat(F.lit('{"event_type":"'), "event_type", F.lit('","deep":'), inner, F.lit("}"))
    return events(spark, sf_dir).withColumn("data", data)


@query(
    "deep_kv_index",
    f"""WITH {{EV}} SELECT 'event_type' AS path, event_type AS value, count(*) AS events FROM ev GROUP BY 2
    UNION ALL SELECT 'deep.{PATH}', (n % 7)::VARCHAR, count(*) FROM ev GROUP BY 2""",
)
def deep_kv_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indexes.kv_index(deep_events(spark, sf_dir))
    value = F.when(F.col("value_type") == "number", F.col("number_value").cast("int").cast("string")).otherwise(F.col("string_value"))
    return index.groupBy("path", value.alias("value")).agg(F.count("*").alias("events"))


@query(
    "capped_kv_index",
    """WITH {EV}, leaves AS (
      SELECT n, unnest([{'i': 1, 'path': 'account_id'}, {'i': 2, 'path': 'country'}, {'i': 3, 'path': CASE WHEN currency <> '' THEN 'currency' END},
        {'i': 4, 'path': 'duration_ms'}, {'i': 5, 'path': 'environment'}, {'i': 6, 'path': 'event_type'}]) AS l FROM ev),
    first AS (SELECT l.path AS path, row_number() OVER (PARTITION BY n ORDER BY l.i) AS rank FROM leaves WHERE l.path IS NOT NULL)
    SELECT path, count(*) AS events FROM first WHERE rank <= 5 GROUP BY path""",
)
def capped_kv_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the first five leaves of each event, as a caller may ask for."""
    index = indexes.kv_index(events(spark, sf_dir), max_rows=5)
    return index.groupBy("path").agg(F.count("*").alias("events"))


@query(
    "deep_field_inference",
    f"""WITH {{EV}}, paths AS (
      SELECT 'event_type' AS path, 'string' AS types
      UNION ALL SELECT 'deep' || repeat('.a', d), CASE WHEN d = {LEVELS} THEN 'number' ELSE 'object' END FROM range({LEVELS + 1}) r(d))
    SELECT path, types, (SELECT count(*) FROM ev) AS events FROM paths""",
)
def deep_field_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalize.field_inference(deep_events(spark, sf_dir))
    return found.select("path", F.array_join("types", ",").alias("types"), F.col("count").alias("events"))


@query(
    "deep_facets",
    "WITH {EV} SELECT event_type, count(*) AS events FROM ev WHERE n % 7 IN (2, 3) AND event_type <> 'view' GROUP BY 1",
)
def deep_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clauses on the deepest leaf, without an index."""
    facets = [Facet(f"deep.{PATH}", "gte", "2"), Facet(f"deep.{PATH}", "lt", "4"), Facet("event_type", "eq", "view", negated=True)]
    hits = filters.filter_facets(deep_events(spark, sf_dir), facets)
    return hits.groupBy("event_type").agg(F.count("*").alias("events"))
