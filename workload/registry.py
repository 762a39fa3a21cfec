"""Registry of queries, and the event view in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TENANTS = ("t0", "t1", "t2", "t3")

# The stream table as events: what ``tidemark.sources.star.adapt_events`` builds.
EV = """ev AS (
  SELECT 't' || (user_id % 4) AS tenant_id, CAST(event_id AS VARCHAR) AS event_id, event_id AS n,
    ts AS timestamp, epoch_us(ts) // 1000 AS ms, event_type,
    CASE WHEN event_type = 'error' THEN 'other' ELSE 'analytics' END AS signal,
    event_type AS name, 'svc' || (event_id % 5) AS service,
    CASE WHEN event_id % 10 < 7 THEN 'prod' ELSE 'dev' END AS environment,
    'u' || user_id AS user_id, 'a' || (user_id % 20) AS account_id,
    user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
    't' || (event_id // 8) AS trace_id, 's' || event_id AS span_id,
    CASE WHEN event_id % 8 <> 0 THEN 's' || (event_id - 1) ELSE '' END AS parent_span_id,
    value, event_type = 'error' AS flagged,
    (event_type = 'error' OR event_id % 97 = 0) AS failed,
    ['free', 'pro', 'enterprise'][user_id % 3 + 1] AS plan,
    ['DE', 'FR', 'JP', 'US'][user_id % 4 + 1] AS country,
    CASE WHEN event_type = 'purchase'
      THEN CASE WHEN user_id % 2 = 0 THEN 'EUR' ELSE 'USD' END ELSE '' END AS currency,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events
)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``{EV}`` in the SQL stands for the event view."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: run(configure(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql.replace("{EV}", EV).strip()
        return run

    return register


def ms(column: str | Column) -> Column:
    return F.unix_millis(column)


def big(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def money(column: str | Column, digits: int = 4) -> Column:
    """Sums of doubles, rounded so that the order of summing does not matter."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits)
