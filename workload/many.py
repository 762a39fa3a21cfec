"""Hundreds of definitions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import alerts, measures
from tidemark.plans.definitions import Definition
from tidemark.sources.star import events
from workload.registry import query

# Definition k: tenant, event type, plan and width of the buckets follow from k.
MANY = 200
TYPES = ("click", "error", "purchase", "signup", "view")
PLANS = ("free", "pro", "enterprise")

_DEFS = f"""defs AS (
  SELECT d, 't' || (d % 4) AS tenant, ['{"','".join(TYPES)}'][d % 5 + 1] AS kind,
    ['{"','".join(PLANS)}'][d % 3 + 1] AS wanted FROM range({MANY}) r(d))"""


def _match(k: int) -> dict:
    match = [{"path": "event_type", "op": "eq", "value": TYPES[k % 5]}]
    if k % 2:
        match.append({"path": "plan", "op": "eq", "value": PLANS[k % 3]})
    return {"all": match}


@query(
    "measures_of_many_definitions",
    f"""WITH {{EV}}, {_DEFS}
    SELECT 'd' || d AS definition_id, 'm' || d AS measure_name, (1 + d % 3)::BIGINT AS version, count(*) AS events,
      round(sum(value), 4) AS total, 'kind' || (d % 3) AS unit
    FROM ev JOIN defs ON tenant = tenant_id AND kind = event_type AND (d % 2 = 0 OR wanted = plan)
    GROUP BY d""",
)
def measures_of_many_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [
        Definition(
            f"d{k}", "measure",
            {"match": _match(k), "outputs": [{"value": {"path": "duration_ms"}, "measure_name": f"m{k}", "unit": f"kind{k % 3}"}]},
            f"t{k % 4}", f"measure {k}", "measure", 1 + k % 3,
        )
        for k in range(MANY)
    ]
    rows = measures.event_measures(events(spark, sf_dir), found)
    return rows.groupBy("definition_id", "measure_name", F.col("definition_version").alias("version"), "unit").agg(
        F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "alerts_of_many_rules",
    f"""WITH {{EV}}, {_DEFS}, hits AS (
      SELECT d, user_id, epoch_us(timestamp) // 1000000 // 3600 AS slot, count(*) AS events
      FROM ev JOIN defs ON tenant = tenant_id AND kind = event_type AND (d % 2 = 0 OR wanted = plan)
      GROUP BY ALL)
    SELECT 'd' || d AS alert_id, 'rule ' || d AS alert_name, ['info', 'critical'][d % 2 + 1] AS severity,
      count(*) AS alerts, count(DISTINCT user_id) AS users, count(*) * (d % 3) AS notifications
    FROM hits GROUP BY d""",
)
def alerts_of_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        alerts.alert_rule(Definition(
            f"d{k}", "alert",
            {"match": _match(k), "severity": ("info", "critical")[k % 2], "dedupe_key": "user_id", "dedupe_seconds": 3600,
             "notifications": {"webhooks": [{"id": f"h{n}", "url": f"https://hooks.test/{k}/{n}"} for n in range(k % 3)]}},
            f"t{k % 4}", f"rule {k}",
        ))
        for k in range(MANY)
    ]
    found = alerts.alert_events(events(spark, sf_dir), rules)
    sent = alerts.notification_outbox(found, rules).groupBy("alert_id").agg(F.count("*").alias("notifications"))
    user = F.split("dedupe_key", ":")[2]
    counted = found.groupBy("alert_id", "alert_name", "severity").agg(
        F.count("*").alias("alerts"), F.countDistinct(user).alias("users")
    )
    return counted.join(sent, "alert_id", "left").withColumn("notifications", F.coalesce("notifications", F.lit(0).cast("long")))
