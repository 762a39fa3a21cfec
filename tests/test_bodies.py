"""Bodies are told apart in time by their length."""

import time

from pyspark.sql import functions as F

from tidemark.sources.events import split_bodies


def test_large_bodies_take_time_by_their_length(spark):
    body = F.to_json(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.struct(i.alias("event_id"), F.lit("x" * 20).alias("data"))))
    bodies = spark.range(0, 4, 1, 4).select(F.lit("t").alias("tenant_id"), body.alias("body"))
    started = time.perf_counter()
    rows = split_bodies(bodies)
    assert tuple(rows.agg(F.count_if(F.col("body_error").isNull()), F.max("position"), F.max(F.get_json_object("raw", "$.event_id").cast("int"))).first()) == (80_000, 19_999, 20_000)
    assert time.perf_counter() - started < 20


def test_odd_bodies(spark):
    texts = ['{"a":1}', "[]", "{", "[[1],null,\"x\"]", "7", "null", "[null]", "", None, '{"a":1,"a":2}']
    rows = split_bodies(spark.createDataFrame(list(enumerate(texts)), "n int, body string"))
    got = {(r["n"], r["position"]): (r["body_error"], r["raw"]) for r in rows.collect()}
    unread, empty = "invalid JSON body", "batch must contain at least one event"
    assert got == {
        (0, 0): (None, '{"a":1}'), (1, 0): (empty, "[]"), (2, 0): (unread, "{"), (3, 0): (None, "[1]"), (3, 1): (None, "null"),
        (3, 2): (None, '"x"'), (4, 0): (None, "7"), (5, 0): (None, "null"), (6, 0): (None, "null"), (7, 0): (unread, ""),
        (8, 0): (unread, None), (9, 0): (unread, '{"a":1,"a":2}'),
    }
