"""Path lookup, value forms, error rules, signals, buckets."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.events import bucket, is_error, signal
from tidemark.functions.paths import Fields, check_path, number_from_text, shred

PAYLOAD = {
    "a.b": 1,
    "a": {"b": 2, "c": None, "d": "[not a list]", "e": [1], "f": {"x": 1}},
    "n": 1.0,
    "text": "12.5",
    "flag": True,
    "off": False,
    "none": None,
    "c.d": None,
    "c": {"d": "hidden"},
    "empty": "",
}


def read(spark, column_of, shredded):
    df = spark.createDataFrame([(json.dumps(PAYLOAD),)], "data string")
    if shredded:
        df = shred(df, ["a.b", "a.c", "n", "text", "flag", "none", "c.d", "a.d", "a.e"])
    return df.select(column_of(Fields(df))).first()[0]


@pytest.mark.parametrize("shredded", [False, True])
@pytest.mark.parametrize(
    ("path", "expected"),
    [
        ("a.b", "1"),  # the literal key wins
        ("a.c", ""),
        ("a.d", "[not a list]"),
        ("a.e", ""),
        ("a.f", ""),
        ("n", "1.0"),
        ("flag", "true"),
        ("off", "false"),
        ("none", ""),
        ("c.d", ""),  # a literal null hides the nested value
        ("missing", ""),
    ],
)
def test_string(spark, path, expected, shredded):
    assert read(spark, lambda f: f.string(path), shredded) == expected


def test_string_default(spark):
    assert read(spark, lambda f: f.string("empty", "d"), False) == "d"
    assert read(spark, lambda f: f.string("missing", "d"), True) == "d"


@pytest.mark.parametrize(
    ("path", "expected"), [("n", 1.0), ("text", 12.5), ("flag", None), ("a.d", None)]
)
def test_number(spark, path, expected):
    assert read(spark, lambda f: f.number(path), False) == expected


def test_number_text(spark):
    texts = ["1", "-2.5", ".5", "1e3", "1d", " 1", "0x1", "NaN", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(number_from_text(F.col("t"))).collect()]
    assert got == [1.0, -2.5, 0.5, 1000.0, None, None, None, None, None, None]


def test_paths_are_checked():
    with pytest.raises(ValueError):
        check_path("a['b']")


@pytest.mark.parametrize(
    ("payload", "expected"),
    [
        ({"is_error": True}, (True, True, True, True)),
        ({"is_error": 1}, (True, True, True, True)),
        ({"is_error": 2}, (True, False, True, True)),
        ({"is_error": "yes"}, (True, True, True, True)),
        ({"is_error": 0, "span_status_code": "ERROR"}, (True, True, False, False)),
        ({"event_type": "payment_ERROR"}, (True, True, True, True)),
        ({"is_error": "no"}, (False, False, False, False)),
        ({}, (False, False, False, False)),
    ],
)
def test_error_rules(make_events, payload, expected):
    df = make_events((1, "2024-01-01T00:00:00Z", payload))
    row = df.select(
        *[is_error(df, v).alias(v) for v in ("materializer", "query", "view", "alert")]
    ).first()
    assert tuple(row) == expected


def test_signal(spark):
    rows = [("", "span_end"), ("x", "span"), (None, "identify"), ("", "metric"), ("", "click")]
    df = spark.createDataFrame(rows, "s string, t string")
    got = [r[0] for r in df.select(signal(F.col("s"), F.col("t"))).collect()]
    assert got == ["trace", "x", "analytics", "metric", "other"]


def test_bucket_before_epoch(spark):
    df = spark.sql("SELECT TIMESTAMP '1969-12-31 23:59:59.5' AS t")
    assert str(df.select(bucket(F.col("t"), 60).cast("string")).first()[0]) == "1969-12-31 23:59:00"
