"""Search through postings against search in every text."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import indexes, search
from tidemark.operators.filters import TimeRange


@pytest.fixture
def source(spark, make_events, tmp_path):
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma ray", "ÄÖ über", "x1", "zz top", "Σίσυφος", "😀 smile", "needle in hay"]
    rows = [(k, f"2024-01-{1 + k % 9:02d}T00:00:{k % 60:02d}Z", {"message": " ".join(rng.choices(words, k=rng.randint(0, 6)))}) for k in range(150)]
    rows += [(500, "2024-01-20T00:00:00Z", {"message": "a rare thing " + "long text " * 4000}), (501, "2024-01-20T00:00:00Z", {})]
    events = make_events(*rows)
    index = indexes.text_index(events)
    path = str(tmp_path / "postings")
    search.write_postings(search.postings(index), path)
    return events, index, spark.read.parquet(path)


def test_answers_are_the_same(source):
    events, index, posted = source
    for phrase in ("gamma ray", "BETA alpha", "über", "x1", "zz", "äö", "ΣΊΣ", "😀 sm", "needle in hay needle", "no such phrase", "a rare thing long text long", "ta", "message:"):
        for more in ({}, {"limit": 3, "offset": 2}, {"time_range": TimeRange("2024-01-03T00:00:00Z", "2024-01-05T00:00:00Z")}):
            plain = search.search(index, events, phrase, **{"limit": 1000, **more})
            through = search.search(index, events, phrase, postings=posted, **{"limit": 1000, **more})
            assert [tuple(r) for r in through.collect()] == [tuple(r) for r in plain.collect()], phrase


def test_a_lookup_pushes_its_grams_to_the_scan(source):
    _, _, posted = source
    found = search.candidates(posted, "a rare thing long")
    plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "In(gram" in pushed and "EqualTo(size,3)" in pushed
    assert [r["event_id"] for r in found.collect()] == ["500"]
    read = posted.where(F.col("size") == 3).groupBy("gram").count()
    assert read.where("count > 140").count() > 5  # hot grams are there, and split by range


def test_short_and_empty_texts(spark):
    rows = [("t", "1", "2024-01-01 00:00:00", ""), ("t", "2", "2024-01-01 00:00:00", "a"), ("t", "3", "2024-01-01 00:00:00", "ab"), ("t", "4", "2024-01-01 00:00:00", None), ("t", "5", "2024-01-01 00:00:00", "aaaa")]
    index = spark.createDataFrame(rows, "tenant_id string, event_id string, time string, text string").withColumn("timestamp", F.to_timestamp("time"))
    got = {(r["event_id"], r["size"]): r["n"] for r in search.postings(index).groupBy("event_id", "size").agg(F.count("*").alias("n")).collect()}
    assert got == {("3", 2): 1, ("5", 2): 1, ("5", 3): 1}
