import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tidemark.session import local_session  # noqa: E402
from tidemark.sources.events import to_canonical  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """Canonical events from (event_id, timestamp, payload) triples."""

    def make(*rows, offset=0):
        data = [
            (str(i), time, json.dumps({"tenant_id": "t", **payload}, separators=(",", ":")), offset + n)
            for n, (i, time, payload) in enumerate(rows)
        ]
        raw = spark.createDataFrame(
            data, "event_id string, time string, data string, source_offset bigint"
        )
        return to_canonical(
            raw.select(
                "event_id", F.to_timestamp("time").alias("timestamp"), "data", "source_offset"
            )
        )

    return make
