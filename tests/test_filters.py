"""Facets with and without the index, time, text, paging, search."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.paths import Fields
from tidemark.operators import filters, indexes, pages, search
from tidemark.operators.filters import TimeRange
from tidemark.plans.facets import Facet, facet_path, scope_of_path
from tidemark.plans.matchers import alert_matcher, matcher

T0 = "2024-01-01T00:00:00Z"


def ids(df):
    return sorted(int(r["event_id"]) for r in df.select("event_id").collect())


@pytest.fixture(scope="module")
def events(make_events):
    return make_events(
        (1, T0, {"a": "1", "b": [{"x": 1, "y": "p"}, {"x": 2, "y": "q"}]}),
        (2, T0, {"a": 1, "b": [{"x": 1, "y": "q"}]}),
        (3, T0, {"a": True, "f": None}),
        (4, T0, {"a": "true", "f": "null"}),
        (5, T0, {"c": "Hello World"}),
    )


CASES = [
    ([Facet("a", "eq", "1")], [1, 2, 3]),
    ([Facet("a", "eq", "true")], [3, 4]),
    ([Facet("a", "eq", "1", negated=True)], [4, 5]),
    ([Facet("a", "in", values=("1", "true"))], [1, 2, 3, 4]),
    ([Facet("a", "in")], []),
    ([Facet("f", "exists")], [3, 4]),
    ([Facet("f", "eq", "null")], [3, 4]),
    ([Facet("a", "gte", "1")], [2]),
    ([Facet("c", "contains", "WORLD")], [5]),
    ([Facet("c", "contains", "world", negated=True)], [1, 2, 3, 4]),
    ([Facet("b[].x", "eq", "1"), Facet("b[].y", "eq", "q")], [2]),
    ([Facet("b[].x", "eq", "1"), Facet("b[].y", "eq", "q", negated=True)], [1][:0]),
    ([Facet("b[].x", "eq", "2")], [1]),
    ([Facet("a", "exists"), Facet("c", "exists", join="or")], [1, 2, 3, 4, 5]),
    ([Facet("a", "exists", negated=True), Facet("f", "exists", join="or")], [3, 4, 5]),
    ([Facet("c", "contains", "o"), Facet("f", "exists", join="or")], [3, 4, 5]),
    ([], [1, 2, 3, 4, 5]),
]


@pytest.mark.parametrize(("facets", "expected"), CASES)
def test_facets(events, facets, expected):
    assert ids(filters.filter_facets(events, facets, indexes.kv_index(events))) == expected
    assert ids(filters.filter_facets(events, facets)) == expected


def test_index_and_rows_agree(make_events):
    rng = random.Random(3)
    events = make_events(
        *[
            (i, T0, {"p": rng.randint(0, 3), "q": rng.choice(["u", "v", None]),
                     "l": [{"m": rng.randint(0, 2), "n": rng.randint(0, 2)} for _ in range(2)]})
            for i in range(40)
        ]
    )
    index = indexes.kv_index(events)
    choices = [
        Facet("p", "gt", "1"), Facet("q", "eq", "u"), Facet("q", "eq", "null", negated=True),
        Facet("l[].m", "eq", "1"), Facet("l[].n", "lt", "1"),
    ]
    for pair in itertools.combinations(choices, 3):
        mixed = [pair[0], pair[1], Facet(**{**pair[2].__dict__, "join": "or"})]
        assert ids(filters.filter_facets(events, mixed, index)) == ids(
            filters.filter_facets(events, mixed)
        )


def test_facet_arguments():
    with pytest.raises(ValueError):
        Facet("a", "gt", "x")
    with pytest.raises(ValueError):
        Facet("a", "like", "x")
    with pytest.raises(ValueError):
        Facet("1a", "eq", "x")
    assert facet_path("http-route") == "http.route" and facet_path("traceId") == "trace_id"
    assert scope_of_path("a[].b[].c") == "a.b" and scope_of_path("a.b") is None


def test_index_filter_needs_no_python_and_no_cross_join(events):
    index = indexes.kv_index(events)
    df = filters.filter_facets(events, [Facet("a", "eq", "1")], index)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "LeftSemi" in plan


def test_time_windows(make_events):
    times = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:01Z", "2024-01-01T00:00:02Z"]
    events = make_events(*[(i, t, {}) for i, t in enumerate(times)])
    whole = TimeRange(times[0], times[1])
    assert ids(filters.in_time(events, whole)) == [0, 1]
    assert ids(filters.in_time(events, whole, after=times[2])) == [2]
    assert ids(filters.in_window(events, times[0], times[2])) == [0, 1]
    assert ids(filters.in_time(events, TimeRange(lookback_minutes=5))) == []


def test_matcher_semantics(make_events):
    events = make_events(
        (1, T0, {"v": 1}), (2, T0, {"v": "1"}), (3, T0, {"v": None}), (4, T0, {}),
        (5, T0, {"v": [1]}), (6, T0, {"v": ""}), (7, T0, {"v": "x"}),
    )

    def match(op, **value):
        spec = {"path": "v", "op": op, **value}
        return ids(events.where(matcher(Fields(events), {"all": [spec]})))

    assert match("exists") == [1, 2, 5, 6, 7]
    assert match("eq", value=1) == [1, 2]
    assert match("neq", value=1) == [3, 5, 6, 7]
    assert match("eq", value=None) == [3, 5, 6]
    assert match("is_number") == [1, 2]
    assert match("in", value=["x", 1]) == [1, 2, 7]
    assert match("eq") == []
    with pytest.raises(ValueError):
        match("like", value=1)


def test_alert_conditions(make_events):
    events = make_events(
        (1, T0, {"v": "aBc", "n": "5"}), (2, T0, {"v": None}), (3, T0, {"x": {"y": 3}, "x.y": 4})
    )

    def match(**condition):
        return ids(events.where(alert_matcher(events, {"all": [condition]})))

    assert match(path="v", op="contains", value="B") == [1]
    assert match(path="v", op="contains", value="b") == []
    assert match(path="v", op="not_exists") == [2, 3]
    assert match(path="n", op="gte", value=5) == [1]
    assert match(path="data.x.y", op="eq", value=3) == [3]
    assert match(path="v", op="ne", value="q") == [1, 2, 3]
    assert match(path="v", op="regex", value="^a.c$") == [1]
    assert match(path="event_id", op="eq", value="2") == [2]
    with pytest.raises(ValueError):
        match(path="v", op="close_to")


def test_whole_text(make_events):
    events = make_events((1, T0, {"v": "Needle"}), (2, T0, {}))
    assert ids(filters.filter_whole_text(events, text="needle")) == [1]
    assert ids(filters.filter_whole_text(events, regex='"event_id":"2"')) == [2]


def walk(events, direction, limit):
    cursor, seen = None, []
    while True:
        rows = pages.page(events, direction, cursor, limit).collect()
        if not rows:
            return seen
        seen += [int(r["event_id"]) for r in rows]
        last = rows[-1]
        side = "before" if direction == "desc" else "after"
        cursor = pages.Cursor(side, last["timestamp"], last["event_id"])


def test_paging_visits_every_event_once(make_events):
    events = make_events(*[(i, f"2024-01-01T00:00:{i // 3:02d}Z", {}) for i in range(10, 21)])
    assert walk(events, "desc", 4) == list(range(20, 9, -1))
    assert walk(events, "asc", 4) == list(range(10, 21))


def test_page_next_to_cursor(make_events):
    events = make_events(*[(i, f"2024-01-01T00:00:{i:02d}Z", {}) for i in range(10)])
    at = "2024-01-01T00:00:04Z"
    rows = pages.page(events, "desc", pages.Cursor("after", at), 2).collect()
    assert [r["event_id"] for r in rows] == ["6", "5"]
    rows = pages.page(events, "asc", pages.Cursor("before", at), 2).collect()
    assert [r["event_id"] for r in rows] == ["2", "3"]
    rows = pages.page(events, "desc", pages.Cursor("around", at), 2).collect()
    assert [r["event_id"] for r in rows] == ["4", "3"]


def test_search(make_events):
    events = make_events(*[(i, f"2024-01-01T00:00:{i:02d}Z", {"m": "x" * 300 + " Target"}) for i in range(5)])
    index = indexes.text_index(events)
    rows = search.search(index, events, "target", limit=2, offset=1).collect()
    assert [r["event_id"] for r in rows] == ["3", "2"]
    assert len(rows[0]["snippet"]) <= 240 and "Target" in rows[0]["snippet"]
    with pytest.raises(ValueError):
        search.search(index, events, "x")
    with pytest.raises(ValueError):
        search.search(index, events, "target", mode="fuzzy")


def test_dimension_filters(spark):
    df = spark.sql("SELECT map('a', 'x') AS dimensions UNION ALL SELECT map('b', 'y')")
    assert filters.filter_dimensions(df, {"a": ""}).count() == 1
    assert filters.filter_dimensions(df, {"a": "x"}).count() == 1
    cube = spark.sql("SELECT array('a','b') AS dimension_names, array('1','2') AS dimension_values")
    assert filters.filter_cube_dimensions(cube, {"b": "2"}).count() == 1
    assert filters.filter_cube_dimensions(cube, {"c": "2"}).count() == 0
    assert F is not None
