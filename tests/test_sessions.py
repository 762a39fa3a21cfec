"""A lending library whose loans come from a seeded generator, counted in plain Python.

Members join, search, borrow, maybe renew, and give back or not; each return reports
how many days the loan took. What Spark finds must equal what the generator noted down.
"""

import random
from collections import Counter, defaultdict

import pytest

from tidemark.functions.quantiles import sketch_percentiles
from tidemark.operators import cohorts, indexes, measures, sequences
from tidemark.operators.filters import filter_facets
from tidemark.plans.definitions import Definition
from tidemark.plans.facets import Facet

BRANCHES = {"harbour": 5, "hill": 3, "mill": 1}
SHELVES = ("maps", "novels", "scores")
PATH = ("searched", "borrowed", "returned")


def kind_is(name):
    return {"path": "event_type", "value": name}


@pytest.fixture(scope="module")
def library(make_events):
    rng = random.Random(20240229)
    rows, depth, days, fans = [], Counter(), defaultdict(list), set()
    for member in range(700):
        branch = rng.choices(list(BRANCHES), BRANCHES.values())[0]
        minute = rng.randrange(0, 600)
        shelf = rng.choice(SHELVES)
        stages = 1 + (rng.random() < 0.7) + 0
        stages += stages == 2 and rng.random() < 0.6
        for stage, name in enumerate(PATH[:stages]):
            depth[branch, stage] += 1
            at = f"2024-02-29T{(minute + 15 * stage) // 60:02d}:{(minute + 15 * stage) % 60:02d}:07Z"
            payload = {"event_type": name, "member": f"m{member}", "branch": branch, "loan": {"shelf": shelf}}
            if name == "returned":
                payload["loan"]["days"] = rng.randint(1, 40)
                days[branch, shelf].append(payload["loan"]["days"])
                if shelf == "maps":
                    fans.add(f"m{member}")
            rows.append((f"{member}/{name}", at, payload))
    return make_events(*rows).cache(), depth, days, fans


def test_loan_days_by_branch_and_shelf(library):
    events, _, days, _ = library
    output = {
        "target": "measure_cube_rollups", "measure_name": "days", "value": {"path": "loan.days"}, "bucket_seconds": 3600,
        "dimension_sets": [{"id": "where", "dimensions": [
            {"name": "branch", "value": {"path": "branch"}}, {"name": "shelf", "value": {"path": "loan.shelf"}}]}],
    }
    config = {"match": {"all": [kind_is("returned")]}, "outputs": [output]}
    points = measures.measure_cube_points(events, [Definition("loans", "measure", config, "t", "days", "cube")])
    rolled = measures.merge_rollups(measures.measure_cube_rollups(points), ["dimension_values"])
    found = rolled.select("dimension_values", "count", "sum", *sketch_percentiles("quantiles_state")).collect()
    assert {tuple(r["dimension_values"]): (r["count"], r["sum"]) for r in found} == {
        place: (len(seen), sum(seen)) for place, seen in days.items()
    }
    for row in found:
        seen = sorted(days[tuple(row["dimension_values"])])
        rank = sum(d <= row["p90"] for d in seen) / len(seen)
        assert rank >= 0.85 and sum(d < row["p90"] for d in seen) / len(seen) <= 0.95


def test_loan_funnel_by_branch(library):
    events, depth, _, _ = library
    steps = [sequences.Step(name, {"all": [kind_is(name)]}) for name in PATH]
    rows = sequences.funnel(events, steps, "member", {"branch": "branch"}).collect()
    assert {(r["branch"], r["step_index"]): r["entity_count"] for r in rows} == dict(depth)


def test_map_readers_as_cohort_and_as_filter(library):
    events, _, _, fans = library
    match = {"all": [kind_is("returned"), {"path": "loan.shelf", "value": "maps"}]}
    config = {"match": match, "outputs": [{"entity_type": "member", "entity_id": {"path": "member"}}]}
    members = cohorts.cohort(events, [Definition("maps", "cohort", config, "t", "map_readers")])
    assert {r["entity_id"] for r in members.collect()} == fans
    facets = [Facet("event_type", "eq", "returned"), Facet("loan.shelf", "eq", "maps")]
    assert filter_facets(events, facets, indexes.kv_index(events)).count() == len(fans)
