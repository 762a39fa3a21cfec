"""Many funnels in one walk against walking each entity's events."""

import random

from tidemark.operators import sequences
from tidemark.plans.definitions import Definition


def funnels(n):
    made = []
    for k in range(n):
        steps = [{"name": f"s{i}", "match": {"all": [{"path": "kind", "value": "abc"[(k + i) % 3]}]}} for i in range(1 + k % 4)]
        output = {"entity_id": {"path": "user"}, "steps": steps, "bucket_seconds": [3600, 86_400, 60][k % 3], "report_id": f"r{k}"}
        if k % 2:
            output["dimensions"] = [{"name": "plan", "value": {"path": "plan"}}]
        made.append(Definition(f"d{k}", "sequence", {"match": {"all": [{"path": "plan", "op": "exists"}]} if k % 5 == 0 else {}, "outputs": [output]}, f"t{k % 2}", f"n{k}", "funnel"))
    return made


def brute(rows, made):
    counts = {}
    for k, d in enumerate(made):
        output = d.config["outputs"][0]
        width, steps = output["bucket_seconds"], [s["match"]["all"][0]["value"] for s in output["steps"]]
        state = {}
        for second, data in sorted(rows, key=lambda r: r[0]):
            if data["tenant_id"] != d.tenant_id or (k % 5 == 0 and data["plan"] is None) or not data["user"]:
                continue
            segment = data["plan"] if k % 2 and data["plan"] else None
            key = (second // width * width, segment, data["user"])
            # An event may match several steps, in their order.
            for i, kind in enumerate(steps):
                if data["kind"] == kind and state.get(key, 0) == i:
                    state[key] = i + 1
        groups = {}
        for (bucket, segment, _), reached in state.items():
            groups.setdefault((bucket, segment), []).append(reached)
        for (bucket, segment), reached in groups.items():
            deepest = max(reached)
            for i in range(deepest):
                here = sum(r > i for r in reached)
                counts[(d.tenant_id, f"r{k}", bucket, segment, i, f"s{i}")] = (here, sum(r > i + 1 for r in reached) if i + 1 < deepest else here)
    return counts


def test_ten_funnels_are_one_scan_and_two_walk_shuffles(spark, make_events, tmp_path):
    rng = random.Random(6)
    rows = []
    for n in range(900):
        # A third of all events are one user's, over many days.
        user = "hot" if n % 3 == 0 else rng.choice(["a", "b", "c", "d", ""])
        second = 1_704_067_200 + (rng.randrange(400_000) if user == "hot" else rng.randrange(8_000))
        rows.append((second, {"tenant_id": f"t{n % 2}", "user": user, "kind": rng.choice("abcd"), "plan": rng.choice(["pro", "free", None])}))
    rows = list({r[0]: r for r in rows}.values())
    from datetime import datetime, timezone

    stamp = lambda s: datetime.fromtimestamp(s, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    events = make_events(*[(n, stamp(s), d) for n, (s, d) in enumerate(rows)])
    events.write.parquet(str(tmp_path / "events"))
    stored = spark.read.schema(events.schema).parquet(str(tmp_path / "events"))
    for n in (10, 80):
        made = funnels(n)
        found = sequences.sequence_report(stored, made)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") <= 3
        got = {
            (r["tenant_id"], r["report_id"], int(r["bucket_time"].replace(tzinfo=timezone.utc).timestamp()), r["segment"].get("plan"), r["step_index"], r["step_name"]): (r["entity_count"], r["conversion_count"])
            for r in found.collect()
        }
        assert got == brute(rows, made) and len(got) > 100
