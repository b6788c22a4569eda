"""Progress lines as events, and agents' states: tables against a plain walk, streams against tables."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import progress as P

T0 = dt.datetime(2024, 1, 1)


def test_events_are_typed_and_bad_lines_kept(spark):
    lines = [
        '{"event": "started", "model": "m", "containers": 3, "journeys": 2, "scout": true}',
        '{"event": "survey_done", "system": {"name": "s"}, "people": [], "externals": [], "containers": [{"id": "c"}]}',
        '{"event": "agent_activity", "role": "scout", "target": null, "kind": "reading", "path": "a.py"}',
        '{"event": "agent_done", "role": "scout", "ok": false, "cost_usd": 1, "secs": 2.5, "error": "no"}',
        '{"event": "stage"}', '{"event": "agent_activity", "role": "scout", "kind": "searching"}', '{"event": "agent_activity", "role": "scout", "kind": "sleeping"}',
        '{"event": "lost"}', '{"stage": "field"}', '{"event": "stage", ', "[1]", "", None,
    ]
    df = P.events(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq int, value string"))
    assert "value" not in df.columns
    r = {x.seq: x for x in df.withColumn("inner", F.try_variant_get("body", "$.containers[0].id", "string")).drop("body").collect()}
    assert (r[0].model, r[0].containers, r[0].journeys, r[0].scout) == ("m", 3, 2, True)
    assert r[1].event == "survey_done" and r[1].containers is None and r[1].inner == "c"
    assert (r[2].kind, r[2].path, r[2].target) == ("reading", "a.py", None)
    assert (r[3].ok, r[3].cost_usd, r[3].secs, r[3].error) == (False, 1.0, 2.5, "no")
    assert all(r[i].problem is None and r[i].raw is None for i in range(4))
    assert [r[i].problem for i in range(4, 13)] == ["stage without stage", "searching without query", "unknown activity", "unknown event lost", "no event", "not JSON", "no event", "not JSON", "not JSON"]
    assert all(r[i].event is None and r[i].raw == lines[i] for i in range(4, 13))


def test_events_of_no_lines(spark):
    assert P.events(spark.createDataFrame([], "value string, event int")).filter("event is not null").count() == 0


def walked(rows, as_of, timeout):
    """Agents by a walk over their events in order."""
    state = {}
    for ts, seq, run, e in sorted(rows, key=lambda r: r[:2]):
        if ts >= as_of or not e["event"].startswith("agent_"):
            continue
        second = int((ts - T0).total_seconds())
        a = state.setdefault((run, e["role"], e.get("target") or ""), {"from": second, "name": None, "reads": 0, "current": None, "end": None})
        if second >= a["from"] + timeout:
            continue
        if e["event"] == "agent_started" and a["name"] is None:
            a["name"] = e["name"]
        elif e["event"] == "agent_activity":
            a["reads"] += e["kind"] == "reading"
            a["current"] = e["path"] if e["kind"] == "reading" else f"searching {e['query']}".strip()
        elif e["event"] == "agent_done" and a["end"] is None:
            a["end"] = (e["cost_usd"], e["secs"], e.get("error"), e["ok"])
    out = set()
    for key, a in state.items():
        late = (as_of - T0).total_seconds() >= a["from"] + timeout
        status = ("done" if a["end"][3] else "failed") if a["end"] else "timed out" if late else "running"
        out.add((*key, a["name"], status, a["reads"], a["current"] if status == "running" else None, *(a["end"][:3] if a["end"] else (0.0, 0.0, P.stopped(timeout) if late else None))))
    return out


def some(seed, agents=12):
    """Events of agents: in time, beyond the deadline, without an end, with two ends, twice in one moment."""
    rng, rows, seq = random.Random(seed), [], 0
    for n in range(agents):
        role, target = rng.choice([("survey", None), ("container", f"c:{n}"), ("journey", f"j:{n}")])
        run, begin = f"r{n % 3}-{n}", rng.randrange(0, 900)
        made = [(0, {"event": "agent_started", "name": f"n{n}"})]
        made += [(rng.randrange(0, 90), rng.choice([{"event": "agent_activity", "kind": "reading", "path": f"f{rng.randrange(4)}"}, {"event": "agent_activity", "kind": "searching", "query": rng.choice(["x", ""])}])) for _ in range(rng.randrange(12))]
        made += [(rng.randrange(20, 100), {"event": "agent_done", "ok": rng.random() < 0.7, "cost_usd": 0.25, "secs": 3.0, "error": rng.choice([None, "e"])}) for _ in range(rng.randrange(3))]
        for after, e in made:
            seq += 1
            rows.append((T0 + dt.timedelta(seconds=begin + after, milliseconds=rng.choice([0, 0, 500])), seq, run, {"role": role, "target": target, **e}))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(ts, seq, run, json.dumps(e)) for ts, seq, run, e in rows], "ts timestamp, seq long, run string, value string")


@pytest.mark.parametrize("seed", [1, 2])
def test_agents_equal_a_walk(spark, seed):
    rows = some(seed, 60)
    for as_of in (T0 + dt.timedelta(seconds=500), T0 + dt.timedelta(days=1)):
        got = P.agents(P.events(table(spark, rows)), F.lit(as_of), 60)
        assert {tuple(r) for r in got.collect()} == walked(rows, as_of, 60)


def test_stream_equals_table(spark, tmp_path):
    """Events come out of order in three batches; one agent's first event comes after its others, some agents run
    out of time, one wakes after its deadline; then a last event moves the watermark."""
    rows = some(5)
    last = (T0 + dt.timedelta(seconds=20_000), 10_000, "z", {"event": "agent_started", "role": "editor", "name": "z"})
    waking = (T0 + dt.timedelta(seconds=2000), 9_999, rows[0][2], {**rows[0][3], "event": "agent_started", "name": "again"})
    random.Random(3).shuffle(rows)
    source = str(tmp_path / "in")
    for i, part in enumerate([rows[::2], rows[1::2], [waking], [last]]):
        table(spark, part).coalesce(1).write.mode("append").json(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.STATE_STORE)
    try:
        lines = spark.readStream.schema("ts timestamp, seq long, run string, value string").option("maxFilesPerTrigger", 1).json(source)
        q = P.agents_stream(P.events(lines), "30 minutes", 60).writeStream.format("memory").queryName("agents_").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None and not q.isActive
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.table("agents_")
    final = [tuple(r) for r in out.filter("final").drop("final").collect()]
    assert sorted(final, key=str) == sorted(walked([*rows, waking], T0 + dt.timedelta(days=1), 60), key=str)
    assert {"timed out", "done", "failed"} <= {r[4] for r in final}
    assert out.filter("run = 'z' and status = 'running' and not final").count() == 1
