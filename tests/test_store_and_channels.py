"""Append log and recovery, paced replay, CSV of ticks, bounded channels, counters, traces; new queries against their SQL."""

import json
import os
import random

import duckdb
import numpy as np
import pytest

from tests.test_plans_and_sources import chain, columns
from tickloom import queries
from tickloom.oracles import ORACLES
from tickloom.plans.registry import Engine
from tickloom.sources import segments as S
from tickloom.streaming import online

TRACE = "channel string, at bigint, op string"


def test_log_of_appends(tmp_path):
    folder = str(tmp_path / "store")
    price, volume, ts = columns()
    path = S.append_segment(folder, price[:3], volume[:3], ts[:3], f"a{S.SUFFIX}")
    assert S.append_segment(folder, price, volume, ts, f"a{S.SUFFIX}") == path
    assert len(S.unpack(open(path, "rb").read())[0]) == 10
    names = {os.path.basename(S.append_segment(folder, price[:4], volume[:4], ts[:4])) for _ in range(2)}
    assert len(names) == 2 and len(S.list_segments(folder)) == 3 and set(S.noted(folder).values()) == {"done"}
    S.note(folder, "begun", f"b{S.SUFFIX}")
    for name in ("b", "c"):
        (tmp_path / f"store/{name}{S.SUFFIX}.partial").write_bytes(b"x")
    with open(f"{folder}/{S.LOG}", "ab") as f:
        f.write(b'{"state": "done", "name": "b')
    assert S.noted(folder)[f"b{S.SUFFIX}"] == "begun"
    assert S.recover(folder, unlogged=False) == 1 and os.path.exists(f"{folder}/c{S.SUFFIX}.partial")
    assert S.recover(folder) == 1 and S.recover(folder) == 0 and len(S.list_segments(folder)) == 3
    with pytest.raises(S.SegmentError):
        S.append_segment(folder, price, volume, ts[::-1], f"d{S.SUFFIX}")
    assert S.noted(str(tmp_path)) == {}


def test_paced_replay(tmp_path):
    folder = str(tmp_path)
    price, volume, ts = columns()
    S.append_segment(folder, price, volume, ts, f"a{S.SUFFIX}")
    S.append_segment(folder, price[:4], volume[:4], ts[:4], f"b{S.SUFFIX}")
    waits = []
    got = list(S.paced_batches(folder, rate=10.0, batch=4, sleep=waits.append))
    assert [b.num_rows for b in got] == [4, 4, 2, 4] and len(waits) == 4 and waits == sorted(waits) and 1.0 < waits[-1] <= 1.4
    assert sum(b.num_rows for b in S.paced_batches(folder, 1020, 1060)) == 7 and not list(S.paced_batches(folder, 9000, sleep=waits.append))


def test_csv_of_ticks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1.5,10,1000\nbad,3,4\n2.5\n3,4,5.5\n7,8,9\n")
    assert sorted(tuple(r) for r in S.read_tick_csv(spark, str(tmp_path / "t.csv")).collect()) == [(1.5, 10.0, 1000), (7.0, 8.0, 9)]


def test_channels_against_plain_queues(spark):
    r, trace, dropped, blocked = random.Random(3), [], {}, {}
    for c in "ab":
        held = level = 0
        for at in range(120):
            op = "push" if r.random() < (0.6 if c == "a" else 0.4) else "pop"
            trace.append((c, at, op))
            ok = held < 3 if op == "push" else held > 0
            held += (1 if op == "push" else -1) * ok
            dropped[c, at] = ok, held
            ok = level < 3 if op == "push" else level > 0
            level = level + 1 if op == "push" else max(0, level - 1)
            blocked[c, at] = ok, min(level, 3), max(0, level - 3)
    df = spark.createDataFrame(r.sample(trace, len(trace)), TRACE)
    assert {(x["channel"], x["at"]): (x["ok"], x["depth"]) for x in online.bounded_channel(df, 3).collect()} == dropped
    got = online.blocking_channel(df, 3)
    assert {(x["channel"], x["at"]): (x["ok"], x["depth"], x["waiting"]) for x in got.collect()} == blocked
    counted = {x["channel"]: (x["accepted"], x["refused"], x["depth"], x["most"]) for x in online.channel_counters(got).collect()}
    pushes = {c: [blocked[k] for k in blocked if k[0] == c and (*k, "push") in set(trace)] for c in "ab"}
    assert counted == {c: (sum(x[0] for x in p), sum(not x[0] for x in p), blocked[c, 119][1], max(blocked[k][1] for k in blocked if k[0] == c)) for c, p in pushes.items()}
    assert online.channel_counters(online.blocking_channel(spark.createDataFrame([], TRACE), 3)).count() == 0


def test_engine_and_trace(spark):
    g, engine = chain(spark, [1, 2, 3]), Engine(spark)
    assert [r["d"] for r in engine.execute(g, timed=True)["twice"].orderBy("d").collect()] == [2, 4, 6] and set(engine.took) == g.live()
    events = json.loads(g.trace_json({"ticks": 1.0, "half": 2.0, "twice": 0.5}))["traceEvents"]
    assert [(e["name"], e["ts"], e["dur"]) for e in events] == [("ticks", 0, 10**6), ("half", 10**6, 2 * 10**6), ("twice", 3 * 10**6, 5 * 10**5)]


@pytest.mark.parametrize("name", ["bounded_channel", "blocking_channel"])
def test_channel_queries_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    df = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(names).collect()) == sorted(tuple(int(v) if not isinstance(v, str) else v for v in row) for row in want.fetchall())


def test_queue_depths_against_a_plain_queue():
    r = np.random.default_rng(7)
    for n, capacity, share in ((1, 3, 0.5), (64, 1, 0.5), (1000, 5, 0.6), (1000, 40, 0.5), (777, 1000, 0.9), (300, 0, 0.5)):
        steps = np.where(r.random(n) < share, 1, -1)
        for start, got in zip((0, capacity // 2, capacity), online.queue_depths(steps, capacity, (0, capacity // 2, capacity)), strict=True):
            want, y = [], start
            for s in steps.tolist():
                y = min(capacity, max(0, y + s))
                want.append(y)
            assert got.tolist() == want


def replayed(trace, capacity):
    depth, out = {}, {}
    for c, at, op in sorted(trace, key=lambda x: (x[0] or "", x[1])):
        y = depth.get(c, 0)
        ok = y < capacity if op == "push" else y > 0
        depth[c] = y + (1 if op == "push" else -1) * ok
        out[c, at] = ok, depth[c]
    return out


@pytest.mark.parametrize("capacity", [0, 5, 400, 10**6])
def test_channel_of_many_ranges_and_batches(spark, capacity):
    """Channels that span ranges and Arrow batches, many in one batch, and one without a name."""
    r = random.Random(5)
    trace = [(c, at, "push" if r.random() < share else "pop") for c, n, share in (("a", 4000, 0.55), ("b", 3000, 0.45), (None, 900, 0.6), ("z", 2500, 0.5)) for at in range(n)]
    trace += [(f"c{i}", at, "push") for i in range(40) for at in range(3)]
    df = spark.createDataFrame(r.sample(trace, len(trace)), TRACE)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        got = {(x["channel"], x["at"]): (x["ok"], x["depth"]) for x in online.bounded_channel(df, capacity).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == replayed(trace, capacity)


def test_a_channel_is_not_one_group_of_python(spark):
    trace = spark.range(50_000).selectExpr("'a' AS channel", "id AS at", "if(id % 3 = 0, 'pop', 'push') AS op")
    plan = online.bounded_channel(trace, 8)._jdf.queryExecution().toString()
    assert "FlatMapGroupsIn" not in plan and "FlatMapCoGroupsIn" not in plan
