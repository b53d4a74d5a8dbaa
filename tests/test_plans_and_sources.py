"""Graphs, segments, streams, plans' shapes and the driver's entry points."""

import os
import random
import subprocess
import sys
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT
from tests.test_operators import ticks, values, walk
from tickloom.operators import windows
from tickloom.plans import graph as G
from tickloom.sources import segments as S
from tickloom.streaming import online


def chain(spark, prices):
    base = ticks(spark, prices)
    g = G.PlanGraph()
    g.add("ticks", "scan", lambda: base)
    g.add("half", "transform", lambda t: t.withColumn("h", F.col("price") / 2), ("ticks",))
    g.add("twice", "transform", lambda t: t.withColumn("d", F.col("h") * 4), ("half",), output=True)
    g.add("dead", "transform", lambda t: 1 / 0, ("ticks",))
    return g


def test_graph(spark):
    g = chain(spark, [1, 2, 3, 4])
    assert g.live() == {"ticks", "half", "twice"} and g.fused() == [("half", "twice")]
    assert values(g.execute()["twice"], "d") == [2, 4, 6, 8]
    assert g.critical_path({"ticks": 1, "half": 2, "twice": 3, "dead": 1}) == (["ticks", "half", "twice"], 6)
    assert set(g.timed()) == g.live()
    one, two = G.run_manifest(g, "a"), G.run_manifest(chain(spark, [1, 2, 3, 4]), "b")
    assert G.verify(G.Manifest.from_json(one.to_json()), two) == {"graph_matches": True, "outputs_match": True, "diverged": []}
    nudged = G.run_manifest(chain(spark, [1, 2, 3 + 1e-9, 4]), "c")
    assert G.verify(one, nudged) == {"graph_matches": True, "outputs_match": False, "diverged": ["twice"]}
    with pytest.raises(ValueError, match="cycle"):
        G.PlanGraph().add("x", "t", None, ("y",)).add("y", "t", None, ("x",)).levels()
    with pytest.raises(ValueError):
        G.PlanGraph().add("x", "t", None, ("gone",)).levels()
    assert G.fnv1a(b"a") == 0xAF63DC4C8601EC8C


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_follow_their_edges(seed):
    r = random.Random(seed)
    g = G.PlanGraph()
    for i in range(120):
        g.add(str(i), "t", lambda *x: 1 + sum(x), tuple(str(j) for j in range(i) if r.random() < 1 / 13), output=r.random() < 0.2)
    want = {}
    for i in range(120):
        want[str(i)] = 1 + sum(want[d] for d in g.nodes[str(i)].needs)
    assert g.execute() == {k: want[k] for k, n in g.nodes.items() if n.output}


def columns(n=10):
    return np.arange(n) + 100.0, np.arange(n) + 1.0, 1000.0 + 10 * np.arange(n)


def test_segment_bytes():
    price, volume, ts = columns()
    data = S.pack(price, volume, ts)
    assert all((a == b).all() for a, b in zip(S.unpack(data), (price, volume, ts), strict=True))
    assert S.header(data)["min"][2] == 1000 and S.header(data)["n"] == 10
    assert np.isnan(S.header(S.pack(*columns(0)))["min"][0])
    for bad in (ts[::-1], np.append(ts[:-1], np.nan)):
        with pytest.raises(S.SegmentError):
            S.pack(price, volume, bad)
    with pytest.raises(S.SegmentError):
        S.pack(price[:3], volume, ts)
    r = random.Random(1)
    for _ in range(1500):
        raw = bytearray(data[: r.randint(0, len(data))] if r.random() < 0.4 else data)
        for _ in range(r.randint(1, 3)):
            if raw:
                raw[r.randrange(len(raw))] ^= 1 << r.randrange(8)
        try:
            S.unpack(bytes(raw))
        except S.SegmentError:
            pass


def test_store_range_and_recovery(spark, tmp_path):
    S.register(spark)
    folder = str(tmp_path / "store")
    os.makedirs(folder)
    price, volume, ts = columns()
    S.seal(f"{folder}/a{S.SUFFIX}", S.pack(price[:4], volume[:4], ts[:4]))
    S.seal(f"{folder}/b{S.SUFFIX}", S.pack(price[4:], volume[4:], ts[4:]))
    (tmp_path / "store/torn.partial").write_bytes(b"x")
    assert S.recover(folder) == 1 and S.recover(folder) == 0 and S.recover(str(tmp_path / "none")) == 0
    df = spark.read.format("tickseg").option("path", folder).option("batch", 3).load()
    got = S.replay_range(spark, folder, 1020, 1060, batch=3).collect()
    assert len(got) == 5 and sum(r["price"] for r in got) == 520
    assert S.replay_range(spark, folder, 5000, 9000).count() == 0 and df.count() == 10 and df.where("ts_ns > 1030").count() == 6
    reader = S.SegmentReader(folder, False, 4096, 1040.0, 2000.0)
    assert [os.path.basename(p.path)[0] for p in reader.partitions()] == ["b"]
    df.write.format("tickseg").option("path", str(tmp_path / "copy")).mode("append").save()
    assert spark.read.format("tickseg").option("path", str(tmp_path / "copy")).load().agg(F.sum("price")).first()[0] == sum(price)
    assert not [x for x in os.listdir(tmp_path / "copy") if x.endswith(".partial")]
    assert S.save_flat(str(tmp_path / "t.flat"), price, volume, ts) == 16 + 240
    flat = spark.read.format("tickseg").option("path", str(tmp_path / "t.flat")).option("flat", "true").load()
    assert flat.agg(F.sum("ts_ns")).first()[0] == ts.sum()
    (tmp_path / "cut.flat").write_bytes((tmp_path / "t.flat").read_bytes()[:-9])
    with pytest.raises(S.SegmentError):
        S.load_flat(str(tmp_path / "cut.flat"))


def test_parquet_store_prunes(spark, tmp_path):
    p, v = walk(400)
    store = S.TickStore(spark, str(tmp_path / "ticks"))
    store.append(ticks(spark, p, v), files=4)
    inside = store.range(1500, 2500)
    assert inside.count() == 101 and store.range(9999, None).count() == 0
    plan = inside._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts_ns,1500)" in plan and "LessThanOrEqual(ts_ns,2500)" in plan
    rows = store.inspect().collect()
    assert max(r["n"] for r in rows if r["file"] is None) == 400 and len(rows) == 5
    b = S.replay_batches(ticks(spark, p, v), 150).orderBy("batch").collect()
    assert [r["n"] for r in b] == [150, 150, 100]


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1.5,10\nbad,3\n2.5\n,4\n3,\n")
    assert sorted(tuple(r) for r in S.read_csv(spark, str(tmp_path / "x.csv")).collect()) == [(1.5, 10.0), (2.5, 0.0), (3.0, 0.0)]


def test_charts(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"symbol": "A", "timestamp": [10, 20, 30], "close": [1.5, null, 3.0], "volume": [7, 8, null]}\n{"symbol": "B", "timestamp": [], "close": [], "volume": []}\n')
    assert [tuple(r) for r in S.read_charts(spark, str(tmp_path / "c.json")).orderBy("ord").collect()] == [("A", 10, 10 * 10**9, 1.5, 7.0), ("A", 30, 30 * 10**9, 3.0, 0.0)]


def test_command_line(tmp_path, capsys):
    from tickloom.__main__ import main

    S.seal(f"{tmp_path}/a{S.SUFFIX}", S.pack(*columns()))
    (tmp_path / f"b{S.SUFFIX}").write_bytes(b"junk" * 60)
    (tmp_path / "c.partial").write_bytes(b"")
    assert main(["inspect", str(tmp_path)]) == 0
    out = capsys.readouterr().out
    assert "10 rows, time 1000 to 1090" in out and "total: 10 rows" in out and "not a segment" in out
    assert main(["recover", str(tmp_path)]) == 0 and "1 unfinished" in capsys.readouterr().out
    assert main([]) == 2


def test_one_window_for_three_features(spark):
    plan = windows.rolling_features(ticks(spark, [1, 2, 3]), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1


def test_stream_mean_is_batch_mean(spark, tmp_path):
    online.use_rocksdb(spark)
    p, v = walk(60)
    t = ticks(spark, p, v).unionByName(ticks(spark, p[:5], v[:5], "b"))
    for i in range(3):
        t.where(F.floor(F.col("ord") / 20) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part{i}"))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = online.online_mean_stream(stream, 10).writeStream.format("memory").queryName("means").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["instrument"], r["ord"]): r["mean"] for r in spark.table("means").collect()}
    want = {(r["instrument"], r["ord"]): r["m"] for r in t.withColumn("m", windows.online_mean(F.col("price"), 10)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_plan_per_batch(spark, tmp_path):
    p, v = walk(30)
    t = ticks(spark, p, v)
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = online.each_batch(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in")), lambda b: windows.rolling_features(b, 3), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 30 and out.where("mean IS NOT NULL").count() == 28


def test_channel_and_gaps(spark):
    trace = [("c", 1, "push"), ("c", 2, "push"), ("c", 3, "push"), ("c", 4, "pop"), ("c", 5, "push"), ("c", 6, "pop"), ("c", 7, "pop"), ("c", 8, "pop")]
    got = online.bounded_channel(spark.createDataFrame(trace, "channel string, at bigint, op string"), 2).orderBy("at").collect()
    assert [r["ok"] for r in got] == [True, True, False, True, True, True, True, False]
    frames = spark.createDataFrame([("a", s) for s in (0, 1, 4, 5, 9)], "instrument string, sequence bigint")
    assert sorted(r["missing"] for r in online.sequence_gaps(frames).collect()) == [2, 3]


def test_frames_and_feed(spark):
    rows = [(1000 + 10 * i, 100.0 + i, 1.0 + i, i) for i in range(10)]
    data = online.pack_frames(rows)
    whole, carry = online.unpack_frames(data[:70])
    assert whole == rows[:2] and online.unpack_frames(carry + data[70:])[0] == rows[2:]
    assert online.unpack_frames(online.pack_frames([(-5, 1, 1, 0)]))[0][0][0] == 0
    port, ready = [], threading.Event()
    t = ticks(spark, [100.0 + i for i in range(10)], [1.0 + i for i in range(10)])
    sent = []
    server = threading.Thread(target=lambda: sent.append(online.serve(t, 0, batch=3, ready=lambda p: (port.append(p), ready.set()))))
    server.start()
    assert ready.wait(30)
    feed = online.FeedReader("127.0.0.1", port[0], 4)
    got, at = [], feed.initialOffset()
    while len(got) < 10:
        some, at = feed.read(at)
        got += list(some)
    server.join(30)
    assert got == rows and sent == [10] and at == {"frames": 10}
    assert list(feed.readBetweenOffsets({"frames": 2}, {"frames": 4})) == rows[2:4]
    feed.commit({"frames": 3})
    assert list(feed.readBetweenOffsets({"frames": 3}, {"frames": 5})) == rows[3:5]


def test_feed_as_stream(spark, tmp_path):
    spark.dataSource.register(online.FeedSource)
    port, ready = [], threading.Event()
    t = ticks(spark, [100.0 + i for i in range(10)], [1.0 + i for i in range(10)])
    threading.Thread(target=lambda: online.serve(t, 0, batch=4, rate=1000.0, ready=lambda p: (port.append(p), ready.set())), daemon=True).start()
    assert ready.wait(30)
    stream = spark.readStream.format("tickfeed").option("port", port[0]).load()
    q = stream.writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            if spark.table("frames").count() >= 10:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    got = spark.table("frames").orderBy("sequence").collect()
    assert [r["sequence"] for r in got] == list(range(10)) and sum(r["price"] for r in got) == 1045


def test_sweep_empties_only_its_own_folder(spark, tmp_path):
    from tickloom import lineage

    df = lineage.saved(spark.range(5), "five")
    folder = lineage.own_folder(spark).removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(folder)
    lineage.sweep(spark)
    assert not os.path.exists(folder) and os.path.isdir(os.path.dirname(folder))


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_works_without_the_text_operators(tmp_path):
    """As the driver does: the llm folders and corpus_pipeline.py gone."""
    import shutil

    shutil.copytree(ROOT / "tickloom", tmp_path / "tickloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ema' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_queries_against_duckdb(spark):
    import duckdb

    from tickloom.oracles import ORACLES
    from tickloom.queries import QUERIES

    folder, db = "/root/testdata/sf0.001", duckdb.connect()
    for table in "orders events embeddings".split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, folder)
        cells = lambda v: v if v is None or isinstance(v, str) else round(float(v), 9)
        got = sorted((tuple(cells(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        want = sorted((tuple(cells(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in found.fetchall()), key=repr)
        assert sorted(df.columns) == sorted(names) and got == want, name
