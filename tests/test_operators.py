"""Operators against hand-computed values and plain loops."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.functions import display, ieee
from tickloom.functions.expression import ExpressionError, evaluate
from tickloom.operators import reductions, scans, tensor, windows
from tickloom.plans import pipelines, report
from tickloom.plans.registry import KERNELS, Engine, close
from tickloom.ticks import TICK_SCHEMA


def ticks(spark, prices, volumes=None, instrument="a"):
    volumes = volumes or [1.0] * len(prices)
    rows = [(instrument, i, 1000 + 10 * i, float(p) if p is not None else None, float(v)) for i, (p, v) in enumerate(zip(prices, volumes, strict=True))]
    return spark.createDataFrame(rows, TICK_SCHEMA)


def values(df, column):
    return [r[column] for r in df.orderBy("instrument", "ord").collect()]


def near(got, want, eps=1e-9):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert (a is None) == (b is None) and (a is None or close(a, b, eps)), (a, b)


def walk(n, seed=1, offset=0.0):
    r = np.random.default_rng(seed)
    return (100 * np.cumprod(1 + r.normal(0, 1e-3, n)) + offset).tolist(), r.lognormal(4, 1, n).tolist()


def brute(p, v, w):
    out = []
    for i in range(len(p)):
        if w == 0 or i + 1 < w:
            out.append((None, None, None))
            continue
        a, b = np.array(p[i + 1 - w : i + 1]), np.array(v[i + 1 - w : i + 1])
        out.append((a.mean(), a.std(), (a * b).sum() / b.sum() if b.sum() > 0 else None))
    return [list(x) for x in zip(*out, strict=True)]


def test_five_prices(spark):
    t = ticks(spark, [1, 2, 3, 4, 5], [1, 1, 2, 1, 1])
    near(values(windows.rolling_features(t, 3), "mean"), [None, None, 2, 3, 4])
    near([values(windows.rolling_features(t, 3), "std")[2]], [math.sqrt(2 / 3)])
    near(values(scans.with_ema(t, "price", 0.5, "e"), "e")[:3], [1, 1.5, 2.25])
    near([values(windows.rolling_features(t, 2), "vwap")[2]], [8 / 3])


@pytest.mark.parametrize("w", [0, 1, 2, 3, 100, 700])
def test_rolling_is_brute_force(spark, w):
    p, v = walk(600)
    x = windows.rolling_features(ticks(spark, p, v), w)
    for name, want in zip(("mean", "std", "vwap"), brute(p, v, w), strict=True):
        near(values(x, name), want)


def test_std_of_offset_series(spark):
    p, v = walk(1500, offset=1e6)
    near(values(windows.rolling_features(ticks(spark, p, v), 1000), "std"), brute(p, v, 1000)[1], 1e-8)


def test_nan_stays_in_its_windows_and_zero_volume_gives_nothing(spark):
    t = ticks(spark, [1, 2, float("nan"), 4, 5, 6, 7], [0, 0, 0, 0, 1, 0, 0])
    x = windows.rolling_features(t, 2)
    mean = values(x, "mean")
    assert math.isnan(mean[2]) and math.isnan(mean[3]) and mean[4:] == [4.5, 5.5, 6.5]
    assert values(x, "vwap")[1] is None and values(x, "vwap")[5] == 5
    assert values(windows.rolling_features(ticks(spark, []), 3), "mean") == []
    assert math.isnan(values(t.withColumn("m", windows.rolling_mean(F.col("price"), 3, warmup="nan")), "m")[0])
    with pytest.raises(ValueError):
        windows.rolling_mean(F.col("price"), -1)


@pytest.mark.parametrize(("w", "size"), [(20, 64), (3, 7), (1, 5)])
def test_halo_is_the_whole_series(spark, w, size):
    p, v = walk(500)
    both = ticks(spark, p, v).unionByName(ticks(spark, p[:9], v[:9], "b"))
    a, b = windows.halo_rolling(both, w, size), windows.rolling_features(both, w)
    for name in ("mean", "std", "vwap"):
        near(values(a, name), values(b, name))
    assert sorted(r["rn"] for r in windows.row_numbers(both).where("instrument = 'a'").collect()) == list(range(500))
    with pytest.raises(ValueError):
        windows.halo_rolling(both, 100, 10)


def test_online_and_batch_windows(spark):
    p, v = walk(90)
    t = ticks(spark, p, v)
    near(values(t.withColumn("m", windows.online_mean(F.col("price"), 10)), "m"), list(scans.online(p, 10)))
    x = windows.batch_rolling(t, 5, 40)
    want = [m for i in range(0, 90, 40) for m in brute(p[i : i + 40], v[i : i + 40], 5)[0]]
    near(values(x, "mean"), want)


def loop(x, a, y=None):
    out = []
    for v in x:
        y = (v if y is None else a * v + (1 - a) * y)
        out.append(y)
    return out


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), max_size=300), st.floats(0.01, 1.0))
def test_affine_scan_is_the_loop(x, a):
    want = []
    y = 0.0
    for v in x:
        y = a * v + (1 - a) * y
        want.append(y)
    assert np.allclose(scans.affine_scan(np.array(x), a, 0.0), want, rtol=1e-9, atol=1e-6)


def test_ema_forms_agree(spark):
    p, v = walk(300)
    both = ticks(spark, p, v).unionByName(ticks(spark, p[:50], v[:50], "b"))
    want = loop(p, 0.1) + loop(p[:50], 0.1)
    for x in (scans.with_ema(both, "price", 0.1, "e"), scans.with_ema(both, "price", 0.1, "e", size=32), scans.fold_ema(both, "price", 0.1, "e")):
        near(values(x, "e"), want)
    for alpha in (0, -1, 1.5):
        with pytest.raises(ValueError):
            scans.with_ema(both, "price", alpha, "e")


def test_reductions_and_order_statistics(spark):
    p, v = walk(101)
    t = ticks(spark, p, [float(round(x) % 9) for x in v])
    v = values(t, "volume")
    got = reductions.reduce_ticks(t).first()
    near([got["price_sum"], got["price_max"], got["price_dot_volume"]], [sum(p), max(p), float(np.dot(p, v))])
    s = sorted(v)
    o = reductions.order_statistics(t).first()
    assert (o["median_volume"], o["block_threshold"], o["block_days"]) == (s[50], s[90], sum(x >= s[90] for x in v))
    empty = ticks(spark, []).agg(ieee.total(F.col("price")).alias("s"), ieee.largest(F.col("price")).alias("m"), ieee.dot(F.col("price"), F.col("volume")).alias("d")).first()
    assert tuple(empty) == (0.0, float("-inf"), 0.0)
    assert ticks(spark, [1, float("nan"), 0]).agg(ieee.largest(F.col("price")).alias("m")).first()["m"] == 1
    assert values(ticks(spark, [3, 3, 3]).withColumn("z", reductions.zscore(F.col("price"))), "z") == [0, 0, 0]
    z = values(t.withColumn("z", reductions.zscore(F.col("price"))), "z")
    near(z, ((np.array(p) - np.mean(p)) / np.std(p)).tolist())


def histogram(ns, p):
    counts = [0] * 24
    for x in ns:
        b, c = 0, 64
        while b < 23 and x > c:
            b, c = b + 1, c * 2
        counts[b] += 1
    target, seen, c = int(len(ns) * p), 0, 64
    for n in counts:
        seen += n
        if seen >= target:
            return c
        c *= 2
    return c


def test_latency_buckets(spark):
    ns = [1, 63, 64, 65, 128, 129, 5000, 10**6, 2**29, 2**30, 10**12] * 7
    df = spark.createDataFrame([("k", x) for x in ns], "k string, ns bigint")
    got = reductions.latency_percentiles(df, "k", "ns", 0.001, 0.5, 0.9, 0.99).first()
    assert [got[c] for c in ("p0_1", "p50", "p90", "p99")] == [histogram(ns, p) for p in (0.001, 0.5, 0.9, 0.99)]


def test_erf_and_gelu(spark):
    xs = [-7.0, -3.1, -2.0, -1.0, -0.5, -1e-9, 0.0, 1e-300, 0.3, 0.84, 0.85, 1.2, 1.3, 2.5, 2.9, 5.9, 6.5, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ieee.erf(F.col("x")).alias("e"), ieee.gelu(F.col("x")).alias("g"))
    for r in df.collect():
        assert close(r["e"], math.erf(r["x"]), 1e-13) and close(r["g"], 0.5 * r["x"] * (1 + math.erf(r["x"] / math.sqrt(2))), 1e-12)


def test_ieee_division_and_log(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (float("nan"), 0.0), (6.0, 3.0), (None, 1.0)]
    got = [r["q"] for r in spark.createDataFrame(rows, "x double, y double").select(ieee.ieee_div(F.col("x"), F.col("y")).alias("q")).collect()]
    assert got[0] == float("inf") and got[1] == float("-inf") and math.isnan(got[2]) and math.isnan(got[3]) and got[4] == 2 and got[5] is None
    logs = [r["l"] for r in spark.createDataFrame([(0.0,), (-1.0,), (1.0,)], "x double").select(ieee.ieee_log(F.col("x")).alias("l")).collect()]
    assert logs[0] == float("-inf") and math.isnan(logs[1]) and logs[2] == 0
    c = spark.createDataFrame([(float("nan"),), (5.0,), (-5.0,)], "x double").select(ieee.clamp(F.col("x"), -1, 1).alias("c")).collect()
    assert math.isnan(c[0]["c"]) and c[1]["c"] == 1 and c[2]["c"] == -1


def test_tensors(spark):
    df = spark.createDataFrame([(0, [1000.0, 1001.0, 1002.0]), (1, [-1000.0, -999.0, -998.0]), (2, [])], "row_id int, x array<double>")
    soft = {r["row_id"]: r["y"] for r in df.withColumn("y", tensor.softmax(F.col("x"))).collect()}
    assert close(sum(soft[0]), 1, 1e-12) and close(soft[0][2], soft[1][2], 1e-12) and soft[2] == []
    norm = df.where("row_id < 2").withColumn("y", tensor.layernorm(F.col("x"))).collect()
    x = np.array([1000.0, 1001.0, 1002.0])
    near(norm[0]["y"], ((x - x.mean()) / np.sqrt(x.var() + 1e-5)).tolist())
    cells = lambda m: spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "i int, j int, v double")
    product = {(r["i"], r["j"]): r["v"] for r in tensor.matmul(cells([[1, 2], [3, 4]]), cells([[5, 6], [7, 8]])).collect()}
    assert product == {(0, 0): 19, (0, 1): 22, (1, 0): 43, (1, 1): 50}
    two = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    assert two.select(tensor.matmul_rows(F.col("x"), [[5, 6], [7, 8]]).alias("y")).first()["y"] == [19, 22]
    with pytest.raises(Exception, match="differ"):
        two.select(tensor.matmul_rows(F.col("x"), [[5, 6]]).alias("y")).collect()


def sine(spark, n=500):
    p, x = [], 100.0
    for i in range(n):
        x *= 1 + 1e-3 * math.sin(0.01 * i)
        p.append(x)
    return ticks(spark, p, [1 + i % 7 for i in range(n)]), p, [1.0 + i % 7 for i in range(n)]


def test_expressions(spark):
    t, p, v = sine(spark)
    mean, _, vwap = brute(p, v, 50)
    e = loop(p, 0.1)
    less = lambda a, b: [None if x is None else x - y for x, y in zip(a, b, strict=True)]
    want = {
        "price": p,
        "mean(price,50)": mean,
        "mean(price, 5 * 10)": mean,
        "std(price,50)": brute(p, v, 50)[1],
        "ema(price,0.1)": e,
        "vwap(price,volume,50)": vwap,
        "price + 1": [x + 1 for x in p],
        "2 * price": [2 * x for x in p],
        "-price": [-x for x in p],
        "(price + price) / 2": p,
        "1 + 2 * 3": [7.0] * len(p),
        "vwap(price,volume,50) - ema(price,0.1)": less(vwap, e),
        "price - mean(price,50)": [None if m is None else x - m for x, m in zip(p, mean, strict=True)],
        "1.5e1 - -2": [17.0] * len(p),
    }
    for source, expected in want.items():
        near(values(evaluate(t, source), "value"), expected)
    assert values(evaluate(t, "mean(price, 0)"), "value") == [None] * len(p)
    for bad in ("mean(price,-1)", "mean(price,2.5)", "vwap(price,volume,-3)", "mean(price)", "nope(price,1)", "price + )", "price_x", "mean(price + 1, 3)", "1 2", "mean(price, 1/0)", "cost", "ema(price, 2)", "", "mean(price, volume)"):
        with pytest.raises((ExpressionError, ValueError)):
            evaluate(t, bad)


def plain_report(p, v):
    n = len(p)
    r = [math.log(b / a) for a, b in zip(p, p[1:], strict=False)]
    mu, sd = float(np.mean(r)), float(np.std(r))
    s, w, peak, mdd = sorted(v), min(20, n // 2), p[0], 0.0
    for x in p:
        peak = max(peak, x)
        mdd = min(mdd, x / peak - 1)
    up, down = sum(b for a, b in zip(r, v[1:], strict=True) if a > 0), sum(b for a, b in zip(r, v[1:], strict=True) if a < 0)
    pv = sum(a * b for a, b in zip(p[-w:], v[-w:], strict=True))
    return {
        "first": p[0], "last": p[-1], "min": min(p), "max": max(p), "total_return_pct": (p[-1] / p[0] - 1) * 100, "ann_return_pct": mu * 25200, "ann_vol_pct": sd * math.sqrt(252) * 100,
        "sharpe": mu * 252 / (sd * math.sqrt(252)) if sd > 1e-15 else 0.0, "max_drawdown_pct": mdd * 100, "mean_daily_pct": mu * 100, "win_rate": sum(x > 0 for x in r) / (n - 1),
        "best_day_pct": max(r) * 100, "worst_day_pct": min(r) * 100, "avg_volume": sum(v) / n, "median_volume": s[n // 2], "total_volume": sum(v), "block_threshold": s[int(0.9 * (n - 1))],
        "block_days": sum(x >= s[int(0.9 * (n - 1))] for x in v), "dollar_volume": sum(a * b for a, b in zip(p, v, strict=True)), "up_volume_frac": up / (up + down) if up + down else 0.0,
        "obv_last": up - down, "latest_vwap": pv / sum(v[-w:]) if sum(v[-w:]) > 0 else None, "latest_mean": sum(p[-w:]) / w,
    }


@pytest.mark.parametrize("n", [8, 9, 150])
def test_report_metrics(spark, n):
    p, v = walk(n)
    v = [round(x) % 50 for x in v]
    t = ticks(spark, p, v).unionByName(ticks(spark, p[:7], v[:7], "short")).unionByName(ticks(spark, [5] * 10, [0] * 10, "flat"))
    got = {r["instrument"]: r for r in report.analytics(t).collect()}
    assert set(got) == {"a", "flat"}
    for name, want in plain_report(p, v).items():
        near([got["a"][name]], [want])
    flat = got["flat"]
    assert (flat["sharpe"], flat["up_volume_frac"], flat["max_drawdown_pct"], flat["latest_vwap"]) == (0, 0, 0, None)


def test_live_update(spark):
    p, v = walk(40)
    t = ticks(spark, p, v)
    old = report.analytics(t)
    quote = spark.createDataFrame([("a", 123.0, 0.0)], "instrument string, price double, volume double")
    new, was = report.live_update(t, old, quote).first(), old.first()
    want = plain_report([*p[:-1], 123.0], v)
    for name, x in want.items():
        near([new[name]], [was[name] if name in report.NOT_LIVE else x])


def test_search_and_names(spark):
    u = report.instruments(spark)
    hits = [(r["key"], r["rank"]) for r in report.search(u, " TA ").collect()]
    assert hits[0][1] == 1 and {"TATAMOTORS", "TATAPOWER", "TATASTEEL"} <= {k for k, _ in hits}
    assert report.search(u, "").count() == 0 and report.search(u, "zzz").count() == 0
    live = spark.createDataFrame([("aapl", "aapl", "x", "US"), ("ZZ", "ZZ", "zz", "US"), ("ZZ", "ZZ", "zz", "US")], "symbol string, key string, name string, region string")
    assert [r["symbol"] for r in report.search(u, "aapl", live).collect()] == ["AAPL", "ZZ"]
    row = spark.createDataFrame([("^gspc", "tcs.ns", "BTC-USD")], "a string, b string, c string")
    got = row.select(*[f(F.col(c)).alias(f"{c}{k}") for c in "abc" for k, f in enumerate((display.display_key, display.region))]).first()
    assert tuple(got) == ("gspc", "Index", "tcs", "India", "BTC", "Crypto")
    x = spark.createDataFrame([(1234567.0, -0.5, 950.0)], "a double, b double, c double")
    shown = x.select(display.magnitude(F.col("a")), display.percent(F.col("b")), display.latency(F.col("c")), display.price(F.col("a")), display.price(F.col("c"))).first()
    assert tuple(shown) == ("1.2M", "-0.50%", "950 ns", "1,234,567", "950.00")


def test_report_tables(spark):
    p, v = walk(300)
    t = ticks(spark, p, v, "AAPL").unionByName(ticks(spark, p[::-1], v, "TSLA"))
    r = report.analytics(t)
    assert [x["symbol"] for x in report.universe(r, report.instruments(spark)).collect()] == ["AAPL", "TSLA"]
    order = [x["instrument"] for x in report.sort_table(r, "ret").collect()]
    assert order == [x["instrument"] for x in report.sort_table(r, "ret", ascending=True).collect()][::-1]
    assert report.downsample(t).where("instrument = 'AAPL'").count() == 150
    import json

    assert json.loads(report.report_json(r).first()["json"])["stats"]["first"] == r.first()["first"]
    c = spark.createDataFrame([(1, 2.0, None), (2, None, 5.0)], "time bigint, close double, volume double")
    assert [tuple(x) for x in report.candles(c).collect()] == [(1, 2.0, 0.0)]


def test_market_pipeline_is_the_loop(spark):
    p, v = walk(230)
    w, batch = 10, 100
    want = []
    for b in range(0, 230, batch):
        q, u = p[b : b + batch], v[b : b + batch]
        mean, std, vwap = brute(q, u, w)
        e, position, total = loop(q, 0.08), 0.0, 0.0
        for i in range(len(q)):
            s = 0.0
            if i + 1 >= w and std[i] > 1e-12 and vwap[i] is not None:
                z = (q[i] - 0.5 * (mean[i] + vwap[i])) / std[i]
                ret = math.log(q[i] / q[i - 1])
                s = min(1.0, max(-1.0, -0.35 * z + 2000 * ret + 0.05 * (1 if e[i] >= mean[i] else -1)))
            position = min(1.0, max(-1.0, 0.98 * position + 0.02 * s))
            total += position * (i % 17 + 1)
        want.append(total)
    got = pipelines.market_checksums(ticks(spark, p, v), w, batch).orderBy("batch").collect()
    near([r["checksum"] for r in got], want, 1e-9)
    x = pipelines.analytics_chain(ticks(spark, [1, 2, 3, 4]))
    e = loop([1, 2, 3, 4], 0.1)
    z = ((np.array(e) - np.mean(e)) / np.std(e)).tolist()
    near(values(x, "z"), z)
    assert values(x, "signal") == [float(k > 1) for k in z]


def test_registry(spark):
    assert len(KERNELS) == 12 and Engine(spark).kernel("dot").tolerance == 1e-11
    with pytest.raises(KeyError):
        Engine(spark).kernel("nope")
    row = spark.createDataFrame([([0.0, 0.0],)], "x array<double>").select(Engine(spark).row("softmax", "x").alias("y")).first()
    assert row["y"] == [0.5, 0.5]
