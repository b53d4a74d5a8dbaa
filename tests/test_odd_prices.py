"""Queries against their SQL on prices of 0, below 0, NaN and infinite, and on series that don't move."""

import json
import math
from decimal import Decimal

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tickloom.operators import tensor, windows
from tickloom.oracles import ORACLES
from tickloom.plans import report
from tickloom.queries import QUERIES
from tickloom.ticks import TICK_SCHEMA, rounded

KINDS = ("zero", "minus", "nan", "inf", "plain", "flat")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder, r, n = tmp_path_factory.mktemp("odd"), np.random.default_rng(3), 240
    kind, i = np.array(KINDS)[np.arange(n) % 6], np.arange(n) // 6
    p = np.round(np.exp(r.normal(3, 0.5, n)), 2)
    p[(kind == "zero") & ((i % 7 == 3) | (i == 0))] = 0
    p[(kind == "minus") & (i % 9 == 4)] *= -1
    p[(kind == "nan") & (i % 11 == 5)] = np.nan
    p[(kind == "inf") & (i == 17)] = np.inf
    p[kind == "flat"] = 4.0
    when = (np.datetime64("2024-01-01") + np.arange(n).astype("timedelta64[s]")).astype("datetime64[us]")
    rows = {"event_id": np.arange(n), "ts": when, "user_id": np.arange(n) % 3, "event_type": kind, "value": p, "props": [json.dumps({"k": int(k)}) for k in r.integers(0, 100, n)]}
    pq.write_table(pa.table({k: pa.array(v) for k, v in rows.items()}), folder / "events.parquet")  # NaN stays NaN
    return str(folder)


def shown(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.6g}"
    return str(v)


@pytest.mark.parametrize("name", ["rolling_features", "returns_drawdown_obv", "zscore", "instrument_report", "live_update", "market_pipeline", "analytics_chain"])
def test_query_is_its_sql(spark, odd, name):
    found = QUERIES[name](spark, odd)
    columns = sorted(found.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{odd}/events.parquet'")
    want = con.sql(ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(shown(r[k]) for k in at) for r in want.fetchall())


def test_live_update_without_a_move_keeps_the_up_share(spark):
    rows = [("a", i, 1000 + i, 10.0 if i < 11 else 12.0, 3.0) for i in range(12)]
    t = spark.createDataFrame(rows, TICK_SCHEMA)
    old = report.analytics(t)
    flat = spark.createDataFrame([("a", 10.0, 0.0)], "instrument string, price double, volume double")
    new = report.live_update(t, old, flat).first()
    assert old.first()["up_volume_frac"] == 1.0 and new["up_volume_frac"] == 1.0 and new["last"] == 10.0 and new["ann_vol_pct"] == 0.0


def test_json_with_series(spark):
    rows = [("a", i, 1000 + i, 100.0 + i / 7, 2.0) for i in range(300)]
    t = spark.createDataFrame(rows, TICK_SCHEMA)
    found = report.analytics(t)
    got = json.loads(report.report_json(found, report.series(t, found), significant=6).first()["json"])
    assert got["rows"] == 300 and got["window"] == 20 and len(got["price"]) == len(got["mean"]) == len(got["volume"]) == 150
    assert got["price"][:3] == [100.0, 100.286, 100.571] and got["mean"][:10] == [None] * 10
    assert got["mean"][10] == pytest.approx(np.mean([100 + i / 7 for i in range(1, 21)]), rel=1e-5) and got["stats"]["last"] == 142.714


def test_layernorm_of_an_empty_row(spark):
    x = spark.createDataFrame([(0, []), (1, [1.0, 3.0])], "row_id int, x array<double>")
    got = {r["row_id"]: r["y"] for r in x.select("row_id", tensor.layernorm(F.col("x")).alias("y")).collect()}
    assert got[0] == [] and got[1] == pytest.approx([-1, 1], abs=1e-4)


@pytest.mark.parametrize("name", ["returns_drawdown_obv", "instrument_report", "time_range"])
def test_ties_are_rounded_as_in_sql(spark, tmp_path, name):
    """Falls from 800.00 and 512.00 have halves at the seventh decimal, values at the seventh too."""
    r, n = np.random.default_rng(1), 4000
    kind = np.array(["a", "b", "c"])[np.arange(n) % 3]
    p = np.round(r.uniform(0, 500, n), 2)
    p[:2] = 800.0, 512.0
    p[kind == "c"] = r.integers(0, 10**6, (kind == "c").sum()) / 10**6 + 5e-7
    when = (np.datetime64("2024-01-01") + np.arange(n).astype("timedelta64[s]")).astype("datetime64[us]")
    rows = {"event_id": np.arange(n), "ts": when, "user_id": np.arange(n) % 3, "event_type": kind, "value": p, "props": ['{"k": 3}' if i % 5 else "{}" for i in range(n)]}
    pq.write_table(pa.table(rows), tmp_path / "events.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    columns = sorted(c for c in found.columns if name != "instrument_report" or c in ("instrument", "rows", "max_drawdown_pct", "first", "last", "min", "max"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(str(r[k]) for k in at) for r in want.fetchall())


def test_rounding_of_odd_numbers(spark):
    xs = [0.49999999999999994, 2.5e-6, -2.5e-6, 0.1234565, -0.8765434999999999, 1e300, -1e306, 4503599627.3704965, float("inf"), -float("inf"), 0.0, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r["x"] for r in rounded(df, "x").orderBy("i").collect()]
    con = duckdb.connect()
    assert got == [con.execute("SELECT round(?::DOUBLE, 6) + 0.0", [x]).fetchone()[0] for x in xs]
    assert rounded(spark.createDataFrame([(float("nan"),)], "x double"), "x").first()["x"] is None


def test_obv_goes_on_where_a_chunk_begins_without_volume(spark):
    volume = [None, 2.0, 3.0, 4.0, None, None, 7.0, 8.0, None, None, None, None, None]
    rows = [(k, i, 1000 + i, 10.0 + i, v if k == "a" else None) for k in "ab" for i, v in enumerate(volume)]
    got = {(r["instrument"], r["ord"]): r["obv"] for r in windows.price_moves(spark.createDataFrame(rows, TICK_SCHEMA), size=4).collect()}
    assert [got["a", i] for i in range(13)] == [None, 2, 5, 9, 9, 9, 16, 24, 24, 24, 24, 24, 24] and {got["b", i] for i in range(13)} == {None}


def test_price_moves_of_tied_ticks_follow_one_order(spark, monkeypatch):
    """Rows of a chunk come in any order where several executors send them; ticks that tie keep their places nevertheless."""
    plain = windows.chunked
    monkeypatch.setattr(windows, "chunked", lambda *a: plain(*a).repartition(5, F.rand(1)).sortWithinPartitions(F.rand(2)))
    rows = [("a", 1, 5, float(p), 1.0) for p in np.random.default_rng(2).permutation(np.arange(1, 401))]
    got = sorted(((r["_tl_rn"], r["price"], r["ret"], r["obv"], r["dd"]) for r in windows.price_moves(spark.createDataFrame(rows, TICK_SCHEMA), size=64).collect()), key=lambda x: x[0])
    obv = high = 0.0
    for i, (rn, price, ret, found, dd) in enumerate(got):
        before = got[i - 1][1] if i else price
        obv, high = obv + np.sign(price - before), max(high, price)
        assert rn == i and (ret or 0.0) == pytest.approx(math.log(price / before)) and found == obv and dd == price / high - 1
