"""The per-instrument report: 23 metrics of price, return, risk and volume, its live update, and the tables built on it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.display import display_key, region
from tickloom.functions.ieee import NAN, ieee_div, largest, smallest, total
from tickloom.operators.reductions import order_statistics
from tickloom.operators.windows import price_moves, rolling_features, row_numbers
from tickloom.ticks import ORDER

YEAR = 252.0
LEAST_ROWS = 8
METRICS = (
    "first last min max total_return_pct ann_return_pct ann_vol_pct sharpe max_drawdown_pct mean_daily_pct win_rate best_day_pct worst_day_pct avg_volume median_volume"
    " total_volume block_threshold block_days dollar_volume up_volume_frac obv_last latest_vwap latest_mean"
).split()
#: What a live update leaves as it was.
NOT_LIVE = ("median_volume", "total_volume", "avg_volume", "block_threshold", "block_days", "obv_last")


def candles(df: DataFrame) -> DataFrame:
    """Provider rows made regular: no close, no row; no volume counts as 0."""
    return df.where(F.col("close").isNotNull()).withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def _unless_first(first: Column, value: Column) -> Column:
    """The value, but NaN where the series begins with NaN."""
    return F.when(F.isnan(first), F.lit(NAN)).otherwise(value)


def _metrics(ticks: DataFrame, longest: int) -> DataFrame:
    """All metrics, and _moved: the volume of the rows whose price moved. NaN is neither up nor down, nor an extreme."""
    p, v, r = F.col("price"), F.col("volume"), F.col("ret")
    counts = ticks.groupBy(F.col("instrument").alias("_of")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ROWS)
    x = price_moves(ticks.select("instrument", *ORDER, "price", "volume")).join(counts, F.col("instrument").eqNullSafe(F.col("_of"))).drop("_of")
    x = x.withColumn("w", F.least(F.lit(longest), F.floor(F.col("n") / 2)))
    key, late = F.struct(*ORDER), F.col("n") - F.col("_tl_rn") <= F.col("w")
    known = ~F.isnan(r)
    up, down = F.sum(F.when(known & (r > 0), v).otherwise(0.0)), F.sum(F.when(known & (r < 0), v).otherwise(0.0))
    sums = x.groupBy("instrument").agg(
        F.max("n").alias("rows"),
        F.max("w").alias("window"),
        F.min_by(p, key).alias("first"),
        F.max_by(p, key).alias("last"),
        smallest(p).alias("_min"),
        largest(p).alias("_max"),
        F.avg(r).alias("_mu"),
        F.stddev_pop(r).alias("_sd"),
        F.least(smallest(F.col("dd")), F.lit(0.0)).alias("_mdd"),
        F.count_if(known & (r > 0)).alias("_up"),
        F.max(F.when(known, r)).alias("_best"),
        F.min(F.when(known, r)).alias("_worst"),
        total(v).alias("total_volume"),
        total(p * v).alias("dollar_volume"),
        up.alias("_upv"),
        down.alias("_downv"),
        F.avg(F.when(late, p)).alias("latest_mean"),
        F.sum(F.when(late, p * v)).alias("_pv"),
        F.sum(F.when(late, v)).alias("_v"),
    )
    # The deviation of equal returns is noise of rounding, not risk; without a finite one there is no telling.
    sd = F.when(~F.isnan("_sd") & (F.col("_sd") > 1e-15), F.col("_sd")).otherwise(0.0)
    both = F.col("_upv") + F.col("_downv")
    out = sums.join(order_statistics(ticks), "instrument")
    derived = {
        "min": _unless_first(F.col("first"), F.col("_min")),
        "max": _unless_first(F.col("first"), F.col("_max")),
        "total_return_pct": (ieee_div(F.col("last"), F.col("first")) - 1) * 100,
        "ann_return_pct": F.col("_mu") * YEAR * 100,
        "ann_vol_pct": sd * math.sqrt(YEAR) * 100,
        "sharpe": F.when(sd > 0, F.col("_mu") * YEAR / (F.nullif(sd, F.lit(0.0)) * math.sqrt(YEAR))).otherwise(0.0),
        "max_drawdown_pct": F.col("_mdd") * 100,
        "mean_daily_pct": F.col("_mu") * 100,
        "win_rate": F.col("_up") / (F.col("rows") - 1),
        "best_day_pct": F.col("_best") * 100,
        "worst_day_pct": F.col("_worst") * 100,
        "avg_volume": F.col("total_volume") / F.col("rows"),
        "up_volume_frac": F.when(both > 0, F.col("_upv") / F.nullif(both, F.lit(0.0))).otherwise(0.0),
        "obv_last": F.col("_upv") - F.col("_downv"),
        "latest_vwap": F.when(F.col("_v") > 0, F.col("_pv") / F.nullif(F.col("_v"), F.lit(0.0))),
        "_moved": both,
    }
    return out.withColumns(derived).select("instrument", "rows", "window", *METRICS, "_moved")


def analytics(ticks: DataFrame, longest: int = 20) -> DataFrame:
    """One row per instrument with at least LEAST_ROWS ticks. The window of the latest mean and vwap is min(longest, n div 2)."""
    return _metrics(ticks, longest).drop("_moved")


def live_update(ticks: DataFrame, report: DataFrame, quotes: DataFrame, longest: int = 20) -> DataFrame:
    """The report after quotes (instrument, price, volume) have replaced the last close, and the last volume where it is above 0.

    Metrics in NOT_LIVE keep their values, the up share too where nothing moved; without volume the latest vwap is the price.
    """
    q = quotes.select("instrument", F.col("price").alias("_price"), F.col("volume").alias("_volume"))
    ends = ticks.groupBy("instrument").agg(F.max(F.struct(*ORDER)).alias("_end"))
    patched = ticks.select("instrument", *ORDER, "price", "volume").join(ends.join(q, "instrument"), "instrument")
    last = F.struct(*ORDER) == F.col("_end")
    patched = patched.withColumn("price", F.when(last, F.col("_price")).otherwise(F.col("price")))
    patched = patched.withColumn("volume", F.when(last & (F.col("_volume") > 0), F.col("_volume")).otherwise(F.col("volume"))).drop("_end", "_price", "_volume")
    old = report.select("instrument", *[F.col(c).alias(f"_{c}") for c in (*NOT_LIVE, "up_volume_frac")])
    x = _metrics(patched, longest).join(old, "instrument").join(q, "instrument")
    x = x.withColumns({c: F.col(f"_{c}") for c in NOT_LIVE})
    x = x.withColumn("up_volume_frac", F.when(F.col("_moved") > 0, F.col("up_volume_frac")).otherwise(F.col("_up_volume_frac")))
    x = x.withColumn("latest_vwap", F.coalesce("latest_vwap", "_price"))
    return x.select("instrument", "rows", "window", *METRICS)


# The instruments listed (symbol, name, sector, region, aliases).
LISTED = (
    ("AAPL", "Apple", "Technology", "US", ["apple"]),
    ("MSFT", "Microsoft", "Technology", "US", ["microsoft"]),
    ("NVDA", "NVIDIA", "Semiconductors", "US", ["nvidia"]),
    ("AMZN", "Amazon", "Consumer", "US", ["amazon"]),
    ("GOOGL", "Alphabet", "Technology", "US", ["google", "alphabet"]),
    ("META", "Meta Platforms", "Technology", "US", ["meta", "facebook"]),
    ("TSLA", "Tesla", "Automotive", "US", ["tesla"]),
    ("AMD", "AMD", "Semiconductors", "US", ["amd"]),
    ("AVGO", "Broadcom", "Semiconductors", "US", ["broadcom"]),
    ("NFLX", "Netflix", "Media", "US", ["netflix"]),
    ("JPM", "JPMorgan Chase", "Financials", "US", ["jpmorgan", "chase"]),
    ("INTC", "Intel", "Semiconductors", "US", ["intel"]),
    ("PLTR", "Palantir", "Technology", "US", ["palantir"]),
    ("COIN", "Coinbase", "Financials", "US", ["coinbase"]),
    ("ORCL", "Oracle", "Technology", "US", ["oracle"]),
    ("CRM", "Salesforce", "Technology", "US", ["salesforce"]),
    ("UBER", "Uber", "Technology", "US", ["uber"]),
    ("XOM", "Exxon Mobil", "Energy", "US", ["exxon"]),
    ("SPY", "S&P 500 ETF", "Index", "US", ["sp500", "s&p", "spy"]),
    ("QQQ", "Nasdaq-100 ETF", "Index", "US", ["nasdaq", "qqq"]),
    ("^GSPC", "S&P 500", "Index", "US", ["s&p 500", "spx"]),
    ("^IXIC", "Nasdaq Composite", "Index", "US", ["nasdaq composite"]),
    ("^DJI", "Dow Jones", "Index", "US", ["dow", "dow jones"]),
    ("^NSEI", "Nifty 50", "Index", "India", ["nifty", "nifty 50"]),
    ("^BSESN", "BSE Sensex", "Index", "India", ["sensex", "bse"]),
    ("TATAMOTORS.NS", "Tata Motors", "Automotive", "India", ["tata motors", "tata"]),
    ("TATAPOWER.NS", "Tata Power", "Energy", "India", ["tata power", "tata"]),
    ("TCS.NS", "Tata Consultancy", "Technology", "India", ["tcs", "tata"]),
    ("TATASTEEL.NS", "Tata Steel", "Materials", "India", ["tata steel", "tata"]),
    ("RELIANCE.NS", "Reliance Industries", "Energy", "India", ["reliance"]),
    ("INFY.NS", "Infosys", "Technology", "India", ["infosys"]),
    ("HDFCBANK.NS", "HDFC Bank", "Financials", "India", ["hdfc"]),
    ("WIPRO.NS", "Wipro", "Technology", "India", ["wipro"]),
    ("ADANIENT.NS", "Adani Enterprises", "Industrials", "India", ["adani"]),
    ("BTC-USD", "Bitcoin", "Crypto", "Global", ["bitcoin", "btc"]),
    ("ETH-USD", "Ethereum", "Crypto", "Global", ["ethereum", "eth"]),
    ("SOL-USD", "Solana", "Crypto", "Global", ["solana", "sol"]),
)


def instruments(spark: SparkSession, listed: tuple = LISTED) -> DataFrame:
    rows = [(k, *x) for k, x in enumerate(listed)]
    return spark.createDataFrame(rows, "ordinal int, symbol string, name string, sector string, region string, aliases array<string>")


def search(listed: DataFrame, query: str, live: DataFrame | None = None, most: int = 10) -> DataFrame:
    """Ranked hits: key, key's head, name's head, an alias' head, anywhere; then live hits (symbol, key, name, region) that aren't among them."""
    q = query.strip().lower()
    key, name = F.lower(display_key(F.col("symbol"))), F.lower("name")
    rank = (
        F.when(key == q, 0)
        .when(key.startswith(q), 1)
        .when(name.startswith(q), 2)
        .when(F.exists("aliases", lambda a: a.startswith(q)), 3)
        .when(key.contains(q) | name.contains(q) | F.exists("aliases", lambda a: a.contains(q)), 4)
    )
    hits = listed.select("symbol", display_key(F.col("symbol")).alias("key"), "name", "region", rank.alias("rank")).where(F.col("rank").isNotNull() & F.lit(q != ""))
    if live is not None:
        more = live.select("symbol", "key", "name", "region", F.lit(5).alias("rank")).join(hits.select(F.upper("symbol").alias("_s")), F.upper("symbol") == F.col("_s"), "left_anti")
        hits = hits.unionByName(more.dropDuplicates(["symbol"]))
    return hits.orderBy("rank", F.lower("key"), "symbol").limit(most)


def universe(report: DataFrame, listed: DataFrame) -> DataFrame:
    """Reports of listed instruments in the order of the list; those without a report are left out."""
    return listed.join(report, listed.symbol == report.instrument).drop("instrument", "aliases").withColumn("key", display_key(F.col("symbol"))).withColumn("market", region(F.col("symbol"))).orderBy("ordinal")


SORT_KEYS = {"sym": "instrument", "last": "last", "ret": "total_return_pct", "ann": "ann_return_pct", "vol": "ann_vol_pct", "shp": "sharpe", "dd": "max_drawdown_pct", "dv": "dollar_volume", "blk": "block_days", "lat": "latency_ns"}


def sort_table(report: DataFrame, key: str = "ret", ascending: bool = False) -> DataFrame:
    c = F.col(SORT_KEYS[key])
    return report.orderBy(c.asc() if ascending else c.desc(), "instrument")


def downsample(ticks: DataFrame, points: int = 120) -> DataFrame:
    """Every max(1, n div points)-th tick of each instrument, from the first."""
    x = row_numbers(ticks)
    strides = x.groupBy(F.col("instrument").alias("_of")).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / points)).alias("_stride"))
    return x.join(strides, F.col("instrument").eqNullSafe(F.col("_of"))).where(F.col("rn") % F.col("_stride") == 0).drop("_of", "_stride", "rn")


def series(ticks: DataFrame, report: DataFrame, points: int = 120) -> DataFrame:
    """Per instrument of the report its down-sampled price, rolling mean and vwap (null before the window is full) and volume: every max(1, rows div points)-th value, as arrays.

    The window is the report's. Only the rows that are kept are gathered, fewer than 2 * points an instrument.
    """
    sizes = report.select(F.col("instrument").alias("_of"), F.col("window").cast("int").alias("_w"), F.greatest(F.lit(1), F.floor(F.col("rows") / points)).alias("_stride"))
    out = None
    for row in sizes.select("_w").distinct().collect():  # one window size, or a few
        some = sizes.where(F.col("_w") == row["_w"])
        x = rolling_features(ticks.join(some, F.col("instrument").eqNullSafe(F.col("_of")), "left_semi"), row["_w"])
        x = row_numbers(x, "_tl_rn").join(some, F.col("instrument").eqNullSafe(F.col("_of"))).where(F.col("_tl_rn") % F.col("_stride") == 0)
        x = x.groupBy("instrument").agg(F.sort_array(F.collect_list(F.struct("_tl_rn", "price", "mean", "vwap", "volume"))).alias("_all"))
        x = x.select("instrument", *[F.col(f"_all.{c}").alias(c) for c in ("price", "mean", "vwap", "volume")])
        out = x if out is None else out.unionByName(x)
    return out


def json_number(x: Column, significant: int | None = None) -> Column:
    """The number, or with so many significant digits (6: as C prints it with %.6g); null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.format_string(f"%.{significant - 1}e", x).cast("double") if significant else x)


def report_json(report: DataFrame, drawn: DataFrame | None = None, significant: int | None = None) -> DataFrame:
    """One JSON object per instrument; NaN and infinities as null. drawn: the result of series(), whose arrays are added."""
    stats = F.struct(*[(F.col(c) if c == "block_days" else json_number(F.col(c).cast("double"), significant)).alias(c) for c in METRICS])
    parts = [F.col("instrument").alias("ticker"), "rows", "window", stats.alias("stats")]
    if drawn is not None:
        names = ("price", "mean", "vwap", "volume")
        report = report.join(drawn.select(F.col("instrument").alias("_of"), *[F.col(c).alias(f"_{c}") for c in names]), F.col("instrument").eqNullSafe(F.col("_of")), "left")
        parts += [F.transform(f"_{c}", lambda x: json_number(x, significant)).alias(c) for c in names]
    return report.select("instrument", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("json"))
