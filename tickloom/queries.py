"""Queries over the test tables by name, and DuckDB SQL that gives the same rows.

Floats are rounded on both sides after all comparisons. Ticks are events by type: value is the price, props.k the volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import ticks as T
from tickloom.functions import display
from tickloom.functions.expression import evaluate
from tickloom.functions.ieee import rounded_to
from tickloom.operators import reductions, scans, tensor, windows
from tickloom.plans import pipelines, report
from tickloom.sources import segments
from tickloom.streaming import online

SLIDE = 20
KEYS = ("instrument", "ord")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.event_ticks(spark, sf_dir)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def cells(df: DataFrame, x: str = "y", digits: int = 6) -> DataFrame:
    long = df.select("row_id", F.posexplode(x).alias("j", "v"))
    return T.rounded(long, "v", digits=digits)


def rolling(spark, d):
    x = windows.rolling_features(events(spark, d), SLIDE)
    return T.rounded(x, "mean", "std", "vwap", digits=8).select(*KEYS, "mean", "std", "vwap")


def rolling_one(spark, d):
    """Windows of one row: vwap is null where the volume is 0."""
    x = windows.rolling_features(events(spark, d), 1)
    return T.rounded(x, "mean", "std", "vwap", digits=8).select(*KEYS, "mean", "std", "vwap")


def online_mean(spark, d):
    return T.rounded(events(spark, d).withColumn("mean", windows.online_mean(F.col("price"), 100)), "mean", digits=8).select(*KEYS, "mean")


def batch_rolling(spark, d):
    x = windows.batch_rolling(events(spark, d), SLIDE, 256)
    return T.rounded(x, "mean", "std", "vwap", digits=8).select(*KEYS, "batch", "mean", "std", "vwap")


def halo_rolling(spark, d):
    x = windows.halo_rolling(events(spark, d), SLIDE, 512)
    return T.rounded(x, "mean", "std", "vwap", digits=8).select(*KEYS, "mean", "std", "vwap")


def returns(spark, d):
    x = windows.price_moves(events(spark, d)).withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    return T.rounded(x, "ret", "dd", "obv").select(*KEYS, "ret", "dd", "obv")


def zscores(spark, d):
    return T.rounded(reductions.with_zscore(events(spark, d), "price", "z"), "z").select(*KEYS, "z")


def ema(spark, d):
    return T.rounded(scans.with_ema(events(spark, d), "price", 0.1, "ema"), "ema").select(*KEYS, "ema")


def ema_chunked(spark, d):
    """The same by chunks of 512 rows, whose carries are composed."""
    return T.rounded(scans.with_ema(events(spark, d), "price", 0.1, "ema", size=512), "ema").select(*KEYS, "ema")


def ema_folded(spark, d):
    """The same by one fold for short series: events by user."""
    return T.rounded(scans.fold_ema(T.event_ticks(spark, d, "user_id"), "price", 0.1, "ema"), "ema").select(*KEYS, "ema")


def reduce_ticks(spark, d):
    return T.rounded(reductions.reduce_ticks(events(spark, d)), "price_sum", "price_max", "price_dot_volume", digits=3)


def order_statistics(spark, d):
    return reductions.order_statistics(events(spark, d))


def nearest_rank(spark, d):
    return reductions.nearest_rank(events(spark, d), "instrument", "price", 0.5, 0.99)


def latency_percentiles(spark, d):
    x = events(spark, d).withColumn("ns", F.floor(F.col("price") * 1000))
    return reductions.latency_percentiles(x, "instrument", "ns", 0.5, 0.99, 0.999)


def weighted_checksum(spark, d):
    return T.rounded(reductions.weighted_checksum(events(spark, d), "price"), "checksum", digits=3)


def zone_map(spark, d):
    return reductions.zone_map(T.order_ticks(spark, d), "instrument").withColumns({c: F.col(c).cast("double") for c in ("min_ts_ns", "max_ts_ns")})


def expression_feature(spark, d):
    x = evaluate(events(spark, d), "vwap(price,volume,50) - ema(price,0.1)", "feature")
    x = evaluate(x, "(price - mean(price, 5 * 4)) / std(price, 20)", "score")
    x = evaluate(x, "1 + 2 * 3 - -price / 2", "plain")
    return T.rounded(x, "feature", "score", "plain").select(*KEYS, "feature", "score", "plain")


def softmax(spark, d):
    return cells(matrix(spark, d).withColumn("y", tensor.softmax(F.col("x"))), digits=9)


def layernorm(spark, d):
    return cells(matrix(spark, d).withColumn("y", tensor.layernorm(F.col("x"))))


def gelu(spark, d):
    return cells(matrix(spark, d).withColumn("y", tensor.gelu_row(F.col("x"))), digits=9)


def matmul(spark, d):
    """Gram matrix of the columns: the transpose times the matrix."""
    a = tensor.long_form(matrix(spark, d), "row_id", "x")
    return T.rounded(tensor.matmul(a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), a), "v")


def weights(rows: int = 64, columns: int = 8) -> list[list[float]]:
    return [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(columns)] for i in range(rows)]


def mlp(spark, d):
    return cells(tensor.mlp(matrix(spark, d), "x", weights()), digits=9)


def instrument_report(spark, d):
    x = report.analytics(events(spark, d))
    coarse = ("dollar_volume", "total_volume")
    return T.rounded(T.rounded(x, *[c for c in report.METRICS if c not in coarse]), *coarse, digits=2)


def report_table(spark, d):
    """Reports of short series (events by user), by return."""
    x = report.sort_table(report.analytics(T.event_ticks(spark, d, "user_id")), "ret")
    return T.rounded(x, *report.METRICS, digits=5).select("instrument", "rows", "window", "total_return_pct", "ann_vol_pct", "sharpe", "max_drawdown_pct", "median_volume", "block_days", "latest_vwap", "latest_mean")


def live_update(spark, d):
    """Quotes 10 % above the last price, with volume 50."""
    t = events(spark, d)
    old = report.analytics(t)
    quotes = old.select("instrument", (F.col("last") * 1.1).alias("price"), F.lit(50.0).alias("volume"))
    x = report.live_update(t, old, quotes)
    return T.rounded(x, *report.METRICS, digits=5).select("instrument", "first", "last", "min", "max", "total_return_pct", "ann_return_pct", "win_rate", "median_volume", "obv_last", "latest_mean", "latest_vwap")


def downsample(spark, d):
    return T.rounded(report.downsample(events(spark, d)), "price").select(*KEYS, "price")


def shown_numbers(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    p = F.col("o_totalprice") * 1.000371
    return o.select("o_orderkey", display.percent(p / 1000 - 100).alias("pct"), display.magnitude(p * 1000).alias("big"), display.latency(p).alias("lat"))


def regions(spark, d):
    return report.instruments(spark).select("symbol", display.region(F.col("symbol")).alias("market"), display.display_key(F.col("symbol")).alias("key"))


def search(spark, d):
    found = [report.search(report.instruments(spark), q).withColumn("q", F.lit(q)) for q in ("ta", "s&p", "n", "bitcoin", "zzz")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("q", "symbol", "key", "rank")


def time_range(spark, d):
    """All ticks of the middle half of the span, by bounds that reach the scan."""
    e = spark.read.parquet(f"{d}/events.parquet")
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    span = (last - first) / 4
    inside = e.where((F.col("ts") >= F.lit(first + span)) & (F.col("ts") <= F.lit(last - span)))
    return inside.select("event_id", "event_type", rounded_to(F.col("value"), 6).alias("value"))


def replay_batches(spark, d):
    return T.rounded(segments.replay_batches(events(spark, d), 500), "price_sum", digits=4).select("instrument", "batch", "n", "price_sum")


def channel_trace(spark, d):
    """Each event pushes, every third also stands for a pop before it."""
    t = events(spark, d)
    pushes = t.select(F.col("instrument").alias("channel"), (F.col("ord") * 2 + 1).alias("at"), F.lit("push").alias("op"))
    pops = t.where(F.col("ord") % 3 == 0).select(F.col("instrument").alias("channel"), (F.col("ord") * 2).alias("at"), F.lit("pop").alias("op"))
    return pushes.unionByName(pops)


def channel(spark, d):
    x = online.channel_counters(online.bounded_channel(channel_trace(spark, d), 64))
    return x.select("channel", "accepted", F.col("refused").alias("dropped"), "most")


def blocking(spark, d):
    """The same trace, but a push waits while the queue is full."""
    x = online.blocking_channel(channel_trace(spark, d), 64)
    waiting = x.groupBy(F.col("channel").alias("_of")).agg(F.max("waiting").alias("most_waiting"))
    return online.channel_counters(x).join(waiting, F.col("channel") == F.col("_of")).select("channel", "accepted", F.col("refused").alias("waited"), "depth", "most_waiting")


def gaps(spark, d):
    """Sequence numbers (ids of all events) that each type's stream lacks."""
    x = online.sequence_gaps(events(spark, d).withColumn("sequence", F.col("ord")))
    return x.groupBy("instrument").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum("missing").alias("n_missing"))


def analytics_chain(spark, d):
    return T.rounded(pipelines.analytics_chain(events(spark, d)), "ema", "z").select(*KEYS, "ema", "z", "signal")


def market_pipeline(spark, d):
    x = pipelines.market_checksums(events(spark, d), 20, 1000)
    return T.rounded(x, "checksum", digits=5)


QUERIES = {
    "market_pipeline": market_pipeline,
    "rolling_features": rolling,
    "rolling_one_row": rolling_one,
    "rolling_online_mean": online_mean,
    "rolling_by_batch": batch_rolling,
    "rolling_halo": halo_rolling,
    "returns_drawdown_obv": returns,
    "zscore": zscores,
    "ema": ema,
    "ema_chunked": ema_chunked,
    "ema_folded": ema_folded,
    "reduce_sum_max_dot": reduce_ticks,
    "order_statistics": order_statistics,
    "nearest_rank": nearest_rank,
    "latency_percentiles": latency_percentiles,
    "weighted_checksum": weighted_checksum,
    "zone_map": zone_map,
    "expression_feature": expression_feature,
    "softmax": softmax,
    "layernorm": layernorm,
    "gelu": gelu,
    "matmul": matmul,
    "mlp": mlp,
    "instrument_report": instrument_report,
    "report_table": report_table,
    "live_update": live_update,
    "downsample": downsample,
    "shown_numbers": shown_numbers,
    "regions": regions,
    "search": search,
    "time_range": time_range,
    "replay_batches": replay_batches,
    "bounded_channel": channel,
    "blocking_channel": blocking,
    "sequence_gaps": gaps,
    "analytics_chain": analytics_chain,
}
