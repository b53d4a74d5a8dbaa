"""Trailing row windows. All variants of one feature share one Window spec, so Spark plans one WindowExec for them.

A window that isn't full gives null (warmup="nan": NaN); w = 0 gives nothing but that. NaN inside a window makes that window NaN and no other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.ieee import INF, ieee_div, ieee_log
from tickloom.lineage import saved
from tickloom.ticks import ORDER, in_order, trailing, warm


def _none(warmup: str) -> Column:
    return F.lit(None).cast("double") if warmup == "null" else F.lit(float("nan"))


def _over(w: int, keys: tuple, value: Callable, warmup: str) -> Column:
    if w < 0:
        raise ValueError("a window can't be negative")
    if w == 0:
        return _none(warmup)
    spec = trailing(w, *keys)
    return warm(value(spec), F.count(F.lit(1)).over(spec), w, warmup)


def rolling_mean(x: Column, w: int, *keys: str, warmup: str = "null") -> Column:
    return _over(w, keys, lambda s: F.avg(x).over(s), warmup)


def rolling_std(x: Column, w: int, *keys: str, warmup: str = "null") -> Column:
    """Population deviation, from centred moments."""
    return _over(w, keys, lambda s: F.stddev_pop(x).over(s), warmup)


def rolling_vwap(price: Column, volume: Column, w: int, *keys: str, warmup: str = "null") -> Column:
    """Volume-weighted mean price; nothing unless the volumes add up to more than 0."""
    weight = lambda s: F.sum(volume).over(s)
    return _over(w, keys, lambda s: F.when(weight(s) > 0, F.try_divide(F.sum(price * volume).over(s), weight(s))).otherwise(_none(warmup)), warmup)


def rolling_sum(x: Column, w: int, *keys: str, warmup: str = "null") -> Column:
    return _over(w, keys, lambda s: F.sum(x).over(s), warmup)


def online_mean(x: Column, w: int, *keys: str) -> Column:
    """Mean of the last w rows, or of as many as there are."""
    return F.avg(x).over(trailing(w, *keys))


def log_return(price: Column, *keys: str) -> Column:
    """log(p / previous p), by IEEE rules; the first row has 0."""
    return F.coalesce(ieee_log(ieee_div(price, F.lag(price).over(in_order(*keys)))), F.lit(0.0))


def running_max(x: Column, *keys: str) -> Column:
    """The largest value so far; NaN is passed over."""
    return F.max(F.nanvl(x, F.lit(-INF))).over(in_order(*keys).rowsBetween(W.unboundedPreceding, 0))


def drawdown(price: Column, *keys: str) -> Column:
    return ieee_div(price, running_max(price, *keys)) - 1.0


def signed_volume(price: Column, before: Column, volume: Column) -> Column:
    """The volume, signed by the move of the price; 0 without a move, or where there is no telling."""
    move = F.signum(price - before)
    return F.nanvl(F.coalesce(move, F.lit(0.0)), F.lit(0.0)) * volume


def on_balance_volume(price: Column, volume: Column, *keys: str) -> Column:
    """Running sum of the signed volume."""
    return F.sum(signed_volume(price, F.lag(price).over(in_order(*keys)), volume)).over(in_order(*keys).rowsBetween(W.unboundedPreceding, 0))


def rolling_features(ticks: DataFrame, w: int, *keys: str) -> DataFrame:
    """mean, std and vwap in one pass."""
    p, v = F.col("price"), F.col("volume")
    return ticks.withColumns({"mean": rolling_mean(p, w, *keys), "std": rolling_std(p, w, *keys), "vwap": rolling_vwap(p, v, w, *keys)})


#: Rows of a chunk of a long series.
CHUNK = 65_536


def row_numbers(ticks: DataFrame, name: str = "rn") -> DataFrame:
    """Each tick's place in its instrument from 0, without moving an instrument to one task. Column names that begin with _tl_ are this module's own.

    Rows are dealt by ranges of (instrument, order) and written; a range's rows of an instrument start after those of the ranges before it.
    """
    n = int(ticks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ticks.repartitionByRange(n, "instrument", *ORDER).sortWithinPartitions("instrument", *ORDER)
    rows = saved(dealt.withColumn("_tl_id", F.monotonically_increasing_id()).withColumn("_tl_part", F.shiftrightunsigned("_tl_id", 33)), "ranges")
    counts = rows.groupBy("instrument", "_tl_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_tl_id").alias("_first"))
    before = F.sum("_n").over(W.partitionBy("instrument").orderBy("_tl_part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(F.col("instrument").alias("_tl_i"), F.col("_tl_part").alias("_tl_p"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_tl_shift"))
    joined = rows.join(starts, F.col("instrument").eqNullSafe(F.col("_tl_i")) & (F.col("_tl_part") == F.col("_tl_p")))
    return joined.withColumn(name, F.col("_tl_id") + F.col("_tl_shift")).drop("_tl_id", "_tl_part", "_tl_i", "_tl_p", "_tl_shift")


def chunked(ticks: DataFrame, halo: int, size: int) -> DataFrame:
    """ticks with their place _tl_rn, in chunks _tl_chunk of `size` rows that also hold the last `halo` rows of the chunk before; a row's own chunk is _tl_own."""
    if size < halo:
        raise ValueError("a chunk must hold a window's history")
    numbered = row_numbers(ticks, "_tl_rn")
    own = F.floor(F.col("_tl_rn") / size)
    late = F.col("_tl_rn") % size >= size - halo
    chunks = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    return numbered.withColumn("_tl_own", own).withColumn("_tl_chunk", F.explode(chunks))


def halo_rolling(ticks: DataFrame, w: int, size: int = CHUNK) -> DataFrame:
    """rolling_features of long series, by chunks with the last w - 1 rows of the one before."""
    x = chunked(ticks, max(w - 1, 0), size)
    return rolling_features(x, w, "_tl_chunk").where("_tl_chunk = _tl_own").drop("_tl_chunk", "_tl_own", "_tl_rn")


def price_moves(ticks: DataFrame, size: int = CHUNK) -> DataFrame:
    """ret (log return; null in the first row), dd (fall from the largest price so far), obv (running signed volume) and the place _tl_rn, for series of any length.

    Chunks are worked on side by side; a chunk's largest price and its signed volume are carried to the later ones, one row per chunk.
    """
    o = W.partitionBy("instrument", "_tl_chunk").orderBy("_tl_rn")
    so_far = o.rowsBetween(W.unboundedPreceding, 0)
    p = F.col("price")
    x = chunked(ticks, 1, size).withColumn("_tl_before", F.lag(p).over(o)).where("_tl_chunk = _tl_own")
    x = x.withColumn("_tl_flow", signed_volume(p, F.col("_tl_before"), F.col("volume"))).withColumn("_tl_high", F.nanvl(p, F.lit(-INF)))
    ends = x.groupBy("instrument", "_tl_own").agg(F.max("_tl_high").alias("_tl_top"), F.sum("_tl_flow").alias("_tl_sum"))
    before = W.partitionBy("instrument").orderBy("_tl_own").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(F.col("instrument").alias("_tl_i"), F.col("_tl_own").alias("_tl_c"), F.max("_tl_top").over(before).alias("_tl_top"), F.sum("_tl_sum").over(before).alias("_tl_sum"))
    x = x.withColumn("_tl_high", F.max("_tl_high").over(so_far)).withColumn("_tl_flow", F.sum("_tl_flow").over(so_far))
    x = x.join(ends, F.col("instrument").eqNullSafe(F.col("_tl_i")) & (F.col("_tl_own") == F.col("_tl_c")))
    ret = ieee_log(ieee_div(p, F.col("_tl_before")))
    out = x.withColumns({"ret": ret, "dd": ieee_div(p, F.greatest("_tl_high", "_tl_top")) - 1.0, "obv": F.coalesce(F.col("_tl_flow") + F.col("_tl_sum"), "_tl_flow", "_tl_sum")})
    return out.drop("_tl_chunk", "_tl_own", "_tl_before", "_tl_flow", "_tl_high", "_tl_i", "_tl_c", "_tl_top", "_tl_sum")


def batch_rolling(ticks: DataFrame, w: int, batch: int) -> DataFrame:
    """rolling_features that begin anew with every batch of rows."""
    numbered = row_numbers(ticks, "_tl_rn").withColumn("batch", F.floor(F.col("_tl_rn") / batch))
    return rolling_features(numbered, w, "batch").drop("_tl_rn")


def signal(z: Column, threshold: float = 1.0) -> Column:
    """1 above the threshold; NaN is not above it."""
    return F.when(~F.isnan(z) & (z > threshold), 1.0).otherwise(0.0)
