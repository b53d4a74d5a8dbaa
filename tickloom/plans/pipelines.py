"""End-to-end plans: the market pipeline from ticks to a risk checksum, and the short analytics chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.ieee import clamp
from tickloom.operators import scans, windows
from tickloom.operators.reductions import with_zscore


def fair_signal(w: int, place: Column) -> Column:
    """Wanted exposure from price against (mean + vwap) / 2, momentum and trend; 0 before the window is full or without spread or volume."""
    z = F.try_divide(F.col("price") - 0.5 * (F.col("mean") + F.col("vwap")), F.col("std"))
    trend = F.when(~F.isnan("ema") & (F.col("ema") >= F.col("mean")), 1.0).otherwise(-1.0)
    ready = (place >= w) & ~F.isnan("std") & (F.col("std") > 1e-12) & F.col("vwap").isNotNull()
    return F.when(ready, clamp(-0.35 * z + 2000.0 * F.col("ret") + 0.05 * trend, -1.0, 1.0)).otherwise(0.0)


def market_features(ticks: DataFrame, w: int = 128, batch: int = 65_536) -> DataFrame:
    """Returns, mean, std, vwap, ema, signal and exposure; all state begins anew with each batch of an instrument's rows."""
    numbered = windows.row_numbers(ticks, "_tl_rn")
    x = numbered.withColumn("batch", F.floor(F.col("_tl_rn") / batch)).withColumn("place", F.col("_tl_rn") % batch + 1).drop("_tl_rn")
    x = x.withColumn("ret", windows.log_return(F.col("price"), "batch"))
    x = windows.rolling_features(x, w, "batch")
    x = scans.batch_scan(x, {"ema": ("price", 0.08, "value")})
    x = x.withColumn("signal", fair_signal(w, F.col("place")))
    # The exposure is an exponential average of signals within [-1, 1], so its clamp never binds.
    return scans.batch_scan(x, {"exposure": ("signal", 0.02, "zero")})


def market_checksums(ticks: DataFrame, w: int = 128, batch: int = 65_536) -> DataFrame:
    """Rows and checksum of exposure per instrument and batch."""
    x = market_features(ticks, w, batch)
    weight = (F.col("place") - 1) % 17 + 1
    return x.groupBy("instrument", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("exposure") * weight).alias("checksum"))


def analytics_chain(ticks: DataFrame, alpha: float = 0.1, threshold: float = 1.0) -> DataFrame:
    """Exponential average, its z-score, and a signal where that is high."""
    x = with_zscore(scans.with_ema(ticks, "price", alpha, "ema"), "ema", "z")
    return x.withColumn("signal", windows.signal(F.col("z"), threshold))
