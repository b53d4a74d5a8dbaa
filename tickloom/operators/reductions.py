"""Reductions per instrument: sums, order statistics by exact index, z-scores, checksums and histogram percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.ieee import dot, largest, smallest, total
from tickloom.operators.windows import row_numbers


def reduce_ticks(ticks: DataFrame) -> DataFrame:
    """sum, max and dot, with the conventions for empty input and NaN."""
    p, v = F.col("price"), F.col("volume")
    return ticks.groupBy("instrument").agg(total(p).alias("price_sum"), largest(p).alias("price_max"), dot(p, v).alias("price_dot_volume"), F.count(F.lit(1)).alias("n"))


def _standard(x: Column, mean: Column, sd: Column) -> Column:
    """A deviation within the rounding of the mean is no spread."""
    return F.when(~F.isnan(sd) & (sd <= 1e-15 * F.abs(mean)), 0.0).otherwise(F.try_divide(x - mean, sd))


def zscore(x: Column, *keys: str) -> Column:
    """Against the whole series; 0 where it has no spread. One window over the series: with_zscore is for long ones."""
    every = W.partitionBy("instrument", *keys)
    mean, sd = F.avg(x).over(every), F.stddev_pop(x).over(every)
    return _standard(x, mean, sd)


def with_zscore(ticks: DataFrame, x: str, name: str, *keys: str) -> DataFrame:
    """The same as a column: moments are aggregated before the shuffle and come back by a join, so no series is moved to one task."""
    by = ["instrument", *keys]
    moments = ticks.groupBy(*[F.col(k).alias(f"_tl_{k}") for k in by]).agg(F.avg(x).alias("_tl_mean"), F.stddev_pop(x).alias("_tl_sd"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_tl_{k}")) for k in by])
    return ticks.join(moments, same).withColumn(name, _standard(F.col(x), F.col("_tl_mean"), F.col("_tl_sd"))).drop(*[f"_tl_{k}" for k in by], "_tl_mean", "_tl_sd")


def value_runs(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key its distinct values in order, with how many rows have the value (_c) and are up to it (_end), and n in all: partial counts, then one running sum."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    run = W.partitionBy(key).orderBy(value)
    return counts.withColumn("_end", F.sum("_c").over(run.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("_c").over(W.partitionBy(key)))


def at(index: Column, what: Column) -> Column:
    """what, of the run that holds the sorted place `index` (from 0)."""
    return F.max(F.when((F.col("_end") > index) & (F.col("_end") - F.col("_c") <= index), what))


def at_index(df: DataFrame, key: str, value: str, indexes: dict[str, Column]) -> DataFrame:
    """Per key the values at sorted places that the columns give in terms of n."""
    return value_runs(df, key, value).groupBy(key).agg(*[at(i, F.col(value)).alias(name) for name, i in indexes.items()])


def order_statistics(ticks: DataFrame) -> DataFrame:
    """Upper median and the value at floor(0.9 (n - 1)) of the volumes, and how many reach the latter."""
    late = F.floor(0.90 * (F.col("n") - 1))
    return value_runs(ticks, "instrument", "volume").groupBy("instrument").agg(
        at(F.floor(F.col("n") / 2), F.col("volume")).alias("median_volume"),
        at(late, F.col("volume")).alias("block_threshold"),
        at(late, F.col("n") - F.col("_end") + F.col("_c")).alias("block_days"),
    )


def nearest_rank(df: DataFrame, key: str, value: str, *ps: float) -> DataFrame:
    """Percentiles at index floor(p (n - 1)), named p<percent>."""
    return at_index(df, key, value, {f"p{p * 100:g}".replace(".", "_"): F.floor(F.lit(p) * (F.col("n") - 1)) for p in ps})


def weighted_checksum(ticks: DataFrame, value: str, cycle: int = 17) -> DataFrame:
    """Sum of value_i (i mod cycle + 1) in order."""
    numbered = row_numbers(ticks)
    return numbered.groupBy("instrument").agg(F.sum(F.col(value) * (F.col("rn") % cycle + 1)).alias("checksum"))


def latency_bucket(ns: Column, buckets: int = 24) -> Column:
    """Smallest k with ns <= 64 * 2^k, the last bucket taking all beyond."""
    over = F.ceil(F.log2(F.greatest(ns.cast("double"), F.lit(1.0)) / 64.0) - 1e-12)
    return F.least(F.greatest(over, F.lit(0)), F.lit(buckets - 1)).cast("int")


def latency_percentiles(df: DataFrame, key: str, ns: str, *ps: float) -> DataFrame:
    """Per key the ceiling of the first bucket at which floor(count p) observations are seen; 64 where that is 0."""
    counts = df.groupBy(key, latency_bucket(F.col(ns)).alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    run = W.partitionBy(key).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumn("seen", F.sum("c").over(run)).withColumn("n", F.sum("c").over(W.partitionBy(key)))
    ceiling = lambda p: F.when(F.floor(F.max("n") * p) == 0, F.lit(64).cast("long")).otherwise(F.min(F.when(F.col("seen") >= F.floor(F.col("n") * p), F.expr("shiftleft(64L, bucket)"))))
    return counts.groupBy(key).agg(*[ceiling(p).alias(f"p{p * 100:g}".replace(".", "_")) for p in ps])


def zone_map(df: DataFrame, key: str) -> DataFrame:
    """Rows and per-column bounds, NaN ignored: what a segment's header holds."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in ("price", "volume", "ts_ns") for n, f in (("min", smallest), ("max", largest))])
