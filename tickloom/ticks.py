"""Ticks: (instrument, ord, ts_ns, price, volume) with a total order within each instrument, and views of tables as ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.ieee import rounded_to

TICK_SCHEMA = T.StructType([T.StructField("instrument", T.StringType()), T.StructField("ord", T.LongType()), T.StructField("ts_ns", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("volume", T.DoubleType())])

#: Every ordered operator sorts by these within an instrument: time, then a unique id.
ORDER = ("ts_ns", "ord")


def in_order(*keys: str):
    """The window of an instrument's ticks (and further keys) in their total order."""
    return W.partitionBy("instrument", *keys).orderBy(*ORDER)


def trailing(w: int, *keys: str):
    """The last w rows, the current one included."""
    return in_order(*keys).rowsBetween(-(w - 1), 0)


def event_ticks(spark: SparkSession, sf_dir: str, instrument: str = "event_type") -> DataFrame:
    """events as ticks: value is the price, the number in props the volume."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col(instrument).cast("string").alias("instrument"),
        F.col("event_id").alias("ord"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as ticks by priority, with volume 1."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderpriority").alias("instrument"), F.col("o_orderkey").alias("ord"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("ts_ns"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """The named columns rounded, negative zero as zero and NaN as null: comparable across engines."""
    tidy = lambda c: F.when(~F.isnan(c), rounded_to(c, digits) + 0.0)
    return df.withColumns({n: tidy(F.col(n)) for n in names})


def warm(value: Column, rows: Column, w: int, warmup: str = "null") -> Column:
    """The value where the window is full; null (or NaN) before."""
    return F.when(rows >= w, value) if warmup == "null" else F.when(rows >= w, value).otherwise(F.lit(float("nan")))
