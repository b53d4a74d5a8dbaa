"""First-order recursions over ordered ticks: exponential averages and the risk position.

Short series fold inside one expression; any others go by chunks: y = a x + (1 - a) y' is an affine map, maps compose associatively, so each chunk is scanned
from 0 on its own, the carries of a series' chunks are composed in order, and (1 - a)^(k + 1) times the carry is added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.lineage import saved
from tickloom.operators.windows import row_numbers
from tickloom.ticks import ORDER

BLOCK = 64


def check_alpha(alpha: float) -> None:
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")


def affine_scan(x: np.ndarray, alpha: float, start: float) -> np.ndarray:
    """y_k = alpha x_k + (1 - alpha) y_{k-1} from y_{-1} = start, by blocks of BLOCK rows."""
    n, keep = len(x), 1.0 - alpha
    if not n:
        return x.astype(float)
    step = np.arange(BLOCK)
    lower = np.where(step[:, None] >= step, alpha * keep ** np.maximum(step[:, None] - step, 0), 0.0)
    padded = np.zeros(-(-n // BLOCK) * BLOCK)
    padded[:n] = x
    if np.isfinite(padded).all():
        local = padded.reshape(-1, BLOCK) @ lower.T
        decay, carry = keep ** (step + 1), start
        for row in local:
            row += decay * carry
            carry = row[-1]
        return local.ravel()[:n]
    out, y = np.empty(n), start
    for i, v in enumerate(x):
        y = alpha * v + keep * y
        out[i] = y
    return out


def fold_ema(ticks: DataFrame, column: str, alpha: float, name: str) -> DataFrame:
    """For short series: sorted rows of an instrument folded in one expression (rows are few, as the array is copied at each step)."""
    check_alpha(alpha)
    rest = [c for c in ticks.columns if c != "instrument"]
    rows = ticks.groupBy("instrument").agg(F.sort_array(F.collect_list(F.struct(*ORDER, F.struct(*rest).alias("row")))).alias("rows"))
    x = lambda r: r["row"][column].cast("double")
    last = lambda acc: F.element_at(acc, -1)
    empty = F.array().cast("array<double>")
    folded = F.aggregate("rows", empty, lambda acc, r: F.concat(acc, F.array(F.when(F.size(acc) == 0, x(r)).otherwise(alpha * x(r) + (1 - alpha) * last(acc)))))
    out = rows.withColumn("y", folded).select("instrument", F.explode(F.arrays_zip("rows", "y")).alias("z"))
    return out.select("instrument", *[F.col(f"z.rows.row.{c}").alias(c) for c in rest], F.col("z.y").alias(name))


def numbers(rows: pa.Table, column: str) -> np.ndarray:
    """A column as doubles; null is NaN. (Arrow, unlike pandas, tells NaN from null on the way back.)"""
    return rows.column(column).cast(pa.float64()).to_numpy().astype(float)


def with_ema(ticks: DataFrame, column: str, alpha: float, name: str, size: int = 65_536, first: str = "value") -> DataFrame:
    """ticks with the exponential average of a column. first: "value" starts at the first value, "zero" at 0 before it."""
    check_alpha(alpha)
    keep = 1.0 - alpha
    numbered = saved(row_numbers(ticks, "_tl_rn").withColumn("_tl_chunk", F.floor(F.col("_tl_rn") / size)), "numbered")
    own = T.StructType([*numbered.schema.fields, T.StructField("_tl_local", T.DoubleType())])

    def scan(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_tl_rn")
        x = numbers(rows, column)
        start = x[0] if first == "value" and len(x) and rows.column("_tl_chunk")[0].as_py() == 0 else 0.0
        return rows.append_column("_tl_local", pa.array(affine_scan(x, alpha, start)))

    local = numbered.groupBy("instrument", "_tl_chunk").applyInArrow(scan, own)
    if numbered.agg(F.max("_tl_chunk")).first()[0] in (None, 0):
        return local.withColumnRenamed("_tl_local", name).drop("_tl_rn", "_tl_chunk")
    local = saved(local, "chunks")
    ends = local.groupBy("instrument", "_tl_chunk").agg(F.max_by("_tl_local", "_tl_rn").alias("end"), F.count(F.lit(1)).alias("n"))

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_tl_chunk")
        out, y = [], 0.0
        for end, n in zip(rows["end"], rows["n"], strict=True):
            out.append(y)
            y = end + keep**n * y
        return pd.DataFrame({"instrument": rows["instrument"], "_tl_chunk": rows["_tl_chunk"], "_tl_carry": out})

    carried = ends.groupBy("instrument").applyInPandas(carry, "instrument string, _tl_chunk bigint, _tl_carry double")
    joined = local.join(carried.withColumnRenamed("instrument", "_tl_i").withColumnRenamed("_tl_chunk", "_tl_c"), F.col("instrument").eqNullSafe(F.col("_tl_i")) & (F.col("_tl_chunk") == F.col("_tl_c")))
    decay = F.pow(F.lit(keep), F.col("_tl_rn") % size + 1)
    return joined.withColumn(name, F.col("_tl_local") + decay * F.col("_tl_carry")).drop("_tl_rn", "_tl_chunk", "_tl_local", "_tl_carry", "_tl_i", "_tl_c")


def batch_scan(batches: DataFrame, steps: dict[str, tuple[str, float, str]]) -> DataFrame:
    """Exponential averages that begin anew in each (instrument, batch): name -> (column, alpha, first)."""
    schema = T.StructType([*batches.schema.fields, *[T.StructField(n, T.DoubleType()) for n in steps]])

    def scan(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ORDER])
        for name, (column, alpha, first) in steps.items():
            x = numbers(rows, column)
            rows = rows.append_column(name, pa.array(affine_scan(x, alpha, x[0] if first == "value" else 0.0)))
        return rows

    return batches.groupBy("instrument", "batch").applyInArrow(scan, schema)


def online(values: Iterator[float], w: int) -> Iterator[float]:
    """The recursion of the streaming mean, for one series in order."""
    held, total = [], 0.0
    for v in values:
        held.append(v)
        total += v
        if len(held) > w:
            total -= held.pop(0)
        yield total / len(held)
