"""Rows of numbers as array columns: softmax, layer normalisation, GELU, products with matrices, and their chain.

Long form is (i, j, v), one row per cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.ieee import gelu


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once a row (an expression used inside a lambda would be computed once an element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(x: Column) -> Column:
    """Of each row, the largest entry subtracted first; an empty row stays empty."""
    raised = lambda m: F.transform(x, lambda v: F.exp(v - m))
    return let(F.array_max(x), lambda m: let(raised(m), lambda e: let(_sum(e), lambda s: F.transform(e, lambda v: F.try_divide(v, s)))))


def layernorm(x: Column, eps: float = 1e-5) -> Column:
    """Of each row, with population variance; no gain or bias; an empty row stays empty."""
    n = F.nullif(F.size(x), F.lit(0))
    spread = lambda d: F.sqrt(_sum(F.transform(d, lambda v: v * v)) / n + eps)
    whole = let(_sum(x) / n, lambda m: let(F.transform(x, lambda v: v - m), lambda d: let(spread(d), lambda s: F.transform(d, lambda v: v / s))))
    return F.when(F.size(x) == 0, x).otherwise(whole)


def gelu_row(x: Column) -> Column:
    return F.transform(x, gelu)


def dot_rows(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a * b))


def long_form(df: DataFrame, row: str, x: str) -> DataFrame:
    return df.select(F.col(row).alias("i"), F.posexplode(x).alias("j", "v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two matrices in long form: one join on the inner index, one sum by cell."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("jj"), F.col("v").alias("w"))
    return a.join(right, F.col("j") == F.col("k")).groupBy("i", F.col("jj").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def matmul_rows(x: Column, weights: list[list[float]]) -> Column:
    """Rows times a small matrix given as rows of numbers (a model's layer: its size is the model's, not the data's)."""
    if any(len(r) != len(weights[0]) for r in weights):
        raise ValueError("rows of the weights differ in length")
    columns = [F.array(*[F.lit(float(r[j])) for r in weights]) for j in range(len(weights[0]))]
    fits = F.assert_true(F.size(x) == len(weights), F.lit("row and weights differ in length"))
    return F.coalesce(fits.cast("array<double>"), F.array(*[dot_rows(x, c) for c in columns]))


def mlp(df: DataFrame, x: str, weights: list[list[float]], name: str = "y") -> DataFrame:
    """Product, layer normalisation, softmax."""
    return df.withColumn(name, let(matmul_rows(F.col(x), weights), lambda h: let(layernorm(h), softmax)))
