"""The twelve kernels by name, with class and tolerance, and a small facade over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import ieee
from tickloom.operators import reductions, scans, tensor, windows
from tickloom.plans.graph import PlanGraph


@dataclass(frozen=True)
class Kernel:
    name: str
    kind: str
    build: Callable
    tolerance: float


KERNELS = {
    k.name: k
    for k in (
        Kernel("rolling_mean", "window", windows.rolling_mean, 1e-9),
        Kernel("rolling_std", "window", windows.rolling_std, 1e-8),
        Kernel("rolling_vwap", "window", windows.rolling_vwap, 1e-9),
        Kernel("sum", "reduction", ieee.total, 1e-12),
        Kernel("max", "reduction", ieee.largest, 0.0),
        Kernel("dot", "reduction", ieee.dot, 1e-11),
        Kernel("ema", "transform", scans.with_ema, 1e-12),
        Kernel("zscore", "transform", reductions.zscore, 1e-10),
        Kernel("gelu", "transform", ieee.gelu, 1e-12),
        Kernel("softmax", "normalization", tensor.softmax, 1e-12),
        Kernel("layernorm", "normalization", tensor.layernorm, 1e-10),
        Kernel("matmul", "matrix", tensor.matmul, 1e-10),
    )
}


def close(a: float, b: float, eps: float) -> bool:
    """Equal within eps, absolute for small and relative for large numbers; NaN equals NaN."""
    return a != a and b != b or abs(a - b) <= eps * (1 + abs(b))


class Engine:
    """Kernels by name, those that are expressions on arrays as Columns, and plan graphs with what their last run took."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.took: dict[str, float] = {}

    def execute(self, graph: PlanGraph, timed: bool = False) -> dict[str, DataFrame]:
        """The graph's outputs by name. With timed, each live node's plan is run alone once more, and its seconds are kept in `took`."""
        self.took = graph.timed() if timed else {}
        return graph.execute()

    def kernel(self, name: str) -> Kernel:
        if name not in KERNELS:
            raise KeyError(f"no kernel {name}; there are {', '.join(KERNELS)}")
        return KERNELS[name]

    def row(self, name: str, x: str) -> Column:
        return self.kernel(name).build(F.col(x))
