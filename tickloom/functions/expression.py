"""A small expression language over tick columns, compiled to one Spark Column.

sum := product (('+' | '-') product)*; product := factor (('*' | '/') factor)*; factor := number | name | name '(' sum (',' sum)* ')' | '(' sum ')' | '-' factor.
Columns: price, volume, ts. Calls: mean(col, w), std(col, w), ema(col, a), vwap(col, col, w); columns in calls are bare names,
windows and alphas constant expressions. Catalyst resolves, folds and shares subexpressions; only ema needs a step of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.ieee import ieee_div
from tickloom.operators import scans, windows

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z][A-Za-z0-9]*)|([-+*/(),]))")
COLUMNS = {"price": "price", "volume": "volume", "ts": "ts_ns"}


class ExpressionError(ValueError):
    pass


@dataclass
class Compiled:
    """A scalar has its value, a vector its Column."""

    column: Column
    value: float | None = None


class Compiler:
    def __init__(self, source: str, columns: dict[str, str], warmup: str):
        self.columns, self.warmup = columns, warmup
        self.emas: dict[tuple[str, float], str] = {}
        self.tokens: list[str] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise ExpressionError(f"unexpected character at {at}: {source[at:at + 8]!r}")
            self.tokens.append(m[1] or m[2] or m[3])
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        got = self.peek()
        if not got or wanted is not None and got != wanted:
            raise ExpressionError(f"expected {wanted or 'more'}, found {got or 'the end'}")
        self.at += 1
        return got

    def run(self) -> Compiled:
        out = self.sum()
        if self.peek():
            raise ExpressionError(f"unexpected {self.peek()}")
        return out

    def sum(self) -> Compiled:
        left = self.product()
        while self.peek() in ("+", "-"):
            left = self.binary(self.take(), left, self.product())
        return left

    def product(self) -> Compiled:
        left = self.factor()
        while self.peek() in ("*", "/"):
            left = self.binary(self.take(), left, self.factor())
        return left

    def binary(self, op: str, a: Compiled, b: Compiled) -> Compiled:
        column = {"+": lambda: a.column + b.column, "-": lambda: a.column - b.column, "*": lambda: a.column * b.column, "/": lambda: ieee_div(a.column, b.column)}[op]()
        if a.value is None or b.value is None:
            return Compiled(column)
        if op == "/":
            return Compiled(column, a.value / b.value if b.value else float("nan") if not a.value else float("inf") * a.value)
        return Compiled(column, {"+": a.value + b.value, "-": a.value - b.value, "*": a.value * b.value}[op])

    def factor(self) -> Compiled:
        token = self.take()
        if token == "-":
            inner = self.factor()
            return Compiled(-inner.column, None if inner.value is None else -inner.value)
        if token == "(":
            inner = self.sum()
            self.take(")")
            return inner
        if token[0].isdigit() or token[0] == ".":
            return Compiled(F.lit(float(token)), float(token))
        if not token[0].isalpha():
            raise ExpressionError(f"unexpected {token}")
        if self.peek() != "(":
            return Compiled(F.col(self.name(token)).cast("double"))
        return self.call(token)

    def name(self, token: str) -> str:
        if token not in self.columns:
            raise ExpressionError(f"unknown column {token}")
        return self.columns[token]

    def call(self, function: str) -> Compiled:
        arity = {"mean": 1, "std": 1, "ema": 1, "vwap": 2}.get(function)
        if arity is None:
            raise ExpressionError(f"unknown function {function}")
        self.take("(")
        names = []
        for _ in range(arity):
            token = self.take()
            if not token[0].isalpha() or self.peek() != ",":
                raise ExpressionError(f"{function} takes bare column names, then a constant")
            names.append(self.name(token))
            self.take(",")
        constant = self.sum()
        self.take(")")
        if constant.value is None:
            raise ExpressionError(f"the last argument of {function} must be constant")
        if function == "ema":
            scans.check_alpha(constant.value)
            return Compiled(F.col(self.emas.setdefault((names[0], constant.value), f"_ema{len(self.emas)}")))
        w = constant.value
        if not (w >= 0 and w == int(w) if w == w and abs(w) != float("inf") else False):
            raise ExpressionError(f"a window must be a whole number of rows, not {w}")
        return Compiled({"mean": windows.rolling_mean, "std": windows.rolling_std, "vwap": windows.rolling_vwap}[function](*map(F.col, names), int(w), warmup=self.warmup))


def evaluate(ticks: DataFrame, source: str, name: str = "value", columns: dict[str, str] | None = None, warmup: str = "null") -> DataFrame:
    """ticks with the expression's value; a scalar goes to every row."""
    compiler = Compiler(source, columns or COLUMNS, warmup)
    out = compiler.run()
    for (column, alpha), target in compiler.emas.items():
        ticks = scans.with_ema(ticks, column, alpha, target)
    return ticks.withColumn(name, out.column).drop(*compiler.emas.values())
