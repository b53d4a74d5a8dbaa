"""Numbers as they are shown: percent with sign, price, magnitude and latency; instrument keys and regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CURRENCY = {"USD": "$", "INR": "₹", "EUR": "€", "GBP": "£"}

# Exchange suffixes that a display key drops, and the regions of suffixes.
EXCHANGES = ("NS", "BO", "KS", "L", "TO", "HK", "DE", "PA", "SS", "SZ")
REGION_BY_SUFFIX = ((".NS", "India"), (".BO", "India"), ("-USD", "Crypto"))
REGION_BY_EXCHANGE = ((".L", "UK"), (".KS", "Korea"), (".TO", "Canada"), (".HK", "Hong Kong"))


def currency_sign(code: Column) -> Column:
    return F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in CURRENCY.items()], F.lit(""))


def percent(x: Column) -> Column:
    return F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit("")), F.format_string("%.2f%%", x))


def price(x: Column) -> Column:
    return F.when(x >= 1000, F.format_number(x, 0)).otherwise(F.format_string("%.2f", x))


def magnitude(x: Column) -> Column:
    a = F.abs(x)
    steps = ((1e12, "%.2fT"), (1e9, "%.2fB"), (1e6, "%.1fM"), (1e3, "%.1fK"))
    return F.coalesce(*[F.when(a >= s, F.format_string(f, x / s)) for s, f in steps], F.format_string("%.0f", x))


def latency(ns: Column) -> Column:
    ns = ns.cast("double")
    return F.when(ns < 1000, F.format_string("%.0f ns", ns)).when(ns < 1e6, F.format_string("%.1f µs", ns / 1000)).otherwise(F.format_string("%.2f ms", ns / 1e6))


def display_key(symbol: Column) -> Column:
    """Without a leading caret, an exchange suffix and the quote currency."""
    bare = F.regexp_replace(symbol, r"^\^", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)\.(" + "|".join(EXCHANGES) + r")$", ""), "-USD$", "")


def region(symbol: Column) -> Column:
    s = F.upper(symbol)
    rules = [F.when(s.endswith(k), F.lit(v)) for k, v in REGION_BY_SUFFIX] + [F.when(s.startswith("^"), F.lit("Index"))] + [F.when(s.endswith(k), F.lit(v)) for k, v in REGION_BY_EXCHANGE]
    return F.coalesce(*rules, F.lit("US"))
