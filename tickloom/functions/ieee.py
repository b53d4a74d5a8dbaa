"""Arithmetic that follows IEEE 754 where Spark's own raises or gives null, and erf."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def ieee_div(x: Column, y: Column) -> Column:
    """x / y with infinities and NaN for y = 0; -0.0 as divisor counts as 0."""
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(NAN)).when(x > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(y.isNull() | x.isNull(), F.lit(None).cast("double")).when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def ieee_log(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INF)).when((x < 0) | F.isnan(x), F.lit(NAN)).otherwise(F.log(x))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def rounded_to(x: Column, digits: int) -> Column:
    """x to so many decimals, halves away from 0, by scaling as DuckDB does; Spark's round goes by a number's shortest text, which turns ties of quotients either way."""
    scaled = x.cast("double") * 10.0**digits
    whole = F.rint(scaled)
    near = F.when(F.abs(scaled - whole) == 0.5, scaled + 0.5 * F.signum(scaled)).otherwise(whole) / 10.0**digits
    return F.when(F.abs(scaled) == INF, x.cast("double")).otherwise(near)


def total(x: Column) -> Column:
    """Sum; of no rows 0."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def largest(x: Column) -> Column:
    """Maximum that ignores NaN; of no rows -inf."""
    return F.coalesce(F.max(F.nanvl(x, F.lit(-INF))), F.lit(-INF))


def smallest(x: Column) -> Column:
    """Minimum that ignores NaN; of no rows inf."""
    return F.coalesce(F.min(F.nanvl(x, F.lit(INF))), F.lit(INF))


def dot(x: Column, y: Column) -> Column:
    return total(x * y)


# The published rational approximations of erf by intervals (Sun Microsystems, fdlibm s_erf.c).
ERF_SMALL = (
    (1.28379167095512558561e-01, -3.25042107247001499370e-01, -2.84817495755985104766e-02, -5.77027029648944159157e-03, -2.37630166566501626084e-05),
    (1.0, 3.97917223959155352819e-01, 6.50222499887672944485e-02, 5.08130628187576562776e-03, 1.32494738004321644526e-04, -3.96022827877536812320e-06),
)
ERF_ONE = 8.45062911510467529297e-01
ERF_NEAR_ONE = (
    (-2.36211856075265944077e-03, 4.14856118683748331666e-01, -3.72207876035701323847e-01, 3.18346619901161753674e-01, -1.10894694282396677476e-01, 3.54783043256182359371e-02, -2.16637559486879084300e-03),
    (1.0, 1.06420880400844228286e-01, 5.40397917702171048937e-01, 7.18286544141962662868e-02, 1.26171219808761642112e-01, 1.36370839120290507362e-02, 1.19844998467991074170e-02),
)
ERF_MIDDLE = (
    (-9.86494403484714822705e-03, -6.93858572707181764372e-01, -1.05586262253232909814e01, -6.23753324503260060396e01, -1.62396669462573470355e02, -1.84605092906711035994e02, -8.12874355063065934246e01, -9.81432934416914548592e00),
    (1.0, 1.96512716674392571292e01, 1.37657754143519042600e02, 4.34565877475229228821e02, 6.45387271733267880336e02, 4.29008140027567833386e02, 1.08635005541779435134e02, 6.57024977031928170135e00, -6.04244152148580987438e-02),
)
ERF_LARGE = (
    (-9.86494292470009928597e-03, -7.99283237680523006574e-01, -1.77579549177547519889e01, -1.60636384855821916062e02, -6.37566443368389627722e02, -1.02509513161107724954e03, -4.83519191608651397019e02),
    (1.0, 3.03380607434824582924e01, 3.25792512996573918826e02, 1.53672958608443695994e03, 3.19985821950859553908e03, 2.55305040643316442583e03, 4.74528541206955367215e02, -2.24409524465858183362e01),
)


def _ratio(z: Column, of: tuple) -> Column:
    horner = lambda cs: reduce(lambda acc, c: acc * z + c, reversed(cs[:-1]), F.lit(cs[-1]))
    return horner(of[0]) / horner(of[1])


def erf(x: Column) -> Column:
    """The error function, within about 1e-15; NaN stays NaN."""
    a = F.abs(x)
    tail = lambda of: F.lit(1.0) - F.exp(-a * a - 0.5625 + _ratio(1.0 / (a * a), of)) / a
    body = (
        F.when(a < 0.84375, a + a * _ratio(a * a, ERF_SMALL))
        .when(a < 1.25, F.lit(ERF_ONE) + _ratio(a - 1.0, ERF_NEAR_ONE))
        .when(a < 1 / 0.35, tail(ERF_MIDDLE))
        .when(a < 6.0, tail(ERF_LARGE))
        .otherwise(F.lit(1.0))
    )
    return F.when(F.isnan(x), x).otherwise(F.signum(x) * body)


def gelu(x: Column) -> Column:
    """The exact form, by erf."""
    return 0.5 * x * (1.0 + erf(x / (2.0**0.5)))
