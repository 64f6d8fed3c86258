"""Moments and regressions over the last rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tickloom.functions import fdiv
from tickloom.operators.graph import Graph, Node
from tickloom.operators.indicators.common import scaled
from tickloom.operators.registry import indicator


@indicator("StdDev")
def std_dev(g: Graph, window: int = 20, price_col: str = "close") -> Node:
    return g.std(g.source(price_col), window)


@indicator("Variance")
def variance(g: Graph, window: int = 20, price_col: str = "close") -> Node:
    return g.var(g.source(price_col), window)


@indicator("SEM")
def sem(g: Graph, window: int = 20, price_col: str = "close") -> Node:
    return g.row(
        f"sem({price_col},{window})", [g.std(g.source(price_col), window)], lambda s: s / math.sqrt(window)
    )


def central_moments(g: Graph, x: Node, n: int) -> Node:
    """Sums of the 2nd to 4th power of the distance from the window mean."""
    v = g.finite(x)
    mean = g.mean(v, n)
    values = g.values(v, n)

    def make(xs, m):
        zero = F.struct(F.lit(0.0).alias("s2"), F.lit(0.0).alias("s3"), F.lit(0.0).alias("s4"))

        def add(total, one):
            d2 = (one - m) * (one - m)
            return F.struct(
                (total["s2"] + d2).alias("s2"),
                (total["s3"] + d2 * (one - m)).alias("s3"),
                (total["s4"] + d2 * d2).alias("s4"),
            )

        return F.when(m.isNotNull(), F.aggregate(xs, zero, add))

    return g.row(f"moments({v.key},{n})", [values, mean], make)


@indicator("Skew")
def skew(g: Graph, window: int = 20, price_col: str = "close") -> Node:
    """Bias-corrected skewness; 0 on a constant window."""
    n, x = window, g.source(price_col)
    factor = math.sqrt(n * (n - 1)) / (n - 2) * math.sqrt(n)
    return g.row(
        f"skew1({x.key},{n})",
        [central_moments(g, x, n), g.std(x, n)],
        lambda m, d: F.when(d == 0, 0.0).otherwise(factor * F.try_divide(m["s3"], F.pow(m["s2"], F.lit(1.5)))),
    )


@indicator("Kurtosis")
def kurtosis(g: Graph, window: int = 20, price_col: str = "close") -> Node:
    """Bias-corrected excess kurtosis; -3 on a constant window."""
    n, x = window, g.source(price_col)
    factor = (n - 1) / ((n - 2) * (n - 3))
    return g.row(
        f"kurt2({x.key},{n})",
        [central_moments(g, x, n), g.std(x, n)],
        lambda m, d: F.when(d == 0, -3.0).otherwise(
            factor * ((n + 1) * (n * F.try_divide(m["s4"], m["s2"] * m["s2"]) - 3) + 6)
        ),
    )


def _pairs(g: Graph, key: str, a: Node, b: Node, n: int, make) -> Node:
    """A window over rows where both columns are present."""
    x, y = g.finite(a), g.finite(b)
    w = g.rows_before(n)

    def build():
        both = F.col(x.column).isNotNull() & F.col(y.column).isNotNull()
        p, q = F.when(both, F.col(x.column)), F.when(both, F.col(y.column))
        return F.when(F.count(p).over(w) == n, make(p, q, w))

    return g.window(key, [x, y], build, n - 1)


@indicator("Correlation")
def correlation(g: Graph, window: int = 20, price_col: str = "close", benchmark_col: str = "volume") -> Node:
    a, b = g.source(price_col), g.source(benchmark_col)

    def make(p, q, w):
        spread = F.stddev_samp(p).over(w) * F.stddev_samp(q).over(w)
        return F.try_divide(F.covar_samp(p, q).over(w), spread)

    return _pairs(g, f"corr({a.key},{b.key},{window})", a, b, window, make)


@indicator("Beta")
def beta(g: Graph, window: int = 20, price_col: str = "close", market_col: str = "close") -> Node:
    a, b = g.pct(g.source(price_col)), g.pct(g.source(market_col))

    def make(p, q, w):
        return fdiv(F.covar_samp(p, q).over(w), F.var_samp(q).over(w))

    return _pairs(g, f"beta({a.key},{b.key},{window})", a, b, window, make)


def slope(g: Graph, x: Node, window: int) -> Node:
    """Least-squares slope against 0..n-1, from the weighted and the plain sum."""
    n = window
    middle, total = (n + 1) / 2, n * (n * n - 1) / 12
    return g.row(
        f"slope({x.key},{n})",
        [g.weighted(x, n), g.sum(x, n)],
        lambda w, s: (w * (n * (n + 1) / 2) - s * middle) / total,
    )


def _line(g: Graph, window: int, price_col: str, at: float) -> Node:
    x = g.source(price_col)
    reach = at - (window - 1) / 2
    return g.row(
        f"line({x.key},{window},{at!r})",
        [g.mean(x, window), slope(g, x, window)],
        lambda m, s: m + s * reach,
    )


@indicator("LinearReg")
def linear_reg(g: Graph, window: int = 20, price_col: str = "close") -> Node:
    return _line(g, window, price_col, window - 1)


@indicator("LinearRegSlope")
def linear_reg_slope(g: Graph, window: int = 20, price_col: str = "close") -> Node:
    return slope(g, g.source(price_col), window)


@indicator("LinearRegAngle")
def linear_reg_angle(g: Graph, window: int = 20, price_col: str = "close") -> Node:
    s = slope(g, g.source(price_col), window)
    return scaled(g, g.row(f"atan({s.key})", [s], F.atan), 180 / math.pi)


@indicator("TSF")
def tsf(g: Graph, window: int = 20, price_col: str = "close") -> Node:
    return _line(g, window, price_col, window)
