"""Moving averages and Ichimoku lines."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tickloom.operators.graph import Graph, Node
from tickloom.operators.registry import indicator


@indicator("SMA")
def sma(g: Graph, window: int = 20, price_col: str = "close") -> Node:
    return g.mean(g.source(price_col), window)


@indicator("EMA")
def ema(g: Graph, window: int = 20, price_col: str = "close") -> Node:
    return g.span(g.source(price_col), window)


@indicator("WMA")
def wma(g: Graph, window: int = 20, price_col: str = "close") -> Node:
    return g.weighted(g.source(price_col), window)


@indicator("HMA")
def hma(g: Graph, window: int = 9, price_col: str = "close") -> Node:
    price = g.source(price_col)
    half, full = g.weighted(price, window // 2), g.weighted(price, window)
    lead = g.row(f"hull({price.key},{window})", [half, full], lambda a, b: 2 * a - b)
    return g.weighted(lead, math.isqrt(window))


def chain(g: Graph, x: Node, window: int, times: int) -> list[Node]:
    """EMA, EMA of EMA, ..."""
    out = [g.span(x, window)]
    for _ in range(times - 1):
        out.append(g.span(out[-1], window))
    return out


@indicator("TEMA")
def tema(g: Graph, window: int = 20, price_col: str = "close") -> Node:
    price = g.source(price_col)
    return g.row(
        f"tema({price.key},{window})", chain(g, price, window, 3), lambda a, b, c: 3 * a - 3 * b + c
    )


@indicator("DEMA")
def dema(g: Graph, window: int = 20, price_col: str = "close") -> Node:
    price = g.source(price_col)
    return g.row(f"dema({price.key},{window})", chain(g, price, window, 2), lambda a, b: 2 * a - b)


@indicator("KAMA")
def kama(g: Graph, window: int = 10, fast: int = 2, slow: int = 30, price_col: str = "close") -> Node:
    price = g.source(price_col)
    key = f"kama({price.key},{window},{fast},{slow})"
    step = g.row(f"|diff|({price.key})", [g.diff(price)], F.abs)
    travel = g.row(f"|diff|({price.key},{window})", [g.diff(price, window)], F.abs)
    ratio = g.finite(g.div(travel, g.sum(step, window)))
    quick, calm = 2 / (fast + 1), 2 / (slow + 1)
    speed = g.row(
        f"{key}.speed",
        [ratio],
        lambda er: F.pow(F.coalesce(er, F.lit(0.0)) * (quick - calm) + calm, F.lit(2.0)),
    )
    oldest, seed_at = g.lag(price, window), g.lag(price, window - 1)
    a = g.row(
        f"{key}.a", [speed, oldest], lambda s, o: F.when(o.isNotNull(), 1 - s).otherwise(F.lit(1.0))
    )
    b = g.row(
        f"{key}.b",
        [speed, oldest, seed_at, price],
        lambda s, o, first, p: F.when(o.isNotNull(), s * p).when(first.isNotNull(), p),
    )
    return g.affine(key, a, b, 1 - calm**2)


def midpoint(g: Graph, window: int) -> Node:
    """Middle of the range of the last rows."""
    top, bottom = g.max(g.source("high"), window), g.min(g.source("low"), window)
    return g.row(f"midpoint({window})", [top, bottom], lambda a, b: (a + b) / 2)


@indicator("IchimokuTenkan")
def ichimoku_tenkan(g: Graph, window: int = 9) -> Node:
    return midpoint(g, window)


@indicator("IchimokuKijun")
def ichimoku_kijun(g: Graph, window: int = 26) -> Node:
    return midpoint(g, window)


# The displacement of both leading lines is fixed, whatever the windows are.
DISPLACEMENT = 26


@indicator("IchimokuSenkouA")
def ichimoku_senkou_a(g: Graph, tenkan: int = 9, kijun: int = 26) -> Node:
    middle = g.row(
        f"senkou_a({tenkan},{kijun})", [midpoint(g, tenkan), midpoint(g, kijun)], lambda a, b: (a + b) / 2
    )
    return g.lag(middle, DISPLACEMENT)


@indicator("IchimokuSenkouB")
def ichimoku_senkou_b(g: Graph, window: int = 52) -> Node:
    return g.lag(midpoint(g, window), DISPLACEMENT)
