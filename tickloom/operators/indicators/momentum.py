"""Oscillators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators.graph import Graph, Node
from tickloom.operators.indicators.common import (
    band_position,
    median_price,
    minus,
    relative_strength,
    scaled,
    true_range,
    typical,
)
from tickloom.operators.registry import indicator


@indicator("RSI")
def rsi(g: Graph, window: int = 14, price_col: str = "close") -> Node:
    return relative_strength(g, g.source(price_col), window)


@indicator("StochasticK")
def stochastic_k(g: Graph, window: int = 14, smooth: int = 3) -> Node:
    top, bottom = g.max(g.source("high"), window), g.min(g.source("low"), window)
    return g.mean(scaled(g, band_position(g, g.source("close"), top, bottom), 100.0), smooth)


@indicator("StochasticD")
def stochastic_d(g: Graph, window: int = 14, smooth_k: int = 3, smooth_d: int = 3) -> Node:
    return g.mean(stochastic_k(g, window, smooth_k), smooth_d)


@indicator("StochRSIK")
def stoch_rsi_k(g: Graph, window: int = 14, smooth: int = 3, price_col: str = "close") -> Node:
    strength = relative_strength(g, g.source(price_col), window)
    position = band_position(g, strength, g.max(strength, window), g.min(strength, window))
    return g.mean(scaled(g, position, 100.0), smooth)


@indicator("StochRSID")
def stoch_rsi_d(
    g: Graph, window: int = 14, smooth_k: int = 3, smooth_d: int = 3, price_col: str = "close"
) -> Node:
    return g.mean(stoch_rsi_k(g, window, smooth_k, price_col), smooth_d)


@indicator("MACD")
def macd(g: Graph, fast: int = 12, slow: int = 26, signal: int = 9, price_col: str = "close") -> Node:
    price = g.source(price_col)
    return minus(g, g.span(price, fast), g.span(price, slow))


@indicator("MACDSignal")
def macd_signal(g: Graph, fast: int = 12, slow: int = 26, signal: int = 9, price_col: str = "close") -> Node:
    return g.span(macd(g, fast, slow, signal, price_col), signal)


@indicator("MACDHist")
def macd_hist(g: Graph, fast: int = 12, slow: int = 26, signal: int = 9, price_col: str = "close") -> Node:
    line = macd(g, fast, slow, signal, price_col)
    return minus(g, line, macd_signal(g, fast, slow, signal, price_col))


def commodity_channel(g: Graph, x: Node, window: int) -> Node:
    v = g.finite(x)
    mean = g.mean(v, window)
    values = g.values(v, window)
    spread = g.row(
        f"mad({v.key},{window})",
        [values, mean],
        lambda xs, m: F.aggregate(xs, F.lit(0.0), lambda total, one: total + F.abs(one - m)) / window,
    )
    ratio = g.div(minus(g, v, mean), scaled(g, spread, 0.015))
    # On a constant window the mean is the value but for rounding.
    return g.row(
        f"cci({v.key},{window})", [ratio, values], lambda r, xs: F.when(F.array_max(xs) > F.array_min(xs), r)
    )


@indicator("CCI")
def cci(g: Graph, window: int = 20) -> Node:
    return commodity_channel(g, typical(g), window)


@indicator("WilliamsR")
def williams_r(g: Graph, window: int = 14) -> Node:
    top, bottom = g.max(g.source("high"), window), g.min(g.source("low"), window)
    return scaled(g, g.div(minus(g, top, g.source("close")), minus(g, top, bottom)), -100.0)


@indicator("ROC")
def roc(g: Graph, window: int = 10, price_col: str = "close") -> Node:
    price = g.source(price_col)
    return scaled(g, g.div(g.diff(price, window), g.lag(price, window)), 100.0)


@indicator("Momentum")
def momentum(g: Graph, window: int = 10, price_col: str = "close") -> Node:
    return g.diff(g.source(price_col), window)


@indicator("TSI")
def tsi(g: Graph, slow: int = 25, fast: int = 13, price_col: str = "close") -> Node:
    move = g.diff(g.source(price_col))
    size = g.row(f"|{move.key}|", [move], F.abs)

    def smooth(x: Node) -> Node:
        return g.span(g.span(x, slow, deep=True), fast, deep=True)

    return scaled(g, g.div(smooth(move), smooth(size)), 100.0)


@indicator("UltimateOscillator")
def ultimate_oscillator(g: Graph, fast: int = 7, medium: int = 14, slow: int = 28) -> Node:
    close = g.source("close")
    pressure = g.row(
        "buying_pressure", [close, g.source("low"), g.lag(close, 1)], lambda c, l, p: c - F.least(l, p)
    )
    reach = true_range(g)
    shares = [g.div(g.sum(pressure, n), g.sum(reach, n)) for n in (fast, medium, slow)]
    return g.row(
        f"uo({fast},{medium},{slow})", shares, lambda a, b, c: 100 * ((4 * a + 2 * b + c) / 7)
    )


@indicator("AwesomeOscillator")
def awesome_oscillator(g: Graph, fast: int = 5, slow: int = 34) -> Node:
    price = median_price(g)
    return minus(g, g.mean(price, fast), g.mean(price, slow))
