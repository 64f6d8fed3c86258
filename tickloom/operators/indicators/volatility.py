"""Ranges, bands and channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators.graph import Graph, Node
from tickloom.operators.indicators.common import minus, scaled, true_range
from tickloom.operators.registry import indicator


@indicator("ATR")
def atr(g: Graph, window: int = 14) -> Node:
    return g.span(true_range(g), window)


@indicator("NATR")
def natr(g: Graph, window: int = 14) -> Node:
    return scaled(g, g.div(atr(g, window), g.source("close")), 100.0)


def shifted(g: Graph, middle: Node, spread: Node, factor: float) -> Node:
    """middle + factor * spread"""
    return g.row(f"({middle.key}+{factor!r}*{spread.key})", [middle, spread], lambda m, s: m + s * factor)


@indicator("BollingerMiddle")
def bollinger_middle(g: Graph, window: int = 20, price_col: str = "close") -> Node:
    return g.mean(g.source(price_col), window)


@indicator("BollingerUpper")
def bollinger_upper(g: Graph, window: int = 20, std: float = 2, price_col: str = "close") -> Node:
    price = g.source(price_col)
    return shifted(g, g.mean(price, window), g.std(price, window), std)


@indicator("BollingerLower")
def bollinger_lower(g: Graph, window: int = 20, std: float = 2, price_col: str = "close") -> Node:
    price = g.source(price_col)
    return shifted(g, g.mean(price, window), g.std(price, window), -std)


@indicator("BollingerWidth")
def bollinger_width(g: Graph, window: int = 20, std: float = 2, price_col: str = "close") -> Node:
    return minus(g, bollinger_upper(g, window, std, price_col), bollinger_lower(g, window, std, price_col))


@indicator("BollingerPercent")
def bollinger_percent(g: Graph, window: int = 20, std: float = 2, price_col: str = "close") -> Node:
    score = g.score(g.source(price_col), window)
    return g.row(f"percent({score.key},{std!r})", [score], lambda z: (z + std) / (2 * std))


@indicator("KeltnerMiddle")
def keltner_middle(g: Graph, window: int = 20, price_col: str = "close") -> Node:
    return g.span(g.source(price_col), window)


@indicator("KeltnerUpper")
def keltner_upper(
    g: Graph, window: int = 20, atr_window: int = 10, mult: float = 2, price_col: str = "close"
) -> Node:
    return shifted(g, keltner_middle(g, window, price_col), atr(g, atr_window), mult)


@indicator("KeltnerLower")
def keltner_lower(
    g: Graph, window: int = 20, atr_window: int = 10, mult: float = 2, price_col: str = "close"
) -> Node:
    return shifted(g, keltner_middle(g, window, price_col), atr(g, atr_window), -mult)


@indicator("DonchianUpper")
def donchian_upper(g: Graph, window: int = 20) -> Node:
    return g.max(g.source("high"), window)


@indicator("DonchianLower")
def donchian_lower(g: Graph, window: int = 20) -> Node:
    return g.min(g.source("low"), window)


@indicator("UlcerIndex")
def ulcer_index(g: Graph, window: int = 14, price_col: str = "close") -> Node:
    price = g.source(price_col)
    top = g.max(price, window)
    fall = scaled(g, g.div(minus(g, price, top), top), 100.0)
    square = g.row(f"{fall.key}^2", [fall], lambda x: x * x)
    mean = g.mean(square, window)
    return g.row(f"sqrt({mean.key})", [mean], F.sqrt)


@indicator("MassIndex")
def mass_index(g: Graph, window: int = 25, ema_period: int = 9, price_col: str = "close") -> Node:
    extent = minus(g, g.source("high"), g.source("low"))
    once = g.span(extent, ema_period, deep=True)
    return g.sum(g.div(once, g.span(once, ema_period, deep=True)), window)
