"""Quantities shared by several indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators.graph import Graph, Node


def true_range(g: Graph) -> Node:
    """Range of the row including the close before it; on the first row high - low."""
    before = g.lag(g.source("close"), 1)
    return g.row(
        "true_range",
        [g.source("high"), g.source("low"), before],
        lambda h, l, c: F.greatest(h - l, F.abs(h - c), F.abs(l - c)),
    )


def typical(g: Graph) -> Node:
    return g.row(
        "typical", [g.source("high"), g.source("low"), g.source("close")], lambda h, l, c: (h + l + c) / 3
    )


def median_price(g: Graph) -> Node:
    return g.row("median_price", [g.source("high"), g.source("low")], lambda h, l: (h + l) / 2)


def product(g: Graph, a: Node, b: Node) -> Node:
    return g.row(f"({a.key}*{b.key})", [a, b], lambda x, y: x * y)


def location(g: Graph) -> Node:
    """Where the close lies in the range, -1..1; 0 on a flat bar."""
    high, low, close = (g.source(c) for c in ("high", "low", "close"))
    part = g.row("location.part", [high, low, close], lambda h, l, c: (c - l) - (h - c))
    extent = g.row("high-low", [high, low], lambda h, l: h - l)
    return g.row("location", [g.div(part, extent)], lambda x: F.coalesce(x, F.lit(0.0)))


def relative_strength(g: Graph, x: Node, window: int) -> Node:
    """Plain-mean RSI. The first row counts as no move."""
    move = g.diff(x)
    gain = g.row(
        f"gain({x.key})", [move], lambda d: F.coalesce(F.greatest(d, F.lit(0.0)), F.lit(0.0)), may_inf=False
    )
    loss = g.row(
        f"loss({x.key})", [move], lambda d: F.coalesce(F.greatest(-d, F.lit(0.0)), F.lit(0.0)), may_inf=False
    )
    ratio = g.div(g.mean(gain, window), g.mean(loss, window))
    return g.row(f"rsi({x.key},{window})", [ratio], lambda r: 100 - 100 / (1 + r), may_inf=False)


def band_position(g: Graph, x: Node, top: Node, bottom: Node) -> Node:
    """(x - bottom) / (top - bottom)"""
    above = g.row(f"({x.key}-{bottom.key})", [x, bottom], lambda a, b: a - b)
    extent = g.row(f"({top.key}-{bottom.key})", [top, bottom], lambda a, b: a - b)
    return g.div(above, extent)


def scaled(g: Graph, x: Node, factor: float) -> Node:
    return g.row(f"{factor!r}*{x.key}", [x], lambda v: v * factor)


def minus(g: Graph, a: Node, b: Node) -> Node:
    return g.row(f"({a.key}-{b.key})", [a, b], lambda x, y: x - y)
