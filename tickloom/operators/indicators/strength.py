"""Strength and direction of a trend."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators.blocks import SLOT
from tickloom.operators.graph import Graph, Node
from tickloom.operators.indicators.common import minus, scaled, true_range
from tickloom.operators.indicators.trend import chain
from tickloom.operators.registry import indicator


def _directional(g: Graph, window: int, up: bool) -> Node:
    rise = g.diff(g.source("high"))
    fall = scaled(g, g.diff(g.source("low")), -1.0)
    mine, other = (rise, fall) if up else (fall, rise)
    moved = g.row(
        f"dm({up})", [mine, other], lambda m, o: F.when((m > o) & (m > 0), m).otherwise(F.lit(0.0))
    )
    ratio = g.div(g.span(moved, window, deep=True), g.span(true_range(g), window, deep=True))
    return scaled(g, ratio, 100.0)


@indicator("DIPlus")
def di_plus(g: Graph, window: int = 14) -> Node:
    return _directional(g, window, up=True)


@indicator("DIMinus")
def di_minus(g: Graph, window: int = 14) -> Node:
    return _directional(g, window, up=False)


def directional_index(g: Graph, window: int) -> Node:
    return g.row(
        f"dx({window})",
        [di_plus(g, window), di_minus(g, window)],
        lambda p, m: 100 * F.abs(p - m) / F.when(p + m == 0, 1.0).otherwise(p + m),
    )


@indicator("ADX")
def adx(g: Graph, window: int = 14) -> Node:
    return g.span(directional_index(g, window), window)


def _aroon(g: Graph, window: int, up: bool) -> Node:
    """100 * (place of the earliest extreme in the window, 1..n) / n"""
    x = g.finite(g.source("high" if up else "low"))

    def make():
        w = g.rows_before(window)
        if up:
            best = -F.max(F.struct(F.col(x.column), -F.col(SLOT))).over(w)["col2"]
        else:
            best = F.min(F.struct(F.col(x.column), F.col(SLOT))).over(w)[SLOT]
        place = window - (F.col(SLOT) - best)
        return F.when(F.count(F.lit(1)).over(w) == window, place / F.lit(float(window)) * 100)

    return g.window(f"aroon({window},{up})", [x], make, window - 1)


@indicator("AroonUp")
def aroon_up(g: Graph, window: int = 25) -> Node:
    return _aroon(g, window, up=True)


@indicator("AroonDown")
def aroon_down(g: Graph, window: int = 25) -> Node:
    return _aroon(g, window, up=False)


@indicator("AroonOsc")
def aroon_osc(g: Graph, window: int = 25) -> Node:
    return minus(g, aroon_up(g, window), aroon_down(g, window))


def _vortex(g: Graph, window: int, here: str, before: str) -> Node:
    reach = g.row(f"|{here}-{before}'|", [g.source(here), g.lag(g.source(before), 1)], lambda a, b: F.abs(a - b))
    return g.div(g.sum(reach, window), g.sum(true_range(g), window))


@indicator("VortexPlus")
def vortex_plus(g: Graph, window: int = 14) -> Node:
    return _vortex(g, window, "high", "low")


@indicator("VortexMinus")
def vortex_minus(g: Graph, window: int = 14) -> Node:
    return _vortex(g, window, "low", "high")


@indicator("TRIX")
def trix(g: Graph, window: int = 14, price_col: str = "close") -> Node:
    return scaled(g, g.pct(chain(g, g.source(price_col), window, 3)[-1]), 10000.0)
