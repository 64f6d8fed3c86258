"""Stops, reversals and pivots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.blocks import BLOCK, Series, place, running
from tickloom.operators.graph import Graph, Node
from tickloom.operators.indicators.volatility import atr
from tickloom.operators.registry import indicator
from tickloom.operators.sequential import (
    EXTEND,
    Machine,
    missing_to_null,
    parabolic,
    reversals,
    trailing_band,
)


@dataclass(frozen=True)
class Ordered:
    """An indicator that needs one ordered pass.

    `inputs` are graph columns the machine reads besides the bar columns;
    `finish` turns the machine's outputs into the column `name`.
    """

    key: str
    machine: Machine
    inputs: dict[str, Node]
    finish: Callable[[DataFrame, Series, str], DataFrame]


@indicator("PSAR")
def psar(g: Graph, af: float = 0.02, max_af: float = 0.2) -> Ordered:
    machine = parabolic(af, max_af, f"_psar_{af}_{max_af}_".replace(".", "p"))
    stop = machine.outputs[0]
    return Ordered(stop, machine, {}, lambda df, series, name: df.withColumn(name, F.col(stop)))


@indicator("PSARTrend")
def psar_trend(g: Graph, af: float = 0.02, max_af: float = 0.2) -> Ordered:
    base = psar(g, af, max_af)
    above = F.when(F.col("close") > F.col(base.key), 1.0).when(F.col("close") <= F.col(base.key), -1.0)
    return Ordered(base.key, base.machine, {}, lambda df, series, name: df.withColumn(name, above))


@indicator("SuperTrend")
def super_trend(g: Graph, window: int = 10, mult: float = 3.0) -> Ordered:
    reach = f"_atr_{window}"
    machine = trailing_band(mult, reach, f"_super_{window}_{mult}_".replace(".", "p"))
    line = machine.outputs[0]
    return Ordered(
        line, machine, {reach: atr(g, window)}, lambda df, series, name: df.withColumn(name, F.col(line))
    )


@indicator("ZigZag")
def zig_zag(g: Graph, pct: float = 5.0) -> Ordered:
    machine = reversals(pct / 100.0, f"_zigzag_{pct}_".replace(".", "p"))
    kind, price = machine.outputs

    def finish(df: DataFrame, series: Series, name: str) -> DataFrame:
        df = place(missing_to_null(df, machine.outputs), series)
        df = running(df, series, {"_following": ("after", F.col(kind))})
        # An end of a leg that a later extension moves is no pivot.
        stays = F.col(kind).isNotNull() & (F.coalesce(F.col("_following"), F.lit(0.0)) != EXTEND)
        df = running(df, series, {name: ("last", F.when(stays, F.col(price)))})
        return df.drop("_following", BLOCK)

    return Ordered(kind, machine, {}, finish)


def _pivot(g: Graph, window: int, high: bool) -> Node:
    x = g.source("high" if high else "low")
    best = F.max if high else F.min

    def make():
        here = F.col(x.column)
        left, right = g.frame(-window, -1), g.frame(1, window)
        whole = (F.count(x.column).over(left) == window) & (F.count(x.column).over(right) == window)
        before, after = best(x.column).over(left), best(x.column).over(right)
        beats = (here > before) & (here >= after) if high else (here < before) & (here <= after)
        return F.when(whole & beats, here).otherwise(F.lit(0.0))

    return g.window(f"pivot({x.key},{window})", [x], make, window, window)


@indicator("PivotHigh")
def pivot_high(g: Graph, window: int = 5) -> Node:
    return _pivot(g, window, high=True)


@indicator("PivotLow")
def pivot_low(g: Graph, window: int = 5) -> Node:
    return _pivot(g, window, high=False)
