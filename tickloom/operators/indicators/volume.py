"""Price moves weighted by volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators.graph import Graph, Node
from tickloom.operators.indicators.common import location, median_price, minus, product, scaled, typical
from tickloom.operators.registry import indicator


@indicator("OBV")
def obv(g: Graph) -> Node:
    signed = g.row(
        "obv.step",
        [g.source("volume"), g.diff(g.source("close")), g.first_row()],
        lambda v, d, first: F.when(first, v).otherwise(v * F.coalesce(F.signum(d), F.lit(0.0))),
    )
    return g.total("obv", "sum", signed)


@indicator("AD")
def ad(g: Graph) -> Node:
    return g.total("ad", "sum", product(g, location(g), g.source("volume")))


@indicator("ADL")
def adl(g: Graph) -> Node:
    return ad(g)


@indicator("CMF")
def cmf(g: Graph, window: int = 20) -> Node:
    volume = g.source("volume")
    return g.div(g.sum(product(g, location(g), volume), window), g.sum(volume, window))


@indicator("EMV")
def emv(g: Graph, window: int = 14) -> Node:
    extent = minus(g, g.source("high"), g.source("low"))
    box = g.div(scaled(g, g.source("volume"), 1e-6), extent)
    ease = g.row(
        "ease",
        [g.diff(median_price(g)), box],
        lambda d, b: F.when(F.abs(b) == float("inf"), d * 0.0)
        .when(b == 0, F.when(d > 0, float("inf")).when(d < 0, float("-inf")))
        .otherwise(F.try_divide(d, b)),
        may_inf=True,
    )
    return g.mean(ease, window)


@indicator("ForceIndex")
def force_index(g: Graph, window: int = 13) -> Node:
    return g.span(product(g, g.diff(g.source("close")), g.source("volume")), window)


def _index_on(g: Graph, name: str, rises: bool) -> Node:
    """1000 times the product of returns on rows where volume rose or fell."""
    volume = g.source("volume")
    growth = g.div(g.source("close"), g.lag(g.source("close"), 1))

    def factor(now, before, change):
        moved = now > before if rises else now < before
        return F.when(moved, change).otherwise(F.lit(1.0))

    step = g.row(f"{name}.step", [volume, g.lag(volume, 1), growth], factor)
    return g.row(name, [g.total(f"{name}.total", "product", step)], lambda x: x * 1000.0)


@indicator("NVI")
def nvi(g: Graph) -> Node:
    return _index_on(g, "nvi", rises=False)


@indicator("PVI")
def pvi(g: Graph) -> Node:
    return _index_on(g, "pvi", rises=True)


@indicator("VPT")
def vpt(g: Graph) -> Node:
    return g.total("vpt", "sum", product(g, g.source("volume"), g.pct(g.source("close"))))


@indicator("MFI")
def mfi(g: Graph, window: int = 14) -> Node:
    price = typical(g)
    flow, move = product(g, price, g.source("volume")), g.diff(price)
    gained = g.row("mfi.up", [flow, move], lambda f, d: F.when(d > 0, f).otherwise(F.lit(0.0)))
    lost = g.row("mfi.down", [flow, move], lambda f, d: F.when(d < 0, f).otherwise(F.lit(0.0)))
    # A window without outflow divides by this instead of 0.
    floor = 0.0001
    return g.row(
        f"mfi({window})",
        [g.sum(gained, window), g.sum(lost, window)],
        lambda up, down: 100 - 100 / (1 + up / F.when(down == 0, floor).otherwise(down)),
    )


@indicator("VWAP")
def vwap(g: Graph) -> Node:
    volume = g.source("volume")
    value = product(g, typical(g), volume)
    return g.div(g.total("vwap.value", "sum", value), g.total("vwap.volume", "sum", volume))


@indicator("VWMA")
def vwma(g: Graph, window: int = 20) -> Node:
    volume = g.source("volume")
    return g.div(g.sum(product(g, g.source("close"), volume), window), g.sum(volume, window))
