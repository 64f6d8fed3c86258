"""Feature tables over one-second order-book snapshots."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import fdiv
from tickloom.operators.blocks import BLOCK, DEFAULT_ROWS, SLOT, Series, place, row_slots, running
from tickloom.operators.book import depth_notional, time_parts
from tickloom.operators.graph import Graph, Node
from tickloom.operators.indicators.common import band_position, minus, product, scaled
from tickloom.operators.indicators.momentum import commodity_channel
from tickloom.operators.indicators.statistical import slope

ROLLING_SECONDS = (10, 30, 60, 300)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with their place in the series; the first column of `order` is their time."""
    return row_slots(df, keys, [F.col(c) for c in order], F.date_trunc("hour", F.col(order[0])))


def row_features(df: DataFrame) -> DataFrame:
    """The daily features that need their row alone."""
    mid = F.col("mid_price")
    log_mid = F.when(mid > 0, F.ln(mid)).when(mid == 0, F.lit(float("-inf")))
    return depth_notional(time_parts(df)).withColumns(
        {"bid_ask_ratio": fdiv(F.col("best_bid"), F.col("best_ask")), "log_mid_price": log_mid}
    )


def daily_features(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts",),
    complete: bool = False,
    block_rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Time parts, ratios, depth notionals and rolling statistics of joined
    snapshot and trade rows (`mid_price`, `spread`, `quantity_sum`, ladder).

    Rows that are `numbered` already have been given their `row_features` before:
    they are shuffled with what is wanted of those alone."""
    base = df if SLOT in df.columns else numbered(row_features(df), keys, order)
    g = Graph(Series(tuple(keys), block_rows), ["mid_price", "spread", "quantity_sum"], complete)
    price, gap, traded = (g.source(c) for c in g.sources)
    outputs: dict[str, Node] = {"mid_price_change": g.diff(price), "mid_price_pct_change": g.pct(price)}
    for n in ROLLING_SECONDS:
        outputs[f"mid_price_mean_{n}s"] = g.mean(price, n)
        outputs[f"mid_price_std_{n}s"] = g.std(price, n)
        outputs[f"spread_mean_{n}s"] = g.mean(gap, n)
        outputs[f"volume_sum_{n}s"] = g.sum(traded, n)
    return g.evaluate(base, outputs)


# -- feature matrix --------------------------------------------------------


class _Matrix:
    """Builds the matrix columns; absent input columns give the neutral value."""

    def __init__(self, g: Graph):
        self.g = g
        self.mid = g.source("mid_price")
        self.asked: set[str] = set()

    def has(self, *columns: str) -> bool:
        self.asked.update(columns)
        return all(c in self.g.sources for c in columns)

    def constant(self, value: float) -> Node:
        return self.g.row(f"constant({value})", [], lambda: F.lit(float(value)), may_inf=False)

    def sum_of(self, key: str, columns: Sequence[str], weights: Sequence[float] | None = None) -> Node:
        nodes = [self.g.source(c) for c in columns if c in self.g.sources]
        w = list(weights) if weights else [1.0] * len(nodes)

        def make(*cols: Column) -> Column:
            out = cols[0] * w[0]
            for col, one in zip(cols[1:], w[1:], strict=False):
                out = out + col * one
            return out

        return self.g.row(f"sum_of({key})", nodes, make)

    def quantity(self, side: str, levels: int) -> Node:
        return self.sum_of(f"{side}_qty_{levels}", [f"{side}_{i}_qty" for i in range(levels)])

    def flag(self, key: str, deps: Sequence[Node], make: Callable[..., Column]) -> Node:
        """1 where the condition holds, 0 where it does not or is unknown."""
        return self.g.row(
            key, deps, lambda *c: F.coalesce(make(*c), F.lit(False)).cast("double"), may_inf=False
        )

    def volume(self) -> Node | None:
        if not self.has("buy_volume_1s", "sell_volume_1s"):
            return None
        return self.g.row(
            "volume_1s", [self.g.source("buy_volume_1s"), self.g.source("sell_volume_1s")], lambda a, b: a + b
        )

    # Each category returns output name -> node.

    def price_liquidity(self) -> dict[str, Node]:
        g, mid = self.g, self.mid
        out = {f"mid_price_delta_{n}s": g.diff(mid, n) for n in (1, 3, 5)}
        if self.has("vwap_1s"):
            vwap = g.source("vwap_1s")
            out["vwap_mid_diff"], out["vwap_mid_ratio"] = minus(g, vwap, mid), g.div(vwap, mid)
        else:
            out["vwap_mid_diff"], out["vwap_mid_ratio"] = self.constant(0), self.constant(1)
        spread = g.source("spread")
        mean, std = g.mean(spread, 10), g.std(spread, 10)
        out["spread_bps"] = scaled(g, g.source("spread_pct"), 100.0)
        out["spread_rolling_mean_10s"], out["spread_rolling_std_10s"] = mean, std
        out["spread_zscore"] = g.score(spread, 10)
        if self.has("bid_0_price", "bid_0_qty", "ask_0_price", "ask_0_qty"):
            bid, ask = g.source("bid_0_qty"), g.source("ask_0_qty")
            crossed = g.row(
                "crossed",
                [g.source("bid_0_price"), ask, g.source("ask_0_price"), bid],
                lambda bp, aq, ap, bq: bp * aq + ap * bq,
            )
            micro = g.div(crossed, g.row("top_qty", [bid, ask], lambda a, b: a + b))
            out["micro_price"], out["micro_price_diff"] = micro, minus(g, micro, mid)
        else:
            out["micro_price"], out["micro_price_diff"] = mid, self.constant(0)
        out["price_position_10s"] = band_position(g, mid, g.max(mid, 10), g.min(mid, 10))
        for side in ("bid", "ask"):
            if self.has("bid_0_qty"):
                share = g.div(g.source(f"{side}_0_qty"), self.quantity(side, 5))
            else:
                share = self.constant(0.2)
            out[f"{side}_concentration_l1"] = share
        out["effective_spread"] = g.row(
            "effective_spread", [g.lag(mid, -1), mid], lambda later, now: F.abs(later - now) * 2
        )
        for n in (1, 5, 10):
            ratio = g.div(mid, g.lag(mid, n))
            out[f"log_return_{n}s"] = g.row(
                f"ln({ratio.key})", [ratio], lambda r: F.when(r > 0, F.ln(r)).when(r == 0, F.lit(float("-inf")))
            )
        return out

    def order_flow(self) -> dict[str, Node]:
        g = self.g
        out = {}
        for i in range(5):
            if self.has(f"bid_{i}_qty", f"ask_{i}_qty"):
                out[f"ofi_level_{i}"] = minus(
                    g, g.diff(g.source(f"bid_{i}_qty")), g.diff(g.source(f"ask_{i}_qty"))
                )
            else:
                out[f"ofi_level_{i}"] = self.constant(0)
        flows = list(out.values())
        total = g.row("ofi_total", flows, lambda a, b, c, d, e: a + b + c + d + e)
        out["ofi_total"], out["ofi_cumsum_10s"] = total, g.sum(total, 10)
        for n in (1, 3, 5, 10):
            out[f"depth_imbalance_l{n}"] = g.row(
                f"imbalance({n})",
                [self.quantity("bid", n), self.quantity("ask", n)],
                lambda b, a: F.when(b + a > 0, F.try_divide(b - a, b + a)).otherwise(F.lit(0.0)),
            )
        bid, ask = self.quantity("bid", 5), self.quantity("ask", 5)
        changes = {"bid": g.diff(bid), "ask": g.diff(ask)}
        out["bid_depth_change_1s"], out["ask_depth_change_1s"] = changes["bid"], changes["ask"]
        out["total_depth_change_1s"] = g.row("depth_change", list(changes.values()), lambda b, a: b + a)
        if self.has(*(f"bid_{i}_price" for i in range(5))):
            weights = [1 - i / 10 for i in range(5)]
            wb = self.sum_of("weighted_bid", [f"bid_{i}_qty" for i in range(5)], weights)
            wa = self.sum_of("weighted_ask", [f"ask_{i}_qty" for i in range(5)], weights)
            out["weighted_depth_imbalance"] = g.div(
                minus(g, wb, wa), g.row("weighted_total", [wb, wa], lambda b, a: b + a)
            )
        else:
            out["weighted_depth_imbalance"] = (
                g.source("imbalance_5") if self.has("imbalance_5") else self.constant(0)
            )
        for side, amount in (("bid", bid), ("ask", ask)):
            best = f"best_{side}"
            out[f"{side}_intensity"] = g.div(amount, g.source(best)) if self.has(best) else self.constant(0)
        if self.volume() is not None:
            buy, sell = g.source("buy_volume_1s"), g.source("sell_volume_1s")
            net = minus(g, buy, sell)
            out["net_trade_flow"] = net
            if self.has("trade_imbalance"):
                out["trade_imbalance"] = g.source("trade_imbalance")
            else:
                padded = g.row("volume_1s+", [self.volume()], lambda v: v + 1e-8)
                out["trade_imbalance"] = g.div(net, padded)
        else:
            out["net_trade_flow"], out["trade_imbalance"] = self.constant(0), self.constant(0)
        return out

    def volatility(self) -> dict[str, Node]:
        g, mid = self.g, self.mid
        ret = g.pct(mid)
        out = {f"volatility_{n}s": g.std(ret, n) for n in (3, 10, 30, 60)}
        out["atr_14s"] = g.mean(minus(g, g.max(mid, 14), g.min(mid, 14)), 14)
        square = g.row("ret^2", [ret], lambda r: r * r)
        energy = g.sum(square, 30)
        out["realized_vol_30s"] = g.row("realized", [energy], F.sqrt)
        out["vol_ratio_10_30"] = g.div(out["volatility_10s"], out["volatility_30s"])
        out["vol_ratio_30_60"] = g.div(out["volatility_30s"], out["volatility_60s"])
        out["squared_returns"], out["vol_momentum"] = square, g.mean(square, 10)
        if self.has("bid_0_price", "ask_0_price"):
            gap = minus(g, g.source("ask_0_price"), g.source("bid_0_price"))
        else:
            gap = g.source("spread")
        out["spread_volatility_10s"] = g.std(gap, 10)
        calm = out["volatility_30s"]
        out["volatility_zscore"] = g.score(calm, 300)
        return out

    def wilder(self, x: Node, n: int) -> Node:
        """Smoothing with alpha = 1/n, given once n values are there."""
        g = self.g
        smooth, oldest = g.ewm(x, 1 / n, deep=True), g.lag(x, n - 1)
        return g.row(
            f"wilder({x.key},{n})", [smooth, oldest], lambda s, o: F.when(o.isNotNull(), s), may_inf=False
        )

    def momentum(self) -> dict[str, Node]:
        g, mid = self.g, self.mid
        move = g.diff(mid)
        gain = g.row("mid.gain", [move], lambda d: F.when(d > 0, d).when(d <= 0, F.lit(0.0)))
        loss = g.row("mid.loss", [move], lambda d: F.when(d < 0, -d).when(d >= 0, F.lit(0.0)))
        out = {}
        for n in (7, 14, 21):
            up, down = self.wilder(gain, n), self.wilder(loss, n)
            both = g.row(f"both({n})", [up, down], lambda u, d: u + d)
            out[f"rsi_{n}"] = scaled(g, g.div(up, both), 100.0)
        for n in (5, 10, 20):
            out[f"roc_{n}s"] = scaled(g, g.div(g.diff(mid, n), g.lag(mid, n)), 100.0)
        place_14 = band_position(g, mid, g.max(mid, 14), g.min(mid, 14))
        out["stoch_k"] = g.mean(scaled(g, place_14, 100.0), 3)
        out["stoch_d"] = g.mean(out["stoch_k"], 3)
        out["williams_r"] = g.row("williams_mid", [place_14], lambda p: (p - 1) * 100)
        out["cci_20"] = commodity_channel(g, mid, 20)
        if self.volume() is not None:
            flow = product(g, mid, product(g, mid, self.volume()))
            up = g.row("flow.up", [flow, move], lambda f, d: F.when(d > 0, f).when(d <= 0, F.lit(0.0)))
            down = g.row("flow.down", [flow, move], lambda f, d: F.when(d < 0, f).when(d >= 0, F.lit(0.0)))
            ups, downs = g.sum(up, 14), g.sum(down, 14)
            out["mfi_14"] = scaled(g, g.div(ups, g.row("flow.both", [ups, downs], lambda u, d: u + d)), 100.0)
        else:
            out["mfi_14"] = self.constant(50)
        out["momentum_10s"] = g.diff(mid, 10)
        return out

    def trend(self) -> dict[str, Node]:
        g, mid = self.g, self.mid
        out = {f"ema_{n}": g.span(mid, n) for n in (3, 9, 21, 50)}
        out["price_ema3_dist"] = g.div(minus(g, mid, out["ema_3"]), mid)
        out["price_ema9_dist"] = g.div(minus(g, mid, out["ema_9"]), mid)
        out["ema3_ema9_dist"] = g.div(minus(g, out["ema_3"], out["ema_9"]), out["ema_9"])
        line = minus(g, g.span(mid, 12), g.span(mid, 26))
        signal = g.span(line, 9)
        out["macd"], out["macd_signal"], out["macd_hist"] = line, signal, minus(g, line, signal)
        move = g.diff(mid)
        reach = g.row("|move|", [move], F.abs)
        parts = []
        for name, sign in (("up", 1), ("down", -1)):
            step = g.row(
                f"dm.{name}", [move], lambda d, s=sign: F.when(d * s > 0, d * s).when(d.isNotNull(), F.lit(0.0))
            )
            parts.append(g.div(g.ewm(step, 1 / 14, deep=True), g.ewm(reach, 1 / 14, deep=True)))
        spread = g.row(
            "mid.dx", parts, lambda p, m: F.abs(p - m) * 100 / F.when(p + m == 0, 1.0).otherwise(p + m), may_inf=False
        )
        out["adx"] = g.ewm(spread, 1 / 14)
        for n in (10, 30):
            out[f"linreg_slope_{n}s"] = slope(g, mid, n)
        return out

    def bands(self) -> dict[str, Node]:
        g, mid = self.g, self.mid
        out = {}

        def channel(prefix: str, top: Node, bottom: Node) -> None:
            out[f"{prefix}_upper"], out[f"{prefix}_lower"] = top, bottom
            out[f"{prefix}_position"] = band_position(g, mid, top, bottom)

        mean, std = g.mean(mid, 20), g.std(mid, 20)
        out["bb_upper"] = g.row("bb_top", [mean, std], lambda m, s: m + s * 2)
        out["bb_lower"] = g.row("bb_bottom", [mean, std], lambda m, s: m - s * 2)
        out["bb_position"] = g.row("bb_place", [g.score(mid, 20)], lambda z: (z + 2) / 4)
        out["bb_middle"], out["bb_width"] = mean, minus(g, out["bb_upper"], out["bb_lower"])
        reach = g.row("|move|", [g.diff(mid)], F.abs)
        middle, spread = g.span(mid, 20), g.span(reach, 20)
        channel(
            "kc",
            g.row("kc_top", [middle, spread], lambda m, s: m + F.coalesce(s, F.lit(0.0)) * 2),
            g.row("kc_bottom", [middle, spread], lambda m, s: m - F.coalesce(s, F.lit(0.0)) * 2),
        )
        channel("donchian", g.max(mid, 20), g.min(mid, 20))
        return out

    def volume_psychology(self) -> dict[str, Node]:
        g, mid = self.g, self.mid
        volume = self.volume()
        out = {}
        if volume is not None:
            signed = g.row("flow.sign", [volume, g.diff(mid)], lambda v, d: F.when(d > 0, v).otherwise(-v))
            out["obv"] = g.total("mid.obv", "sum", signed)
            out["vwma_10"] = g.div(g.sum(product(g, mid, volume), 10), g.sum(volume, 10))
            padded = g.row("sell+", [g.source("sell_volume_1s")], lambda v: v + 1e-8)
            out["volume_ratio_buy_sell"] = g.div(g.source("buy_volume_1s"), padded)
            out["volume_momentum_10s"] = g.div(g.mean(volume, 10), g.mean(volume, 30))
            out["large_order_indicator"] = self.flag(
                "large", [volume, g.mean(volume, 100), g.std(volume, 100)], lambda v, m, s: v > m + s * 2
            )
            # The change of obv over ten rows is the signed volume of those rows.
            obv_move = g.sum(signed, 10)
        else:
            out["obv"], out["vwma_10"] = self.constant(0), g.mean(mid, 10)
            out["volume_ratio_buy_sell"], out["volume_momentum_10s"] = self.constant(1), self.constant(1)
            out["large_order_indicator"] = self.constant(0)
            obv_move = g.lag(self.constant(0), 10)
        for side in ("bid", "ask"):
            amount = self.quantity(side, 10)
            pulled = g.row(f"pulled({side})", [g.diff(amount)], lambda d: F.abs(F.least(d, F.lit(0.0))))
            out[f"{side}_cancel_rate"] = g.div(
                pulled, g.row(f"{side}_qty+", [amount], lambda q: q + 1e-8)
            )
        out["distance_to_round_100"] = g.row("mod100", [mid], lambda p: F.pmod(p, F.lit(100.0)))
        out["distance_to_round_1000"] = g.row("mod1000", [mid], lambda p: F.pmod(p, F.lit(1000.0)))
        out["at_psychological_level"] = self.flag(
            "at_round",
            [out["distance_to_round_100"], out["distance_to_round_1000"]],
            lambda a, b: (a < 1) | (b < 10),
        )
        # An unknown direction on either side counts as a divergence.
        agree = self.flag(
            "agree", [g.diff(mid, 10), self._present_move(obv_move)], lambda p, o: F.signum(p) == F.signum(o)
        )
        out["momentum_divergence"] = g.row("divergence", [agree], lambda a: 1 - a)
        if self.has("_hour"):
            hour = g.source("_hour")
            turn = 2 * math.pi / 24
            out["hour_sin"] = g.row("hour_sin", [hour], lambda h: F.sin(h * turn))
            out["hour_cos"] = g.row("hour_cos", [hour], lambda h: F.cos(h * turn))
            for name, start in (("asian", 0), ("european", 8), ("us", 16)):
                out[f"is_{name}_session"] = self.flag(
                    f"session({name})", [hour], lambda h, s=start: (h >= s) & (h < s + 8)
                )
        return out

    def _present_move(self, move: Node) -> Node:
        """The change over ten rows exists from the eleventh row on."""
        eleventh = self.g.lag(self.mid, 10)
        return self.g.row(
            "obv_move", [move, eleventh], lambda m, first: F.when(first.isNotNull(), m), may_inf=False
        )


CATEGORIES = (
    "price_liquidity",
    "order_flow",
    "volatility",
    "momentum",
    "trend",
    "bands",
    "volume_psychology",
)
# Outputs that read the row after theirs.
LOOKS_AHEAD = ("effective_spread",)


HOUR_OF = "_hour"


def _matrix_graph(series: Series, categories: Sequence[str], columns: Sequence[str], complete: bool) -> tuple[Graph, dict[str, Node], set[str]]:
    """The graph, its outputs, and the columns that were asked for, there or not."""
    unknown = [c for c in categories if c not in CATEGORIES]
    if unknown:
        raise ValueError(f"unknown categories: {unknown}")
    g = Graph(series, [*columns, HOUR_OF], complete)
    matrix = _Matrix(g)
    outputs: dict[str, Node] = {}
    for category in categories:
        outputs.update(getattr(matrix, category)())
    return g, outputs, matrix.asked


def matrix_inputs(categories: Sequence[str], columns: Sequence[str]) -> list[str]:
    """The columns, among those there are, on which these categories of the matrix depend."""
    g, outputs, asked = _matrix_graph(Series(), categories, columns, True)
    needed = asked | set(g.reads(outputs.values()))
    return [c for c in columns if c in needed]


def feature_matrix(
    df: DataFrame,
    categories: Sequence[str] = CATEGORIES,
    *,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts",),
    complete: bool = False,
    fill: bool = True,
    block_rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """The feature matrix of snapshot rows with their trade flow.

    order: columns that order the rows of a series; the first is their time.
    complete: no input value is missing.
    fill: repeat the last value over gaps, then 0.
    """
    series = Series(tuple(keys), block_rows)
    g, outputs, _ = _matrix_graph(series, categories, [c for c in df.columns if c not in (*keys, *order)], complete)
    # Only what the categories read goes through the shuffles.
    needed = [c for c in g.reads(outputs.values()) if c != HOUR_OF]
    timed = numbered(df.select(*dict.fromkeys([*keys, *order]), *needed), keys, order)
    timed = timed.withColumn(HOUR_OF, F.hour(order[0]).cast("double"))
    shown = list(dict.fromkeys([*keys, *order]))
    made = g.evaluate(timed, outputs, [*shown, SLOT])
    if not fill:
        return made.drop(SLOT)
    gappy = [n for n, node in outputs.items() if not complete or g.can_miss(node)]
    if gappy:
        made = running(place(made, series), series, {n: ("last", F.col(n)) for n in gappy})
    return made.select(*shown, *(F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in outputs)).drop(SLOT, BLOCK)
