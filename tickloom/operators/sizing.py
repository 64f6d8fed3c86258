"""Position sizes and trading costs as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SHARE = 0.95


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _capped(size: Column, value: Column, price: Column, cap: float) -> Column:
    return F.least(size, F.try_divide(value * cap, price))


def kelly_size(
    value: Column,
    price: Column,
    confidence: Column,
    win_rate: Column | float = 0.5,
    avg_win: Column | float = 0.02,
    avg_loss: Column | float = 0.01,
    *,
    fraction: float = 0.25,
    min_edge: float = 0.02,
    cap: float = MAX_SHARE,
) -> Column:
    """A share of the Kelly stake; 0 below the least edge or without a loss size."""
    w, gain, loss = _col(win_rate), _col(avg_win), _col(avg_loss)
    odds = F.try_divide(gain, loss)
    stake = F.try_divide(w * odds - (1 - w), odds)
    edge = w * gain - (1 - w) * loss
    share = F.greatest(F.lit(0.0), stake * fraction * confidence)
    size = _capped(F.try_divide(value * share, price), value, price, cap)
    return F.when((loss <= 0) | (edge < min_edge), F.lit(0.0)).otherwise(size)


def fixed_fractional_size(
    value: Column,
    price: Column,
    confidence: Column,
    stop: Column | None = None,
    *,
    risk: float = 0.02,
    default_stop: float = 0.02,
    cap: float = MAX_SHARE,
) -> Column:
    """Risk a fixed share of the portfolio against the stop distance."""
    given = F.lit(default_stop) if stop is None else F.coalesce(F.nullif(stop, F.lit(0.0)), F.lit(default_stop))
    return _capped(value * risk * confidence / given / price, value, price, cap)


def realized_volatility(n_returns: Column, spread: Column, lookback: int = 30) -> Column:
    """Yearly volatility from the population deviation of daily returns.

    A short history counts as 0.5, and no value is below 0.01.
    """
    yearly = F.when(n_returns < lookback, F.lit(0.5)).otherwise(spread * F.sqrt(F.lit(365.0)))
    return F.greatest(yearly, F.lit(0.01))


def volatility_parity_size(
    value: Column, price: Column, confidence: Column, volatility: Column, *, target: float = 0.15, cap: float = MAX_SHARE
) -> Column:
    share = F.least(F.try_divide(F.lit(target), volatility) * confidence, F.lit(cap))
    return _capped(value * share / price, value, price, cap)


# -- costs -------------------------------------------------------------------

# Fees, slippage in basis points, funding per eight hours.
MAKER_FEE = 0.0002
TAKER_FEE = 0.0005
SLIPPAGE_BPS = 5.0
FUNDING_RATE = 0.0001
FUNDING_HOURS = 8.0
TRADING_DAYS = 252


def vip_fee(base: Column | float, level: Column | int = 0) -> Column:
    """5% off per level up to 9; any other level pays the full fee."""
    tier = _col(level)
    return F.when(tier.between(0, 9), _col(base) * (1 - tier * 0.05)).otherwise(_col(base))


def _commission(notional: Column, maker: Column | bool, level: Column | int) -> Column:
    fee = F.when(_col(maker), vip_fee(MAKER_FEE, level)).otherwise(vip_fee(TAKER_FEE, level))
    return notional * fee


def _slippage(notional: Column, urgency: Column | float) -> Column:
    # Notional steps and the factor above each.
    impact = (
        F.when(notional > 1_000_000, 2.0).when(notional > 500_000, 1.5).when(notional > 100_000, 1.2).otherwise(1.0)
    )
    return notional * (F.lit(SLIPPAGE_BPS) * (_col(urgency) * 0.5 + 1) * impact / 10000)


def _breakdown(commission: Column, slippage: Column, funding: Column) -> Column:
    return F.struct(
        commission.alias("commission"),
        slippage.alias("slippage"),
        funding.alias("funding"),
        (commission + slippage + funding).alias("total"),
    )


def entry_cost(
    notional: Column, maker: Column | bool = False, urgency: Column | float = 0.5, level: Column | int = 0
) -> Column:
    """struct(commission, slippage, funding, total)"""
    return _breakdown(_commission(notional, maker, level), _slippage(notional, urgency), F.lit(0.0))


def exit_cost(
    notional: Column,
    hours: Column | float,
    maker: Column | bool = False,
    urgency: Column | float = 0.5,
    level: Column | int = 0,
) -> Column:
    funding = notional * FUNDING_RATE * (_col(hours) / FUNDING_HOURS)
    return _breakdown(_commission(notional, maker, level), _slippage(notional, urgency), funding)


def round_trip_cost(
    notional: Column,
    hours: Column | float,
    entry_maker: Column | bool = False,
    exit_maker: Column | bool = False,
    entry_urgency: Column | float = 0.5,
    exit_urgency: Column | float = 0.5,
    level: Column | int = 0,
) -> Column:
    """struct with total commission, slippage, funding and cost, and the cost in
    percent of the notional, which is also the move needed to break even."""
    first = entry_cost(notional, entry_maker, entry_urgency, level)
    last = exit_cost(notional, hours, exit_maker, exit_urgency, level)
    cost = first["total"] + last["total"]
    percent = F.try_divide(cost, notional) * 100
    return F.struct(
        (first["commission"] + last["commission"]).alias("total_commission"),
        (first["slippage"] + last["slippage"]).alias("total_slippage"),
        last["funding"].alias("total_funding"),
        cost.alias("total_cost"),
        percent.alias("cost_percentage"),
        percent.alias("breakeven_move"),
    )


def annual_cost(
    position: Column,
    trades_per_day: Column | float,
    hours: Column | float,
    maker_ratio: Column | float = 0.5,
    level: Column | int = 0,
) -> Column:
    """struct of yearly costs for a mean position size."""
    maker = _col(maker_ratio)
    fee = vip_fee(MAKER_FEE, level) * maker + vip_fee(TAKER_FEE, level) * (1 - maker)
    trades = _col(trades_per_day) * TRADING_DAYS
    commission = position * fee * 2 * trades
    slippage = position * (SLIPPAGE_BPS / 10000) * 2 * trades
    funding = position * FUNDING_RATE * (_col(hours) / FUNDING_HOURS) * trades
    total = commission + slippage + funding
    return F.struct(
        commission.alias("annual_commission"),
        slippage.alias("annual_slippage"),
        funding.alias("annual_funding"),
        total.alias("total_annual_costs"),
        F.try_divide(total, trades).alias("cost_per_trade"),
        (total / TRADING_DAYS).alias("daily_costs"),
    )
