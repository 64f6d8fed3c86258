"""Analytics over recorded equity curves, one series per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import clip
from tickloom.operators.blocks import BLOCK, DEFAULT_ROWS, SLOT, Series, place, running
from tickloom.operators.graph import Graph, Node

HOURS_PER_YEAR = 24 * 365


def _returns(g: Graph, equity: str) -> tuple[Node, Node]:
    """(return with 0 on the first row, return missing on the first row)"""
    e = g.source(equity)
    open_end = g.div(g.diff(e), g.lag(e, 1))
    first = g.first_row()
    closed = g.row("step_return", [open_end, first], lambda r, f: F.when(f, F.lit(0.0)).otherwise(r))
    return closed, open_end


def _drawdown(g: Graph, equity: str) -> tuple[Node, Node]:
    """(peak with floor 0, drawdown from it)"""
    e = g.source(equity)
    top = g.row("peak", [g.total("peak.total", "max", e)], lambda p: F.greatest(p, F.lit(0.0)))
    fall = g.row(
        "drawdown", [top, e], lambda p, x: F.when(p > 0, F.try_divide(p - x, p)).otherwise(F.lit(0.0))
    )
    return top, fall


def _graph(df: DataFrame, keys: Sequence[str], step: str, block_rows: int) -> tuple[Graph, DataFrame]:
    sources = [c for c in df.columns if c not in keys]
    return Graph(Series(tuple(keys), block_rows), sources), df.withColumn(SLOT, F.col(step).cast("long"))


def equity_steps(
    df: DataFrame, *, keys: Sequence[str] = ("run_id",), step: str = "step", equity: str = "equity", block_rows: int = DEFAULT_ROWS
) -> DataFrame:
    """Add step_return, peak_equity and drawdown."""
    g, rows = _graph(df, keys, step, block_rows)
    top, fall = _drawdown(g, equity)
    return g.evaluate(
        rows, {"step_return": _returns(g, equity)[0], "peak_equity": top, "drawdown": fall}, df.columns
    )


def risk_balanced_score(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("run_id",),
    step: str = "step",
    equity: str = "equity",
    lookback: int = 100,
    risk_free_rate: float = 0.0,
    drawdown_penalty: float = 2.0,
    volatility_penalty: float = 1.5,
    low: float = -2.0,
    high: float = 5.0,
    block_rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Rolling Sharpe ratio less penalties, clipped.

    Reads trade_cost and holding_period. The ratio is 0 below 20 returns.
    """
    least = 20
    hourly = risk_free_rate / 252 / 24
    g, rows = _graph(df, keys, step, block_rows)
    ret = _returns(g, equity)[0]
    mean = g.rolling("mean", ret, lookback, F.avg, need=least)
    spread = g.rolling("pstd", ret, lookback, F.stddev_pop, need=least)
    recent = g.rolling("pstd", ret, least, F.stddev_pop)
    fall = _drawdown(g, equity)[1]
    sharpe = g.row(
        "sharpe", [mean, spread], lambda m, s: F.when(s > 0, F.try_divide(m - hourly, s)).otherwise(F.lit(0.0))
    )
    ratio = g.row("vol_ratio", [recent, spread], lambda r, s: F.when(s > 0, F.try_divide(r, s)))
    wild = g.row(
        "wild", [ratio], lambda r: F.when(r > 1.5, (r - 1.5) * volatility_penalty).otherwise(F.lit(0.0))
    )
    held = g.row(
        "held", [g.source("holding_period")], lambda h: F.when(h > 100, (h - 100) * 0.001).otherwise(F.lit(0.0))
    )
    cost = g.row("cost", [g.source("trade_cost")], lambda c: c * 10)
    score = g.row(
        "score",
        [sharpe, fall, wild, held, cost],
        lambda s, d, w, h, c: clip(s - d * drawdown_penalty - w - h - c, low, high),
    )
    outputs = {
        "sharpe_ratio": sharpe,
        "drawdown": fall,
        "volatility_penalty": wild,
        "holding_penalty": held,
        "trade_cost_penalty": cost,
        "score": score,
    }
    return g.evaluate(rows, outputs, df.columns)


def _curve(df: DataFrame, keys: Sequence[str], step: str, equity: str, block_rows: int) -> DataFrame:
    """Per row: return (missing on the first row) and fall from the running maximum."""
    g, rows = _graph(df, keys, step, block_rows)
    e = g.source(equity)
    fall = g.row("fall", [g.total("peak.total", "max", e), e], lambda p, x: F.try_divide(p - x, p))
    return g.evaluate(rows, {"_ret": _returns(g, equity)[1], "_fall": fall}, [*keys, step, equity])


def _spread(x: Column) -> Column:
    """Population deviation that is exactly 0 for equal values."""
    return F.when(F.max(x) == F.min(x), F.lit(0.0)).otherwise(F.stddev_pop(x))


def run_metrics(
    df: DataFrame, *, keys: Sequence[str] = ("run_id",), step: str = "step", equity: str = "equity",
    risk_free_rate: float = 0.0, block_rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Total return, largest drawdown, Sharpe ratio, win rate and profit factor per run."""
    ret = F.col("_ret")
    grouped = _curve(df, keys, step, equity, block_rows).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min_by(equity, step).alias("_first"),
        F.max_by(equity, step).alias("_last"),
        F.max("_fall").alias("_fall"),
        F.count(ret).alias("_n"),
        F.avg(ret).alias("_mean"),
        _spread(ret).alias("_std"),
        F.count(F.when(ret > 0, 1)).alias("_wins"),
        F.sum(F.when(ret > 0, ret)).alias("_gain"),
        F.sum(F.when(ret < 0, -ret)).alias("_loss"),
    )
    enough = F.col("_rows") >= 2
    zero = F.lit(0.0)

    def measured(x: Column) -> Column:
        return F.when(enough, x).otherwise(zero)

    hourly = risk_free_rate / 252 / 24
    sharpe = F.when(F.col("_std") > 0, F.try_divide(F.col("_mean") - hourly, F.col("_std"))).otherwise(zero)
    factor = F.when(F.col("_loss") > 0, F.coalesce(F.try_divide("_gain", "_loss"), zero)).otherwise(
        F.when(F.col("_wins") > 0, F.lit(float("inf"))).otherwise(zero)
    )
    return grouped.select(
        *keys,
        measured(F.try_divide(F.col("_last") - F.col("_first"), F.col("_first"))).alias("total_return"),
        measured(F.col("_fall")).alias("max_drawdown"),
        measured(sharpe).alias("sharpe_ratio"),
        measured(F.try_divide(F.col("_wins"), F.col("_n"))).alias("win_rate"),
        measured(factor).alias("profit_factor"),
    )


def detect_trades(
    df: DataFrame, *, keys: Sequence[str] = ("run_id",), step: str = "step", position: str = "position",
    threshold: float = 0.0001, block_rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Rows whose position differs from the row before, with the change and the
    return until the next trade (missing on the last trade and when flat)."""
    g, rows = _graph(df, keys, step, block_rows)
    moved = g.evaluate(rows, {"position_change": g.diff(g.source(position))}, [*df.columns, SLOT])
    traded = F.abs("position_change") > threshold
    series = Series(tuple(keys), block_rows)
    ahead = running(place(moved, series), series, {"_exit": ("after", F.when(traded, F.col("price")))})
    gain = F.col(position) * F.try_divide(F.col("_exit") - F.col("price"), F.col("price"))
    return (
        ahead.filter(traded)
        .withColumn("trade_return", F.when(F.col(position) != 0, gain))
        .drop("_exit", SLOT, BLOCK)
    )


def backtest_metrics(
    df: DataFrame, *, keys: Sequence[str] = ("run_id",), step: str = "step", equity: str = "equity", block_rows: int = DEFAULT_ROWS
) -> DataFrame:
    """The backtest report per run; shares are in percent.

    Where the returns do not vary, the yearly return and both ratios are 0.
    Runs of one row are left out.
    """
    ret = F.col("_ret")
    curve = _curve(df, keys, step, equity, block_rows).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min_by(equity, step).alias("_first"),
        F.max_by(equity, step).alias("final_equity"),
        F.max(equity).alias("best_equity"),
        F.min(equity).alias("worst_equity"),
        F.max("_fall").alias("_fall"),
        F.avg(ret).alias("_mean"),
        _spread(ret).alias("_std"),
        F.count(F.when(ret < 0, 1)).alias("_downs"),
        _spread(F.when(ret < 0, ret)).alias("_down_std"),
    )
    gain = F.col("trade_return")
    trades = detect_trades(df, keys=keys, step=step, block_rows=block_rows).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count(gain).alias("_closed"),
        F.count(F.when(gain > 0, 1)).alias("_wins"),
        F.count(F.when(gain < 0, 1)).alias("_losses"),
        F.avg(F.when(gain > 0, gain)).alias("_avg_win"),
        F.avg(F.when(gain < 0, gain)).alias("_avg_loss"),
        F.sum(F.when(gain > 0, gain)).alias("_won"),
        F.sum(F.when(gain < 0, -gain)).alias("_lost"),
    )
    zero, inf = F.lit(0.0), F.lit(float("inf"))
    varies = F.col("_std") > 0
    yearly = F.pow(1 + F.col("_mean"), F.lit(float(HOURS_PER_YEAR))) - 1
    root = HOURS_PER_YEAR**0.5
    both = curve.filter("_rows >= 2").join(trades, list(keys), "left").withColumn(
        "_yearly", F.when(varies, yearly).otherwise(zero)
    )
    sortino = F.when(
        F.col("_downs") > 0, F.when(F.col("_down_std") > 0, F.try_divide(F.col("_yearly"), F.col("_down_std") * root)).otherwise(zero)
    ).otherwise(F.when(F.col("_yearly") > 0, inf).otherwise(zero))
    factor = F.when(F.coalesce("_closed", F.lit(0)) == 0, zero).otherwise(
        F.when(F.col("_losses") == 0, inf).otherwise(F.coalesce(F.try_divide("_won", "_lost"), zero))
    )
    return both.select(
        *keys,
        (F.try_divide(F.col("final_equity") - F.col("_first"), F.col("_first")) * 100).alias("total_return"),
        (F.col("_yearly") * 100).alias("annualized_return"),
        (F.col("_fall") * 100).alias("max_drawdown"),
        F.when(varies, F.try_divide(F.col("_yearly"), F.col("_std") * root)).otherwise(zero).alias("sharpe_ratio"),
        F.when(varies, sortino).otherwise(zero).alias("sortino_ratio"),
        F.coalesce("n_trades", F.lit(0)).alias("n_trades"),
        (F.coalesce(F.try_divide("_wins", "_closed"), zero) * 100).alias("win_rate"),
        (F.coalesce("_avg_win", zero) * 100).alias("avg_win"),
        (F.coalesce("_avg_loss", zero) * 100).alias("avg_loss"),
        factor.alias("profit_factor"),
        "final_equity",
        "best_equity",
        "worst_equity",
    )


def run_summary(trades: DataFrame, curve: DataFrame, initial: float = 100000.0, *, keys: Sequence[str] = ("run_id",), step: str = "step") -> DataFrame:
    """Trade count, mean value, fees and final equity per run."""
    dealt = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.avg(F.abs("value")).alias("avg_trade_value"),
        F.sum("cost").alias("total_fees"),
    )
    ends = curve.groupBy(*keys).agg(F.max_by("equity", step).alias("final_equity"))
    return ends.join(dealt, list(keys), "left").select(
        *keys,
        F.coalesce("n_trades", F.lit(0)).alias("n_trades"),
        F.coalesce("avg_trade_value", F.lit(0.0)).alias("avg_trade_value"),
        F.coalesce("total_fees", F.lit(0.0)).alias("total_fees"),
        "final_equity",
        ((F.col("final_equity") - initial) / initial * 100).alias("total_return_pct"),
    )


def expanding_normalize(
    df: DataFrame,
    columns: Sequence[str],
    *,
    keys: Sequence[str] = ("run_id",),
    step: str = "step",
    warm: int = 100,
    bound: float = 10.0,
    block_rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Scale by the mean and deviation of all rows so far, this one included.

    Up to `warm` rows values are only clipped. Sums are taken about the first
    value of the series, which keeps them small.
    """
    series = Series(tuple(keys), block_rows)
    slotted = place(df.withColumn(SLOT, F.col(step).cast("long")), series)
    # min_by over a running frame: the value with the least step so far.
    origin = running(slotted, series, {"_start": ("min", F.struct(F.col(SLOT), *columns))})
    totals: dict[str, tuple[str, Column]] = {"_count": ("sum", F.lit(1))}
    for c in columns:
        away = F.col(c) - F.col(f"_start.{c}")
        totals[f"_s1_{c}"] = ("sum", away)
        totals[f"_s2_{c}"] = ("sum", away * away)
    summed = running(origin, series, totals)
    n = F.col("_count")
    made = {}
    for c in columns:
        shift, square = F.col(f"_s1_{c}"), F.col(f"_s2_{c}")
        mean = shift / n + F.col(f"_start.{c}")
        rest = F.greatest(square - shift * shift / n, F.lit(0.0))
        spread = F.sqrt(F.try_divide(rest, n - 1))
        scaled = F.try_divide(F.col(c) - mean, F.when(spread < 1e-8, F.lit(1.0)).otherwise(spread))
        made[f"{c}_norm"] = clip(F.when(n > warm, scaled).otherwise(F.col(c)), -bound, bound)
    return summed.withColumns(made).drop("_start", *totals, SLOT, BLOCK)


def across_runs(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, population deviation, least and greatest value of each metric."""
    long = metrics.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], list(columns), "metric", "value")
    return long.groupBy("metric").agg(
        F.count("value").alias("runs"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def action_histogram(df: DataFrame, column: str = "action", bins: int = 30) -> DataFrame:
    """Counts in equal bins between the least and greatest value.

    The two bounds are fetched first: two numbers, whatever the table.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, left double, count long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    bucket = F.least(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)) - 1
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(bucket.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("left", F.lit(low) + F.col("bin") * ((high - low) / bins))
    )
