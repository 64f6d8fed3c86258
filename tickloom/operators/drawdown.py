"""Drawdown of an equity curve over a trailing window of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.blocks import DEFAULT_ROWS, SLOT, Series, join_on, row_slots
from tickloom.operators.ranges import trailing_status
from tickloom.operators.sequential import WARM_UP, guard, ordered_pass
from tickloom.session import materialize

DAY = 86400
MICROS = 1_000_000


def position_scale(drawdown: Column, triggered: Column, limit: float = 0.10, scale: bool = True) -> Column:
    """Share of the normal position size allowed in a drawdown."""
    if not scale:
        return F.when(triggered, F.lit(0.0)).otherwise(F.lit(1.0))
    # Steps of the limit and the size allowed below each.
    return (
        F.when(triggered, 0.1)
        .when(drawdown < limit * 0.5, 1.0)
        .when(drawdown < limit * 0.75, 0.75)
        .when(drawdown < limit * 0.9, 0.5)
        .otherwise(0.25)
    )


def drawdown_guard(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("account",),
    time: str = "ts",
    order: Sequence[str] | None = None,
    equity: str = "equity",
    limit: float = 0.10,
    lookback_days: int = 30,
    recovery_days: int = 7,
    scale_positions: bool = True,
    block_rows: int = DEFAULT_ROWS,
    warm_up: int = WARM_UP,
) -> DataFrame:
    """The status after every equity update.

    order: columns that order the updates; they start with `time` and make
        updates of the same time distinct.
    """
    order = list(order or [time])
    series = Series(tuple(keys), block_rows)
    slots = row_slots(df, keys, [F.col(c) for c in order], F.to_date(time))
    # Read again for the windows and the result; what lies between has few columns.
    numbered = materialize(slots.withColumn("_at", F.unix_micros(time)))
    found = trailing_status(numbered, series, lookback_days * DAY * MICROS, "_at", equity)
    top, now = F.col("high"), F.col("x")
    fall = F.when(top > 0, F.try_divide(top - now, top)).otherwise(F.lit(0.0))
    measured = found.select(
        *keys,
        SLOT,
        top.alias("peak_equity"),
        F.greatest("fall", F.lit(0.0)).alias("max_drawdown"),
        fall.alias("current_drawdown"),
        F.floor((F.col("at") - F.col("near_at")) / F.lit(DAY * MICROS)).cast("long").alias("days_in_drawdown"),
        (F.col("at") / 1e6).alias("_clock"),
    )
    machine = guard(limit, recovery_days * DAY, "current_drawdown", "_clock", "_active")
    flagged = ordered_pass(measured, series, [machine], warm_up)
    active = F.col("_active") > 0
    return join_on(numbered, flagged, [*keys, SLOT]).select(
        *df.columns,
        "peak_equity",
        "max_drawdown",
        "current_drawdown",
        active.alias("is_triggered"),
        position_scale(F.col("current_drawdown"), active, limit, scale_positions).alias("position_scale"),
        "days_in_drawdown",
    )
