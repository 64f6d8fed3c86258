"""Profit and loss of positions, trade screening and portfolio reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import BLOCK, SLOT, Series, join_on, place, row_slots, running, running_rows
from tickloom.operators.drawdown import position_scale
from tickloom.operators.sizing import annual_cost, entry_cost, kelly_size, round_trip_cost


# Parts of the ids, and the number of closes above which a part is summed over blocks.
PARTS = 4096
CROWD = 1 << 20


def _crowded(closes: DataFrame, id: str, crowd: int) -> list[int]:
    """The parts of the ids with far more closes than others; one count per part goes to the driver."""
    counts = dict(closes.groupBy(_part(id)).count().collect())
    return sorted(part for part, n in counts.items() if n > max(crowd, 4 * sum(counts.values()) / PARTS))


def _part(id: str) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(PARTS)).cast("int")


def close_positions(
    opens: DataFrame, closes: DataFrame, *, id: str = "position_id", crowd: int = CROWD, carry: Sequence[str] = ()
) -> DataFrame:
    """Profit and loss of each close.

    opens: (id, size, entry_price, position_type, entry_time); `carry` names further
        columns that a close takes over from its open.
    closes: (id, close_seq, exit_price, exit_size, exit_time); an exit_size of
        NULL or 0 closes what is left.
    A close of an unknown position, or of one that an earlier close used up,
    realizes 0. Earlier closes are summed where the closes of an id meet its open,
    after one shuffle of each; those of ids among very many closes (`crowd`) as
    running totals over blocks, so a position with very many closes is no single
    task. `closes` is read twice.
    """
    given = F.nullif(F.col("exit_size"), F.lit(0.0))
    order = [F.col("exit_time"), F.col("close_seq")]
    totals = {"_sold": ("sum", F.coalesce(given, F.lit(0.0))), "_whole": ("sum", given.isNull().cast("long"))}
    crowded = _crowded(closes, id, crowd)
    upto = Window.partitionBy(id).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The part of a missing id is known as well, so no close is left out.
    plain = closes.where(~_part(id).isin(crowded)) if crowded else closes
    summed = plain.withColumns({name: F.sum(value).over(upto) for name, (_, value) in totals.items()})
    if crowded:
        numbered = row_slots(closes.where(_part(id).isin(crowded)), [id], order, F.to_date("exit_time"))
        series = Series((id,))
        summed = summed.unionByName(running(place(numbered, series), series, totals).drop(SLOT, BLOCK))
    earlier = F.col("_sold") - F.coalesce(given, F.lit(0.0))
    full_before = F.col("_whole") - given.isNull().cast("long")
    known = opens.select(id, "size", "entry_price", "position_type", "entry_time", *carry, F.lit(True).alias("_known"))
    joined = summed.withColumns({"_earlier": earlier, "_full_before": full_before}).join(known, id, "left")
    alive = F.col("_known").isNotNull() & (F.col("_full_before") == 0) & (F.col("_earlier") < F.col("size"))
    left = F.col("size") - F.col("_earlier")
    amount = F.coalesce(given, left)
    move = F.when(F.col("position_type") == "long", F.col("exit_price") - F.col("entry_price")).otherwise(
        F.col("entry_price") - F.col("exit_price")
    )
    hours = (F.unix_micros("exit_time") - F.unix_micros("entry_time")) / 3.6e9
    staged = joined.withColumns({"_alive": alive, "_amount": amount, "_hours": hours}).withColumns(
        {"gross_pnl": move * F.col("_amount"), "_notional": F.col("_amount") * F.col("entry_price")}
    )
    costs = round_trip_cost(F.col("_notional"), F.col("_hours"))["total_cost"]
    priced = staged.withColumn("costs", costs).withColumn("net_pnl", F.col("gross_pnl") - F.col("costs"))

    def realized(x: Column) -> Column:
        return F.when(F.col("_alive"), x).otherwise(F.lit(0.0))

    return priced.select(
        *closes.columns,
        *(realized(F.col(c)).alias(c) for c in ("gross_pnl", "costs", "net_pnl")),
        realized(F.try_divide(F.col("net_pnl"), F.col("_notional")) * 100).alias("return_pct"),
        F.when(F.col("_alive"), F.greatest(left - F.col("_amount"), F.lit(0.0))).alias("remaining_size"),
        F.when(F.col("_alive"), F.least(left, F.col("_amount")) * F.col("entry_price")).alias("closed_value"),
        *carry,
        F.coalesce("_alive", F.lit(False)).alias("known"),
    )


def daily_pnl(closed: DataFrame, time: str = "exit_time") -> DataFrame:
    return closed.groupBy(F.to_date(time).alias("date")).agg(
        F.sum("net_pnl").alias("daily_pnl"), F.count(F.lit(1)).alias("closes")
    )


def running_daily_pnl(closed: DataFrame, time: str = "exit_time", order: Sequence[str] = ("close_seq",)) -> DataFrame:
    """The profit and loss of the day so far after each close."""
    dated = closed.withColumn("_day", F.to_date(time))
    places = [F.col(time), *(F.col(c) for c in order)]
    totals = {"daily_pnl": ("sum", F.col("net_pnl"))}
    return running_rows(dated, ["_day"], places, F.date_trunc("minute", F.col(time)), totals).drop("_day")


def max_loss(notional: Column) -> Column:
    """A 2% stop plus a round trip held for a day."""
    return notional * 0.02 + round_trip_cost(notional, 24.0)["total_cost"]


def account_moves(opens: DataFrame, closed: DataFrame, *, account: str = "account", id: str = "position_id", time: str = "ts") -> DataFrame:
    """What changes an account at each moment: one row for all closes and one for all opens of it.

    opens: (id, account, size, entry_price, entry_time); closed: the result of
    `close_positions`, with the account carried along or not. `_kind` is 0 for closes
    and 2 for opens; `_pnl`, `_count` and `_cash` add to profit, open positions and
    their entry value. Copies of a moment merge before they are shuffled.
    """
    done = closed.where("known")
    if account not in closed.columns:
        done = done.join(opens.select(id, account), id)
    # What a close takes off is its part of the entry value; the last one of a position ends it.
    ended = F.when(F.col("remaining_size") == 0, -1).otherwise(0).cast("long")
    taken = done.groupBy(account, F.col("exit_time").alias(time)).agg(
        F.sum("net_pnl").alias("_pnl"), F.sum(ended).alias("_count"), F.sum(-F.col("closed_value")).alias("_cash")
    )
    opened = opens.groupBy(account, F.col("entry_time").alias(time)).agg(
        F.lit(0.0).alias("_pnl"), F.count(F.lit(1)).alias("_count"), F.sum(F.col("size") * F.col("entry_price")).alias("_cash")
    )
    return taken.withColumn("_kind", F.lit(0)).unionByName(opened.withColumn("_kind", F.lit(2)))


def account_state(
    signals: DataFrame,
    opens: DataFrame,
    closed: DataFrame,
    guard: DataFrame | None = None,
    *,
    account: str = "account",
    id: str = "position_id",
    time: str = "ts",
    start_value: float = 100000.0,
) -> DataFrame:
    """The signals with the state of their account at their time.

    opens and closed: as in `account_moves`; guard: the result of `drawdown_guard`,
    keyed by account and `time`. Adds open_positions, open_exposure, daily_pnl,
    portfolio_value and, with a guard, drawdown and drawdown_triggered, so
    `screen_trades` can follow.
    """
    moves = account_moves(opens, closed, account=account, id=id, time=time)
    return state_at(signals, moves, guard, account=account, time=time, start_value=start_value)


def state_at(
    signals: DataFrame, moves: DataFrame, guard: DataFrame | None = None, *, account: str = "account", time: str = "ts", start_value: float = 100000.0
) -> DataFrame:
    """`account_state` from the moves of the accounts.

    Events of all kinds are put on one line per account; a signal comes after
    closes and guard rows of its time and before opens of its time. The state is
    a set of running totals over blocks of that line. Signals of one account and time
    see the same state, so only their moments are put there.
    """
    rest = [c for c in signals.columns if c not in (account, time)]
    asked = signals.select(account, time)
    events = moves.unionByName((asked.distinct() if rest else asked).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    if guard is not None:
        status = F.struct(*(c for c in guard.columns if c not in (account, time)))
        events = events.unionByName(guard.select(account, time, F.lit(0).alias("_kind"), status.alias("_guard")), allowMissingColumns=True)
    # Rows of equal time and kind differ in nothing that a signal can see.
    places = [F.col(time), F.col("_kind")]
    totals = {
        "_open": ("sum", F.col("_count")),
        "_exposure": ("sum", F.col("_cash")),
        "_gain": ("sum", F.col("_pnl")),
        "_today": ("sum", F.col("_pnl"), F.to_date),
    }
    if guard is not None:
        totals["_status"] = ("last", F.col("_guard"))
    state = running_rows(events, [account], places, F.date_trunc("hour", F.col(time)), totals).where("_kind = 1")
    gain = F.coalesce(F.col("_gain"), F.lit(0.0))
    added = {
        "open_positions": F.coalesce(F.col("_open"), F.lit(0)),
        "open_exposure": F.coalesce(F.col("_exposure"), F.lit(0.0)),
        "daily_pnl": F.coalesce(F.col("_today"), F.lit(0.0)),
        "portfolio_value": gain + start_value,
    }
    if guard is not None:
        added["drawdown"] = F.coalesce(F.col("_status.current_drawdown"), F.lit(0.0))
        added["drawdown_triggered"] = F.coalesce(F.col("_status.is_triggered"), F.lit(False))
        added["drawdown_status"] = F.col("_status")
    state = state.select(account, time, *(value.alias(c) for c, value in added.items()))
    kept = [c for c in signals.columns if c not in added]
    return join_on(signals.select(*kept), state, [account, time]).select(*kept, *added) if rest else state


def portfolio_updates(moves: DataFrame, *, account: str = "account", time: str = "ts", start_value: float = 100000.0) -> DataFrame:
    """(account, time, equity): the portfolio value after the closes of each moment, as `drawdown_guard` reads it."""
    moments = moves.where("_kind = 0").select(account, time, "_pnl")
    summed = running_rows(moments, [account], [F.col(time)], F.to_date(time), {"_gain": ("sum", F.col("_pnl"))})
    return summed.select(account, time, (F.col("_gain") + start_value).alias("equity"))


def constraint(max_daily_loss: float, max_positions: int) -> Column:
    """Why an account may not trade in its state; NULL where it may."""
    value = F.col("portfolio_value")
    moved = F.when(value > 0, F.abs(F.try_divide(F.col("daily_pnl"), value))).otherwise(F.lit(0.0))
    # The texts of the rejections.
    return (
        F.when(F.col("drawdown_triggered"), "Drawdown guard triggered")
        .when(moved > max_daily_loss, "Daily loss limit exceeded")
        .when(F.col("open_positions") >= max_positions, "Maximum positions reached")
    )


def screen_trades(
    signals: DataFrame,
    *,
    max_drawdown: float = 0.10,
    max_daily_loss: float = 0.05,
    max_positions: int = 3,
    win_rate: Column | float = 0.5,
    avg_win: Column | float = 0.02,
    avg_loss: Column | float = 0.01,
    min_edge: float = 0.02,
    limit_order: Column | bool = False,
    urgency: Column | float = 0.5,
) -> DataFrame:
    """Approve or reject each signal against the account state in its row.

    Reads portfolio_value, price, confidence, drawdown, drawdown_triggered,
    daily_pnl and open_positions.
    """
    value, price = F.col("portfolio_value"), F.col("price")
    scale = position_scale(F.col("drawdown"), F.col("drawdown_triggered"), max_drawdown)
    sized = signals.withColumns({"risk_multiplier": scale, "adjusted_confidence": F.col("confidence") * scale})
    size = kelly_size(value, price, F.col("adjusted_confidence"), win_rate, avg_win, avg_loss, min_edge=min_edge)
    sized = sized.withColumn("_size", size).withColumn("_notional", F.col("_size") * price)
    small = F.when(F.col("_notional") < value * 0.01, "Position size below minimum")
    reason = F.coalesce(constraint(max_daily_loss, max_positions), small)
    judged = sized.withColumn("reason", reason).withColumn("approved", F.col("reason").isNull())

    def granted(x: Column) -> Column:
        return F.when(F.col("approved"), x)

    return judged.select(
        *signals.columns,
        "approved",
        "reason",
        F.coalesce(granted(F.col("_size")), F.lit(0.0)).alias("position_size"),
        granted(F.col("_notional")).alias("notional_value"),
        granted(entry_cost(F.col("_notional"), limit_order, urgency)).alias("entry_costs"),
        granted(F.col("risk_multiplier")).alias("risk_multiplier"),
        granted(F.col("adjusted_confidence")).alias("adjusted_confidence"),
        granted(max_loss(F.col("_notional"))).alias("max_loss"),
    )


def portfolio_metrics(state: DataFrame, *, max_daily_loss: float = 0.05, max_positions: int = 3) -> DataFrame:
    """The metrics of an account at each row of `account_state`.

    Adds exposure_pct, daily_return, can_trade and the reason why not;
    drawdown_status comes with the state.
    """

    def share(x: str) -> Column:
        whole = F.col("portfolio_value")
        return F.when(whole > 0, F.try_divide(F.col(x), whole) * 100).otherwise(F.lit(0.0))

    reason = constraint(max_daily_loss, max_positions)
    return state.withColumns(
        {
            "exposure_pct": share("open_exposure"),
            "daily_return": share("daily_pnl"),
            "can_trade": reason.isNull(),
            "reason": reason,
        }
    )


def risk_report(
    state: DataFrame, *, max_drawdown: float = 0.10, max_daily_loss: float = 0.05, max_positions: int = 3
) -> DataFrame:
    """Counts, limits and the yearly cost at the mean open position with ten trades a day, for each row of `account_state`."""
    mean = F.coalesce(F.try_divide(F.col("open_exposure"), F.col("open_positions")), F.lit(0.0))
    return state.withColumns(
        {
            "max_drawdown": F.lit(max_drawdown),
            "max_daily_loss": F.lit(max_daily_loss),
            "max_positions": F.lit(max_positions),
            "cost_estimates": annual_cost(mean, 10, 24),
        }
    )
