"""State machines over ordered series, parallel inside one series.

A machine reads rows in order and carries a small state. Each block is read once
and leaves its transfer function (`transfer`), which gives the leaving state for
any entering state. The blocks of a series are then walked in order, in a table
with one row per block. A machine that forgets its state within a few rows needs no
such function: the block guesses its entering state by running over the rows before
it. Where neither tells how a block is left, the leaving state is predicted, the
walk goes on and one round runs all such blocks; the walk is repeated until every
step of it is known: the result is that of one pass in order.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import transfer
from tickloom.operators.blocks import BLOCK, OWN, SLOT, STRETCH, Series, cuts, gather, join_on, place, with_halo
from tickloom.session import materialize

WARM_UP = 2048
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Machine:
    """`run(state, columns)` handles consecutive rows.

    `state` is None before the first row of a series. It returns one list per
    output column and the state after the last row, as floats. `transfer(columns,
    before)` gives the transfer function of consecutive rows as a list, `before`
    being the row ahead of them or None, and `follow(function, state)` the state it
    leaves with; an empty list or None says that the rows must be run.
    """

    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    run: Callable[[list[float] | None, list[list[float]]], tuple[list[list[float]], list[float]]]
    transfer: Callable[[list[list[float]], list[float] | None], list[float]] | None = None
    follow: Callable[[list[float], list[float]], list[float] | None] | None = None


def _step_all(machines: Sequence[Machine], states, lists: dict[str, list], rows: slice):
    """Run every machine over consecutive rows."""
    made, left = {}, []
    for machine, state in zip(machines, states, strict=True):
        columns = [lists[c][rows] for c in machine.inputs]
        results, end = machine.run(state, columns)
        made.update(zip(machine.outputs, results, strict=True))
        left.append([float(v) for v in end])
    return made, left


def _unpack(packed, machines):
    if packed is None or len(packed) == 0:
        return [None] * len(machines)
    return [list(map(float, part)) if len(part) else None for part in packed]


STATE = T.ArrayType(T.ArrayType(T.DoubleType()))


def ordered_pass(df: DataFrame, series: Series, machines: Sequence[Machine], warm_up: int = WARM_UP) -> DataFrame:
    """Add the outputs of the machines to `df`, which carries `_slot`."""
    # The rows are read several times, so what leads to them is run once.
    df = materialize(df)
    machines = list(machines)
    inputs = list(dict.fromkeys(c for m in machines for c in m.inputs))
    outputs = [c for m in machines for c in m.outputs]
    result_schema = T.StructType(
        [*place(df, series).schema.fields, *(T.StructField(c, T.DoubleType()) for c in outputs)]
    )
    order = [f.name for f in result_schema.fields]
    enter = _entering_states(df.select(*series.keys, SLOT, *inputs), series, machines, warm_up)
    stretch = [*series.keys, STRETCH]

    def resumed(frame: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame(columns=order)
        frame = frame.sort_values(SLOT, ignore_index=True)
        lists = {c: frame[c].tolist() for c in inputs}
        states = dict(zip(state[BLOCK].tolist(), state["enter"], strict=True))
        made: dict[str, list] = {c: [] for c in outputs}
        for block, begin, end in cuts(frame[BLOCK].to_numpy(np.int64)):
            results, _ = _step_all(machines, _unpack(states[block], machines), lists, slice(begin, end))
            for c, values in results.items():
                made[c] += values
        return frame.assign(**made)[order]

    return (
        gather(_stretched(df, series), stretch)
        .groupBy(*stretch)
        .cogroup(enter.withColumn(STRETCH, series.stretch_of(F.col(BLOCK))).groupBy(*stretch))
        .applyInPandas(resumed, result_schema)
        .drop(BLOCK)
    )


def _stretched(df: DataFrame, series: Series) -> DataFrame:
    """Blocks, and the stretches of short blocks that are handed to Python together."""
    placed = df.withColumn(BLOCK, series.block_of(F.col(SLOT)))
    return placed.withColumn(STRETCH, series.stretch_of(F.col(BLOCK)))


def _exact(state) -> tuple:
    return tuple(repr(float(v)) for v in state)


def _walk(machines: Sequence[Machine], tried: pd.DataFrame) -> list[tuple[int, list[list[float]], bool]]:
    """Entering state of every block of a series, and whether it is known how the block is left with it.

    `tried` has block, enter, leave, functions and round; the guess of a block and
    its transfer functions are in its row of round 0.
    """
    known: dict[int, list[dict[tuple, list]]] = {}
    guessed: dict[int, tuple[list, list]] = {}
    for block, enter, leave, functions, number in tried.itertuples(index=False):
        enter = _unpack(enter, machines)
        leave = _unpack(leave, machines)
        for seen, a, b in zip(known.setdefault(block, [{} for _ in machines]), enter, leave, strict=True):
            seen[_exact(a or [])] = b
        if number == 0:
            guessed[block] = leave, [list(map(float, f)) for f in functions]
    out, states = [], [None] * len(machines)
    for block in sorted(known):
        left, done = [], True
        for machine, state, seen, guess, function in zip(machines, states, known[block], *guessed[block], strict=True):
            after = seen.get(_exact(state or []))
            if after is None and state and function and machine.follow:
                after = machine.follow(function, state)
            if after is None:
                after, done = guess, False
            left.append(after)
        out.append((block, [s or [] for s in states], done))
        states = left
    return out


def _entering_states(df: DataFrame, series: Series, machines, warm_up: int) -> DataFrame:
    """(key, block, enter)."""
    home = series.home
    fields = [f for f in place(df, series).schema.fields if f.name in home]
    tail = [T.StructField(c, STATE) for c in ("enter", "leave", "functions")] + [T.StructField("round", T.LongType())]
    schema = T.StructType([*fields, *tail])

    names = [f.name for f in schema.fields]
    inputs = list(dict.fromkeys(c for m in machines for c in m.inputs))
    stretch = [*series.keys, STRETCH]

    def made(frame: pd.DataFrame, tried: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(tried, columns=[BLOCK, "enter", "leave", "functions", "round"])
        return out.assign(**{k: pd.Series([frame[k].iloc[0]] * len(out), dtype=frame[k].dtype) for k in series.keys})[names]

    nothing = pd.DataFrame(columns=names)

    def guess(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(SLOT, ignore_index=True)
        lists = {c: frame[c].tolist() for c in inputs}
        slot, own = frame[SLOT].to_numpy(np.int64), frame[OWN].to_numpy(bool)
        tried = []
        # Halo rows come before all others.
        for block, begin, end in cuts(np.where(own, slot // series.rows, np.iinfo(np.int64).min)):
            if not own[begin]:
                continue
            halo = int(np.searchsorted(slot, block * series.rows - warm_up))
            states = [None] * len(machines)
            functions = [[] for _ in machines]
            if halo < begin:
                _, states = _step_all(machines, states, lists, slice(halo, begin))
                functions = [
                    m.transfer([lists[c][begin:end] for c in m.inputs], [float(lists[c][begin - 1]) for c in m.inputs]) if m.transfer else []
                    for m in machines
                ]
            _, leave = _step_all(machines, states, lists, slice(begin, end))
            tried.append((block, states if halo < begin else [], leave, functions, 0))
        return made(frame, tried) if tried else nothing

    def again(number: int):
        def run(frame: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            if frame.empty or state.empty:
                return nothing
            frame = frame.sort_values(SLOT, ignore_index=True)
            lists = {c: frame[c].tolist() for c in inputs}
            states = dict(zip(state[BLOCK].tolist(), state["enter"], strict=True))
            tried = []
            for block, begin, end in cuts(frame[BLOCK].to_numpy(np.int64)):
                enter = _unpack(states[block], machines)
                _, leave = _step_all(machines, enter, lists, slice(begin, end))
                tried.append((block, [s or [] for s in enter], leave, [[] for _ in machines], number))
            return made(frame, tried)

        return run

    walked = T.StructType([*fields, T.StructField("enter", STATE), T.StructField("done", T.BooleanType())])

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        steps = _walk(machines, frame[[BLOCK, "enter", "leave", "functions", "round"]])
        out = pd.DataFrame([frame[list(series.keys)].iloc[0].tolist()] * len(steps), columns=list(series.keys))
        block, enter, done = zip(*steps, strict=True)
        return out.assign(**{BLOCK: block, "enter": list(enter), "done": done})[[f.name for f in walked.fields]]

    # Only the first block of a stretch needs rows of another.
    longer = Series(series.keys, series.rows * series.together)
    spread = with_halo(df, longer, warm_up)
    tried = materialize(spread.groupBy(*longer.home).applyInPandas(guess, schema))
    number = 0
    while True:
        number += 1
        steps = materialize(tried.groupBy(*series.keys).applyInPandas(walk, walked))
        open_steps = steps.where("not done")
        # A round settles the first open block of every series, so the rounds come to an end.
        if open_steps.isEmpty():
            return steps.select(*home, "enter")
        log.info("ordered pass: round %d", number)
        rows = join_on(_stretched(df, series), open_steps.select(*home), home, "left_semi")
        asked = open_steps.withColumn(STRETCH, series.stretch_of(F.col(BLOCK)))
        more = gather(rows, stretch).groupBy(*stretch).cogroup(asked.groupBy(*stretch)).applyInPandas(again(number), schema)
        tried = tried.unionByName(materialize(more))


# -- machines ------------------------------------------------------------


def parabolic(af: float, max_af: float, prefix: str) -> Machine:
    """Parabolic stop and reverse.

    A falling market is handled as a rising one with negated prices: `near` is
    the side that can cross the stop, `far` the side that extends the move.
    """

    def run(state, columns):
        highs, lows = columns
        stops = []
        if state is None:
            side, stop, best, speed, seen, h1, l1, h2, l2 = 1.0, lows[0], highs[0], af, 0, 0.0, 0.0, 0.0, 0.0
        else:
            side, stop, best, speed, seen, h1, l1, h2, l2 = state
        for high, low in zip(highs, lows, strict=True):
            if seen:
                near, far = (low, high) if side > 0 else (-high, -low)
                stop += speed * (best - stop)
                if near < stop:
                    side, stop, best, speed = -side, -best, -near, af
                else:
                    if far > best:
                        best, speed = far, min(speed + af, max_af)
                    if seen >= 2:
                        stop = min(stop, l1, l2) if side > 0 else min(stop, -h1, -h2)
            stops.append(side * stop)
            h2, l2, h1, l1 = h1, l1, high, low
            seen = min(seen + 1, 2)
        return [stops], [side, stop, best, speed, seen, h1, l1, h2, l2]

    return Machine(("high", "low"), (f"{prefix}stop",), run)


def trailing_band(mult: float, atr: str, prefix: str) -> Machine:
    """SuperTrend: the band on the far side of the price, which only tightens
    until a close breaks it."""

    def run(state, columns):
        line = []
        top, bottom, last, before = state if state is not None else (None, None, None, None)
        for high, low, close, reach in zip(*columns, strict=True):
            middle = (high + low) / 2
            upper, lower = middle + mult * reach, middle - mult * reach
            on_top = True if top is None else last == top
            if top is None or upper < top or before > top:
                top = upper
            if bottom is None or lower > bottom or before < bottom:
                bottom = lower
            stays_on_top = close <= top if on_top else close < bottom
            last, before = (top if stays_on_top else bottom), close
            line.append(last)
        return [line], [top, bottom, last, before]

    return Machine(("high", "low", "close", atr), (f"{prefix}line",), run, *transfer.trailing_band_transfer(mult))


TURN, EXTEND = 1.0, 2.0


def reversals(share: float, prefix: str) -> Machine:
    """ZigZag events: a turn starts a leg, an extension moves its end."""

    def run(state, columns):
        kinds, prices = [], []
        trend, pivot = state if state is not None else (0.0, None)
        for high, low in zip(*columns, strict=True):
            kind = price = float("nan")
            if pivot is None:
                kind, price = TURN, high
            elif trend > 0 and high > pivot:
                kind, price = EXTEND, high
            elif trend < 0 and low < pivot:
                kind, price = EXTEND, low
            elif trend <= 0 and high >= pivot * (1 + share):
                kind, price, trend = TURN, high, 1.0
            elif trend >= 0 and low <= pivot * (1 - share):
                kind, price, trend = TURN, low, -1.0
            if kind == kind:
                pivot = price
            kinds.append(kind)
            prices.append(price)
        return [kinds, prices], [trend, pivot]

    return Machine(("high", "low"), (f"{prefix}kind", f"{prefix}price"), run, *transfer.reversals_transfer(share))


def guard(limit: float, recovery_seconds: float, drawdown: str, clock: str, output: str) -> Machine:
    """Set once the drawdown reaches the limit; cleared after the recovery time
    while the drawdown is below half the limit."""

    def run(state, columns):
        flags = []
        active, since = state if state is not None else (0.0, 0.0)
        for fall, now in zip(*columns, strict=True):
            if not active and fall >= limit:
                active, since = 1.0, now
            if active and now >= since + recovery_seconds and fall < limit * 0.5:
                active, since = 0.0, 0.0
            flags.append(active)
        return [flags], [active, since]

    return Machine((drawdown, clock), (output,), run, *transfer.guard_transfer(limit, recovery_seconds))


def missing_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Machine outputs use NaN for missing."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


__all__ = ["Machine", "guard", "missing_to_null", "ordered_pass", "parabolic", "reversals", "trailing_band"]
