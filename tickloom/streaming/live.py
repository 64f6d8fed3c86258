"""Streams that say something about every second or bin, with changes or without.

Both keep their state by entry: a change of one price level, or of one bin, reads
and writes that entry. An event-time timer per key wakes it when the watermark
passes the next second (or bin).
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tickloom.operators.bars import SIDE_COLUMNS, _trade_aggregates
from tickloom.operators.book import LEVELS

# Output is handed on in frames of about this many rows.
CHUNK_ROWS = 50_000
SIDES = {"bid": -1.0, "ask": 1.0}
SNAPSHOT_SCHEMA = "symbol string, ts timestamp, side string, level int, price double, qty double"


class _Clocked(StatefulProcessor):
    """A processor with a clock: the next moment (in steps) that it has to list."""

    step_ms: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "at long")

    def close(self) -> None:
        pass

    def wake_at(self, step: int) -> None:
        """One timer per key: the earlier ones are taken back."""
        moment = step * self.step_ms
        timers = list(self.handle.listTimers())
        if any(t <= moment for t in timers):
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(moment)


class LiveBook(_Clocked):
    """Open levels by (side, price), changes that wait by (second, side, price), and the best levels.

    The best `keep` levels of a side are held apart, so that a second is listed
    without reading the rest; only when removals use them up are the open levels
    read again.
    """

    step_ms = 1000

    def __init__(self, levels: int):
        self.levels, self.keep = levels, 4 * levels

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", "side string, price double", "qty double")
        self.waiting = handle.getMapState("waiting", "second long, side string, price double", "qty double, at long, id long")
        self.best = handle.getValueState("best", "bid array<double>, bidq array<double>, bidall boolean, ask array<double>, askq array<double>, askall boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        clock = self.clock.get()[0] if self.clock.exists() else None
        newest: dict[tuple, tuple] = {}
        for frame in rows:
            micros = frame["ts"].astype("datetime64[us]").astype("int64")
            for side, price, qty, at, id_ in zip(frame["side"], frame["price"], frame["qty"], micros, frame["update_id"], strict=True):
                second = -(-int(at) // 1_000_000)
                if clock is not None:
                    second = max(second, clock)
                place, change = (second, side, float(price)), (float(qty), int(at), int(id_))
                if place not in newest or newest[place][1:] <= change[1:]:
                    newest[place] = change
                first = second if first is None else min(first, second)
        for place, change in newest.items():
            if not self.waiting.containsKey(place) or self.waiting.getValue(place)[1:] <= change[1:]:
                self.waiting.updateValue(place, change)
        if first is not None:
            if clock is None:
                self.clock.update((first,))
            self.wake_at(first if clock is None else clock)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs() // 1000
        if not self.clock.exists():
            return
        clock = self.clock.get()[0]
        due: dict[int, list[tuple]] = {}
        more = False
        for place, change in self.waiting.iterator():
            if place[0] <= done:
                due.setdefault(place[0], []).append((place[1], place[2], change[0]))
            else:
                more = True
        held = self._held()
        rows: list[tuple] = []
        while clock <= done:
            for side, price, qty in due.pop(clock, []):
                self.waiting.removeKey((clock, side, price))
                self._change(held, side, price, qty)
            sides = [self._listed(held, side) for side in SIDES]
            if all(sides):
                moment = pd.Timestamp(clock, unit="s")
                rows += [(key[0], moment, *entry) for side in sides for entry in side]
            elif not due:
                clock = done + 1
                break
            if len(rows) >= CHUNK_ROWS:
                yield self._frame(rows)
                rows = []
            clock += 1
        self._hold(held)
        self.clock.update((clock,))
        if more or all(held[side][0] for side in SIDES):
            self.handle.registerTimer(max(clock * 1000, (done + 1) * 1000))
        if rows:
            yield self._frame(rows)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["symbol", "ts", "side", "level", "price", "qty"])

    def _held(self) -> dict[str, list]:
        """Per side: ranks from the best, quantity by rank, and whether these are all open levels."""
        if not self.best.exists():
            return {side: [[], {}, True] for side in SIDES}
        bid, bidq, bid_all, ask, askq, ask_all = self.best.get()
        return {
            "bid": [list(bid), dict(zip(bid, bidq, strict=True)), bid_all],
            "ask": [list(ask), dict(zip(ask, askq, strict=True)), ask_all],
        }

    def _hold(self, held: dict[str, list]) -> None:
        parts = []
        for side in SIDES:
            ranks, qty, whole = held[side]
            parts += [ranks, [qty[r] for r in ranks], whole]
        self.best.update(tuple(parts))

    def _change(self, held: dict[str, list], side: str, price: float, qty: float) -> None:
        part = held[side]
        ranks, known, whole = part
        rank = SIDES[side] * price
        if qty == 0:
            if self.open.containsKey((side, price)):
                self.open.removeKey((side, price))
            if known.pop(rank, None) is not None:
                del ranks[bisect_left(ranks, rank)]
                if not whole and len(ranks) < self.levels:
                    self._refill(held, side)
            return
        self.open.updateValue((side, price), (qty,))
        if rank in known:
            known[rank] = qty
        elif whole or rank < ranks[-1]:
            insort(ranks, rank)
            known[rank] = qty
            if len(ranks) > self.keep:
                del known[ranks.pop()]
                part[2] = False

    def _refill(self, held: dict[str, list], side: str) -> None:
        count = 0

        def entries():
            nonlocal count
            for (own, price), (qty,) in self.open.iterator():
                if own == side:
                    count += 1
                    yield SIDES[side] * price, qty

        best = heapq.nsmallest(self.keep, entries())
        held[side] = [[r for r, _ in best], dict(best), count == len(best)]

    def _listed(self, held: dict[str, list], side: str) -> list[tuple]:
        ranks, known, _ = held[side]
        return [(side, n, SIDES[side] * r, known[r]) for n, r in enumerate(ranks[: self.levels])]


def live_book(deltas: DataFrame, late: str = "10 seconds", levels: int = LEVELS) -> DataFrame:
    """The best levels of each side at every full second of event time at which both sides have one.

    `deltas` has (symbol, ts, update_id, side, price, qty), qty 0 removing a level.
    A second is listed once the watermark passes it, so deltas within `late` of each
    other may come in any order. One changed level rewrites one entry of the state.
    """
    return (
        deltas.withWatermark("ts", late)
        .groupBy("symbol")
        .transformWithStateInPandas(LiveBook(levels), SNAPSHOT_SCHEMA, "Append", "EventTime")
    )


PRICES = ("open", "high", "low", "close")
BAR_VALUES = [*PRICES, "volume", "trade_count", *SIDE_COLUMNS, "vwap"]
_BAR_TYPES = ", ".join(f"{c} {'long' if c.endswith('count') else 'double'}" for c in BAR_VALUES)
BAR_SCHEMA = f"symbol string, ts timestamp, {_BAR_TYPES}"


class LiveBars(_Clocked):
    """The last bar of a key and those that wait, by bin. Empty bins repeat its prices."""

    def __init__(self, step_ms: int):
        self.step_ms = step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "bin long", _BAR_TYPES)
        self.last = handle.getValueState("last", _BAR_TYPES)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        ready: list[tuple] = []
        for frame in rows:
            bins = frame["ts"].astype("datetime64[ms]").astype("int64") // self.step_ms
            values = [frame[c].tolist() for c in BAR_VALUES]
            ready += [(int(b), tuple(v)) for b, *v in zip(bins, *values, strict=True)]
        if not ready:
            return
        # The aggregate before gives a bin once and only behind the watermark, in any order.
        ready.sort()
        last, clock = (self.last.get(), self.clock.get()[0]) if self.clock.exists() else (None, ready[0][0])
        out: list[tuple] = []
        for bin_, bar in ready:
            while clock < bin_:
                out.append((key[0], pd.Timestamp(clock * self.step_ms, unit="ms"), *self._quiet(last)))
                clock += 1
                if len(out) >= CHUNK_ROWS:
                    yield pd.DataFrame(out, columns=["symbol", "ts", *BAR_VALUES])
                    out = []
            # Without volume a bin has no mean price of its own.
            bar = tuple(self._known(c, v, last) for c, v in zip(BAR_VALUES, bar, strict=True))
            out.append((key[0], pd.Timestamp(bin_ * self.step_ms, unit="ms"), *bar))
            last, clock = bar, bin_ + 1
        self.last.update(last)
        self.clock.update((clock,))
        yield pd.DataFrame(out, columns=["symbol", "ts", *BAR_VALUES])

    @staticmethod
    def _known(column: str, value, last):
        missing = value is None or value != value
        if column == "vwap" and missing:
            return last[BAR_VALUES.index("vwap")] if last else 0.0
        return int(value) if column.endswith("count") else float(value)

    @staticmethod
    def _quiet(last: tuple) -> tuple:
        kept = (*PRICES, "vwap")
        return tuple(v if c in kept else (0 if c.endswith("count") else 0.0) for c, v in zip(BAR_VALUES, last, strict=True))


def live_bars(trades: DataFrame, every_seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """Dense bars of a stream, the live form of `bars.trade_bars`.

    A bar is given once the watermark passes its bin, and the empty bins before it
    with it: they repeat open, high, low, close and vwap and have no volume. What
    follows the last trade is open until the next one, as in batch.
    """
    bins = (
        trades.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", f"{every_seconds} seconds").alias("bin"))
        .agg(*_trade_aggregates())
    )
    numbers = [c for c in BAR_VALUES if c != "vwap"]
    bars = bins.select(
        "symbol",
        F.col("bin.start").alias("ts"),
        *(F.coalesce(F.col(c), F.lit(0)).cast("long" if c.endswith("count") else "double").alias(c) for c in numbers),
        F.try_divide("_value", "volume").alias("vwap"),
    )
    return bars.groupBy("symbol").transformWithStateInPandas(LiveBars(every_seconds * 1000), BAR_SCHEMA, "Append", "None")
