"""Transfer functions of blocks: the leaving state for any entering state.

A machine that does not forget, such as a stop that is not reached, leaves a block
as it entered it, so a guess from the rows before tells nothing. Here a block is
read once with an unknown entering state. The states that pass through it without
an event form an interval; each event takes some of them out and puts them on a
path that starts at a known state. Paths that meet go on as one, hence few are
left at the end of a block, and the function is a short list of numbers.

A list and a state give the leaving state, or None where they cannot tell; then
the block has to be run. Only comparisons that the machine makes itself are used,
so a leaving state is exact to the bit.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Sequence

State = list[float]
INF = math.inf


class Paths:
    """Paths of known states that are stepped together and joined where they meet."""

    def __init__(self, step: Callable[[tuple, int], tuple]):
        self.step = step
        self.joined: list[int | None] = []
        self.live: dict[tuple, int] = {}

    def open(self, state: tuple) -> int:
        """Number of a path that is at a state now."""
        if state in self.live:
            return self.live[state]
        self.joined.append(None)
        self.live[state] = len(self.joined) - 1
        return self.live[state]

    def advance(self, row: int) -> None:
        moved: dict[tuple, int] = {}
        for state, path in self.live.items():
            new = self.step(state, row)
            if new in moved:
                self.joined[path] = moved[new]
            else:
                moved[new] = path
        self.live = moved

    def ends(self) -> list[tuple]:
        """The last state of every path."""
        at = {path: state for state, path in self.live.items()}

        def last(path: int) -> tuple:
            while self.joined[path] is not None:
                path = self.joined[path]
            return at[path]

        return [last(path) for path in range(len(self.joined))]


def _gapless(columns: Sequence[Sequence[float]]) -> bool:
    return all(v == v for column in columns for v in column)


# -- reversals (ZigZag) ------------------------------------------------------


def leg_step(share: float, highs: Sequence[float], lows: Sequence[float]):
    """One row of a leg that has a direction."""
    rise, fall = 1 + share, 1 - share

    def step(state: tuple, row: int) -> tuple:
        trend, pivot = state
        if trend > 0:
            if highs[row] > pivot:
                return trend, highs[row]
            return (-1.0, lows[row]) if lows[row] <= pivot * fall else state
        if lows[row] < pivot:
            return trend, lows[row]
        return (1.0, highs[row]) if highs[row] >= pivot * rise else state

    return step


def reversals_transfer(share: float):
    def leg(sign: float, highs, lows) -> list[float]:
        """Entering a leg in direction `sign`, prices counted in that direction.

        A pivot above all prices so far is as it was. A higher price puts it on the
        path of the block's own extreme, a fall by the share on that of the turn.
        """
        ahead, against = (highs, lows) if sign > 0 else ([-v for v in lows], [-v for v in highs])
        factor = 1 - share if sign > 0 else 1 + share
        paths = Paths(leg_step(share, highs, lows))
        top, bottom, turns, own = -INF, INF, [], None
        for row, (far, near) in enumerate(zip(ahead, against, strict=True)):
            paths.advance(row)
            if own is None:
                own, top = paths.open((sign, sign * far)), far
            elif far > top:
                top = far
            if top * factor < bottom and near < bottom:
                # Some pivots may have come through so far, and a new least price turns more of them.
                bottom = near
                turns.append((near, top, paths.open((-sign, sign * near))))
        ends = paths.ends()
        kept: list[list[float]] = []
        for near, high, path in turns:
            # A turn that ends where the block's own path ends needs no word on prices before it.
            item = [near, -INF if ends[path] == ends[own] else high, *ends[path]]
            if kept and kept[-1][1:] == item[1:]:
                kept.pop()
            kept.append(item)
        return [top, float(len(kept)), *(v for item in kept for v in item), *ends[own]]

    def transfer(columns, before) -> list[float]:
        highs, lows = columns
        if not _gapless(columns):
            return []
        up, down = leg(1.0, highs, lows), leg(-1.0, highs, lows)
        return [max(highs), min(lows), float(len(up)), *up, *down]

    def follow(made: list[float], state: State) -> State | None:
        trend, pivot = state
        if trend == 0:
            quiet = made[0] < pivot * (1 + share) and made[1] > pivot * (1 - share)
            return state if quiet else None
        cut = 3 + int(made[2])
        part = made[3:cut] if trend > 0 else made[cut:]
        sign, factor = (1.0, 1 - share) if trend > 0 else (-1.0, 1 + share)
        top, count = part[0], int(part[1])
        own = part[2 + 4 * count :]
        reach = sign * pivot * factor
        for k in range(count):
            near, high, *end = part[2 + 4 * k : 6 + 4 * k]
            if near <= reach:
                return end if sign * pivot >= high else own
        return state if sign * pivot >= top else own

    return transfer, follow


# -- trailing band (SuperTrend) ------------------------------------------------


def band(limit: Sequence[float], close: Sequence[float], before: float, unsure: Sequence[bool]) -> list[float]:
    """Where a band ends that may only fall, for any entering value.

    A value is replaced by the row's limit once the limit is below it or the close
    before is above it (a break). Values that no row replaced are an interval; the
    values in use are ordered, and every row cuts off both ends of them.
    """
    low, high, split = -INF, INF, None
    falls: list[list] = []  # (bound, path): values above the bound
    breaks: list[list] = []  # (bound, path, row of the break): values below it
    parent: list[int] = []
    broke: list[float] = []
    value: list[float] = []
    live: deque[int] = deque()

    def stamp(row: int) -> float:
        # A quarter marks a row on which both bands might be equal.
        return row + (0.25 if row >= 0 and unsure[row] else 0.0)

    for row, reset in enumerate(limit):
        last = before if row == 0 else close[row - 1]
        path = len(parent)
        hit = False
        if split is None:
            if max(low, last) > min(high, reset):
                # None is left: those the break takes are below the split, the others above it.
                split = math.nextafter(high, INF) if last > high else max(low, last)
            if last > low:
                breaks.append([last, path, stamp(row - 1)])
                low, hit = last, True
            if reset < high:
                falls.append([reset, path])
                high, hit = reset, True
        while live and value[live[0]] < last:
            gone = live.popleft()
            parent[gone], broke[gone], hit = path, stamp(row - 1), True
        while live and value[live[-1]] > reset:
            parent[live.pop()], hit = path, True
        if hit:
            parent.append(-1)
            broke.append(-1.0)
            value.append(reset)
            live.append(path)
    rows, end = len(limit), close[-1]
    for path in live:
        if value[path] < end:
            broke[path] = stamp(rows - 1)
    for path in reversed(range(len(parent))):
        if parent[path] >= 0:
            value[path] = value[parent[path]]
            broke[path] = max(broke[path], broke[parent[path]])

    def short(items, ends) -> list[float]:
        kept: list[list[float]] = []
        for item, end_ in zip(items, ends, strict=True):
            if kept and kept[-1][1:] == end_:
                kept.pop()
            kept.append([item[0], *end_])
        return [float(len(kept)), *(v for k in kept for v in k)]

    upper = short(falls, [[value[p], broke[p]] for _, p in falls])
    lower = short(breaks, [[value[p], max(broke[p], row)] for _, p, row in breaks])
    return [low, high, INF if split is None else split, stamp(rows - 1), end, *upper, *lower]


def follow_band(made: list[float], x: float) -> tuple[float, float]:
    """(band at the end, row of the last break or -1) of an entering value."""
    low, high, split, last_row, end = made[:5]
    count = int(made[5])
    upper, lower = made[6 : 6 + 3 * count], made[7 + 3 * count :]
    if split == INF and low <= x <= high:
        return x, last_row if end > x else -1.0
    items = upper if (x >= split if split != INF else x > high) else lower
    above = items is upper
    chosen = len(items) - 3
    for k in range(0, len(items), 3):
        if x > items[k] if above else x < items[k]:
            chosen = k
            break
    return items[chosen + 1], items[chosen + 2]


def trailing_band_transfer(mult: float):
    """Both bands on their own; the side follows from the later of their last breaks.

    Without a break the side stays. After one it is settled, but for bands that are
    equal, which a row can only bring about whose limits jump over the last close:
    such a row makes the answer None unless a later break decides.
    """

    def transfer(columns, before) -> list[float]:
        highs, lows, closes, reaches = columns
        if before is None or not _gapless(columns) or not _gapless([before]):
            return []
        last = before[2]
        upper, lower, unsure, previous, held, open_ = [], [], [], last, math.nan, False
        for high, low, close, reach in zip(highs, lows, closes, reaches, strict=True):
            middle = (high + low) / 2
            u, b = middle + mult * reach, middle - mult * reach
            jumps = u <= previous or b >= previous or reach <= 0
            # Equal bands stay so while the close does not leave them.
            open_ = jumps or (open_ and bool(upper) and (previous in (upper[-1], lower[-1]) or held == previous))
            held = previous
            upper.append(u)
            lower.append(b)
            unsure.append(open_)
            previous = close
        latest = max((k for k, x in enumerate(unsure) if x), default=-1)
        tops = band(upper, closes, last, unsure)
        bottoms = band([-v for v in lower], [-v for v in closes], -last, unsure)
        return [float(latest), closes[-1], float(len(tops)), *tops, *bottoms]

    def follow(made: list[float], state: State) -> State | None:
        top, bottom, last, _ = state
        if not _gapless([state]):
            return None
        cut = 3 + int(made[2])
        latest = made[0]
        new_top, top_break = follow_band(made[3:cut], top)
        negated, bottom_break = follow_band(made[cut:], -bottom)
        new_bottom = -negated
        row = max(top_break, bottom_break)
        if row >= 0 and (int(top_break) == int(bottom_break) or top <= bottom):
            return None
        on_top = last == top if row < 0 else bottom_break > top_break
        if not on_top and (latest > row or row % 1):
            return None
        return [new_top, new_bottom, new_top if on_top else new_bottom, made[1]]

    return transfer, follow


# -- guard -----------------------------------------------------------------


def guard_transfer(limit: float, recovery: float):
    """A flag that is set clears at the first calm row after the recovery time."""

    def transfer(columns, before) -> list[float]:
        falls, clock = columns
        if not _gapless(columns):
            return []

        def step(state: tuple, row: int) -> tuple:
            active, since = state
            if not active and falls[row] >= limit:
                active, since = 1.0, clock[row]
            if active and clock[row] >= since + recovery and falls[row] < limit * 0.5:
                return 0.0, 0.0
            return active, since

        paths = Paths(step)
        idle = paths.open((0.0, 0.0))
        clears: list[tuple[float, int]] = []
        latest = -INF
        for row, now in enumerate(clock):
            paths.advance(row)
            if falls[row] < limit * 0.5 and now > latest:
                latest = now
                clears.append((now, paths.open((0.0, 0.0))))
        ends = paths.ends()
        kept: list[list[float]] = []
        for now, path in clears:
            if kept and kept[-1][1:] == list(ends[path]):
                kept.pop()
            kept.append([now, *ends[path]])
        return [*ends[idle], *(v for item in kept for v in item)]

    def follow(made: list[float], state: State) -> State | None:
        active, since = state
        if not active:
            return list(made[:2])
        for k in range(2, len(made), 3):
            if made[k] >= since + recovery:
                return list(made[k + 1 : k + 3])
        return state

    return transfer, follow
