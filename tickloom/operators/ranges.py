"""Extremes over trailing time windows, by row blocks.

A window that ends in a block starts in an earlier one (or in the same). Its
extremes are those of the tail of the first block, of the whole blocks between and
of the head of the last. Heads and tails are running values; the blocks between
are answered from a table with one row per block. One task holds a block and the
block in which some of its windows start, never a series or a span of time, so it
does not matter how unevenly rows lie in time.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.blocks import BLOCK, SLOT, STRETCH, Series, cuts, gather, join_on
from tickloom.session import materialize

START = "_start"  # the block in which a window starts
GROUP = "_group"  # pairs of blocks that are handled together
NEAR = 0.99


def _fall(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Relative fall from a high to a later low; missing where the high is 0."""
    out = np.full(np.broadcast(high, low).shape, np.nan)
    return np.divide(high - low, high, out=out, where=high != 0)


def heads(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Highest, lowest and deepest fall from the first item to each item, along the last axis."""
    high, low = np.fmax.accumulate(x, axis=-1), np.fmin.accumulate(x, axis=-1)
    return high, low, np.fmax.accumulate(_fall(high, x), axis=-1)


def tails(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from each item to the last."""
    back = x[..., ::-1]
    high, low = np.fmax.accumulate(back, axis=-1), np.fmin.accumulate(back, axis=-1)
    fall = np.fmax.accumulate(_fall(back, low), axis=-1)
    return high[..., ::-1], low[..., ::-1], fall[..., ::-1]


def joined(first, second):
    """Extremes of two stretches, the second after the first."""
    high, low, fall = (np.asarray(v, float) for v in first)
    high2, low2, fall2 = (np.asarray(v, float) for v in second)
    return np.fmax(high, high2), np.fmin(low, low2), np.fmax(np.fmax(fall, fall2), _fall(high, low2))


class Ranges:
    """Extremes of any stretch of a list in one lookup per level.

    Level k cuts the list into pieces of 2^(k+1) items and holds tails of left
    halves and heads of right halves. First and last item of a stretch differ in a
    highest bit; at that level they lie in the two halves of one piece.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray, fall: np.ndarray):
        self.items = high, low, fall
        size = 1 << max(len(high) - 1, 1).bit_length()
        padded = [np.concatenate([np.asarray(v, float), np.full(size - len(v), np.nan)]) for v in self.items]
        self.levels = []
        half = 1
        while half < size:
            pieces = [v.reshape(-1, 2, half) for v in padded]
            left, right = self._tails(*(p[:, 0] for p in pieces)), self._heads(*(p[:, 1] for p in pieces))
            self.levels.append([np.stack([a, b], axis=1).reshape(-1) for a, b in zip(left, right, strict=True)])
            half *= 2

    @staticmethod
    def _heads(high, low, fall):
        top = np.fmax.accumulate(high, axis=-1)
        before = np.concatenate([np.full((*top.shape[:-1], 1), np.nan), top[..., :-1]], axis=-1)
        fall = np.fmax.accumulate(np.fmax(fall, _fall(before, low)), axis=-1)
        return top, np.fmin.accumulate(low, axis=-1), fall

    @staticmethod
    def _tails(high, low, fall):
        high, low, fall = (v[..., ::-1] for v in (high, low, fall))
        bottom = np.fmin.accumulate(low, axis=-1)
        after = np.concatenate([np.full((*bottom.shape[:-1], 1), np.nan), bottom[..., :-1]], axis=-1)
        fall = np.fmax.accumulate(np.fmax(fall, _fall(high, after)), axis=-1)
        return np.fmax.accumulate(high, axis=-1)[..., ::-1], bottom[..., ::-1], fall[..., ::-1]

    def query(self, first: np.ndarray, last: np.ndarray):
        """Extremes from item `first` to item `last`, both counted; missing where last < first."""
        out = [np.full(len(first), np.nan) for _ in range(3)]
        same = first == last
        for o, v in zip(out, self.items, strict=True):
            o[same] = np.asarray(v, float)[first[same]]
        differ = first ^ last
        level = np.frexp(differ.astype(float))[1] - 1
        for k, table in enumerate(self.levels):
            at = np.flatnonzero((level == k) & (first < last))
            both = joined([v[first[at]] for v in table], [v[last[at]] for v in table])
            for o, v in zip(out, both, strict=True):
                o[at] = v
        return tuple(out)


def last_at_least(x: np.ndarray, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each query the last place up to `at` whose value reaches `bound`, or -1."""
    tables, width = [np.asarray(x, float)], 1
    while width < len(x):
        older = np.concatenate([np.full(width, np.nan), tables[-1][:-width]])
        tables.append(np.fmax(tables[-1], older))
        width *= 2
    place = at.copy()
    for level in reversed(range(len(tables))):
        live = place >= 0
        # Written so that a missing value counts as too low.
        low = live & ~(tables[level][np.maximum(place, 0)] >= bound)
        place = np.where(low, place - (1 << level), place)
    return np.maximum(place, -1)


def trailing_status(df: DataFrame, series: Series, length: int, at: str, value: str) -> DataFrame:
    """(key, slot, at, x, high, fall, near_at) of the window of `length` that ends at each row.

    `df` carries `_slot` in the order of `at`, a whole number, and is read several
    times. x: the value; high: the highest
    value; fall: the deepest relative fall from a value to a later one; near_at: `at`
    of the last row whose value is within 1% of the highest (the last highest one
    where that is not above 0).
    """
    keys, home = list(series.keys), series.home
    rows = df.select(*keys, series.block_of(F.col(SLOT)).alias(BLOCK), SLOT, F.col(at).alias("at"), F.col(value).alias("x"))
    named = {f.name: f.dataType for f in rows.schema.fields}

    def schema(**columns: T.DataType) -> T.StructType:
        kept = [T.StructField(c, named[c]) for c in home]
        return T.StructType([*kept, *(T.StructField(c, t) for c, t in columns.items())])

    long, double = T.LongType(), T.DoubleType()
    extremes = {"high": double, "low": double, "fall": double}

    def summary(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(SLOT)
        x, time = frame["x"].to_numpy(float), frame["at"].to_numpy(np.int64)
        _, begin, end = (np.array(v) for v in zip(*cuts(frame[BLOCK].to_numpy(np.int64)), strict=True))
        whole = [[v[-1] for v in heads(x[a:b])] for a, b in zip(begin, end, strict=True)]
        out = frame.iloc[begin][home].reset_index(drop=True).assign(first_at=time[begin], last_at=time[end - 1])
        return out.assign(**dict(zip(extremes, np.array(whole).T, strict=True)))

    stretches = rows.withColumn(STRETCH, series.stretch_of(F.col(BLOCK))).groupBy(*keys, STRETCH)
    blocks = materialize(stretches.applyInPandas(summary, schema(first_at=long, last_at=long, **extremes)))
    pair_schema = schema(**{START: long, "above": long, "upto": long, **extremes})
    pairs = materialize(blocks.groupBy(*keys).applyInPandas(lambda f: _pairs(f, keys, length), pair_schema))

    own = join_on(rows, pairs.select(*home, START), home).withColumn("_own", F.lit(True))
    others = pairs.where(F.col(START) != F.col(BLOCK)).select(*keys, F.col(BLOCK).alias("_into"), F.col(START).alias(BLOCK))
    lent = join_on(rows, others, home).withColumn(START, F.col(BLOCK)).withColumn(BLOCK, F.col("_into")).drop("_into")
    meeting = [*home, START]
    held = gather(own.unionByName(lent.withColumn("_own", F.lit(False))), meeting)
    made = schema(**{SLOT: long, "at": long, "x": double, "high": double, "fall": double, "near": double, "near_at": long})
    found = materialize(
        held.groupBy(*meeting)
        .cogroup(_again(pairs).groupBy(*meeting))
        .applyInPandas(lambda f, p: _windows(f, p, home, length, made.names), made)
    )
    open_ = found.where("near_at is null and near is not null")
    if open_.isEmpty():
        return found.drop(BLOCK, "near")
    settled = found.where("near_at is not null or near is null").drop(BLOCK, "near")
    return settled.unionByName(_between(rows, blocks, open_, series, schema))


def _again(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for use beside what was made from them."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def _pairs(blocks: pd.DataFrame, keys: list[str], length: int) -> pd.DataFrame:
    """For every block the blocks in which its windows start, and the extremes of the blocks between.

    A window that ends at time t starts in the last block that begins before
    t - length; (above, upto] are the limits of t - length.
    """
    blocks = blocks.sort_values(BLOCK, ignore_index=True)
    number, first = blocks[BLOCK].to_numpy(np.int64), blocks["first_at"].to_numpy(np.int64)
    n = len(number)

    def starts(t: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(first, t - length, "left") - 1, 0)

    low, high = starts(first), starts(blocks["last_at"].to_numpy(np.int64))
    count = high - low + 1
    into = np.repeat(np.arange(n), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    table = Ranges(*(blocks[c].to_numpy(float) for c in ("high", "low", "fall")))
    between = table.query(start + 1, into - 1)
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    ends = np.append(first, most)
    out = pd.DataFrame({k: blocks[k].iloc[0] for k in keys}, index=range(len(into)))
    out[BLOCK], out[START] = number[into], number[start]
    out["above"], out["upto"] = np.where(start == 0, least, first[start]), ends[start + 1]
    out["high"], out["low"], out["fall"] = between
    return out


def _windows(frame: pd.DataFrame, pair: pd.DataFrame, home: list[str], length: int, names: list[str]) -> pd.DataFrame:
    """Windows that end in a block and start in another (or the same)."""
    if frame.empty or pair.empty:
        return pd.DataFrame(columns=names)
    pair = pair.iloc[0]
    frame = frame.sort_values(SLOT, ignore_index=True)
    own, lent = frame[frame["_own"]], frame[~frame["_own"]]
    x, at = own["x"].to_numpy(float), own["at"].to_numpy(np.int64)
    begin = at - length
    rows = np.flatnonzero((begin > pair["above"]) & (begin <= pair["upto"]))
    if not len(rows):
        return pd.DataFrame(columns=names)
    same = pair[START] == pair[BLOCK]
    if same:
        # Before the first row of the series there is nothing, so 0 is right there too.
        first = np.searchsorted(at, begin[rows], "left")
        high, _, fall = Ranges(x, x, np.where(np.isnan(x), np.nan, 0.0)).query(first, rows)
    else:
        source, source_at = lent["x"].to_numpy(float), lent["at"].to_numpy(np.int64)
        first = np.searchsorted(source_at, begin[rows], "left")
        tail = [np.append(v, np.nan)[first] for v in tails(source)]
        middle = [np.full(len(rows), float(pair[c])) for c in ("high", "low", "fall")]
        before = joined(tail, middle)
        high, _, fall = joined(before, [v[rows] for v in heads(x)])
    near = np.where(high > 0, high * NEAR, high)
    place = last_at_least(x, rows, near)
    near_at = np.where(place >= 0, at[np.maximum(place, 0)], -1)
    known = place >= 0
    if not same:
        # No whole block between reaches it, so it is in the tail.
        tail_ = ~known & ~(float(pair["high"]) >= near)
        place = last_at_least(source, np.full(len(rows), len(source) - 1), near)
        hit = tail_ & (place >= 0)
        near_at[hit] = source_at[place[hit]]
        known |= hit
    out = own.iloc[rows][home].reset_index(drop=True)
    out[SLOT], out["at"], out["x"] = own[SLOT].to_numpy()[rows], at[rows], x[rows]
    out["high"], out["fall"], out["near"] = high, np.fmax(fall, 0.0), near
    out["near_at"] = pd.array(near_at, "Int64")
    out.loc[~known, "near_at"] = pd.NA
    return out[names]


def _between(rows: DataFrame, blocks: DataFrame, open_: DataFrame, series: Series, schema) -> DataFrame:
    """The last near row where it lies in a whole block between.

    Going back from a block, only blocks that are higher than all later ones can
    hold it; this falling list is carried along the table of blocks. A row takes the
    last of them that reaches its bound and meets that block's rows.
    """
    keys, home, together = list(series.keys), series.home, series.together
    double = T.DoubleType()
    asked = open_.groupBy(*home).agg(F.min("near").alias("least"), F.max("near").alias("most"))
    table = join_on(blocks.select(*home, "high"), asked, home, "left")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(BLOCK, ignore_index=True)
        falling: list[tuple[int, float]] = []
        made = []
        for block, high, least, most in frame[[BLOCK, "high", "least", "most"]].itertuples(index=False):
            if least == least:
                # Those below `least` are passed over at once.
                last = bisect_right(falling, -least, key=lambda item: -item[1])
                above = falling[last][1] if last < len(falling) else -np.inf
                while last and not above >= most:
                    last -= 1
                    source, top = falling[last]
                    made.append((block, source, above, top))
                    above = top
            while falling and not falling[-1][1] > high:
                falling.pop()
            if high == high:
                falling.append((block, high))
        out = pd.DataFrame(made, columns=[BLOCK, START, "over", "top"])
        for k in keys:
            out[k] = frame[k].iloc[0]
        out[GROUP] = np.arange(len(out)) // together
        return out[[*home, START, "over", "top", GROUP]]

    pair_schema = schema(**{START: T.LongType(), "over": double, "top": double, GROUP: T.LongType()})
    pairs = materialize(table.groupBy(*keys).applyInPandas(walk, pair_schema))
    sent = join_on(open_, pairs, home).where("near > over and near <= top")
    meeting = [*keys, GROUP]
    lent = _again(join_on(rows, pairs.select(*keys, F.col(START).alias(BLOCK), GROUP).distinct(), home))
    columns = [*keys, SLOT, "at", "x", "high", "fall", "near_at"]

    def settle(asks: pd.DataFrame, source: pd.DataFrame) -> pd.DataFrame:
        if asks.empty or source.empty:
            return pd.DataFrame(columns=columns)
        source = source.sort_values(SLOT, ignore_index=True)
        x, at = source["x"].to_numpy(float), source["at"].to_numpy(np.int64)
        of = {block: slice(begin, end) for block, begin, end in cuts(source[BLOCK].to_numpy(np.int64))}
        asks = asks.sort_values(START, ignore_index=True)
        near, found = asks["near"].to_numpy(float), []
        for block, begin, end in cuts(asks[START].to_numpy(np.int64)):
            own = of[block]
            found.append(at[own][last_at_least(x[own], np.full(end - begin, own.stop - own.start - 1), near[begin:end])])
        return asks.assign(near_at=np.concatenate(found))[columns]

    fields = [f for f in open_.schema.fields if f.name in columns]
    out = T.StructType(sorted(fields, key=lambda f: columns.index(f.name)))
    return gather(sent, meeting).groupBy(*meeting).cogroup(gather(_again(lent), meeting).groupBy(*meeting)).applyInPandas(settle, out)
