"""Ordered series cut into blocks.

Every series operator needs "the rows before this one". Partitioning by the
series key alone would put a whole series, perhaps a third of all rows, in one
task. Here a series is cut into blocks of `rows` consecutive slots, a slot being
a dense integer position, and all ordered work is partitioned by (key, block):

* operators with bounded look-back get the last rows of the block before as a
  *halo*, so no row waits for another task;
* running totals add up per-block totals in a table with one row per block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = "_slot"
BLOCK = "_block"
OWN = "_own"
DEFAULT_ROWS = 65536
STRETCH = "_stretch"


@dataclass(frozen=True)
class Series:
    """Key columns of a table of ordered series and how it is cut."""

    keys: tuple[str, ...] = ("symbol",)
    rows: int = DEFAULT_ROWS

    @property
    def home(self) -> list[str]:
        return [*self.keys, BLOCK]

    def block_of(self, slot: Column) -> Column:
        size = F.lit(self.rows).cast("long")
        return F.floor((slot - F.pmod(slot, size)) / size).cast("long")


    @property
    def together(self) -> int:
        """How many short blocks are handed to one call of Python code."""
        return max(DEFAULT_ROWS // self.rows, 1)

    def stretch_of(self, block: Column) -> Column:
        return F.floor(block / F.lit(self.together)).cast("long")


def cuts(blocks: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each block of sorted block numbers, its first place and the place after its last."""
    begin = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else np.zeros(0, np.int64)
    return zip(blocks[begin].tolist(), begin.tolist(), np.append(begin[1:], len(blocks)).tolist())


def time_slot(ts: Column, seconds: int) -> Column:
    """Position on the grid of `seconds`-wide bins since the epoch; a row without a time is an error."""
    bin_number = F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")
    return F.coalesce(bin_number, F.raise_error(F.lit("a row has no time")).cast("long"))


def slot_time(slot: Column, seconds: int) -> Column:
    return F.timestamp_seconds(slot * F.lit(seconds))


def row_slots(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
) -> DataFrame:
    """Number the rows of each series 0, 1, 2, ... in `_slot`.

    `chunk` is any coarse column that never decreases along the order, such as
    the hour. Rows are numbered inside their chunk and the chunk counts, one
    row per (key, chunk), are summed up front.
    """
    cut = df.withColumn("_chunk", chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        cut.withColumn("_rn", F.row_number().over(inside))
        .transform(lambda numbered: join_on(numbered, offsets, [*keys, "_chunk"]))
        .withColumn(SLOT, F.col("_offset") + F.col("_rn") - 1)
        .drop("_chunk", "_rn", "_offset")
    )


def with_halo(df: DataFrame, series: Series, back: int, ahead: int = 0) -> DataFrame:
    """Send each row to its own block and to the blocks that look at it.

    A row is needed by every block holding a slot at most `back` later or
    `ahead` earlier. `_own` marks the copy in the row's own block.
    """
    slot = F.col(SLOT)
    own = series.block_of(slot)
    if back or ahead:
        targets = F.sequence(series.block_of(slot - ahead), series.block_of(slot + back))
        spread = df.withColumn(BLOCK, F.explode(targets))
    else:
        spread = df.withColumn(BLOCK, own)
    return gather(spread.withColumn(OWN, F.col(BLOCK) == own), series.home)


def gather(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bring the rows of a block together; adaptive execution sizes the tasks."""
    return df.repartition(*columns)


def join_on(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where NULL equals NULL, so that no row of a NULL key is lost."""
    named = right.select(*(F.col(c).alias(f"_right_{c}") if c in columns else F.col(c) for c in right.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in columns]
    return left.join(named, same, how).drop(*(f"_right_{c}" for c in columns))


def running(df: DataFrame, series: Series, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running totals over whole series.

    `totals` maps an output name to (kind, value) with kind one of sum, max,
    min, product, last (last non-missing value so far), next (first
    non-missing value from here on) and after (the same, this row left out). Rows carry `_block` already and are
    partitioned by it.
    """
    if not totals:
        return df
    inside = Window.partitionBy(*series.home).orderBy(SLOT)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rev_inside = Window.partitionBy(*series.home).orderBy(F.desc(SLOT))
    from_here = rev_inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after_here = rev_inside.rowsBetween(Window.unboundedPreceding, -1)

    fold = {"sum": F.sum, "max": F.max, "min": F.min, "product": F.product}
    valued = df.withColumns({f"_v_{name}": value for name, (_, value) in totals.items()})
    per_block, carry, local, merged = [], [], {}, {}
    before = Window.partitionBy(*series.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*series.keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _) in totals.items():
        v, t, c, here = F.col(f"_v_{name}"), f"_t_{name}", f"_c_{name}", f"_l_{name}"
        if kind in fold:
            per_block.append(fold[kind](v).alias(t))
            carry.append(fold[kind](F.col(t)).over(before).alias(c))
            local[here] = fold[kind](v).over(upto)
        elif kind == "last":
            per_block.append(F.max_by(v, F.when(v.isNotNull(), F.col(SLOT))).alias(t))
            carry.append(F.last(t, ignorenulls=True).over(before).alias(c))
            local[here] = F.last(v, ignorenulls=True).over(upto)
        elif kind in ("next", "after"):
            per_block.append(F.min_by(v, F.when(v.isNotNull(), F.col(SLOT))).alias(t))
            carry.append(F.last(t, ignorenulls=True).over(after).alias(c))
            local[here] = F.last(v, ignorenulls=True).over(from_here if kind == "next" else after_here)
        else:
            raise ValueError(f"unknown running total: {kind}")
        a, b = F.col(here), F.col(c)
        merged[name] = {
            "sum": F.coalesce(a + b, a, b),
            "product": F.coalesce(a * b, a, b),
            "max": F.greatest(a, b),
            "min": F.least(a, b),
            "last": F.coalesce(a, b),
            "next": F.coalesce(a, b),
            "after": F.coalesce(a, b),
        }[kind]
    table = valued.groupBy(*series.home).agg(*per_block).select(*series.home, *carry)
    scratch = [f"{p}{name}" for name in totals for p in ("_v_", "_l_", "_c_")]
    return join_on(valued.withColumns(local), table, series.home).withColumns(merged).drop(*scratch)


def running_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, totals: dict[str, tuple], at: str = "_home"
) -> DataFrame:
    """Running totals over whole series of rows that carry no `_slot`.

    `chunk` is as in `row_slots`. `totals` maps an output name to (kind, value), kind
    being sum, last or after, or to ("sum", value, period) for sums that begin anew with
    period(chunk). Rows are shuffled once, by (key, chunk) as one struct, in which
    NULL equals NULL; the totals of chunks are summed before they are. `df` is read twice.
    """
    homed = df.withColumn(at, F.struct(*keys, chunk.alias("_chunk")))
    placed = gather(homed, [at])
    inside = Window.partitionBy(at).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = [F.col(f"{at}.{k}") for k in keys]
    per_chunk, carry, local, merged = [], [], {}, {}
    for name, (kind, value, *period) in totals.items():
        t, c, here = f"_t_{name}", f"_c_{name}", f"_l_{name}"
        groups = [*own, *(p(F.col(f"{at}._chunk")) for p in period)]
        before = Window.partitionBy(*groups).orderBy(F.col(f"{at}._chunk")).rowsBetween(Window.unboundedPreceding, -1)
        if kind == "sum":
            per_chunk.append(F.sum(value).alias(t))
            carry.append(F.sum(t).over(before).alias(c))
            local[here] = F.sum(value).over(upto)
            merged[name] = F.coalesce(F.col(c) + F.col(here), F.col(c), F.col(here))
        elif kind == "last":
            per_chunk.append(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias(t))
            carry.append(F.last(t, ignorenulls=True).over(before).alias(c))
            local[here] = F.last(value, ignorenulls=True).over(upto)
            merged[name] = F.coalesce(here, c)
        elif kind == "after":
            after = Window.partitionBy(*groups).orderBy(F.col(f"{at}._chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
            per_chunk.append(F.min_by(value, F.when(value.isNotNull(), F.struct(*order))).alias(t))
            carry.append(F.last(t, ignorenulls=True).over(after).alias(c))
            back = Window.partitionBy(at).orderBy(*(o.desc() for o in order)).rowsBetween(Window.unboundedPreceding, -1)
            local[here] = F.last(value, ignorenulls=True).over(back)
            merged[name] = F.coalesce(here, c)
        else:
            raise ValueError(f"unknown running total: {kind}")
    table = homed.groupBy(at).agg(*per_chunk).select(at, *carry)
    scratch = [at, *(f"{p}{name}" for name in totals for p in ("_l_", "_c_"))]
    return placed.withColumns(local).join(table, at).withColumns(merged).drop(*scratch)


def fill_missing(
    df: DataFrame,
    series: Series,
    columns: Sequence[str],
    how: str = "zero",
) -> DataFrame:
    """The fill policy: zero, ffill, bfill or none, per column."""
    if how == "none":
        return df
    if how == "zero":
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})
    if how not in ("ffill", "bfill"):
        raise ValueError(f"unknown fill policy: {how}")
    kind = "last" if how == "ffill" else "next"
    return running(df, series, {c: (kind, F.col(c)) for c in columns})


def place(df: DataFrame, series: Series) -> DataFrame:
    """Give each row its block and bring blocks together, without a halo."""
    return gather(df.withColumn(BLOCK, series.block_of(F.col(SLOT))), series.home)
