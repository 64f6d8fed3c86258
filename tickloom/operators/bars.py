"""Bars on a dense time grid from irregular trades and book rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import fdiv
from tickloom.operators.blocks import BLOCK, SLOT, Series, place, running, slot_time, time_slot

SIDE_COLUMNS = ("buy_volume", "sell_volume", "buy_count", "sell_count")


def densify(df: DataFrame, series: Series, placed: bool = False) -> DataFrame:
    """Repeat each row for the empty slots up to the next row of its series.

    `_filled` is true on the repeated rows. The next row is looked up inside
    the block, or in a table of one row per block. A long gap is opened block
    by block, so no array outgrows a block. `placed` says that `df` has its
    blocks already.
    """
    placed = df if placed else place(df, series)
    inside = Window.partitionBy(*series.home).orderBy(SLOT)
    later = Window.partitionBy(*series.keys).orderBy(BLOCK)
    heads = (
        placed.groupBy(*series.home)
        .agg(F.min(SLOT).alias("_head"))
        .select(*series.home, F.lead("_head").over(later).alias("_next_head"))
    )
    following = F.coalesce(F.lead(SLOT).over(inside), F.col("_next_head"))
    until = F.coalesce(following - 1, F.col(SLOT))
    spans = placed.join(heads, series.home).withColumn("_until", until)
    per_block = spans.withColumn(
        "_at", F.explode(F.sequence(series.block_of(F.col(SLOT)), series.block_of(F.col("_until"))))
    )
    low = F.greatest(F.col(SLOT), F.col("_at") * series.rows)
    high = F.least(F.col("_until"), F.col("_at") * series.rows + (series.rows - 1))
    return (
        per_block.withColumn("_to", F.explode(F.sequence(low, high)))
        .withColumn("_filled", F.col("_to") != F.col(SLOT))
        .withColumn(SLOT, F.col("_to"))
        .drop("_at", "_to", "_until", "_next_head", BLOCK)
    )


def _trade_aggregates() -> list[Column]:
    order = F.struct("ts", "trade_id")
    buy, sell = ~F.col("is_buyer_maker"), F.col("is_buyer_maker")
    amount = F.col("quantity")
    return [
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum(amount).alias("volume"),
        F.count("trade_id").alias("trade_count"),
        F.sum(F.when(buy, amount)).alias("buy_volume"),
        F.sum(F.when(sell, amount)).alias("sell_volume"),
        F.count(F.when(buy, F.col("trade_id"))).alias("buy_count"),
        F.count(F.when(sell, F.col("trade_id"))).alias("sell_count"),
        F.sum(F.col("price") * amount).alias("_value"),
        F.max(buy).alias("_has_buy"),
        F.max(sell).alias("_has_sell"),
    ]


def trade_bars(
    trades: DataFrame,
    every: int = 60,
    *,
    keys: Sequence[str] = ("symbol",),
    edge_mode: str = "zero",
    block_rows: int = 4096,
) -> DataFrame:
    """OHLCV bars of `every` seconds, dense from the first to the last trade.

    Empty bins repeat the last open, high, low, close and vwap and have zero
    volume and counts. edge_mode "zero" gives bins without buys (or sells) a
    zero; "carry" repeats the last value after that side's final trade.
    """
    if edge_mode not in ("zero", "carry"):
        raise ValueError(f"unknown edge_mode: {edge_mode}")
    series = Series(tuple(keys), block_rows)
    binned = (
        trades.withColumn(SLOT, time_slot(F.col("ts"), every))
        .groupBy(*keys, SLOT)
        .agg(*_trade_aggregates())
        .withColumn("vwap", fdiv(F.col("_value"), F.col("volume")))
    )
    binned = running(place(binned, series), series, {"vwap": ("last", F.col("vwap"))})
    dense = densify(binned, series, placed=True)
    zero_when_filled = ["volume", "trade_count", *SIDE_COLUMNS]
    dense = dense.withColumns(
        {
            c: F.when(F.col("_filled"), F.lit(0)).otherwise(F.coalesce(F.col(c), F.lit(0)))
            for c in zero_when_filled
        }
    )
    if edge_mode == "carry":
        dense = _repeat_side_edges(dense, series)
    floats = ("volume", "buy_volume", "sell_volume")
    return dense.select(
        *keys,
        slot_time(F.col(SLOT), every).alias("ts"),
        "open",
        "high",
        "low",
        "close",
        *(F.col(c).cast("double" if c in floats else "long").alias(c) for c in ("volume", "trade_count", *SIDE_COLUMNS)),
        F.coalesce("vwap", F.lit(0.0)).alias("vwap"),
    )


def _repeat_side_edges(dense: DataFrame, series: Series) -> DataFrame:
    """After the last trade of a side its columns keep their last value."""
    placed = place(dense, series)
    totals = {}
    for side in ("buy", "sell"):
        here = ~F.col("_filled") & F.col(f"_has_{side}")
        totals[f"_more_{side}"] = ("next", F.when(here, F.lit(1)))
        for part in ("volume", "count"):
            totals[f"_last_{side}_{part}"] = ("last", F.when(here, F.col(f"{side}_{part}")))
    looked = running(placed, series, totals)
    return looked.withColumns(
        {
            f"{side}_{part}": F.when(F.col(f"_more_{side}").isNotNull(), F.col(f"{side}_{part}")).otherwise(
                F.coalesce(F.col(f"_last_{side}_{part}"), F.lit(0))
            )
            for side in ("buy", "sell")
            for part in ("volume", "count")
        }
    ).drop(*totals, BLOCK)


def second_trades(trades: DataFrame, *, keys: Sequence[str] = ("symbol",), dense: bool = False) -> DataFrame:
    """One-second trade statistics; volumes per side are sums of quantities.

    dense adds the empty seconds between trades with zero sums and counts and
    missing prices.
    """
    order = F.struct("ts", "trade_id")
    sell = F.col("is_buyer_maker")
    made = (
        trades.withColumn(SLOT, time_slot(F.col("ts"), 1))
        .groupBy(*keys, SLOT)
        .agg(
            F.min_by("price", order).alias("price_first"),
            F.max_by("price", order).alias("price_last"),
            F.avg("price").alias("price_mean"),
            F.stddev_samp("price").alias("price_std"),
            F.sum("quantity").alias("quantity_sum"),
            F.count("quantity").alias("quantity_count"),
            F.sum(sell.cast("long")).alias("is_buyer_maker_sum"),
            F.count("is_buyer_maker").alias("is_buyer_maker_count"),
            F.sum(F.when(~sell, F.col("quantity")).otherwise(0.0)).alias("buy_volume"),
            F.sum(F.when(sell, F.col("quantity")).otherwise(0.0)).alias("sell_volume"),
        )
    )
    if dense:
        sums = ["quantity_sum", "quantity_count", "is_buyer_maker_sum", "is_buyer_maker_count", "buy_volume", "sell_volume"]
        prices = ["price_first", "price_last", "price_mean", "price_std"]
        made = densify(made, Series(tuple(keys), 86400))
        made = made.withColumns({c: F.when(F.col("_filled"), F.lit(0)).otherwise(F.col(c)) for c in sums})
        made = made.withColumns({c: F.when(~F.col("_filled"), F.col(c)) for c in prices}).drop("_filled")
    imbalance = fdiv(F.col("buy_volume") - F.col("sell_volume"), F.col("quantity_sum"))
    return made.withColumn("trade_imbalance", imbalance).withColumn("ts", slot_time(F.col(SLOT), 1)).drop(SLOT)


BOOK_LAST = ("mid_price", "best_bid", "best_ask")
BOOK_MEAN = (
    "spread",
    "spread_pct",
    "bid_volume_5",
    "ask_volume_5",
    "bid_volume_10",
    "ask_volume_10",
    "order_imbalance",
)


def book_bars(book: DataFrame, every: int = 60, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Last quotes and mean depth per bin; bins without book rows are left out."""
    order = F.struct("ts", "update_id")
    return (
        book.withColumn(SLOT, time_slot(F.col("ts"), every))
        .groupBy(*keys, SLOT)
        .agg(
            *(F.max_by(c, order).alias(c) for c in BOOK_LAST),
            *(F.avg(c).alias(c) for c in BOOK_MEAN),
        )
        .withColumn("ts", slot_time(F.col(SLOT), every))
        .drop(SLOT)
    )


def join_bars(
    trade_side: DataFrame,
    book_side: DataFrame,
    every: int = 60,
    *,
    keys: Sequence[str] = ("symbol",),
    block_rows: int = 65536,
) -> DataFrame:
    """Full outer join on the bin, forward fill, then zero."""
    series = Series(tuple(keys), block_rows)
    joined = trade_side.join(book_side, [*keys, "ts"], "full_outer")
    values = [c for c in joined.columns if c not in (*keys, "ts")]
    slotted = place(joined.withColumn(SLOT, time_slot(F.col("ts"), every)), series)
    filled = running(slotted, series, {c: ("last", F.col(c)) for c in values})
    return filled.select(*keys, "ts", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in values))


def join_snapshots(
    book: DataFrame,
    trades: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    as_of: bool = False,
    block_seconds: int = 3600,
) -> DataFrame:
    """Snapshots and trade rows on one time line.

    Book columns keep their last value, all other gaps are 0. as_of returns
    only the trade rows, each with the last book at or before it.
    """
    book_cols = [c for c in book.columns if c not in (*keys, "ts")]
    trade_cols = [c for c in trades.columns if c not in (*keys, "ts")]
    joined = book.join(trades.withColumn("_trade", F.lit(True)), [*keys, "ts"], "full_outer")
    series = Series(tuple(keys), block_seconds * 1_000_000)
    placed = place(joined.withColumn(SLOT, F.unix_micros("ts")), series)
    filled = running(placed, series, {c: ("last", F.col(c)) for c in book_cols})
    if as_of:
        filled = filled.filter("_trade")
    return filled.select(*keys, "ts", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in [*book_cols, *trade_cols]))
