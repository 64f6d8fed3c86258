"""Structured Streaming forms of ingest, bars, trade flow and the live book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators.bars import SIDE_COLUMNS, _trade_aggregates
from tickloom.sources import raw
from tickloom.streaming.live import live_bars, live_book


def read_trades(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Trade JSON lines as a stream; bad lines are left out as in the batch reader."""
    return raw.trade_rows(_lines(spark, path, raw.TRADE_SCHEMA, max_files))


def read_book(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    return raw.book_rows(_lines(spark, path, raw.BOOK_SCHEMA, max_files))


def _lines(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = spark.readStream.schema(wide).option("mode", "PERMISSIVE")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def write_hourly(
    stream: DataFrame, path: str, checkpoint: str, *, every: str | None = "60 seconds", time: str = "ts"
) -> StreamingQuery:
    """Append to Parquet below date=/hour=. every=None takes what is there and stops."""
    parted = stream.withColumns({"date": F.to_date(time), "hour": F.hour(time)})
    writer = (
        parted.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("date", "hour")
        .outputMode("append")
    )
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def trade_bars(trades: DataFrame, every: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Bars of the bins that have trades, given once the watermark passes them; `live_bars` fills the others."""
    bars = (
        trades.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", every).alias("bin"))
        .agg(*_trade_aggregates())
    )
    return bars.select(
        "symbol",
        F.col("bin.start").alias("ts"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        "trade_count",
        *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in SIDE_COLUMNS),
        F.try_divide("_value", "volume").alias("vwap"),
    )


def trade_flow(trades: DataFrame, width: str = "1 second", slide: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Buy and sell volume and vwap of sliding windows."""
    maker = F.col("is_buyer_maker")
    flow = (
        trades.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width, slide).alias("bin"))
        .agg(
            F.sum(F.when(~maker, F.col("quantity")).otherwise(0.0)).alias("buy_volume"),
            F.sum(F.when(maker, F.col("quantity")).otherwise(0.0)).alias("sell_volume"),
            F.sum(F.col("price") * F.col("quantity")).alias("_value"),
            F.sum("quantity").alias("_volume"),
        )
    )
    return flow.select(
        "symbol",
        F.col("bin.end").alias("ts"),
        "buy_volume",
        "sell_volume",
        F.try_divide("_value", "_volume").alias("vwap"),
    )


def snapshot_flow(snapshots: DataFrame, trades: DataFrame, window_ms: int = 1000, late: str = "10 seconds") -> DataFrame:
    """Each snapshot with buy_volume_1s, sell_volume_1s and vwap_1s, the stream form of `book.trailing_flow`.

    Counts trades with 0 <= snapshot - trade <= window_ms, times truncated to
    milliseconds. A snapshot is given once the watermark has passed it; equal
    snapshots are given once. `snapshots` has mid_price.
    """
    maker = F.col("is_buyer_maker")
    kept = snapshots.columns
    left = snapshots.withWatermark("ts", late)
    right = trades.withWatermark("ts", late).select(
        F.col("symbol").alias("_symbol"),
        F.col("ts").alias("_at"),
        F.when(~maker, F.col("quantity")).otherwise(0.0).alias("_buy"),
        F.when(maker, F.col("quantity")).otherwise(0.0).alias("_sell"),
        (F.col("price") * F.col("quantity")).alias("_value"),
    )
    age = F.unix_millis("ts") - F.unix_millis("_at")
    near = (F.col("_at") >= F.col("ts") - F.expr(f"interval {window_ms + 1} milliseconds")) & (
        F.col("_at") <= F.col("ts") + F.expr("interval 1 millisecond")
    )
    joined = left.join(right, (F.col("symbol") == F.col("_symbol")) & near & age.between(0, window_ms), "leftOuter")
    flow = joined.groupBy(*kept).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("_buy", "_sell", "_value")))
    volume = F.col("_buy") + F.col("_sell")
    return flow.select(
        *kept,
        F.col("_buy").alias("buy_volume_1s"),
        F.col("_sell").alias("sell_volume_1s"),
        F.when(volume > 0, F.try_divide("_value", volume)).otherwise(F.col("mid_price")).alias("vwap_1s"),
    )


def first_per_time(rows: DataFrame, late: str = "1 minute") -> DataFrame:
    """One row per symbol and time, the first that comes, at once."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])


def last_per_time(rows: DataFrame, order: str, late: str = "1 minute") -> DataFrame:
    """One row per symbol and time, the last in the given order as in `book.keep_last`.

    A row is given once the watermark has passed its time.
    """
    rest = [c for c in rows.columns if c not in ("symbol", "ts")]
    picked = rows.withWatermark("ts", late).groupBy("symbol", "ts").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select("symbol", "ts", *(F.col(f"_row.{c}").alias(c) for c in rest))


__all__ = [
    "first_per_time",
    "last_per_time",
    "live_bars",
    "live_book",
    "read_book",
    "read_trades",
    "snapshot_flow",
    "trade_bars",
    "trade_flow",
    "write_hourly",
]
