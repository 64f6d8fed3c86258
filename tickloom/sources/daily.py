"""The daily job: raw files of a date range to bars joined with the book."""

from __future__ import annotations

import logging
from datetime import date, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.bars import book_bars, join_bars, trade_bars
from tickloom.operators.blocks import join_on
from tickloom.session import materialize
from tickloom.sources import raw, sinks

log = logging.getLogger(__name__)

REPORT = "date string, trade_lines long, trades long, book_lines long, snapshots long, rows long, status string, error string"
KEYS = ("symbol", "day")


def process_days(
    spark: SparkSession, root: str, out: str, first: str, last: str, every: int = 60, layout: str = raw.LAYOUT
) -> DataFrame:
    """Bars of all days of an inclusive range, and a report with one row per day.

    The range is one job: lines are parsed once, bars are made per (symbol, day), so
    days do not run into each other, and the days of the range are written together
    below out/date=. A file belongs to the day of its folder. The report counts
    lines and usable rows of both kinds and the rows written; "missing" is a day
    without files or without a usable line of one kind. Where Spark cannot finish a
    range, its halves are tried, so that only the day at fault is "failed", with the
    message; other errors are raised.
    """
    days = _range(first, last)
    try:
        return _report(spark, _one_job(spark, root, out, first, last, every, layout), days)
    except (PySparkException, Py4JJavaError) as problem:
        if len(days) == 1:
            log.error("%s failed: %s", first, problem)
            return spark.createDataFrame([(first, 0, 0, 0, 0, 0, "failed", str(problem).splitlines()[0])], REPORT)
    middle = len(days) // 2
    early = process_days(spark, root, out, days[0], days[middle - 1], every, layout)
    return early.unionByName(process_days(spark, root, out, days[middle], days[-1], every, layout))


def _one_job(spark: SparkSession, root: str, out: str, first: str, last: str, every: int, layout: str) -> DataFrame:
    """Writes the bars; gives counts by day."""
    trade_lines = materialize(raw.read_raw(spark, root, "trade", first, last, raw.TRADE_SCHEMA, layout, day="day"))
    book_lines = materialize(raw.read_raw(spark, root, "orderbook", first, last, raw.BOOK_SCHEMA, layout, day="day"))
    # Snapshots of the same time are told apart by the last update they hold.
    book = raw.book_rows(book_lines).withColumn("update_id", F.coalesce("final_update_id", "event_time"))
    trades = raw.trade_rows(trade_lines)
    counted = [
        df.groupBy("day").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "day", "n")
        for kind, df in (("trade_lines", trade_lines), ("trades", trades), ("book_lines", book_lines), ("snapshots", book))
    ]
    counts = counted[0]
    for more in counted[1:]:
        counts = counts.unionByName(more)
    counts = materialize(counts.groupBy("day").pivot("kind", ["trade_lines", "trades", "book_lines", "snapshots"]).agg(F.first("n")))
    whole = counts.where("trades > 0 and snapshots > 0").select("day")
    trades, book = (df.join(whole, "day", "left_semi") for df in (trades, book))
    joined = join_bars(trade_bars(trades, every, keys=KEYS), book_bars(book, every, keys=KEYS), every, keys=KEYS)
    joined = materialize(joined)
    sinks.write_daily(joined.withColumnRenamed("day", "date"), out, date="date")
    return join_on(counts, joined.groupBy("day").agg(F.count(F.lit(1)).alias("rows")), ["day"], "left")


def _report(spark: SparkSession, counts: DataFrame, days: list[str]) -> DataFrame:
    every = spark.createDataFrame([(d,) for d in days], "date string")
    seen = counts.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("trade_lines", "trades", "book_lines", "snapshots", "rows")]
    status = F.when(F.col("rows") > 0, "done").otherwise("missing").alias("status")
    return every.join(seen, F.col("date") == F.col("day"), "left").select("date", *numbers, status, F.lit(None).cast("string").alias("error"))


def _range(first: str, last: str) -> list[str]:
    start, end = date.fromisoformat(first), date.fromisoformat(last)
    return [(start + timedelta(days=k)).isoformat() for k in range((end - start).days + 1)]
