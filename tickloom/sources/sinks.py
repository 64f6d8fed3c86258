"""Writers for processed tables and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_daily(
    df: DataFrame, path: str, time: str = "ts", keys: Sequence[str] = ("symbol",), date: str | None = None
) -> None:
    """Snappy Parquet below date=YYYY-MM-DD; only the dates at hand are replaced.

    The date is that of `time`, or the column `date`.

    Rows are spread over (date, hour) rather than date alone, so a busy day is
    written by many tasks.
    """
    dated = df.withColumn("date", F.to_date(date or time))
    (
        dated.repartition("date", F.hour(time), *keys)
        .sortWithinPartitions(*keys, time)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy("date")
        .parquet(path)
    )


def write_hourly(df: DataFrame, path: str, time: str = "ts") -> None:
    """Parquet below date=/hour=, the batch form of hourly rotation."""
    (
        df.withColumns({"date": F.to_date(time), "hour": F.hour(time)})
        .write.mode("append")
        .option("compression", "snappy")
        .partitionBy("date", "hour")
        .parquet(path)
    )


def write_trades_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_metrics_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def status_by_day(df: DataFrame, first: str, last: str, time: str = "ts") -> DataFrame:
    """One row per date of an inclusive range with its row count; a date
    without rows is reported as missing."""
    spark = df.sparkSession
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date")
    )
    counts = df.groupBy(F.to_date(time).alias("date")).agg(F.count(F.lit(1)).alias("rows"))
    return days.join(counts, "date", "left").select(
        "date",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.when(F.col("rows").isNull(), "missing").otherwise("done").alias("status"),
    )
