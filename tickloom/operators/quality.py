"""Checks, splits and selection on finished tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import fdiv
from tickloom.operators.blocks import BLOCK, SLOT, Series, join_on, row_slots, running_rows

FIVE_MINUTES = 300


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def fold_incomplete(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Columns that only `drop_incomplete` reads as one, missing where one of them is missing or NaN."""
    fractions = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    there = [F.col(c).isNotNull() & ~F.isnan(c) if c in fractions else F.col(c).isNotNull() for c in columns]
    folded = F.when(reduce(and_, there, F.lit(True)), F.lit(True)).alias(name)
    return df.select(*(c for c in df.columns if c not in columns), folded)


def quality_report(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    min_rows: float = 0.8 * 86400,
    block_seconds: int = 3600,
) -> DataFrame:
    """One row per series with the measured values and a verdict for each check.

    The longest gap is taken inside time blocks and between the edges of
    neighbouring blocks, so no series is sorted as a whole.
    """
    values = [c for c in df.columns if c not in keys]
    nulls = sum((F.sum(F.col(c).isNull().cast("long")) for c in values), start=F.lit(0))
    series = Series(tuple(keys), block_seconds * 1_000_000)
    time = F.unix_micros("ts")
    placed = df.withColumn(SLOT, time).withColumn(BLOCK, series.block_of(time))
    inside = Window.partitionBy(*series.home).orderBy(SLOT)
    gaps = placed.withColumn("_gap", F.col(SLOT) - F.lag(SLOT).over(inside))
    blocks = gaps.groupBy(*series.home).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("mid_price").alias("_low"),
        F.max("spread_pct").alias("_spread"),
        F.max("_gap").alias("_gap"),
        F.min(SLOT).alias("_first"),
        F.max(SLOT).alias("_last"),
        nulls.alias("_nulls"),
    )
    order = Window.partitionBy(*keys).orderBy(BLOCK)
    edges = blocks.withColumn("_edge", F.col("_first") - F.lag("_last").over(order))
    report = edges.groupBy(*keys).agg(
        F.sum("_rows").alias("rows"),
        F.min("_low").alias("min_mid_price"),
        F.max("_spread").alias("max_spread_pct"),
        (F.greatest(F.max("_gap"), F.max("_edge")) / 1e6).alias("max_gap_seconds"),
        (F.sum("_nulls") / (F.sum("_rows") * len(values))).alias("null_share"),
    )
    failed = (F.col("rows") < min_rows) | (F.col("min_mid_price") <= 0) | (F.col("null_share") > 0.1)
    warned = (F.col("max_spread_pct") > 10) | (F.col("max_gap_seconds") > FIVE_MINUTES)
    return report.withColumns(
        {
            "rows_ok": F.col("rows") >= min_rows,
            "prices_ok": F.col("min_mid_price") > 0,
            "spread_ok": ~F.coalesce(F.col("max_spread_pct") > 10, F.lit(False)),
            "gap_ok": ~F.coalesce(F.col("max_gap_seconds") > FIVE_MINUTES, F.lit(False)),
            "nulls_ok": F.col("null_share") <= 0.1,
            "verdict": F.when(failed, "fail").when(warned, "warn").otherwise("pass"),
        }
    )


def chronological_split(
    df: DataFrame,
    train: float = 0.8,
    validation: float = 0.1,
    *,
    keys: Sequence[str] = ("symbol",),
    time: str = "ts",
    order: Sequence[str] = (),
) -> DataFrame:
    """Label rows train, validation or test by their place in time order.

    order: columns that tell rows of equal time apart.
    """
    placed = row_slots(df, keys, [F.col(time), *map(F.col, order)], F.date_trunc("hour", F.col(time)))
    joined = _with_series_size(placed, Series(tuple(keys)))
    first = F.floor(F.col("_n") * train)
    second = first + F.floor(F.col("_n") * validation)
    label = F.when(F.col(SLOT) < first, "train").when(F.col(SLOT) < second, "validation").otherwise("test")
    return joined.withColumn("split", label).drop(SLOT, BLOCK, "_n")


def _with_series_size(placed: DataFrame, series: Series) -> DataFrame:
    """Add the row count of the series, joined per block, not per key."""
    cut = placed.withColumn(BLOCK, series.block_of(F.col(SLOT)))
    whole = Window.partitionBy(*series.keys)
    sizes = (
        cut.groupBy(*series.home)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*series.home, F.sum("_rows").over(whole).alias("_n"))
    )
    return join_on(cut, sizes, series.home)


def top_variance(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """The n columns of largest sample variance."""
    one = df.agg(*(F.var_samp(c).alias(c) for c in columns))
    return (
        one.unpivot([], list(columns), "feature", "variance")
        .filter(F.col("variance").isNotNull())
        .orderBy(F.desc("variance"), "feature")
        .limit(n)
    )


def top_correlation(df: DataFrame, features: Sequence[str], target: str, n: int) -> DataFrame:
    """feature, rows and correlation of the n features most correlated with the target, ties by name.

    Rows where the feature or the target is missing are left out of its pair.
    """
    parts = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features]
    pairs = df.select(F.col(target).alias("y"), F.explode(F.array(*parts)).alias("p")).select("y", "p.*").dropna()
    return (
        pairs.groupBy("feature")
        .agg(F.count(F.lit(1)).alias("rows"), F.corr("x", "y").alias("correlation"))
        .where("correlation is not null and not isnan(correlation)")
        .orderBy(F.desc(F.abs("correlation")), "feature")
        .limit(n)
    )


def forward_return(
    df: DataFrame,
    price: str = "mid_price",
    *,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """Relative change to the next row, 0 on the last one. `df` is read twice and shuffled once."""
    hour = F.date_trunc("hour", F.col(order[0]))
    seen = running_rows(df, keys, [F.col(c) for c in order], hour, {"_next": ("after", F.col(price))})
    target = F.coalesce(fdiv(F.col("_next"), F.col(price)) - 1, F.lit(0.0))
    return seen.withColumn("target", target).drop("_next")
