"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.operators.features import FeatureSet
from tickloom.plans import indicators, market, risk, views

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [indicators, market, risk]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FeatureSet().transform(
        views.bars(spark, sf_dir), ["SMA_20", "RSI_14", "BB_UPPER"], every=views.HOUR, complete=True
    )


def queries() -> dict[str, Query]:
    return {name: run for module in MODULES for name, run in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    texts = {name: text for module in MODULES for name, text in module.oracle_sql().items()}
    # Short blocks change how a query is computed, not what.
    short = {name: texts[whole] for name in queries() if (whole := name.removesuffix("_blocks")) != name and whole in texts}
    return texts | short
