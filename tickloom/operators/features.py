"""The feature-set API: configured indicators over OHLCV bars."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tickloom.operators.indicators  # noqa: F401  fills the registry
from tickloom.functions import defined
from tickloom.operators.blocks import DEFAULT_ROWS, SLOT, Series, fill_missing, place, row_slots, time_slot
from tickloom.operators.catalog import standard_specs
from tickloom.operators.graph import Graph, Node
from tickloom.operators.indicators.pattern import Ordered
from tickloom.operators.registry import Registry, Spec, load_config, registry
from tickloom.operators.sequential import WARM_UP, ordered_pass

log = logging.getLogger(__name__)

OHLCV = ("open", "high", "low", "close", "volume")


def check_ohlcv(df: DataFrame) -> None:
    missing = [c for c in OHLCV if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


class FeatureSet:
    """A configured list of indicator columns.

    config: path of a YAML file, a list of specs, or None for the standard set.
    """

    def __init__(self, config: str | list[Spec] | None = None, indicators: Registry = registry):
        if config is None:
            specs = standard_specs()
        elif isinstance(config, str):
            specs = load_config(config)
        else:
            specs = list({s.name: s for s in config}.values())
        self.registry = indicators
        self.specs, self.skipped = indicators.check(specs)

    @property
    def names(self) -> list[str]:
        return [s.name for s in self.specs]

    def describe(self, spark: SparkSession) -> DataFrame:
        rows = []
        for s in self.specs:
            builder = self.registry.get(s.cls)
            window = s.params.get("window", s.params.get("slow"))
            rows.append((s.name, s.cls, s.category, builder.__module__, window))
        return spark.createDataFrame(rows, "name string, class string, category string, module string, window int")

    def transform(
        self,
        df: DataFrame,
        names: Sequence[str] | None = None,
        *,
        keys: Sequence[str] = ("symbol",),
        time: str = "ts",
        every: int | None = None,
        fill: str = "zero",
        complete: bool = False,
        block_rows: int = DEFAULT_ROWS,
        warm_up: int = WARM_UP,
        keep: Sequence[str] | None = None,
        order: Sequence[str] = (),
    ) -> DataFrame:
        """Append the indicator columns to `df`.

        every: seconds between bars where the bars form a dense grid; None
            numbers the rows in time order first.
        fill: zero, ffill, bfill or none.
        complete: the bar columns hold no missing value, as those of
            `bars.trade_bars` do.
        keep: input columns to return; all by default.
        order: columns that tell rows of equal time apart, where `every` is None.
        """
        specs = self._choose(names)
        series = Series(tuple(keys), block_rows)
        columns = list(keep) if keep is not None else df.columns
        if every is not None:
            rows = df.withColumn(SLOT, time_slot(F.col(time), every))
        else:
            rows = row_slots(df, keys, [F.col(time), *map(F.col, order)], F.date_trunc("hour", F.col(time)))
        graph = Graph(series, [c for c in df.columns if c not in keys and c != time], complete)
        outputs: dict[str, Node | Ordered | None] = {}
        for s in specs:
            try:
                outputs[s.name] = self.registry.get(s.cls)(graph, **s.params)
                if isinstance(outputs[s.name], Ordered):
                    check_ohlcv(df)
            except ValueError as problem:
                log.error("%s is left missing: %s", s.name, problem)
                outputs[s.name] = None
        ordered = {n: o for n, o in outputs.items() if isinstance(o, Ordered)}
        plain = {n: o for n, o in outputs.items() if n not in ordered}
        if ordered:
            needed = [*columns, *graph.reads(o for o in plain.values() if o is not None), *OHLCV]
            rows = self._ordered_columns(rows.select(*dict.fromkeys([*keys, SLOT, *needed])), graph, ordered, warm_up)
        result = graph.evaluate(rows, plain, list(dict.fromkeys([*columns, *ordered, SLOT, *keys])))
        names_out = [s.name for s in specs]
        present = [n for n in names_out if outputs[n] is not None]
        result = result.withColumns({n: defined(F.col(n)) for n in present})
        if fill in ("ffill", "bfill"):
            result = place(result, series)
        result = fill_missing(result, series, present, fill)
        taken = {n.lower() for n in names_out}
        return result.select(*[c for c in columns if c.lower() not in taken], *names_out)

    def _choose(self, names: Sequence[str] | None) -> list[Spec]:
        if names is None:
            return self.specs
        known = {s.name: s for s in self.specs}
        for name in names:
            if name not in known:
                log.warning("indicator %s is not configured", name)
        return [known[n] for n in dict.fromkeys(names) if n in known]

    @staticmethod
    def _ordered_columns(rows: DataFrame, graph: Graph, ordered: dict[str, Ordered], warm_up: int) -> DataFrame:
        """Add the outputs that need an ordered pass, all in one pass."""
        inputs = {c: node for item in ordered.values() for c, node in item.inputs.items()}
        machines = {item.key: item.machine for item in ordered.values()}
        if inputs:
            rows = graph.evaluate(rows, inputs, rows.columns)
        rows = ordered_pass(rows, graph.series, list(machines.values()), warm_up)
        for name, item in ordered.items():
            rows = item.finish(rows, graph.series, name)
        return rows.drop(*inputs, *(c for m in machines.values() for c in m.outputs))
