"""Boosted regression trees from histograms, for the importance of features.

Features are cut into bins of equal width and the target into whole units. A level
of a tree needs, for every node, feature and bin, the rows and the sum of what the
trees so far leave open: one aggregate over the rows, and a table whose size does
not depend on them. The best split of each node is all that reaches the driver.
Sums are whole numbers, so results are the same however rows are dealt.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialize

SHIFT = 0.3183098861


@dataclass(frozen=True)
class Plan:
    """trees and depth of each; bins of a feature; share of a leaf's mean that a tree takes off; least rows of a leaf."""

    trees: int = 20
    depth: int = 3
    bins: int = 64
    rate: float = 0.3
    min_rows: int = 20
    unit: float = 1e-6


@dataclass
class Tree:
    """Splits by node (root 1, children 2k and 2k+1): (feature number, last bin that goes left)."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    leaves: dict[int, int] = field(default_factory=dict)

    def walk(self, bins: Column, values: dict[int, Column], at: int = 1) -> Column:
        """The value of the node a row falls into."""
        if at not in self.splits:
            return values[at]
        number, last = self.splits[at]
        left, right = self.walk(bins, values, 2 * at), self.walk(bins, values, 2 * at + 1)
        return F.when(bins[number] <= last, left).otherwise(right)

    def ends(self, at: int = 1) -> list[int]:
        return [at] if at not in self.splits else [e for child in (2 * at, 2 * at + 1) for e in self.ends(child)]


def binned(df: DataFrame, features: Sequence[str], target: str, plan: Plan) -> DataFrame:
    """(bins, target in units) of the rows in which nothing is missing."""
    clean = df.select(*(F.col(c).cast("double") for c in (*features, target))).where(
        F.forall(F.array(*features, target), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    # Read for the bounds and for the bins, so what leads to the features runs once.
    clean = materialize(clean)
    # Two numbers per feature reach the driver.
    bounds = clean.agg(*(f(c).alias(f"{k}_{c}") for c in features for k, f in (("lo", F.min), ("hi", F.max)))).first()

    def bin_of(c: str) -> Column:
        low, high = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        if low is None or not high > low:
            return F.lit(0)
        part = (F.col(c) - low) / F.lit(high - low)
        return F.least(F.floor(part * plan.bins), F.lit(plan.bins - 1)).cast("int")

    y = F.floor(F.col(target) / F.lit(plan.unit) + SHIFT).cast("long").alias("y")
    return clean.select(F.array(*map(bin_of, features)).alias("bins"), y)


def best_splits(rows: DataFrame, plan: Plan) -> DataFrame:
    """The best split of every node of `rows` (node, bins, rest), by how much it lowers the squared error.

    Equal gains go to the earlier feature, then to the lower bin; a node that no
    split improves has none.
    """
    cells = (
        rows.select("node", "rest", F.posexplode("bins").alias("number", "bin"))
        .groupBy("node", "number", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("rest").alias("s"))
    )
    feature = Window.partitionBy("node", "number")
    upto = feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = cells.select(
        "node", "number", "bin", F.sum("n").over(upto).alias("n1"), F.sum("s").over(upto).alias("s1"),
        F.sum("n").over(feature).alias("n"), F.sum("s").over(feature).alias("s"),
    )

    def part(s: Column, n: Column) -> Column:
        return s.cast("double") * s.cast("double") / n.cast("double")

    n2, s2 = F.col("n") - F.col("n1"), F.col("s") - F.col("s1")
    gain = part(F.col("s1"), F.col("n1")) + part(s2, n2) - part(F.col("s"), F.col("n"))
    judged = sides.where((F.col("n1") >= plan.min_rows) & (n2 >= plan.min_rows)).withColumn("gain", gain)
    order = F.struct("gain", -F.col("number"), -F.col("bin"))
    return judged.where("gain > 0").groupBy("node").agg(F.max_by(F.struct("number", "bin", "gain", "n1", "s1", "n", "s"), order).alias("best")).select("node", "best.*")


def model_importance(df: DataFrame, features: Sequence[str], target: str, n: int, plan: Plan = Plan()) -> DataFrame:
    """feature and importance of the n features that boosted trees gain most from, ties in the given order.

    Importance is a feature's share of all gains. Rows with a missing or infinite
    value are left out; without a split the result is empty.
    """
    rows = materialize(binned(df, features, target, plan))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).first()
    gains = [0.0] * len(features)
    if total["n"]:
        rest = F.col("y") - F.floor(F.lit(float(total["s"])) / F.lit(float(total["n"]))).cast("long")
        bins = F.col("bins")
        for _ in range(plan.trees):
            tree = _grow(rows.withColumn("rest", rest), plan, gains)
            if not tree.splits:
                break
            rest = rest - tree.walk(bins, {at: F.lit(v).cast("long") for at, v in tree.leaves.items()})
    whole = sum(gains)
    ranked = sorted(((g / whole, -k) for k, g in enumerate(gains) if g > 0), reverse=True)[:n]
    found = [(features[-k], share) for share, k in ranked]
    return df.sparkSession.createDataFrame(found, "feature string, importance double")


def _grow(rows: DataFrame, plan: Plan, gains: list[float]) -> Tree:
    """One tree, level by level; adds to the gains of the features."""
    tree, sums = Tree(), {}
    for _ in range(plan.depth):
        node = tree.walk(F.col("bins"), {at: F.lit(at) for at in tree.ends()})
        found = best_splits(rows.withColumn("node", node), plan).collect()  # one row per node
        if not found:
            break
        for x in sorted(found, key=lambda x: x["node"]):
            at = x["node"]
            tree.splits[at] = x["number"], x["bin"]
            gains[x["number"]] += x["gain"]
            sums[2 * at], sums[2 * at + 1] = (x["s1"], x["n1"]), (x["s"] - x["s1"], x["n"] - x["n1"])
    for at in tree.ends():
        if at in sums:
            s, count = sums[at]
            tree.leaves[at] = int(float(s) / float(count) * plan.rate // 1)
    return tree
