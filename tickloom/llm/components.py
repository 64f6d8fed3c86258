"""Connected components of a link table that no single task can hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import materialize

# Links that a task ties at once.
LINKS_AT_ONCE = 1 << 18


def tied(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``size`` items the least item that the pairs (a, b) tie it to."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _shortened(edges: DataFrame) -> DataFrame:
    """The links of each task as stars around the least nodes; they tie the same nodes."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        least = tied(len(node), at[: len(u)], at[len(u) :])
        own = np.flatnonzero(least != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[least[own]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= LINKS_AT_ONCE:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    return edges.select("u", "v").where("u <> v").mapInArrow(run, "u long, v long")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least node of the neighbourhood: the larger ones, or the smaller ones and the centre."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else both.where("v < u")
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = around.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link down at most, and then none up."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    by_node = ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    return by_node.where("down > 1 or (down = 1 and up > 0)").agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of the links (u, v), which are longs; the root is the least node of its component.

    Alternating large and small stars, for the links that no task has settled
    alone: the number of rounds grows with the logarithm of the longest chain.
    Every round is written to the shared folder.
    """
    edges = materialize(_shortened(_shortened(edges).distinct()))
    rounds = 0
    while not _settled(edges):
        if rounds == most_rounds:
            raise RuntimeError(f"links did not settle in {most_rounds} rounds")
        edges = materialize(_shortened(_stars(_stars(edges, True), False)))
        rounds += 1
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
