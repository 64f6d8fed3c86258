"""Hierarchical weighted hash tree: region, rack, shard.

Each node draws ``-ln(u) / weight`` with u from a hash of the key and the node;
the smallest draw wins, so a child is chosen in proportion to its weight and a
changed weight moves rows only into or out of that child. A key descends three
levels and looks only at the children on its path. A new shard opens a region of
its own: no other weight changes, hence it takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("region", "rack", "shard")
BLOCK_ROWS = 1 << 16


@dataclass(frozen=True)
class HashTree:
    """regions: for each region its racks, for each rack (shard, weight) pairs."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def regular(regions: int, racks: int, shards: int) -> HashTree:
        """Equal weights, shards numbered through."""
        number = iter(range(regions * racks * shards))
        return HashTree(
            tuple(tuple(tuple((next(number), 1.0) for _ in range(shards)) for _ in range(racks)) for _ in range(regions))
        )

    @property
    def shards(self) -> list[tuple[int, float]]:
        return [s for region in self.regions for rack in region for s in rack]

    def with_shard(self, weight: float = 1.0) -> HashTree:
        """One more shard, in a new region."""
        number = max((s for s, _ in self.shards), default=-1) + 1
        return HashTree((*self.regions, (((number, weight),),)))

    def reweighted(self, shard: int, weight: float) -> HashTree:
        """Another weight of one shard; rows outside its region stay unless they move into it or out of it."""
        return HashTree(
            tuple(
                tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region)
                for region in self.regions
            )
        )


def _uniform(key: Column, level: str, node: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of node and key."""
    digest = F.md5(F.concat(F.lit(level + "/"), node, F.lit("/"), key))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _choose(key: Column, level: str, children: Column) -> Column:
    """Number of the child with the least draw; ties go to the lower number."""
    draws = F.transform(
        children,
        lambda c: F.struct((-F.log(_uniform(key, level, c["name"])) / c["weight"]).alias("draw"), c["number"].alias("number")),
    )
    return F.array_min(draws)["number"]


def _children(nodes: list[tuple[str, int, float]]) -> Column:
    """Nodes of weight above zero as an array literal."""
    live = [
        F.struct(F.lit(name).alias("name"), F.lit(number).alias("number"), F.lit(float(weight)).alias("weight"))
        for name, number, weight in nodes
        if weight > 0
    ]
    return F.array(*live) if live else F.array().cast("array<struct<name:string,number:int,weight:double>>")


def descend(key: Column, tree: HashTree) -> Column:
    """The shard of a key, as a column expression; no shuffle."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    regions, racks, shards = [], [], []
    for r, region in enumerate(tree.regions):
        inner = []
        for k, rack in enumerate(region):
            weight = sum(w for _, w in rack)
            inner.append((f"{r}/{k}", len(shards), weight))
            shards.append(_children([(str(s), s, w) for s, w in rack]))
        regions.append((str(r), r, sum(w for _, _, w in inner)))
        racks.append(_children(inner))
    region = _choose(key, "region", _children(regions))
    rack = _choose(key, "rack", F.element_at(F.array(*racks), region + 1))
    return _choose(key, "shard", F.element_at(F.array(*shards), rack + 1)).cast("int")


def assign_shards(docs: DataFrame, tree: HashTree, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """All columns of ``docs`` and the shard of each row.

    The key alone decides: equal keys share a shard, NULL counts as the word
    "null", a column called ``name`` is replaced.
    """
    return docs.withColumn(name, descend(F.col(key), tree))


def shard_digest(
    docs: DataFrame, tree: HashTree, id_column: str = "doc_id", text_column: str = "text", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard of every row.

    ``slot`` numbers the rows of a shard from 0 without gaps. Rows are numbered
    inside blocks of about ``block_rows`` rows, and the blocks of a shard follow
    each other, so no task holds a shard. Equal (id, checksum, size) rows, however
    many, travel as one row with a count. A NULL text has size 8 and no checksum;
    an empty table gives an empty result. Only the id and the digest of the text
    are shuffled.
    """
    blocks = max(1, -(-docs.count() // block_rows))
    text = F.col(text_column)
    own = docs.select(
        F.col(id_column).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = F.coalesce(F.col("_id").cast("string"), F.lit("null"))
    spread = F.md5(F.concat(key, F.lit("/"), F.coalesce(F.col("text_crc32").cast("string"), F.lit("null"))))
    groups = (
        own.groupBy("_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "*",
            (F.conv(F.substring(spread, 1, 8), 16, 10).cast("long") % blocks).alias("_block"),
            descend(F.col("_id"), tree).alias("shard"),
            descend(F.col("_id"), tree.with_shard()).alias("grown_shard"),
        )
    )
    inside = Window.partitionBy("shard", "_block").orderBy("_id", "text_crc32", "size")
    placed = groups.withColumn("_ahead", F.sum("_n").over(inside) - F.col("_n"))
    counts = groups.groupBy("shard", "_block").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    # A count of millions is opened in two steps, the second one spread again.
    steps = placed.join(counts, ["shard", "_block"]).withColumn(
        "_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / block_rows)))
    )
    first = F.col("_step") * block_rows
    last = F.least(first + block_rows, F.col("_n")) - 1
    rows = steps.withColumn("_k", F.explode(F.sequence(first, last)))
    return rows.select(
        F.col("_id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_start") + F.col("_ahead") + F.col("_k")).cast("long").alias("slot"),
        "grown_shard",
    )
