"""Exact duplicates through an extendible-hash index on shared files.

Every text has a 64-bit key. The directory has 2^d pointers, one per d-bit key
prefix; it is doubled, one bit more at a time, until no bucket holds more bytes
of distinct texts than fit. A bucket is therefore a range of keys, and all texts
of a range are brought to one owner task, which compares whole texts byte by
byte. Different texts of equal key are chained. The entries are written in key
order to the shared folder and every row then looks its entry up by key; only
rows whose key has a chain compare texts once more.

DataFrame functions only; nothing is collected but one row of totals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialize

MAX_DEPTH = 18  # bits, so the directory never has more than 2^18 pointers
BUCKET_BYTES = 1 << 20
HOT_SHARE = 1024  # a key is hot above 1/1024 of all rows: there are fewer than 1,024
HOT_ROWS = 64
OPEN_ROWS = 1 << 16


@dataclass(frozen=True)
class ExactIndex:
    """What ``build_index`` leaves on shared files.

    keys: key of every row (``_id, _key, _bytes``); directory: ``pointer, bucket,
    local_depth``; hot: the keys that were salted, with their rows; entries: one row
    per distinct text with ``bucket, _key, chain`` (place among texts of equal key),
    ``chains`` (how many there are), ``keep_id, group_size, text_sha256`` and
    ``_text`` where there is a chain.
    """

    keys: DataFrame
    hot: DataFrame
    directory: DataFrame
    depth: int
    entries: DataFrame


def key_of(text: Column, bits: int = 64) -> Column:
    """The first ``bits`` bits of the 64-bit hash, in place; the rest is zero."""
    value = F.xxhash64(text)
    return value if bits >= 64 else F.shiftleft(F.shiftrightunsigned(value, 64 - bits), 64 - bits)


def grow_directory(heads: DataFrame, capacity: int) -> DataFrame:
    """Buckets of the directory, ``prefix, local_depth``, from one (key, bytes) row per key.

    Starting from a single bucket, each that holds more than ``capacity`` bytes and
    more than one key is split by the next bit, at most MAX_DEPTH times. A bucket is
    so a prefix that is not overfull while all shorter ones are; sizes of all
    prefixes come from one table of at most 2^18 cells.
    """
    cells = heads.groupBy(F.shiftrightunsigned("_key", 64 - MAX_DEPTH).alias("_cell")).agg(
        F.sum("_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_texts")
    )
    prefix = F.expr(f"shiftright(_cell, {MAX_DEPTH} - local_depth)")
    nodes = (
        cells.withColumn("local_depth", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))))
        .groupBy("local_depth", prefix.alias("prefix"))
        .agg(F.sum("_bytes").alias("_bytes"), F.sum("_texts").alias("_texts"))
    )
    overfull = (F.col("_bytes") > capacity) & (F.col("_texts") > 1)
    nodes = nodes.withColumn("_split", overfull & (F.col("local_depth") < MAX_DEPTH))
    split = nodes.where("_split").select(
        (F.col("local_depth") + 1).alias("local_depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")
    )
    below = nodes.where("not _split and local_depth > 0").join(split, ["local_depth", "prefix"], "left_semi")
    root = nodes.where("not _split and local_depth = 0")
    return root.unionByName(below).select("prefix", "local_depth")


def build_index(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    key_bits: int = 64,
) -> ExactIndex:
    """Index all texts; NULL counts as the empty text.

    Buckets hold about ``bucket_bytes``, or 2^-16 of all bytes if that is more. Rows
    of a hot key are dealt to several tasks by salt and their partial entries are
    combined, so a text that a third of all rows share is no task of its own.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    hashed = docs.select(F.col(id_column).alias("_id"), text.alias("_text"), key_of(text, key_bits).alias("_key"))
    keys = materialize(hashed.select("_id", "_key", F.octet_length("_text").cast("long").alias("_bytes")))
    heads = materialize(keys.groupBy("_key").agg(F.max("_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_rows")))
    rows, size = heads.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.sum("_bytes"), F.lit(0))).first()

    buckets = materialize(grow_directory(heads, max(bucket_bytes, size >> (MAX_DEPTH - 2))))
    depth = buckets.agg(F.coalesce(F.max("local_depth"), F.lit(0))).first()[0]
    first = F.expr(f"shiftleft(prefix, {depth} - local_depth)")
    last = F.expr(f"shiftleft(prefix + 1, {depth} - local_depth) - 1")
    directory = buckets.select(
        F.explode(F.sequence(first, last)).alias("pointer"), first.alias("bucket"), "local_depth"
    )
    limit = max(HOT_ROWS, rows // HOT_SHARE)
    hot = materialize(heads.where(F.col("_rows") > limit).select("_key", "_rows"))

    # Both tables have a fixed bound: 2^18 pointers, 1,024 hot keys.
    pointer = F.shiftrightunsigned("_key", 64 - depth) if depth else F.lit(0).cast("long")
    salts = F.ceil(F.col("_rows") / limit)
    dealt = (
        hashed.join(F.broadcast(hot), "_key", "left")
        .withColumn("_salt", F.when(F.col("_rows").isNull(), -1).otherwise(F.pmod(F.monotonically_increasing_id(), salts)))
        .withColumn("pointer", pointer)
        .join(F.broadcast(directory.select("pointer", "bucket")), "pointer")
        .select("bucket", "_salt", "_key", "_text", "_id")
        .repartition("bucket", "_salt")
    )
    owned = dealt.groupBy("bucket", "_salt", "_key", "_text").agg(
        F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    owned = _chained(owned, ["bucket", "_salt", "_key"]).withColumns(
        {
            "text_sha256": F.sha2(F.col("_text").cast("binary"), 256),
            "_text": F.when((F.col("chains") > 1) | (F.col("_salt") >= 0), F.col("_text")),
        }
    )
    owned = materialize(owned)
    merged = (
        owned.where("_salt >= 0")
        .groupBy("bucket", "_key", "_text", "text_sha256")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    merged = _chained(merged, ["bucket", "_key"])
    entries = owned.where("_salt < 0").drop("_salt").unionByName(merged)
    return ExactIndex(keys, hot, directory, depth, entries)


def _chained(entries: DataFrame, same: list[str]) -> DataFrame:
    """Number the texts of equal key."""
    chain = Window.partitionBy(*same)
    return entries.withColumns(
        {
            "chain": F.row_number().over(chain.orderBy("_text")) - 1,
            "chains": F.count(F.lit(1)).over(chain),
        }
    )


def mark_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    key_bits: int = 64,
) -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 of every row.

    Of equal texts the row of the largest id stays; rows of a NULL id stay only
    where no row of the text has one, and keep_id is NULL then. Of rows that share
    text and id one stays. NULL texts count as empty, empty texts are equal to each
    other, texts are compared whole at any length and as bytes, valid UTF-8 or not.
    Rows stay rows: an empty table gives an empty result, other columns of ``docs``
    play no part whatever their names.
    """
    index = build_index(docs, id_column, text_column, bucket_bytes, key_bits)
    entry = index.entries.select("_key", "_text", "chains", "keep_id", "group_size", "text_sha256")
    single = entry.where("chains = 1").drop("_text", "chains")
    hot = F.broadcast(index.hot.select("_key"))
    keys = index.keys.select("_id", "_key")

    # Keys without a chain stand for one text each, so key and id name equal rows.
    cold = keys.join(hot, "_key", "left_anti").repartition("_key").groupBy("_key", "_id").agg(F.count(F.lit(1)).alias("_n"))
    often = keys.join(hot, "_key", "left_semi").groupBy("_key", "_id").agg(F.count(F.lit(1)).alias("_n"))
    found = cold.join(single, "_key").unionByName(
        often.join(F.broadcast(single.join(hot, "_key", "left_semi")), "_key")
    )
    chained = materialize(entry.where("chains > 1").drop("chains"))
    if not chained.isEmpty():
        text = F.coalesce(F.col(text_column), F.lit(""))
        rows = docs.select(F.col(id_column).alias("_id"), text.alias("_text"), key_of(text, key_bits).alias("_key"))
        rows = rows.join(chained.select("_key").distinct(), "_key", "left_semi")
        rows = rows.groupBy("_key", "_id", "_text").agg(F.count(F.lit(1)).alias("_n"))
        found = found.unionByName(rows.join(chained, ["_key", "_text"]).drop("_text").select(*found.columns))

    # A count of millions is opened in two steps, the second one in other tasks.
    steps = found.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / OPEN_ROWS))))
    start = F.col("_step") * OPEN_ROWS
    each = steps.withColumn("_at", F.explode(F.sequence(start, F.least(start + OPEN_ROWS, F.col("_n")) - 1)))
    return each.select(
        F.col("_id").alias(id_column),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_at") == 0)).alias("kept"),
        "text_sha256",
    )
