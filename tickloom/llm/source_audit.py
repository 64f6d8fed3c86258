"""Source divergence audit: how far the sources of a language differ, and by which terms.

Terms are counted in numpy. Each is packed by its length: up to 8 bytes into one
uint64 word, up to 16 into two, and sorted by a radix sort of 16-bit digits, of
which a short bucket has few; longer terms go to buckets of their own and are
sorted as bytes. Equal neighbours are runs, and runs are counts per (language,
source) and per document. Spark adds the runs up by term.

Probabilities are integers in parts of 10^9, so every figure is exact. Pairs of
sources are compared in blocks of terms, a dense (source x term) table at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.words import LETTER, Block, blocks, owners
from tickloom.session import materialize

RUN_BYTES = 4 << 20
EMIT_ROWS = 1 << 16
BLOCK_CELLS = 1 << 16
LEAST_TERMS = 64
UNIT = 1_000_000_000
WORD = 8


# -- counting runs ----------------------------------------------------------


def radix_order(digits: list[np.ndarray]) -> np.ndarray:
    """Order of items by 16-bit digits, the least significant first; equal items keep their order."""
    order = None
    for digit in digits:
        if digit[0] == digit[-1] and (digit == digit[0]).all():
            continue
        if order is None:
            order = np.argsort(digit, kind="stable")
        else:
            order = order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(digits[0])) if order is None else order


def _digits(word: np.ndarray, used: int) -> list[np.ndarray]:
    """The upper ``used`` 16-bit digits of a word, the lowest first."""
    return [(word >> np.uint64(16 * k)).astype(np.uint16) for k in range(4 - used, 4)]


def pack(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes of spans of at most 8 bytes as big-endian words; ``data`` ends with 8 spare bytes."""
    at_each = np.ndarray(len(data) - WORD + 1, ">u8", data, strides=(1,))
    spare = (8 * (WORD - lengths)).astype(np.uint64)
    # A shift by 64 is not defined, hence two shifts.
    half = spare >> np.uint64(1)
    return (at_each[starts].astype(np.uint64) >> half >> (spare - half)) << half << (spare - half)


def long_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Spans as byte strings of one width, filled up with zeros."""
    at_each = np.ndarray(len(data) - width + 1, f"S{width}", data, strides=(1,))
    cells = at_each[starts].view(np.uint8).reshape(-1, width)
    cells[np.arange(width) >= lengths[:, None]] = 0
    return cells.reshape(-1).view(f"S{width}")


class Runs:
    """Distinct (term, group) of a block: where a first copy lies, group, count and documents."""

    def __init__(self, block: Block, group: np.ndarray):
        starts, ends, offsets = block.runs(LETTER)
        doc = owners(offsets)
        lengths = ends - starts
        longest = int(lengths.max(initial=0))
        spare = max(2 * WORD, 1 << max(longest - 1, 0).bit_length())
        data = np.concatenate([block.data, np.zeros(spare, np.uint8)])
        parts = []
        # Lengths 1-2, 3-4, ..., 15-16 need 1 to 8 digits, longer ones a power of two in bytes.
        digits = (lengths + 1) // 2
        bucket = np.where(lengths <= 2 * WORD, digits, 8 + np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for b in np.unique(bucket):
            items = np.flatnonzero(bucket == b)
            parts.append(self._bucket(data, starts[items], lengths[items], group[doc[items]], doc[items], int(b)))
        self.data = data
        fields = zip(*parts, strict=True) if parts else [[np.zeros(0, np.int64)]] * 5
        self.starts, self.lengths, self.groups, self.counts, self.docs = (np.concatenate(list(f)) for f in fields)

    @staticmethod
    def _bucket(data, starts, lengths, group, doc, bucket: int):
        by_group = [group.astype(np.uint16), (group >> 16).astype(np.uint16)]
        if bucket <= 4:
            words = [pack(data, starts, lengths)]
            order = radix_order([*by_group, *_digits(words[0], bucket)])
        elif bucket <= 8:
            words = [pack(data, starts, np.full_like(lengths, WORD)), pack(data, starts + WORD, lengths - WORD)]
            order = radix_order([*by_group, *_digits(words[1], bucket - 4), *_digits(words[0], 4)])
        else:
            words = [long_bytes(data, starts, lengths, 1 << (bucket - 8))]
            order = radix_order(by_group)
            order = order[np.argsort(words[0][order], kind="stable")]
        fresh = np.ones(len(order), bool)
        fresh[1:] = group[order][1:] != group[order][:-1]
        for word in words:
            fresh[1:] |= word[order][1:] != word[order][:-1]
        first = np.flatnonzero(fresh)
        # Equal (term, group) items are still in text order, so documents are runs too.
        new_doc = fresh.copy()
        new_doc[1:] |= doc[order][1:] != doc[order][:-1]
        head = order[first]
        return (
            starts[head],
            lengths[head],
            group[head],
            np.diff(np.append(first, len(order))),
            np.add.reduceat(new_doc.astype(np.int64), first),
        )

    def terms(self, rows: slice) -> pa.Array:
        """Terms of some runs as a string column."""
        starts, lengths = self.starts[rows], self.lengths[rows]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)
        offsets = pa.py_buffer(ends.astype(np.int32))
        return pa.Array.from_buffers(pa.string(), len(starts), [None, offsets, pa.py_buffer(self.data[at])])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text"), limit=RUN_BYTES):
            rows = batch.slice(block.first, len(block))
            pairs = pa.StructArray.from_arrays([rows.column("lang"), rows.column("source")], ["lang", "source"])
            group = _codes(pairs)
            runs = Runs(block, group)
            one = np.zeros(int(group.max(initial=0)) + 1, np.int64)
            one[group] = np.arange(len(block))  # a row of each group
            for first in range(0, len(runs.starts), EMIT_ROWS):
                part = slice(first, first + EMIT_ROWS)
                named = pairs.take(pa.array(one[runs.groups[part]]))
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": named.field(0),
                        "source": named.field(1),
                        "term": runs.terms(part),
                        "n": pa.array(runs.counts[part], pa.int64()),
                        "docs": pa.array(runs.docs[part], pa.int64()),
                    }
                )


def _codes(pairs: pa.StructArray) -> np.ndarray:
    """Number of each row's (lang, source) among those of the block."""
    lang = pairs.field(0).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    source = pairs.field(1).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.unique(lang * (source.max(initial=0) + 1) + source, return_inverse=True)[1]


def term_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold it), one row per term of a group."""
    rows = _plain(docs, text_column, lang_column, source_column)
    made = rows.mapInArrow(_count_batches, "lang string, source string, term string, n bigint, docs bigint")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _plain(docs: DataFrame, text_column: str, lang_column: str, source_column: str) -> DataFrame:
    named = {"lang": lang_column, "source": source_column, "text": text_column}
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in named.items()))


# -- divergences ------------------------------------------------------------


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact at any size; 0 without terms."""
    # Decimal products hold 10^9 times any count, which a long would not.
    upper = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    lower = (total + 2 * terms).cast("decimal(20,0)")
    value = F.call_function("div", upper, F.when(terms > 0, lower))
    return F.coalesce(value + 1, F.lit(0)).cast("long")


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit_sources(
    docs: DataFrame,
    min_docs: int = 10,
    top: int = 10,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part ``pair``: each other source of the language with the divergence summed over
    all kept terms. Part ``term``: the ``top`` kept terms by which a source lies above
    its language. NULL text, lang and source count as empty; a source without terms
    has pairs but no terms, a language without kept terms has pairs of value 0, a
    language with one source has no pairs. Repeated rows count as often as they
    occur, equal values rank by item in byte order. Texts and terms are read whole
    at any length. An empty table gives an empty result; other columns play no part.
    """
    rows = _plain(docs, text_column, lang_column, source_column)
    counts = materialize(
        term_counts(docs, text_column, lang_column, source_column)
        .groupBy("lang", "term")
        .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by_source"))
        .where(F.col("docs") >= min_docs)
        .drop("docs")
    )
    listed = counts.select("lang", "term", "lang_n", F.explode("by_source").alias("s")).select("lang", "term", "lang_n", "s.*")
    present = listed.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = counts.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = rows.select("lang", "source").distinct()
    groups = groups.join(present, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "lang_total"])
    sources = Window.partitionBy("lang")
    held = F.greatest(F.lit(LEAST_TERMS), F.floor(F.lit(block_cells) / F.count(F.lit(1)).over(sources)))
    groups = materialize(
        groups.withColumns(
            {
                "blocks": F.greatest(F.lit(1), F.ceil(F.col("terms") / held)).cast("long"),
                "absent": _share(F.lit(0), F.col("total"), F.col("terms")),
            }
        )
    )
    # A source has a row per kept term at most, so no (lang, source) outweighs the terms.
    shares = listed.join(groups, ["lang", "source"]).withColumns(
        {
            "p": _share(F.col("n"), F.col("total"), F.col("terms")),
            "q": _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")),
        }
    )
    pairs = _pairs(groups, shares)
    pairs = pairs.withColumn("rank", F.row_number().over(_ranking()))
    terms = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value")
    )
    # Spark keeps the first rows of each group before it shuffles them.
    terms = terms.withColumn("rank", F.row_number().over(_ranking())).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def _ranking():
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Divergences of all ordered pairs of sources of a language, added up over blocks of terms."""
    every = groups.select(
        "lang",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        "source",
        F.lit(None).cast("string").alias("term"),
        F.col("absent").alias("p"),
    )
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    cells = every.unionByName(shares.select("lang", block, "source", "term", "p"))
    # Names travel as bytes: what is not UTF-8 has no place in a pandas string.
    cells = cells.withColumns({c: F.col(c).cast("binary") for c in ("lang", "source", "term")})
    made = cells.groupBy("lang", "block").applyInPandas(_compare, "lang binary, source binary, item binary, value bigint")
    made = made.withColumns({c: F.col(c).cast("string") for c in ("lang", "source", "item")})
    return made.groupBy("lang", "source", F.lit("pair").alias("part"), "item").agg(F.sum("value").alias("value"))


def _compare(cells: pd.DataFrame) -> pd.DataFrame:
    """Sums over the terms of a block for all pairs of sources; rows without a term give a source's share of absent terms."""
    base = cells[cells["term"].isna()].sort_values("source", ignore_index=True)
    own = cells[cells["term"].notna()]
    names = base["source"].to_numpy()
    place = {name: k for k, name in enumerate(names)}
    column, found = pd.factorize(own["term"])
    table = np.repeat(base["p"].to_numpy(np.int64)[:, None], len(found), axis=1)
    table[own["source"].map(place).to_numpy(np.int64), column] = own["p"].to_numpy(np.int64)
    out = []
    for k, name in enumerate(names):
        gap = table - table[k]
        sums = (gap * gap // np.maximum(table + table[k], 1)).sum(axis=1)
        others = np.arange(len(names)) != k
        out.append(pd.DataFrame({"lang": base["lang"].iloc[0], "source": name, "item": names[others], "value": sums[others]}))
    return pd.concat(out, ignore_index=True)
