"""Fill-in-the-middle rows, cut by rank and select on a wavelet matrix.

The bytes of a block of texts are classes (line end, sentence end, blank, other,
continuation of a character), and a wavelet matrix over them holds one bit plane
per bit of a class. Where units begin follows from counts of classes only:

* lines end at line ends: the count of lines is a rank, the end of the k-th line
  a select;
* sentences end at sentence or line ends: the ranks of both classes add up, and
  the k-th end is found by bisection on that sum;
* characters are all bytes but continuations: again bisection on ranks.

Nothing walks through a text, so both cuts of a text cost a few lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.words import Block, blocks

# Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("line", "sentence", "char")

OTHER, LINE_END, SENTENCE_END, INNER = 0, 1, 2, 3
_BYTES = np.arange(256)
CLASSES = np.select(
    [_BYTES == 0x0A, np.isin(_BYTES, [0x2E, 0x21, 0x3F]), (_BYTES & 0xC0) == 0x80], [LINE_END, SENTENCE_END, INNER], OTHER
).astype(np.uint8)


class Plane:
    """A row of bits with rank and select; counts are kept per 64 bits."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        packed = np.zeros((self.size // 64 + 1) * 8, np.uint8)
        packed[: -(-self.size // 8)] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = self.size - int(self.before[-1])

    def ones_before(self, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` bits are set."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def select(self, which: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th bit (from 0) that equals ``which``, by bisection on ranks."""
        return bisect_rank(lambda at: self.ones_before(at) if which else at - self.ones_before(at), k, 0, self.size)


def bisect_rank(rank, k: np.ndarray, low, high) -> np.ndarray:
    """The place of the item of rank k: the largest place with at most k items before it, where ``rank`` counts them."""
    low = np.broadcast_to(np.asarray(low, np.int64), k.shape).copy()
    high = np.broadcast_to(np.asarray(high, np.int64), k.shape).copy()
    while True:
        open_ = high - low > 1
        if not open_.any():
            return low
        middle = (low + high) >> 1
        left = rank(middle) > k
        high = np.where(open_ & left, middle, high)
        low = np.where(open_ & ~left, middle, low)


class WaveletMatrix:
    """Rank and select of two-bit classes over a sequence."""

    BITS = 2

    def __init__(self, classes: np.ndarray):
        self.size = len(classes)
        self.planes = []
        for level in reversed(range(self.BITS)):
            bits = (classes >> level) & 1
            self.planes.append(Plane(bits))
            # Zeros go first, each side in its old order.
            classes = np.concatenate([classes[bits == 0], classes[bits == 1]])

    def rank(self, kind: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` items are of a class."""
        start, end = np.zeros_like(at), at
        for level, plane in zip(reversed(range(self.BITS)), self.planes, strict=True):
            if kind >> level & 1:
                start, end = (plane.zeros + plane.ones_before(x) for x in (start, end))
            else:
                start, end = (x - plane.ones_before(x) for x in (start, end))
        return end - start

    def select(self, kind: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th item (from 0) of a class; it must exist."""
        start = np.zeros(1, np.int64)
        path = []
        for level, plane in zip(reversed(range(self.BITS)), self.planes, strict=True):
            bit = kind >> level & 1
            path.append((plane, bit))
            start = plane.zeros + plane.ones_before(start) if bit else start - plane.ones_before(start)
        at = k + start
        for plane, bit in reversed(path):
            at = plane.select(bit, at - plane.zeros if bit else at)
        return at


class Cutter:
    """Counts and boundaries of the units of all texts of a block."""

    def __init__(self, block: Block, unit: str):
        self.begin, self.end = block.offsets[:-1], block.offsets[1:]
        self.matrix = WaveletMatrix(CLASSES[block.data])
        self.unit = unit
        last = block.data[np.maximum(self.end, 1) - 1] if len(block.data) else np.zeros(len(block), np.uint8)
        self.closed = np.isin(CLASSES[last], {"line": [LINE_END], "sentence": [LINE_END, SENTENCE_END]}.get(unit, []))
        self.first = self.marks(self.begin)

    def marks(self, at: np.ndarray) -> np.ndarray:
        """How many unit marks lie before a place; a boundary count from sums of ranks."""
        if self.unit == "line":
            return self.matrix.rank(LINE_END, at)
        if self.unit == "sentence":
            return self.matrix.rank(LINE_END, at) + self.matrix.rank(SENTENCE_END, at)
        return at - self.matrix.rank(INNER, at)

    def counts(self) -> np.ndarray:
        """Units of each text. Lines and sentences: what follows the last mark is one more."""
        n = self.marks(self.end) - self.first
        if self.unit == "char":
            return n
        return n + ((self.end > self.begin) & ~self.closed)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Where the first k units of each text end."""
        marks = self.marks(self.end) - self.first
        out = np.where(k > 0, self.end, self.begin)
        inner = np.flatnonzero((k > 0) & (k <= marks) if self.unit != "char" else (k > 0) & (k < marks))
        at = self.first[inner] + k[inner]
        if self.unit == "line":
            out[inner] = self.matrix.select(LINE_END, at - 1) + 1
        elif self.unit == "sentence":
            out[inner] = bisect_rank(self.marks, at - 1, self.begin[inner], self.end[inner]) + 1
        else:
            out[inner] = bisect_rank(self.marks, at, self.begin[inner], self.end[inner])
        return out

    def chars(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Code points between two places."""
        return end - start - (self.matrix.rank(INNER, end) - self.matrix.rank(INNER, start))


@dataclass(frozen=True)
class Recipe:
    """Unit of the cuts, seed, per cent of texts transformed, and of these in the order suffix first."""

    unit: str = "line"
    seed: int = 7
    rate: int = 100
    suffix_first: int = 50


def draws(key: Column, seed: int) -> Column:
    """Four 32-bit numbers from the SHA-256 of ``seed:key``; a NULL key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)))


def fill_in_middle(docs: DataFrame, recipe: Recipe = Recipe(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars and output of every row.

    Both cuts are drawn among the n + 1 unit boundaries, so parts may be empty. Form
    is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or
    ``plain``: an empty text, one that contains a marker, or one outside the rate is
    left as it is and has no character counts. NULL texts count as empty and ids
    alone decide the draws, so repeated rows are cut alike and a NULL id counts as an
    empty one. Texts of any length are handled whole, as bytes, valid UTF-8 or not;
    an empty table gives an empty result; other columns play no part.
    """
    if recipe.unit not in UNITS:
        raise ValueError(f"unknown unit: {recipe.unit}")
    id_type = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(
        F.col(id_column).alias("_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("_text"),
        draws(F.col(id_column), recipe.seed).alias("_draws"),
    )
    made = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    cut = rows.mapInArrow(lambda batches: _transform(batches, recipe), f"_id {id_type}, {made}")
    return cut.withColumnRenamed("_id", id_column)


def _transform(batches: Iterator[pa.RecordBatch], recipe: Recipe) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text")
        numbers = batch.column("_draws").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        for block in blocks(texts, lower=False):
            rows = slice(block.first, block.first + len(block))
            yield _transform_block(block, batch.column("_id")[rows], numbers[rows], recipe)


def _transform_block(block: Block, ids: pa.Array, numbers: np.ndarray, recipe: Recipe) -> pa.RecordBatch:
    cutter = Cutter(block, recipe.unit)
    n = cutter.counts()
    picks = numbers[:, :2] % (n + 1)[:, None]
    first, second = cutter.cut(picks.min(1)), cutter.cut(picks.max(1))
    data = block.raw.tobytes()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    outputs, forms = [], []
    for begin, a, b, end, draw in zip(cutter.begin, first, second, cutter.end, numbers, strict=True):
        whole = data[begin:end]
        if not whole or draw[2] % 100 >= recipe.rate or p in whole or s in whole or m in whole:
            form, out = "plain", whole
        else:
            prefix, middle, suffix = data[begin:a], data[a:b], data[b:end]
            if draw[3] % 100 < recipe.suffix_first:
                form, out = "spm", b"".join((s, suffix, p, prefix, m, middle))
            else:
                form, out = "psm", b"".join((p, prefix, s, suffix, m, middle))
        forms.append(form)
        outputs.append(out)
    plain = np.array([f == "plain" for f in forms], bool)
    columns = {
        "_id": ids,
        "n": pa.array(n, pa.int64()),
        "form": pa.array(forms, pa.string()),
        "prefix_chars": pa.array(cutter.chars(cutter.begin, first), pa.int64(), mask=plain),
        "middle_chars": pa.array(cutter.chars(first, second), pa.int64(), mask=plain),
        # Bytes as they are: a text that is not UTF-8 stays what it was.
        "output": pa.array(outputs, pa.binary()).view(pa.string()),
    }
    return pa.RecordBatch.from_pydict(columns)


def restore(output: Column, form: Column) -> Column:
    """The text again, from a row's output and form.

    No text with a marker is transformed and markers begin with a character they do
    not hold again, so the first place where a marker is met is its own.
    """
    size = F.length(F.lit(PREFIX))
    at = F.when(form == "spm", F.locate(PREFIX, output)).otherwise(F.locate(SUFFIX, output))
    end = F.locate(MIDDLE, output)
    one = F.substring(output, size + 1, at - size - 1)
    two = F.substring(output, at + size, end - at - size)
    middle = F.substring(output, end + size, F.length(output))
    return (
        F.when(form == "psm", F.concat(one, middle, two))
        .when(form == "spm", F.concat(two, middle, one))
        .otherwise(output)
    )


def fill_digest(docs: DataFrame, recipe: Recipe = Recipe(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``fill_in_middle`` with checksums of the output and of the text restored from it instead of texts."""
    made = fill_in_middle(docs.select(id_column, text_column), recipe, id_column, text_column)
    back = restore(F.col("output"), F.col("form"))
    return made.select(
        id_column,
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )
