"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of a letter trigram is
the product of the vectors of its letters, each permuted by its place; a text is
the sum of its trigram vectors. Language prototypes are the sums over all
training texts. A text goes to the prototype of largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words
from tickloom.llm.learning import fold

DIMENSIONS = 1024
SEED = 20240
GRAM = 3
CACHE_ROWS = 1 << 14
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For every code point its lower-case letter, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


@cache
def _letter_vector(point: int, dimensions: int) -> np.ndarray:
    random = np.random.Generator(np.random.Philox(key=[SEED, point]))
    return (2 * random.integers(0, 2, dimensions, dtype=np.int8) - 1).astype(np.int8)


class GramVectors:
    """Vectors of trigrams; the last CACHE_ROWS new ones are kept."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.rows = np.zeros((CACHE_ROWS, dimensions), np.float32)
        self.codes = np.zeros(0, np.uint64)
        self.order = np.zeros(0, np.int64)

    def _vector(self, code: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for place in range(GRAM):
            point = (code >> (21 * (GRAM - 1 - place))) & 0x1FFFFF
            out = out * np.roll(_letter_vector(point, self.dimensions), GRAM - 1 - place)
        return out.astype(np.float32)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of counts times vectors, in parts that the cache can hold. codes: sorted, distinct."""
        out = np.zeros(self.dimensions, np.float64)
        for at in range(0, len(codes), CACHE_ROWS // 4):
            part = codes[at : at + CACHE_ROWS // 4]
            out += counts[at : at + CACHE_ROWS // 4].astype(np.float32) @ self.rows[self._places(part)]
        return out

    def _places(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        known = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)
        fresh = codes[~known]
        if len(fresh):
            if len(self.codes) + len(fresh) > CACHE_ROWS:
                self.codes, self.order, fresh = np.zeros(0, np.uint64), np.zeros(0, np.int64), codes
            base = len(self.codes)
            for k, code in enumerate(fresh.tolist()):
                self.rows[base + k] = self._vector(code)
            merged = np.concatenate([self.codes, fresh])
            order = np.argsort(merged, kind="stable")
            places = np.concatenate([self.order, base + np.arange(len(fresh))])
            self.codes, self.order = merged[order], places[order]
            at = np.searchsorted(self.codes, codes)
        return self.order[at]


def grams(block: words.Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text that has a letter: its number, trigram codes and counts.

    What is no letter counts as a blank, runs of blanks as one, and a text is
    taken to begin and end with a blank.
    """
    points = np.frombuffer(block.raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((block.raw & 0xC0) != 0x80)])
    offsets = lead[block.offsets]
    letters = _letters()[points]
    for k in range(len(block)):
        own = letters[offsets[k] : offsets[k + 1]]
        if not own.any():
            continue
        own = np.concatenate([[0], own, [0]]).astype(np.uint64)
        own = own[np.concatenate([[True], (own[1:] != 0) | (own[:-1] != 0)])]
        code = np.zeros(len(own) - GRAM + 1, np.uint64)
        for place in range(GRAM):
            code = (code << np.uint64(21)) | own[place : len(own) - GRAM + 1 + place]
        yield (block.first + k, *np.unique(code, return_counts=True))


def language_prototypes(docs: DataFrame, text_column: str, lang_column: str, dimensions: int = DIMENSIONS) -> dict:
    """Sum of the vectors of all texts of each non-NULL language.

    Each task sends one row per language and dimension, whatever it has read; the
    result has as many rows as languages times dimensions.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = GramVectors(dimensions), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for block in words.blocks(batch.column(1)):
                codes: dict = {}
                for k, code, count in grams(block):
                    codes.setdefault(langs[k], []).append((code, count))
                for lang, own in codes.items():
                    code, inverse = np.unique(np.concatenate([c for c, _ in own]), return_inverse=True)
                    count = np.bincount(inverse, np.concatenate([n for _, n in own]))
                    sums[lang] = sums.get(lang, 0) + vectors.bundle(code, count)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * dimensions, pa.string()),
                    pa.array(np.arange(dimensions, dtype=np.int32)),
                    pa.array(np.rint(total).astype(np.int64)),
                ],
                ["lang", "dimension", "total"],
            )

    rows = (
        docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
        .select(F.col(lang_column).cast("string").alias("lang"), F.make_valid_utf8(F.col(text_column)).alias("text"))
        .mapInArrow(part, "lang string, dimension int, total long")
        .groupBy("lang", "dimension")
        .agg(F.sum("total").alias("total"))
        .toArrow()
    )
    out: dict[str, np.ndarray] = {}
    for lang, dimension, total in zip(*(rows[c].to_pylist() for c in ("lang", "dimension", "total")), strict=True):
        out.setdefault(lang, np.zeros(dimensions))[dimension] = total
    return out


def identify_languages(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    modulus: int = 4,
    held_out: int = 2,
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """id, held_out, lang_pred and score (cosine, 0 at least) of every row.

    Prototypes come from the rows outside the held-out fold. A NULL or empty text,
    one without a letter, and every text where nothing could be learned, get
    "und" and score 0. Ties go to the language that sorts first. Repeated rows are
    learned from and scored as often as they occur, texts whole at any length; bytes
    that are not UTF-8 count as the replacement character, no letter. Other columns
    are not read.
    """
    learned = language_prototypes(docs.where(fold(id_column, modulus) != held_out), text_column, lang_column, dimensions)
    langs = sorted(learned)
    table = np.array([learned[k] / max(np.linalg.norm(learned[k]), 1e-300) for k in langs])
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = GramVectors(dimensions)
        for batch in batches:
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for block in words.blocks(batch.column(2)) if langs else ():
                for k, code, count in grams(block):
                    own = vectors.bundle(code, count)
                    cosines = table @ own / max(np.linalg.norm(own), 1e-300)
                    best[k] = int(np.argmax(cosines))
                    score[k] = min(max(cosines[best[k]], 0.0), 1.0)
            names = pa.array([langs[k] if k >= 0 else UNKNOWN for k in best], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), names, pa.array(score)], [id_column, "held_out", "lang_pred", "score"]
            )

    text = F.make_valid_utf8(F.col(text_column)).alias("_text")
    return docs.select(id_column, (fold(id_column, modulus) == held_out).alias("_held_out"), text).mapInArrow(
        run, f"`{id_column}` {id_type}, held_out boolean, lang_pred string, score double"
    )
