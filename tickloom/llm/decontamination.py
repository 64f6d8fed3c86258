"""Benchmark decontamination with a BM25 index of test items and block-max WAND.

Test items are the indexed side, passages of the training texts are the queries.
Impacts are divided by the BM25 score of an item with itself, so a threshold is
a share of the best score possible. For each term and each block of a few items
the index holds the largest impact; a block is opened for a passage only if these
bounds reach the threshold. Opened blocks are walked with WAND pivots, and every
item above the threshold is checked for the word order of its question and the
words of its answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words

BLOCK_ITEMS = 2
PART_ITEMS = 2048
ITEMS_PER_PASS = 50_000
K1, B = 1.2, 0.75
GRAM = 3

_ALNUM = words.LETTER | ((np.arange(256) >= 0x30) & (np.arange(256) <= 0x39))


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last line, else the last sentence, is the answer."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    parts = [x for x in (text or "").split(". ") if x.strip()]
    return (". ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text or "", "")


def _lower(texts: pa.Array) -> pa.Array:
    """Lower-cased texts; what is not UTF-8 in them becomes the replacement character."""
    try:
        return pc.utf8_lower(texts)
    except pa.ArrowInvalid:
        raw = texts.view(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        known = [None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()]
        return pc.utf8_lower(pa.array(known, pa.large_string()))


def _text_words(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for block in words.blocks(pc.utf8_lower(pa.array(texts, pa.string()))):
        starts, ends, offsets = block.runs(_ALNUM)
        hashes = block.hashes(starts, ends)
        out += [hashes[offsets[k] : offsets[k + 1]] for k in range(len(block))]
    return out


def _grams(own: np.ndarray) -> np.ndarray:
    size = min(GRAM, max(len(own), 1))
    return np.unique(words.windows(own, np.array([0, len(own)]), size)[0])


@dataclass
class Index:
    """Items in order of their numbers; postings by term, then item; bounds by term, then block."""

    ids: list
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: np.ndarray
    post_at: np.ndarray
    post_item: np.ndarray
    impact: np.ndarray
    bound_at: np.ndarray
    bound_block: np.ndarray
    bound: np.ndarray
    essential: np.ndarray
    rest: np.ndarray
    longest: int

    @cached_property
    def lists(self) -> dict[int, tuple[list[int], list[float], float]]:
        """By term and block: the items, their impacts and the largest one; made once per process."""
        out = {}
        for t in range(len(self.vocabulary)):
            begin, end = self.post_at[t], self.post_at[t + 1]
            items, impacts = self.post_item[begin:end], self.impact[begin:end]
            for k in range(self.bound_at[t], self.bound_at[t + 1]):
                block = int(self.bound_block[k])
                own = items // BLOCK_ITEMS == block
                out[t * len(self.rest) + block] = (items[own].tolist(), impacts[own].tolist(), float(self.bound[k]))
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lists"}

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


def build_index(
    ids: list, texts: list[str], n_items: int, frequency: dict[int, int], mean_words: float, threshold: float = 0.5
) -> Index | None:
    """Index of these items; ``frequency`` counts the items of the whole benchmark with a word.

    Frequent words are left to a bound of what they add, but only where an item
    cannot reach the threshold with them alone.
    """
    split = [split_item(t) for t in texts]
    questions, answers = _text_words([q for q, _ in split]), _text_words([a for _, a in split])
    whole = [np.concatenate([q, a]) for q, a in zip(questions, answers, strict=True)]
    good = [k for k in range(len(ids)) if len(whole[k])]
    if not good:
        return None
    ids, questions, answers, whole = ([x[k] for k in good] for x in (ids, questions, answers, whole))
    item = np.repeat(np.arange(len(ids)), [len(w) for w in whole])
    key, count = np.unique(np.rec.fromarrays([np.concatenate(whole), item]), return_counts=True)
    term_hash, item = key["f0"].astype(np.uint64), key["f1"].astype(np.int64)
    vocabulary, term = np.unique(term_hash, return_inverse=True)
    df = np.array([frequency[int(v)] for v in vocabulary.view(np.int64)], float)
    length = np.array([len(w) for w in whole])
    idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
    impact = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[item] / mean_words))
    impact /= np.bincount(item, impact)[item]
    pair = term * (len(ids) // BLOCK_ITEMS + 1) + item // BLOCK_ITEMS
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    essential = df <= max(1.0, 0.05 * n_items)
    rest_item = np.bincount(item, np.where(essential[term], 0, impact), len(ids))
    essential[term[rest_item[item] >= 0.8 * threshold]] = True
    rest_item = np.bincount(item, np.where(essential[term], 0, impact), len(ids))
    edges = np.arange(len(vocabulary) + 1)
    return Index(
        ids,
        [_grams(q) for q in questions],
        [np.unique(a) for a in answers],
        vocabulary,
        np.searchsorted(term, edges),
        item,
        impact,
        np.searchsorted(term[first], edges),
        item[first] // BLOCK_ITEMS,
        np.maximum.reduceat(impact, first),
        essential,
        np.maximum.reduceat(rest_item, np.arange(0, len(ids), BLOCK_ITEMS)),
        int(length.max()),
    )


def wand(index: Index, terms: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
    """All items of a block that score the threshold or more for these distinct terms.

    The lists stand at their next item. The pivot is the first item at which the
    bounds of the lists up to it reach the threshold; items before it are skipped.
    """
    found = (index.lists.get(t * len(index.rest) + block) for t in terms.tolist())
    lists = [[*x, 0] for x in found if x]
    out = []
    while lists:
        lists.sort(key=lambda x: x[0][x[3]])
        reach, pivot = 0.0, None
        for x in lists:
            reach += x[2]
            if reach >= threshold - 1e-12:
                pivot = x[0][x[3]]
                break
        if pivot is None:
            break
        if lists[0][0][lists[0][3]] == pivot:
            score = 0.0
            for x in lists:
                if x[0][x[3]] == pivot:
                    score += x[1][x[3]]
                    x[3] += 1
            if score >= threshold - 1e-12:
                out.append((pivot, score))
        else:
            for x in lists:
                while x[3] < len(x[0]) and x[0][x[3]] < pivot:
                    x[3] += 1
        lists = [x for x in lists if x[3] < len(x[0])]
    return out


@dataclass(frozen=True)
class Limits:
    """Shares of an item's own BM25 score, of the question's word triples and of the answer's words."""

    score: float = 0.5
    question: float = 0.5
    answer: float = 0.5


def block_hits(block: words.Block, index: Index, limits: Limits) -> list[tuple]:
    """(text number, item number, score, question share, answer share, first word, last word)."""
    starts, ends, offsets = block.runs(_ALNUM)
    if not len(starts):
        return []
    hashes = block.hashes(starts, ends)
    step = max(32, index.longest)
    halves = np.concatenate([[0], np.cumsum(-(-np.diff(offsets) // step))])
    text = words.owners(offsets)
    half = halves[text] + (np.arange(len(hashes)) - offsets[text]) // step
    # A passage is two halves, so each run of ``step`` words is inside one.
    of_half = words.owners(halves)
    term = index.terms(hashes)
    own = np.flatnonzero((term >= 0) & index.essential[np.maximum(term, 0)])
    size = len(index.vocabulary)
    key = np.unique(half[own].astype(np.int64) * size + term[own])
    earlier = key - size
    earlier = earlier[(earlier >= 0) & (of_half[key // size] == of_half[np.maximum(key // size - 1, 0)])]
    key = np.unique(np.concatenate([key, earlier]))
    passage, term_of = key // size, key % size
    n_blocks, n_passages = len(index.rest), len(of_half)
    count = (index.bound_at[term_of + 1] - index.bound_at[term_of]).astype(np.int64)
    places = np.arange(count.sum()) + np.repeat(index.bound_at[term_of] - np.cumsum(count) + count, count)
    cell = np.repeat(passage, count) * n_blocks + index.bound_block[places]
    reach = np.bincount(cell, index.bound[places], n_passages * n_blocks).reshape(n_passages, n_blocks)
    best: dict[tuple[int, int], tuple] = {}
    for p, b in zip(*np.nonzero((reach > 0) & (reach + index.rest >= limits.score - 1e-9)), strict=True):
        k = int(of_half[p])
        lo = int(offsets[k] + (p - halves[k]) * step)
        hi = int(min(lo + 2 * step, offsets[k + 1]))
        seen = np.unique(term[lo:hi])
        for item, score in wand(index, seen[seen >= 0], int(b), limits.score):
            question, answer = index.questions[item], index.answers[item]
            size_q = min(GRAM, hi - lo)
            grams = np.concatenate([words.windows(hashes[lo:hi], np.array([0, hi - lo]), s)[0] for s in range(1, size_q + 1)])
            share_q = float(np.isin(question, grams).mean()) if len(question) else 1.0
            share_a = float(np.isin(answer, hashes[lo:hi]).mean()) if len(answer) else 1.0
            if share_q >= limits.question and share_a >= limits.answer:
                # Rounded, so that a score does not depend on the order of its sum.
                found = (round(score, 9), share_q, share_a, lo - int(offsets[k]), hi - int(offsets[k]) - 1)
                if found > best.get((k, item), (0.0,)):
                    best[k, item] = found
    return [(k, item, *found) for (k, item), found in best.items()]


def _passes(benchmark: DataFrame, item_column: str, text_column: str, threshold: float) -> Iterator[list[Index]]:
    """Indexes of all items, ITEMS_PER_PASS at a time, with word counts of the whole benchmark."""
    items = benchmark.where(F.col(text_column).isNotNull()).select(
        F.col(item_column).alias("item"), F.make_valid_utf8(F.col(text_column)).alias("text")
    )

    def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _text_words(batch.column(0).to_pylist()):
                word, first = np.unique(own, return_index=True)
                # The length of an item stands at one of its words only.
                length = np.where(first == 0, len(own), 0)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(length)], ["word", "length"])

    by_word = items.select("text").mapInArrow(item_words, "word long, length long")
    frequency = by_word.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n_items, total = items.count(), by_word.agg(F.sum("length")).first()[0]
    if not total:
        return
    passes = -(-n_items // ITEMS_PER_PASS)
    for number in range(passes):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == number).orderBy("item", "text")
        rows = own.toArrow().to_pylist()
        held = own.select("text").mapInArrow(item_words, "word long, length long").select("word").distinct()
        df = {r["word"]: r["df"] for r in frequency.join(held, "word").toArrow().to_pylist()}
        yield [
            index
            for at in range(0, len(rows), PART_ITEMS)
            if (
                index := build_index(
                    [r["item"] for r in rows[at : at + PART_ITEMS]],
                    [r["text"] for r in rows[at : at + PART_ITEMS]],
                    n_items,
                    df,
                    total / n_items,
                    threshold,
                )
            )
        ]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    limits: Limits = Limits(),
) -> DataFrame:
    """id, item, score, question_overlap, answer_overlap, first_word, last_word per row and leaked item.

    Positions are those of the best passage, in words of letters and digits.
    Texts and items that are NULL or have no words give no row; repeated rows
    give theirs each; an empty benchmark gives an empty result. Texts are read
    whole at any length, and bytes that are not UTF-8 as the replacement character.
    Other columns are not read.
    """
    id_type = docs.schema[id_column].dataType
    item_type = benchmark.schema[item_column].dataType
    schema = (
        f"`{id_column}` {id_type.simpleString()}, `{item_column}` {item_type.simpleString()}, score double, "
        "question_overlap double, answer_overlap double, first_word long, last_word long"
    )
    out = docs.sparkSession.createDataFrame([], schema)
    for indexes in _passes(benchmark, item_column, item_text, limits.score):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in words.blocks(_lower(batch.column(1))):
                    for index in shared.value:
                        found = block_hits(block, index, limits)
                        if found:
                            text, item, *rest = zip(*found, strict=True)
                            ids = batch.column(0).take(pa.array([block.first + k for k in text]))
                            items = pa.array([index.ids[k] for k in item])
                            yield pa.RecordBatch.from_arrays(
                                [ids, items, *(pa.array(x) for x in rest)], names
                            )

        names = [x.strip().split(" ")[0].strip("`") for x in schema.split(",")]
        out = out.unionByName(docs.select(id_column, text_column).mapInArrow(run, schema))
    return out


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    limits: Limits = Limits(),
) -> DataFrame:
    """The rows of ``docs``, with all columns as they are, that hold no test item.

    A NULL or empty text holds none; repeated rows stay or go together. Bytes that
    are not UTF-8 are read as the replacement character.
    """
    for indexes in _passes(benchmark, item_column, item_text, limits.score):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)
        at = docs.columns.index(text_column)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for block in words.blocks(_lower(batch.column(at))):
                    for index in shared.value:
                        for k, *_ in block_hits(block, index, limits):
                            clean[block.first + k] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
