"""Toxicity from class-conditional Kneser-Ney models.

A word is read letter by letter to its end; the context of a letter is what stands
before it in the word, up to ten letters. Scripts without blanks are read from
every character on, four characters far. Toxic and ordinary texts have absolute-discounted counts of
their own, and both fall back on the same continuation counts (how many contexts
a letter has followed), so what is rare in either class weighs next to nothing.
The log-likelihoods are normalised by length: the mean difference per word, and
the means over the most toxic shares of the words, so that a few expressions in
a long text are not averaged away. A logistic curve over these, fitted on texts
that the counts have not seen, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm import words
from tickloom.llm.learning import fit_in_task, fold, labelled_sample, logistic_fit, sigmoid

CONTEXT = 10
WINDOW = 4
TOP_SHARES = (0.005, 0.01, 0.02, 0.04)
END = np.uint64(0)

# Code points of scripts that set no blanks between words, and of signs that are no letters.
UNSPACED = ((0x0E00, 0x0EFF), (0x0F00, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF),
            (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
SIGNS = ((0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x200B), (0x200E, 0x206F),
         (0x3000, 0x3004), (0x3008, 0x3020), (0x30FB, 0x30FB), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40),
         (0xFF5B, 0xFF65))


def _within(code: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    out = np.zeros(len(code), bool)
    for low, high in ranges:
        out |= (code >= low) & (code <= high)
    return out


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points whose first bytes are at these places."""
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    b0, (b1, b2, b3) = padded[at], (padded[at + k] & 0x3F for k in (1, 2, 3))
    return np.select(
        [b0 < 0x80, b0 < 0xE0, b0 < 0xF0],
        [b0, (b0 & 0x1F) << 6 | b1, (b0 & 0x0F) << 12 | b1 << 6 | b2],
        (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3,
    )


def _words(block: words.Block) -> tuple[np.ndarray, ...]:
    """Distinct words of a block: starts, lengths, whether they end there, the word number of each place and the texts' offsets.

    A word is a run of letters. A script without blanks is read from every
    character on, ``WINDOW`` characters far or to the end of its run.
    """
    lead = np.flatnonzero((block.data & 0xC0) != 0x80)
    wide = lead[block.data[lead] >= 0x80]
    starts, ends, offsets = block.runs(words.LETTER)
    closed = np.ones(len(starts), bool)
    code = _code_points(block.data, wide)
    sign, unspaced = _within(code, SIGNS), _within(code, UNSPACED)
    if sign.any() or unspaced.any():
        kind = np.where(words.LETTER[block.data], 1, 0)  # 0 no letter, 1 letter, 2 without blanks
        size = np.append(lead[1:], len(block.data))[np.searchsorted(lead, wide)] - wide
        for own, value in ((sign, 0), (unspaced, 2)):
            for k in range(int(size[own].max(initial=0))):
                kind[wide[own & (size > k)] + k] = value
        owner = np.repeat(np.arange(len(block)), np.diff(block.offsets))
        edge = np.flatnonzero((kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])) + 1
        begin, end = np.append(0, edge), np.append(edge, len(kind))
        whole, run = kind[begin] == 1, kind[begin] == 2
        # Every character of a run without blanks opens a window.
        first = lead[kind[lead] == 2]
        stop = end[run][np.searchsorted(begin[run], first, "right") - 1]
        ahead = np.append(lead, np.full(WINDOW, len(block.data)))[np.searchsorted(lead, first) + WINDOW]
        starts = np.concatenate([begin[whole], first])
        ends = np.concatenate([end[whole], np.minimum(stop, ahead)])
        closed = np.concatenate([np.ones(whole.sum(), bool), stop <= ahead])
        order = np.argsort(starts, kind="stable")
        starts, ends, closed = starts[order], ends[order], closed[order]
        offsets = np.searchsorted(starts, block.offsets)
    key = words.mix(block.hashes(starts, ends) + closed.astype(np.uint64))
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return starts[first], (ends - starts)[first], closed[first], inverse, offsets


@dataclass
class Letters:
    """All letters of some words, ends of words included, each with its context."""

    word: np.ndarray
    context: np.ndarray
    key: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    before: np.ndarray


def _letters(block: words.Block, starts: np.ndarray, lengths: np.ndarray, closed: np.ndarray) -> Letters:
    """The context of a letter is what stands before it in the word, up to ``CONTEXT`` letters."""
    lead = np.flatnonzero((block.data & 0xC0) != 0x80)
    edges = np.append(lead, len(block.data))
    a, z = np.searchsorted(lead, starts), np.searchsorted(lead, starts + lengths)
    n = z - a + closed
    word = np.repeat(np.arange(len(starts)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = a[word] + place
    final = at == z[word]
    start, end = edges[at], np.where(final, edges[at], edges[np.minimum(at + 1, len(lead))])
    # A context of fewer letters begins with the word, which is part of it.
    anchored = (place < CONTEXT).astype(np.uint64)
    from_ = edges[at - np.minimum(place, CONTEXT)]
    context = words.mix(block.hashes(from_, start) * np.uint64(2) + anchored)
    letter = block.hashes(from_, end)
    key = words.mix(letter * np.uint64(4) + anchored * np.uint64(2) + final.astype(np.uint64))
    before = edges[np.maximum(at - 1, 0)]
    return Letters(word, context, key, place == 0, start, end, before)


@dataclass
class KneserNey:
    """Sorted keys of letters in their contexts with log-ratios, and contexts with those of leaving the known letters there."""

    keys: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    leave: np.ndarray

    def word_ratios(
        self, block: words.Block, starts: np.ndarray, lengths: np.ndarray, closed: np.ndarray | None = None
    ) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary), given the first letter of the word."""
        if not len(self.keys) or not len(starts):
            return np.zeros(len(starts))
        own = _letters(block, starts, lengths, np.ones(len(starts), bool) if closed is None else closed)
        at = np.minimum(np.searchsorted(self.keys, own.key), len(self.keys) - 1)
        known = self.keys[at] == own.key
        step = np.where(known, self.ratio[at], 0.0)
        rest = np.flatnonzero(~known & ~own.first)
        up = np.minimum(np.searchsorted(self.contexts, own.context[rest]), len(self.contexts) - 1)
        step[rest] = np.where(self.contexts[up] == own.context[rest], self.leave[up], 0.0)
        return np.bincount(own.word, step, minlength=len(starts))


def _no_counts() -> KneserNey:
    return KneserNey(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0))


def fit_kneser_ney(texts: pa.Array, toxic: np.ndarray) -> KneserNey:
    """Count the letters of all words of both classes in their contexts and work out the log-ratios."""
    parts: list[tuple[np.ndarray, ...]] = []
    for block in words.blocks(texts):
        starts, lengths, closed, inverse, offsets = _words(block)
        if not len(starts):
            continue
        label = toxic[block.first + words.owners(offsets)]
        counts = np.stack([np.bincount(inverse[label == c], minlength=len(starts)) for c in (0, 1)], 1)
        own = _letters(block, starts, lengths, closed)
        key, at, inv = np.unique(own.key, return_index=True, return_inverse=True)
        summed = np.stack([np.bincount(inv, counts[own.word, c], minlength=len(key)) for c in (0, 1)], 1)
        letter = np.where(own.end[at] > own.start[at], block.hashes(own.start[at], own.end[at]), END)
        before = np.where(own.first[at], END, block.hashes(own.before[at], own.start[at]))
        parts.append((key, own.context[at], letter, before, own.first[at], summed))
    if not parts:
        return _no_counts()
    key, context, letter, before, opens, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    context, letter, before, opens = context[first], letter[first], before[first], opens[first]
    count = np.stack([np.bincount(inverse, count[:, c], minlength=len(key)) for c in (0, 1)], 1)

    # Shared lower order: in how many contexts a letter follows the letter before it.
    _, then = np.unique(letter, return_inverse=True)
    _, prior = np.unique(before, return_inverse=True)
    pair, of_pair, types = np.unique(prior * (then.max() + 1) + then, return_inverse=True, return_counts=True)
    single = (np.bincount(then) + 1) / (len(key) + then.max() + 1)
    row = np.bincount(prior)
    follows = np.bincount(pair // (then.max() + 1), minlength=len(row))
    shared = np.maximum(types[of_pair] - 0.75, 0) / row[prior] + (0.75 * follows / row)[prior] * single[then]

    contexts, up = np.unique(context, return_inverse=True)
    probability = np.ones((len(key), 2))
    weight = np.ones((len(contexts), 2))
    for c in (0, 1):
        ones, twos = (count[:, c] == 1).sum(), (count[:, c] == 2).sum()
        discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
        total = np.bincount(up, count[:, c], minlength=len(contexts))
        kinds = np.bincount(up, count[:, c] > 0, minlength=len(contexts))
        weight[:, c] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        seen = np.maximum(count[:, c] - discount, 0) / np.maximum(total[up], 1)
        probability[:, c] = np.where(total[up] > 0, seen, 0) + weight[up, c] * shared
    step = np.where(opens, 0.0, np.log(probability[:, 1]) - np.log(probability[:, 0]))
    return KneserNey(key, step, contexts, np.log(weight[:, 1]) - np.log(weight[:, 0]))


def text_figures(model: KneserNey, block: words.Block) -> np.ndarray:
    """Per text the mean log-ratio per word and the means over the most toxic words; 0 without words."""
    starts, lengths, closed, inverse, offsets = _words(block)
    ratios = model.word_ratios(block, starts, lengths, closed)[inverse]
    out = np.zeros((len(block), 1 + len(TOP_SHARES)))
    for k in range(len(block)):
        own = ratios[offsets[k] : offsets[k + 1]]
        if len(own):
            most = np.sort(own)[::-1]
            out[k] = own.mean(), *(most[: max(1, int(share * len(own)))].mean() for share in TOP_SHARES)
    return out


@dataclass
class ToxicityModel:
    counts: KneserNey
    weights: np.ndarray

    def scores(self, block: words.Block) -> np.ndarray:
        return sigmoid(np.column_stack([text_figures(self.counts, block), np.ones(len(block))]) @ self.weights)


def fit_toxicity(texts: pa.Array, toxic: np.ndarray, prior_shift: float = 0.0) -> ToxicityModel:
    """Counts from two thirds of the texts, the curve from the rest."""
    third = np.arange(len(toxic)) % 3 == 0
    if len(set(toxic[~third])) < 2 or len(set(toxic[third])) < 2:
        share = float(toxic.mean()) if len(toxic) else 0.0
        odds = np.log((share + 1e-3) / (1 - share + 1e-3))
        return ToxicityModel(_no_counts(), np.array([0.0] * (1 + len(TOP_SHARES)) + [odds]))
    counts = fit_kneser_ney(texts.filter(pa.array(~third)), toxic[~third])
    rest = texts.filter(pa.array(third))
    figures = np.concatenate([text_figures(counts, block) for block in words.blocks(rest)])
    weights = logistic_fit(figures, toxic[third])
    weights[-1] += prior_shift
    return ToxicityModel(counts, weights)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    target: str = "toxic",
    modulus: int = 5,
    held_out: int = 0,
    rows_per_class: int = 3000,
    threshold: float = 0.5,
) -> DataFrame:
    """id, held_out, score and predicted of every row.

    The models are fitted on at most ``rows_per_class`` labelled rows of each
    class outside the held-out fold. NULL and empty texts are scored as texts
    without words; without labels of both classes all scores are the share of
    toxic labels. Other columns are not read.
    """
    sample = labelled_sample(docs, labels, target, id_column, text_column, modulus, held_out, rows_per_class)
    fields = fit_in_task(*sample, fit_toxicity)
    model = ToxicityModel(KneserNey(**fields["counts"]), fields["weights"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            parts = [own.scores(block) for block in words.blocks(batch.column(2))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                [id_column, "held_out", "score", "predicted"],
            )

    return docs.select(id_column, (fold(id_column, modulus) == held_out).alias("_held_out"), text_column).mapInArrow(
        run, f"`{id_column}` {id_type}, held_out boolean, score double, predicted int"
    )
