"""Quality classifier by gated-attention multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded from the
pairs of neighbouring byte classes and a few repetition figures; a gated
attention weighs the passages, learned from document labels alone; the weighted
passage vector gives the score. Trained in numpy with Adam.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words
from tickloom.llm.learning import fit_in_task, fold, labelled_sample, sigmoid

PASSAGE_WORDS = 64


def _byte_classes() -> np.ndarray:
    out = np.full(256, 10)
    for name, k in ((b"aeiou", 0), (b"bcdfghjklmnpqrstvwxyz", 1), (b"0123456789", 3), (b" ", 4), (b"\t\n\v\f\r", 5)):
        out[list(name)] = k
    out[0x41:0x5B] = 2
    out[list(b".")], out[list(b",;:")], out[list(b"!?")], out[list(b"|")] = 6, 7, 8, 9
    out[list(b"#*$%&<>")] = 11
    out[0x80:] = 12
    return out


CLASS = _byte_classes()
CLASSES = 13
EXTRA = 7
WIDTH = CLASSES * CLASSES + EXTRA


def passages(block: words.Block) -> tuple[np.ndarray, np.ndarray]:
    """Figures of all passages of a block of raw texts, and where those of each text begin.

    A text without words is one passage.
    """
    starts, ends, offsets = block.words()
    count = np.maximum(-(-np.diff(offsets) // PASSAGE_WORDS), 1)
    bags = np.concatenate([[0], np.cumsum(count)])
    n = bags[-1]
    text = words.owners(bags)
    place = np.arange(n) - bags[text]
    first_word = offsets[text] + place * PASSAGE_WORDS
    begin = np.where(place == 0, block.offsets[text], starts[np.minimum(first_word, max(len(starts) - 1, 0))] if len(starts) else 0)
    end = np.concatenate([begin[1:], [len(block.data)]])
    size = end - begin
    of_byte = np.repeat(np.arange(n), size)
    kind = CLASS[block.data]
    x = np.zeros((n, WIDTH), np.float32)
    if len(kind):
        following = np.append(kind[1:], 5)
        pairs = np.bincount((of_byte * CLASSES + kind) * CLASSES + following, minlength=n * CLASSES * CLASSES)
        x[:, : CLASSES * CLASSES] = pairs.reshape(n, -1) / np.maximum(size, 1)[:, None]
    of_word = bags[words.owners(offsets)] + (np.arange(len(starts)) - np.repeat(offsets[:-1], np.diff(offsets))) // PASSAGE_WORDS
    total = np.maximum(np.bincount(of_word, minlength=n), 1)
    hashes = block.hashes(starts, ends)
    tail = x[:, CLASSES * CLASSES :]
    if len(starts):
        own = words.mix(hashes + of_word.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        _, first = np.unique(own, return_index=True)
        tail[:, 0] = np.bincount(of_word[first], minlength=n) / total
        same = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
        tail[:, 1] = np.bincount(of_word[1:][same], minlength=n) / total
        tail[:, 2] = np.bincount(of_word, ends - starts, minlength=n) / total / 10
        # Words that the text has already used in the same neighbourhood of two.
        text_of_word = words.owners(offsets).astype(np.uint64)
        pair = words.mix(hashes[:-1] * np.uint64(3) + hashes[1:] + words.mix(text_of_word[1:]))
        _, inverse, often = np.unique(pair, return_inverse=True, return_counts=True)
        again = (often[inverse] > 2) & (text_of_word[1:] == text_of_word[:-1])
        tail[:, 3] = np.bincount(of_word[1:][again], minlength=n) / total
        loud = words.runs_of_upper(block, starts, ends)
        tail[:, 4] = np.bincount(of_word[loud], minlength=n) / total
    tail[:, 5] = np.log1p(total) / np.log(PASSAGE_WORDS + 1)
    tail[:, 6] = np.log1p(count[text]) / 5
    return x, bags


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray  # WIDTH + 1 by hidden, last row the bias
    attend: np.ndarray  # hidden by attention
    gate: np.ndarray
    pick: np.ndarray
    out: np.ndarray  # hidden + 1
    shift: float = 0.0

    def _forward(self, x: np.ndarray, bags: np.ndarray) -> dict:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.encode[:-1] + self.encode[-1])
        a, g = np.tanh(h @ self.attend), sigmoid(h @ self.gate)
        e = (a * g) @ self.pick
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bags[:-1]), np.diff(bags)))
        w = e / np.repeat(np.add.reduceat(e, bags[:-1]), np.diff(bags))
        m = np.add.reduceat(w[:, None] * h, bags[:-1])
        return {"z": z, "h": h, "a": a, "g": g, "w": w, "m": m, "logit": m @ self.out[:-1] + self.out[-1]}

    def scores(self, block: words.Block) -> np.ndarray:
        x, bags = passages(block)
        return sigmoid(self._forward(x, bags)["logit"] + self.shift)


def fit_attention(
    x: np.ndarray,
    bags: np.ndarray,
    y: np.ndarray,
    hidden: int = 24,
    attention: int = 12,
    epochs: int = 40,
    batch: int = 64,
    rate: float = 3e-3,
    decay: float = 1e-4,
    seed: int = 7,
) -> AttentionModel:
    """Adam on the cross-entropy of bag labels; the gradients are written out below."""
    random = np.random.default_rng(seed)
    draw = lambda *shape: random.standard_normal(shape) / np.sqrt(shape[0])
    model = AttentionModel(
        x.mean(0),
        x.std(0) + 1e-3,
        np.vstack([draw(x.shape[1], hidden), np.zeros((1, hidden))]),
        draw(hidden, attention),
        draw(hidden, attention),
        draw(attention),
        np.append(draw(hidden), 0.0),
    )
    names = ("encode", "attend", "gate", "pick", "out")
    slow = {k: np.zeros_like(getattr(model, k)) for k in names}
    fast = {k: np.zeros_like(getattr(model, k)) for k in names}
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(y))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            sizes = np.diff(bags)[own]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.arange(ends[-1]) + np.repeat(bags[:-1][own] - ends[:-1], sizes)
            f = model._forward(x[rows], ends)
            error = (sigmoid(f["logit"]) - y[own]) / len(own)
            by_row = np.repeat(np.arange(len(own)), sizes)
            d_m = error[:, None] * model.out[:-1]
            d_h = f["w"][:, None] * d_m[by_row]
            d_w = (d_m[by_row] * f["h"]).sum(1)
            d_e = f["w"] * (d_w - np.add.reduceat(f["w"] * d_w, ends[:-1])[by_row])
            d_a = d_e[:, None] * model.pick * f["g"] * (1 - f["a"] ** 2)
            d_g = d_e[:, None] * model.pick * f["a"] * f["g"] * (1 - f["g"])
            d_h += d_a @ model.attend.T + d_g @ model.gate.T
            d_z = d_h * (1 - f["h"] ** 2)
            gradients = {
                "encode": np.vstack([f["z"].T @ d_z, d_z.sum(0)]),
                "attend": f["h"].T @ d_a,
                "gate": f["h"].T @ d_g,
                "pick": (f["a"] * f["g"]).T @ d_e,
                "out": np.append(f["m"].T @ error, error.sum()),
            }
            step += 1
            for k in names:
                value = getattr(model, k)
                g = gradients[k] + decay * value
                slow[k] += 0.1 * (g - slow[k])
                fast[k] += 0.001 * (g * g - fast[k])
                value -= rate * (slow[k] / (1 - 0.9**step)) / (np.sqrt(fast[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit_quality(texts: pa.Array, good: np.ndarray, prior_shift: float = 0.0) -> AttentionModel:
    if len(set(good)) < 2:
        share = float(good.mean()) if len(good) else 1.0
        zero = np.zeros
        odds = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return AttentionModel(zero(WIDTH), zero(WIDTH) + 1, zero((WIDTH + 1, 1)), zero((1, 1)), zero((1, 1)), zero(1), zero(2), odds)
    parts = [passages(block) for block in words.blocks(texts, lower=False)]
    sizes = np.concatenate([np.diff(bags) for _, bags in parts])
    model = fit_attention(np.concatenate([x for x, _ in parts]), np.concatenate([[0], np.cumsum(sizes)]), good)
    model.shift = prior_shift
    return model


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    target: str = "quality",
    modulus: int = 5,
    held_out: int = 0,
    rows_per_class: int = 2500,
    threshold: float = 0.3,
    carry: bool = False,
) -> DataFrame:
    """id, held_out, score and predicted of every row, with ``carry`` also the whole row as a struct ``row``.

    The model is fitted on at most ``rows_per_class`` labelled rows of each class
    outside the held-out fold. NULL and empty texts are one passage without words;
    without labels of both classes every score is the share of good labels (1 if
    there are none). No column but the text enters a score.
    """
    sample = labelled_sample(docs, labels, target, id_column, text_column, modulus, held_out, rows_per_class)
    model = AttentionModel(**fit_in_task(*sample, fit_quality))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_column].dataType.simpleString()
    row_type = f"row {docs.schema.simpleString()}, " if carry else ""
    extra = ["row"] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(2)
            parts = [own.scores(block) for block in words.blocks(texts.field(at) if carry else texts, lower=False)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [
                    *([texts] if carry else []),
                    batch.column(0),
                    batch.column(1),
                    pa.array(score),
                    pa.array((score >= threshold).astype(np.int32)),
                ],
                [*extra, id_column, "held_out", "score", "predicted"],
            )

    at = docs.columns.index(text_column)
    text = F.struct(*(docs[c] for c in docs.columns)) if carry else docs[text_column]
    rows = docs.select(docs[id_column], (fold(id_column, modulus) == held_out).alias("_held_out"), text.alias("_text"))
    return rows.mapInArrow(run, f"{row_type}`{id_column}` {id_type}, held_out boolean, score double, predicted int")
