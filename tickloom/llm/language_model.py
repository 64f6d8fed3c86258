"""Text log-probabilities from a log-bilinear model trained with noise contrast.

Words are counted over all training texts. The most frequent ones are states of
their own, all others share one state whose words are told apart by their
counts. A state's score after the state before it is ``r[before] . q[state] +
b[state]``; vectors and biases are trained in numpy with noise-contrastive
estimation, where the expectations over data and noise are taken from the state
pairs of the whole corpus instead of drawn samples. One matrix product and a
softmax per row then give normalised log-probabilities for every token.

Exact counts of rare words never sit in one place: the HEAD_WORDS most frequent
words, a fixed number, are broadcast; the rest is joined by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words
from tickloom.llm.learning import fold, sigmoid
from tickloom.session import materialize

HEAD_WORDS = 1 << 18
STATES = 2048
VECTOR = 32
NOISE = 20
PAIR_ROWS = 32
TALLY = 1 << 20
END_TOKEN = np.uint64(0x8A5CD789635D2DFF)


def token_hashes(block: words.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end token after each, and the offsets."""
    hashes, offsets = block.word_hashes()
    ends = offsets + np.arange(len(offsets))
    out = np.full(ends[-1], END_TOKEN, np.uint64)
    out[np.arange(len(hashes)) + words.owners(offsets)] = hashes
    return out, ends


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64)


def token_counts(docs: DataFrame, text_column: str) -> DataFrame:
    """word (hash), n: occurrences of every token in all texts.

    A task adds up what it reads in a table of bounded size and sends it on when
    that is full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def rows() -> pa.RecordBatch:
            key, count = _summed(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], ["word", "n"])

        for batch in batches:
            for block in words.blocks(batch.column(0)):
                key, count = np.unique(token_hashes(block)[0], return_counts=True)
                keys.append(key)
                counts.append(count)
                held += len(key)
                if held > TALLY:
                    key, count = _summed(keys, counts)
                    keys, counts, held = [key], [count], len(key)
                    if held > TALLY // 2:
                        yield rows()
                        keys, counts, held = [], [], 0
        if keys:
            yield rows()

    return docs.select(text_column).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words by hash, with counts and states; 0 is the end of a text, 1 the shared state."""

    keys: np.ndarray
    counts: np.ndarray
    states: np.ndarray
    n_states: int

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the vocabulary, -1 where unknown, and state of each token."""
        if not len(self.keys):
            return np.full(len(hashes), -1), np.where(hashes == END_TOKEN, 0, 1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[at] == hashes
        return np.where(known, at, -1), np.where(known, self.states[at], np.where(hashes == END_TOKEN, 0, 1))


def head_vocabulary(counts: DataFrame, head_words: int = HEAD_WORDS, states: int = STATES) -> Vocabulary:
    # Counts by size class tell from which count on words can be among the first.
    classes = counts.groupBy(F.floor(F.log2("n") * 8).alias("k")).agg(F.count(F.lit(1)).alias("words")).collect()
    held, least = 0, 0.0
    for k, words_of in sorted(((r["k"], r["words"]) for r in classes), reverse=True):
        held, least = held + words_of, 2.0 ** (k / 8) * (1 - 1e-9)
        if held >= head_words:
            break
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(head_words).toArrow()
    key = top["word"].to_numpy().astype(np.int64).view(np.uint64)
    n = top["n"].to_numpy()
    state = np.ones(len(key), np.int32)
    plain = np.flatnonzero(key != END_TOKEN)[: states - 2]
    state[plain] = np.arange(2, 2 + len(plain))
    state[key == END_TOKEN] = 0
    order = np.argsort(key)
    return Vocabulary(key[order], n[order], state[order], states)


def state_pairs(docs: DataFrame, text_column: str, vocabulary) -> np.ndarray:
    """How often each state follows each other one, over all texts; a text begins after an end.

    The table has a fixed size. Tasks send it in blocks of rows, each block is
    added up where it arrives, one block at a time.
    """
    size = vocabulary.value.n_states

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = vocabulary.value, np.zeros(size * size, np.int64)
        for batch in batches:
            for block in words.blocks(batch.column(0)):
                hashes, ends = token_hashes(block)
                _, state = own.find(hashes)
                before = np.concatenate([[0], state[:-1]]).astype(np.int64)
                before[ends[:-1]] = 0
                key, n = np.unique(before * size + state, return_counts=True)
                total[key] += n
        for at in range(0, size, PAIR_ROWS):
            part = total[at * size : (at + PAIR_ROWS) * size]
            if part.any():
                packed = zlib.compress(part.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed], pa.binary())], ["at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(packed.as_py()), np.int64)
                sums[at] = sums[at] + part if at in sums else part
        for at, part in sums.items():
            packed = zlib.compress(part.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed], pa.binary())], ["at", "n"])

    parts = docs.select(text_column).mapInArrow(count, "at int, n binary").repartition("at").mapInArrow(add, "at int, n binary")
    out = np.zeros((size, size), np.float32)
    for row in parts.toArrow().to_pylist():
        part = np.frombuffer(zlib.decompress(row["n"]), np.int64).reshape(-1, size)
        out[row["at"] : row["at"] + len(part)] = part
    return out


@dataclass
class LogBilinear:
    before: np.ndarray
    after: np.ndarray
    bias: np.ndarray
    _table: np.ndarray | None = field(default=None, repr=False)

    def table(self) -> np.ndarray:
        """log10 P(state | state before it) for all pairs, worked out once per process."""
        if self._table is None:
            s = self.before @ self.after.T + self.bias
            s -= s.max(1, keepdims=True)
            s -= np.log(np.exp(s).sum(1, keepdims=True))
            self._table = (s / np.log(10)).astype(np.float32)
        return self._table

    def __getstate__(self):
        return {"before": self.before, "after": self.after, "bias": self.bias, "_table": None}


def fit_log_bilinear(
    pairs: np.ndarray, vector: int = VECTOR, noise: int = NOISE, epochs: int = 30, rows: int = 128, rate: float = 0.02, seed: int = 3
) -> LogBilinear:
    """Noise-contrastive estimation: tell observed successors from draws of the unigram law."""
    random = np.random.default_rng(seed)
    size = len(pairs)
    unigram = (pairs.sum(0) + 0.1) / (pairs.sum() + 0.1 * size)
    chance = np.log(noise * unigram).astype(np.float32)
    weight = pairs.sum(1, keepdims=True) + 0.1
    names = ("before", "after", "bias")
    value = {
        "before": (0.1 * random.standard_normal((size, vector))).astype(np.float32),
        "after": (0.1 * random.standard_normal((size, vector))).astype(np.float32),
        "bias": np.log(unigram).astype(np.float32),
    }
    slow = {k: np.zeros_like(v) for k, v in value.items()}
    fast = {k: np.zeros_like(v) for k, v in value.items()}
    step, steps = 0, epochs * -(-size // rows)
    for _ in range(epochs):
        order = random.permutation(size)
        for at in range(0, size, rows):
            own = order[at : at + rows]
            r = value["before"][own]
            logit = r @ value["after"].T + value["bias"] - chance
            real = sigmoid(logit).astype(np.float32)
            share = np.sqrt(weight[own])  # rare states learn too
            g = share * ((noise * unigram) * real - pairs[own] / weight[own] * (1 - real)).astype(np.float32)
            g /= share.sum()
            gradients = {"after": g.T @ r + 1e-6 * value["after"], "bias": g.sum(0)}
            step += 1
            speed = rate * (1 - step / (steps + 1))
            for k in names:
                if k == "before":
                    d = g @ value["after"] + 1e-6 * r
                    slow[k][own] += 0.1 * (d - slow[k][own])
                    fast[k][own] += 0.01 * (d * d - fast[k][own])
                    value[k][own] -= speed * slow[k][own] / (np.sqrt(fast[k][own]) + 1e-9)
                else:
                    d = gradients[k]
                    slow[k] += 0.1 * (d - slow[k])
                    fast[k] += 0.01 * (d * d - fast[k])
                    value[k] -= speed * slow[k] / (np.sqrt(fast[k]) + 1e-9)
    return LogBilinear(value["before"], value["after"], value["bias"])


def score_texts(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    modulus: int = 10,
    held_out: int = 0,
    head_words: int = HEAD_WORDS,
    states: int = STATES,
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``score`` is the log10 probability of the text under the log-bilinear model,
    ``base_score`` under smoothed word counts. NULL is scored as the empty text,
    one end token. Without training texts every token has base probability 1.
    Words are held by 64-bit hashes. Other columns are not read.
    """
    spark = docs.sparkSession
    train = docs.where(fold(id_column, modulus) != held_out)
    counts = materialize(token_counts(train, text_column))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head = head_vocabulary(counts, head_words, states)
    vocabulary = spark.sparkContext.broadcast(head)
    model = spark.sparkContext.broadcast(fit_log_bilinear(state_pairs(train, text_column, vocabulary)))

    own_state = head.states != 1
    other_total = total - int(head.counts[own_state].sum())
    other_distinct = distinct - int(own_state.sum())
    base_scale = float(np.log10(total + 0.1 * (distinct + 1)))
    other_scale = float(np.log10(other_total + 0.1 * (other_distinct + 1)))
    id_type = docs.schema[id_column].dataType.simpleString()
    fields = f"`{id_column}` {id_type}, held_out boolean, n_tokens long, n_known long, base_part double, score_part double"
    tail_type = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, table = vocabulary.value, model.value.table()
        logs = np.append(np.log10(vocab.counts + 0.1), 0.0)
        for batch in batches:
            for block in words.blocks(batch.column(2)):
                hashes, ends = token_hashes(block)
                at, state = vocab.find(hashes)
                before = np.concatenate([[0], state[:-1]])
                before[ends[:-1]] = 0
                part = logs[at]
                other = state == 1
                chain = table[before, state] + np.where(other, part - other_scale, 0.0)
                sums = lambda x: np.add.reduceat(x.astype(np.float64), ends[:-1])
                n = np.diff(ends)
                rare = np.flatnonzero(at < 0)
                text = words.owners(ends)[rare]
                mixed = words.mix(hashes[rare] + words.mix(text.astype(np.uint64)))
                _, first, often = np.unique(mixed, return_index=True, return_counts=True)
                order = np.argsort(first)
                first, often = first[order], often[order]
                tails = pa.StructArray.from_arrays(
                    [pa.array(hashes[rare][first].view(np.int64)), pa.array(often.astype(np.int64))], ["word", "n"]
                )
                places = np.searchsorted(text[first], np.arange(len(block) + 1)).astype(np.int32)
                cut = slice(block.first, block.first + len(block))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[cut],
                        batch.column(1)[cut],
                        pa.array(n),
                        pa.array(sums(at >= 0).astype(np.int64)),
                        pa.array(sums(part) - n * base_scale),
                        pa.array(sums(chain)),
                        pa.ListArray.from_arrays(pa.array(places), tails).cast(tail_type),
                    ],
                    [id_column, "held_out", "n_tokens", "n_known", "base_part", "score_part", "tail"],
                )

    rows = docs.select(id_column, (fold(id_column, modulus) == held_out).alias("_held_out"), text_column)
    scored = rows.mapInArrow(run, fields + ", tail array<struct<word:bigint,n:bigint>>")
    # Kept once: the rare words are joined by word, their sums come back by row.
    scored = materialize(scored.withColumn("_row", F.monotonically_increasing_id()))
    rare = scored.select("_row", F.inline("tail")).withColumnRenamed("n", "times")
    found = rare.join(counts, "word", "left")
    tail = found.groupBy("_row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("_logs"),
    )
    missing = F.coalesce("_logs", F.lit(0.0))
    return scored.join(tail, "_row", "left").select(
        id_column,
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_part") + missing).alias("base_score"),
        (F.col("score_part") + missing).alias("score"),
    )
