"""Folds, bounded labelled samples and small numpy fits shared by the models."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a NULL id counts as the empty text."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % modulus).cast("int")


def prior_shift(labels: np.ndarray, counts: tuple[int, int]) -> float:
    """What to add to a logit fitted on a sample so that it fits all labelled rows, counted by class."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    if not ones or not zeros or not counts[0] or not counts[1]:
        return 0.0
    return float(np.log(counts[1] / counts[0]) - np.log(ones / zeros))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    target: str,
    id_column: str,
    text_column: str,
    modulus: int,
    held_out: int,
    rows_per_class: int,
) -> tuple[DataFrame, tuple[int, int]]:
    """At most ``rows_per_class`` labelled training texts of each class, chosen by a hash of the id.

    Ids are drawn from the labels alone, so only the drawn texts are fetched. Of
    several labels of an id the largest counts; NULL labels are left out. An id
    that stands for several texts gives the one of least hash. The result has the
    columns text and label, and the labelled rows of each class are counted.
    """
    own = (
        labels.where(F.col(target).isNotNull() & F.col(id_column).isNotNull() & (fold(id_column, modulus) != held_out))
        .groupBy(F.col(id_column).alias("_id"))
        .agg(F.max((F.col(target) > 0).cast("int")).alias("_label"))
    )
    drawn, counts = [], []
    for value in (0, 1):
        one = own.where(F.col("_label") == value)
        counts.append(one.count())
        digest = F.md5(F.col("_id").cast("string"))
        # Twice the rows wanted pass the first test, so few are sorted however many labels there are.
        share = min(1.0, (2 * rows_per_class + 100) / max(counts[-1], 1))
        low = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") < share * 2.0**32
        drawn.append(one.where(low).orderBy(digest, "_id").limit(rows_per_class))
    picked = drawn[0].unionByName(drawn[1])
    texts = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    # The drawn ids are bounded by 2 * rows_per_class, hence the broadcast.
    sample = (
        texts.join(F.broadcast(picked), "_id")
        .groupBy("_id", "_label")
        .agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("text"))
        .select("text", F.col("_label").alias("label"), F.md5(F.col("_id").cast("string")).alias("place"))
    )
    return sample, (counts[0], counts[1])


def fit_in_task(sample: DataFrame, counts: tuple[int, int], fit: Callable[[pa.Array, np.ndarray, float], object]) -> dict:
    """The fields of the model that ``fit`` makes of the texts, labels and prior shift of a bounded sample.

    It is fitted in one task, in the order of the hash of the ids; only the model
    comes to the driver. ``fit`` returns a dataclass.
    """

    def fitted(table: pa.Table) -> dict:
        table = table.sort_by("place")
        labels = table["label"].to_numpy().astype(np.int64)
        texts = table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string())
        return asdict(fit(texts, labels, prior_shift(labels, counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            model = pickle.dumps(fitted(pa.Table.from_batches(parts)))
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    made = sample.repartition(1).mapInArrow(run, "model binary").collect()
    if made:
        return pickle.loads(made[0]["model"])
    return asdict(fit(pa.array([], pa.string()), np.zeros(0, np.int64), 0.0))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, np.float64)))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w
