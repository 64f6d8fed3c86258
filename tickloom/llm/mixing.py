"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed in cells of source, language and topic. The weights of the
cells are raked until the weighted tokens meet the target shares of all three
margins. Documents are then sampled with probabilities in proportion to the
weight of their cell, calibrated so that the expected tokens meet the budget.

A margin has the values its targets name and "other", so the number of cells is
bounded by the targets, whatever the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words
from tickloom.llm.quality_rules import Texts

OTHER = "other"
TOPICS = ("table", "shout", "symbols", "note", "article", "book")
SWEEPS = 60
Targets = dict[str, dict[str, float]]


def topics(block: words.Block) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and number of the topic (what kind of text it is) of each text."""
    t = Texts(block)
    n = t["n_words"]
    bars = np.concatenate([[0], np.cumsum(block.data == 0x7C)])
    bars = bars[block.offsets[1:]] - bars[block.offsets[:-1]]
    kind = np.select(
        [4 * bars > n, 2 * t["n_upper"] > t["n_letters"], 10 * t["n_symbols"] > 3 * n, n < 100, n < 1000],
        [0, 1, 2, 3, 4],
        5,
    )
    return n, kind


def with_topic(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """row (a struct of all columns of ``docs``), tokens and topic."""
    at = docs.columns.index(text_column)
    names = pa.array(TOPICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            parts = [topics(block) for block in words.blocks(row.field(at), lower=False)]
            n = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            kind = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(n.astype(np.int64)), names.take(pa.array(kind))], ["row", "tokens", "topic"]
            )

    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return rows.mapInArrow(run, f"row {docs.schema.simpleString()}, tokens long, topic string")


def group(column: str, targets: dict[str, float]) -> Column:
    """The value if the targets name it, else "other"; NULL is "other"."""
    return F.when(F.col(column).isin(*targets), F.col(column)).otherwise(F.lit(OTHER))


def rake(cells: list[tuple[tuple[str, ...], float]], targets: list[dict[str, float]], sweeps: int = SWEEPS) -> np.ndarray:
    """Weight of each cell (values of the margins, tokens) so that the weighted shares meet the targets.

    Targets of values without tokens are dealt to the others in proportion;
    "other" keeps the share it has.
    """
    tokens = np.array([n for _, n in cells], float)
    total = tokens.sum()
    weight = np.ones(len(cells))
    margins = []
    for m, wanted in enumerate(targets):
        names, own = np.unique([key[m] for key, _ in cells], return_inverse=True)
        have = np.bincount(own, tokens)
        rest = sum(h for n, h in zip(names, have, strict=True) if n == OTHER)
        named = sum(wanted[n] for n, h in zip(names, have, strict=True) if n != OTHER and h > 0)
        goal = np.array([h if n == OTHER else wanted[n] / named * (total - rest) if h > 0 else 0.0 for n, h in zip(names, have, strict=True)])
        margins.append((own, goal))
    for _ in range(sweeps):
        for own, goal in margins:
            now = np.bincount(own, tokens * weight)
            weight = weight * np.where(now[own] > 0, goal[own] / np.maximum(now[own], 1e-300), 0.0)
    return weight


def calibrate(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, c * weight) with c such that the expected tokens are the budget."""
    order = np.argsort(-weight, kind="stable")
    t, w = tokens[order].astype(float), weight[order]
    full = np.concatenate([[0.0], np.cumsum(t)])[:-1]
    left = np.cumsum((t * w)[::-1])[::-1]
    for k in range(len(t)):
        c = (budget - full[k]) / left[k] if left[k] > 0 else np.inf
        if c * w[k] <= 1:
            return np.minimum(1.0, c * weight)
    return np.ones(len(t))


def mix(
    docs: DataFrame,
    targets: Targets,
    rate: float,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    lang_column: str = "lang",
    seed: str = "mix",
) -> DataFrame:
    """row (a struct of all columns of ``docs``), source, lang, topic, tokens, weight, probability and sampled.

    ``rate`` is the share of all tokens to keep in expectation. A row is sampled
    if the hash of its id is below its probability, so equal ids share the draw.
    NULL and empty texts have no tokens, but the probability of their cell; an
    empty table gives an empty result.
    """
    marked = with_topic(docs, text_column)
    marked = marked.withColumn("source", group(f"row.`{source_column}`", targets["source"])).withColumn(
        "lang", group(f"row.`{lang_column}`", targets["lang"])
    )
    key = ["source", "lang", "topic"]
    # At most as many rows as the targets have combinations.
    rows = marked.groupBy(*key).agg(F.sum("tokens").alias("tokens")).orderBy(*key).toArrow().to_pylist()
    cells = [(tuple(r[k] for k in key), float(r["tokens"])) for r in rows]
    weight = rake(cells, [targets[k] for k in key])
    tokens = np.array([n for _, n in cells])
    probability = calibrate(tokens, weight, rate * tokens.sum())
    solved = docs.sparkSession.createDataFrame(
        [(*k, float(w), float(p)) for (k, _), w, p in zip(cells, weight, probability, strict=True)],
        "source string, lang string, topic string, weight double, probability double",
    )
    ident = F.coalesce(F.col(f"row.`{id_column}`").cast("string"), F.lit("null"))
    digest = F.md5(F.concat(F.lit(seed + "/"), ident))
    draw = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    sampled = marked.join(F.broadcast(solved), key).withColumn("sampled", draw < F.col("probability"))
    return sampled.select("row", *key, "tokens", "weight", "probability", "sampled")
