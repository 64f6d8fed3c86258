"""Secret scan whose false positives a random forest removes.

A scan of whole texts lists every long run of key-like characters with a digit.
Each finding is described by its length, its character transitions, how much of
it dictionary words cover, the path of its text and the words around it. A
random forest trained on labelled findings then says which are secrets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words
from tickloom.llm.language_model import head_vocabulary, token_counts
from tickloom.llm.learning import fold
from tickloom.session import materialize

LEAST_LENGTH = 16
AROUND = 48
DICTIONARY_WORDS = 1 << 16

_B = np.arange(256)
_DIGIT = (_B >= 0x30) & (_B <= 0x39)
_UPPER = (_B >= 0x41) & (_B <= 0x5A)
_SMALL = (_B >= 0x61) & (_B <= 0x7A)
KEY_BYTES = _DIGIT | _UPPER | _SMALL | np.isin(_B, list(b"_-+/"))
_KIND = np.where(_DIGIT, 0, np.where(_UPPER, 1, np.where(_SMALL, 2, 3)))
_HEX = np.isin(_B, list(b"0123456789abcdefABCDEF"))

CREDENTIAL = re.compile(rb"(?i)(token|secret|passw(or)?d|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)")
PLACEHOLDER = re.compile(rb"(?i)(example|dummy|sample|placeholder|changeme|xxxx|test|mock)")
REFERENCE = re.compile(rb"(?i)(commit|sha\d*|md5|hash|checksum|uuid|guid|card|account|phone|isbn|http|www|mail)")
ASSIGNED = re.compile(rb"[=:]\s*[\"'`]?$")

FEATURES = [
    "length", "digit_share", "upper_share", "small_share", "hex_share", "entropy", "transitions", "longest_run",
    "dictionary_share", "path_depth", "path_test", "path_suffix", "assigned", "quoted", "credential_before",
    "placeholder_near", "reference_near", "words_around",
]


def describe(text: bytes, start: int, end: int, covered: float, path: str) -> list[float]:
    """The features of one finding."""
    own = np.frombuffer(text[start:end], np.uint8)
    kind = _KIND[own]
    changes = np.flatnonzero(kind[1:] != kind[:-1])
    runs = np.diff(np.concatenate([[-1], changes, [len(own) - 1]]))
    share = np.bincount(own) / len(own)
    share = share[share > 0]
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    near = b" ".join(before.split()[-3:]) + b" " + b" ".join(after.split()[:2])
    return [
        float(len(own)),
        float(_DIGIT[own].mean()),
        float(_UPPER[own].mean()),
        float(_SMALL[own].mean()),
        float(_HEX[own].mean()),
        float(-(share * np.log2(share)).sum()),
        len(changes) / len(own),
        float(runs.max()),
        covered,
        float(path.count("/")),
        float(bool(PLACEHOLDER.search(path.encode()))),
        float("." in path.rsplit("/", 1)[-1]),
        float(bool(ASSIGNED.search(before))),
        float(before[-1:] in (b'"', b"'", b"`") and after[:1] in (b'"', b"'", b"`")),
        float(bool(CREDENTIAL.search(b" ".join(before.split()[-3:])))),
        float(bool(PLACEHOLDER.search(near))),
        float(bool(REFERENCE.search(near))),
        float(len(before.split()) + len(after.split())),
    ]


def find_candidates(docs: DataFrame, id_column: str, text_column: str, path_column: str) -> DataFrame:
    """id, start, length (bytes), masked and the features of every finding in every text."""
    spark = docs.sparkSession
    dictionary = spark.sparkContext.broadcast(head_vocabulary(token_counts(docs, text_column), DICTIONARY_WORDS, 2).keys)
    fields = ", ".join(f"{c} double" for c in FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary.value
        for batch in batches:
            paths = batch.column(2).to_pylist()
            rows: list[tuple] = []
            texts: list[int] = []
            for block in words.blocks(batch.column(1), lower=False):
                starts, ends, offsets = block.runs(KEY_BYTES)
                digits = np.concatenate([[0], np.cumsum(_DIGIT[block.data])])
                good = (ends - starts >= LEAST_LENGTH) & (digits[ends] > digits[starts])
                owner = words.owners(offsets)[good]
                small = words.Block(0, block.data, block.offsets, True)
                for s, e, k in zip(starts[good], ends[good], owner, strict=True):
                    part = words.Block(0, small.data[s:e], np.array([0, e - s]), False)
                    a, b, _ = part.runs(words.LETTER)
                    long = b - a >= 3
                    hashes = part.hashes(a[long], b[long])
                    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                    hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                    covered = float((b - a)[long][hit].sum() / (e - s))
                    lo, hi = int(block.offsets[k]), int(block.offsets[k + 1])
                    text = block.data[max(lo, s - AROUND) : min(hi, e + AROUND)].tobytes()
                    at0 = int(s - max(lo, s - AROUND))
                    texts.append(block.first + int(k))
                    masked = text[at0 : at0 + 4].decode("ascii") + "*" * 4
                    rows.append(
                        (int(s) - lo, int(e - s), masked, *describe(text, at0, at0 + int(e - s), covered, paths[texts[-1]] or ""))
                    )
            if rows:
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(texts)), *columns], [id_column, "start", "length_bytes", "masked", *FEATURES]
                )

    id_type = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column, docs[path_column].cast("string").alias("_path")).mapInArrow(
        run, f"`{id_column}` {id_type}, start long, length_bytes long, masked string, {fields}"
    )


def rule_label() -> Column:
    """Label of a finding by rule, where nobody has labelled it: 1 for a random value assigned to a
    credential name, 0 for numbers, dictionary words, placeholders and references, NULL where unsure."""
    random = (F.col("entropy") >= 3.0) & (F.col("digit_share") < 1.0) & (F.col("dictionary_share") < 0.3)
    named = (F.col("assigned") > 0) & (F.col("credential_before") > 0) & (F.col("placeholder_near") == 0)
    plain = (F.col("digit_share") == 1.0) | (F.col("dictionary_share") >= 0.5) | (F.col("placeholder_near") > 0)
    return F.when(named & random, 1).when(plain | (F.col("reference_near") > 0) | (F.col("assigned") == 0), 0)


def scan_secrets(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    path_column: str = "source",
    modulus: int = 5,
    held_out: int = 0,
    trees: int = 40,
    depth: int = 6,
    threshold: float = 0.5,
) -> DataFrame:
    """id, start, length_bytes, masked, held_out, score and is_secret of every finding.

    ``labelled`` has id, start and label (0 or 1) of labelled findings; without
    it, findings are labelled by ``rule_label``. The forest is trained on all
    labelled findings outside the held-out fold. With labels of one class only,
    that class is the score; with none, every finding counts as a secret. NULL
    and empty texts have no findings; repeated rows have theirs each.
    """
    found = find_candidates(docs, id_column, text_column, path_column)
    found = materialize(found.withColumn("held_out", fold(id_column, modulus) == held_out))
    if labelled is None:
        known = found.withColumn("label", rule_label())
    else:
        one = labelled.groupBy(id_column, "start").agg(F.max("label").alias("label"))
        known = found.join(one, [id_column, "start"], "left")
    train = known.where(F.col("label").isNotNull() & ~F.col("held_out"))
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(counts) < 2:
        score = F.lit(float(next(iter(counts), 1)))
        scored = found.withColumn("score", score)
    else:
        vector = VectorAssembler(inputCols=FEATURES, outputCol="_features")
        forest = RandomForestClassifier(
            labelCol="label", featuresCol="_features", numTrees=trees, maxDepth=depth, seed=11, probabilityCol="_p"
        ).fit(vector.transform(train.select("label", *FEATURES)))
        scored = forest.transform(vector.transform(found)).withColumn("score", vector_to_array("_p")[1])
    return scored.select(
        id_column, "start", "length_bytes", "masked", "held_out", "score", (F.col("score") >= threshold).alias("is_secret")
    )
