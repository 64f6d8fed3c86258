"""A training corpus in five stages, each an operator of tickloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``; each result is written and read again before
the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.decontamination import drop_leaks
from tickloom.llm.jaccard_join import jaccard_classes
from tickloom.llm.mixing import mix
from tickloom.llm.quality_model import score_quality
from tickloom.llm.settings import MIX_RATE, MIX_TARGETS, SHARD_TREE
from tickloom.llm.sharding import shard_digest
from tickloom.session import materialize, prepare

NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels, carry=True).where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id."""
    prepare(spark)
    # Numbered and written once: a second scan of the documents may number them otherwise.
    rows = materialize(
        docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("at"))
    )
    found = materialize(
        jaccard_classes(
            rows.select("row.doc_id", "row.text", "at"), size=NEAR_WORDS, percent=NEAR_PERCENT, keep=("at",), group="copies"
        )
    )
    # A text without words has no group, so it is none's copy.
    first = found.where("n_shingles > 0").groupBy("copies").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    kept = first.select("first.at").unionByName(found.where("n_shingles = 0").select("at"))
    return rows.join(kept, "at", "left_semi").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item."""
    prepare(spark)
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens come nearer to the target shares of source, language and topic (figures in the README)."""
    prepare(spark)
    return mix(docs, MIX_TARGETS, MIX_RATE).where("sampled").select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every document that is left."""
    prepare(spark)
    return shard_digest(docs, SHARD_TREE)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# The classifier is trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, applied to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


def queries():
    return {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
