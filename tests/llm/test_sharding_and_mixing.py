import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from made_up import prose, rows_of

from tickloom.llm import mixing, sharding

TREE = sharding.HashTree.regular(3, 2, 4)


def test_growth_moves_rows_only_into_the_new_shard(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    tree = TREE
    for _ in range(3):
        more = tree.with_shard()
        rows = ids.select(sharding.descend(F.col("doc_id"), tree).alias("a"), sharding.descend(F.col("doc_id"), more).alias("b")).collect()
        new = len(tree.shards)
        assert {r.b for r in rows if r.a != r.b} == {new}
        share = sum(r.b == new for r in rows) / len(rows)
        assert abs(share - 1 / (new + 1)) < 0.01
        tree = more
    counts = Counter(r.a for r in rows)
    assert len(counts) == 26 and max(counts.values()) < 1.25 * min(counts.values())


def test_weights_and_confined_movement(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    heavy = TREE.reweighted(5, 3.0)
    rows = ids.select(sharding.descend(F.col("doc_id"), TREE).alias("a"), sharding.descend(F.col("doc_id"), heavy).alias("b")).collect()
    # Shard 5 is in region 0 (shards 0 to 7): rows elsewhere stay or move into that region.
    assert all(r.b < 8 for r in rows if r.a != r.b)
    assert abs(sum(r.b == 5 for r in rows) / len(rows) - 3 / 26) < 0.01
    assert 9 not in {r.shard for r in sharding.assign_shards(ids, TREE.reweighted(9, 0.0)).collect()}


def test_digest_of_odd_rows(odd, none):
    rows = sharding.shard_digest(odd, TREE, block_rows=2).collect()
    assert len(rows) == odd.count()
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    want = Counter((i, 8 + len((t or "").encode()), None if t is None else zlib.crc32(t.encode())) for i, t in texts)
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == set(want)
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    assert sharding.shard_digest(none, TREE).count() == 0


def test_raking_meets_the_margins():
    cells = [((s, la, t), float(10 + 7 * i + 3 * j * k)) for i, s in enumerate("abc") for j, la in enumerate("xy") for k, t in enumerate("pq")]
    targets = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"x": 0.7, "y": 0.3}, {"p": 0.4, "q": 0.6}]
    weight = mixing.rake(cells, targets)
    tokens = np.array([n for _, n in cells])
    for m, wanted in enumerate(targets):
        for value, share in wanted.items():
            own = sum(t * w for ((key, t), w) in zip(cells, weight) if key[m] == value)
            assert own / tokens.sum() == pytest.approx(share, abs=1e-9)


def test_calibration_spends_the_budget():
    r = np.random.default_rng(1)
    tokens, weight = r.integers(0, 100, 50).astype(float), r.exponential(1, 50)
    for rate in (0.0, 0.2, 0.9, 1.0):
        p = mixing.calibrate(tokens, weight, rate * tokens.sum())
        assert (p <= 1).all() and (tokens * p).sum() == pytest.approx(rate * tokens.sum())


def test_mix(spark, odd, none):
    targets = {"source": {"src0": 0.2, "src1": 0.8}, "lang": {"en": 0.5, "fr": 0.5}, "topic": dict.fromkeys(mixing.TOPICS, 1 / 6)}
    rows = [r for k in range(300) for r in rows_of([prose(k, 120)], k, ("en", "fr")[k % 2], ("src0", "src0", "src1")[k % 3])]
    docs = spark.createDataFrame(rows, odd.schema)
    got = mixing.mix(docs, targets, 0.4).collect()
    kept = [r for r in got if r.sampled]
    assert len(got) == 300 and abs(len(kept) / 300 - 0.4) < 0.1
    assert abs(sum(r.source == "src1" for r in kept) / len(kept) - 0.8) < 0.12
    assert mixing.mix(odd, targets, 0.5).count() == odd.count()
    assert {r.source for r in mixing.mix(odd, targets, 0.5).collect()} <= {"src0", "src1", "other"}
    assert mixing.mix(none, targets, 0.5).count() == 0
    assert mixing.mix(docs, targets, 1.0).where("not sampled").count() == 0
