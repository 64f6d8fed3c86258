import hashlib
from collections import defaultdict

import pytest
from made_up import prose
from pyspark.sql import functions as F

from tickloom.llm import exact_index


def expected(rows):
    """Rows of (id, text) by plain grouping of texts."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        seen = False
        for i in ids:
            first, seen = i == top and not seen, seen or i == top
            out.append((i, top, len(ids), first, digest))
    return sorted(out, key=str)


def found(docs, **options):
    rows = exact_index.mark_copies(docs, **options).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows), key=str)


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_odd_rows(odd, none, bits):
    """Keys of few bits chain different texts; the result stays that of comparing texts."""
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd, key_bits=bits or 1, bucket_bytes=1000) == expected(rows)
    assert found(none, key_bits=bits or 1) == []


def test_hot_text_is_salted_and_merged(spark):
    same, other = prose(1, 40), prose(2, 40)
    rows = [(k, same if k % 3 == 0 else other if k % 3 == 1 else f"text {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    index = exact_index.build_index(docs)
    assert index.hot.count() == 2 and index.entries.count() == 1002
    assert found(docs) == expected(rows)
    # The same with chains in hot keys.
    assert found(docs, key_bits=2) == expected(rows)


def test_directory_splits_until_buckets_fit(spark):
    rows = [(k, prose(k, 30, 5000)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_index.build_index(docs, bucket_bytes=2000)
    directory = index.directory.collect()
    assert index.depth >= 5
    assert len({r.pointer for r in directory}) == len(directory) <= 2**index.depth
    size = defaultdict(int)
    bucket = {r.pointer: r.bucket for r in directory}
    for r in index.entries.join(index.keys.dropDuplicates(["_key"]), "_key").collect():
        assert r.bucket == bucket[(r._key % 2**64) >> (64 - index.depth)]
        size[r.bucket] += r._bytes
    assert max(size.values()) <= 2000
    # A bucket of local depth l is met by 2^(depth - l) pointers, a range of keys.
    for r in directory:
        held = sorted(p for p, b in bucket.items() if b == r.bucket)
        assert held == list(range(r.bucket, r.bucket + 2 ** (index.depth - r.local_depth)))


def test_one_text_larger_than_a_bucket(spark):
    rows = [(1, "x" * 5000), (2, "x" * 5000), (3, "y"), (4, "y"), (5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, bucket_bytes=10) == expected(rows)


def test_repeated_rows_and_bytes_that_are_no_text(spark):
    rows = [(1, "a")] * 5 + [(2, "b")] * 2 + [(None, "b"), (None, "c"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == expected(rows)
    raw = spark.createDataFrame([(1, b"\xff\xfe"), (2, b"\xff\xfe"), (3, b"\xff")], "doc_id long, b binary")
    made = found(raw.select("doc_id", F.expr("cast(b as string)").alias("text")))
    assert [(i, keep, n, kept) for i, keep, n, kept, _ in made] == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    assert made[2][4] == hashlib.sha256(b"\xff").hexdigest()
