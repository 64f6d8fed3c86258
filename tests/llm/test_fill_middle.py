import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from made_up import prose, rows_of
from pyspark.sql import functions as F

from tickloom.llm import fill_middle as fim
from tickloom.llm.words import blocks

UNITS = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^.!?\n]*[.!?\n]|[^.!?\n]+", "char": r"(?s)."}


def plain_transform(key, text, unit, rate=100):
    """The same by walking through the text."""
    text = text or ""
    units = re.findall(UNITS[unit], text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_wavelet_matrix_against_counting():
    r = np.random.default_rng(5)
    for size in (1, 63, 64, 65, 1000):
        classes = r.integers(0, 4, size).astype(np.uint8)
        matrix = fim.WaveletMatrix(classes)
        at = np.arange(size + 1)
        for kind in range(4):
            places = np.flatnonzero(classes == kind)
            assert (matrix.rank(kind, at) == np.searchsorted(places, at)).all()
            assert (matrix.select(kind, np.arange(len(places))) == places).all()


@pytest.mark.parametrize("unit", list(UNITS))
def test_cuts_of_all_units(unit):
    r = random.Random(3)
    texts = ["", "\n", "a", "a\n", "\n\na", "x.y!z?\n.", "é.ü\nß", "日本\n語。"]
    texts += ["".join(r.choice("ab é.\n!日") for _ in range(r.randrange(200))) for _ in range(100)]
    for block in blocks(pa.array(texts), lower=False, limit=500):
        cutter = fim.Cutter(block, unit)
        own = texts[block.first : block.first + len(block)]
        units = [re.findall(UNITS[unit], t) for t in own]
        assert list(cutter.counts()) == [len(u) for u in units]
        for _ in range(5):
            k = [r.randint(0, len(u)) for u in units]
            places = cutter.cut(np.array(k)) - cutter.begin
            assert list(places) == [len("".join(u[:n]).encode()) for u, n in zip(units, k, strict=True)]


@pytest.mark.parametrize("unit, rate", [("line", 100), ("char", 100), ("sentence", 40)])
def test_rows_and_round_trip(spark, odd, unit, rate):
    extra = ["has <P> inside", "ends <", "<S", "a\n<\nS>\n<M\n>", "\n".join(prose(k, 9) for k in range(50)), "no end. two! three"]
    docs = odd.unionByName(spark.createDataFrame(rows_of(extra * 4, 100), odd.schema))
    made = fim.fill_in_middle(docs, fim.Recipe(unit=unit, rate=rate)).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=str)
    want = sorted(((r.doc_id, *plain_transform(r.doc_id, r.text, unit, rate)) for r in docs.collect()), key=str)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert sorted(r.back for r in made.collect()) == sorted(r.text or "" for r in docs.collect())


def test_digest_and_empty_table(odd, none):
    rows = fim.fill_digest(odd).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            assert r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
            assert r.output_sha256 == hashlib.sha256(plain_transform(r.doc_id, texts[r.doc_id], "line")[-1].encode()).hexdigest()
    assert len(rows) == odd.count()
    assert fim.fill_digest(none).collect() == []
    with pytest.raises(ValueError):
        fim.fill_in_middle(odd, fim.Recipe(unit="page"))


def test_bytes_that_are_no_text(spark):
    raw = spark.createDataFrame([(k, b"a\n\xff\xfeb\nc\xc3\n" * k) for k in range(1, 9)], "doc_id long, b binary")
    made = fim.fill_digest(raw.select("doc_id", F.expr("cast(b as string)").alias("text"))).collect()
    assert sorted(r.n for r in made) == [3 * k for k in range(1, 9)]
    assert all(r.form in ("psm", "spm") for r in made)
