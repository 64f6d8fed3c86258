import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from made_up import prose, rows_of
from pyspark.sql import functions as F

from tickloom.llm import source_audit as audit
from tickloom.llm.words import blocks

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_audit(rows, min_docs, top):
    """(lang, source, part, item, value, rank) by dictionaries."""
    count, total = defaultdict(Counter), defaultdict(Counter)
    docs = defaultdict(Counter)
    for text, lang, source in rows:
        words = terms_of(text)
        count[lang or "", source or ""].update(words)
        total[lang or ""].update(words)
        docs[lang or ""].update(set(words))
    kept = {lang: sorted(t for t, n in docs[lang].items() if n >= min_docs) for lang, _ in count}
    share = {}

    def shares(table, lang):
        v = len(kept[lang])
        n = sum(table[t] for t in kept[lang])
        return {t: 1 + 10**9 * (table[t] + 2) // (n + 2 * v) for t in kept[lang]}

    for group, table in count.items():
        share[group] = shares(table, group[0])
    out = []
    for group, p in share.items():
        lang, source = group
        q = shares(total[lang], lang)
        pairs = [
            (sum((p[t] - o[t]) ** 2 // (p[t] + o[t]) for t in kept[lang]), other)
            for (la, other), o in share.items()
            if la == lang and other != source
        ]
        above = [((p[t] - q[t]) ** 2 // (p[t] + q[t]), t) for t in kept[lang] if count[group][t] and p[t] > q[t]]
        for part, found, limit in (("pair", pairs, None), ("term", above, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[:limit])]
    return sorted(out)


def found(docs, **options):
    return sorted(tuple(r) for r in audit.audit_sources(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_runs_against_counting(limit):
    r = random.Random(4)
    pool = ["a", "ab", "Abc", "abcd", "abcdefgh", "abcdefghi", "é", "éé", "日本語日本語", "x" * 16, "x" * 17, "y" * 32, "z" * 33, "q" * 700]
    texts = [" ".join(r.choice(pool) + r.choice(["", "1", ".", "b"]) for _ in range(r.randrange(60))) for _ in range(80)] + ["", None]
    for block in blocks(pa.array(texts), limit=limit):
        group = np.array([r.randrange(3) for _ in range(len(block))])
        runs = audit.Runs(block, group)
        want, docs = Counter(), Counter()
        for text, g in zip(texts[block.first : block.first + len(block)], group, strict=True):
            want.update((t, g) for t in terms_of(text))
            docs.update((t, g) for t in set(terms_of(text)))
        named = list(zip(runs.terms(slice(None)).to_pylist(), runs.groups, strict=True))
        assert len(set(named)) == len(named)
        assert dict(zip(named, runs.counts, strict=True)) == want
        assert dict(zip(named, runs.docs, strict=True)) == docs


def test_radix_order_is_stable():
    r = np.random.default_rng(1)
    words = r.integers(0, 50, 5000).astype(np.uint64) << np.uint64(37)
    order = audit.radix_order(audit._digits(words, 4))
    assert (order == np.argsort(words, kind="stable")).all()


@pytest.mark.parametrize("cells", [1 << 20, 64])
def test_audit_against_dictionaries(spark, monkeypatch, cells):
    monkeypatch.setattr(audit, "LEAST_TERMS", 5)
    r = random.Random(8)
    rows = []
    for k in range(300):
        lang = r.choice(["en", "en", "fr", None])
        source = r.choice(["s1", "s1", "s2", "s3", None, ""])
        rows.append((prose(r.randrange(60), r.randrange(1, 80), 150 if source != "s2" else 90) + " ÉTÉ Zoë", lang, source))
    rows += [("", "en", "silent"), (None, "one", "only"), ("rare words", "few", "a"), ("rare words", "few", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = found(docs, min_docs=10, top=4, block_cells=cells)
    assert got == plain_audit(rows, 10, 4)
    # Sources without terms have pairs; a language without kept terms has pairs of value 0.
    assert {x[3] for x in got if x[1] == "silent"} == {"s1", "s2", "s3", ""}
    assert [x[3:5] for x in got if x[0] == "few"] == [("b", 0), ("a", 0)]
    assert not [x for x in got if x[0] == "one"]


def test_odd_rows(spark, odd, none):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert found(odd, min_docs=2, top=10) == plain_audit(rows, 2, 10)
    assert found(odd, min_docs=1, top=3) == plain_audit(rows, 1, 3)
    assert found(none) == []
    raw = spark.createDataFrame(rows_of(["ab cd"] * 3), odd.schema)
    broken = raw.unionByName(raw.withColumn("text", F.expr("cast(X'61FF62C3' as string)")).withColumn("source", F.lit("src9")))
    assert {x[0] for x in found(broken, min_docs=2)} == {"en"}


def test_counts_beyond_a_long(spark):
    big = spark.createDataFrame([(2 * 10**10, 4 * 10**12, 1000)], "n long, total long, terms long")
    assert big.select(audit._share(F.col("n"), F.col("total"), F.col("terms"))).first()[0] == 1 + 10**9 * (2 * 10**10 + 2) // (4 * 10**12 + 2000)
