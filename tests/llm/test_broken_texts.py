"""Texts with bytes that are not UTF-8, and plain forms of what vectors compute."""

import numpy as np
from made_up import prose
from pyspark.sql import functions as F

from tickloom.llm import decontamination, language_id


def broken(spark, rows):
    """(doc_id, text, lang) from bytes."""
    raw = spark.createDataFrame(rows, "doc_id long, b binary, lang string")
    return raw.select("doc_id", F.expr("cast(b as string)").alias("text"), "lang")


def test_language_of_broken_texts(spark):
    rows = [(k, (("guten tag und " if k % 2 else "hello and the ") * 20).encode(), "de" if k % 2 else "en") for k in range(40)]
    rows += [(100, b"guten tag und \xff\xfe guten tag und", None), (101, b"\xff\xfe\xc3", None), (102, b"hello and \xe2\x28 the", "en")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_languages(broken(spark, rows), dimensions=256).collect()}
    assert got[100][0] == "de" and got[102][0] == "en"
    assert got[101] == ("und", 0.0)


def test_leaks_in_broken_texts(spark):
    item = "which river runs through the old town of the northern valley\nthe silver river"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    bench = bench.unionByName(spark.sql("select 2L as item_id, cast(X'61FF62' as string) as text"))
    rows = [(1, prose(1, 50).encode() + b" \xff " + item.encode() + b" \xc3", "x"), (2, b"\xff\xfe", "x"), (3, prose(2, 60).encode(), "x")]
    docs = broken(spark, rows)
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).select("doc_id", "item_id").collect()} == {(1, 1)}
    kept = decontamination.drop_leaks(docs, bench)
    assert sorted(bytes(r.b) for r in kept.select(F.col("text").cast("binary").alias("b")).collect()) == sorted([rows[1][1], rows[2][1]])


def plain_vector(gram, dimensions):
    """The product of the letters' vectors, each turned by its place."""
    out = np.ones(dimensions)
    for place, letter in enumerate(gram):
        point = 0 if letter == " " else ord(letter)
        out = out * np.roll(language_id._letter_vector(point, dimensions).astype(float), len(gram) - 1 - place)
    return out


def plain_text(text):
    kept = "".join(c.lower() if c.isalpha() else " " for c in text)
    return " " + " ".join(kept.split()) + " "


def plain_bundle(text, dimensions):
    s = plain_text(text)
    return sum(plain_vector(s[k : k + 3], dimensions) for k in range(len(s) - 2))


def test_scores_against_plain_bundling(spark):
    texts = [(k, prose(k, 30, 60) if k % 2 else "le chat et la souris, été %d fois" % k, "en" if k % 2 else "fr") for k in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    made = language_id.identify_languages(docs, dimensions=128).collect()
    held = {r.doc_id for r in made if r.held_out}
    prototypes = {lang: sum(plain_bundle(t, 128) for k, t, own in texts if own == lang and k not in held) for lang in ("en", "fr")}

    def cosine(a, b):
        return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))

    for r in made:
        own = plain_bundle(texts[r.doc_id][1], 128)
        want = {lang: cosine(p, own) for lang, p in prototypes.items()}
        best = max(sorted(want), key=want.get)
        assert r.lang_pred == best and abs(r.score - max(want[best], 0)) < 1e-9
