import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from made_up import prose, rows_of, word

from tickloom.llm import language_id, language_model, quality_model, toxicity, words


def remainder(doc_id, modulus):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def test_quality_separates_held_out_texts(spark, odd):
    r = random.Random(4)
    texts, marks = [], []
    for k in range(300):
        bad = r.random() < 0.4
        text = prose(k, r.choice([20, 90, 400]))
        texts.append(" ".join(w + r.choice(["###", "$$$", "!!"]) for w in text.split()) if bad else text.capitalize() + ".")
        marks.append(1 - bad)
    docs = spark.createDataFrame(rows_of(texts), odd.schema)
    labels = spark.createDataFrame([(k, m, 0) for k, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    rows = quality_model.score_quality(docs, labels, rows_per_class=60, carry=True).collect()
    assert all(r.row.text == texts[r.doc_id] and r.held_out == (remainder(r.doc_id, 5) == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == marks[r.doc_id] for r in held) / len(held) > 0.95


def test_attention_gradients():
    r = np.random.default_rng(0)
    x, bags, y = r.standard_normal((9, 4)), np.array([0, 3, 4, 9]), np.array([1, 0, 1])
    model = quality_model.fit_attention(x, bags, y, hidden=3, attention=2, epochs=300, batch=3, rate=0.02, decay=0.0)
    assert ((model._forward(x, bags)["logit"] > 0) == (y > 0)).all()
    weights = model._forward(x, bags)["w"]
    assert np.allclose(np.add.reduceat(weights, bags[:-1]), 1)


def test_passages_cover_whole_texts():
    block = next(words.blocks(pa.array(["", prose(1, 64), prose(2, 65), "  x"]), lower=False))
    x, bags = quality_model.passages(block)
    assert np.diff(bags).tolist() == [1, 1, 2, 1] and np.isfinite(x).all()


def test_toxicity_finds_expressions_unseen_in_their_form(spark, odd):
    r = random.Random(6)
    texts, marks = [], []
    for k in range(600):
        own = prose(k, r.choice([40, 150]), 2000).split()
        bad = r.random() < 0.25
        if bad:
            for at in r.sample(range(len(own)), max(1, len(own) // 40)):
                own[at] = "zorg" + r.choice("abcdefgh") + r.choice("mnopqrst")
        texts.append(" ".join(own))
        marks.append(int(bad))
    docs = spark.createDataFrame(rows_of(texts), odd.schema)
    labels = spark.createDataFrame([(k, 1, m) for k, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.score_toxicity(docs, labels, rows_per_class=300).collect() if r.held_out]
    assert sum(r.predicted == marks[r.doc_id] for r in held) / len(held) > 0.95


def test_kneser_ney_ratios_follow_the_tree():
    texts = pa.array(["zorgam zorgbn good day", "good day good night"])
    model = toxicity.fit_kneser_ney(texts, np.array([1, 0]))
    block = next(words.blocks(pa.array(["zorgam zorgxx good unseen"])))
    starts, ends, _ = block.runs(words.LETTER)
    ratio = model.word_ratios(block, starts, ends - starts)
    assert ratio[0] >= ratio[1] and np.isfinite(ratio).all() and ratio[3] == 0


def test_letters_behind_the_tenth_and_scripts_without_blanks_count():
    texts = pa.array(["abcdefghijklmnzorg день", "abcdefghijklmngood день", "今天天气很好我们去公园混蛋", "今天天气很好我们去公园散步"] * 5)
    model = toxicity.fit_kneser_ney(texts, np.array([1, 0, 1, 0] * 5))
    block = next(words.blocks(pa.array(["abcdefghijklmnzorg", "abcdefghijklmngood", "他们昨天说你是混蛋", "他们昨天说你是散步", "好。混蛋"])))
    most = toxicity.text_figures(model, block)[:, 1]
    assert most[0] > 0.5 > -0.5 > most[1]
    assert most[2] > 0.3 > most[3] and most[4] > 0.3


def test_language_of_held_out_texts(spark, odd):
    r = random.Random(8)
    syllables = {"aa": ["la", "mi", "tou"], "bb": ["ßor", "ähm", "kt"], "cc": ["при", "вет", "ка"]}
    rows = []
    for k in range(200):
        lang = r.choice(list(syllables))
        text = " ".join("".join(r.choices(syllables[lang], k=3)) for _ in range(30))
        rows += rows_of([text], k, lang)
    rows += rows_of([None, "", "12 34 !?"], 200, "aa")
    got = {r.doc_id: r for r in language_id.identify_languages(spark.createDataFrame(rows, odd.schema), dimensions=256).collect()}
    assert all(got[x[0]].lang_pred == x[2] for x in rows[:200])
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (200, 201, 202))
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got.values())


def test_gram_vectors_survive_a_full_cache(monkeypatch):
    monkeypatch.setattr(language_id, "CACHE_ROWS", 16)
    block = next(words.blocks(pa.array(["abcdefghijklmnopqrstuvwxyz" * 2])))
    (_, code, count), = language_id.grams(block)
    small = language_id.GramVectors(64).bundle(code, count)
    monkeypatch.setattr(language_id, "CACHE_ROWS", 1024)
    assert np.allclose(small, language_id.GramVectors(64).bundle(code, count))


def test_base_scores_and_normalised_states(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(k, prose(k, 50)) for k in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None] for _, t in rows]
    counts = Counter(w for (i, _), own in zip(rows, tokens) if remainder(i, 10) for w in own)
    total, distinct = sum(counts.values()), len(counts)
    got = language_model.score_texts(docs, head_words=300, states=64).collect()
    key = lambda *x: tuple((v is not None, v) if not isinstance(v, float) else round(v, 6) for v in x)
    want = sorted(
        key(i, len(own), sum(counts[w] > 0 for w in own), sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own))
        for (i, _), own in zip(rows, tokens)
    )
    assert sorted(key(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got) == want
    assert all(r.train_tokens == total and math.isfinite(r.score) and r.score < 0 for r in got)


def test_log_bilinear_learns_successors():
    r = np.random.default_rng(5)
    law = r.dirichlet(np.full(40, 0.1), 40)
    pairs = r.poisson(2000 * law).astype(np.float32)
    model = language_model.fit_log_bilinear(pairs, vector=16, epochs=200, rows=20)
    table = model.table() * np.log(10)
    assert np.allclose(np.exp(table).sum(1), 1, atol=1e-4)
    unigram = np.log((pairs.sum(0) + 0.1) / (pairs.sum() + 4))
    assert (pairs * table).sum() / pairs.sum() > (pairs * unigram).sum() / pairs.sum() + 0.5


def test_odd_and_empty_tables(spark, odd, none, labels):
    nothing = labels.limit(0)
    n = odd.count()
    for marks in (labels, nothing):
        for f in (quality_model.score_quality, toxicity.score_toxicity):
            got = f(odd, marks, rows_per_class=20).collect()
            assert len(got) == n and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
            assert f(none, marks, rows_per_class=20).count() == 0
    assert language_id.identify_languages(odd, dimensions=64).count() == n
    assert language_id.identify_languages(none, dimensions=64).count() == 0
    assert language_model.score_texts(none, states=16).count() == 0
    assert word(0) == "w"
