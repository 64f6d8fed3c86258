import random

import numpy as np
import pyarrow as pa
from made_up import prose, rows_of

from tickloom.llm import decontamination as leaks
from tickloom.llm import secrets, words


def items(count):
    return [(k, prose(5000 + k, 30, 900) + ".\n" + prose(7000 + k, 6, 900) + ".") for k in range(count)]


def test_planted_items_are_found_and_clean_texts_left_alone(spark, odd):
    bench = items(60)
    r = random.Random(2)
    texts, want = [], set()
    for k in range(200):
        text = prose(k, r.choice([5, 60, 900]), 900)
        if k % 4 == 0:
            item, body = r.choice(bench)
            body = r.choice([body, body.upper(), body.replace(" ", "  ")])
            at = r.randrange(len(text))
            text = text[:at] + " " + body + " " + text[at:]
            want.add((k, item))
        texts.append(text)
    docs = spark.createDataFrame(rows_of(texts), odd.schema).repartition(3)
    benchmark = spark.createDataFrame([*bench, (900, None), (901, ""), (902, "..")], "item_id long, text string")
    got = leaks.find_leaks(docs, benchmark).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    assert all(x.score > 0.95 and x.question_overlap > 0.9 for x in got)
    clean = {x.doc_id for x in leaks.drop_leaks(docs, benchmark).collect()}
    assert clean == set(range(200)) - {k for k, _ in want}


def test_passes_over_a_large_benchmark(spark, odd, monkeypatch):
    bench = items(40)
    docs = spark.createDataFrame(rows_of([text for _, text in bench] + [prose(1, 100)]), odd.schema)
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    one = sorted(map(tuple, leaks.find_leaks(docs, benchmark).collect()))
    monkeypatch.setattr(leaks, "ITEMS_PER_PASS", 15)
    monkeypatch.setattr(leaks, "PART_ITEMS", 4)
    many = sorted(map(tuple, leaks.find_leaks(docs, benchmark).collect()))
    assert [x[:2] for x in one] == [x[:2] for x in many] == [(k, k) for k in range(40)]
    assert np.allclose([x[2] for x in one], [x[2] for x in many])


def test_items_of_frequent_words_only(spark, odd):
    text = prose(4, 30, 40)
    benchmark = spark.createDataFrame([(k, text + ".\n" + prose(5, 4, 40)) for k in range(3)], "item_id long, text string")
    docs = spark.createDataFrame(rows_of([prose(6, 90, 900) + " " + text + " " + prose(5, 4, 40), prose(7, 90, 900)]), odd.schema)
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, benchmark).collect()} == {(0, 0), (0, 1), (0, 2)}


def test_wand_returns_all_above_the_threshold():
    r = random.Random(5)
    texts = [prose(k, r.choice([8, 20, 40]), 60) for k in range(30)]
    frequency: dict[int, int] = {}
    hashed = leaks._text_words(texts)
    for own in hashed:
        for h in np.unique(own).view(np.int64).tolist():
            frequency[h] = frequency.get(h, 0) + 1
    index = leaks.build_index(list(range(30)), texts, 30, frequency, float(np.mean([len(h) for h in hashed])))
    for k in range(60):
        terms = np.unique(index.terms(leaks._text_words([prose(k, 30, 60)])[0]))
        terms = terms[terms >= 0]
        scores = np.zeros(30)
        for t in terms:
            own = slice(index.post_at[t], index.post_at[t + 1])
            scores[index.post_item[own]] += index.impact[own]
        for threshold in (0.1, 0.3, 0.6):
            found = {i: s for b in range(len(index.rest)) for i, s in leaks.wand(index, terms, b, threshold)}
            assert set(found) == set(np.flatnonzero(scores >= threshold - 1e-12))
            assert all(abs(scores[i] - s) < 1e-9 for i, s in found.items())


def test_odd_and_empty_tables(spark, odd, none):
    benchmark = spark.createDataFrame(items(5), "item_id long, text string")
    empty = benchmark.limit(0)
    assert leaks.find_leaks(odd, benchmark).count() == 0
    for docs, bench in ((odd, empty), (none, benchmark), (none, empty)):
        assert leaks.find_leaks(docs, bench).count() == 0
        assert leaks.drop_leaks(docs, bench).count() == docs.count()
    assert secrets.scan_secrets(none).count() == 0
    assert secrets.scan_secrets(odd).count() == 0


def test_forest_tells_keys_from_numbers(spark, odd):
    r = random.Random(9)
    texts, want = [], {}
    for k in range(240):
        before = prose(k, 20) + " "
        if k % 3 == 0:
            value = "".join(r.choices("0123456789abcdef", k=40))
            text = f'{before}token = "{value}" {prose(k, 5)}'
        elif k % 3 == 1:
            text = f"{before}account {r.randrange(10**15, 10**16)} {prose(k, 5)}"
        else:
            text = f"{before}commit {''.join(r.choices('0123456789abcdef', k=40))} {prose(k, 5)}"
        texts.append(text)
        want[k] = k % 3 == 0
    docs = spark.createDataFrame(rows_of(texts), odd.schema)
    got = secrets.scan_secrets(docs, trees=15).collect()
    assert len(got) == 240 and len({x.doc_id for x in got}) == 240
    assert all(texts[x.doc_id].encode()[x.start :][: x.length_bytes].decode().startswith(x.masked[:4]) for x in got)
    held = [x for x in got if x.held_out]
    assert len(held) > 20 and sum(x.is_secret == want[x.doc_id] for x in held) / len(held) > 0.95
    # Labels of one's own: here only numbers count.
    own = spark.createDataFrame([(x.doc_id, x.start, int(x.doc_id % 3 == 1)) for x in got], "doc_id long, start long, label int")
    again = [x for x in secrets.scan_secrets(docs, own, trees=15).collect() if x.held_out]
    assert sum(x.is_secret == (x.doc_id % 3 == 1) for x in again) / len(again) > 0.95


def test_every_long_candidate_is_listed():
    text = "key=" + "a1" * 10 + " " + "b" * 30 + " " + "1" * 15 + "\n" + "Z9" * 8
    block = next(words.blocks(pa.array([text]), lower=False))
    starts, ends, _ = block.runs(secrets.KEY_BYTES)
    long = [text[s:e] for s, e in zip(starts, ends) if e - s >= secrets.LEAST_LENGTH]
    assert long == ["a1" * 10, "b" * 30, "Z9" * 8]
