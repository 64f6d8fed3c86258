import re
from collections import Counter

import numpy as np
import pyarrow as pa
from made_up import prose, rows_of

from tickloom.llm import quality_rules as rules
from tickloom.llm import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["a b  c", "", None, " x", "A b c \u0085 d", "é\tÉ z", "a b c a b c a", "l1\nl2\nl1\n\n \nl1", "x" * 3000000, "end "]


def figures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_words_match_the_pattern():
    for block in words.blocks(pa.array(TEXTS), lower=False):
        starts, ends, offsets = block.words()
        for k in range(len(block)):
            found = [block.data[s:e].tobytes().decode() for s, e in zip(starts[offsets[k] : offsets[k + 1]], ends[offsets[k] : offsets[k + 1]])]
            assert found == WORD.findall(TEXTS[block.first + k] or "")


def test_equal_words_have_equal_hashes_wherever_they_stand():
    hashes, offsets = next(words.blocks(pa.array(["aa b aa", "b aa", "AA"]))).word_hashes()
    assert hashes[0] == hashes[2] == hashes[4] == hashes[5] and hashes[1] == hashes[3] != hashes[0]


def test_shingles_of_few_words():
    sets = words.shingle_sets(next(words.blocks(pa.array(["a b", "a b c", "", "a  B", "a b c d a b c"]))), 3)
    assert [len(s) for s in sets] == [1, 1, 0, 1, 4]
    assert sets[0] == sets[3] and sets[0] != sets[1] and sets[1][0] in sets[4]


def test_sliced_columns_and_several_blocks():
    texts = pa.array([prose(k, 200) for k in range(40)])
    whole = [w.tolist() for b in words.blocks(texts) for w in words.shingle_sets(b, 3)]
    parts = [w.tolist() for b in words.blocks(texts.slice(7), limit=3000) for w in words.shingle_sets(b, 3)]
    assert parts == whole[7:]


def test_rule_figures_and_verdict(spark, odd, none):
    texts = TEXTS[:8] + [prose(5, 60), prose(6, 60) + " #" * 30, ("go on now " * 40), prose(7, 90).upper(), "w " * 200]
    docs = spark.createDataFrame(rows_of(texts), odd.schema)
    got = {r.doc_id: r for r in rules.quality_rules(docs, sample_rows=5).collect()}
    for k, text in enumerate(texts):
        want = figures(text)
        assert tuple(got[k][c] for c in rules.FIGURES) == want, k
        assert got[k].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert got[8].kept and not got[9].kept and got[9].failed_rule == "symbols"
    assert not got[10].kept and got[11].failed_rule == "shouting" and not got[12].kept
    assert rules.quality_rules(odd).count() == odd.count()
    assert rules.quality_rules(none).count() == 0


def test_cascade_order_never_changes_the_verdict():
    block = next(words.blocks(pa.array([prose(k, 50) + " #" * (k % 40) + (" A" * (k % 97)) for k in range(200)]), lower=False))
    verdicts = [rules.cascade(rules.Texts(block), order) >= 0 for order in (rules.RULES, rules.RULES[::-1])]
    assert np.array_equal(*verdicts) and verdicts[0].any() and not verdicts[0].all()


def test_order_is_rejection_per_cost():
    measured = {"symbols": (1.0, 0.1), "shouting": (0.1, 0.1), "word_length": (1.0, 0.0), "repeated_lines": (2.0, 0.9), "few_letters": (1.0, 0.0)}
    assert [r.name for r in rules.ordered(rules.RULES, measured)][:3] == ["shouting", "repeated_lines", "symbols"]
