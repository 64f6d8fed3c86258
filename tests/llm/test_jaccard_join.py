import random

import numpy as np
import pytest
from made_up import prose, rows_of, word

from tickloom.llm import components as links_of
from tickloom.llm import jaccard_join
from tickloom.llm.components import components


def brute(rows, size, percent):
    """n_shingles, n_links and component_id by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return sorted((rows[k][0], len(sets[k]), links[k], min(groups[find(k)])) for k in range(len(rows)))


def copies(seed):
    """Groups of exact and near copies, a passage that many share, and loners."""
    r = random.Random(seed)
    passage = prose(99, 30)
    out = []
    for g in range(12):
        base = prose(1000 * seed + g, r.choice([12, 40, 90, 150]), 3000).split()
        for _ in range(r.choice([1, 2, 9, 25])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                own[r.randrange(len(own))] = word(r.randrange(3000))
            out.append(" ".join(own) if r.random() < 0.7 else passage + " " + " ".join(own))
    out += [passage + " " + word(5000 + k) for k in range(30)] + ["", None, "a", "A", "a b", "a  b"]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed, size, percent", [(1, 3, 90), (2, 5, 80)])
def test_matches_all_pairs(spark, odd, monkeypatch, seed, size, percent):
    rows = rows_of(copies(seed))
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 8)  # lists and units of several chunks
    monkeypatch.setattr(jaccard_join, "UNIT_SETS", 6)
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, odd.schema).repartition(3), size, percent).collect()
    want = brute([r[:2] for r in rows], size, percent)
    assert sorted((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in got) == want
    assert sum(w[2] for w in want) > 200


def test_odd_rows(odd, none):
    got = jaccard_join.jaccard_classes(odd, keep=("n", "row")).collect()
    assert len(got) == odd.count()
    same = [r for r in got if r.doc_id == 7]
    assert len(same) == 4 and all(r.n_links == 6 and r.component_id == 7 for r in same)
    blank = [r for r in got if r.n_shingles == 0]
    assert len(blank) == 4 and all(r.n_links == 0 and r.component_id == r.doc_id for r in blank)
    assert {r.component_id for r in got if r.doc_id in (3, 4)} == {3}
    assert jaccard_join.jaccard_classes(none).count() == 0


def test_overlaps_are_derived_from_similar_sets():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 1 << 60, 300).astype(np.uint64))
    sets = {k: np.unique(np.concatenate([base[r.random(len(base)) < 0.97], r.integers(0, 1 << 60, 5).astype(np.uint64)])) for k in range(20)}
    overlaps = jaccard_join.Overlaps(sets)
    for a in range(20):
        partners = list(range(a + 1, 20))
        assert overlaps.of(a, partners) == {z: len(np.intersect1d(sets[a], sets[z])) for z in partners}
    assert overlaps.derived > 100


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(300, 301), (301, 300), (301, 302)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(200, 260)} == {7}
    assert got[302] == 300 and len(got) == 61 + 61 + 3


def test_few_links_settle_without_a_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(links_of, "materialize", lambda df, write=links_of.materialize: written.append(1) or write(df))
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long").repartition(3)).collect()}
    assert set(got.values()) == {7, 100} and len(written) == 1


@pytest.mark.parametrize("at_once", [1, 50])
def test_components_of_links_cut_into_small_parts(spark, monkeypatch, at_once):
    monkeypatch.setattr(links_of, "LINKS_AT_ONCE", at_once)
    monkeypatch.setattr(links_of, "_settled", lambda edges, ask=links_of._settled: rounds.append(1) or ask(edges))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    rounds = []
    r = random.Random(3)
    nodes = r.sample(range(10**12), 500)
    links = [(nodes[k], nodes[k + 1]) for k in range(499) if k % 100 != 99] + [(None, 5), (5, 5), (nodes[0], nodes[1])]
    r.shuffle(links)
    try:
        got = sorted(tuple(x) for x in components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert got == sorted((nodes[k], min(nodes[k // 100 * 100 : k // 100 * 100 + 100])) for k in range(500))
    assert len(rounds) > 1


def test_tied_against_walking():
    r = np.random.default_rng(5)
    a, b = r.integers(0, 300, (2, 200))
    root = np.arange(300)
    for _ in range(300):
        for x, y in zip(a, b):
            root[[x, y]] = root[[x, y]].min()
    assert np.array_equal(links_of.tied(300, a, b), root)
