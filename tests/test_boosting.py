import random

from tickloom.operators import boosting


def plain(rows, features, plan):
    """The same trees by scanning rows. rows: (bins, y)."""
    rest = [y - int(sum(y for _, y in rows) / len(rows) // 1) for _, y in rows]
    gains = [0.0] * features
    for _ in range(plan.trees):
        nodes = [1] * len(rows)
        for _ in range(plan.depth):
            best = {}
            for node in set(nodes):
                own = [k for k, at in enumerate(nodes) if at == node]
                s, n = sum(rest[k] for k in own), len(own)
                for f in range(features):
                    for cut in sorted({rows[k][0][f] for k in own}):
                        left = [k for k in own if rows[k][0][f] <= cut]
                        n1, s1 = len(left), sum(rest[k] for k in left)
                        if n1 < plan.min_rows or n - n1 < plan.min_rows:
                            continue
                        gain = float(s1) * s1 / n1 + float(s - s1) * (s - s1) / (n - n1) - float(s) * s / n
                        if gain > 0 and (node not in best or gain > best[node][0]):
                            best[node] = gain, f, cut
            for gain, f, _ in best.values():
                gains[f] += gain
            nodes = [at if at not in best else 2 * at + (rows[k][0][best[at][1]] > best[at][2]) for k, at in enumerate(nodes)]
        for node in set(nodes):
            own = [k for k, at in enumerate(nodes) if at == node]
            leaf = int(sum(rest[k] for k in own) / len(own) * plan.rate // 1)
            for k in own:
                rest[k] -= leaf
    return [g / sum(gains) for g in gains]


def test_importance_against_scanning(spark):
    r = random.Random(6)
    data = []
    for _ in range(400):
        a, b, c = r.uniform(0, 10), r.gauss(0, 1), r.choice([1.0, 2.0])
        data.append((a, b, c, a, 7.0, (a > 6) * 0.5 + b * 0.2 * (c > 1) + r.gauss(0, 0.01)))
    data += [(None, 0.0, 1.0, 0.0, 7.0, 1.0), (1.0, float("inf"), 1.0, 1.0, 7.0, 1.0), (1.0, 1.0, 1.0, 1.0, 7.0, None)]
    names = ["a", "b", "c", "copy", "flat"]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in (*names, "y")))
    plan = boosting.Plan(trees=4, depth=2, bins=16)
    rows = [(x.bins, x.y) for x in boosting.binned(df, names, "y", plan).collect()]
    assert len(rows) == 400 and {x[4] for x, _ in rows} == {0} and max(x[0] for x, _ in rows) == 15
    want = dict(zip(names, plain(rows, 5, plan), strict=True))
    got = {x.feature: x.importance for x in boosting.model_importance(df, names, "y", 5, plan).collect()}
    # The earlier of two equal features takes all of the gain.
    assert "copy" not in got and "flat" not in got and list(got)[0] == "a"
    assert all(abs(got[c] - want[c]) < 1e-12 for c in got) and abs(sum(got.values()) - 1) < 1e-12


def test_nothing_to_learn(spark):
    schema = "x double, y double"
    none = spark.createDataFrame([], schema)
    assert boosting.model_importance(none, ["x"], "y", 3).collect() == []
    flat = spark.createDataFrame([(float(k), 1.0) for k in range(100)], schema)
    assert boosting.model_importance(flat, ["x"], "y", 3).collect() == []
