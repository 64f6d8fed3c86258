import random

import numpy as np
import pandas as pd
import pytest

from tickloom.operators.features import FeatureSet
from tickloom.operators.sequential import guard, reversals, trailing_band


def walk(r, n, size, grid=None):
    """Highs, lows and closes of a random walk; a coarse grid gives equal prices."""
    close, out = 100.0, []
    for _ in range(n):
        close += r.gauss(0, size)
        a, b = close + abs(r.gauss(0, size)) * r.choice([0, 1]), close - abs(r.gauss(0, size)) * r.choice([0, 1])
        row = (a, b, close)
        out.append(tuple(round(v / grid) * grid for v in row) if grid else row)
    return [list(c) for c in zip(*out, strict=True)]


def check(machine, columns, before, states):
    """The transfer function against running the rows; how many states it could tell."""
    made = machine.transfer(columns, before)
    told = 0
    for state in states:
        _, end = machine.run(list(state), columns)
        left = machine.follow(made, list(state))
        if left is not None:
            told += 1
            assert [repr(float(v)) for v in left] == [repr(float(v)) for v in end], (state, made)
    return told / len(states)


@pytest.mark.parametrize("size", [0.01, 0.3, 2.0])
@pytest.mark.parametrize("grid", [None, 0.5])
def test_reversals(size, grid):
    r = random.Random(1)
    machine = reversals(0.02, "z_")
    for _ in range(60):
        highs, lows, closes = walk(r, r.randrange(1, 80), size, grid)
        pivots = [r.choice(highs + lows) * f for f in (1, 1, 0.97, 0.98, 0.985, 0.999, 1.001, 1.02, 1.03)]
        states = [(t, p) for p in pivots + highs + lows for t in (1.0, -1.0)]
        assert check(machine, [highs, lows], None, states) == 1
        check(machine, [highs, lows], None, [(0.0, p) for p in pivots])


@pytest.mark.parametrize("size", [0.01, 0.3, 2.0])
@pytest.mark.parametrize("grid", [None, 0.5])
def test_trailing_band(size, grid):
    r = random.Random(2)
    machine = trailing_band(1.5, "atr", "s_")
    told = []
    for _ in range(150):
        n = r.randrange(1, 80)
        highs, lows, closes = walk(r, n, size, grid)
        reach = [abs(r.gauss(2 * size, size / 3)) for _ in range(n)]
        if grid:
            reach = [round(x / grid) * grid * r.choice([0, 1, 1]) for x in reach]
        before = closes[0] + r.gauss(0, size)
        if grid:
            before = round(before / grid) * grid
        states = []
        for _ in range(60):
            top = r.choice(closes) + r.choice([0, 0.5, 1, 3]) * size * r.choice([1, r.random()])
            bottom = top - r.choice([0, 0.5, 1, 3, 6]) * size * r.choice([1, r.random()])
            states.append((top, bottom, r.choice([top, bottom]), before))
        # Any state, among them bands on one side of the close before, equal or crossed.
        check(machine, [highs, lows, closes, reach], [0.0, 0.0, before, 0.0], states)
        # States that rows lead to.
        cut = n // 2
        if cut:
            columns = [highs, lows, closes, reach]
            ends = [machine.run(None, [c[k:cut] for c in columns])[1] for k in range(cut)]
            told.append(check(machine, [c[cut:] for c in columns], [c[cut - 1] for c in columns], ends))
    assert np.mean(told) > (0.95 if grid is None else 0.3)


def test_guard():
    r = random.Random(3)
    machine = guard(0.1, 20.0, "fall", "clock", "flag")
    for _ in range(100):
        n = r.randrange(1, 60)
        falls = [r.choice([0.0, 0.03, 0.07, 0.1, 0.2]) for _ in range(n)]
        clock = [100.0 + 3 * k + r.choice([0, 0, 1]) for k in range(n)]
        states = [(0.0, 0.0)] + [(1.0, 100 - x) for x in (1.0, 5.0, 19.0, 20.0, 21.0, -3.0 * n, 0.0)] + [(1.0, c - 20) for c in clock]
        assert check(machine, [falls, clock], None, states) == 1


def bars_of(close, spread=0.01):
    n = len(close)
    p = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "close": close})
    p["open"] = p["close"]
    p["high"], p["low"], p["volume"] = p["close"] + spread, p["close"] - spread, 1.0
    return p


def ordered(spark, bars, names, **options):
    made = FeatureSet().transform(spark.createDataFrame(bars), names, every=3600, complete=True, **options).toPandas()
    return made.sort_values("ts", ignore_index=True)


@pytest.mark.parametrize("name", ["ZIG_ZAG_5", "SUPERTREND_10_3", "PSAR"])
def test_quiet_blocks_need_few_rounds(spark, caplog, name):
    """A turn in the first block, then 64 blocks in which nothing happens."""
    n = 65 * 64
    wiggle = 0.5 * np.sin(np.arange(n) / 5.0)
    close = np.r_[100.0, 112.0, 118.0, 118.0 + wiggle[3:]]
    bars = bars_of(close)
    if name.startswith("SUPER"):
        # A jump that no later close takes back, far from either band.
        bars.loc[:1, ["high", "low"]] = [[150.0, 60.0], [150.0, 60.0]]
    with caplog.at_level("INFO", "tickloom.operators.sequential"):
        cut = ordered(spark, bars, [name], block_rows=64, warm_up=16)
    assert len([r for r in caplog.records if "round" in r.message]) <= 8
    whole = ordered(spark, bars, [name])
    np.testing.assert_array_equal(cut[name], whole[name])


def test_restless_blocks(spark, caplog):
    r = np.random.default_rng(4)
    bars = bars_of(100 * np.exp(r.normal(0, 0.01, 1500).cumsum()), 0.3)
    names = ["ZIG_ZAG_5", "SUPERTREND_7_3", "SUPERTREND_10_3", "PSAR"]
    with caplog.at_level("INFO", "tickloom.operators.sequential"):
        cut = ordered(spark, bars, names, block_rows=32, warm_up=8)
    assert len([x for x in caplog.records if "round" in x.message]) <= 8
    whole = ordered(spark, bars, names)
    for name in names:
        np.testing.assert_array_equal(cut[name], whole[name])
