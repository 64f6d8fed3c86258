import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from tickloom.operators import blocks, drawdown, ranges

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def deepest(x):
    top, fall = -np.inf, 0.0
    for v in x:
        top = max(top, v)
        fall = max(fall, (top - v) / top)
    return fall


def test_ranges_against_scanning():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 8, 33):
        x = r.integers(50, 90, n).astype(float)
        table = ranges.Ranges(x, x, np.zeros(n))
        first, last = (v.ravel() for v in np.meshgrid(np.arange(n), np.arange(n)))
        high, low, fall = table.query(first, last)
        for k, (a, b) in enumerate(zip(first, last, strict=True)):
            if a > b:
                assert np.isnan([high[k], low[k], fall[k]]).all()
            else:
                part = x[a : b + 1]
                assert (high[k], low[k]) == (part.max(), part.min())
                assert fall[k] == deepest(part)


def test_last_at_least():
    r = np.random.default_rng(3)
    for n in (1, 2, 9, 40):
        x = r.integers(0, 10, n).astype(float)
        at, bound = (v.ravel() for v in np.meshgrid(np.arange(n), np.arange(12.0)))
        want = [max((k for k in range(i + 1) if x[k] >= b), default=-1) for i, b in zip(at, bound, strict=True)]
        assert list(ranges.last_at_least(x, at, bound)) == want


def brute(rows):
    out, active, since = {}, False, None
    for i, (now, e) in enumerate(rows):
        window = [(t, x) for t, x in rows[: i + 1] if t >= now - timedelta(days=30)]
        peak = max(x for _, x in window)
        fall = (peak - e) / peak
        if fall >= 0.10 and not active:
            active, since = True, now
        if active and now >= since + timedelta(days=7) and fall < 0.05:
            active = False
        near = [t for t, x in window if x >= peak * 0.99][-1]
        out[i] = (peak, deepest([x for _, x in window]), active, (now - near).days)
    return out


@pytest.mark.parametrize("block_rows", [7, 64])
def test_one_account_with_most_rows_and_uneven_time(spark, block_rows):
    """Dense days, long gaps, a slow decline over many blocks, equal times; small accounts beside."""
    r = random.Random(5)
    accounts = {}
    for account, n in (("hot", 500), ("small", 40), ("one", 1)):
        now, e, rows = T0, 100e3, []
        for k in range(n):
            now += timedelta(hours=r.choice([0, 0, 0, 1, 2, 9]) if k % 100 < 70 else r.choice([20, 60, 400]))
            e *= 1 + (r.uniform(-0.001, 0.0005) if k % 50 < 35 else r.uniform(-0.03, 0.03))
            rows.append((now, e))
        accounts[account] = rows
    df = spark.createDataFrame(
        [(a, t, k, e) for a, rows in accounts.items() for k, (t, e) in enumerate(rows)],
        "account string, ts timestamp, step long, equity double",
    )
    made = drawdown.drawdown_guard(df, order=["ts", "step"], block_rows=block_rows, warm_up=4).collect()
    assert len(made) == 541
    for account, rows in accounts.items():
        want = brute(rows)
        for x in (m for m in made if m.account == account):
            got = (x.peak_equity, pytest.approx(x.max_drawdown), x.is_triggered, x.days_in_drawdown)
            assert got == want[x.step], (account, x.step)


def test_no_task_holds_more_than_two_blocks(spark, monkeypatch):
    """A third of all rows in one account: a task gets a block and the block its windows start in."""
    rows = [("hot", T0 + timedelta(minutes=20 * k), k, 100.0 + k % 17) for k in range(3000)]
    rows += [(f"a{k % 60}", T0 + timedelta(minutes=k), k, 100.0) for k in range(6000)]
    df = spark.createDataFrame(rows, "account string, ts timestamp, step long, equity double")
    from pyspark.sql import functions as F

    from tickloom.operators.blocks import Series, row_slots

    slots = row_slots(df, ["account"], [F.col("ts"), F.col("step")], F.to_date("ts")).withColumn("at", F.unix_micros("ts"))
    inner = ranges._windows

    def counted(frame, pair, *rest):
        assert len(frame) <= 200
        return inner(frame, pair, *rest)

    monkeypatch.setattr(ranges, "_windows", counted)
    found = ranges.trailing_status(slots, Series(("account",), 100), 10 * 86400 * 10**6, "at", "equity")
    assert found.count() == 9000


def test_values_at_and_below_zero(spark):
    rows = [("a", T0 + timedelta(days=k), k, e) for k, e in enumerate([-5.0, -3.0, -3.0, -8.0, 0.0, -1.0, None, -2.0])]
    df = spark.createDataFrame(rows, "account string, ts timestamp, step long, equity double")
    made = drawdown.drawdown_guard(df, order=["ts", "step"], block_rows=2).orderBy("step").collect()
    assert [x.peak_equity for x in made] == [-5.0, -3.0, -3.0, -3.0, 0.0, 0.0, 0.0, 0.0]
    assert [x.days_in_drawdown for x in made] == [0, 0, 0, 1, 0, 1, 2, 3]
    assert not any(x.is_triggered for x in made)


@pytest.mark.parametrize("together", [1, 21, 100])
def test_short_blocks_are_handed_over_together(spark, monkeypatch, together):
    from tickloom.operators.blocks import Series

    r = random.Random(8)
    rows, e = [], 100e3
    for k in range(300):
        e *= 1 + (r.uniform(-0.001, 0.0005) if k % 50 < 35 else r.uniform(-0.03, 0.03))
        rows.append((r.choice(["a", None]), T0 + timedelta(hours=7 * k), k, e))
    df = spark.createDataFrame(rows, "account string, ts timestamp, step long, equity double")
    want = sorted(map(str, drawdown.drawdown_guard(df, order=["ts", "step"]).collect()))
    monkeypatch.setattr(blocks, "DEFAULT_ROWS", together)
    assert Series(rows=7).together == max(together // 7, 1)
    made = drawdown.drawdown_guard(df, order=["ts", "step"], block_rows=7, warm_up=3)
    assert sorted(map(str, made.collect())) == want
