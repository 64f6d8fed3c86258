import collections
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators import drawdown, positions, sizing

T0 = datetime(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_kelly(spark):
    lit = F.lit
    size = sizing.kelly_size(lit(100000.0), lit(50000.0), lit(1.0), 0.6, 0.02, 0.01, min_edge=0.005)
    assert one(spark, size) == pytest.approx(0.2)
    assert one(spark, sizing.kelly_size(lit(100000.0), lit(50000.0), lit(1.0), 0.6, 0.02, 0.0)) == 0
    assert one(spark, sizing.kelly_size(lit(100000.0), lit(50000.0), lit(1.0))) == 0


def test_costs(spark):
    taker, maker = sizing.entry_cost(F.lit(100000.0)), sizing.entry_cost(F.lit(100000.0), True)
    assert one(spark, taker)["commission"] == pytest.approx(50)
    assert one(spark, maker)["commission"] == pytest.approx(20)
    assert one(spark, sizing.vip_fee(0.0005, F.lit(9))) == pytest.approx(0.0005 * 0.55)
    assert one(spark, sizing.vip_fee(0.0005, F.lit(12))) == pytest.approx(0.0005)
    slow, fast = (one(spark, sizing.entry_cost(F.lit(1000.0), urgency=u))["slippage"] for u in (0.0, 1.0))
    assert fast == pytest.approx(1.5 * slow)
    held = one(spark, sizing.exit_cost(F.lit(1000.0), 16.0))
    assert held["funding"] == pytest.approx(0.2)


def guarded(spark, rows, **options):
    df = spark.createDataFrame([("a", t, float(e)) for t, e in rows], "account string, ts timestamp, equity double")
    made = drawdown.drawdown_guard(df, **options)
    return made.orderBy("ts").collect()


def test_drawdown_of_a_curve(spark):
    curve = [100e3, 105e3, 110e3, 108e3, 105e3, 103e3]
    rows = guarded(spark, [(T0 + timedelta(hours=i), e) for i, e in enumerate(curve)])
    assert rows[-1]["peak_equity"] == 110e3
    assert rows[-1]["current_drawdown"] == pytest.approx(7 / 110)
    assert rows[-1]["max_drawdown"] == pytest.approx(7 / 110)
    assert rows[-1]["position_scale"] == 0.75


def test_trigger_and_recovery(spark):
    rows = guarded(
        spark,
        [
            (T0, 100e3),
            (T0 + timedelta(seconds=1), 120e3),
            (T0 + timedelta(seconds=2), 106e3),
            (T0 + timedelta(days=5), 110e3),
            (T0 + timedelta(days=8), 115e3),
        ],
        block_rows=2,
        warm_up=1,
    )
    assert [r["is_triggered"] for r in rows] == [False, False, True, True, False]
    assert rows[2]["position_scale"] == 0.1
    assert [r["days_in_drawdown"] for r in rows] == [0, 0, 0, 4, 7]


def test_lookback_forgets_old_peaks(spark):
    now = T0 + timedelta(days=60)
    old = [(now - timedelta(days=40), 150e3)]
    rows = guarded(spark, old + [(now - timedelta(days=20 - i), 100e3 + 1e3 * i) for i in range(20)])
    assert rows[-1]["peak_equity"] == 119e3


def test_guard_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows, equity = [], 100e3
    for i in range(400):
        equity += rnd.uniform(-2500, 2500)
        rows.append((T0 + timedelta(hours=7 * i + rnd.randrange(7)), equity))
    made = guarded(spark, rows, block_rows=64, warm_up=4)
    active, since = False, None
    for i, (now, e) in enumerate(rows):
        window = [(t, x) for t, x in rows[: i + 1] if t >= now - timedelta(days=30)]
        peak, top, worst = max(x for _, x in window), 0, 0
        for _, x in window:
            top = max(top, x)
            worst = max(worst, (top - x) / top)
        fall = (peak - e) / peak
        if fall >= 0.10 and not active:
            active, since = True, now
        if active and now >= since + timedelta(days=7) and fall < 0.05:
            active = False
        near = [t for t, x in window if x >= peak * 0.99][-1]
        r = made[i]
        assert (r["peak_equity"], r["is_triggered"]) == (peak, active)
        assert r["max_drawdown"] == pytest.approx(worst)
        assert r["days_in_drawdown"] == (now - near).days


def test_position_pnl(spark):
    opens = spark.createDataFrame(
        [(1, 2.0, 50000.0, "long", T0), (2, 1.0, 50000.0, "short", T0), (3, 2.0, 50000.0, "long", T0)],
        "position_id long, size double, entry_price double, position_type string, entry_time timestamp",
    )
    later = T0 + timedelta(hours=8)
    closes = spark.createDataFrame(
        [(1, 1, 52000.0, None, later), (2, 1, 51000.0, None, later), (3, 1, 51000.0, 1.0, later),
         (3, 2, 51000.0, 0.0, later), (3, 3, 51000.0, 1.0, later), (9, 1, 1.0, None, later)],
        "position_id long, close_seq int, exit_price double, exit_size double, exit_time timestamp",
    )
    rows = {(r["position_id"], r["close_seq"]): r for r in positions.close_positions(opens, closes).collect()}
    assert rows[1, 1]["gross_pnl"] == pytest.approx(4000)
    assert rows[2, 1]["gross_pnl"] == pytest.approx(-1000)
    assert rows[3, 1]["gross_pnl"] == pytest.approx(1000) and rows[3, 1]["remaining_size"] == 1.0
    assert rows[3, 2]["gross_pnl"] == pytest.approx(1000) and rows[3, 2]["remaining_size"] == 0.0
    assert rows[3, 3]["gross_pnl"] == 0 and not rows[3, 3]["known"]
    assert rows[9, 1]["net_pnl"] == 0
    assert rows[1, 1]["net_pnl"] == pytest.approx(4000 - rows[1, 1]["costs"])


def test_account_state_follows_guard_and_positions(spark):
    at = lambda h: T0 + timedelta(hours=h)
    opens = spark.createDataFrame(
        [("a", 1, 2.0, 100.0, "long", at(1)), ("a", 2, 1.0, 50.0, "long", at(3)), ("b", 3, 1.0, 10.0, "long", at(1))],
        "account string, position_id long, size double, entry_price double, position_type string, entry_time timestamp",
    )
    closes = spark.createDataFrame(
        [(1, 1, 110.0, 1.0, at(4)), (1, 2, 120.0, None, at(6)), (2, 1, 40.0, None, at(30))],
        "position_id long, close_seq long, exit_price double, exit_size double, exit_time timestamp",
    )
    closed = positions.close_positions(opens.drop("account"), closes)
    net = {(r.position_id, r.close_seq): r.net_pnl for r in closed.collect()}
    guard = spark.createDataFrame([("a", at(2), 0.02, False), ("a", at(5), 0.2, True)], "account string, ts timestamp, current_drawdown double, is_triggered boolean")
    asked = [("a", at(h), h) for h in (0, 1, 2, 4, 5, 7, 31)] + [("b", at(5), 99)]
    signals = spark.createDataFrame(asked, "account string, ts timestamp, n long")
    got = {r.n: r for r in positions.account_state(signals, opens, closed, guard).collect()}
    assert {n: (r.open_positions, r.open_exposure) for n, r in got.items()} == {
        0: (0, 0.0), 1: (0, 0.0), 2: (1, 200.0), 4: (2, 150.0), 5: (2, 150.0), 7: (1, 50.0), 31: (0, 0.0), 99: (1, 10.0)
    }
    assert got[7].daily_pnl == pytest.approx(net[1, 1] + net[1, 2]) and got[31].daily_pnl == pytest.approx(net[2, 1])
    assert got[31].portfolio_value == pytest.approx(100000 + sum(net.values()))
    assert [got[n].drawdown_triggered for n in (2, 4, 5, 99)] == [False, False, True, False] and got[4].drawdown == 0.02


def test_moves_and_signals_of_a_moment_are_one_row(spark):
    at = lambda h: T0 + timedelta(hours=h)
    opens = spark.createDataFrame(
        [("a" if i % 2 else None, i, 4.0, 10.0 + i % 3, "long", at(i % 2)) for i in range(60)],
        "account string, position_id long, size double, entry_price double, position_type string, entry_time timestamp",
    )
    closes = spark.createDataFrame(
        [(i, k, 11.0, 1.0 if k == 1 else None, at(5 * k)) for i in range(60) for k in (1, 2)],
        "position_id long, close_seq int, exit_price double, exit_size double, exit_time timestamp",
    )
    closed = positions.close_positions(opens, closes, carry=["account"])
    moves = {(r.account, r.ts, r._kind): r for r in positions.account_moves(opens, closed).collect()}
    assert len(moves) == 2 * 3 and moves["a", at(1), 2]._count == 30 and moves["a", at(10), 0]._count == -30
    signals = spark.createDataFrame([(account, at(h), n) for n in range(3) for account in ("a", None) for h in (0, 1, 2, 7, 11)] + [("b", None, 9)], "account string, ts timestamp, n int")
    got = collections.Counter((r.account, r.ts, r.open_positions, r.open_exposure) for r in positions.account_state(signals, opens, closed).collect())
    whole = [sum(4 * (10 + i % 3) for i in range(60) if i % 2 == k) for k in (0, 1)]
    left = [sum(3 * (10 + i % 3) for i in range(60) if i % 2 == k) for k in (0, 1)]
    want = {("a", at(0), 0, 0.0): 3, ("a", at(1), 0, 0.0): 3, ("a", at(2), 30, whole[1]): 3, ("a", at(7), 30, left[1]): 3, ("a", at(11), 0, 0.0): 3, ("b", None, 0, 0.0): 1}
    want |= {(None, at(0), 0, 0.0): 3, (None, at(1), 30, whole[0]): 3, (None, at(2), 30, whole[0]): 3, (None, at(7), 30, left[0]): 3, (None, at(11), 0, 0.0): 3}
    assert got == want


def test_a_held_drawdown_over_many_blocks_needs_few_rounds(spark, caplog):
    rows = [("x", T0 + timedelta(hours=k), k, 100.0 if k < 40 else 80.0) for k in range(700)]
    df = spark.createDataFrame(rows, "account string, ts timestamp, step long, equity double")
    with caplog.at_level("INFO", "tickloom.operators.sequential"):
        made = drawdown.drawdown_guard(df, order=["ts", "step"], block_rows=10, warm_up=4).collect()
    rounds = [r for r in caplog.records if "round" in r.message]
    assert sum(r.is_triggered for r in made) == 660 and len(rounds) <= 4


def _shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def _many_closes(spark):
    opens = [(i, 8.0, 100.0 + i, "long" if i % 2 else "short", T0) for i in range(20)]
    closes = [(i if i % 5 else None, k, 101.0 + k, None if k == 3 else 1.5, T0 + timedelta(hours=30 * k)) for i in range(24) for k in range(5)]
    return (
        spark.createDataFrame(opens, "position_id long, size double, entry_price double, position_type string, entry_time timestamp"),
        spark.createDataFrame(closes, "position_id long, close_seq int, exit_price double, exit_size double, exit_time timestamp"),
    )


def test_closes_are_shuffled_once(spark):
    opens, closes = _many_closes(spark)
    assert _shuffles(positions.close_positions(opens, closes)) <= 2


def test_crowded_positions_close_the_same(spark):
    opens, closes = _many_closes(spark)
    closes = closes.where("position_id is not null")
    plain, crowded = (positions.close_positions(opens, closes, crowd=n).collect() for n in (1 << 20, -1))
    assert len(plain) == 95 and any(r.known for r in plain) and not all(r.known for r in plain)
    assert sorted(map(str, plain)) == sorted(map(str, crowded))


def test_close_of_no_position_stays(spark):
    opens, closes = _many_closes(spark)
    made = positions.close_positions(opens, closes).where("position_id is null").collect()
    assert len(made) == 25 and not any(r.known for r in made)


def test_running_pnl_over_minutes_and_missing_times(spark):
    rows = [(k, 1, T0 + timedelta(minutes=7 * k) if k % 9 else None, float(k)) for k in range(400)]
    closed = spark.createDataFrame(rows, "position_id long, close_seq int, exit_time timestamp, net_pnl double")
    made = positions.running_daily_pnl(closed, order=("close_seq", "position_id"))
    assert _shuffles(made) <= 4
    want, total, day = {}, 0.0, None
    for i, _, at, x in sorted(rows, key=lambda r: (r[2] is not None, r[2], r[0])):
        now = at.date() if at else "none"
        total, day = (total if now == day else 0.0) + x, now
        want[i] = total
    assert {r.position_id: r.daily_pnl for r in made.collect()} == want
