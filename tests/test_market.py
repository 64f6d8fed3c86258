import json
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars, book, quality
from tickloom.operators.blocks import SLOT, Series
from tickloom.operators.graph import Graph
from tickloom.plans import market
from tickloom.sources import raw, sinks
from tickloom.sources.daily import process_days
from tickloom.streaming import market as live

T0 = datetime(2024, 1, 1)
TRADES = "symbol string, ts timestamp, trade_id long, price double, quantity double, is_buyer_maker boolean"


def trades(spark, rows):
    return spark.createDataFrame([("A", T0 + timedelta(seconds=s), i, float(p), float(q), m) for i, (s, p, q, m) in enumerate(rows)], TRADES)


ROWS = [(0, 100, 1, False), (30, 102, 2, True), (59, 101, 1, False), (600, 105, 3, True), (1205, 104, 1, True)]


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_bars_are_dense(spark, block_rows):
    made = bars.trade_bars(trades(spark, ROWS), 60, block_rows=block_rows).orderBy("ts").collect()
    assert len(made) == 21
    first = made[0]
    assert (first["open"], first["high"], first["low"], first["close"]) == (100, 102, 100, 101)
    assert (first["volume"], first["buy_volume"], first["sell_count"]) == (4, 2, 1)
    assert first["vwap"] == pytest.approx((100 + 204 + 101) / 4)
    assert made[5]["close"] == 101 and made[5]["volume"] == 0 and made[5]["vwap"] == first["vwap"]
    assert made[10]["open"] == 105 and made[20]["close"] == 104


@pytest.mark.parametrize("block_rows", [4096, 4])
def test_side_edges(spark, block_rows):
    made = bars.trade_bars(trades(spark, ROWS), 60, edge_mode="carry", block_rows=block_rows)
    made = made.orderBy("ts").collect()
    # The last buy is in the first bar, so its values repeat to the end.
    assert {r["buy_volume"] for r in made} == {2}
    assert [made[i]["sell_volume"] for i in (0, 5, 10, 15, 20)] == [2, 0, 3, 0, 1]


LEVELS = [[str(30000 - i), str(1.0 + i)] for i in range(5)], [[str(30002 + i), str(1.5 + i)] for i in range(5)]


def line(**change):
    row = {"timestamp": 1704067200123, "event_time": 1704067200000, "symbol": "A", "bids": LEVELS[0], "asks": LEVELS[1]}
    return json.dumps({**row, **change})


def test_book_lines(spark, tmp_path):
    lines = [line(), "not json", json.dumps({"invalid": True}), line(bids=[]), line(event_time=None),
             line(bids=[["x", "1"]]), line(timestamp=1704067201123)]
    (tmp_path / "book.jsonl").write_text("\n".join(lines))
    parsed = raw.read_lines(spark, str(tmp_path), raw.BOOK_SCHEMA)
    rows = raw.book_rows(parsed).orderBy("ts").collect()
    assert len(rows) == 2
    r = rows[0]
    assert (r["mid_price"], r["spread"], r["bid_volume_5"], r["ask_volume_5"]) == (30001, 2, 15, 17.5)
    assert r["order_imbalance"] == pytest.approx(-2.5 / 32.5)
    assert r["ts"] == datetime(2024, 1, 1, 0, 0, 0, 123000)


def test_trade_lines(spark, tmp_path):
    base = {"timestamp": 1704067200000, "event_time": 1, "trade_id": 1, "symbol": "A", "price": "30000", "quantity": "1", "is_buyer_maker": True}
    bad = [{**base, "price": "not_a_number"}, {k: v for k, v in base.items() if k != "trade_id"}]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(r) for r in [*bad, base]))
    rows = raw.trade_rows(raw.read_lines(spark, str(tmp_path), raw.TRADE_SCHEMA)).collect()
    assert [(r["price"], r["quantity"]) for r in rows] == [(30000.0, 1.0)]


def day_files(root, days):
    """Raw files of these days of January 2024: two book lines and three trades, a bad one with them."""
    for day in days:
        folder = root / f"2024/01/{day:02d}"
        folder.mkdir(parents=True)
        start = int(datetime(2024, 1, day, tzinfo=timezone.utc).timestamp() * 1000)
        (folder / f"a_orderbook_202401{day:02d}_000000.jsonl").write_text(line().replace("1704067200123", str(start + 5)))
        trades = [
            {"timestamp": start + 1000 * k, "event_time": 1, "trade_id": k, "symbol": "A", "price": str(100 + k), "quantity": "1", "is_buyer_maker": True}
            for k in range(3)
        ]
        (folder / f"a_trades_202401{day:02d}_000000.jsonl").write_text("\n".join(map(json.dumps, [*trades, {"price": "x"}])))


def test_only_folders_of_the_range_are_read(spark, tmp_path):
    day_files(tmp_path, (1, 2, 3, 5))
    df = raw.read_raw(spark, str(tmp_path), "orderbook", "2024-01-02", "2024-01-04", raw.BOOK_SCHEMA)
    assert df.count() == 2
    assert sorted(f.split("2024/01/")[1] for f in df.inputFiles()) == ["02/a_orderbook_20240102_000000.jsonl", "03/a_orderbook_20240103_000000.jsonl"]
    assert raw.read_raw(spark, str(tmp_path), "orderbook", "2025-01-02", "2025-01-04", raw.BOOK_SCHEMA).count() == 0


def test_daily_job(spark, tmp_path):
    day_files(tmp_path / "raw", (1, 2, 4))
    (tmp_path / "raw/2024/01/04/a_trades_20240104_000000.jsonl").write_text("not json")
    out = str(tmp_path / "out")
    report = {r.date: (r.rows, r.status) for r in process_days(spark, str(tmp_path / "raw"), out, "2024-01-01", "2024-01-04").collect()}
    assert report == {"2024-01-01": (1, "done"), "2024-01-02": (1, "done"), "2024-01-03": (0, "missing"), "2024-01-04": (0, "missing")}
    counts = process_days(spark, str(tmp_path / "raw"), str(tmp_path / "again"), "2024-01-01", "2024-01-04").orderBy("date").collect()
    assert [(r.trade_lines, r.trades, r.book_lines, r.snapshots) for r in counts] == [(4, 3, 1, 1), (4, 3, 1, 1), (0, 0, 0, 0), (1, 0, 1, 1)]
    rows = spark.read.parquet(out).orderBy("date").collect()
    assert [(r.open, r.close, r.volume, r.best_bid) for r in rows] == [(100.0, 102.0, 3.0, 30000.0)] * 2


def test_a_broken_file_fails_only_its_day(spark, tmp_path):
    day_files(tmp_path / "raw", (1, 2, 3))
    (tmp_path / "raw/2024/01/02/b_trades_20240102_010000.jsonl.gz").write_bytes(b"no gzip at all")
    out = str(tmp_path / "out")
    report = process_days(spark, str(tmp_path / "raw"), out, "2024-01-01", "2024-01-03").orderBy("date").collect()
    assert [r.status for r in report] == ["done", "failed", "done"] and report[1].error
    assert [str(r.date) for r in spark.read.parquet(out).select("date").distinct().orderBy("date").collect()] == ["2024-01-01", "2024-01-03"]


DELTAS = "symbol string, ts timestamp, update_id long, side string, price double, qty double"


def deltas(spark):
    rows = [(0.2, "bid", 10, 1), (0.4, "bid", 9, 2), (0.6, "ask", 11, 1), (1.5, "bid", 10, 0), (2.5, "ask", 12, 3), (2.6, "ask", 11, 5), (4.0, "bid", 8, 1)]
    return spark.createDataFrame([("A", T0 + timedelta(seconds=s), i, side, float(p), float(q)) for i, (s, side, p, q) in enumerate(rows)], DELTAS)


BOOKS = {
    1: {"bid": [(10, 1), (9, 2)], "ask": [(11, 1)]},
    2: {"bid": [(9, 2)], "ask": [(11, 1)]},
    3: {"bid": [(9, 2)], "ask": [(11, 5), (12, 3)]},
    4: {"bid": [(9, 2), (8, 1)], "ask": [(11, 5), (12, 3)]},
}


def books(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["side"], r["level"])):
        at = int((r["ts"] - T0).total_seconds())
        out.setdefault(at, {"bid": [], "ask": []})[r["side"]].append((r["price"], r["qty"]))
    return out


def test_reconstruction(spark):
    for block_rows in (1, 2, 100):
        listed = book.reconstruct(deltas(spark), 1, block_rows=block_rows)
        assert books(listed.collect()) == BOOKS
        assert books(book.dense_book(listed).collect()) == BOOKS


def test_one_sided_points_are_left_out(spark):
    rows = [(0.5, "bid", 10, 1), (1.5, "ask", 11, 1), (3.5, "ask", 11, 0), (6.5, "ask", 12, 2)]
    made = spark.createDataFrame([("A", T0 + timedelta(seconds=s), i, side, float(p), float(q)) for i, (s, side, p, q) in enumerate(rows)], DELTAS)
    for block_rows in (1, 100):
        listed = book.reconstruct(made, 1, block_rows=block_rows)
        assert books(listed.collect()) == {2: {"bid": [(10, 1)], "ask": [(11, 1)]}, 7: {"bid": [(10, 1)], "ask": [(12, 2)]}}
        assert sorted(books(book.dense_book(listed).collect())) == [2, 3, 7]


def test_short_runs_of_the_book(spark):
    rows = [("A", T0 + timedelta(seconds=(i * 7) % 60 + 0.5), i, ("bid", "ask")[i % 2], float((i * 13) % 40 + 100 * (i % 2)), float(i % 5)) for i in range(400)]
    made = spark.createDataFrame(rows, DELTAS)
    want = sorted(book.reconstruct(made, 10, levels=3).collect())
    assert len(want) == 6 * 2 * 3
    for run_rows in (1, 150):
        assert sorted(book.reconstruct(made, 10, levels=3, block_rows=1, run_rows=run_rows).collect()) == want


def test_a_book_that_only_grows_is_not_copied_along(spark, monkeypatch):
    rows = [("A", T0 + timedelta(seconds=i), i, side, sign * (1000.0 + i), 1.0) for i in range(512) for side, sign in (("bid", -1), ("ask", 1))]
    sizes = []
    kept = book.materialize
    monkeypatch.setattr(book, "materialize", lambda df: [made := kept(df), sizes.append(made.count())][0])
    listed = book.reconstruct(spark.createDataFrame(rows, DELTAS), 1, levels=2, block_rows=8)
    assert listed.count() == 2 * (1 + 2 * 511) and sum(sizes) < 16


def test_forward_return_shuffles_rows_once(spark):
    # Hours with many rows and hours with none, prices that are missing, a row without a time.
    rows = [(f"s{i % 2}", T0 + timedelta(minutes=17 * i + 300 * (i // 50)), i, None if i % 7 == 3 else 100.0 + i * 13 % 29) for i in range(200)]
    rows.append(("s0", None, 999, 50.0))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, update_id long, mid_price double")
    made = quality.forward_return(df, order=("ts", "update_id"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4
    got = {r.update_id: r.target for r in made.collect()}
    want = {}
    for s in ("s0", "s1"):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1], r[2]))
        for k, r in enumerate(own):
            later = next((x[3] for x in own[k + 1 :] if x[3] is not None), None)
            want[r[2]] = 0.0 if later is None or r[3] is None else later / r[3] - 1
    assert got == pytest.approx(want)


def test_changes_no_listing_shows_are_not_kept(spark, monkeypatch):
    rows = []
    for i in range(16000):
        # A large odd number deals prices; a fifth of the changes remove a level.
        deep, side = i * 7919 % 2003 + 1, ("bid", "ask")[i % 2]
        rows.append(("A", T0 + timedelta(seconds=i // 40), i, side, 5000.0 - deep if side == "bid" else 5000.0 + deep, float(i * 31 % 5)))
    made = spark.createDataFrame(rows, DELTAS)
    want = sorted(book.reconstruct(made, 1, levels=2).collect())
    sizes = []
    kept = book.materialize
    monkeypatch.setattr(book, "materialize", lambda df: [done := kept(df), sizes.append(done.count())][0])
    assert sorted(book.reconstruct(made, 1, levels=2, block_rows=2000, run_rows=2000).collect()) == want
    assert len(want) == 400 * 4 and sum(sizes) < 8000


def test_a_book_that_loses_its_best_levels_is_walked_deeper(spark):
    best, deep = [*range(1, 301)], [*range(1001, 1101)]
    changes = [(d, 1.0) for d in deep] + [(d, 2.0) for d in best] + [(d, 0.0) for d in best] + [(deep[0], 3.0)]
    rows = [
        ("A", T0 + timedelta(seconds=i), i, side, 5000.0 + sign * d, q) for i, (d, q) in enumerate(changes) for side, sign in (("bid", -1), ("ask", 1))
    ]
    made = spark.createDataFrame(rows, DELTAS)
    want = sorted(book.reconstruct(made, 1, levels=3).collect())
    assert sorted(book.reconstruct(made, 1, levels=3, block_rows=200, run_rows=200).collect()) == want
    assert [(r.price, r.qty) for r in want if r.ts == T0 + timedelta(seconds=700) and r.side == "bid"] == [(3999.0, 3.0), (3998.0, 1.0), (3997.0, 1.0)]


def test_merged_changes_equal_single_ones():
    one, many = book.Ladder([1.0, 2.0, 4.0], [1.0, 1.0, 1.0]), book.Ladder([1.0, 2.0, 4.0], [1.0, 1.0, 1.0])
    changes = [(3.0, 2.0), (1.0, 0.0), (4.0, 5.0), (0.5, 0.0), (6.0, 1.0)]
    for rank, qty in changes:
        one.change(rank, qty)
    many.merge(*map(np.array, zip(*changes, strict=True)))
    assert (many.ranks, many.qty) == (one.ranks, one.qty) == ([2.0, 3.0, 4.0, 6.0], [1.0, 2.0, 5.0, 1.0])


def test_live_book_equals_batch(spark, tmp_path):
    df = deltas(spark)
    end = spark.createDataFrame([("B", T0 + timedelta(seconds=60), 99, "bid", 1.0, 1.0)], DELTAS)
    df.unionByName(end).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DELTAS).parquet(str(tmp_path / "in"))
    query = (
        live.live_book(stream, "1 second").writeStream.format("memory").queryName("live_book").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    rows = spark.sql("select * from live_book where symbol = 'A'").collect()
    got = books(rows)
    assert {k: got[k] for k in BOOKS} == BOOKS


def test_stream_bars_equal_batch(spark, tmp_path):
    df = trades(spark, [*ROWS, (100000, 1, 1, True)])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TRADES).parquet(str(tmp_path / "in"))
    query = (
        live.trade_bars(stream).writeStream.format("memory").queryName("bars_out").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    columns = ["ts", "open", "high", "low", "close", "volume", "buy_volume", "sell_count", "vwap"]
    got = spark.table("bars_out").select(columns).orderBy("ts").collect()
    batch = bars.trade_bars(trades(spark, ROWS), 60).filter("trade_count > 0").select(columns).orderBy("ts").collect()
    assert got == batch


def test_stream_ingest_rotates_by_hour(spark, tmp_path):
    base = {"event_time": 1, "trade_id": 1, "symbol": "A", "price": "1", "quantity": "1", "is_buyer_maker": True}
    (tmp_path / "in").mkdir()
    stamps = [1704067200000, 1704070800000]
    (tmp_path / "in/a.json").write_text("\n".join([*(json.dumps({**base, "timestamp": t}) for t in stamps), "bad"]))
    query = live.write_hourly(live.read_trades(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), every=None)
    query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).select("date", "hour").collect()
    assert sorted(r["hour"] for r in rows) == [0, 1]


def test_sinks(spark, tmp_path):
    made = bars.trade_bars(trades(spark, ROWS), 60)
    sinks.write_daily(made, str(tmp_path / "d"))
    sinks.write_daily(made.withColumn("ts", F.col("ts") + F.expr("interval 1 day")), str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d"))
    assert back.groupBy("date").count().count() == 2
    sinks.write_trades_csv(made, str(tmp_path / "c"))
    sinks.write_metrics_json(made.agg(F.max("high").alias("high")), str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 21
    assert spark.read.json(str(tmp_path / "j")).first()["high"] == 105


def test_quality_flags(spark):
    rows = spark.createDataFrame(
        [("A", T0, 1.0, 0.1), ("A", T0 + timedelta(hours=2), 2.0, 11.0), ("B", T0, -1.0, 0.1)],
        "symbol string, ts timestamp, mid_price double, spread_pct double",
    )
    report = {r["symbol"]: r for r in quality.quality_report(rows, min_rows=1).collect()}
    assert report["A"]["verdict"] == "warn" and report["A"]["max_gap_seconds"] == 7200
    assert not report["A"]["spread_ok"] and report["B"]["verdict"] == "fail"


def _streamed(spark, tmp_path, name, frames, schema, make):
    """Rows of a stream over these frames, one file after the other."""
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"part={k}"))
    sources = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    query = (
        make(sources.parquet(str(tmp_path / name))).writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return spark.sql(f"select * from {name}")


def test_stream_keeps_the_last_per_time(spark, tmp_path):
    schema = "symbol string, ts timestamp, update_id long, mid_price double"
    rows = [("A", T0 + timedelta(seconds=s), i, float(p)) for s, i, p in [(1, 5, 10), (1, 7, 11), (1, 6, 12), (2, 8, 13), (2, 8, 13)]]
    frames = [spark.createDataFrame(rows[:2], schema), spark.createDataFrame(rows[2:], schema)]
    frames.append(spark.createDataFrame([("B", T0 + timedelta(hours=1), 1, 1.0)], schema))
    got = _streamed(spark, tmp_path, "last_rows", frames, schema, lambda df: live.last_per_time(df, "update_id"))
    want = book.keep_last(spark.createDataFrame(rows, schema), ["symbol", "ts"], ["update_id"])
    assert sorted(map(tuple, got.where("symbol = 'A'").collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_stream_flow_equals_batch(spark, tmp_path):
    snaps = "symbol string, ts timestamp, update_id long, mid_price double"
    rows = [("A", T0 + timedelta(milliseconds=m), i, 100.0 + i) for i, m in enumerate([0, 400, 1000, 1400, 2600, 9000])]
    early = spark.createDataFrame(rows, snaps)
    end = spark.createDataFrame([("Z", T0 + timedelta(hours=1), 99, 1.0)], snaps)
    traded = trades(spark, [(0.0, 10, 1, True), (0.4, 11, 2, False), (0.4005, 12, 1, True), (1.4, 13, 3, False), (2.5, 14, 1, True)])
    late = spark.createDataFrame([("Z", T0 + timedelta(hours=1), 9, 1.0, 1.0, True)], TRADES)
    for k, frame in enumerate((traded, late)):
        frame.coalesce(1).write.parquet(str(tmp_path / "trades" / f"part={k}"))
    stream = spark.readStream.schema(TRADES).option("recursiveFileLookup", True).parquet(str(tmp_path / "trades"))
    got = _streamed(spark, tmp_path, "flow_rows", [early, end], snaps, lambda df: live.snapshot_flow(df, stream))
    want = book.trailing_flow(early, traded)
    assert sorted(map(tuple, got.where("symbol = 'A'").collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


@pytest.mark.parametrize("window_ms", [0, 250, 1000, 3_600_000])
def test_flow_of_windows_of_any_length(spark, window_ms):
    at = lambda ms: T0 + timedelta(milliseconds=ms)
    times = [(k * k * 137) % 900_000 for k in range(60)] + [250, 500, 500, 1000, 299_999, 300_000, 300_250]
    traded = [("A", at(t), i, 100.0 + i, i % 7 + 0.5, i % 3 == 0) for i, t in enumerate(times)]
    asked = [("A", at(t), i, 50.0) for i, t in enumerate([*times, 0, 750, 301_000, 3_700_000])] + [("A", None, 999, 50.0)]
    snaps = spark.createDataFrame(asked, "symbol string, ts timestamp, update_id long, mid_price double")
    made = book.trailing_flow(snaps, spark.createDataFrame([*traded, ("A", None, 99, 1.0, 1.0, True)], TRADES), window_ms)
    # A frame that slides is added up anew for every row.
    assert "RangeFrame, -" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.update_id: r for r in made.collect()}
    assert len(got) == len(asked)
    for _, t, i, mid in asked:
        seen = [r for r in traded if t is not None and timedelta(0) <= t - r[1] <= timedelta(milliseconds=window_ms)]
        buy, sell = (sum(r[4] for r in seen if r[5] == maker) for maker in (False, True))
        price = sum(r[3] * r[4] for r in seen) / (buy + sell) if seen else mid
        assert (got[i].buy_volume_1s, got[i].sell_volume_1s, got[i].vwap_1s) == pytest.approx((buy, sell, price))


def test_a_line_is_parsed_once(spark):
    for schema, rows in ((raw.BOOK_SCHEMA, raw.book_rows), (raw.TRADE_SCHEMA, raw.trade_rows)):
        lines = spark.createDataFrame([(line(),), ("not json",), (None,)], "value string").repartition(2)
        made = rows(raw.parse_lines(lines, schema))
        assert made._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1
        assert made.count() == (1 if schema is raw.BOOK_SCHEMA else 0)


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """400 events of one type, four a second, one of them without a value."""
    rows = [(i, T0 + timedelta(milliseconds=250 * i), 1, "A", None if i == 350 else 100.0 + i % 7, "") for i in range(400)]
    folder = tmp_path_factory.mktemp("events")
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_complete_rows_shuffle_what_they_read(spark, events):
    made = market.complete_rows(spark, events)
    plan = made._jdf.queryExecution().optimizedPlan()
    # Rows are counted for their numbers before the trade flow, which then runs once.
    assert sum("_late" in node.simpleString(100) for node in nodes(plan) if node.nodeName() == "Generate") == 1
    assert max(node.output().size() for node in nodes(plan) if node.nodeName() == "Window") < 70
    assert {r["update_id"] for r in made.collect()} == set(range(299, 400)) - {350}


def test_folded_columns_drop_the_same_rows(spark):
    rows = [(1, 1.0, "a", 2.0), (2, None, "a", 2.0), (3, 1.0, None, 2.0), (4, float("nan"), "a", 2.0), (5, 1.0, "a", None), (None, 1.0, "a", 2.0)]
    df = spark.createDataFrame(rows, "i long, x double, s string, y double")
    folded = quality.fold_incomplete(df, ["x", "s"], "_whole")
    assert folded.columns == ["i", "y", "_whole"]
    assert [r["i"] for r in quality.drop_incomplete(folded).collect()] == [r["i"] for r in quality.drop_incomplete(df).collect()] == [1]


def test_long_variances_are_merged(spark):
    rng = np.random.default_rng(5)
    x = np.r_[1e4 + rng.normal(0, 1, 900).cumsum(), np.full(400, 0.1)]
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(x)], f"symbol string, {SLOT} long, x double")
    g = Graph(Series(rows=512), ["x"], complete=True)
    made = g.evaluate(df, {f"v{n}": g.var(g.source("x"), n) for n in (30, 60, 300)}, ["symbol", SLOT])
    assert "RowFrame, -299, currentrow" not in made._jdf.queryExecution().executedPlan().toString()
    got = made.toPandas().sort_values(SLOT, ignore_index=True)
    for n in (30, 60, 300):
        wanted = [np.nan if i < n - 1 else x[i - n + 1 : i + 1].var(ddof=1) for i in range(len(x))]
        np.testing.assert_allclose(got[f"v{n}"].astype(float), wanted, rtol=1e-9, atol=1e-12)
        assert (got[f"v{n}"][900 + n :] == 0).all()


def test_methods_stay_below_what_the_jvm_compiles(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
