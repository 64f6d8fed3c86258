import random
from datetime import datetime, timedelta

import pytest

from tickloom.operators import bars, book
from tickloom.streaming import live as states
from tickloom.streaming import market as live

T0 = datetime(2024, 1, 1)
DELTAS = "symbol string, ts timestamp, update_id long, side string, price double, qty double"
TRADES = "symbol string, ts timestamp, trade_id long, price double, quantity double, is_buyer_maker boolean"


def run(stream, path, name):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    )
    query.awaitTermination(200)
    return query


def files(spark, rows, schema, path, parts):
    """The rows in several files, read one after the other."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_live_book_equals_batch_over_many_triggers(spark, tmp_path):
    """Deep books, removals that use up the best levels, quiet seconds, changes out of order."""
    r = random.Random(7)
    rows, now = [], 0.0
    for k in range(400):
        now += r.choice([0.05, 0.3, 0.3, 2.5])
        side = r.choice(["bid", "ask"])
        price = 100 + (1 if side == "ask" else -1) * r.randrange(1, 40)
        late = r.choice([0, 0, 0.6])
        rows.append(("A", T0 + timedelta(seconds=now - late), k, side, float(price), float(r.choice([0, 0, 1, 2, 5]))))
    last = max(x[1] for x in rows)
    rows.append(("Z", last + timedelta(seconds=100), 9999, "bid", 1.0, 1.0))
    stream = files(spark, rows, DELTAS, tmp_path / "in", 5)
    run(live.live_book(stream, "5 seconds", levels=4), tmp_path / "ck", "many_books")
    got = {(x.ts, x.side, x.level, x.price, x.qty) for x in spark.table("many_books").where("symbol = 'A'").collect()}
    deltas = spark.createDataFrame(rows, DELTAS).where("symbol = 'A'")
    batch = book.dense_book(book.reconstruct(deltas, 1, levels=4)).collect()
    want = {(x.ts, x.side, x.level, x.price, x.qty) for x in batch}
    end = max(x[0] for x in want)
    assert len(want) > 500 and {x for x in got if x[0] <= end} == want


class Spy:
    """A state that counts what is written."""

    def __init__(self):
        self.data, self.writes = {}, 0

    def exists(self):
        return bool(self.data)

    def get(self):
        return self.data["v"]

    def update(self, value):
        self.data["v"] = value

    def containsKey(self, key):
        return key in self.data

    def getValue(self, key):
        return self.data[key]

    def updateValue(self, key, value):
        self.data[key] = value
        self.writes += 1

    def removeKey(self, key):
        del self.data[key]
        self.writes += 1

    def iterator(self):
        return iter(list(self.data.items()))


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Spy())

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Spy())

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_one_changed_level_rewrites_one_entry():
    import pandas as pd

    class Watermark:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    machine, handle = states.LiveBook(5), Handle()
    machine.init(handle)

    def feed(rows, watermark):
        frame = pd.DataFrame(rows, columns=["ts", "update_id", "side", "price", "qty"])
        list(machine.handleInputRows(("A",), iter([frame.assign(ts=pd.to_datetime(frame["ts"], unit="s"))]), Watermark(0)))
        return pd.concat(machine.handleExpiredTimer(("A",), Watermark(watermark), None))

    deep = [(0.5, k, side, 100.0 + sign * (k + 1), 1.0) for side, sign in (("bid", -1), ("ask", 1)) for k in range(500)]
    listed = feed(deep, 1000)
    assert len(listed) == 10 and handle.states["open"].writes == 1000
    listed = feed([(1.5, 1000, "bid", 60.0, 9.0)], 2000)
    assert handle.states["open"].writes == 1001 and len(listed) == 10
    assert len(handle.states["best"].get()[0]) == 20 and not handle.states["waiting"].data
    # Removals that reach below the held levels bring the next ones up.
    listed = feed([(2.5, 2000 + k, "bid", 99.0 - k, 0.0) for k in range(30)], 3000)
    assert listed[listed.side == "bid"].price.tolist() == [69.0, 68.0, 67.0, 66.0, 65.0]


@pytest.mark.parametrize("parts", [1, 4])
def test_live_bars_equal_batch(spark, tmp_path, parts):
    r = random.Random(9)
    rows, now = [], 0
    for k in range(200):
        now += r.choice([1, 5, 30, 300])
        rows.append(("A" if k % 3 else "B", T0 + timedelta(seconds=now), k, float(r.randrange(90, 110)), float(r.choice([0, 1, 2])), r.random() < 0.5))
    rows.append(("Z", T0 + timedelta(seconds=now + 7200), 999, 1.0, 1.0, True))
    stream = files(spark, rows, TRADES, tmp_path / "in", parts)
    run(live.live_bars(stream, 60), tmp_path / "ck", f"live_bars_{parts}")
    columns = ["symbol", "ts", "open", "high", "low", "close", "volume", "trade_count", "buy_volume", "sell_volume", "buy_count", "sell_count", "vwap"]
    got = spark.table(f"live_bars_{parts}").select(columns).orderBy("symbol", "ts").collect()
    batch = bars.trade_bars(spark.createDataFrame(rows, TRADES).where("symbol <> 'Z'"), 60)
    want = batch.select(columns).orderBy("symbol", "ts").collect()
    assert [tuple(x)[:-1] for x in got] == [tuple(x)[:-1] for x in want]
    assert [x.vwap for x in got] == pytest.approx([x.vwap for x in want])
