import numpy as np
import pandas as pd
import pytest

from tickloom.operators.features import FeatureSet
from tickloom.operators.registry import Registry, Spec, registry

HOUR = 3600


def series(symbol, n, seed, start=0):
    rng = np.random.default_rng(seed)
    close = 100 + rng.normal(0, 1, n).cumsum()
    opening = np.r_[close[0], close[:-1]]
    high = np.maximum(opening, close) + rng.random(n)
    low = np.minimum(opening, close) - rng.random(n)
    flat = rng.random(n) < 0.1
    high[flat] = low[flat] = opening[flat] = close[flat]
    return pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(start, start + n), unit="h"),
            "open": opening,
            "high": high,
            "low": low,
            "close": close,
            "volume": np.where(rng.random(n) < 0.1, 0.0, rng.random(n) * 10),
        }
    )


@pytest.fixture(scope="module")
def frame():
    return pd.concat([series("A", 700, 1, 37), series("B", 30, 2), series("C", 8, 3)], ignore_index=True)


@pytest.fixture(scope="module")
def bars(spark, frame):
    return spark.createDataFrame(frame).cache()


def run(bars, names, **options):
    options = {"every": HOUR, "complete": True, **options}
    made = FeatureSet().transform(bars, names, **options).toPandas()
    return made.sort_values(["symbol", "ts"], ignore_index=True)


def by_symbol(frame, f):
    parts = [f(part.reset_index(drop=True)) for _, part in frame.sort_values(["symbol", "ts"]).groupby("symbol")]
    return pd.concat(parts, ignore_index=True)


# pandas updates the higher moments of a moving window in place and loses digits.
LOOSE = {"SKEW_20": 1e-7, "KURT_20": 1e-7}


def check(made, column, wanted, fill=0.0):
    wanted = wanted.fillna(fill) if fill is not None else wanted
    near = LOOSE.get(column, 1e-9)
    np.testing.assert_allclose(made[column].astype(float), wanted, rtol=near, atol=near, err_msg=column)


def true_range(p):
    before = p.close.shift()
    return pd.concat([p.high - p.low, (p.high - before).abs(), (p.low - before).abs()], axis=1).max(axis=1)


def ewm(x, span):
    return x.ewm(span=span, adjust=False).mean()


CASES = {
    "SMA_20": lambda p: p.close.rolling(20).mean(),
    "SMA_200": lambda p: p.close.rolling(200).mean(),
    "EMA_5": lambda p: ewm(p.close, 5),
    "EMA_200": lambda p: ewm(p.close, 200),
    "WMA_10": lambda p: p.close.rolling(10).apply(lambda x: np.average(x, weights=np.arange(1, 11))),
    "TEMA_20": lambda p: 3 * ewm(p.close, 20) - 3 * ewm(ewm(p.close, 20), 20) + ewm(ewm(ewm(p.close, 20), 20), 20),
    "MACD": lambda p: ewm(p.close, 12) - ewm(p.close, 26),
    "ATR_14": lambda p: ewm(true_range(p), 14),
    "MASS_INDEX": lambda p: (ewm(p.high - p.low, 9) / ewm(ewm(p.high - p.low, 9), 9)).rolling(25).sum(),
    "FI_13": lambda p: ewm(p.close.diff() * p.volume, 13),
    "STDDEV_20": lambda p: p.close.rolling(20).std(),
    "SKEW_20": lambda p: p.close.rolling(20).skew(),
    "KURT_20": lambda p: p.close.rolling(20).kurt(),
    "CORREL_20": lambda p: p.close.rolling(20).corr(p.volume),
    "ICHIMOKU_SENKOU_B": lambda p: ((p.high.rolling(52).max() + p.low.rolling(52).min()) / 2).shift(26),
    "LINEARREG_SLOPE_20": lambda p: p.close.rolling(20).apply(lambda x: np.polyfit(np.arange(20), x, 1)[0]),
    "VPT": lambda p: (p.volume * p.close.pct_change()).cumsum(),
    "ROC_10": lambda p: p.close.pct_change(10) * 100,
}


@pytest.mark.parametrize("block_rows", [65536, 512])
def test_against_pandas(bars, frame, block_rows):
    made = run(bars, list(CASES), block_rows=block_rows)
    for name, formula in CASES.items():
        check(made, name, by_symbol(frame, formula))


def test_smoothing_over_gaps(spark, frame):
    gappy = frame.copy()
    gappy.loc[(gappy.index % 7 == 3) | (gappy.index < 3), "close"] = np.nan
    df = spark.createDataFrame(gappy).replace(float("nan"), None)
    made = run(df, ["EMA_5", "EMA_50", "SMA_5"], complete=False, fill="none", block_rows=512)
    check(made, "EMA_5", by_symbol(gappy, lambda p: ewm(p.close, 5)), fill=None)
    check(made, "EMA_50", by_symbol(gappy, lambda p: ewm(p.close, 50)), fill=None)
    check(made, "SMA_5", by_symbol(gappy, lambda p: p.close.rolling(5).mean()), fill=None)


def test_quotients_in_a_long_flat_market(spark):
    n = 1500
    close = np.r_[100 + np.random.default_rng(5).normal(0, 1, 200).cumsum(), np.full(n - 200, 101.0)]
    p = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "close": close})
    p["open"] = p["high"] = p["low"] = p["close"]
    p["volume"] = 1.0
    made = run(spark.createDataFrame(p), ["TSI", "DI_PLUS_14"], block_rows=512)
    move = p.close.diff()
    tsi = 100 * ewm(ewm(move, 25), 13) / ewm(ewm(move.abs(), 25), 13)
    np.testing.assert_allclose(made["TSI"], tsi.fillna(0), rtol=1e-6)
    plus = p.high.diff().where((p.high.diff() > -p.low.diff()) & (p.high.diff() > 0), 0)
    di = (100 * ewm(plus, 14) / ewm(true_range(p), 14)).fillna(0)
    np.testing.assert_allclose(made["DI_PLUS_14"], di, rtol=1e-6)


ORDERED = ["PSAR", "PSAR_TREND", "SUPERTREND_7_3", "ZIG_ZAG_5"]


def test_ordered_passes_do_not_depend_on_blocks(bars):
    whole = run(bars, ORDERED)
    # A warm-up of one row guesses wrongly, so states must be corrected.
    cut = run(bars, ORDERED, block_rows=64, warm_up=1)
    for name in ORDERED:
        check(cut, name, whole[name])


def test_totals_do_not_depend_on_blocks(bars, frame):
    names = ["OBV", "AD", "NVI", "VWAP"]
    whole, cut = run(bars, names), run(bars, names, block_rows=50)
    for name in names:
        check(cut, name, whole[name])

    def vwap(p):
        tp = (p.high + p.low + p.close) / 3
        return (tp * p.volume).cumsum() / p.volume.cumsum()

    check(whole, "VWAP", by_symbol(frame, vwap))


def test_one_symbol_alone(bars, frame):
    names = ["EMA_20", "RSI_14", "OBV", "PIVOT_HIGH"]
    among = run(bars, names)
    alone = run(bars.filter("symbol = 'B'"), names)
    among = among[among.symbol == "B"].reset_index(drop=True)
    for name in names:
        check(alone, name, among[name])


def test_rows_without_a_grid(bars):
    names = ["SMA_5", "EMA_10"]
    on_grid = run(bars, names)
    numbered = run(bars, names, every=None)
    for name in names:
        check(numbered, name, on_grid[name])


def test_fill_policies(bars, frame):
    sma = lambda p: p.close.rolling(5).mean()
    for policy in ("ffill", "bfill", "none"):
        made = run(bars, ["SMA_5"], fill=policy, block_rows=50)
        fills = {"ffill": lambda p: sma(p).ffill(), "bfill": lambda p: sma(p).bfill(), "none": sma}
        check(made, "SMA_5", by_symbol(frame, fills[policy]), fill=None)


def test_standard_set_and_selection(bars, caplog):
    features = FeatureSet()
    assert len(features.names) == 99 and features.skipped == []
    assert len(registry.names()) == 78
    made = features.transform(bars, ["SMA_5", "NO_SUCH"], every=HOUR, complete=True)
    assert made.columns == [*bars.columns, "SMA_5"]
    assert "NO_SUCH" in caplog.text


def test_missing_columns_give_missing_outputs(bars):
    made = run(bars.drop("volume"), ["SMA_5", "CMF_20", "PSAR"])
    assert made["CMF_20"].isna().all() and made["PSAR"].isna().all()
    assert made["SMA_5"].abs().sum() > 0


def test_custom_indicator_and_bad_configuration(bars, frame):
    own = Registry()
    own.register("Doubled", lambda g, window=1: g.row("doubled", [g.source("close")], lambda c: c * 2))
    specs = [Spec("TWICE", "Doubled"), Spec("BAD", "Doubled", {"nope": 1}), Spec("WHAT", "Unknown")]
    features = FeatureSet(specs, own)
    assert features.skipped == ["BAD", "WHAT"]
    made = features.transform(bars, every=HOUR, complete=True).toPandas().sort_values(["symbol", "ts"])
    np.testing.assert_allclose(made["TWICE"], made["close"] * 2)


def test_config_file(tmp_path, spark):
    path = tmp_path / "indicators.yaml"
    path.write_text(
        "trend:\n  - {name: FAST, class: SMA, params: {window: 3}}\n  - {name: FAST, class: SMA, params: {window: 4}}\n"
    )
    features = FeatureSet(str(path))
    assert features.names == ["FAST"]
    row = features.describe(spark).first()
    assert (row["class"], row["window"]) == ("SMA", 4)


def test_a_row_goes_to_few_blocks_however_far_back_it_is_seen(spark, monkeypatch):
    from tickloom.operators import graph
    from tickloom.operators.blocks import Series

    asked = []
    spread = graph.with_halo
    monkeypatch.setattr(graph, "with_halo", lambda df, series, back, ahead: asked.append((series.rows, back)) or spread(df, series, back, ahead))
    g = graph.Graph(Series(("symbol",), 16), ["price"])
    df = spark.createDataFrame([("A", k, float(k % 11)) for k in range(600)], "symbol string, _slot long, price double")
    made = g.evaluate(df, {"m": g.mean(g.source("price"), 200)}, ["_slot"]).orderBy("_slot").collect()
    assert [rows >= back > 16 for rows, back in asked] == [True]
    assert made[599]["m"] == pytest.approx(sum(k % 11 for k in range(400, 600)) / 200)
