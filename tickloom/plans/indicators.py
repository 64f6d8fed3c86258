"""Registered queries over hourly bars, one per indicator family."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import grid, sci
from tickloom.operators.features import FeatureSet
from tickloom.plans import views
from tickloom.plans.sql import bars, decay, fdiv, lag, over, roll, std
from tickloom.plans.sql import grid as sql_grid
from tickloom.plans.sql import sci as sql_sci

# query -> (outputs, digits); digits None compares in scientific notation.
FAMILIES: dict[str, tuple[list[str], int | None]] = {
    "sma": (["SMA_5", "SMA_10", "SMA_20", "SMA_50", "SMA_100", "SMA_200"], 6),
    "ema": (["EMA_5", "EMA_10", "EMA_20", "EMA_50", "EMA_100", "EMA_200"], 6),
    "wma": (["WMA_10", "WMA_20"], 6),
    "hma": (["HMA_9", "HMA_21"], 6),
    "tema_dema": (["TEMA_20", "DEMA_20"], 6),
    "kama": (["KAMA_10"], 6),
    "ichimoku": (["ICHIMOKU_TENKAN", "ICHIMOKU_KIJUN", "ICHIMOKU_SENKOU_A", "ICHIMOKU_SENKOU_B"], 6),
    "rsi": (["RSI_7", "RSI_14", "RSI_21"], 6),
    "stochastic": (["STOCH_K", "STOCH_D"], 6),
    "stochastic_rsi": (["STOCHRSI_K", "STOCHRSI_D"], 5),
    "macd": (["MACD", "MACD_SIGNAL", "MACD_HIST"], 6),
    "cci": (["CCI_14", "CCI_20"], 5),
    "williams_roc_momentum": (["WILLIAMS_R", "ROC_10", "ROC_20", "MOM_10", "MOM_20"], 5),
    "tsi": (["TSI"], 6),
    "ultimate_oscillator": (["UO"], 6),
    "awesome_oscillator": (["AO"], 6),
    "atr": (["ATR_14", "ATR_20", "NATR_14"], 5),
    "bollinger": (["BB_UPPER", "BB_MIDDLE", "BB_LOWER", "BB_WIDTH", "BB_PERCENT"], 6),
    "keltner": (["KC_UPPER", "KC_MIDDLE", "KC_LOWER"], 6),
    "donchian": (["DC_UPPER", "DC_LOWER"], 6),
    "ulcer_index": (["ULCER_INDEX"], 6),
    "mass_index": (["MASS_INDEX", "MI_9"], 6),
    "on_balance": (["OBV", "AD", "ADL"], 4),
    "money_flow": (["CMF_20", "MFI_14"], 6),
    "ease_of_movement": (["EMV_14"], None),
    "force_index": (["FI_13"], 4),
    "volume_index": (["NVI", "PVI"], None),
    "price_volume": (["VWAP", "VWMA_20"], 6),
    "price_volume_trend": (["VPT"], 3),
    "adx": (["ADX_14", "ADX_20", "DI_PLUS_14", "DI_MINUS_14"], 6),
    "aroon": (["AROON_UP_25", "AROON_DOWN_25", "AROON_OSC_25"], 6),
    "vortex": (["VI_PLUS_14", "VI_MINUS_14"], 6),
    "trix": (["TRIX_14"], 5),
    "parabolic_sar": (["PSAR", "PSAR_TREND"], 6),
    "supertrend": (["SUPERTREND_7_3", "SUPERTREND_10_3"], 6),
    "zigzag": (["ZIG_ZAG_5"], 6),
    "pivots": (["PIVOT_HIGH", "PIVOT_LOW"], 6),
    "dispersion": (["STDDEV_20", "VAR_20", "SEM_20"], 5),
    "shape": (["SKEW_20", "KURT_20"], 6),
    "correlation_beta": (["CORREL_20", "BETA_20"], 6),
    "linear_regression": (["LINEARREG_20", "LINEARREG_SLOPE_20", "LINEARREG_ANGLE_20", "TSF_20"], 6),
}


# Families of each kind (frames, exponential means, running totals, state
# machines) that are also computed over many short blocks, against the same SQL.
BLOCKED = (
    "sma", "ema", "tema_dema", "kama", "rsi", "macd", "adx", "bollinger", "on_balance", "volume_index",
    "price_volume", "parabolic_sar", "supertrend", "zigzag", "linear_regression",
)
SHORT_BLOCKS = {"block_rows": 128, "warm_up": 24}


def _query(digits_of: dict[str, int | None], **blocks: int) -> Callable[[SparkSession, str], DataFrame]:
    names = list(digits_of)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = FeatureSet().transform(
            views.bars(spark, sf_dir), names, every=views.HOUR, complete=True, keep=["symbol", "ts"], **blocks
        )
        shown = [
            (sci(F.col(n)) if digits is None else grid(F.col(n), digits)).alias(n) for n, digits in digits_of.items()
        ]
        return frame.select("symbol", F.unix_timestamp("ts").alias("t"), *shown)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = {f"indicator_{q}": _query(dict.fromkeys(names, digits)) for q, (names, digits) in FAMILIES.items()}
    every = {n: digits for names, digits in FAMILIES.values() for n in names}
    made["indicator_all"] = _query(every)
    for family in BLOCKED:
        names, digits = FAMILIES[family]
        made[f"indicator_{family}_blocks"] = _query(dict.fromkeys(names, digits), **SHORT_BLOCKS)
    return made


def _final(family: str, exprs: dict[str, str], source: str) -> str:
    names, digits = FAMILIES[family]
    shown = []
    for n in names:
        value = f"coalesce({exprs[n]}, 0.0)"
        shown.append(f"{sql_sci(value) if digits is None else sql_grid(value, digits)} AS \"{n}\"")
    return f"SELECT symbol, t, {', '.join(shown)} FROM {source}"


def _plain(family: str, exprs: dict[str, str], *steps: str, source: str = "p") -> str:
    return f"WITH {', '.join([bars(), *steps])} {_final(family, exprs, source)}"


def _recursive(family: str, exprs: dict[str, str], state: dict[str, tuple[str, str]], *after: str, pre=(), source="e", base="p") -> str:
    """state: column -> (value on row 0, value from the row before `e` and this row `x`)."""
    first = ", ".join(f"({init})::DOUBLE AS {c}" for c, (init, _) in state.items())
    then = ", ".join(f"({step})::DOUBLE" for _, step in state.values())
    walk = f"""e AS (
  SELECT x.*, {first} FROM {base} x WHERE rn = 0
  UNION ALL
  SELECT x.*, {then} FROM e JOIN {base} x ON x.symbol = e.symbol AND x.rn = e.rn + 1)"""
    return f"WITH RECURSIVE {', '.join([bars(), *pre, walk, *after])} {_final(family, exprs, source)}"


def _ema(col: str, x: str, span: int) -> tuple[str, str]:
    return x, decay(f"e.{col}", x, 2 / (span + 1))


def _chain(prefix: str, x: str, span: int, times: int) -> dict[str, tuple[str, str]]:
    state, value, init = {}, x, x
    for i in range(1, times + 1):
        col = f"{prefix}{i}"
        state[col] = (init, decay(f"e.{col}", value, 2 / (span + 1)))
        value = state[col][1]
    return state


def _weighted(x: str, n: int) -> str:
    terms = " + ".join(
        f"{n - i} * {x}" if i == 0 else f"{n - i} * {lag(x, i)}" for i in range(n)
    )
    return f"({terms}) / {n * (n + 1) // 2}.0"


def _rsi(n: int) -> str:
    up = roll("avg", "gain", n)
    down = roll("avg", "loss", n)
    return f"100 - 100 / (1 + {fdiv(up, down)})"


CLV = f"coalesce({fdiv('(close - low) - (high - close)', 'high - low')}, 0)"


def _middle(n: int) -> str:
    return f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2"


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["sma"] = _plain("sma", {f"SMA_{n}": roll("avg", "close", n) for n in (5, 10, 20, 50, 100, 200)})
    spans = (5, 10, 20, 50, 100, 200)
    sql["ema"] = _recursive("ema", {f"EMA_{n}": f"e{n}" for n in spans}, {f"e{n}": _ema(f"e{n}", "x.close", n) for n in spans})
    sql["wma"] = _plain("wma", {f"WMA_{n}": _weighted("close", n) for n in (10, 20)})
    hull = f"""h AS (SELECT *, 2 * ({_weighted("close", 4)}) - ({_weighted("close", 9)}) AS r9,
      2 * ({_weighted("close", 10)}) - ({_weighted("close", 21)}) AS r21 FROM p)"""
    sql["hma"] = _plain("hma", {"HMA_9": _weighted("r9", 3), "HMA_21": _weighted("r21", 4)}, hull, source="h")
    sql["tema_dema"] = _recursive(
        "tema_dema", {"TEMA_20": "3 * e1 - 3 * e2 + e3", "DEMA_20": "2 * e1 - e2"}, _chain("e", "x.close", 20, 3)
    )
    fast, slow = 2 / 3, 2 / 31
    speed = f"""s AS (SELECT *, {lag("close", 10)} AS far, {lag("close", 9)} AS near, abs(close - pc) AS step FROM p),
k AS MATERIALIZED (SELECT *, power(coalesce(abs(close - far) / nullif({roll("sum", "step", 10)}, 0), 0) * {fast - slow!r} + {slow!r}, 2) AS sc FROM s)"""
    sql["kama"] = _recursive(
        "kama",
        {"KAMA_10": "y"},
        {"y": ("NULL", "CASE WHEN x.rn < 9 THEN NULL WHEN x.rn = 9 THEN x.close ELSE e.y + x.sc * (x.close - e.y) END")},
        pre=[speed],
        base="k",
    )
    mids = f"m AS (SELECT *, {_middle(9)} AS m9, {_middle(26)} AS m26, {_middle(52)} AS m52 FROM p)"
    sql["ichimoku"] = _plain(
        "ichimoku",
        {
            "ICHIMOKU_TENKAN": "m9",
            "ICHIMOKU_KIJUN": "m26",
            "ICHIMOKU_SENKOU_A": lag("(m9 + m26) / 2", 26),
            "ICHIMOKU_SENKOU_B": lag("m52", 26),
        },
        mids,
        source="m",
    )
    moves = "g AS (SELECT *, coalesce(greatest(close - pc, 0), 0) AS gain, coalesce(greatest(pc - close, 0), 0) AS loss FROM p)"
    sql["rsi"] = _plain("rsi", {f"RSI_{n}": _rsi(n) for n in (7, 14, 21)}, moves, source="g")
    top, low = roll("max", "high", 14), roll("min", "low", 14)
    raw = f"k0 AS (SELECT *, 100 * ({fdiv(f'close - ({low})', f'({top}) - ({low})')}) AS k FROM p)"
    smooth = f"k1 AS (SELECT *, {roll('avg', 'k', 3)} AS kk FROM k0)"
    sql["stochastic"] = _plain("stochastic", {"STOCH_K": "kk", "STOCH_D": roll("avg", "kk", 3)}, raw, smooth, source="k1")
    r = f"r AS (SELECT *, {_rsi(14)} AS rsi FROM g)"
    rk = f"""k0 AS (SELECT *, 100 * ({fdiv(f"rsi - ({roll('min', 'rsi', 14)})", f"({roll('max', 'rsi', 14)}) - ({roll('min', 'rsi', 14)})")}) AS k FROM r)"""
    sql["stochastic_rsi"] = _plain(
        "stochastic_rsi", {"STOCHRSI_K": "kk", "STOCHRSI_D": roll("avg", "kk", 3)}, moves, r, rk, smooth, source="k1"
    )
    f12, f26 = _ema("a", "x.close", 12), _ema("b", "x.close", 26)
    line = f"({f12[1]}) - ({f26[1]})"
    sql["macd"] = _recursive(
        "macd",
        {"MACD": "a - b", "MACD_SIGNAL": "s", "MACD_HIST": "a - b - s"},
        {"a": f12, "b": f26, "s": ("0.0", decay("e.s", line, 0.2))},
    )
    cci = {}
    steps = []
    source = "p"
    for n in (14, 20):
        steps.append(f"c{n} AS (SELECT *, {roll('avg', 'tp', n)} AS m{n}, list(tp) {over(n)} AS l{n} FROM {source})")
        source = f"c{n}"
    for n in (14, 20):
        mad = f"list_sum(list_transform(l{n}, lambda v: abs(v - m{n}))) / {n}.0"
        varies = f"m{n} IS NOT NULL AND list_max(l{n}) > list_min(l{n})"
        cci[f"CCI_{n}"] = f"CASE WHEN {varies} THEN {fdiv(f'tp - m{n}', f'0.015::DOUBLE * ({mad})')} END"
    sql["cci"] = _plain("cci", cci, *steps, source=source)
    williams = {"WILLIAMS_R": f"-100 * ({fdiv(f'({top}) - close', f'({top}) - ({low})')})"}
    for n in (10, 20):
        williams[f"ROC_{n}"] = f"100 * (close - {lag('close', n)}) / {lag('close', n)}"
        williams[f"MOM_{n}"] = f"close - {lag('close', n)}"
    sql["williams_roc_momentum"] = _plain("williams_roc_momentum", williams)
    tsi_state = {}
    for c, x in (("m", "(x.close - x.pc)"), ("a", "abs(x.close - x.pc)")):
        outer = decay(f"e.{c}1", x, 2 / 26)
        tsi_state[f"{c}1"] = ("NULL", outer)
        tsi_state[f"{c}2"] = ("NULL", decay(f"e.{c}2", outer, 2 / 14))
    sql["tsi"] = _recursive("tsi", {"TSI": f"100 * ({fdiv('m2', 'a2')})"}, tsi_state)
    uo_base = "u AS (SELECT *, close - least(low, coalesce(pc, low)) AS bp FROM p)"
    share = {n: fdiv(roll("sum", "bp", n), roll("sum", "tr", n)) for n in (7, 14, 28)}
    sql["ultimate_oscillator"] = _plain(
        "ultimate_oscillator",
        {"UO": f"100 * ((4 * ({share[7]}) + 2 * ({share[14]}) + ({share[28]})) / 7)"},
        uo_base,
        source="u",
    )
    sql["awesome_oscillator"] = _plain("awesome_oscillator", {"AO": f"({roll('avg', 'mp', 5)}) - ({roll('avg', 'mp', 34)})"})
    sql["atr"] = _recursive(
        "atr",
        {"ATR_14": "a14", "ATR_20": "a20", "NATR_14": fdiv("100 * a14", "close")},
        {"a14": _ema("a14", "x.tr", 14), "a20": _ema("a20", "x.tr", 20)},
    )
    band = f"d AS (SELECT *, {roll('avg', 'close', 20)} AS m, {std('close', 20)} AS s FROM p)"
    sql["bollinger"] = _plain(
        "bollinger",
        {
            "BB_UPPER": "m + 2 * s",
            "BB_MIDDLE": "m",
            "BB_LOWER": "m - 2 * s",
            "BB_WIDTH": "(m + 2 * s) - (m - 2 * s)",
            "BB_PERCENT": "CASE WHEN s > 0 THEN ((close - m) / s + 2) / 4 END",
        },
        band,
        source="d",
    )
    sql["keltner"] = _recursive(
        "keltner",
        {"KC_UPPER": "m + 2 * a", "KC_MIDDLE": "m", "KC_LOWER": "m - 2 * a"},
        {"m": _ema("m", "x.close", 20), "a": _ema("a", "x.tr", 10)},
    )
    sql["donchian"] = _plain("donchian", {"DC_UPPER": roll("max", "high", 20), "DC_LOWER": roll("min", "low", 20)})
    ulcer = [
        f"u AS (SELECT *, {roll('max', 'close', 14)} AS hi FROM p)",
        "v AS (SELECT *, power(100 * (close - hi) / hi, 2) AS sq FROM u)",
    ]
    sql["ulcer_index"] = _plain("ulcer_index", {"ULCER_INDEX": f"sqrt({roll('avg', 'sq', 14)})"}, *ulcer, source="v")
    mass = [f"q AS (SELECT *, {fdiv('e1', 'e2')} AS ratio FROM e)", ]
    sql["mass_index"] = _recursive(
        "mass_index",
        {"MASS_INDEX": roll("sum", "ratio", 25), "MI_9": roll("sum", "ratio", 9)},
        _chain("e", "(x.high - x.low)", 9, 2),
        *mass,
        source="q",
    )
    total = "OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING)"
    sql["on_balance"] = _plain(
        "on_balance",
        {
            "OBV": f"sum(CASE WHEN pc IS NULL THEN volume ELSE volume * sign(close - pc) END) {total}",
            "AD": f"sum({CLV} * volume) {total}",
            "ADL": f"sum({CLV} * volume) {total}",
        },
    )
    flow = [
        f"f AS (SELECT *, {CLV} * volume AS mfv, {lag('tp')} AS ptp FROM p)",
        "f2 AS (SELECT *, CASE WHEN tp > ptp THEN tp * volume ELSE 0.0 END AS up, CASE WHEN tp < ptp THEN tp * volume ELSE 0.0 END AS dn FROM f)",
    ]
    down = roll("sum", "dn", 14)
    sql["money_flow"] = _plain(
        "money_flow",
        {
            "CMF_20": fdiv(roll("sum", "mfv", 20), roll("sum", "volume", 20)),
            "MFI_14": f"100 - 100 / (1 + ({roll('sum', 'up', 14)}) / CASE WHEN ({down}) = 0 THEN 0.0001::DOUBLE ELSE ({down}) END)",
        },
        *flow,
        source="f2",
    )
    emv = [
        f"m1 AS (SELECT *, mp - {lag('mp')} AS dm, CASE WHEN high - low = 0 THEN CASE WHEN volume > 0 THEN 'inf'::DOUBLE END ELSE volume * 1e-6 / (high - low) END AS box FROM p)",
        f"m2 AS (SELECT *, CASE WHEN isinf(box) THEN dm * 0.0 WHEN box = 0 THEN NULL ELSE dm / box END AS ease FROM m1)",
    ]
    sql["ease_of_movement"] = _plain("ease_of_movement", {"EMV_14": roll("avg", "ease", 14)}, *emv, source="m2")
    sql["force_index"] = _recursive(
        "force_index", {"FI_13": "y"}, {"y": ("NULL", decay("e.y", "((x.close - x.pc) * x.volume)", 2 / 14))}
    )
    sql["volume_index"] = _recursive(
        "volume_index",
        {"NVI": "n", "PVI": "q"},
        {
            "n": ("1000", "CASE WHEN x.volume < x.pv THEN e.n * (x.close / x.pc) ELSE e.n END"),
            "q": ("1000", "CASE WHEN x.volume > x.pv THEN e.q * (x.close / x.pc) ELSE e.q END"),
        },
    )
    sql["price_volume"] = _plain(
        "price_volume",
        {
            "VWAP": fdiv(f"sum(tp * volume) {total}", f"sum(volume) {total}"),
            "VWMA_20": fdiv(roll("sum", "cv", 20), roll("sum", "volume", 20)),
        },
        "v AS (SELECT *, close * volume AS cv FROM p)",
        source="v",
    )
    sql["price_volume_trend"] = _plain("price_volume_trend", {"VPT": f"sum(volume * (close / pc - 1)) {total}"})
    dm = """d AS MATERIALIZED (SELECT *,
      CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS up,
      CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS dn FROM p)"""
    adx_state: dict[str, tuple[str, str]] = {}
    for n in (14, 20):
        a = 2 / (n + 1)
        parts = {c: decay(f"e.{c}{n}", f"x.{x}", a) for c, x in (("u", "up"), ("d", "dn"), ("r", "tr"))}
        for c, x in (("u", "up"), ("d", "dn"), ("r", "tr")):
            adx_state[f"{c}{n}"] = (f"x.{x}", parts[c])
    walk_di = []
    for n in (14, 20):
        walk_di.append(
            f"100 * u{n} / nullif(r{n}, 0) AS p{n}, 100 * d{n} / nullif(r{n}, 0) AS m{n}"
        )
    di = f"di AS MATERIALIZED (SELECT *, {', '.join(walk_di)} FROM e)"
    dx = "dx AS MATERIALIZED (SELECT *, " + ", ".join(
        f"100 * abs(p{n} - m{n}) / CASE WHEN p{n} + m{n} = 0 THEN 1 ELSE p{n} + m{n} END AS x{n}" for n in (14, 20)
    ) + " FROM di)"
    second = f"""z AS (
  SELECT y.*, y.x14 AS a14, y.x20 AS a20 FROM dx y WHERE rn = 0
  UNION ALL
  SELECT y.*, {decay("z.a14", "y.x14", 2 / 15)}, {decay("z.a20", "y.x20", 2 / 21)}
  FROM z JOIN dx y ON y.symbol = z.symbol AND y.rn = z.rn + 1)"""
    sql["adx"] = _recursive(
        "adx",
        {"ADX_14": "a14", "ADX_20": "a20", "DI_PLUS_14": "p14", "DI_MINUS_14": "m14"},
        adx_state,
        di,
        dx,
        second,
        pre=[dm],
        source="z",
        base="d",
    )
    place = """CASE WHEN count(*) {w} = 25 THEN 4.0 * (25 - (rn - {pick})) END"""
    aroon_up = place.format(w=over(25), pick=f"-(max({{'v': high, 'r': -rn}}) {over(25)}).r")
    aroon_dn = place.format(w=over(25), pick=f"(min({{'v': low, 'r': rn}}) {over(25)}).r")
    sql["aroon"] = _plain(
        "aroon", {"AROON_UP_25": aroon_up, "AROON_DOWN_25": aroon_dn, "AROON_OSC_25": f"({aroon_up}) - ({aroon_dn})"}
    )
    vm = "v AS (SELECT *, abs(high - pl) AS vp, abs(low - ph) AS vn FROM p)"
    sql["vortex"] = _plain(
        "vortex",
        {
            "VI_PLUS_14": fdiv(roll("sum", "vp", 14), roll("sum", "tr", 14)),
            "VI_MINUS_14": fdiv(roll("sum", "vn", 14), roll("sum", "tr", 14)),
        },
        vm,
        source="v",
    )
    sql["trix"] = _recursive("trix", {"TRIX_14": f"10000 * (e3 / {lag('e3')} - 1)"}, _chain("e", "x.close", 14, 3))
    sql["parabolic_sar"] = _parabolic()
    sql["supertrend"] = _supertrend()
    sql["zigzag"] = _zigzag()
    left = "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
    right = "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
    whole = f"count(*) {left} = 5 AND count(*) {right} = 5"
    sql["pivots"] = _plain(
        "pivots",
        {
            "PIVOT_HIGH": f"CASE WHEN {whole} AND high > max(high) {left} AND high >= max(high) {right} THEN high ELSE 0.0 END",
            "PIVOT_LOW": f"CASE WHEN {whole} AND low < min(low) {left} AND low <= min(low) {right} THEN low ELSE 0.0 END",
        },
    )
    sql["dispersion"] = _plain(
        "dispersion",
        {
            "STDDEV_20": std("close", 20),
            "VAR_20": roll("var_samp", "close", 20),
            "SEM_20": f"({std('close', 20)}) / sqrt(20.0)",
        },
    )
    w = over(20)
    moments = f"""c AS (SELECT *, list(close) {w} AS xs, {roll('avg', 'close', 20)} AS m, max(close) {w} = min(close) {w} AS flat FROM p),
c2 AS (SELECT *, list_sum(list_transform(xs, lambda v: power(v - m, 2))) / 20 AS m2, list_sum(list_transform(xs, lambda v: power(v - m, 3))) / 20 AS m3,
  list_sum(list_transform(xs, lambda v: power(v - m, 4))) / 20 AS m4 FROM c)"""
    g1 = f"m3 / power(m2, 1.5) * {math.sqrt(20 * 19) / 18!r}"
    g2 = f"{19 / (18 * 17)!r} * (21 * (m4 / (m2 * m2) - 3) + 6)"
    sql["shape"] = _plain(
        "shape",
        {
            "SKEW_20": f"CASE WHEN m IS NULL THEN NULL WHEN flat THEN 0.0 ELSE {g1} END",
            "KURT_20": f"CASE WHEN m IS NULL THEN NULL WHEN flat THEN -3.0 ELSE {g2} END",
        },
        moments,
        source="c2",
    )
    ret = "r AS (SELECT *, close / pc - 1 AS ret FROM p)"
    corr_flat = f"max(close) {w} = min(close) {w} OR max(volume) {w} = min(volume) {w}"
    beta_flat = f"max(ret) {w} = min(ret) {w}"
    sql["correlation_beta"] = _plain(
        "correlation_beta",
        {
            "CORREL_20": f"CASE WHEN count(close) {w} < 20 OR {corr_flat} THEN NULL ELSE covar_samp(close, volume) {w} / (stddev_samp(close) {w} * stddev_samp(volume) {w}) END",
            "BETA_20": f"CASE WHEN count(ret) {w} < 20 OR {beta_flat} THEN NULL ELSE covar_samp(ret, ret) {w} / var_samp(ret) {w} END",
        },
        ret,
        source="r",
    )
    line_base = f"""l AS (SELECT *, {roll('avg', 'close', 20)} AS m, {roll('sum', 'close', 20)} AS s1,
  CASE WHEN count(close) {w} = 20 THEN list(close) {w} END AS xs FROM p),
l2 AS (SELECT *, list_sum(list_transform(xs, lambda v, i: (i - 10.5) * (v - m))) / 665.0 AS s FROM l)"""
    sql["linear_regression"] = _plain(
        "linear_regression",
        {
            "LINEARREG_20": "m + s * 9.5",
            "LINEARREG_SLOPE_20": "s",
            "LINEARREG_ANGLE_20": "degrees(atan(s))",
            "TSF_20": "m + s * 10.5",
        },
        line_base,
        source="l2",
    )
    parts = [f"({text}) AS q{i}" for i, text in enumerate(sql.values())]
    joined = parts[0] + "".join(f" JOIN {part} USING (symbol, t)" for part in parts[1:])
    sql["all"] = f"SELECT * FROM {joined}"
    return {f"indicator_{k}": v for k, v in sql.items()}



def _parabolic() -> str:
    base = f"b2 AS MATERIALIZED (SELECT *, {lag('high', 2)} AS ph2, {lag('low', 2)} AS pl2 FROM p)"
    moved = "(e.sar + e.af * (e.ep - e.sar))"
    flip = f"(CASE WHEN e.bull = 1 THEN x.low < {moved} ELSE x.high > {moved} END)"
    wider = "(CASE WHEN e.bull = 1 THEN x.high > e.ep ELSE x.low < e.ep END)"
    far = "(CASE WHEN e.bull = 1 THEN x.high ELSE x.low END)"
    clamp = f"CASE WHEN x.rn < 2 THEN {moved} WHEN e.bull = 1 THEN least({moved}, x.pl, x.pl2) ELSE greatest({moved}, x.ph, x.ph2) END"
    state = {
        "bull": ("1", f"CASE WHEN {flip} THEN 1 - e.bull ELSE e.bull END"),
        "sar": ("x.low", f"CASE WHEN {flip} THEN e.ep ELSE {clamp} END"),
        "ep": (
            "x.high",
            f"CASE WHEN {flip} THEN CASE WHEN e.bull = 1 THEN x.low ELSE x.high END WHEN {wider} THEN {far} ELSE e.ep END",
        ),
        "af": (
            "0.02",
            f"CASE WHEN {flip} THEN 0.02::DOUBLE WHEN {wider} THEN least(e.af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE e.af END",
        ),
    }
    trend = "CASE WHEN close > sar THEN 1.0 ELSE -1.0 END"
    return _recursive("parabolic_sar", {"PSAR": "sar", "PSAR_TREND": trend}, state, pre=[base], base="b2")


def _supertrend() -> str:
    """The ATR walk first, then one walk per window."""
    atr_state = {f"a{n}": _ema(f"a{n}", "x.tr", n) for n in (7, 10)}
    first = ", ".join(f"({i})::DOUBLE AS {c}" for c, (i, _) in atr_state.items())
    then = ", ".join(f"({s})::DOUBLE" for _, s in atr_state.values())
    walks = [
        f"""a AS (SELECT x.*, {first} FROM p x WHERE rn = 0 UNION ALL
  SELECT x.*, {then} FROM a e JOIN p x ON x.symbol = e.symbol AND x.rn = e.rn + 1)""",
        "bands AS MATERIALIZED (SELECT *, "
        + ", ".join(f"mp + 3 * a{n} AS u{n}, mp - 3 * a{n} AS l{n}" for n in (7, 10))
        + " FROM a)",
    ]
    state: dict[str, tuple[str, str]] = {}
    for n in (7, 10):
        top = f"(CASE WHEN x.u{n} < e.t{n} OR x.pc > e.t{n} THEN x.u{n} ELSE e.t{n} END)"
        low = f"(CASE WHEN x.l{n} > e.b{n} OR x.pc < e.b{n} THEN x.l{n} ELSE e.b{n} END)"
        state[f"t{n}"] = (f"x.u{n}", top)
        state[f"b{n}"] = (f"x.l{n}", low)
        state[f"s{n}"] = (
            f"CASE WHEN x.close <= x.u{n} THEN x.u{n} ELSE x.l{n} END",
            f"CASE WHEN e.s{n} = e.t{n} THEN CASE WHEN x.close <= {top} THEN {top} ELSE {low} END "
            f"ELSE CASE WHEN x.close >= {low} THEN {low} ELSE {top} END END",
        )
    exprs = {"SUPERTREND_7_3": "s7", "SUPERTREND_10_3": "s10"}
    return _recursive("supertrend", exprs, state, pre=walks, base="bands")


def _zigzag() -> str:
    extend = "((e.trend = 1 AND x.high > e.pivot) OR (e.trend = -1 AND x.low < e.pivot))"
    rise = "(e.trend <= 0 AND x.high >= e.pivot * (1 + 0.05::DOUBLE))"
    fall = "(e.trend >= 0 AND x.low <= e.pivot * (1 - 0.05::DOUBLE))"
    price = f"CASE WHEN {extend} THEN CASE WHEN e.trend = 1 THEN x.high ELSE x.low END WHEN {rise} THEN x.high WHEN {fall} THEN x.low END"
    state = {
        "kind": ("1", f"CASE WHEN {extend} THEN 2 WHEN {rise} OR {fall} THEN 1 END"),
        "price": ("x.high", price),
        "trend": ("0", f"CASE WHEN {extend} THEN e.trend WHEN {rise} THEN 1 WHEN {fall} THEN -1 ELSE e.trend END"),
        "pivot": ("x.high", f"coalesce({price}, e.pivot)"),
    }
    events = "ev AS (SELECT symbol, rn, price, lead(kind) OVER (PARTITION BY symbol ORDER BY rn) AS following FROM e WHERE kind IS NOT NULL)"
    pivots = """z AS (SELECT e.symbol, e.t, e.rn, last_value(ev.price IGNORE NULLS) OVER (PARTITION BY e.symbol ORDER BY e.rn) AS zz
  FROM e LEFT JOIN ev ON ev.symbol = e.symbol AND ev.rn = e.rn AND coalesce(ev.following, 1) <> 2)"""
    return _recursive("zigzag", {"ZIG_ZAG_5": "zz"}, state, events, pivots, source="z")
