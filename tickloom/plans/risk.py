"""Registered queries on risk, cost, positions and equity curves."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import grid, sci
from tickloom.operators import drawdown, equity, positions, sizing
from tickloom.operators.blocks import SLOT, Series
from tickloom.operators.graph import Graph
from tickloom.plans import views
from tickloom.plans.sql import lag, over
from tickloom.plans.sql import grid as sql_grid
from tickloom.plans.sql import sci as sql_sci
from tickloom.session import materialize

LIMIT = 0.03
DESK_VALUE = 400000.0


def _grids(columns, digits: int = 6):
    return [grid(F.col(c), digits).alias(c.split(".")[-1]) for c in columns]


# -- sizing and costs --------------------------------------------------------


def position_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.signals(spark, sf_dir)
    value, price, trust = F.col("portfolio_value"), F.col("price"), F.col("confidence")
    made = s.select(
        "position_id",
        "price",
        sizing.kelly_size(value, price, trust, F.col("win_rate"), F.col("avg_win"), F.col("avg_loss")).alias("kelly"),
        sizing.fixed_fractional_size(value, price, trust, F.col("stop_loss")).alias("fixed"),
    )
    return made.select("position_id", *_grids(["price", "kelly", "fixed"]))


def volatility_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from the last 30 step returns of each equity curve."""
    steps = equity.equity_steps(views.equity(spark, sf_dir)).withColumn(SLOT, F.col("step"))
    g = Graph(Series(("run_id",)), ["step_return"])
    ret = g.source("step_return")
    outputs = {
        "seen": g.rolling("seen", ret, 30, F.count, need=0),
        "spread": g.rolling("pstd", ret, 30, F.stddev_pop),
    }
    made = g.evaluate(steps, outputs, ["run_id", "step", "equity", "price"])
    vol = sizing.realized_volatility(F.col("seen"), F.col("spread"))
    size = sizing.volatility_parity_size(F.col("equity"), F.col("price"), F.lit(0.8), vol)
    return made.withColumns({"volatility": vol, "size": size}).select("run_id", "step", *_grids(["volatility", "size"]))


def trading_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, level, maker, urge = F.col("notional"), F.col("vip_level"), F.col("maker"), F.col("urgency")
    made = views.signals(spark, sf_dir).select(
        "position_id",
        "notional",
        sizing.vip_fee(sizing.TAKER_FEE, level).alias("fee"),
        sizing.entry_cost(n, maker, urge, level).alias("entry"),
        sizing.exit_cost(n, F.col("holding_hours"), maker, urge, level).alias("exit"),
        sizing.round_trip_cost(n, F.col("holding_hours"), maker, False, urge, 0.5, level).alias("trip"),
        positions.max_loss(n).alias("max_loss"),
    )
    return made.select(
        "position_id",
        grid(F.col("fee"), 9).alias("fee"),
        *(grid(F.col(f"entry.{c}"), 5).alias(f"entry_{c}") for c in ("commission", "slippage", "total")),
        *(grid(F.col(f"exit.{c}"), 5).alias(f"exit_{c}") for c in ("commission", "slippage", "funding", "total")),
        *_grids([f"trip.{c}" for c in TRIP], 5),
        *_grids(["max_loss"], 5),
    )


TRIP = ["total_commission", "total_slippage", "total_funding", "total_cost", "cost_percentage"]
ANNUAL = [
    "annual_commission",
    "annual_slippage",
    "annual_funding",
    "total_annual_costs",
    "cost_per_trade",
    "daily_costs",
]


def annual_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = views.signals(spark, sf_dir).groupBy("vip_level").agg(
        F.avg("notional").alias("position"), F.avg("holding_hours").alias("hours")
    )
    made = by.withColumn("c", sizing.annual_cost(F.col("position"), 5, F.col("hours"), 0.3, F.col("vip_level")))
    return made.select("vip_level", *_grids([f"c.{c}" for c in ANNUAL], 3))


# -- drawdown ----------------------------------------------------------------


def drawdown_guard(spark: SparkSession, sf_dir: str, **blocks: int) -> DataFrame:
    made = drawdown.drawdown_guard(
        views.equity(spark, sf_dir), keys=["run_id"], order=["ts", "step"], limit=LIMIT, **blocks
    )
    return made.select(
        "run_id",
        "step",
        "is_triggered",
        "days_in_drawdown",
        *_grids(["equity", "peak_equity", "current_drawdown", "max_drawdown", "position_scale"]),
    )


# -- positions ---------------------------------------------------------------


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read for the opens and, twice, for their closes.
    opens = materialize(views.positions(spark, sf_dir).drop("account", "l_extendedprice"))
    return positions.close_positions(opens, views.closes(opens))


def position_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _closed(spark, sf_dir)
    return made.select(
        "position_id",
        F.col("close_seq").cast("long").alias("close_seq"),
        "known",
        *_grids(["gross_pnl", "costs", "net_pnl", "return_pct", "remaining_size"], 5),
    )


def daily_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = positions.daily_pnl(_closed(spark, sf_dir))
    return made.select(F.date_format("date", "yyyy-MM-dd").alias("day"), "closes", *_grids(["daily_pnl"], 3))


def running_daily_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = positions.running_daily_pnl(_closed(spark, sf_dir), order=("close_seq", "position_id"))
    return made.select(
        "position_id", F.col("close_seq").cast("long").alias("close_seq"), *_grids(["daily_pnl"], 3)
    )


def _moves(opens: DataFrame) -> DataFrame:
    """What opens and their closes change in the accounts."""
    return materialize(positions.account_moves(opens, positions.close_positions(opens, views.closes(opens), carry=["account"])))


def _desk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Opens, moves and drawdown status of the accounts of the desks."""
    opens = materialize(views.desk_positions(spark, sf_dir).drop("l_extendedprice"))
    moves = _moves(opens)
    updates = positions.portfolio_updates(moves, start_value=DESK_VALUE)
    return opens, moves, materialize(drawdown.drawdown_guard(updates))


def trade_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position screened in the state its account was in before it was opened."""
    opens, moves, guard = _desk(spark, sf_dir)
    state = positions.state_at(views.desk_signals(opens), moves, guard, start_value=DESK_VALUE)
    made = positions.screen_trades(
        state,
        win_rate=F.col("win_rate"),
        avg_win=F.col("avg_win"),
        avg_loss=F.col("avg_loss"),
        limit_order=F.col("maker"),
        urgency=F.col("urgency"),
    )
    return made.select(
        "position_id",
        "approved",
        "reason",
        grid(F.col("entry_costs.total"), 4).alias("entry_total"),
        *_grids(["position_size", "risk_multiplier", "adjusted_confidence"], 5),
        *_grids(["notional_value", "max_loss"], 2),
    )


def account_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the account just before each position was opened."""
    opens = materialize(views.positions(spark, sf_dir).drop("l_extendedprice"))
    signals = opens.select("account", "position_id", F.col("entry_time").alias("ts"))
    made = positions.state_at(signals, _moves(opens))
    return made.select("account", "position_id", "open_positions", *_grids(["open_exposure", "daily_pnl", "portfolio_value"], 2))


STATUS = ["equity", "peak_equity", "current_drawdown", "max_drawdown", "position_scale"]


def portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account after every update of its value."""
    _, moves, guard = _desk(spark, sf_dir)
    state = positions.state_at(guard.select("account", "ts"), moves, guard, start_value=DESK_VALUE)
    made = positions.portfolio_metrics(state)
    return made.select(
        "account",
        F.unix_seconds("ts").alias("at"),
        "open_positions",
        "can_trade",
        "reason",
        F.col("drawdown_status.is_triggered").alias("is_triggered"),
        F.col("drawdown_status.days_in_drawdown").alias("days_in_drawdown"),
        *_grids([f"drawdown_status.{c}" for c in STATUS], 4),
        *_grids(["open_exposure", "portfolio_value", "daily_pnl"], 2),
        *_grids(["exposure_pct", "daily_return"], 4),
    )


def risk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account at the end of every month in which its value changed."""
    _, moves, guard = _desk(spark, sf_dir)
    month_end = F.add_months(F.trunc("ts", "month"), 1).cast("timestamp").alias("ts")
    state = positions.state_at(guard.select("account", month_end).distinct(), moves, guard, start_value=DESK_VALUE)
    made = positions.risk_report(state)
    return made.select(
        "account",
        F.date_format("ts", "yyyy-MM-dd").alias("as_of"),
        "open_positions",
        "drawdown_triggered",
        F.col("max_positions").cast("long").alias("max_positions"),
        *_grids(["daily_pnl", "portfolio_value"], 2),
        *_grids(["max_drawdown", "max_daily_loss"]),
        *_grids([f"cost_estimates.{c}" for c in ANNUAL], 2),
    )


# -- equity curves -----------------------------------------------------------


def equity_steps(spark: SparkSession, sf_dir: str, **blocks: int) -> DataFrame:
    made = equity.equity_steps(views.equity(spark, sf_dir), **blocks)
    return made.select("run_id", "step", *_grids(["equity", "step_return", "peak_equity", "drawdown"]))


SCORE = ["sharpe_ratio", "drawdown", "volatility_penalty", "holding_penalty", "trade_cost_penalty", "score"]


def risk_balanced_score(spark: SparkSession, sf_dir: str, **blocks: int) -> DataFrame:
    made = equity.risk_balanced_score(views.equity(spark, sf_dir), **blocks)
    return made.select("run_id", "step", *_grids(SCORE))


METRICS = ["total_return", "max_drawdown", "sharpe_ratio", "win_rate", "profit_factor"]


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equity.run_metrics(views.equity(spark, sf_dir)).select("run_id", *_grids(METRICS))


def detected_trades(spark: SparkSession, sf_dir: str, **blocks: int) -> DataFrame:
    made = equity.detect_trades(views.equity(spark, sf_dir), **blocks)
    return made.select("run_id", "step", *_grids(["position_change", "trade_return"]))


BACKTEST = [
    "total_return",
    "max_drawdown",
    "win_rate",
    "avg_win",
    "avg_loss",
    "profit_factor",
    "final_equity",
    "best_equity",
    "worst_equity",
]
BACKTEST_WIDE = ["annualized_return", "sharpe_ratio", "sortino_ratio"]


def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = equity.backtest_metrics(views.equity(spark, sf_dir))
    return made.select("run_id", "n_trades", *_grids(BACKTEST), *(sci(F.col(c), 5).alias(c) for c in BACKTEST_WIDE))


SUMMARY = ["avg_trade_value", "total_fees", "final_equity", "total_return_pct"]


def _trade_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = equity.detect_trades(views.equity(spark, sf_dir))
    return made.withColumns(
        {"value": -F.col("position_change") * F.col("price"), "cost": F.col("trade_cost") * F.col("price")}
    )


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = equity.run_summary(_trade_log(spark, sf_dir), views.equity(spark, sf_dir))
    return made.select("run_id", "n_trades", *_grids(SUMMARY, 4))


def expanding_normalization(spark: SparkSession, sf_dir: str, **blocks: int) -> DataFrame:
    made = equity.expanding_normalize(views.equity(spark, sf_dir), ["equity", "price"], **blocks)
    return made.select("run_id", "step", *_grids(["equity_norm", "price_norm"], 5))


def across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = equity.across_runs(equity.run_metrics(views.equity(spark, sf_dir)), METRICS)
    return made.select("metric", "runs", *_grids(["mean", "std", "min", "max"]))


def action_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = equity.action_histogram(_trade_log(spark, sf_dir))
    return made.select(F.col("bin").cast("long").alias("bin"), "count", *_grids(["left"]))


def queries() -> dict:
    risk = [
        position_sizing,
        volatility_parity,
        trading_costs,
        annual_costs,
        drawdown_guard,
        position_pnl,
        daily_pnl,
        running_daily_pnl,
        trade_screening,
        account_state,
        portfolio_metrics,
        risk_report,
    ]
    curves = [
        equity_steps,
        risk_balanced_score,
        run_metrics,
        detected_trades,
        backtest_metrics,
        run_summary,
        expanding_normalization,
        across_runs,
        action_histogram,
    ]
    made = {f"risk_{f.__name__}": f for f in risk}
    made.update({f"equity_{f.__name__}": f for f in curves})
    short = {
        "equity_equity_steps": equity_steps,
        "equity_risk_balanced_score": risk_balanced_score,
        "equity_detected_trades": detected_trades,
        "equity_expanding_normalization": expanding_normalization,
    }
    made.update({f"{name}_blocks": partial(f, block_rows=128) for name, f in short.items()})
    made["risk_drawdown_guard_blocks"] = partial(drawdown_guard, block_rows=128, warm_up=16)
    return made


# -- comparison SQL ----------------------------------------------------------

SIGNALS = """sg AS (
  SELECT l_orderkey * 10 + l_linenumber AS position_id, 100000.0::DOUBLE AS portfolio_value, l_extendedprice / l_quantity AS price,
    (l_orderkey % 100)::DOUBLE / 100.0::DOUBLE AS confidence, (l_partkey % 30)::DOUBLE / 200.0::DOUBLE AS drawdown,
    l_suppkey % 17 = 0 AS drawdown_triggered, (l_partkey % 101 - 50) * 150.0::DOUBLE AS daily_pnl, l_linenumber % 4 AS open_positions,
    0.4::DOUBLE + (l_partkey % 5) * 0.1::DOUBLE AS win_rate, 0.02::DOUBLE + (l_suppkey % 5) * 0.02::DOUBLE AS avg_win,
    (l_partkey % 4) * 0.01::DOUBLE AS avg_loss, (l_suppkey % 4) * 0.01::DOUBLE AS stop_loss, l_partkey % 11 - 1 AS vip_level,
    l_suppkey % 2 = 0 AS maker, (l_partkey % 11)::DOUBLE / 10.0::DOUBLE AS urgency,
    l_quantity * l_extendedprice / 2.0::DOUBLE AS notional, (l_suppkey % 100)::DOUBLE / 2.0::DOUBLE AS holding_hours
  FROM lineitem)"""

EQUITY = f"""e0 AS (
  SELECT o_custkey % 10 AS run_id, o_orderdate AS ts, o_orderkey AS order_id, o_totalprice AS price,
    (((o_orderkey // 3) * 13) % 5 - 2)::DOUBLE / 2.0::DOUBLE AS position, ((o_orderkey * 7) % 201 - 100)::DOUBLE / 100.0::DOUBLE AS action,
    ((o_orderkey * 11) % 50)::DOUBLE / 10000.0::DOUBLE AS trade_cost, (o_orderkey * 3) % 180 AS holding_period,
    row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderdate, o_orderkey) - 1 AS step,
    (100000 + sum((o_orderkey * 37) % 2001 - 1000) OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))::DOUBLE AS equity
  FROM orders),
eq AS MATERIALIZED (SELECT *, {lag("equity", 1, "run_id", "step")} AS pe,
  max(equity) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS top FROM e0),
er AS (SELECT *, (equity - pe) / pe AS ret, (top - equity) / top AS fall FROM eq)"""

POSITIONS = """po AS MATERIALIZED (
  SELECT * FROM (SELECT l_orderkey * 10 + l_linenumber AS position_id, l_returnflag AS account, l_quantity AS size,
    l_extendedprice / l_quantity AS entry_price, CASE WHEN l_returnflag = 'R' THEN 'short' ELSE 'long' END AS position_type,
    l_shipdate AS entry_time, l_partkey, l_suppkey,
    row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1)"""

CLOSES = """cl AS (
  SELECT CASE WHEN l_partkey % 50 = 0 THEN -position_id ELSE position_id END AS position_id, seq AS close_seq,
    entry_price * (1.0::DOUBLE + (l_partkey % 21 - 10)::DOUBLE / 100.0::DOUBLE) AS exit_price,
    CASE WHEN seq = 1 THEN floor(size / 2) WHEN seq = 2 AND l_suppkey % 3 > 0 THEN size / 4 END AS exit_size,
    epoch_us(entry_time) // 1000000 + seq * (l_partkey % 72 + 1) * 3600 AS exit_s
  FROM po, (VALUES (1), (2), (3)) AS v(seq))"""


def _vip(base: str, level: str) -> str:
    return f"CASE WHEN {level} BETWEEN 0 AND 9 THEN {base}::DOUBLE * (1 - {level} * 0.05::DOUBLE) ELSE {base}::DOUBLE END"


def _commission(n: str, maker: str, level: str) -> str:
    return f"({n} * (CASE WHEN {maker} THEN {_vip('0.0002', level)} ELSE {_vip('0.0005', level)} END))"


def _slip(n: str, urgency: str) -> str:
    impact = f"(CASE WHEN {n} > 1000000 THEN 2.0 WHEN {n} > 500000 THEN 1.5 WHEN {n} > 100000 THEN 1.2 ELSE 1.0 END)::DOUBLE"
    return f"({n} * 5.0::DOUBLE * (1 + 0.5::DOUBLE * {urgency}) * {impact} / 10000)"


def _trip(n: str, hours: str, maker: str = "false", urgency: str = "0.5::DOUBLE", level: str = "0") -> dict[str, str]:
    c = f"({_commission(n, maker, level)} + {_commission(n, 'false', level)})"
    s = f"({_slip(n, urgency)} + {_slip(n, '0.5::DOUBLE')})"
    f = f"({n} * 0.0001::DOUBLE * {hours} / 8)"
    t = f"({c} + {s} + {f})"
    return dict(zip(TRIP, (c, s, f, t, f"({t} / {n} * 100)"), strict=True))


def _max_loss(n: str) -> str:
    return f"{n} * 0.02::DOUBLE + {_trip(n, '24')['total_cost']}"


def _scale(dd: str, triggered: str, limit: str) -> str:
    return f"CASE WHEN {triggered} THEN 0.1 WHEN {dd} < {limit}::DOUBLE * 0.5 THEN 1.0 WHEN {dd} < {limit}::DOUBLE * 0.75 THEN 0.75 WHEN {dd} < {limit}::DOUBLE * 0.9 THEN 0.5 ELSE 0.25 END::DOUBLE"


def _kelly(confidence: str) -> str:
    stake = "((win_rate * (avg_win / avg_loss) - (1 - win_rate)) / (avg_win / avg_loss))"
    edge = "win_rate * avg_win - (1 - win_rate) * avg_loss"
    return (
        f"CASE WHEN avg_loss <= 0 OR {edge} < 0.02::DOUBLE THEN 0.0::DOUBLE ELSE "
        f"least(portfolio_value * greatest(0.0, {stake} * 0.25 * {confidence}) / price, portfolio_value * 0.95::DOUBLE / price) END"
    )


def _annual(position: str, per_day: str, hours: str, maker: str, level: str) -> dict[str, str]:
    fee = f"(({_vip('0.0002', level)}) * {maker} + ({_vip('0.0005', level)}) * (1 - {maker}))"
    trades = f"({per_day} * 252)"
    c = f"({position} * {fee} * 2 * {trades})"
    s = f"({position} * 0.0005::DOUBLE * 2 * {trades})"
    f = f"({position} * 0.0001::DOUBLE * ({hours} / 8) * {trades})"
    t = f"({c} + {s} + {f})"
    return dict(zip(ANNUAL, (c, s, f, t, f"({t} / {trades})", f"({t} / 252)"), strict=True))


def _named(exprs: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"{sql_grid(v, digits)} AS {k}" for k, v in exprs.items())


def _same(columns, digits: int = 6) -> str:
    return _named({c: c for c in columns}, digits)


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    fixed = "least(portfolio_value * 0.02::DOUBLE * confidence / coalesce(nullif(stop_loss, 0), 0.02::DOUBLE) / price, portfolio_value * 0.95::DOUBLE / price)"
    sql["risk_position_sizing"] = f"WITH {SIGNALS} SELECT position_id, {_named({'price': 'price', 'kelly': _kelly('confidence'), 'fixed': fixed})} FROM sg"
    w30 = over(30, "run_id", "step")
    sql["risk_volatility_parity"] = f"""WITH {EQUITY}, r AS (SELECT *, coalesce(ret, 0) AS r0 FROM er),
v AS (SELECT *, greatest(CASE WHEN count(*) {w30} < 30 THEN 0.5 ELSE stddev_pop(r0) {w30} * sqrt(365.0) END, 0.01::DOUBLE) AS volatility FROM r)
SELECT run_id, step, {_named({'volatility': 'volatility', 'size': 'least(equity * least(0.15::DOUBLE / volatility * 0.8::DOUBLE, 0.95::DOUBLE) / price, equity * 0.95::DOUBLE / price)'})} FROM v"""
    c, s = _commission("notional", "maker", "vip_level"), _slip("notional", "urgency")
    f = "(notional * 0.0001::DOUBLE * holding_hours / 8)"
    cost = {
        "entry_commission": c,
        "entry_slippage": s,
        "entry_total": f"({c} + {s})",
        "exit_commission": c,
        "exit_slippage": s,
        "exit_funding": f,
        "exit_total": f"({c} + {s} + {f})",
        **_trip("notional", "holding_hours", "maker", "urgency", "vip_level"),
        "max_loss": _max_loss("notional"),
    }
    sql["risk_trading_costs"] = f"WITH {SIGNALS} SELECT position_id, {sql_grid(_vip('0.0005', 'vip_level'), 9)} AS fee, {_named(cost, 5)} FROM sg"
    sql["risk_annual_costs"] = f"WITH {SIGNALS}, g AS (SELECT vip_level, avg(notional) AS p, avg(holding_hours) AS h FROM sg GROUP BY 1) SELECT vip_level, {_named(_annual('p', '5', 'h', '0.3::DOUBLE', 'vip_level'), 3)} FROM g"
    sql["risk_drawdown_guard"] = f"""WITH RECURSIVE {EQUITY},
pairs AS (SELECT a.run_id, a.step, a.ts, a.equity, h.step AS hstep, h.ts AS hts, h.equity AS hq,
   max(h.equity) OVER (PARTITION BY a.run_id, a.step ORDER BY h.step ROWS UNBOUNDED PRECEDING) AS runmax
   FROM eq a JOIN eq h ON h.run_id = a.run_id AND h.step <= a.step AND h.ts >= a.ts - INTERVAL 30 DAY),
win AS (SELECT run_id, step, ts, equity, max(hq) AS peak_equity, max((runmax - hq) / runmax) AS max_drawdown FROM pairs GROUP BY ALL),
since AS (SELECT p.run_id, p.step, max(p.hts) AS near FROM pairs p JOIN win w USING (run_id, step) WHERE p.hq >= w.peak_equity * 0.99::DOUBLE GROUP BY 1, 2),
m AS MATERIALIZED (SELECT w.*, (peak_equity - equity) / peak_equity AS dd, (epoch_us(w.ts) - epoch_us(near)) // 86400000000 AS days_in_drawdown FROM win w JOIN since USING (run_id, step)),
fl AS (
  SELECT m.*, dd >= {LIMIT}::DOUBLE AS act, CASE WHEN dd >= {LIMIT}::DOUBLE THEN m.ts END AS since FROM m WHERE step = 0
  UNION ALL
  SELECT x.*, CASE WHEN NOT fl.act AND x.dd >= {LIMIT}::DOUBLE THEN true
      WHEN fl.act AND x.ts >= fl.since + INTERVAL 7 DAY AND x.dd < {LIMIT}::DOUBLE * 0.5 THEN false ELSE fl.act END,
    CASE WHEN NOT fl.act AND x.dd >= {LIMIT}::DOUBLE THEN x.ts
      WHEN fl.act AND x.ts >= fl.since + INTERVAL 7 DAY AND x.dd < {LIMIT}::DOUBLE * 0.5 THEN NULL ELSE fl.since END
  FROM fl JOIN m x ON x.run_id = fl.run_id AND x.step = fl.step + 1)
SELECT run_id, step, act AS is_triggered, days_in_drawdown,
 {_named({'equity': 'equity', 'peak_equity': 'peak_equity', 'current_drawdown': 'dd', 'max_drawdown': 'max_drawdown', 'position_scale': _scale('dd', 'act', str(LIMIT))})} FROM fl"""
    closed_by = f"""{CLOSES},
ord AS (SELECT cl.*, nullif(exit_size, 0) AS given FROM cl),
pre AS (SELECT *, coalesce(sum(coalesce(given, 0)) OVER w, 0) AS earlier, coalesce(sum(CASE WHEN given IS NULL THEN 1 ELSE 0 END) OVER w, 0) AS whole
  FROM ord WINDOW w AS (PARTITION BY position_id ORDER BY exit_s, close_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
jn AS (SELECT pre.*, po.size, po.entry_price, po.position_type, po.position_id IS NOT NULL AND whole = 0 AND earlier < po.size AS known,
   coalesce(given, po.size - earlier) AS amount, (exit_s - epoch_us(po.entry_time) // 1000000) / 3600.0::DOUBLE AS hours FROM pre LEFT JOIN po USING (position_id)),
pr AS (SELECT *, CASE WHEN position_type = 'long' THEN exit_price - entry_price ELSE entry_price - exit_price END * amount AS gross, amount * entry_price AS n FROM jn),
cs AS (SELECT *, {_trip('n', 'hours')['total_cost']} AS cost FROM pr),
pnl AS (SELECT position_id, close_seq, exit_s, known, CASE WHEN known THEN gross ELSE 0 END AS gross_pnl, CASE WHEN known THEN cost ELSE 0 END AS costs,
  CASE WHEN known THEN gross - cost ELSE 0 END AS net_pnl, CASE WHEN known THEN (gross - cost) / n * 100 ELSE 0 END AS return_pct,
  CASE WHEN known THEN greatest(size - earlier - amount, 0) END AS remaining_size FROM cs)"""
    closed = f"{POSITIONS}, {closed_by}"
    sql["risk_position_pnl"] = f"WITH {closed} SELECT position_id, close_seq, known, {_same(['gross_pnl', 'costs', 'net_pnl', 'return_pct', 'remaining_size'], 5)} FROM pnl"
    sql["risk_daily_pnl"] = f"WITH {closed}, d AS (SELECT exit_s // 86400 AS d, count(*) AS closes, sum(net_pnl) AS daily_pnl FROM pnl GROUP BY 1) SELECT strftime(make_timestamp(d * 86400000000), '%Y-%m-%d') AS day, closes, {_same(['daily_pnl'], 3)} FROM d"
    sql["risk_running_daily_pnl"] = f"WITH {closed}, d AS (SELECT *, sum(net_pnl) OVER (PARTITION BY exit_s // 86400 ORDER BY exit_s, close_seq, position_id ROWS UNBOUNDED PRECEDING) AS daily_pnl FROM pnl) SELECT position_id, close_seq, {_same(['daily_pnl'], 3)} FROM d"
    desk = f"""{POSITIONS.replace("l_returnflag AS account", f"l_suppkey % {views.DESKS} AS account")}, {closed_by},
ce AS MATERIALIZED (SELECT po.account, cs.exit_s AS s, gross - cost AS pnl, CASE WHEN greatest(cs.size - earlier - amount, 0) = 0 THEN 1 ELSE 0 END AS ended,
    least(amount, cs.size - earlier) * cs.entry_price AS cash
  FROM cs JOIN po USING (position_id) WHERE known),
mo AS (SELECT account, s, sum(pnl) AS pnl FROM ce GROUP BY ALL),
eq AS MATERIALIZED (SELECT account, s, row_number() OVER w - 1 AS step, {DESK_VALUE}::DOUBLE + sum(pnl) OVER w AS equity FROM mo WINDOW w AS (PARTITION BY account ORDER BY s)),
pairs AS (SELECT a.account, a.step, a.s, a.equity, h.s AS hs, h.equity AS hq,
   max(h.equity) OVER (PARTITION BY a.account, a.step ORDER BY h.step ROWS UNBOUNDED PRECEDING) AS runmax
   FROM eq a JOIN eq h ON h.account = a.account AND h.step <= a.step AND h.s >= a.s - 30 * 86400),
win AS (SELECT account, step, s, equity, max(hq) AS peak_equity, max((runmax - hq) / runmax) AS max_drawdown FROM pairs GROUP BY ALL),
near AS (SELECT p.account, p.step, max(p.hs) AS near FROM pairs p JOIN win w USING (account, step) WHERE p.hq >= w.peak_equity * 0.99::DOUBLE GROUP BY 1, 2),
m AS MATERIALIZED (SELECT w.*, (peak_equity - equity) / peak_equity AS dd, (w.s - near) // 86400 AS days_in_drawdown FROM win w JOIN near USING (account, step)),
fl AS (
  SELECT m.*, dd >= 0.1::DOUBLE AS act, CASE WHEN dd >= 0.1::DOUBLE THEN m.s END AS since FROM m WHERE step = 0
  UNION ALL
  SELECT x.*, CASE WHEN NOT fl.act AND x.dd >= 0.1::DOUBLE THEN true WHEN fl.act AND x.s >= fl.since + 7 * 86400 AND x.dd < 0.05::DOUBLE THEN false ELSE fl.act END,
    CASE WHEN NOT fl.act AND x.dd >= 0.1::DOUBLE THEN x.s WHEN fl.act AND x.s >= fl.since + 7 * 86400 AND x.dd < 0.05::DOUBLE THEN NULL ELSE fl.since END
  FROM fl JOIN m x ON x.account = fl.account AND x.step = fl.step + 1),
gd AS MATERIALIZED (SELECT *, {_scale('dd', 'act', '0.10')} AS position_scale FROM fl),
sg AS (SELECT account, position_id, epoch_us(entry_time) // 1000000 AS s, entry_price AS price, ((position_id // 10) % 100)::DOUBLE / 100.0::DOUBLE AS confidence,
    0.4::DOUBLE + (l_partkey % 5) * 0.1::DOUBLE AS win_rate, 0.02::DOUBLE + (l_suppkey % 5) * 0.02::DOUBLE AS avg_win, (l_partkey % 4) * 0.01::DOUBLE AS avg_loss,
    l_suppkey % 2 = 0 AS maker, (l_partkey % 11)::DOUBLE / 10.0::DOUBLE AS urgency FROM po)"""

    def desk_state(asks: str) -> str:
        """State of the accounts at the rows (account, s, id) of `asks`."""
        return f"""WITH RECURSIVE {desk},
asks AS (SELECT * FROM ({asks})),
ev AS (SELECT account, s, 0 AS kind, NULL AS id, pnl, -ended AS n, -cash AS cash FROM ce
  UNION ALL SELECT account, s, 1, id, 0, 0, 0 FROM asks
  UNION ALL SELECT account, epoch_us(entry_time) // 1000000, 2, NULL, 0, 1, size * entry_price FROM po),
su AS (SELECT *, coalesce(sum(n) OVER w, 0) AS open_positions, coalesce(sum(cash) OVER w, 0) AS open_exposure, coalesce(sum(pnl) OVER w, 0) + {DESK_VALUE}::DOUBLE AS portfolio_value,
    sum(pnl) OVER (PARTITION BY account, s // 86400 ORDER BY s, kind) AS daily_pnl
  FROM ev WINDOW w AS (PARTITION BY account ORDER BY s, kind)),
st AS (SELECT su.account, su.s, su.id, CAST(open_positions AS BIGINT) AS open_positions, open_exposure, portfolio_value, daily_pnl, gd.s AS guard_s, gd.equity, gd.peak_equity, gd.max_drawdown,
    gd.dd, coalesce(gd.dd, 0) AS drawdown, coalesce(gd.act, false) AS drawdown_triggered, gd.position_scale, gd.days_in_drawdown,
    CASE WHEN coalesce(gd.act, false) THEN 'Drawdown guard triggered' WHEN portfolio_value > 0 AND abs(daily_pnl / portfolio_value) > 0.05::DOUBLE THEN 'Daily loss limit exceeded'
      WHEN open_positions >= 3 THEN 'Maximum positions reached' END AS refusal
  FROM (SELECT * FROM su WHERE kind = 1) su ASOF LEFT JOIN gd ON gd.account = su.account AND gd.s <= su.s)"""

    entry_total = f"({_commission('n', 'maker', '0')} + {_slip('n', 'urgency')})"
    screened = {
        "entry_total": (entry_total, 4),
        "position_size": ("size", 5),
        "risk_multiplier": ("mult", 5),
        "adjusted_confidence": ("adj", 5),
        "notional_value": ("n", 2),
        "max_loss": (_max_loss("n"), 2),
    }
    granted = ", ".join(
        f"{sql_grid(f'CASE WHEN reason IS NULL THEN {e} ' + ('ELSE 0 ' if k == 'position_size' else '') + 'END', d)} AS {k}" for k, (e, d) in screened.items()
    )
    sql["risk_trade_screening"] = f"""{desk_state('SELECT account, s, position_id AS id FROM sg')},
a AS (SELECT st.*, sg.* EXCLUDE (account, s), {_scale('drawdown', 'drawdown_triggered', '0.10')} AS mult FROM st JOIN sg ON sg.position_id = st.id),
b AS (SELECT *, confidence * mult AS adj FROM a), c AS (SELECT *, {_kelly('adj')} AS size FROM b), d AS (SELECT *, size * price AS n FROM c),
f AS (SELECT *, coalesce(refusal, CASE WHEN n < portfolio_value * 0.01::DOUBLE THEN 'Position size below minimum' END) AS reason FROM d)
SELECT position_id, reason IS NULL AS approved, reason, {granted} FROM f"""
    sql["risk_account_state"] = f"""WITH {closed},
ce AS (SELECT po.account, cs.exit_s AS s, cs.position_id, CASE WHEN known THEN gross - cost ELSE 0 END AS pnl, known,
    CASE WHEN greatest(cs.size - earlier - amount, 0) = 0 THEN 1 ELSE 0 END AS ended, least(amount, cs.size - earlier) * cs.entry_price AS cash
  FROM cs JOIN po USING (position_id) WHERE known),
en AS (SELECT account, position_id, epoch_us(entry_time) // 1000000 AS s, size * entry_price AS cash FROM po),
ev AS (SELECT account, s, 0 AS kind, NULL AS position_id, pnl, -ended AS n, -cash AS cash FROM ce
  UNION ALL SELECT account, s, 1, position_id, 0, 0, 0 FROM en UNION ALL SELECT account, s, 2, NULL, 0, 1, cash FROM en),
st AS (SELECT *, sum(n) OVER w AS op, sum(cash) OVER w AS ex, sum(pnl) OVER w AS gain, sum(pnl) OVER (PARTITION BY account, s // 86400 ORDER BY s, kind) AS day
  FROM ev WINDOW w AS (PARTITION BY account ORDER BY s, kind))
SELECT account, position_id, CAST(op AS BIGINT) AS open_positions, {_named({'open_exposure': 'ex', 'daily_pnl': 'day', 'portfolio_value': 'gain + 100000'}, 2)} FROM st WHERE kind = 1"""
    share = "CASE WHEN portfolio_value > 0 THEN {} / portfolio_value * 100 ELSE 0 END"
    sql["risk_portfolio_metrics"] = f"""{desk_state('SELECT account, s, step AS id FROM gd')}
SELECT account, s AS at, open_positions, refusal IS NULL AS can_trade, refusal AS reason, drawdown_triggered AS is_triggered, days_in_drawdown,
  {_named({c: 'dd' if c == 'current_drawdown' else c for c in STATUS}, 4)}, {_same(['open_exposure', 'portfolio_value', 'daily_pnl'], 2)},
  {_named({'exposure_pct': share.format('open_exposure'), 'daily_return': share.format('daily_pnl')}, 4)} FROM st"""
    month_end = "epoch_us(date_trunc('month', make_timestamp(s * 1000000)) + INTERVAL 1 MONTH) // 1000000"
    mean = "coalesce(open_exposure / nullif(open_positions, 0), 0)"
    costs = {k: f"({v})" for k, v in _annual("av", "10", "24", "0.5::DOUBLE", "0").items()}
    sql["risk_risk_report"] = f"""{desk_state(f'SELECT DISTINCT account, {month_end} AS s, 0 AS id FROM gd')},
rp AS (SELECT *, {mean} AS av FROM st)
SELECT account, strftime(make_timestamp(s * 1000000), '%Y-%m-%d') AS as_of, open_positions, drawdown_triggered, 3 AS max_positions, {_same(['daily_pnl', 'portfolio_value'], 2)},
  {_named({'max_drawdown': '0.1::DOUBLE', 'max_daily_loss': '0.05::DOUBLE'})}, {_named(costs, 2)} FROM rp"""

    sql["equity_equity_steps"] = f"WITH {EQUITY} SELECT run_id, step, {_named({'equity': 'equity', 'step_return': 'coalesce(ret, 0)', 'peak_equity': 'greatest(top, 0)', 'drawdown': 'fall'})} FROM er"
    w100, w20 = over(100, "run_id", "step"), over(20, "run_id", "step")
    sql["equity_risk_balanced_score"] = f"""WITH {EQUITY}, r AS (SELECT *, coalesce(ret, 0) AS r0 FROM er),
w AS (SELECT *, count(*) {w100} AS n, avg(r0) {w100} AS m, stddev_pop(r0) {w100} AS sd, stddev_pop(r0) {w20} AS sr FROM r),
x AS (SELECT *, CASE WHEN n >= 20 AND sd > 0 THEN m / sd ELSE 0 END AS sharpe_ratio, CASE WHEN n >= 20 AND sd > 0 AND sr / sd > 1.5 THEN (sr / sd - 1.5) * 1.5 ELSE 0 END AS volatility_penalty,
  CASE WHEN holding_period > 100 THEN (holding_period - 100) * 0.001::DOUBLE ELSE 0 END AS holding_penalty, trade_cost * 10 AS trade_cost_penalty, fall AS drawdown FROM w),
y AS (SELECT *, least(greatest(sharpe_ratio - drawdown * 2 - volatility_penalty - holding_penalty - trade_cost_penalty, -2), 5) AS score FROM x)
SELECT run_id, step, {_same(SCORE)} FROM y"""
    metrics = f"""{EQUITY}, mt AS (SELECT run_id, (last(equity ORDER BY step) - first(equity ORDER BY step)) / first(equity ORDER BY step) AS total_return, max(fall) AS max_drawdown,
  avg(ret) / stddev_pop(ret) AS sharpe_ratio, count(*) FILTER (ret > 0) / count(ret) AS win_rate, sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret < 0) AS profit_factor FROM er GROUP BY 1)"""
    sql["equity_run_metrics"] = f"WITH {metrics} SELECT run_id, {_same(METRICS)} FROM mt"
    trades = f"""pc AS (SELECT *, position - {lag('position', 1, 'run_id', 'step')} AS position_change FROM er),
tr AS (SELECT *, CASE WHEN position <> 0 THEN position * (lead(price) OVER (PARTITION BY run_id ORDER BY step) - price) / price END AS trade_return FROM pc WHERE abs(position_change) > 0.0001)"""
    sql["equity_detected_trades"] = f"WITH {EQUITY}, {trades} SELECT run_id, step, {_same(['position_change', 'trade_return'])} FROM tr"
    sql["equity_backtest_metrics"] = f"""WITH {EQUITY}, {trades},
ts AS (SELECT run_id, count(*) AS n_trades, 100.0 * count(*) FILTER (trade_return > 0) / count(trade_return) AS win_rate, 100 * avg(trade_return) FILTER (trade_return > 0) AS avg_win,
  100 * avg(trade_return) FILTER (trade_return < 0) AS avg_loss, sum(trade_return) FILTER (trade_return > 0) / -sum(trade_return) FILTER (trade_return < 0) AS profit_factor FROM tr GROUP BY 1),
cv AS (SELECT run_id, 100 * (last(equity ORDER BY step) - first(equity ORDER BY step)) / first(equity ORDER BY step) AS total_return, 100 * max(fall) AS max_drawdown, last(equity ORDER BY step) AS final_equity,
  max(equity) AS best_equity, min(equity) AS worst_equity, power(1 + avg(ret), 8760) - 1 AS y, stddev_pop(ret) AS sd, stddev_pop(ret) FILTER (ret < 0) AS dsd FROM er GROUP BY 1)
SELECT run_id, n_trades, {_same(BACKTEST)}, {sql_sci('y * 100', 5)} AS annualized_return, {sql_sci('y / (sd * sqrt(8760.0))', 5)} AS sharpe_ratio, {sql_sci('y / (dsd * sqrt(8760.0))', 5)} AS sortino_ratio FROM cv JOIN ts USING (run_id)"""
    sql["equity_run_summary"] = f"""WITH {EQUITY}, {trades}, d AS (SELECT run_id, count(*) AS n_trades, avg(abs(position_change * price)) AS avg_trade_value, sum(trade_cost * price) AS total_fees FROM tr GROUP BY 1),
l AS (SELECT run_id, last(equity ORDER BY step) AS final_equity FROM er GROUP BY 1), z AS (SELECT *, (final_equity - 100000) / 100000 * 100 AS total_return_pct FROM l JOIN d USING (run_id))
SELECT run_id, n_trades, {_same(SUMMARY, 4)} FROM z"""
    up = "OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING)"
    norm = {
        f"{c}_norm": f"least(greatest(CASE WHEN step >= 100 THEN ({c} - avg({c}) {up}) / stddev_samp({c}) {up} ELSE {c} END, -10), 10)"
        for c in ("equity", "price")
    }
    sql["equity_expanding_normalization"] = f"WITH {EQUITY} SELECT run_id, step, {_named(norm, 5)} FROM er"
    parts = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS v FROM mt" for m in METRICS)
    sql["equity_across_runs"] = f"WITH {metrics}, u AS ({parts}), g AS (SELECT metric, count(*) AS runs, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max FROM u GROUP BY 1) SELECT metric, runs, {_named({c: c for c in ('mean', 'std', 'min', 'max')})} FROM g"
    sql["equity_action_histogram"] = f"""WITH {EQUITY}, {trades}, b AS (SELECT min(action) AS lo, max(action) AS hi FROM tr),
h AS (SELECT least(floor((action - lo) / ((hi - lo) / 30))::BIGINT, 29) AS bin, lo, hi FROM tr, b)
SELECT bin, count(*) AS count, {sql_grid('any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 30)')} AS "left" FROM h GROUP BY bin"""
    return sql
