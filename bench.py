"""Benchmark: headline queries on the tables in $BENCH_SF_DIR.

Prints one JSON line. Every query is run to the end once on a fresh plan after
one warm-up query that only starts the engine.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.operators.features import FeatureSet  # noqa: E402
from tickloom.plans import market, risk, views  # noqa: E402
from tickloom.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
FIVE_MINUTES = 300


def indicators(names=None, every=FIVE_MINUTES):
    def run(spark, sf_dir):
        bars = views.bars(spark, sf_dir, every)
        return FeatureSet().transform(bars, names, every=every, complete=True)

    return run


QUERIES = {
    "trade_bars_5min": market.trade_bars_five_minutes,
    "sma_rsi_bollinger_5min": indicators(["SMA_20", "RSI_14", "BB_UPPER"]),
    "ema_family_5min": indicators(["EMA_5", "EMA_20", "EMA_200", "TEMA_20", "MACD_HIST", "ADX_14"]),
    "running_totals_5min": indicators(["OBV", "AD", "NVI", "PVI", "VWAP", "VPT"]),
    "ordered_indicators_5min": indicators(["PSAR", "PSAR_TREND", "SUPERTREND_10_3", "ZIG_ZAG_5"]),
    "all_99_indicators_5min": indicators(),
    "trailing_flow": market.trailing_flow,
    "book_reconstruction": market.book_reconstruction,
    "feature_matrix_price": lambda s, d: market.matrix_frame(s, d, ["price_liquidity", "volatility"]),
    "position_pnl": risk.position_pnl,
    "drawdown_guard": risk.drawdown_guard,
    "risk_balanced_score": risk.risk_balanced_score,
    "backtest_metrics": risk.backtest_metrics,
    "trading_costs": risk.trading_costs,
}


def main() -> None:
    only = re.compile(sys.argv[1] if len(sys.argv) > 1 else ".")
    spark = build_session(
        f"local[{CPUS}]",
        int(CPUS),
        **{"spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    views.trades(spark, SF_DIR).groupBy("symbol").count().collect()
    times = {}
    for name, run in QUERIES.items():
        if not only.search(name):
            continue
        start = time.perf_counter()
        run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([\d.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
