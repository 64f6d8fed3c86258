"""Registered queries on raw market data: parsing, bars, book, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import grid
from tickloom.operators import bars as b
from tickloom.operators import book as k
from tickloom.operators import boosting, quality, snapshots
from tickloom.plans import views
from tickloom.plans.sql import TRADES, bars, decay, fdiv, lag, over, roll, std
from tickloom.plans.sql import grid as sql_grid
from tickloom.session import new_folder
from tickloom.sources import raw, sinks
from tickloom.sources.daily import process_days

FIVE_MINUTES = 300


def _show(df: DataFrame, exact: list[str], rounded: list[str], digits: int = 6) -> DataFrame:
    return df.select(
        *exact,
        F.unix_timestamp("ts").alias("t"),
        *(grid(F.col(c), digits).alias(c) for c in rounded),
    )


# -- bars --------------------------------------------------------------------

BAR_EXACT = ["symbol", "trade_count", "buy_count", "sell_count"]
BAR_ROUNDED = ["open", "high", "low", "close", "volume", "buy_volume", "sell_volume", "vwap"]


def trade_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(views.bars(spark, sf_dir), BAR_EXACT, BAR_ROUNDED)


def trade_bars_five_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(views.bars(spark, sf_dir, FIVE_MINUTES), BAR_EXACT, BAR_ROUNDED)


def trade_bars_side_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = b.trade_bars(views.trades(spark, sf_dir), FIVE_MINUTES, edge_mode="carry")
    return _show(made, ["symbol", "buy_count", "sell_count"], ["buy_volume", "sell_volume"])


SECOND_EXACT = ["symbol", "quantity_count", "is_buyer_maker_sum", "is_buyer_maker_count"]
SECOND_ROUNDED = [
    "price_first",
    "price_last",
    "price_mean",
    "price_std",
    "quantity_sum",
    "buy_volume",
    "sell_volume",
    "trade_imbalance",
]


def second_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(b.second_trades(views.trades(spark, sf_dir)), SECOND_EXACT, SECOND_ROUNDED)


BOOK_COLUMNS = [*b.BOOK_LAST, *b.BOOK_MEAN]


def book_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(b.book_bars(views.book_rows(spark, sf_dir), views.HOUR), ["symbol"], BOOK_COLUMNS)


def joined_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = b.book_bars(views.book_rows(spark, sf_dir), FIVE_MINUTES)
    made = b.join_bars(views.bars(spark, sf_dir, 2 * FIVE_MINUTES), book, FIVE_MINUTES)
    return _show(made, BAR_EXACT, ["close", "volume", "mid_price", "best_bid", "best_ask", "spread", "order_imbalance"])


SNAP_COLUMNS = ["mid_price", "best_bid", "best_ask", "spread", "quantity_sum", "price_last"]


def _joined_snapshots(spark: SparkSession, sf_dir: str, as_of: bool = False) -> DataFrame:
    # Deduplicate first: the join is on exact time.
    book = k.keep_last(k.snapshot_features(views.book(spark, sf_dir)).drop("bids", "asks"), ["symbol", "ts"], ["update_id"])
    return b.join_snapshots(book.drop("update_id"), b.second_trades(views.trades(spark, sf_dir)), as_of=as_of)


def snapshot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _joined_snapshots(spark, sf_dir)
    return made.select("symbol", F.unix_micros("ts").alias("us"), *(grid(F.col(c)).alias(c) for c in SNAP_COLUMNS))


def snapshot_join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _joined_snapshots(spark, sf_dir, as_of=True)
    return made.select("symbol", F.unix_micros("ts").alias("us"), *(grid(F.col(c)).alias(c) for c in SNAP_COLUMNS))


# -- order book --------------------------------------------------------------


def top_of_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.book_rows(spark, sf_dir)
    columns = ["best_bid", "best_ask", "mid_price", "spread", "spread_pct"]
    return rows.select("symbol", "update_id", *(grid(F.col(c)).alias(c) for c in columns))


def book_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.book_rows(spark, sf_dir)
    columns = ["bid_volume_5", "ask_volume_5", "bid_volume_10", "ask_volume_10", "order_imbalance"]
    return rows.select("symbol", "update_id", *(grid(F.col(c)).alias(c) for c in columns))


LADDER = [f"{side}_{i}_{part}" for i in range(k.LEVELS) for side in ("bid", "ask") for part in ("price", "qty")]


def book_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = k.snapshot_features(views.book(spark, sf_dir))
    return rows.select("symbol", "update_id", *(grid(F.col(c)).alias(c) for c in ["imbalance_5", *LADDER]))


NOTIONAL = [f"{side}_depth_{i}" for side in ("bid", "ask") for i in range(5)] + [
    "total_bid_depth",
    "total_ask_depth",
    "depth_imbalance",
]


def depth_notional(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = k.depth_notional(k.flatten_ladder(views.book(spark, sf_dir), 5))
    return rows.select("symbol", "update_id", *(grid(F.col(c), 5).alias(c) for c in NOTIONAL))


def _listed_book(every: int, **blocks: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = k.reconstruct(views.book_deltas(spark, sf_dir), every=every, **blocks)
        return made.select(
            "symbol",
            F.unix_timestamp("ts").alias("t"),
            F.unix_timestamp("valid_until").alias("until"),
            "side",
            F.col("level").cast("long").alias("level"),
            *(grid(F.col(c)).alias(c) for c in ("price", "qty")),
        )

    return run


def book_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second."""
    return _listed_book(1)(spark, sf_dir)


def book_reconstruction_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed_book(86400, block_rows=512)(spark, sf_dir)


def book_reconstruction_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated at every hour."""
    made = k.dense_book(k.reconstruct(views.book_deltas(spark, sf_dir), every=3600, levels=2), 3600)
    return made.select(
        "symbol", F.unix_timestamp("ts").alias("t"), "side", F.col("level").cast("long").alias("level"), grid(F.col("price")).alias("price"), grid(F.col("qty")).alias("qty")
    )


def trailing_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.snapshots(spark, sf_dir)
    columns = ["mid_price", "buy_volume_1s", "sell_volume_1s", "vwap_1s"]
    return rows.select("symbol", "update_id", *(grid(F.col(c)).alias(c) for c in columns))


def trailing_flow_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over an hour, so that many trades overlap."""
    flat = k.top_of_book(views.book(spark, sf_dir)).select("symbol", "ts", "update_id", "mid_price")
    rows = k.trailing_flow(flat, views.trades(spark, sf_dir), 3_600_000)
    columns = ["mid_price", "buy_volume_1s", "sell_volume_1s", "vwap_1s"]
    return rows.select("symbol", "update_id", *(grid(F.col(c)).alias(c) for c in columns))


# -- snapshot features -------------------------------------------------------


IDS = ["symbol", "ts", "update_id"]
FLOWS = ["buy_volume_1s", "sell_volume_1s", "vwap_1s"]


def _daily(spark: SparkSession, sf_dir: str, read: list[str], whole: str | None = None) -> DataFrame:
    """Snapshots carrying the traded quantity, with the daily features; of the columns of a row alone those in `read`.

    Rows are numbered and cut to what is read before they are shuffled; `whole` names a
    column that is missing where one of those left out is.
    """
    flat = snapshots.row_features(k.snapshot_features(views.book(spark, sf_dir)).drop("bids", "asks"))
    kept = [c for c in k.select_features(flat.columns) if c in (*IDS, "mid_price", "spread", *read)]
    left_out = [c for c in flat.columns if c not in kept]
    narrow = quality.fold_incomplete(flat, left_out, whole) if whole else flat.select(*kept)
    placed = snapshots.numbered(narrow, ["symbol"], ["ts", "update_id"])
    rows = k.trailing_flow(placed, views.trades(spark, sf_dir))
    rows = rows.withColumn("quantity_sum", F.col("buy_volume_1s") + F.col("sell_volume_1s"))
    rows = quality.fold_incomplete(rows, [whole, *FLOWS], whole) if whole else rows.drop(*FLOWS)
    return snapshots.daily_features(rows, order=("ts", "update_id"), complete=True)


TIME_COLUMNS = ["hour", "minute", "second", "day_of_week"]
RATIOS = ["bid_ask_ratio", "log_mid_price", "mid_price_change", "mid_price_pct_change"]


def time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _daily(spark, sf_dir, [*TIME_COLUMNS, *RATIOS])
    return made.select("symbol", "update_id", *TIME_COLUMNS, *(grid(F.col(c)).alias(c) for c in RATIOS))


ROLLING = [
    f"{c}_{n}s"
    for n in snapshots.ROLLING_SECONDS
    for c in ("mid_price_mean", "mid_price_std", "spread_mean", "volume_sum")
]


def rolling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir, []).select("symbol", "update_id", *(grid(F.col(c)).alias(c) for c in ROLLING))


def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with every rolling value, raw ladder columns left out."""
    made = quality.drop_incomplete(_daily(spark, sf_dir, [*RATIOS, *NOTIONAL], whole="_whole"))
    chosen = [c for c in k.select_features(made.columns) if c in (*RATIOS, *NOTIONAL, *ROLLING)]
    return made.select("symbol", "update_id", *(grid(F.col(c), 5).alias(c) for c in chosen))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = k.top_of_book(views.book(spark, sf_dir)).select("symbol", "ts", "mid_price", "spread_pct")
    made = quality.quality_report(rows, min_rows=1000)
    return made.select(
        "symbol",
        "rows",
        grid(F.col("min_mid_price")).alias("min_mid_price"),
        grid(F.col("max_spread_pct")).alias("max_spread_pct"),
        grid(F.col("max_gap_seconds")).alias("max_gap_seconds"),
        grid(F.col("null_share")).alias("null_share"),
        "verdict",
    )


def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.chronological_split(views.bars(spark, sf_dir))
    return made.select("symbol", F.unix_timestamp("ts").alias("t"), "split")


def variance_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["open", "high", "low", "close", "volume", "vwap", "buy_volume", "sell_volume"]
    top = quality.top_variance(views.bars(spark, sf_dir), columns, 5)
    return top.select("feature", grid(F.col("variance"), 4).alias("variance"))


CORRELATED = ["spread", "imbalance_5", "mid_price", "buy_volume_1s", "sell_volume_1s", "vwap_1s", "bid_0_qty", "ask_0_qty"]
SELECTED = [*CORRELATED, "bid_1_qty", "ask_1_qty", "bid_2_qty", "ask_2_qty"]
SELECTION = boosting.Plan(trees=3, depth=2, bins=32, rate=0.3, min_rows=20, unit=1e-3)


def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of a snapshot that boosted trees for the next return gain most from."""
    # The return is found before the flow joins, from the columns that are read.
    ahead = quality.forward_return(views.quotes(spark, sf_dir, SELECTED), order=("ts", "update_id"))
    rows = k.trailing_flow(ahead, views.trades(spark, sf_dir))
    # On a grid, so that engines that differ in the last bit agree on the bins.
    rows = rows.select(*(grid(F.col(c), 6).alias(c) for c in SELECTED), grid(F.col("target"), 6).alias("target"))
    made = boosting.model_importance(rows, SELECTED, "target", 10, SELECTION)
    return made.select("feature", grid(F.col("importance"), 6).alias("importance"))




def target_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.forward_return(views.snapshots(spark, sf_dir), order=("ts", "update_id"))
    top = quality.top_correlation(rows, CORRELATED, "target", 5)
    return top.select("feature", "rows", grid(F.col("correlation"), 6).alias("correlation"))


def forward_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.forward_return(views.snapshots(spark, sf_dir), order=("ts", "update_id"))
    return made.select("symbol", "update_id", grid(F.col("target"), 5).alias("target"))


# -- sources -----------------------------------------------------------------


def _book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured book lines; by event_id some are cut off, empty or misspelt."""

    def text(side: str):
        return F.transform(
            side,
            lambda level: F.array(level["price"].cast("string"), level["qty"].cast("string")),
        )

    millis = F.unix_millis("ts")
    i = F.col("update_id")
    good = views.book(spark, sf_dir).select(
        i,
        F.to_date("ts").alias("day"),
        F.to_json(
            F.struct(
                millis.alias("timestamp"),
                F.when(i % 31 != 3, millis).alias("event_time"),
                "symbol",
                i.alias("final_update_id"),
                F.when(i % 29 == 2, F.array().cast("array<array<string>>")).otherwise(text("bids")).alias("bids"),
                text("asks").alias("asks"),
            )
        ).alias("value"),
    )
    return good.select("day", F.when(i % 37 == 5, F.lit("not a record")).otherwise(F.col("value")).alias("value"))


def parse_book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw.book_rows(raw.parse_lines(_book_lines(spark, sf_dir), raw.BOOK_SCHEMA))
    columns = ["mid_price", "spread", "bid_volume_5", "ask_volume_10", "order_imbalance"]
    return rows.select(
        "symbol",
        F.col("final_update_id").alias("update_id"),
        F.unix_millis("ts").alias("ms"),
        *(grid(F.col(c)).alias(c) for c in columns),
    )


def _trade_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured trade lines; by trade_id some prices are no number and some quantities are missing."""
    i = F.col("trade_id")
    price = F.when(i % 23 == 7, F.lit("not_a_number")).otherwise(F.col("price").cast("string"))
    return views.trades(spark, sf_dir).select(
        F.to_date("ts").alias("day"),
        F.to_json(
            F.struct(
                F.unix_millis("ts").alias("timestamp"),
                F.unix_millis("ts").alias("event_time"),
                "symbol",
                "trade_id",
                price.alias("price"),
                F.when(i % 41 != 1, F.col("quantity").cast("string")).alias("quantity"),
                "is_buyer_maker",
            )
        ).alias("value"),
    )


def parse_trade_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw.trade_rows(raw.parse_lines(_trade_lines(spark, sf_dir), raw.TRADE_SCHEMA))
    return rows.select(
        "symbol", "trade_id", F.unix_millis("ts").alias("ms"), grid(F.col("price")).alias("price"),
        grid(F.col("quantity")).alias("quantity"), "is_buyer_maker",
    )


def line_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = raw.parse_lines(_book_lines(spark, sf_dir), raw.BOOK_SCHEMA)
    return raw.rejects(parsed, raw.book_rows(parsed))


def combined_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping files put together; the later file wins per time."""
    rows = views.trades(spark, sf_dir).select("symbol", "ts", "trade_id", "price")
    minute = F.date_trunc("minute", "ts")
    first = rows.filter(F.hour("ts") < 14).withColumns({"ts": minute, "file": F.lit(1)})
    second = rows.filter(F.hour("ts") >= 10).withColumns(
        {"ts": minute, "file": F.lit(2), "price": F.col("price") + 1}
    )
    both = first.unionByName(second)
    last = k.keep_last(both, ["symbol", "ts"], ["file", "trade_id"])
    return last.select("symbol", F.unix_timestamp("ts").alias("t"), "trade_id", "file", grid(F.col("price")).alias("price"))


def raw_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition columns from the names of the files that would hold the events."""
    kind = F.when(F.col("trade_id") % 2 == 0, "orderbook").otherwise("trades")
    path = F.concat(F.lit("/data/"), "symbol", F.lit("_"), kind, F.lit("_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".parquet"))
    named = views.trades(spark, sf_dir).withColumn("path", path)
    return named.withColumns(raw.path_columns(F.col("path"))).groupBy("year", "month", "day", "kind").agg(
        F.count(F.lit(1)).alias("files")
    )


def daily_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily job over raw files written from the events: what it read and wrote of every day."""
    root, out = new_folder(spark), new_folder(spark)
    for kind, lines in (("trade", _trade_lines(spark, sf_dir)), ("orderbook", _book_lines(spark, sf_dir))):
        lines.write.partitionBy("day").text(f"{root}/{kind}")
    report = process_days(spark, root, out, *DAYS, every=views.HOUR, layout="{kind}/day=%Y-%m-%d")
    written = spark.read.parquet(out).groupBy(F.date_format("date", "yyyy-MM-dd").alias("date"))
    written = written.agg(F.sum("volume").alias("volume"), F.max("best_ask").alias("best_ask"), F.count_if(F.col("trade_count") == 0).alias("quiet"))
    made = report.join(written, "date", "left")
    return made.select(
        F.col("date").alias("day"), "trade_lines", "trades", "book_lines", "snapshots", "rows", "status", "quiet",
        grid(F.col("volume"), 4).alias("volume"), grid(F.col("best_ask"), 4).alias("best_ask"),
    )


DAYS = ("2023-12-30", "2024-02-02")


def day_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sinks.status_by_day(views.bars(spark, sf_dir), "2023-12-30", "2024-02-02")
    return made.select(F.date_format("date", "yyyy-MM-dd").alias("day"), "rows", "status")


# -- feature matrix ----------------------------------------------------------


def matrix_frame(spark: SparkSession, sf_dir: str, categories, **blocks: int) -> DataFrame:
    order = ("ts", "update_id")
    known = [c for c in views.snapshots(spark, sf_dir).columns if c not in ("symbol", *order)]
    # The ladder has eighty columns, of which a category reads a few.
    rows = views.snapshots(spark, sf_dir, snapshots.matrix_inputs(categories, known))
    return snapshots.feature_matrix(rows, categories, order=order, complete=True, **blocks)


MATRIX_DIGITS = {
    "price_liquidity": 5,
    "order_flow": 5,
    "volatility": 4,
    "momentum": 4,
    "trend": 5,
    "bands": 5,
    "volume_psychology": 4,
}


def _matrix_query(category: str, **blocks: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = matrix_frame(spark, sf_dir, [category], **blocks)
        columns = [c for c in made.columns if c not in ("symbol", "ts", "update_id")]
        digits = MATRIX_DIGITS[category]
        return made.select("symbol", "update_id", *(grid(F.col(c), digits).alias(c) for c in columns))

    return run


def queries() -> dict:
    plain = [
        trade_bars,
        trade_bars_five_minutes,
        trade_bars_side_edges,
        second_trades,
        book_bars,
        joined_bars,
        snapshot_join,
        snapshot_join_as_of,
        top_of_book,
        book_depth,
        book_ladder,
        depth_notional,
        book_reconstruction,
        book_reconstruction_daily,
        book_reconstruction_dense,
        trailing_flow,
        trailing_flow_hour,
        time_parts,
        rolling_rows,
        complete_rows,
        quality_report,
        chronological_split,
        variance_selection,
        model_selection,
        target_correlation,
        forward_return,
        parse_book_lines,
        parse_trade_lines,
        line_rejects,
        combined_files,
        raw_paths,
        day_status,
        daily_job,
    ]
    made = {f"market_{f.__name__}": f for f in plain}
    made.update({f"matrix_{c}": _matrix_query(c) for c in snapshots.CATEGORIES})
    made.update({f"matrix_{c}_blocks": _matrix_query(c, block_rows=256) for c in ("trend", "momentum", "bands", "volume_psychology")})
    return made


# -- comparison SQL ----------------------------------------------------------


def _grid_list(columns, digits: int = 6, prefix: str = "") -> str:
    return ", ".join(f'{sql_grid(prefix + c, digits)} AS "{c}"' for c in columns)


def _level(sign: int, i: int) -> str:
    return f"(value * {1 + sign * 0.0001 * (i + 1)!r}::DOUBLE)"


def _qty(side: str, i: int) -> str:
    step, skip = (7, 13) if side == "bid" else (11, 17)
    return f"(((event_id * {step} + {i * skip}) % 50 + 1)::DOUBLE / 10.0::DOUBLE)"


def _sum_qty(side: str, n: int) -> str:
    return "(" + " + ".join(_qty(side, i) for i in range(n)) + ")"


def _ladder() -> str:
    parts = []
    for i in range(k.LEVELS):
        for side, sign in (("bid", -1), ("ask", 1)):
            parts.append(f"{_level(sign, i)} AS {side}_{i}_price, {_qty(side, i)} AS {side}_{i}_qty")
    return ", ".join(parts)


BOOK = f"""book0 AS (
  SELECT event_type AS symbol, ts, event_id AS update_id, event_id, value, {_ladder()},
    {_sum_qty("bid", 5)} AS bid_volume_5, {_sum_qty("ask", 5)} AS ask_volume_5,
    {_sum_qty("bid", 10)} AS bid_volume_10, {_sum_qty("ask", 10)} AS ask_volume_10
  FROM events),
book1 AS (SELECT *, bid_0_price AS best_bid, ask_0_price AS best_ask, (bid_0_price + ask_0_price) / 2 AS mid_price,
    ask_0_price - bid_0_price AS spread FROM book0),
book AS (SELECT *, spread / mid_price * 100 AS spread_pct,
    (bid_volume_10 - ask_volume_10) / (bid_volume_10 + ask_volume_10) AS order_imbalance,
    (bid_volume_5 - ask_volume_5) / (bid_volume_5 + ask_volume_5) AS imbalance_5 FROM book1)"""

FLOW = """trail AS (
  SELECT s.update_id, sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE 0.0 END) AS buy,
    sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0.0 END) AS sell,
    sum(price * quantity) / sum(quantity) AS vw
  FROM book s JOIN t ON t.symbol = s.symbol
   AND epoch_us(s.ts) // 1000 - epoch_us(t.ts) // 1000 BETWEEN 0 AND {ms}
  GROUP BY 1)"""

SNAPSHOTS = f"""{TRADES}, {BOOK}, {FLOW.format(ms=1000)},
s AS MATERIALIZED (SELECT book.*, coalesce(buy, 0) AS buy_volume_1s, coalesce(sell, 0) AS sell_volume_1s,
  coalesce(vw, mid_price) AS vwap_1s, coalesce(buy, 0) + coalesce(sell, 0) AS quantity_sum,
  row_number() OVER (PARTITION BY symbol ORDER BY ts, update_id) - 1 AS rn,
  {lag("mid_price", 1, order="ts, update_id")} AS pm
  FROM book LEFT JOIN trail USING (update_id))"""


def _boosting_sql(start: str, source: str) -> str:
    """The boosted trees of SELECTION unrolled, level by level."""
    plan, n = SELECTION, len(SELECTED)
    values = ", ".join(f"{sql_grid(c, 6)} AS {c}" for c in (*SELECTED, "target"))
    known = " AND ".join(f"{c} IS NOT NULL" for c in (*SELECTED, "target"))
    lows = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in SELECTED)
    bins = ", ".join(
        f"CASE WHEN hi_{c} > lo_{c} THEN least(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * {plan.bins}), {plan.bins - 1}) ELSE 0 END::INT" for c in SELECTED
    )
    steps = [
        start,
        f"v AS (SELECT {values} FROM {source} WHERE {known})",
        f"lim AS (SELECT {lows} FROM v)",
        f"b AS MATERIALIZED (SELECT [{bins}] AS bins, CAST(floor(target / {plan.unit!r}::DOUBLE + {boosting.SHIFT}::DOUBLE) AS BIGINT) AS y FROM v, lim)",
        "r0 AS MATERIALIZED (SELECT bins, 1 AS node, y - (SELECT CAST(floor(sum(y)::DOUBLE / count(*)::DOUBLE) AS BIGINT) FROM b) AS rest FROM b)",
    ]

    def part(s: str, k: str) -> str:
        return f"({s})::DOUBLE * ({s})::DOUBLE / ({k})::DOUBLE"

    for t in range(plan.trees):
        for d in range(plan.depth):
            at, of = f"{t}_{d}", f"r{t}" if d == 0 else f"n{t}_{d - 1}"
            steps += [
                f"c{at} AS (SELECT node, f, bins[f + 1] AS bin, count(*) AS n, sum(rest) AS s FROM {of}, range({n}) AS x(f) GROUP BY ALL)",
                f"w{at} AS (SELECT node, f, bin, sum(n) OVER u AS n1, sum(s) OVER u AS s1, sum(n) OVER p AS n, sum(s) OVER p AS s FROM c{at} "
                "WINDOW u AS (PARTITION BY node, f ORDER BY bin ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY node, f))",
                f"g{at} AS (SELECT *, {part('s1', 'n1')} + {part('s - s1', 'n - n1')} - {part('s', 'n')} AS gain FROM w{at} WHERE n1 >= {plan.min_rows} AND n - n1 >= {plan.min_rows})",
                f"s{at} AS MATERIALIZED (SELECT * FROM g{at} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) = 1)",
                f"n{at} AS MATERIALIZED (SELECT bins, rest, CASE WHEN s.f IS NULL THEN r.node WHEN bins[s.f + 1] <= s.bin THEN 2 * r.node ELSE 2 * r.node + 1 END AS node "
                f"FROM {of} r LEFT JOIN s{at} s ON s.node = r.node)",
            ]
        last = f"n{t}_{plan.depth - 1}"
        steps.append(
            f"r{t + 1} AS MATERIALIZED (SELECT bins, 1 AS node, rest - leaf AS rest FROM {last} JOIN "
            f"(SELECT node, CAST(floor(sum(rest)::DOUBLE / count(*)::DOUBLE * {plan.rate!r}::DOUBLE) AS BIGINT) AS leaf FROM {last} GROUP BY 1) USING (node))"
        )
    gains = " UNION ALL ".join(f"SELECT f, gain FROM s{t}_{d}" for t in range(plan.trees) for d in range(plan.depth))
    names = ", ".join(f"({k}, '{c}')" for k, c in enumerate(SELECTED))
    steps.append(f"i AS (SELECT f, sum(gain) / (SELECT sum(gain) FROM ({gains})) AS importance FROM ({gains}) GROUP BY 1)")
    return (
        f"WITH {', '.join(steps)} SELECT name AS feature, {sql_grid('importance', 6)} AS importance FROM i JOIN (VALUES {names}) x(k, name) ON k = f "
        "ORDER BY i.importance DESC, f LIMIT 10"
    )


def _matrix_sql(category: str, outputs: dict[str, str], *steps: str, source: str = "s", recursive: str = "") -> str:
    digits = MATRIX_DIGITS[category]
    filled = ", ".join(
        f'coalesce(last_value({expr} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS "{c}"'
        for c, expr in ((c, f"v_{i}") for i, c in enumerate(outputs))
    )
    values = ", ".join(f"({expr})::DOUBLE AS v_{i}" for i, expr in enumerate(outputs.values()))
    body = [SNAPSHOTS, *steps, f"vals AS (SELECT symbol, update_id, rn, {values} FROM {source})", f"done AS (SELECT symbol, update_id, {filled} FROM vals)"]
    return f"WITH {recursive} {', '.join(body)} SELECT symbol, update_id, {_grid_list(outputs, digits)} FROM done"


def _ms() -> dict[str, str]:
    sql = {}
    spread_mean, spread_std = roll("avg", "spread", 10), std("spread", 10)
    top, low = roll("max", "mid_price", 10), roll("min", "mid_price", 10)
    micro = "(bid_0_price * ask_0_qty + ask_0_price * bid_0_qty) / (bid_0_qty + ask_0_qty)"
    out = {f"mid_price_delta_{n}s": f"mid_price - {lag('mid_price', n)}" for n in (1, 3, 5)}
    out |= {
        "vwap_mid_diff": "vwap_1s - mid_price",
        "vwap_mid_ratio": "vwap_1s / mid_price",
        "spread_bps": "spread_pct * 100",
        "spread_rolling_mean_10s": spread_mean,
        "spread_rolling_std_10s": spread_std,
        "spread_zscore": f"(spread - ({spread_mean})) / nullif({spread_std}, 0)",
        "micro_price": micro,
        "micro_price_diff": f"{micro} - mid_price",
        "price_position_10s": fdiv(f"mid_price - ({low})", f"({top}) - ({low})"),
        "bid_concentration_l1": "bid_0_qty / bid_volume_5",
        "ask_concentration_l1": "ask_0_qty / ask_volume_5",
        "effective_spread": "2 * abs(lead(mid_price) OVER (PARTITION BY symbol ORDER BY rn) - mid_price)",
    }
    out |= {f"log_return_{n}s": f"ln(mid_price / {lag('mid_price', n)})" for n in (1, 5, 10)}
    sql["price_liquidity"] = _matrix_sql("price_liquidity", out)

    out = {f"ofi_level_{i}": f"(bid_{i}_qty - {lag(f'bid_{i}_qty')}) - (ask_{i}_qty - {lag(f'ask_{i}_qty')})" for i in range(5)}
    total = " + ".join(f"({v})" for v in out.values())
    depth = "d1 AS (SELECT *, " + ", ".join(
        f"({' + '.join(f'{side}_{i}_qty' for i in range(n))}) AS {side}_d{n}" for side in ("bid", "ask") for n in (1, 3, 5, 10)
    ) + f", {total} AS ofi FROM s)"
    weighted = {side: "(" + " + ".join(f"{side}_{i}_qty * {1 - i / 10!r}::DOUBLE" for i in range(5)) + ")" for side in ("bid", "ask")}
    out |= {"ofi_total": "ofi", "ofi_cumsum_10s": roll("sum", "ofi", 10)}
    out |= {f"depth_imbalance_l{n}": f"(bid_d{n} - ask_d{n}) / (bid_d{n} + ask_d{n})" for n in (1, 3, 5, 10)}
    out |= {f"{side}_depth_change_1s": f"{side}_d5 - {lag(f'{side}_d5')}" for side in ("bid", "ask")}
    out |= {
        "total_depth_change_1s": f"(bid_d5 - {lag('bid_d5')}) + (ask_d5 - {lag('ask_d5')})",
        "weighted_depth_imbalance": f"({weighted['bid']} - {weighted['ask']}) / ({weighted['bid']} + {weighted['ask']})",
        "bid_intensity": "bid_d5 / best_bid",
        "ask_intensity": "ask_d5 / best_ask",
        "net_trade_flow": "buy_volume_1s - sell_volume_1s",
        "trade_imbalance": "(buy_volume_1s - sell_volume_1s) / (quantity_sum + 1e-8)",
    }
    sql["order_flow"] = _matrix_sql("order_flow", out, depth, source="d1")

    r1 = f"r1 AS (SELECT *, mid_price / pm - 1 AS ret, ask_0_price - bid_0_price AS gap, {roll('max', 'mid_price', 14)} - ({roll('min', 'mid_price', 14)}) AS rng FROM s)"
    r2 = f"r2 AS (SELECT *, ret * ret AS sq, {', '.join(f'{std("ret", n)} AS v{n}' for n in (3, 10, 30, 60))} FROM r1)"
    out = {f"volatility_{n}s": f"v{n}" for n in (3, 10, 30, 60)}
    out |= {
        "atr_14s": roll("avg", "rng", 14),
        "realized_vol_30s": f"sqrt({roll('sum', 'sq', 30)})",
        "vol_ratio_10_30": fdiv("v10", "v30"),
        "vol_ratio_30_60": fdiv("v30", "v60"),
        "squared_returns": "sq",
        "vol_momentum": roll("avg", "sq", 10),
        "spread_volatility_10s": std("gap", 10),
        "volatility_zscore": f"(v30 - ({roll('avg', 'v30', 300)})) / nullif({std('v30', 300)}, 0)",
    }
    sql["volatility"] = _matrix_sql("volatility", out, r1, r2, source="r2")

    walk = {}
    for n in (7, 14, 21):
        for c, x in (("u", "greatest(x.mid_price - x.pm, 0)"), ("d", "greatest(x.pm - x.mid_price, 0)")):
            walk[f"{c}{n}"] = ("NULL", decay(f"e.{c}{n}", f"CASE WHEN x.pm IS NOT NULL THEN {x} END", 1 / n))
    pos = fdiv(f"mid_price - ({roll('min', 'mid_price', 14)})", f"({roll('max', 'mid_price', 14)}) - ({roll('min', 'mid_price', 14)})")
    flow = "mid_price * (mid_price * quantity_sum)"
    m1 = f"m1 AS (SELECT *, {pos} AS pos, {roll('avg', 'mid_price', 20)} AS m20, list(mid_price) {over(20)} AS l20, CASE WHEN mid_price > pm THEN {flow} WHEN pm IS NOT NULL THEN 0.0 END AS fu, CASE WHEN mid_price < pm THEN {flow} WHEN pm IS NOT NULL THEN 0.0 END AS fd FROM e)"
    m2 = f"m2 AS (SELECT *, 100 * pos AS pos100 FROM m1)"
    m3 = f"m3 AS (SELECT *, {roll('avg', 'pos100', 3)} AS k3, list_sum(list_transform(l20, lambda v: abs(v - m20))) / 20.0 AS mad FROM m2)"
    up, down = roll("sum", "fu", 14), roll("sum", "fd", 14)
    out = {f"rsi_{n}": f"CASE WHEN rn >= {n} THEN 100 * ({fdiv(f'u{n}', f'u{n} + d{n}')}) END" for n in (7, 14, 21)}
    out |= {f"roc_{n}s": f"100 * (mid_price - {lag('mid_price', n)}) / {lag('mid_price', n)}" for n in (5, 10, 20)}
    out |= {
        "stoch_k": "k3",
        "stoch_d": roll("avg", "k3", 3),
        "williams_r": "(pos - 1) * 100",
        "cci_20": f"CASE WHEN m20 IS NOT NULL AND list_max(l20) > list_min(l20) THEN {fdiv('mid_price - m20', '0.015::DOUBLE * mad')} END",
        "mfi_14": f"100 * ({fdiv(up, f'({up}) + ({down})')})",
        "momentum_10s": f"mid_price - {lag('mid_price', 10)}",
    }
    sql["momentum"] = _matrix_sql("momentum", out, _walk(walk), m1, m2, m3, source="m3", recursive="RECURSIVE")

    walk = {f"e{n}": ("x.mid_price", decay(f"e.e{n}", "x.mid_price", 2 / (n + 1))) for n in (3, 9, 21, 50, 12, 26)}
    line = f"({walk['e12'][1]}) - ({walk['e26'][1]})"
    walk["sig"] = ("0.0", decay("e.sig", line, 0.2))
    for c, x in (("u", "greatest(x.mid_price - x.pm, 0)"), ("d", "greatest(x.pm - x.mid_price, 0)"), ("r", "abs(x.mid_price - x.pm)")):
        walk[c] = ("NULL", decay(f"e.{c}", f"CASE WHEN x.pm IS NOT NULL THEN {x} END", 1 / 14))
    dx = "dx AS MATERIALIZED (SELECT *, abs(u / nullif(r, 0) - d / nullif(r, 0)) * 100 / CASE WHEN u / r + d / r = 0 THEN 1 ELSE u / nullif(r, 0) + d / nullif(r, 0) END AS dx FROM e)"
    second = f"z AS (SELECT y.*, y.dx AS adx FROM dx y WHERE rn = 0 UNION ALL SELECT y.*, {decay('z.adx', 'y.dx', 1 / 14)} FROM z JOIN dx y ON y.symbol = z.symbol AND y.rn = z.rn + 1)"

    def slope(n: int) -> str:
        center, total = (n + 1) / 2, n * (n * n - 1) / 12
        return f"CASE WHEN len(l{n}) = {n} THEN list_sum(list_transform(l{n}, lambda v, i: (i - {center!r}) * v)) / {total!r} END"

    lists = f"z2 AS (SELECT *, list(mid_price) {over(10)} AS l10, list(mid_price) {over(30)} AS l30 FROM z)"
    out = {f"ema_{n}": f"e{n}" for n in (3, 9, 21, 50)}
    out |= {
        "price_ema3_dist": "(mid_price - e3) / mid_price",
        "price_ema9_dist": "(mid_price - e9) / mid_price",
        "ema3_ema9_dist": "(e3 - e9) / e9",
        "macd": "e12 - e26",
        "macd_signal": "sig",
        "macd_hist": "e12 - e26 - sig",
        "adx": "adx",
        "linreg_slope_10s": slope(10),
        "linreg_slope_30s": slope(30),
    }
    sql["trend"] = _matrix_sql("trend", out, _walk(walk), dx, second, lists, source="z2", recursive="RECURSIVE")

    walk = {
        "m": ("x.mid_price", decay("e.m", "x.mid_price", 2 / 21)),
        "a": ("NULL", decay("e.a", "abs(x.mid_price - x.pm)", 2 / 21)),
    }
    b1 = f"b1 AS (SELECT *, {roll('avg', 'mid_price', 20)} AS m20, {std('mid_price', 20)} AS s20, {roll('max', 'mid_price', 20)} AS hi, {roll('min', 'mid_price', 20)} AS lo FROM e)"
    out = {
        "bb_upper": "m20 + 2 * s20",
        "bb_lower": "m20 - 2 * s20",
        "bb_position": "((mid_price - m20) / nullif(s20, 0) + 2) / 4",
        "bb_middle": "m20",
        "bb_width": "(m20 + 2 * s20) - (m20 - 2 * s20)",
        "kc_upper": "m + 2 * coalesce(a, 0)",
        "kc_lower": "m - 2 * coalesce(a, 0)",
        "kc_position": fdiv("mid_price - (m - 2 * coalesce(a, 0))", "(m + 2 * coalesce(a, 0)) - (m - 2 * coalesce(a, 0))"),
        "donchian_upper": "hi",
        "donchian_lower": "lo",
        "donchian_position": fdiv("mid_price - lo", "hi - lo"),
    }
    sql["bands"] = _matrix_sql("bands", out, _walk(walk), b1, source="b1", recursive="RECURSIVE")

    v1 = "v1 AS (SELECT *, CASE WHEN mid_price > pm THEN quantity_sum ELSE -quantity_sum END AS signed, mid_price * quantity_sum AS mv, (" + " + ".join(f"bid_{i}_qty" for i in range(10)) + ") AS b10, (" + " + ".join(f"ask_{i}_qty" for i in range(10)) + ") AS a10 FROM s)"
    v2 = "v2 AS (SELECT *, sum(signed) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS obv FROM v1)"
    big = f"quantity_sum > ({roll('avg', 'quantity_sum', 100)}) + 2 * ({std('quantity_sum', 100)})"
    out = {
        "obv": "obv",
        "vwma_10": fdiv(roll("sum", "mv", 10), roll("sum", "quantity_sum", 10)),
        "volume_ratio_buy_sell": "buy_volume_1s / (sell_volume_1s + 1e-8)",
        "volume_momentum_10s": fdiv(roll("avg", "quantity_sum", 10), roll("avg", "quantity_sum", 30)),
        "large_order_indicator": f"CASE WHEN {big} THEN 1 ELSE 0 END",
        "bid_cancel_rate": f"abs(least(b10 - {lag('b10')}, 0)) / (b10 + 1e-8)",
        "ask_cancel_rate": f"abs(least(a10 - {lag('a10')}, 0)) / (a10 + 1e-8)",
        "distance_to_round_100": "mid_price % 100",
        "distance_to_round_1000": "mid_price % 1000",
        "at_psychological_level": "CASE WHEN mid_price % 100 < 1 OR mid_price % 1000 < 10 THEN 1 ELSE 0 END",
        "momentum_divergence": f"CASE WHEN sign(mid_price - {lag('mid_price', 10)}) = sign({roll('sum', 'signed', 10)}) THEN 0 ELSE 1 END",
        "hour_sin": "sin(2 * pi() * hour(ts) / 24)",
        "hour_cos": "cos(2 * pi() * hour(ts) / 24)",
        "is_asian_session": "CASE WHEN hour(ts) < 8 THEN 1 ELSE 0 END",
        "is_european_session": "CASE WHEN hour(ts) BETWEEN 8 AND 15 THEN 1 ELSE 0 END",
        "is_us_session": "CASE WHEN hour(ts) >= 16 THEN 1 ELSE 0 END",
    }
    sql["volume_psychology"] = _matrix_sql("volume_psychology", out, v1, v2, source="v2")
    return {f"matrix_{c}": text for c, text in sql.items()}


def _walk(state: dict[str, tuple[str, str]]) -> str:
    first = ", ".join(f"({init})::DOUBLE AS {c}" for c, (init, _) in state.items())
    then = ", ".join(f"({step})::DOUBLE" for _, step in state.values())
    return f"""e AS (SELECT x.*, {first} FROM s x WHERE rn = 0 UNION ALL
  SELECT x.*, {then} FROM e JOIN s x ON x.symbol = e.symbol AND x.rn = e.rn + 1)"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    def bar_query(seconds: int) -> str:
        fills = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("buy_volume", "sell_volume", "buy_count", "sell_count"))
        return (
            f"WITH {bars(seconds)}, z AS (SELECT symbol, t, open, high, low, close, volume, vwap, trade_count, {fills} FROM b) "
            f"SELECT {', '.join(BAR_EXACT)}, t, {_grid_list(BAR_ROUNDED)} FROM z"
        )

    sql["trade_bars"] = bar_query(3600)
    sql["trade_bars_five_minutes"] = bar_query(FIVE_MINUTES)
    sides = []
    for side in ("buy", "sell"):
        for part in ("volume", "count"):
            c = f"{side}_{part}"
            sides.append(
                f"CASE WHEN {side}_more THEN coalesce({c}, 0) ELSE coalesce(last_value(nullif({c}, 0) IGNORE NULLS) OVER w, 0) END AS {c}"
            )
    more = ", ".join(
        f"coalesce(bool_or({side}_count > 0) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false) AS {side}_more"
        for side in ("buy", "sell")
    )
    sql["trade_bars_side_edges"] = (
        f"WITH {bars(FIVE_MINUTES)}, m AS (SELECT *, {more} FROM b), z AS (SELECT symbol, t, {', '.join(sides)} FROM m "
        f"WINDOW w AS (PARTITION BY symbol ORDER BY rn)) SELECT symbol, t, buy_count, sell_count, {_grid_list(['buy_volume', 'sell_volume'])} FROM z"
    )
    seconds = """sec AS (SELECT symbol, epoch_us(ts) // 1000000 AS t, first(price ORDER BY ts, trade_id) AS price_first,
  last(price ORDER BY ts, trade_id) AS price_last, avg(price) AS price_mean, stddev_samp(price) AS price_std,
  sum(quantity) AS quantity_sum, count(*) AS quantity_count, sum(is_buyer_maker::BIGINT)::BIGINT AS is_buyer_maker_sum,
  count(*) AS is_buyer_maker_count, sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE 0.0 END) AS buy_volume,
  sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0.0 END) AS sell_volume FROM t GROUP BY 1, 2)"""
    sql["second_trades"] = (
        f"WITH {TRADES}, {seconds}, z AS (SELECT *, (buy_volume - sell_volume) / quantity_sum AS trade_imbalance FROM sec) "
        f"SELECT {', '.join(SECOND_EXACT)}, t, {_grid_list(SECOND_ROUNDED)} FROM z"
    )

    def book_agg(seconds: int) -> str:
        last = ", ".join(f"last({c} ORDER BY ts, update_id) AS {c}" for c in b.BOOK_LAST)
        mean = ", ".join(f"avg({c}) AS {c}" for c in b.BOOK_MEAN)
        return f"bb AS (SELECT symbol, epoch_us(ts) // {seconds * 1_000_000} * {seconds} AS t, {last}, {mean} FROM book GROUP BY 1, 2)"

    sql["book_bars"] = f"WITH {BOOK}, {book_agg(3600)} SELECT symbol, t, {_grid_list(BOOK_COLUMNS)} FROM bb"
    columns = ["trade_count", "buy_count", "sell_count", "close", "volume", "mid_price", "best_bid", "best_ask", "spread", "order_imbalance"]
    fills = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER w, 0) AS {c}" for c in columns)
    sql["joined_bars"] = (
        f"WITH {bars(2 * FIVE_MINUTES)}, {BOOK}, {book_agg(FIVE_MINUTES)}, "
        "z0 AS (SELECT symbol, t, coalesce(trade_count, 0) AS trade_count, coalesce(buy_count, 0) AS buy_count, coalesce(sell_count, 0) AS sell_count, close, volume FROM b), "
        f"j AS (SELECT * FROM z0 FULL JOIN bb USING (symbol, t)), f AS (SELECT symbol, t, {fills} FROM j WINDOW w AS (PARTITION BY symbol ORDER BY t)) "
        f"SELECT {', '.join(BAR_EXACT)}, t, {_grid_list(columns[3:])} FROM f"
    )
    book_fill = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER w, 0) AS {c}" for c in SNAP_COLUMNS[:4])
    snap = (
        f"WITH {TRADES}, {BOOK}, {seconds}, lastbook AS (SELECT symbol, epoch_us(ts) AS us, last(mid_price ORDER BY update_id) AS mid_price, last(best_bid ORDER BY update_id) AS best_bid,"
        " last(best_ask ORDER BY update_id) AS best_ask, last(spread ORDER BY update_id) AS spread FROM book GROUP BY 1, 2), "
        "st AS (SELECT symbol, t * 1000000 AS us, quantity_sum, price_last, true AS trade FROM sec), "
        "j AS (SELECT * FROM lastbook FULL JOIN st USING (symbol, us)), "
        f"f AS (SELECT symbol, us, trade, {book_fill}, coalesce(quantity_sum, 0) AS quantity_sum, coalesce(price_last, 0) AS price_last FROM j WINDOW w AS (PARTITION BY symbol ORDER BY us)) "
        f"SELECT symbol, us, {_grid_list(SNAP_COLUMNS)} FROM f"
    )
    sql["snapshot_join"] = snap
    sql["snapshot_join_as_of"] = snap + " WHERE trade"
    sql["top_of_book"] = f"WITH {BOOK} SELECT symbol, update_id, {_grid_list(['best_bid', 'best_ask', 'mid_price', 'spread', 'spread_pct'])} FROM book"
    sql["book_depth"] = f"WITH {BOOK} SELECT symbol, update_id, {_grid_list(['bid_volume_5', 'ask_volume_5', 'bid_volume_10', 'ask_volume_10', 'order_imbalance'])} FROM book"
    sql["book_ladder"] = f"WITH {BOOK} SELECT symbol, update_id, {_grid_list(['imbalance_5', *LADDER])} FROM book"
    depth = ", ".join(f"{side}_{i}_price * {side}_{i}_qty AS {side}_depth_{i}" for side in ("bid", "ask") for i in range(5))
    totals = ", ".join(f"{' + '.join(f'{side}_depth_{i}' for i in range(5))} AS total_{side}_depth" for side in ("bid", "ask"))
    notional = f"n1 AS (SELECT *, {depth} FROM {{src}}), n2 AS (SELECT *, {totals} FROM n1), n3 AS (SELECT *, (total_bid_depth - total_ask_depth) / (total_bid_depth + total_ask_depth) AS depth_imbalance FROM n2)"
    sql["depth_notional"] = f"WITH {BOOK}, {notional.format(src='book')} SELECT symbol, update_id, {_grid_list(NOTIONAL, 5)} FROM n3"
    deltas = " UNION ALL ".join(
        f"SELECT event_type AS symbol, ts, event_id AS update_id, '{side}' AS side, {_level(sign, i)} AS price, "
        f"CASE WHEN (event_id + {i}) % 5 = 0 THEN 0.0 ELSE {_qty(side, i)} END AS qty FROM events"
        for side, sign in (("bid", -1), ("ask", 1))
        for i in range(k.LEVELS)
    )
    def listed(every: int, levels: int) -> str:
        size = every * 1_000_000
        rank = "CASE WHEN side = 'bid' THEN -price ELSE price END"
        return f"""d AS MATERIALIZED ({deltas}),
x AS (SELECT *, (epoch_us(ts) + {size - 1}) // {size} AS p FROM d),
l AS MATERIALIZED (SELECT symbol, side, price, p, last(qty ORDER BY ts, update_id) AS qty FROM x GROUP BY 1, 2, 3, 4),
sp AS (SELECT *, coalesce(lead(p) OVER (PARTITION BY symbol, side, price ORDER BY p), 1e15::BIGINT) AS q FROM l),
pts AS (SELECT symbol, p AS pt, coalesce(lead(p) OVER (PARTITION BY symbol ORDER BY p) - 1, p) AS until FROM (SELECT DISTINCT symbol, p FROM l)),
best AS MATERIALIZED (SELECT pts.symbol, pt, until, side, min({{'r': {rank}, 'price': price, 'qty': qty}}, {levels}) AS top
  FROM pts JOIN sp ON sp.symbol = pts.symbol AND pt >= p AND pt < q WHERE qty > 0 GROUP BY 1, 2, 3, 4),
paired AS (SELECT *, count(*) OVER (PARTITION BY symbol, pt) AS sides FROM best),
li AS (SELECT symbol, pt, until, side, unnest(range(len(top))) AS level, unnest(top) AS e FROM paired WHERE sides = 2)"""

    shown = f"side, level, {sql_grid('e.price', 6)} AS price, {sql_grid('e.qty', 6)} AS qty"
    for name, every in (("book_reconstruction", 1), ("book_reconstruction_daily", 86400)):
        sql[name] = f"WITH {listed(every, k.LEVELS)} SELECT symbol, pt * {every} AS t, until * {every} AS until, {shown} FROM li"
    sql["book_reconstruction_dense"] = (
        f"WITH {listed(3600, 2)} SELECT symbol, s * 3600 AS t, {shown} FROM (SELECT *, unnest(range(pt, until + 1)) AS s FROM li)"
    )
    flow_cols = ["mid_price", "buy_volume_1s", "sell_volume_1s", "vwap_1s"]
    sql["trailing_flow"] = f"WITH {SNAPSHOTS} SELECT symbol, update_id, {_grid_list(flow_cols)} FROM s"
    hourly = SNAPSHOTS.replace(FLOW.format(ms=1000), FLOW.format(ms=3_600_000))
    sql["trailing_flow_hour"] = f"WITH {hourly} SELECT symbol, update_id, {_grid_list(flow_cols)} FROM s"
    ratios = "best_bid / best_ask AS bid_ask_ratio, ln(mid_price) AS log_mid_price, mid_price - pm AS mid_price_change, mid_price / pm - 1 AS mid_price_pct_change"
    sql["time_parts"] = (
        f"WITH {SNAPSHOTS}, z AS (SELECT *, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second, isodow(ts) - 1 AS day_of_week, {ratios} FROM s) "
        f"SELECT symbol, update_id, {', '.join(TIME_COLUMNS)}, {_grid_list(RATIOS)} FROM z"
    )
    rolled = ", ".join(
        f"{roll('avg', 'mid_price', n)} AS mid_price_mean_{n}s, {std('mid_price', n)} AS mid_price_std_{n}s, "
        f"{roll('avg', 'spread', n)} AS spread_mean_{n}s, {roll('sum', 'quantity_sum', n)} AS volume_sum_{n}s"
        for n in snapshots.ROLLING_SECONDS
    )
    sql["rolling_rows"] = f"WITH {SNAPSHOTS}, z AS (SELECT *, {rolled} FROM s) SELECT symbol, update_id, {_grid_list(ROLLING)} FROM z"
    chosen = [c for c in (*RATIOS, *NOTIONAL, *ROLLING) if not ("bid_" in c or "ask_" in c) or "depth" in c or "ratio" in c]
    sql["complete_rows"] = (
        f"WITH {SNAPSHOTS}, y AS (SELECT *, {ratios}, {rolled} FROM s), {notional.format(src='y')} "
        f"SELECT symbol, update_id, {_grid_list(chosen, 5)} FROM n3 WHERE rn >= 299"
    )
    sql["quality_report"] = f"""WITH {BOOK}, g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY ts)) / 1e6 AS gap FROM book),
r AS (SELECT symbol, count(*) AS rows, min(mid_price) AS min_mid_price, max(spread_pct) AS max_spread_pct, max(gap) AS max_gap_seconds, 0.0 AS null_share FROM g GROUP BY 1)
SELECT symbol, rows, {_grid_list(['min_mid_price', 'max_spread_pct', 'max_gap_seconds', 'null_share'])},
 CASE WHEN rows < 1000 OR min_mid_price <= 0 THEN 'fail' WHEN max_spread_pct > 10 OR max_gap_seconds > 300 THEN 'warn' ELSE 'pass' END AS verdict FROM r"""
    sql["chronological_split"] = f"""WITH {bars()}, n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM b)
SELECT symbol, t, CASE WHEN rn < floor(n * 0.8) THEN 'train' WHEN rn < floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM n"""
    columns = ["open", "high", "low", "close", "volume", "vwap", "buy_volume", "sell_volume"]
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp(coalesce({c}, 0)) AS variance FROM b" for c in columns)
    sql["variance_selection"] = f"WITH {bars()}, v AS ({parts}) SELECT feature, {sql_grid('variance', 4)} AS variance FROM v ORDER BY v.variance DESC, feature LIMIT 5"
    per_column = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS rows, corr({c}, target) AS correlation FROM y WHERE {c} IS NOT NULL" for c in CORRELATED
    )
    ahead = "coalesce(lead(mid_price) OVER (PARTITION BY symbol ORDER BY rn) / mid_price - 1, 0)"
    sql["target_correlation"] = (
        f"WITH {SNAPSHOTS}, y AS (SELECT *, {ahead} AS target FROM s), z AS ({per_column}) "
        f"SELECT feature, rows, {sql_grid('correlation', 6)} AS correlation FROM z WHERE correlation IS NOT NULL "
        "ORDER BY abs(z.correlation) DESC, feature LIMIT 5"
    )
    sql["model_selection"] = _boosting_sql(f"{SNAPSHOTS}, y0 AS (SELECT *, {ahead} AS target FROM s)", "y0")
    sql["forward_return"] = f"WITH {SNAPSHOTS} SELECT symbol, update_id, {sql_grid('coalesce(lead(mid_price) OVER (PARTITION BY symbol ORDER BY rn) / mid_price - 1, 0)', 5)} AS target FROM s"
    good = "update_id % 37 <> 5 AND update_id % 29 <> 2 AND update_id % 31 <> 3"
    sql["daily_job"] = f"""WITH {BOOK}, {TRADES},
gt AS (SELECT symbol, ts, quantity FROM t WHERE trade_id % 23 <> 7 AND trade_id % 41 <> 1), gb AS (SELECT * FROM book WHERE {good}),
dt AS (SELECT CAST(ts AS DATE) AS d, symbol, epoch_us(ts) // 3600000000 AS slot, quantity FROM gt), db AS (SELECT CAST(ts AS DATE) AS d, symbol, epoch_us(ts) // 3600000000 AS slot, best_ask, ts, update_id FROM gb),
both_ AS (SELECT DISTINCT d FROM dt SEMI JOIN db USING (d)),
spans AS (SELECT d, symbol, unnest(generate_series(min(slot), max(slot))) AS slot FROM dt GROUP BY d, symbol),
slots AS (SELECT * FROM spans UNION SELECT d, symbol, slot FROM db),
tc AS (SELECT d, symbol, slot, sum(quantity) AS q, count(*) AS k FROM dt GROUP BY ALL),
bc AS (SELECT d, symbol, slot, last(best_ask ORDER BY ts, update_id) AS ask FROM db GROUP BY ALL),
tb AS (SELECT d, symbol, slot, coalesce(q, 0) AS q, coalesce(k, 0) AS k FROM spans LEFT JOIN tc USING (d, symbol, slot)),
filled AS (SELECT d, coalesce(last_value(q IGNORE NULLS) OVER w, 0) AS q, coalesce(last_value(k IGNORE NULLS) OVER w, 0) AS k, ask
  FROM slots LEFT JOIN tb USING (d, symbol, slot) LEFT JOIN bc USING (d, symbol, slot) WINDOW w AS (PARTITION BY d, symbol ORDER BY slot)),
out AS (SELECT d, count(*) AS rows, sum(q) AS volume, max(coalesce(ask, 0)) AS best_ask, count(*) FILTER (k = 0) AS quiet FROM filled SEMI JOIN both_ USING (d) GROUP BY 1),
days AS (SELECT CAST(unnest(generate_series(DATE '{DAYS[0]}', DATE '{DAYS[1]}', INTERVAL 1 DAY)) AS DATE) AS d),
lines AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1), nt AS (SELECT d, count(*) AS n FROM dt GROUP BY 1), nb AS (SELECT d, count(*) AS n FROM db GROUP BY 1)
SELECT strftime(days.d, '%Y-%m-%d') AS day, coalesce(lines.n, 0) AS trade_lines, coalesce(nt.n, 0) AS trades, coalesce(lines.n, 0) AS book_lines, coalesce(nb.n, 0) AS snapshots,
  coalesce(rows, 0) AS rows, CASE WHEN rows > 0 THEN 'done' ELSE 'missing' END AS status, quiet, {sql_grid('volume', 4)} AS volume, {sql_grid('best_ask', 4)} AS best_ask
FROM days LEFT JOIN out ON out.d = days.d LEFT JOIN lines ON lines.d = days.d LEFT JOIN nt ON nt.d = days.d LEFT JOIN nb ON nb.d = days.d"""
    sql["parse_book_lines"] = f"WITH {BOOK} SELECT symbol, update_id, epoch_us(ts) // 1000 AS ms, {_grid_list(['mid_price', 'spread', 'bid_volume_5', 'ask_volume_10', 'order_imbalance'])} FROM book WHERE {good}"
    sql["parse_trade_lines"] = f"WITH {TRADES} SELECT symbol, trade_id, epoch_us(ts) // 1000 AS ms, {_grid_list(['price', 'quantity'])}, is_buyer_maker FROM t WHERE trade_id % 23 <> 7 AND trade_id % 41 <> 1"
    sql["line_rejects"] = f"WITH {BOOK} SELECT count(*) AS lines, count(*) FILTER ({good}) AS kept, count(*) FILTER (NOT ({good})) AS dropped FROM book"
    sql["combined_files"] = f"""WITH {TRADES}, u AS (SELECT symbol, date_trunc('minute', ts) AS m, trade_id, price, 1 AS file FROM t WHERE hour(ts) < 14
UNION ALL SELECT symbol, date_trunc('minute', ts), trade_id, price + 1, 2 FROM t WHERE hour(ts) >= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, m ORDER BY file DESC, trade_id DESC) AS k FROM u)
SELECT symbol, epoch_us(m) // 1000000 AS t, trade_id, file, {sql_grid('price')} AS price FROM r WHERE k = 1"""
    sql["raw_paths"] = f"WITH {TRADES} SELECT year(ts) AS year, month(ts) AS month, day(ts) AS day, CASE WHEN trade_id % 2 = 0 THEN 'orderbook' ELSE 'trades' END AS kind, count(*) AS files FROM t GROUP BY 1, 2, 3, 4"
    sql["day_status"] = f"""WITH {bars()}, d AS (SELECT unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY))::DATE AS dd),
c AS (SELECT (make_timestamp(t * 1000000))::DATE AS dd, count(*) AS rows FROM b GROUP BY 1)
SELECT strftime(d.dd, '%Y-%m-%d') AS day, coalesce(rows, 0) AS rows, CASE WHEN rows IS NULL THEN 'missing' ELSE 'done' END AS status FROM d LEFT JOIN c USING (dd)"""
    return {f"market_{name}": text for name, text in sql.items()} | _ms()
