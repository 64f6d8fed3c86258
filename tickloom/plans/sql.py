"""Pieces of the comparison SQL."""

from __future__ import annotations

GRID_SHIFT = "0.3183098861"


def grid(expr: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"floor(({expr}) * {scale} + {GRID_SHIFT}) / {scale}"


def sci(expr: str, digits: int = 6) -> str:
    return f"CASE WHEN ({expr}) IS NOT NULL THEN printf('%.{digits}e', {expr}) END"


def fdiv(a: str, b: str) -> str:
    return (
        f"CASE WHEN ({b}) = 0 THEN CASE WHEN ({a}) > 0 THEN 'inf'::DOUBLE WHEN ({a}) < 0 THEN '-inf'::DOUBLE END "
        f"ELSE ({a}) / ({b}) END"
    )


def finite(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN {x} END"


def over(n: int, key: str = "symbol", order: str = "rn") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, key: str = "symbol", order: str = "rn") -> str:
    w = over(n, key, order)
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


def std(x: str, n: int, key: str = "symbol", order: str = "rn") -> str:
    """Sample deviation, exactly 0 on a constant window."""
    w = over(n, key, order)
    return (
        f"CASE WHEN count({x}) {w} = {n} THEN "
        f"CASE WHEN max({x}) {w} = min({x}) {w} THEN 0.0 ELSE stddev_samp({x}) {w} END END"
    )


def lag(x: str, n: int = 1, key: str = "symbol", order: str = "rn") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {key} ORDER BY {order})"


def decay(previous: str, x: str, alpha: float) -> str:
    """One step of an exponential mean."""
    return (
        f"CASE WHEN ({x}) IS NULL THEN {previous} WHEN {previous} IS NULL THEN {x} "
        f"ELSE {previous} * {1 - alpha!r} + ({x}) * {alpha!r} END"
    )


TRADES = """t AS (
  SELECT event_type AS symbol, ts, event_id AS trade_id, value AS price,
         (event_id % 97 + 1)::DOUBLE / 10.0::DOUBLE AS quantity,
         (event_id * 7) % 3 = 0 AS is_buyer_maker
  FROM events)"""


def bars(seconds: int = 3600) -> str:
    return f"""{TRADES},
filled AS (
  SELECT symbol, epoch_us(ts) // {seconds * 1_000_000} AS slot,
         first(price ORDER BY ts, trade_id) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts, trade_id) AS close, sum(quantity) AS volume, count(*) AS trade_count,
         sum(CASE WHEN NOT is_buyer_maker THEN quantity END) AS buy_volume,
         sum(CASE WHEN is_buyer_maker THEN quantity END) AS sell_volume,
         count(CASE WHEN NOT is_buyer_maker THEN 1 END) AS buy_count,
         count(CASE WHEN is_buyer_maker THEN 1 END) AS sell_count,
         sum(price * quantity) / sum(quantity) AS vwap
  FROM t GROUP BY 1, 2),
calendar AS (
  SELECT symbol, unnest(generate_series(min(slot), max(slot))) AS slot FROM filled GROUP BY symbol),
b AS MATERIALIZED (
  SELECT symbol, slot, slot * {seconds} AS t,
         row_number() OVER (PARTITION BY symbol ORDER BY slot) - 1 AS rn,
         last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high,
         last_value(low IGNORE NULLS) OVER w AS low, last_value(close IGNORE NULLS) OVER w AS close,
         coalesce(volume, 0) AS volume, coalesce(trade_count, 0) AS trade_count,
         buy_volume, sell_volume, buy_count, sell_count,
         last_value(vwap IGNORE NULLS) OVER w AS vwap
  FROM calendar LEFT JOIN filled USING (symbol, slot)
  WINDOW w AS (PARTITION BY symbol ORDER BY slot)),
p AS MATERIALIZED (
  SELECT *, {lag("close")} AS pc, {lag("high")} AS ph, {lag("low")} AS pl, {lag("volume")} AS pv,
         greatest(high - low, abs(high - {lag("close")}), abs(low - {lag("close")})) AS tr,
         (high + low + close) / 3 AS tp, (high + low) / 2 AS mp
  FROM b)"""
