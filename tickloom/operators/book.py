"""Order-book rows: features of one snapshot, reconstruction from deltas, and
the trade flow just before a snapshot."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import fdiv
from tickloom.operators.blocks import BLOCK, SLOT, Series, gather, join_on
from tickloom.session import materialize

LEVELS = 20


def depth(levels: Column, n: int) -> Column:
    """Quantity of the first n levels."""
    return F.aggregate(F.slice(levels, 1, n), F.lit(0.0), lambda total, level: total + level["qty"])


def imbalance(bid: Column, ask: Column) -> Column:
    """(bid - ask) / (bid + ask), 0 on an empty book."""
    return F.when(bid + ask > 0, F.try_divide(bid - ask, bid + ask)).otherwise(F.lit(0.0))


def top_of_book(df: DataFrame) -> DataFrame:
    """Best prices, mid and spread from `bids` and `asks`, best level first."""
    bid = F.coalesce(F.get("bids", F.lit(0))["price"], F.lit(0.0))
    ask = F.coalesce(F.get("asks", F.lit(0))["price"], F.lit(0.0))
    two_sided = (F.col("best_bid") != 0) & (F.col("best_ask") != 0)
    quoted = df.withColumns({"best_bid": bid, "best_ask": ask}).withColumns(
        {
            "mid_price": F.when(two_sided, (F.col("best_bid") + F.col("best_ask")) / 2).otherwise(0.0),
            "spread": F.when(two_sided, F.col("best_ask") - F.col("best_bid")).otherwise(0.0),
        }
    )
    share = F.when(F.col("mid_price") > 0, F.try_divide(F.col("spread"), F.col("mid_price")) * 100).otherwise(0.0)
    return quoted.withColumn("spread_pct", share)


def depth_features(df: DataFrame) -> DataFrame:
    """Depth of 5 and 10 levels and the imbalance over 10 levels."""
    sums = {f"{side}_volume_{n}": depth(F.col(f"{side}s"), n) for n in (5, 10) for side in ("bid", "ask")}
    return df.withColumns(sums).withColumn("order_imbalance", imbalance(F.col("bid_volume_10"), F.col("ask_volume_10")))


def flatten_ladder(df: DataFrame, levels: int = LEVELS) -> DataFrame:
    """bid_i_price, bid_i_qty, ask_i_price, ask_i_qty; missing levels are NULL."""
    flat = {
        f"{side}_{i}_{part}": F.get(f"{side}s", F.lit(i))[part]
        for i in range(levels)
        for side in ("bid", "ask")
        for part in ("price", "qty")
    }
    return df.withColumns(flat)


def snapshot_features(df: DataFrame) -> DataFrame:
    """A one-second snapshot row as the collector writes it: quotes, imbalance
    over 5 levels and the flat ladder."""
    quoted = top_of_book(df).withColumn("imbalance_5", imbalance(depth(F.col("bids"), 5), depth(F.col("asks"), 5)))
    return flatten_ladder(quoted)


def depth_notional(df: DataFrame, levels: int = 5) -> DataFrame:
    """price * qty per level, their totals and the imbalance of the totals."""
    parts = {
        f"{side}_depth_{i}": F.col(f"{side}_{i}_price") * F.col(f"{side}_{i}_qty")
        for side in ("bid", "ask")
        for i in range(levels)
    }

    def total(side: str) -> Column:
        out = F.col(f"{side}_depth_0")
        for i in range(1, levels):
            out = out + F.col(f"{side}_depth_{i}")
        return out

    made = df.withColumns(parts).withColumns({"total_bid_depth": total("bid"), "total_ask_depth": total("ask")})
    bid, ask = F.col("total_bid_depth"), F.col("total_ask_depth")
    return made.withColumn("depth_imbalance", fdiv(bid - ask, bid + ask))


def time_parts(df: DataFrame, time: str = "ts") -> DataFrame:
    """hour, minute, second and day_of_week with Monday = 0."""
    return df.withColumns(
        {
            "hour": F.hour(time),
            "minute": F.minute(time),
            "second": F.second(time),
            "day_of_week": F.weekday(time),
        }
    )


def select_features(columns: Sequence[str]) -> list[str]:
    """Leave out raw ladder columns: names with bid_ or ask_, unless they hold
    depth or ratio."""
    return [
        c for c in columns if not ("bid_" in c or "ask_" in c) or "depth" in c or "ratio" in c
    ]


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the last in the given order.

    Aggregated as one struct, so copies of a row merge before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("_row"))
    return picked.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


BOOK_ROWS = 32768
RUN_ROWS = 65536
EVER = (1 << 63) - 1
# A series is cut into so many units, and the cut of a unit comes from so many units before it.
UNITS = 128
REACHES = (32, 4, 1)


def reconstruct(
    deltas: DataFrame,
    every: int = 1,
    levels: int = LEVELS,
    *,
    keys: Sequence[str] = ("symbol",),
    block_rows: int = BOOK_ROWS,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """The best levels of both sides after every grid point that has a delta.

    `deltas` has (ts, update_id, side, price, qty), side being bid or ask and
    qty 0 removing the level. A listing holds until `valid_until`, the point
    before the next delta (its own point for the last one); `dense_book` repeats
    it in between. Points where a side has no level are left out.

    A series is cut into blocks of about `block_rows` level changes; as many as
    make up `run_rows` are walked together. Each run gets the levels that are open
    where it begins and is walked in order, so what is handled grows with the
    changes, not with seconds times levels.

    Of a run, changes deeper than a cut are left out: no listing shows them as long
    as `levels` levels up to the cut are open at each of its points, which the walk
    sees. Runs of which that does not hold are walked again with a deeper cut, at last
    with none. `deltas` is read three times; only what lies above the cuts is shuffled.
    """
    period = every * 1_000_000
    level = [*keys, "side", "price"]
    point = F.ceil(F.unix_micros("ts") / F.lit(period)).cast("long")
    chunk = F.floor(F.col("_point") / 4096)
    size = block_rows * max(run_rows // block_rows, 1)

    # Runs from counts: changes per chunk of time are summed first, then those inside the chunk.
    counts = deltas.groupBy(*keys, point.alias("_point")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_chunk", chunk)
    ahead = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = counts.groupBy(*keys, "_chunk").agg(F.sum("_n").alias("_sum"))
    chunks = chunks.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_point").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_n").over(inside), F.lit(0))
    homes = join_on(counts.withColumn("_earlier", earlier), chunks, [*keys, "_chunk"]).select(
        *keys, "_chunk", "_point", F.floor((F.col("_before") + F.col("_earlier")) / size).alias("_number")
    )
    # The points of a run, a row for each chunk they lie in, and the first points of each run and the next.
    begun = materialize(homes.groupBy(*keys, "_chunk", "_number").agg(F.sort_array(F.collect_list("_point")).alias("_points")))
    in_order = Window.partitionBy(*keys).orderBy("_number")
    table = begun.groupBy(*keys, "_number").agg(F.min(F.get("_points", F.lit(0))).alias("_first"))
    row = (F.row_number().over(in_order) - 1).cast("long")
    unit = F.floor((F.row_number().over(in_order) - 1) / F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / UNITS)).cast("long")
    table = materialize(table.select(*keys, "_number", row.alias(BLOCK), unit.alias("_unit"), "_first", F.lead("_first").over(in_order).alias("_next")))
    begun = join_on(begun, table.select(*keys, "_number", BLOCK, "_unit", "_first"), [*keys, "_number"]).drop("_number")
    table = table.drop("_number")
    runs, width = _runs(begun, keys)

    # A rank grows from the best level on, on both sides.
    bid = F.coalesce(F.col("side") == "bid", F.lit(False))
    rank = F.when(bid, -F.col("price")).otherwise(F.col("price"))
    changes = deltas.select(*level, "qty", "ts", "update_id", point.alias("_point"), bid.alias("_bid"), rank.alias("_rank"))
    changes = changes.withColumn("_chunk", F.floor(F.col("_point") / width))
    at = F.coalesce("_point", F.lit(-EVER))

    def placed(runs: DataFrame, *columns: str) -> DataFrame:
        return join_on(changes, runs, [*keys, *columns, "_chunk"]).where((at >= F.col("_from")) & (at < F.col("_to"))).drop("_chunk", "_from", "_to")

    def listings(kept: DataFrame, entering: DataFrame | None, cuts: DataFrame | None) -> DataFrame:
        # Rows of each run that are no level: where the next one begins and its cuts, and its points.
        head = table.drop("_first", "_unit")
        if cuts is not None:
            of = {c: F.max(F.when(F.col("_bid") == (c == "_bid_cut"), F.col("_cut"))).alias(c) for c in ("_bid_cut", "_ask_cut")}
            head = join_on(head, cuts.groupBy(*keys, BLOCK).agg(*of.values()), [*keys, BLOCK])
        rest = head.unionByName(begun.select(*keys, BLOCK, "_points"), allowMissingColumns=True)
        if entering is not None:
            rest = entering.unionByName(rest, allowMissingColumns=True)
        typed = {"_bid": "boolean", "_rank": "double", "qty": "double", "_bid_cut": "double", "_ask_cut": "double"}
        rest = rest.withColumns({c: F.lit(None).cast(t) for c, t in typed.items() if c not in rest.columns})
        rows = kept.select(*keys, BLOCK, "_point", "ts", "update_id", "_bid", "_rank", "qty")
        ladder = [f"{side}_{part}" for side in ("bid", "ask") for part in ("rank", "qty")]
        schema = T.StructType(
            [
                *(rows.schema[c] for c in keys),
                T.StructField(BLOCK, T.LongType()),
                *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("_at", "_until")),
                *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ladder),
                T.StructField("_short", T.BooleanType()),
            ]
        )

        def walk(changes: pa.Table, rest: pa.Table) -> pa.Table:
            made = walk_run(changes, rest, levels)
            named = {c: rest.column(c).take(pa.array(np.zeros(len(made[0]), np.int64))) for c in (*keys, BLOCK)}
            return pa.table({**named, **dict(zip(["_at", "_until", *ladder, "_short"], made, strict=True))}, schema=pa.schema([(f.name, pa_type(f, rest)) for f in schema]))

        def pa_type(f: T.StructField, rest: pa.Table) -> pa.DataType:
            if f.name in (*keys, BLOCK):
                return rest.schema.field(f.name).type
            return {"_short": pa.bool_(), "_at": pa.list_(pa.int64()), "_until": pa.list_(pa.int64())}.get(f.name, pa.list_(pa.float64()))

        return rows.groupBy(*keys, BLOCK).cogroup(rest.groupBy(*keys, BLOCK)).applyInArrow(walk, schema)

    if (table.agg(F.max(BLOCK)).first()[0] or 0) == 0:
        made = listings(placed(runs), None, None)
    else:
        cuts = materialize(_cuts(placed(runs), table, levels, keys))
        while True:
            later = Window.partitionBy(*keys, "_bid").orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
            # A change that a later run can ask for is kept as well.
            bounds = cuts.select(*keys, BLOCK, "_bid", "_cut", F.greatest("_cut", F.max("_cut").over(later)).alias("_most"))
            known = materialize(join_on(runs.drop("_first", "_unit"), bounds, [*keys, BLOCK]))
            above = placed(known, "_bid").where((F.col("_most") == float("inf")) | (F.col("_rank") <= F.col("_most"))).drop("_most")
            kept = materialize(above)
            near = kept.where((F.col("_cut") == float("inf")) | (F.col("_rank") <= F.col("_cut")))
            made = materialize(listings(near, _entering(kept, table, levels, keys, bid, rank), cuts))
            short = made.where("_short").select(*keys, BLOCK, F.lit(True).alias("_failed")).distinct()
            if short.isEmpty():
                break
            failed = join_on(cuts, short, [*keys, BLOCK], "left")
            others = F.when(F.col("_failed") & (F.size("_cuts") > 1), F.slice("_cuts", 2, len(REACHES) + 1)).otherwise(F.col("_cuts"))
            cuts = materialize(failed.withColumn("_cuts", others).withColumn("_cut", F.get("_cuts", F.lit(0))).drop("_failed"))
    sides = F.array(
        *(
            F.struct(F.lit(side).alias("side"), F.lit(sign).alias("sign"), F.arrays_zip(F.col(f"{side}_rank").alias("rank"), F.col(f"{side}_qty").alias("qty")).alias("of"))
            for side, sign in (("bid", -1.0), ("ask", 1.0))
        )
    )
    each = made.select(*keys, F.arrays_zip("_at", "_until").alias("_spans"), F.inline(sides)).select(*keys, "_spans", "side", "sign", F.posexplode("of").alias("level", "at"))
    each = each.select(*keys, "side", "level", (F.col("sign") * F.col("at.rank")).alias("price"), F.col("at.qty").alias("qty"), F.inline("_spans"))
    return each.select(
        *keys,
        F.timestamp_micros(F.col("_at") * period).alias("ts"),
        "side",
        "level",
        "price",
        "qty",
        F.timestamp_micros(F.col("_until") * period).alias("valid_until"),
    )


def _runs(begun: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """The runs of each chunk of points, each from its first point there to that of the next run, and the width of the
    chunks, such that few runs share one. Few rows, so they go to the changes."""
    chunks = begun.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)), F.sum("_n")).first()
    width = max(4096 >> ((chunks[1] or 0) // max(chunks[0], 1)).bit_length() - 1, 1) if chunks[1] else 4096
    points = begun.select(*keys, BLOCK, "_unit", "_first", F.explode_outer("_points").alias("_point"))
    inside = points.groupBy(*keys, F.floor(F.col("_point") / width).alias("_chunk"), BLOCK, "_unit").agg(F.min("_point").alias("_from"), F.min("_first").alias("_first"))
    in_order = Window.partitionBy(*keys, "_chunk").orderBy(BLOCK)
    begins = F.when(F.row_number().over(in_order) == 1, F.lit(-EVER)).otherwise(F.col("_from"))
    ends = F.coalesce(F.lead("_from").over(in_order), F.lit(EVER))
    # Where a series begins, its first point stands for a run before.
    first = F.when(F.col(BLOCK) == 0, F.col("_first"))
    return materialize(inside.select(*keys, "_chunk", BLOCK, "_unit", first.alias("_first"), begins.alias("_from"), ends.alias("_to"))), width


def _cuts(placed: DataFrame, table: DataFrame, levels: int, keys: Sequence[str]) -> DataFrame:
    """Ranks for each run and side (`_bid`) above which enough levels were opened in the units before.

    `_cuts` has them from the nearest on, the last of them infinite; `_cut` is the first.
    Levels are dealt to `8 * levels` cells by price and the best of each cell counts, so
    copies of a level count once and the sums stay small. A side with a price or quantity
    that is missing or no number, or a quantity below 0, gets no cut.
    """
    cells = max(64, 8 * levels)
    rank, qty = F.col("_rank"), F.col("qty")
    odd = F.coalesce(F.isnan(rank) | F.isnan(qty) | (qty < 0) | rank.isNull() | qty.isNull(), F.lit(True))
    begins = F.coalesce(F.col("_point") == F.col("_first"), F.lit(False))
    cell = F.pmod(F.xxhash64("price"), F.lit(cells))
    seen = materialize(
        placed.groupBy(*keys, "_bid", "_unit", begins.alias("_begins"), cell.alias("_cell")).agg(
            F.min(F.when(qty > 0, rank)).alias("_best"), F.max(odd).alias("_odd")
        )
    )
    kinds = seen.groupBy(*keys, "_bid").agg(F.max("_odd").alias("_odd"))
    of = table.select(*keys, BLOCK, "_unit", F.explode(F.array(F.lit(True), F.lit(False))).alias("_bid"))
    of = join_on(of, kinds, [*keys, "_bid"], "left")
    for reach in REACHES:
        stretch = F.floor(F.col("_unit") / reach)
        # The first unit has none before it; what the first point opens stands for it.
        homes = F.array(stretch + 1, F.when(F.col("_begins"), F.lit(0).cast("long"))) if reach == 1 else F.array(stretch + 1)
        best = seen.select(*keys, "_bid", "_cell", "_best", F.explode(homes).alias("_stretch")).where(F.col("_stretch").isNotNull())
        best = best.groupBy(*keys, "_bid", "_stretch", "_cell").agg(F.min("_best").alias("_best"))
        found = F.get(F.sort_array(F.collect_list("_best")), F.lit(cells // 2 - 1)).alias(f"_best_{reach}")
        of = join_on(of.withColumn("_stretch", stretch), best.groupBy(*keys, "_bid", "_stretch").agg(found), [*keys, "_bid", "_stretch"], "left")
    bests = [F.col(f"_best_{reach}") for reach in REACHES]
    # Each is as deep as those before it, where they are known.
    deeper = [F.when(b.isNotNull(), F.greatest(*bests[: k + 1]) if k else b) for k, b in enumerate(bests)]
    cuts = F.array_distinct(F.array_append(F.array_compact(F.array(*(F.when(~F.coalesce("_odd", F.lit(False)), d) for d in deeper))), F.lit(float("inf"))))
    return of.select(*keys, BLOCK, "_bid", cuts.alias("_cuts"), F.get(cuts, F.lit(0)).alias("_cut"))


def _entering(kept: DataFrame, table: DataFrame, levels: int, keys: Sequence[str], bid: Column, rank: Column) -> DataFrame:
    """The levels of `kept` that are open at the start of each run."""
    level = [*keys, "side", "price"]
    # A level that is open at the end of a run is open at the start of the runs up to its next change.
    place = F.when(F.col("ts").isNotNull(), F.struct("ts", "update_id"))
    left = kept.groupBy(*level, BLOCK).agg(F.max_by("qty", place).alias("qty"), F.min("qty").alias("_least"))
    later = Window.partitionBy(*level).orderBy(BLOCK)
    ends = table.groupBy(*keys).agg(F.max(BLOCK).alias("_end"))
    spans = left.withColumns({"_until": F.lead(BLOCK).over(later), "_gone": F.lead("_least").over(later) == 0}).where("qty > 0")
    spans = join_on(spans.drop("_least"), ends, keys).withColumn("_until", F.coalesce("_until", "_end"))
    left = materialize(spans.where(F.col("_until") > F.col(BLOCK)))
    # A deeper level comes up only where one that was open at the start of the run goes
    # away, so a run needs no more than the best of its start and one for each of those.
    gone = left.where("_gone").groupBy(*keys, "side", F.col("_until").alias(BLOCK)).agg(F.count(F.lit(1)).alias("_more"))
    gone = materialize(gone)
    count = (table.agg(F.max(BLOCK)).first()[0] or 0) + 1
    open_levels = _open_at(left.drop("_gone"), gone, levels, count, keys)
    return open_levels.select(*keys, BLOCK, bid.alias("_bid"), rank.alias("_rank"), "qty")


def walk_run(changes: pa.Table, rest: pa.Table, levels: int) -> tuple:
    """The listings of a run: the points at which each is in force and until when, best ranks and quantities, and whether a cut was too near.

    `changes` has _point, ts, update_id, _bid, _rank and qty; of several changes of a
    level at a point the last counts, and one without a point holds when the run
    begins. `rest` has the levels that are open then, and rows that are no level: with
    _points, points of the run, and with _next, the first point of the run after it,
    and _bid_cut and _ask_cut, the ranks up to which levels and changes are known.
    """
    points = [p.values.to_numpy() for p in rest.column("_points") if p.is_valid]
    points = np.sort(np.concatenate(points)) if points else np.zeros(0, np.int64)
    following, *cuts = (next((x.as_py() for x in rest.column(c) if x.is_valid), None) for c in ("_next", "_bid_cut", "_ask_cut"))
    cuts = [float("inf") if c is None else c for c in cuts]
    in_order = pc.sort_indices(changes, [(c, "ascending") for c in ("_point", "_bid", "_rank", "ts", "update_id")], null_placement="at_start")
    changes = changes.take(in_order)
    point, bid, rank, qty = (changes.column(c) for c in ("_point", "_bid", "_rank", "qty"))
    early = point.is_null().to_numpy()
    point, bid, rank, qty = point.fill_null(0).to_numpy(), bid.to_numpy(), rank.to_numpy(), qty.to_numpy()
    same_rank = (rank[1:] == rank[:-1]) | (np.isnan(rank[1:]) & np.isnan(rank[:-1]))
    last = np.append((point[1:] != point[:-1]) | (early[1:] != early[:-1]) | (bid[1:] != bid[:-1]) | ~same_rank, True)[: len(point)]
    opened = rest.filter(rest.column("_bid").is_valid())
    first = np.flatnonzero(early & last)
    open_bid, open_rank, open_qty = (
        np.concatenate([opened.column(c).to_numpy().astype(v.dtype), v[first]]) for c, v in (("_bid", bid), ("_rank", rank), ("qty", qty))
    )
    book = []
    for side, cut in zip((True, False), cuts, strict=True):
        own = np.flatnonzero((open_bid == side) & ((open_rank <= cut) if np.isfinite(cut) else True))
        own = own[np.argsort(open_rank[own])]
        book.append(Ladder(open_rank[own].tolist(), open_qty[own].tolist()))
    bids, asks = book
    order = np.flatnonzero(~early & last)
    times = point[order]
    ends = np.flatnonzero(np.append(times[1:] != times[:-1], True)) + 1 if len(times) else np.zeros(0, np.int64)
    bid, rank, qty = bid[order], rank[order], qty[order]
    # The state before any change is in force up to the first point that has one.
    state = np.searchsorted(times[ends - 1], points, "right")
    until = np.append(points[1:] - 1, points[-1:] if following is None else following - 1)[: len(points)]
    shown = np.zeros(len(ends) + 1, bool)
    shown[state] = True
    flat: list[list[list[float]]] = [[], [], [], []]
    listing = np.full(len(ends) + 1, -1)
    short = False
    begin = 0
    for k, end in enumerate([0, *ends.tolist()]):
        of = slice(begin, end)
        if end - begin < MERGED or np.isnan(rank[of]).any():
            for side, r, q in zip(bid[of].tolist(), rank[of].tolist(), qty[of].tolist(), strict=True):
                (bids if side else asks).change(r, q)
        else:
            for side, ladder in ((True, bids), (False, asks)):
                ladder.merge(rank[of][bid[of] == side], qty[of][bid[of] == side])
        begin = end
        if not shown[k]:
            continue
        short |= any(np.isfinite(cut) and len(ladder.ranks) < levels for ladder, cut in zip(book, cuts, strict=True))
        if bids.ranks and asks.ranks:
            best = [bids.ranks[:levels], bids.qty[:levels], asks.ranks[:levels], asks.qty[:levels]]
            if not flat[0] or any(f[-1] != b for f, b in zip(flat, best, strict=True)):
                for f, b in zip(flat, best, strict=True):
                    f.append(b)
            listing[k] = len(flat[0]) - 1
    if short:
        return [[]], [[]], *([[[]]] * 4), [True]
    here = listing[state]
    points, until, here = points[here >= 0], until[here >= 0], here[here >= 0]
    offsets = np.searchsorted(here, np.arange(len(flat[0]) + 1)).astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (points, until)]
    return *spans, *(pa.array(f, pa.list_(pa.float64())) for f in flat), np.zeros(len(flat[0]), bool)


def _open_at(left: DataFrame, gone: DataFrame, levels: int, blocks: int, keys: Sequence[str]) -> DataFrame:
    """The best open levels of each side at the start of every block: `levels`, and as many more as `gone` says.

    `left` has levels that are open from the block after `_block` to `_until`. Of
    those with the same span only as many are kept as any block can ask for. A level
    is not sent to each of these blocks but to the few stretches of 2**k blocks that
    make up the span; only the best of a stretch go on to its blocks.
    """
    most = levels + (gone.agg(F.max("_more")).first()[0] or 0)
    sizes = F.sequence(F.lit(0), F.lit(max(blocks, 1).bit_length()))
    low, high = F.col(BLOCK) + 1, F.col("_until") + 1

    def stretches(k: Column) -> Column:
        width = F.pow(F.lit(2.0), k).cast("long")
        first, past = F.ceil(low / width), F.floor(high / width)
        inside = first < past
        start = F.when(inside & (first % 2 == 1), F.struct(k.alias("k"), first.alias("at")))
        end = F.when(inside & (past % 2 == 1), F.struct(k.alias("k"), (past - 1).alias("at")))
        return F.array(start, end)

    parts = F.filter(F.flatten(F.transform(sizes, stretches)), lambda x: x.isNotNull())
    rank = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    width = F.pow(F.lit(2.0), F.col("k")).cast("long")
    # The most that any block of a stretch asks for.
    asked = (
        gone.withColumn("k", F.explode(sizes))
        .groupBy(*keys, "side", "k", F.floor(F.col(BLOCK) / width).alias("at"))
        .agg(F.max("_more").alias("_more"))
    )

    def best(rows: DataFrame, more: DataFrame, *home: str) -> DataFrame:
        place = Window.partitionBy(*keys, "side", *home).orderBy(rank)
        placed = join_on(rows.withColumn("_rank", F.row_number().over(place)), more, [*keys, "side", *home], "left")
        return placed.where(F.col("_rank") <= levels + F.coalesce("_more", F.lit(0))).drop("_rank", "_more")

    alike = Window.partitionBy(*keys, "side", BLOCK, "_until").orderBy(rank)
    few = left.withColumn("_rank", F.row_number().over(alike)).where(F.col("_rank") <= most)
    spread = few.select(*keys, "side", "price", "qty", F.inline(parts))
    kept = best(spread, asked, "k", "at")
    opened = kept.withColumn(BLOCK, F.explode(F.sequence(F.col("at") * width, (F.col("at") + 1) * width - 1))).drop("k", "at")
    return best(opened, gone, BLOCK)


MERGED = 256  # changes of a point from which on they are merged


class Ladder:
    """Open levels of one side: ranks in order and their quantities."""

    def __init__(self, ranks: list[float], qty: list[float]):
        self.ranks, self.qty = ranks, qty

    def change(self, rank: float, qty: float) -> None:
        """Set the quantity of a level; 0 removes it."""
        at = bisect_left(self.ranks, rank)
        known = at < len(self.ranks) and self.ranks[at] == rank
        if qty == 0:
            if known:
                del self.ranks[at], self.qty[at]
        elif known:
            self.qty[at] = qty
        else:
            self.ranks.insert(at, rank)
            self.qty.insert(at, qty)

    def merge(self, ranks: np.ndarray, qty: np.ndarray) -> None:
        """Many changes at once, each of another level."""
        ranks, qty = np.concatenate([self.ranks, ranks]), np.concatenate([self.qty, qty])
        order = np.argsort(ranks, kind="stable")
        ranks, qty = ranks[order], qty[order]
        kept = np.append(ranks[1:] != ranks[:-1], True)[: len(ranks)] & (qty != 0)
        self.ranks, self.qty = ranks[kept].tolist(), qty[kept].tolist()


def dense_book(listed: DataFrame, every: int = 1) -> DataFrame:
    """The listings of `reconstruct`, repeated at every grid point they hold."""
    step = F.expr(f"interval {every} seconds")
    days = F.sequence("ts", "valid_until", F.expr(f"interval {every * 3600} seconds"))
    parted = listed.withColumn("_from", F.explode(days)).withColumn(
        "_to", F.least("valid_until", F.col("_from") + F.expr(f"interval {every * 3599} seconds"))
    )
    return parted.withColumn("ts", F.explode(F.sequence("_from", "_to", step))).drop("_from", "_to", "valid_until")


def trailing_flow(
    snapshots: DataFrame,
    trades: DataFrame,
    window_ms: int = 1000,
    *,
    keys: Sequence[str] = ("symbol",),
    block_seconds: int = 300,
) -> DataFrame:
    """Add buy_volume_1s, sell_volume_1s and vwap_1s to each snapshot.

    Counts trades with 0 <= snapshot - trade <= window_ms, times truncated to
    milliseconds. Both tables are put on one time line cut into blocks; trades
    just before a block are copied into it. A block is cut into lines as long as the
    window: a window is the end of the line before and the beginning of its own. Both
    are running sums, so the work does not grow with the trades that a window holds.
    """
    # A block is at least as long as the window, so a trade goes to two at most.
    series = Series(tuple(keys), max(block_seconds * 1000, window_ms))
    columns = [c for c in snapshots.columns if c not in keys]
    left = snapshots.select(
        *keys, F.unix_millis("ts").alias(SLOT), F.struct(*columns).alias("_snap"), *(F.lit(None).cast("double").alias(c) for c in ("_buy", "_sell", "_value"))
    )
    maker = F.col("is_buyer_maker")
    right = trades.select(
        *keys,
        F.unix_millis("ts").alias(SLOT),
        F.lit(None).cast(left.schema["_snap"].dataType).alias("_snap"),
        F.when(~maker, F.col("quantity")).otherwise(0.0).alias("_buy"),
        F.when(maker, F.col("quantity")).otherwise(0.0).alias("_sell"),
        (F.col("price") * F.col("quantity")).alias("_value"),
    )
    # Snapshots stay in their block; only trades are looked back at.
    own = left.withColumn(BLOCK, series.block_of(F.col(SLOT)))
    blocks = F.sequence(series.block_of(F.col(SLOT)), series.block_of(F.col(SLOT) + window_ms))
    placed = gather(own.unionByName(right.withColumn(BLOCK, F.explode(blocks))), series.home)
    # A trade counts in its line up to the snapshot, and in the next line until it is older than the window.
    times = F.array(*(F.lit(t).cast("long") for t in sorted({0, window_ms})))
    times = F.filter(times, lambda late: series.block_of(F.col(SLOT) + late) == F.col(BLOCK))
    times = F.when(F.col("_snap").isNotNull(), F.array(F.lit(0).cast("long"))).otherwise(times)
    line = placed.withColumn("_late", F.explode(times)).withColumn(SLOT, F.col(SLOT) + F.col("_late"))
    line = line.withColumn("_line", Series(rows=max(window_ms, 1)).block_of(F.col(SLOT)))
    inside = Window.partitionBy(*series.home, "_line")
    so_far = inside.orderBy(SLOT).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = inside.orderBy(F.desc(SLOT)).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def flow(c: str) -> Column:
        begun = F.sum(F.when(F.col("_late") == 0, F.col(c))).over(so_far)
        ending = F.sum(F.when(F.col("_late") > 0, F.col(c))).over(from_here)
        return F.coalesce(ending, F.lit(0.0)) + F.coalesce(begun, F.lit(0.0))

    summed = line.withColumns({"_b": flow("_buy"), "_s": flow("_sell"), "_w": flow("_value")}).filter(F.col("_snap").isNotNull())
    volume = F.col("_b") + F.col("_s")
    return summed.select(
        *keys,
        *(F.col(f"_snap.{c}").alias(c) for c in columns),
        F.col("_b").alias("buy_volume_1s"),
        F.col("_s").alias("sell_volume_1s"),
        F.when(volume > 0, F.try_divide(F.col("_w"), volume)).otherwise(F.col("_snap.mid_price")).alias("vwap_1s"),
    ).drop(BLOCK)
