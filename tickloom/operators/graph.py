"""A graph of named column expressions over ordered series.

An indicator is written once as a small expression; equal sub-expressions
(true range, EMA of close over 12 bars, ...) become one column. The graph knows
how far back and ahead each output looks, so `evaluate` can cut a series into
blocks with a halo that is just wide enough and compute everything with one
shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions import fdiv, finite
from tickloom.operators.blocks import OWN, SLOT, Series, running, with_halo

# Recurrences run inside strides of this many slots, short enough for q**-STRIDE
# to stay a finite double for every smoothing factor down to a span of 2.
STRIDE = 512
# Frames of this many rows and more are put together from shorter ones.
LONG_FRAME = 12
# The same for variances, which are merged from the variances and means of parts.
LONG_SPREAD = 60
# Weights below exp(-FADE), about 1e-17, cannot change a double ...
FADE = 39.2
# ... unless everything newer is zero and a quotient of two averages is taken.
# There the whole range of a double counts.
DEEP_FADE = 745.0


@dataclass(frozen=True)
class Node:
    """One column of the graph."""

    key: str
    column: str
    back: int
    ahead: int
    may_inf: bool
    kind: str  # source, row, window, total


class Graph:
    """Collects the columns wanted by a set of outputs.

    `complete` states that the source columns hold no missing and no infinite
    value; smoothing then needs no bookkeeping of gaps.
    """

    def __init__(self, series: Series, sources: Sequence[str], complete: bool = False):
        self.series = series
        self.sources = list(sources)
        self.complete = complete
        self._nodes: dict[str, Node] = {}
        self._stage: dict[str, int] = {}
        self._depth: dict[str, int] = {}
        self._make: dict[str, Column] = {}
        self._totals: dict[str, tuple[str, Column]] = {}
        self._deps: dict[str, list[str]] = {}
        self._seed: dict[str, Node] = {}
        self._quotients: set[str] = set()
        self._frames: dict[tuple[int, int], WindowSpec] = {}
        home = series.home
        self._ordered = Window.partitionBy(*home).orderBy("_stride", SLOT)
        self._in_stride = (
            Window.partitionBy(*home, "_stride").orderBy(SLOT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        self._strides = Window.partitionBy(*home).orderBy("_stride")

    # -- building blocks -------------------------------------------------

    def source(self, name: str) -> Node:
        if name not in self.sources:
            raise ValueError(f"column {name!r} not found")
        if name not in self._nodes:
            node = Node(name, name, 0, 0, not self.complete, "source")
            self._nodes[name], self._stage[name], self._depth[name] = node, 0, 0
        return self._nodes[name]

    def row(self, key: str, deps: Sequence[Node], make: Callable[..., Column], may_inf: bool | None = None) -> Node:
        """An expression of the same row."""
        inf = any(d.may_inf for d in deps) if may_inf is None else may_inf
        return self._add(key, deps, lambda: make(*(F.col(d.column) for d in deps)), "row", 0, 0, inf)

    def window(self, key: str, deps: Sequence[Node], make: Callable[[], Column], back: int, ahead: int = 0) -> Node:
        """An expression holding window functions of this graph's windows."""
        return self._add(key, deps, make, "window", back, ahead, False)

    def total(self, key: str, kind: str, x: Node) -> Node:
        """A running total over the whole series, see `blocks.running`."""
        node = self._add(key, [x], lambda: None, "total", 0, 0, False)
        self._totals[node.key] = (kind, F.col(x.column))
        return node

    def _add(self, key, deps, make, kind, back, ahead, may_inf) -> Node:
        if key in self._nodes:
            return self._nodes[key]
        if kind != "row" and any(d.kind == "total" or self._stage[d.key] >= 1000 for d in deps):
            raise ValueError(f"{key}: windows over running totals are not supported")
        base = max((self._stage[d.key] for d in deps), default=0)
        if kind == "window":
            stage, depth = base + 1, 0
        elif kind == "total":
            stage, depth = 1000, 0
        else:
            stage = base
            depth = 1 + max((self._depth[d.key] for d in deps if self._stage[d.key] == base), default=0)
        node = Node(
            key,
            f"_n{len(self._nodes)}",
            back + max((d.back for d in deps), default=0),
            ahead + max((d.ahead for d in deps), default=0),
            may_inf,
            kind,
        )
        self._nodes[key], self._stage[key], self._depth[key] = node, stage, depth
        self._deps[key] = [d.key for d in deps]
        if kind != "total":
            self._make[key] = make()
        return node

    def rows_before(self, n: int) -> WindowSpec:
        """Frame of the current row and the n-1 rows before it."""
        return self.frame(-(n - 1), 0)

    def frame(self, first: int, last: int) -> WindowSpec:
        if (first, last) not in self._frames:
            self._frames[first, last] = self._ordered.rowsBetween(first, last)
        return self._frames[first, last]

    # -- derived columns ---------------------------------------------------

    def finite(self, x: Node) -> Node:
        return self.row(f"finite({x.key})", [x], finite, may_inf=False) if x.may_inf else x

    def div(self, a: Node, b: Node) -> Node:
        node = self.row(f"({a.key}/{b.key})", [a, b], fdiv, may_inf=True)
        self._quotients.add(node.key)
        return node

    def first_row(self) -> Node:
        """True on the first row of the series (or of a halo, where it is unused)."""
        return self.window("first_row", [], lambda: F.lag(F.lit(1)).over(self._ordered).isNull(), 1)

    def lag(self, x: Node, n: int) -> Node:
        col = F.lag(x.column, n) if n > 0 else F.lead(x.column, -n)
        node = self.window(
            f"lag({x.key},{n})", [x], lambda: col.over(self._ordered), max(n, 0), max(-n, 0)
        )
        return node if not x.may_inf else self._relabel(node)

    def _relabel(self, node: Node) -> Node:
        marked = Node(node.key, node.column, node.back, node.ahead, True, node.kind)
        self._nodes[node.key] = marked
        return marked

    def diff(self, x: Node, n: int = 1) -> Node:
        return self.row(f"diff({x.key},{n})", [x, self.lag(x, n)], lambda a, b: a - b)

    def pct(self, x: Node, n: int = 1) -> Node:
        ratio = self.div(x, self.lag(x, n))
        return self.row(f"pct({x.key},{n})", [ratio], lambda r: r - 1)

    def rolling(self, name: str, x: Node, n: int, agg: Callable[[Column], Column], need: int | None = None) -> Node:
        """Aggregate of the last n rows once all n (or `need`) of them are present."""
        v = self.finite(x)
        w = self.rows_before(n)

        def make() -> Column:
            if need is None and self.complete and not self.can_miss(v):
                # Nothing is missing after the first value, so the oldest row tells.
                full = F.lag(v.column, n - 1).over(self._ordered).isNotNull()
            else:
                full = F.count(v.column).over(w) >= (n if need is None else need)
            return F.when(full, agg(F.col(v.column)).over(w))

        suffix = "" if need is None else f",{need}"
        return self.window(f"{name}({v.key},{n}{suffix})", [v], make, n - 1)

    def mean(self, x: Node, n: int) -> Node:
        return self.row(f"mean({self.finite(x).key},{n})", [self.sum(x, n)], lambda t: t / n)

    def sum(self, x: Node, n: int) -> Node:
        """Spark adds up a sliding frame anew for every row, so a long one is
        put together from the sums of a shorter one at earlier rows."""
        part = next((m for m in range(n // 2, 1, -1) if n % m == 0 and n // m <= 5), None)
        if n < LONG_FRAME or part is None:
            return self.rolling("sum", x, n, F.sum)
        short = self.sum(x, part)
        earlier = [self.lag(short, part * k) for k in range(1, n // part)]

        def add(*parts: Column) -> Column:
            out = parts[0]
            for one in parts[1:]:
                out = out + one
            return out

        return self.row(f"sum({self.finite(x).key},{n})", [short, *earlier], add)

    def max(self, x: Node, n: int) -> Node:
        return self._extreme("max", x, n, F.max, F.greatest)

    def min(self, x: Node, n: int) -> Node:
        return self._extreme("min", x, n, F.min, F.least)

    def _extreme(self, name: str, x: Node, n: int, agg: Callable, pick: Callable) -> Node:
        if n < LONG_FRAME:
            return self.rolling(name, x, n, agg)
        half = self._extreme(name, x, (n + 1) // 2, agg, pick)
        other = self.lag(half, n - (n + 1) // 2)
        both = F.col(half.column).isNotNull() & F.col(other.column).isNotNull()
        return self.row(
            f"{name}({self.finite(x).key},{n})", [half, other], lambda a, b: F.when(both, pick(a, b))
        )

    def var(self, x: Node, n: int) -> Node:
        """A long frame is merged from parts: what they vary inside, and how far their means lie apart."""
        v = self.finite(x)
        part = next((m for m in range(LONG_SPREAD // 2, n // 2 + 1) if n % m == 0 and n // m <= 5), None)
        if n < LONG_SPREAD or part is None or not self.complete or self.can_miss(v):
            return self.rolling("var", x, n, F.var_samp)
        inner, mean, parts = self.var(v, part), self.mean(v, part), n // part
        earlier = [self.lag(node, part * k) for node in (inner, mean) for k in range(1, parts)]

        def merge(*cols: Column) -> Column:
            # Differences between means are 0 on a constant window, without rounding.
            pairs = [(a - b) * (a - b) for a, b in combinations(cols[parts:], 2)]
            return (reduce(add, cols[:parts]) * (part - 1) + reduce(add, pairs) * (part / parts)) / (n - 1)

        nodes = [inner, *earlier[: parts - 1], mean, *earlier[parts - 1 :]]
        return self.row(f"var({v.key},{n})", nodes, merge, may_inf=False)

    def std(self, x: Node, n: int) -> Node:
        return self.row(f"std({self.finite(x).key},{n})", [self.var(x, n)], F.sqrt)

    def score(self, x: Node, n: int) -> Node:
        """(x - mean) / deviation over n rows; missing on a constant window,
        where the mean is x but for rounding."""
        away = self.row(f"away({x.key},{n})", [x, self.mean(x, n)], lambda a, m: a - m)
        spread = self.std(x, n)
        ratio = self.div(away, spread)
        return self.row(f"score({x.key},{n})", [ratio, spread], lambda r, s: F.when(s > 0, r))

    def values(self, x: Node, n: int) -> Node:
        """The present values of the last n rows, oldest first."""
        v = self.finite(x)
        return self.window(
            f"values({v.key},{n})", [v], lambda: F.collect_list(v.column).over(self.rows_before(n)), n - 1
        )

    def weighted(self, x: Node, n: int) -> Node:
        """Mean with weights 1..n, the newest row weighing most."""
        values = self.values(x, n)
        scale = n * (n + 1) / 2

        def make(xs: Column) -> Column:
            parts = F.transform(xs, lambda value, i: value * (i + 1))
            total = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
            return F.when(F.size(xs) == n, total / scale)

        return self.row(f"weighted({self.finite(x).key},{n})", [values], make)

    def span(self, x: Node, n: int, deep: bool = False) -> Node:
        """Exponential mean with alpha = 2/(n+1)."""
        return self.ewm(x, 2 / (n + 1), deep)

    # -- recurrences -----------------------------------------------------

    def _start(self, x: Node) -> Node:
        """True on the first present row, for columns without inner gaps."""
        if x.key in self._seed:
            return self._seed[x.key]
        return self.window(
            f"start({x.key})",
            [x],
            lambda: F.col(x.column).isNotNull() & F.lag(x.column).over(self._ordered).isNull(),
            1,
        )

    def ewm(self, x: Node, alpha: float, deep: bool = False) -> Node:
        """y = (1-alpha)*y_prev + alpha*x, starting at the first present x.

        A missing x holds the last value, and the next present x is weighted
        against (1-alpha)**(rows since the last present one). `deep` keeps
        weights down to the smallest double, for averages that are divided by
        each other.
        """
        v = self.finite(x)
        key = f"ewm({v.key},{alpha!r}{',deep' if deep else ''})"
        if key in self._nodes:
            return self._nodes[key]
        if alpha >= 1:
            return v
        depth = DEEP_FADE if deep else FADE
        if not self.complete:
            return self._ewm_over_gaps(key, v, alpha, depth)
        q = 1 - alpha
        fade = self._fade(depth, q)
        start = self._start(v)
        j = F.pmod(F.col(SLOT), F.lit(STRIDE)).cast("double")

        def local() -> Column:
            value = F.col(v.column)
            term = F.when(F.col(start.column), value).otherwise(value * alpha)
            return F.pow(F.lit(q), j) * F.sum(term * F.pow(F.lit(q), -j)).over(self._in_stride)

        loc = self.window(f"{key}.local", [v, start], local, 0)

        carry = self._carry(loc, fade, q**STRIDE)

        def joined(value: Column, here: Column, before: Column) -> Column:
            return F.when(value.isNotNull(), here + F.pow(F.lit(q), j + 1) * before)

        inner = self.row(f"{key}.joined", [v, loc, carry], joined)
        node = self._reaching_back(key, inner, fade)
        self._seed[node.key] = start
        return node

    def _reaching_back(self, key: str, x: Node, rows: int) -> Node:
        """The column x, known to depend on at most `rows` earlier rows."""
        node = Node(key, x.column, x.back + rows, x.ahead, x.may_inf, x.kind)
        self._nodes[key], self._stage[key], self._depth[key] = node, self._stage[x.key], self._depth[x.key]
        self._deps[key] = [x.key]
        return node

    def _stride_end(self, x: Node) -> Node:
        """Value of x at the end of the stride before, 0 if there is none.

        The frame only moves when the stride does, so it costs one step per row.
        """
        at_end = F.when(F.pmod(F.col(SLOT), F.lit(STRIDE)) == STRIDE - 1, F.col(x.column))
        return self.window(
            f"end({x.key})",
            [x],
            lambda: F.coalesce(F.sum(at_end).over(self._strides.rangeBetween(-1, -1)), F.lit(0.0)),
            0,
        )

    def _carry(self, local: Node, fade: int, factor: float | Node) -> Node:
        """What the strides before add at the start of this one.

        `factor` is the product of the weights over a stride. Starting from the
        stride before, each step doubles the strides taken in.
        """
        total = self._stride_end(local)
        weight = self._stride_end(factor) if isinstance(factor, Node) else factor
        taken = 1
        while taken * STRIDE < fade:
            older = self.lag(total, taken * STRIDE)
            name = f"{local.key}.carry{2 * taken}"
            if isinstance(weight, Node):
                total = self.row(
                    name, [total, weight, older], lambda t, w, o: t + w * F.coalesce(o, F.lit(0.0)), may_inf=False
                )
                weight = self.row(
                    f"{name}.weight",
                    [weight, self.lag(weight, taken * STRIDE)],
                    lambda w, o: w * F.coalesce(o, F.lit(0.0)),
                    may_inf=False,
                )
            else:
                total = self.row(
                    name,
                    [total, older],
                    lambda t, o, w=weight: t + F.coalesce(o, F.lit(0.0)) * w,
                    may_inf=False,
                )
                weight = weight * weight
            taken *= 2
        # The steps look back over rows that `fade` already counts.
        return self._bounded(total, local.back)

    def _bounded(self, x: Node, rows: int) -> Node:
        key = f"{x.key}.bounded"
        if key not in self._nodes:
            node = Node(key, x.column, rows, x.ahead, x.may_inf, x.kind)
            self._nodes[key], self._stage[key], self._depth[key] = node, self._stage[x.key], self._depth[x.key]
            self._deps[key] = [x.key]
        return self._nodes[key]

    @staticmethod
    def _fade(depth: float, q: float) -> int:
        return math.ceil(depth / -math.log(q))

    def affine(self, key: str, a: Node, b: Node, slowest: float, depth: float = FADE) -> Node:
        """y = a*y_prev + b with a row-dependent a in (0, 1].

        `slowest` is the largest a of a row that is not a mere hold. Rows
        without b are missing and must come before all others.
        """
        product = self.window(f"{key}.product", [a], lambda: F.product(a.column).over(self._in_stride), 0)

        def local() -> Column:
            p = F.col(product.column)
            return p * F.sum(F.try_divide(F.col(b.column), p)).over(self._in_stride)

        loc = self.window(f"{key}.local", [product, b], local, 0)
        fade = self._fade(depth, slowest)

        carry = self._carry(loc, fade, product)
        started = self.window(
            f"{key}.started",
            [b],
            lambda: F.max(F.col(b.column).isNotNull()).over(self.frame(Window.unboundedPreceding, 0)),
            0,
        )

        def joined(here: Column, factor: Column, before: Column, begun: Column) -> Column:
            return F.when(begun, F.coalesce(here, F.lit(0.0)) + factor * before)

        inner = self.row(f"{key}.joined", [loc, product, carry, started], joined)
        return self._reaching_back(key, inner, fade)

    def _ewm_over_gaps(self, key: str, v: Node, alpha: float, depth: float) -> Node:
        q = 1 - alpha
        upto_previous = self._ordered.rowsBetween(Window.unboundedPreceding, -1)
        seen = self.window(
            f"seen({v.key})",
            [v],
            lambda: F.max(F.when(F.col(v.column).isNotNull(), F.col(SLOT))).over(upto_previous),
            1,
        )
        keep = F.pow(F.lit(q), (F.col(SLOT) - F.col(seen.column)).cast("double"))
        follows = F.col(v.column).isNotNull() & F.col(seen.column).isNotNull()
        a = self.row(
            f"{key}.a", [v, seen], lambda x, s: F.when(follows, keep / (keep + alpha)).otherwise(F.lit(1.0))
        )
        b = self.row(
            f"{key}.b",
            [v, seen],
            lambda x, s: F.when(follows, x * alpha / (keep + alpha)).when(x.isNotNull(), x).when(
                s.isNotNull(), F.lit(0.0)
            ),
        )
        return self.affine(key, a, b, q, depth)

    # -- evaluation --------------------------------------------------------

    def evaluate(self, df: DataFrame, outputs: dict[str, Node | None], keep: Sequence[str] | None = None) -> DataFrame:
        """Add the outputs to `df`, which carries `_slot`.

        A None output becomes a column that is missing throughout.
        """
        wanted = {n: node for n, node in outputs.items() if node is not None}
        back = max((n.back for n in wanted.values()), default=0)
        ahead = max((n.ahead for n in wanted.values()), default=0)
        columns = list(keep) if keep is not None else [c for c in df.columns if c != SLOT]
        needed = list(dict.fromkeys([*self.series.keys, SLOT, *columns, *self.reads(wanted.values())]))
        # A block is at least as long as what it looks at, so a row goes to three blocks at most, not to back / rows.
        series = replace(self.series, rows=max(self.series.rows, back, ahead))
        frame = with_halo(df.select(*needed), series, back, ahead)
        stride = F.floor(F.col(SLOT) / F.lit(STRIDE)).cast("long")
        frame = frame.withColumn("_stride", stride)
        late = []
        levels = self._levels(n.key for n in wanted.values())
        for stage, keys in levels:
            if stage >= 1000:
                late.append(keys)
            else:
                made = {self._nodes[k].column: self._make[k] for k in keys if k in self._make}
                frame = frame.withColumns(made) if made else frame
        frame = frame.filter(OWN)
        for keys in late:
            totals = {self._nodes[k].column: self._totals[k] for k in keys if k in self._totals}
            frame = running(frame, series, totals)
            made = {self._nodes[k].column: self._make[k] for k in keys if k in self._make}
            if made:
                frame = frame.withColumns(made)
        # Column names are case-insensitive in Spark: an output replaces an input
        # column that differs from it in case only.
        taken = {name.lower() for name in outputs}
        result = [F.col(c) for c in columns if c.lower() not in taken]
        result += [
            F.lit(None).cast("double").alias(name) if node is None else F.col(node.column).alias(name)
            for name, node in outputs.items()
        ]
        return frame.select(*result)

    def reads(self, nodes: Iterable[Node]) -> list[str]:
        """Source columns the nodes depend on."""
        reached = self._reach(n.key for n in nodes)
        return [c for c in self.sources if c in reached]

    def can_miss(self, node: Node) -> bool:
        """Whether a complete series can give a missing value after a present one."""
        return node.ahead > 0 or any(k in self._quotients for k in self._reach([node.key]))

    def _reach(self, keys: Iterable[str]) -> set[str]:
        todo, reached = list(keys), set()
        while todo:
            key = todo.pop()
            if key not in reached:
                reached.add(key)
                todo.extend(self._deps.get(key, []))
        return reached

    def _levels(self, keys: Iterable[str]) -> list[tuple[int, list[str]]]:
        """Columns that can be added together, in order."""
        reached = self._reach(keys)
        groups: dict[tuple[int, int], list[str]] = {}
        for key, node in self._nodes.items():
            if node.kind != "source" and key in reached:
                groups.setdefault((self._stage[key], self._depth[key]), []).append(key)
        return [(stage, groups[stage, depth]) for stage, depth in sorted(groups)]
