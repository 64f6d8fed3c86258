"""Exact Jaccard join of word-shingle sets with set-relation skipping.

Equal sets form one class, and classes are joined:

1. A table of bucket counts gives all shingles one order, rare ones first. Two
   similar sets share a shingle in the short prefixes of that order; shingles
   that only one prefix holds are left out.
2. The list of a shingle is sorted by set size, and each entry knows its
   position. Stretches of the list whose sizes or positions rule a link out are
   skipped; so is a pair in all lists but the first one that both sets have
   among their earliest shared shingles. Parity signatures, whose
   distance never exceeds the number of differing shingles, skip most of the rest.
3. Sets that still have a partner are tied into clusters, and those of a cluster
   meet in a unit, or in a unit for every two parts of a large cluster. There the
   overlaps of a set follow from those of a similar set done before: only the
   shingles in which the two differ are looked up. Lists and units report ties and
   counts, so what they send grows with their sets, not with their pairs.

Every step is a bound, so no link is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words
from tickloom.llm.components import components, tied
from tickloom.session import materialize

ORDER_BITS = 20
NEEDED_BITS = 22
SIGNATURE_BITS = 512
LIST_ROWS = 1024
UNIT_SETS = 256
PAIRS_AT_ONCE = 1 << 17
EARLY = 4
_PART = 1 << 14


def _bucket_counts(rows: DataFrame, hashes, bits: int) -> np.ndarray:
    """How many hashes fall into each of 2**bits buckets, up to 65535 from one task.

    ``hashes`` yields arrays of 64-bit hashes from a record batch. The result has
    a fixed size; it is added up in parts, each where it arrives.
    """
    size = 1 << bits

    def rows_of(table: np.ndarray, at: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int32()), pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())], ["at", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.uint32)
        for batch in batches:
            for own in hashes(batch):
                table += np.bincount((own >> np.uint64(8)) & np.uint64(size - 1), minlength=size).astype(np.uint32)
        for at in range(0, size, _PART):
            part = np.minimum(table[at : at + _PART], 65535).astype(np.uint16)
            if part.any():
                yield rows_of(part, at)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(packed.as_py()), np.uint16).astype(np.int64)
                sums[at] = sums[at] + part if at in sums else part
        for at, part in sums.items():
            yield rows_of(part, at)

    out = np.zeros(size, np.int64)
    parts = rows.mapInArrow(count, "at int, n binary").repartition("at").mapInArrow(add, "at int, n binary")
    for row in parts.toArrow().to_pylist():
        out[row["at"] : row["at"] + _PART] = np.frombuffer(zlib.decompress(row["n"]), np.int64)
    return out


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(8)) & np.uint64((1 << bits) - 1)


def _fingerprint(own: np.ndarray) -> tuple[int, int]:
    first = int(np.add.reduce(words.mix(own ^ np.uint64(0x243F6A8885A308D3)), dtype=np.uint64))
    second = int(np.add.reduce(words.mix(own + np.uint64(0x13198A2E03707344)), dtype=np.uint64))
    return first, second


def _parity(own: np.ndarray, bits: int) -> bytes:
    """Bit b is set if an odd number of hashes fall into bucket b."""
    odd = np.bincount((own >> np.uint64(20)) & np.uint64(bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _fine_bits(n: int, percent: int) -> int:
    """Bits of the longer signature, a power of two.

    Sets without anything in common differ in about half of the bits. That has to be
    more than linked sets of this size may differ in, with an eighth to spare.
    """
    differ = 2 * n * (100 - percent) // (100 + percent)
    return 1 << max(differ * 9 // 4 - 1, 1).bit_length()


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([*values, np.zeros(0, np.uint64)]).astype(np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _describe(docs: DataFrame, order, size: int, percent: int) -> DataFrame:
    """All columns but the text, n, fingerprint, prefix in the common order and signature of every row."""
    kept = [c for c in docs.columns if c != "_text"]
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for batch in batches:
            for block in words.blocks(batch.column(0)):
                sets = words.shingle_sets(block, size)
                prefixes, signatures, fines, marks = [], [], [], []
                for own in sets:
                    n = len(own)
                    need = n - -(-percent * n // 100) + 1 if n else 0
                    by_rank = np.argsort(rank[_bucket(own, ORDER_BITS)], kind="stable")  # ties by hash
                    prefixes.append(own[by_rank[:need]])
                    signatures.append(_parity(own, SIGNATURE_BITS))
                    # A large set fills the short signature, so it has one in proportion to its size too.
                    fines.append(_parity(own, _fine_bits(n, percent)) if n > 2 * SIGNATURE_BITS else b"")
                    marks.append(_fingerprint(own))
                cut = slice(block.first, block.first + len(block))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c[cut] for c in batch.columns[1:]),
                        pa.array([len(s) for s in sets], pa.int64()),
                        _signed([m[0] for m in marks]),
                        _signed([m[1] for m in marks]),
                        _lists(prefixes),
                        pa.array(signatures, pa.binary()),
                        pa.array(fines, pa.binary()),
                    ],
                    [*kept, "n", "f1", "f2", "prefix", "signature", "fine"],
                )

    return docs.select("_text", *kept).mapInArrow(run, f"{fields}, n long, f1 long, f2 long, prefix array<long>, signature binary, fine binary")


def _alike(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the signatures allow that at most ``most`` shingles are in one set only."""
    good = np.bitwise_count(rows["signature"][a] ^ rows["signature"][b]).sum(-1, dtype=np.int64) <= most
    fine = rows["fine"]
    for k in np.flatnonzero(good & (rows["n"][a] > 2 * SIGNATURE_BITS) & (rows["n"][b] > 2 * SIGNATURE_BITS)):
        x, y = (np.frombuffer(fine[i[k]], np.uint8) for i in (a, b))
        while len(x) != len(y):  # the halves of a signature give the one of half its length
            x, y = (x, y) if len(x) > len(y) else (y, x)
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        good[k] = int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= most[k]
    return good


def _numbers(batch: pa.RecordBatch, names) -> dict[str, np.ndarray]:
    out = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names}
    flat = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint64)
    fine = np.array(batch.column("fine").to_pylist(), dtype=object)
    return out | {"signature": flat.reshape(batch.num_rows, -1), "fine": fine}


def _list_ties(percent: int):
    """Ties (u, v) between sets whose lists cannot rule a link out, from lists sorted by set size."""

    def ties_of(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = np.stack([rows[k] for k in ("token", "low", "high")], 1)
        begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        bounds = np.append(begins, len(key))
        n, position = rows["n"], rows["position"]
        early = np.stack([rows[f"e{k}"] for k in range(1, EARLY + 1)], 1)
        # Sizes rise inside a list: past this place the other set is too large.
        stop = np.empty(len(key), np.int64)
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            stop[begin:end] = begin + np.searchsorted(n[begin:end], n[begin:end] * 100 // percent, "right")
        count = np.maximum(stop - np.arange(len(key)) - 1, 0)
        total = np.cumsum(count)
        at = 0
        while at < len(key):
            past = total[at - 1] if at else 0
            upto = max(int(np.searchsorted(total, past + PAIRS_AT_ONCE, "right")), at + 1)
            own = count[at:upto]
            a = np.repeat(np.arange(at, upto), own)
            b = a + 1 + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            at = upto
            good = (rows["low"][a] == rows["high"][a]) | (rows["chunk"][a] != rows["chunk"][b])
            need = -(-percent * (n[a] + n[b]) // (100 + percent))
            good &= np.minimum(position[a], position[b]) + np.minimum(n[a] - position[a], n[b] - position[b]) >= need
            a, b, need = a[good], b[good], need[good]
            good = _alike(rows, a, b, n[a] + n[b] - 2 * need)
            a, b = a[good], b[good]
            # The earliest shingle that both have first decides in which list they are looked at.
            shared = ((early[a][:, :, None] == early[b][:, None, :]) & (early[a] != 0)[:, :, None]).any(2)
            first = early[a, shared.argmax(1)]
            good = ~shared.any(1) | (first == rows["token"][a])
            a, b = a[good], b[good]
            if len(a):
                node, at_node = np.unique(rows["node"][np.concatenate([a, b])], return_inverse=True)
                least = tied(len(node), at_node[: len(a)], at_node[len(a) :])
                own = np.flatnonzero(least != np.arange(len(node)))
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[least[own]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "low", "high", "chunk", "node", "n", "position", *(f"e{k}" for k in range(1, EARLY + 1))]
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            now = _numbers(batch, names)
            if held is not None:
                now = {c: np.concatenate([held[c], now[c]]) for c in now}
            key = np.stack([now[k] for k in ("token", "low", "high")], 1)
            last = np.flatnonzero((key != key[-1]).any(1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from ties_of({c: v[:cut] for c, v in now.items()})
            held = {c: v[cut:] for c, v in now.items()}
        if held is not None and len(held["n"]):
            yield from ties_of(held)

    return run


class Overlaps:
    """Overlaps of the sets of a unit, derived from a similar set's where there is one."""

    def __init__(self, sets: dict[int, np.ndarray]):
        self.sets = sets
        self.done: dict[int, dict[int, int]] = {}
        self.derived = 0

    @staticmethod
    def _common(small: np.ndarray, large: np.ndarray) -> int:
        if not len(small) or not len(large):
            return 0
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        return int((large[at] == small).sum())

    def of(self, a: int, partners: list[int]) -> dict[int, int]:
        own, answers = self.sets[a], {}
        base = next((y for y in reversed(self.done) if a in self.done[y]), None)
        if base is not None:
            other = self.sets[base]
            lost = np.setdiff1d(other, own, assume_unique=True)
            won = np.setdiff1d(own, other, assume_unique=True)
            if len(lost) + len(won) > len(own):
                base = None
        for z in partners:
            if base is not None and z in self.done[base]:
                target = self.sets[z]
                answers[z] = self.done[base][z] - self._common(lost, target) + self._common(won, target)
                self.derived += 1
            else:
                answers[z] = self._common(own, self.sets[z])
        self.done[a] = answers
        if len(self.done) > 64:  # the latest are the likeliest to help
            self.done.pop(next(iter(self.done)))
        return answers


def _verify(percent: int):
    """Links inside units, from rows sorted by unit and set size. A unit has the pairs of its two parts.

    Sends (u, v, NULL) for the links of a spanning forest and (u, NULL, more) for
    the rows that are linked to a set in this unit.
    """

    def links(rows: dict[str, np.ndarray], tokens: list[np.ndarray]) -> pa.RecordBatch | None:
        # Rows of equal id and text give their set each; one is enough.
        one = np.sort(np.unique(rows["node"], return_index=True)[1])
        rows, tokens = {c: x[one] for c, x in rows.items()}, [tokens[k] for k in one]
        n, part, size = rows["n"], rows["part"], len(tokens)
        overlaps = Overlaps(dict(enumerate(tokens)))
        more = np.zeros(size, np.int64)
        root = list(range(size))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        forest = []
        stop = np.searchsorted(n, n * 100 // percent, "right")
        for a in range(size):
            b = np.arange(a + 1, stop[a])
            need = -(-percent * (n[a] + n[b]) // (100 + percent))
            b = b[_alike(rows, np.full(len(b), a), b, n[a] + n[b] - 2 * need)]
            low, high = np.minimum(part[a], part[b]), np.maximum(part[a], part[b])
            b = b[(low == rows["low"][0]) & (high == rows["high"][0])]
            for z, common in overlaps.of(a, b.tolist()).items() if len(b) else ():
                if 100 * common >= percent * int(n[a] + n[z] - common):
                    more[a] += rows["rows"][z]
                    more[z] += rows["rows"][a]
                    if find(a) != find(z):
                        root[find(z)] = find(a)
                        forest.append((a, z))
        node, own = rows["node"], np.flatnonzero(more)
        if not len(own):
            return None
        u = np.concatenate([node[own], node[[a for a, _ in forest]]])
        v = pa.array([None] * len(own) + node[[z for _, z in forest]].tolist(), pa.int64())
        counts = pa.array(more[own].tolist() + [None] * len(forest), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(u), v, counts], ["u", "v", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[dict[str, np.ndarray], list[np.ndarray]]] = []

        def out() -> Iterator[pa.RecordBatch]:
            rows = {c: np.concatenate([h[0][c] for h in held]) for c in held[0][0]}
            found = links(rows, [t for _, own in held for t in own])
            if found is not None:
                yield found

        for batch in batches:
            now = _numbers(batch, ("cluster", "low", "high", "part", "node", "n", "rows"))
            unit = np.stack([now[c] for c in ("cluster", "low", "high")], 1)
            lists = batch.column("tokens")
            tokens = [np.sort(lists[k].values.to_numpy().view(np.uint64)) for k in range(batch.num_rows)]
            edges = np.flatnonzero((unit[1:] != unit[:-1]).any(1)) + 1
            for lo, hi in zip(np.append(0, edges), np.append(edges, batch.num_rows), strict=True):
                if held and any(held[0][0][c][0] != now[c][lo] for c in ("cluster", "low", "high")):
                    yield from out()
                    held = []
                held.append(({c: x[lo:hi] for c, x in now.items()}, tokens[lo:hi]))
        if held:
            yield from out()

    return run


def _whole_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """f1, f2, tokens of the wanted classes and a few more, from one more pass over the texts.

    The buckets of the wanted rows are a sieve of fixed size; the join with the
    members of the units leaves what is wanted.
    """
    wanted = nodes.select((F.xxhash64("member")).alias("h"), "f1")

    def buckets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        h, f = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h", "f1"))
        yield words.mix(f + words.mix(h))

    sieve = docs.sparkSession.sparkContext.broadcast(np.packbits(_bucket_counts(wanted, buckets, NEEDED_BITS) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(sieve.value).astype(bool)
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for block in words.blocks(batch.column(0)):
                sets = words.shingle_sets(block, size)
                marks = [_fingerprint(own) for own in sets]
                first = np.array([m[0] for m in marks], np.uint64)
                spot = words.mix(first + words.mix(keys[block.first : block.first + len(block)]))
                good = np.flatnonzero(held[_bucket(spot, NEEDED_BITS).astype(np.int64)])
                if len(good):
                    yield pa.RecordBatch.from_arrays(
                        [_signed(first[good]), _signed([marks[k][1] for k in good]), _lists([sets[k] for k in good])],
                        ["f1", "f2", "tokens"],
                    )

    rows = docs.select("_text", F.xxhash64("_id").alias("_key"))
    return rows.mapInArrow(run, "f1 long, f2 long, tokens array<long>")


def _links(described: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """u, v, more: links that connect linked classes, and counts of linked rows."""
    reps = described.join(classes.select(F.col("node").alias("_row"), "node", "rows"), "_row")
    reps = materialize(reps.select("node", "n", "rows", "f1", "f2", F.col("_id").alias("member"), "prefix", "signature", "fine"))
    postings = reps.select("node", "n", F.posexplode("prefix").alias("position", "token"))
    # A list of two sets of unlike sizes has no link to find.
    live = (
        postings.groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"), F.min("n").alias("least"), F.max("n").alias("most"))
        .where(f"df > 2 or (df = 2 and 100 * least >= {percent} * most)")
        .select("token", "df")
    )
    own = (
        postings.drop("n")
        .join(live, "token")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("position", "token", "df"))).alias("live"))
        .select("node", "live", *(F.coalesce(F.get("live", F.lit(k))["token"], F.lit(0)).alias(f"e{k + 1}") for k in range(EARLY)))
    )
    entries = materialize(reps.select("node", "n", "rows", "signature", "fine").join(own, "node"))
    early = [f"e{k + 1}" for k in range(EARLY)]
    lists = entries.select("node", "n", "signature", "fine", *early, F.inline("live"))
    # A long list is cut into chunks; every two chunks meet in a list of their own.
    chunks = F.ceil(F.col("df") / LIST_ROWS)
    lists = lists.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))
    )
    lists = lists.select(
        "token",
        F.least("chunk", "other").alias("low"),
        F.greatest("chunk", "other").alias("high"),
        "chunk",
        "node",
        "n",
        "position",
        *early,
        "signature",
        "fine",
    )
    lists = lists.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "n", "node")
    clusters = components(lists.mapInArrow(_list_ties(percent), "u long, v long"))
    parts = F.ceil(F.col("size") / UNIT_SETS)
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = (
        clusters.join(sizes, "root")
        .select(F.col("root").alias("cluster"), "node", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).alias("part"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("cluster", "node", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    )
    needed = materialize(reps.select("node", "f1", "f2", "member").join(clusters.select("node"), "node"))
    about = entries.select("node", "n", "rows", "signature", "fine").join(needed.select("node", "f1", "f2"), "node")
    # Whole sets are shuffled twice: to what is known of them, then to the units.
    whole = about.join(_whole_sets(docs, needed, size), ["f1", "f2"]).drop("f1", "f2")
    rows = members.join(whole, "node").select("cluster", "low", "high", "part", "node", "n", "rows", "signature", "fine", "tokens")
    rows = rows.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "n", "node")
    return materialize(rows.mapInArrow(_verify(percent), "u long, v long, more long"))


def jaccard_classes(
    docs: DataFrame,
    size: int = 3,
    percent: int = 90,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: tuple[str, ...] = (),
    group: str | None = None,
) -> DataFrame:
    """id, the columns named in ``keep``, n_shingles, n_links, component_id of every row.

    Two rows are linked if 100 * intersection >= percent * union of their sets of
    ``size``-word shingles (a text with fewer words has its word sequence as its
    only shingle). ``n_links`` counts the linked rows, equal texts included, and
    ``component_id`` is the least id that links reach. NULL and empty texts, and
    texts of blanks, have no shingles and no links. Rows with equal ids count as
    rows of their own, so ``component_id`` does not tell groups apart where ids are
    NULL or repeated. ``group`` names a further column that does: a number that all
    rows of a group share and no others, NULL without shingles. Other columns are
    not read.
    """

    def shingles(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for block in words.blocks(batch.column(0)):
            own = words.shingle_sets(block, size)
            yield np.concatenate(own)

    # Names of our own, so that no name of the table is in the way.
    kept = {c: f"_keep{k}" for k, c in enumerate(keep)}
    rows = docs.select(
        docs[text_column].alias("_text"), docs[id_column].alias("_id"), *(docs[c].alias(own) for c, own in kept.items())
    )
    order = docs.sparkSession.sparkContext.broadcast(
        _bucket_counts(rows.select("_text"), shingles, ORDER_BITS).astype(np.uint32)
    )
    described = materialize(_describe(rows, order, size, percent).withColumn("_row", F.monotonically_increasing_id()))
    order.destroy()  # the table is written; driver and executors need not keep its copies
    classes = materialize(
        described.where("n > 0")
        .groupBy("f1", "f2", "n")
        .agg(F.min("_row").alias("node"), F.count(F.lit(1)).alias("rows"), F.min("_id").alias("least"))
    )
    links = _links(described, classes, rows, size, percent)
    rooted = components(links.where("v is not null").select("u", "v"))
    more = links.where("more is not null").groupBy(F.col("u").alias("node")).agg(F.sum("more").alias("more"))
    labelled = rooted.join(classes.select("node", "least"), "node")
    least = labelled.groupBy("root").agg(F.min("least").alias("component"))
    grouped = rooted.join(least, "root").select("node", "component", *(["root"] if group else []))
    info = classes.join(more, "node", "left").join(grouped, "node", "left").select(
        "f1",
        "f2",
        "n",
        (F.col("rows") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
        F.coalesce("component", "least").alias("component_id"),
        *([F.coalesce("root", "node").alias("_group")] if group else []),
    )
    return described.drop("prefix", "signature", "fine", "_row").join(info, ["f1", "f2", "n"], "left").select(
        F.col("_id").alias(id_column),
        *(F.col(own).alias(c) for c, own in kept.items()),
        F.col("n").alias("n_shingles"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "_id").alias("component_id"),
        *([F.col("_group").alias(group)] if group else []),
    )
