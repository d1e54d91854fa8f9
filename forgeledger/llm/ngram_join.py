"""Jaccard join of word n-gram sets by signature trees.

A document's set is its distinct shingles of lower-cased words, as 64-bit hashes. Rows with equal sets are
one class, and everything below works on one row of each class.

Two sets of the wanted similarity have a shingle in common among the first fifth of each, in any order that is the
same for all sets (prefix filter). The order puts shingles that very many documents hold last, as far as a bounded
count over all documents names them, so that common passages hardly enter a prefix. The sets that meet under a shingle
are a list, of those whose sizes, and places of the shingle in the order, allow that it is the first that similar
sets have in common. A list is named by its members, so equal lists are one. All this is exact: order and bounds
change the work, not the links.

A list, or a block of a long one, is joined in a task by signature trees. Its sets, sorted by size, are the leaves, each
with a bitmap of its shingles; a node holds the OR of the bitmaps below it, the range of sizes, and by how much a set
below it can exceed the bits it sets. Two trees, or one and itself, are traversed together from their roots: a pair of
nodes is dropped when the sizes do not allow the similarity, when the bits they share allow too small an overlap, or
when nothing is left to find below it. A first traversal, over bitmaps alone, leaves the sets that may have a partner;
only their texts are fetched, and a second one decides the pairs of leaves it reaches on the sets themselves. It returns a
spanning forest of the links it found, never pairs.

First every class meets the others of its two smallest lists. That ties copies together. What is left are lists that
still hold more than one component: there the largest component's members meet the others, and the others meet each
other. So many copies of one text cost no more than their number. Blocks of others grow with the square of their
number in a list; these are sets that share a rare shingle and a size and are no copies.

Columns ``doc_id`` and ``text`` are read; others are ignored. Null and blank texts have empty sets and no links. Every
row is a document of its own: rows that repeat an id and a text have equal results, rows of one id with different
texts each have that of their text, and rows without an id link others like any. ``component_id`` is
the smallest id reachable; it is null where no row reachable has one. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, durable_counted
from . import words as W
from .components import components
from .frames import per_batch, sorted_runs

SHINGLE = 5
#: 100 * intersection >= PERCENT * union
PERCENT = 80
#: Sets, and shingles of them, that a task joins at a time.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Shingles that come last in the order, and those a task counts for it.
LOUD, COUNTED = 1 << 16, 1 << 13
FANOUT = 8
#: Bits of a set's bitmap, at least and at most.
LEAST_BITS, MOST_BITS = 64, 1 << 16
#: Members of a run whose pairs are looked at for sizes and places; members of a run that a task holds.
SHORT, LONGEST = 8, 1 << 16
_NODE_PAIRS, _SALTS, _MARKS = 1 << 14, 256, 1 << 20


def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every row's distinct shingle hashes, sorted, and the rows' offsets."""
    return W.distinct_by_row(*W.shingles(*W.word_hashes(column, lower=True), SHINGLE))


def prefix_length(size: int, percent: int) -> int:
    """Shingles of a set of which one at least is in the prefix of any set similar enough."""
    return size - -(-percent * size // 100) + 1


class SignatureTree:
    """Bitmaps of sets, and of all sets below a node, level by level from the leaves up."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, height: int):
        self.maps, self.low, self.high = [maps], [sizes], [sizes]
        self.excess = [sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)]
        for _ in range(height):
            begin = np.arange(0, len(self.low[-1]), FANOUT)
            self.maps.append(np.bitwise_or.reduceat(self.maps[-1], begin, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], begin))
            self.high.append(np.maximum.reduceat(self.high[-1], begin))
            self.excess.append(np.maximum.reduceat(self.excess[-1], begin))
        self.height = height


def bitmaps(values: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """A row of ``bits`` bits for each set, as 64-bit words; a shingle sets the bit that its last digits name."""
    n = len(ends) - 1
    maps = np.zeros((n, bits // 8), np.uint8)
    step = max(1, (1 << 25) // bits)
    for at in range(0, n, step):
        to = min(n, at + step)
        spread = np.zeros((to - at, bits), bool)
        rows = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))
        spread[rows, (values[ends[at] : ends[to]] & np.uint64(bits - 1)).astype(np.int64)] = True
        maps[at:to] = np.packbits(spread, axis=1, bitorder="little")
    return maps.view(np.uint64)


def map_bits(size: int) -> int:
    """Bits of a set's bitmap: sets similar enough have the same number of them or twice as many."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (4 * size - 1).bit_length()))


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """The bitmaps that the same sets have with fewer bits."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def _overlap_needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of two similar sets that have at least ``a`` and ``b`` elements."""
    both = -(-percent * (a + b) // (100 + percent))
    return np.maximum(both, -(-percent * np.maximum(a, b) // 100))


def _possible(x: SignatureTree, y: SignatureTree, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of nodes below which similar sets may be."""
    a, b = x.maps[level][i], y.maps[level][j]
    low = _overlap_needed(x.low[level][i], y.low[level][j], percent)
    most = np.bitwise_count(a & b).sum(1, dtype=np.int64) + np.minimum(x.excess[level][i], y.excess[level][j])
    possible = most >= low
    possible &= (100 * x.high[level][i] >= percent * y.low[level][j]) & (100 * y.high[level][j] >= percent * x.low[level][i])
    if not level:
        # Every bit that the other set lacks is an element that it lacks.
        possible &= x.low[0][i] - np.bitwise_count(a & ~b).sum(1, dtype=np.int64) >= low
        possible &= y.low[0][j] - np.bitwise_count(b & ~a).sum(1, dtype=np.int64) >= low
    return possible


def traverse(x: SignatureTree, y: SignatureTree, settled: Callable, visit: Callable, percent: int) -> None:
    """Follow pairs of nodes from the roots of two trees, or of one and itself, down to pairs of sets, depth first.

    A pair is left where no similar sets can be below it, or where ``settled(level, i, j)`` says that nothing is
    left to find. ``visit(i, j)`` gets the pairs of sets that may be similar.
    """
    itself, children = x is y, np.arange(FANOUT)
    stack = [(x.height, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if itself and not level:
            i, j = i[i < j], j[i < j]
        for left_out in (settled, lambda level, i, j: ~_possible(x, y, level, i, j, percent)):
            stay = ~left_out(level, i, j)
            i, j = i[stay], j[stay]
        if not level:
            if len(i):
                visit(i, j)
            continue
        i, j = np.add.outer(i * FANOUT, children)[:, :, None], np.add.outer(j * FANOUT, children)[:, None, :]
        i, j = (z.ravel() for z in np.broadcast_arrays(i, j))
        there = (i < len(x.low[level - 1])) & (j < len(y.low[level - 1]))
        if itself:
            there &= i <= j
        i, j = i[there], j[there]
        # Near the diagonal first: sets of about equal size are the likely copies, and ties spare the rest.
        nearest = np.argsort(np.abs(j - i), kind="stable") if itself else np.arange(len(i))
        for at in reversed(range(0, len(i), _NODE_PAIRS)):
            own = nearest[at : at + _NODE_PAIRS]
            stack.append((level - 1, i[own], j[own]))


def _height(n: int) -> int:
    height = 0
    while n > 1:
        height, n = height + 1, -(-n // FANOUT)
    return height


class Below:
    """A value of every set, and the least and greatest below every node, until the values change."""

    def __init__(self, values: Callable[[], np.ndarray]):
        self._values, self._known = values, {}

    def __call__(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if level not in self._known:
            values = self._values()
            begin = np.arange(0, len(values), FANOUT**level)
            self._known[level] = np.minimum.reduceat(values, begin), np.maximum.reduceat(values, begin)
        least, most = self._known[level]
        return least[nodes], most[nodes]

    def changed(self) -> None:
        self._known = {}


class Ties:
    """Which sets are tied to each other; links that tie more are kept."""

    def __init__(self, known: np.ndarray):
        first: dict[int, int] = {}
        self.above = [first.setdefault(int(k), i) for i, k in enumerate(known)]
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        above = self.above
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    def tie(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.above[max(a, b)] = min(a, b)
        self.links.append((i, j))

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.above))])


def forest(members: list[np.ndarray], known: np.ndarray, side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that tie similar sets together, beyond what ``known`` ties; across the two sides only, if there are two."""
    order = sorted(range(len(members)), key=lambda i: (side[i], len(members[i]), int(members[i][0])))
    own = [members[i] for i in order]
    ties, split = Ties(known[order]), int((side == side.min()).sum())
    ends = np.concatenate([[0], np.cumsum([len(m) for m in own])])
    bits = map_bits(int(np.diff(ends).max()))
    while bits > LEAST_BITS and len(own) * bits > 1 << 28:
        bits //= 2
    maps, sizes, height = bitmaps(np.concatenate(own), ends, bits), np.diff(ends), _height(max(split, len(own) - split))
    x = SignatureTree(maps[:split], sizes[:split], height)
    y = SignatureTree(maps[split:], sizes[split:], height) if split < len(own) else x
    shift = split if y is not x else 0
    roots = Below(lambda: ties.roots()[:split]), Below(lambda: ties.roots()[shift:] if shift else ties.roots())

    def settled(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (a, b), (c, d) = roots[0](level, i), roots[1](level, j)
        return (a == b) & (c == d) & (a == c)

    def visit(i: np.ndarray, j: np.ndarray) -> None:
        before = len(ties.links)
        for a, b in zip(i.tolist(), (j + shift).tolist(), strict=True):
            if ties.root(a) != ties.root(b):
                common = len(own[a]) + len(own[b]) - len(np.unique(np.concatenate([own[a], own[b]])))
                if 100 * common >= percent * (len(own[a]) + len(own[b]) - common):
                    ties.tie(a, b)
        if len(ties.links) > before:
            for r in roots:
                r.changed()

    if y is x and len(own) > 1:
        at = np.arange(len(own) - 1)
        likely = at[_possible(x, x, 0, at, at + 1, percent)]
        visit(likely, likely + 1)
    traverse(x, y, settled, visit, percent)
    return [(order[a], order[b]) for a, b in ties.links]


def partnered(maps: list[np.ndarray], sizes: np.ndarray, known: np.ndarray, side: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which sets may be similar to another one that is not tied to them by ``known``, as far as their bitmaps tell."""
    marked = np.zeros(len(maps), bool)
    words = np.array([len(m) for m in maps])
    parts = {}
    for s in np.unique(side):
        for w in np.unique(words):
            own = np.flatnonzero((side == s) & (words == w))
            if len(own):
                own = own[np.lexsort((known[own], sizes[own]))]
                parts[int(s), int(w)] = own, np.stack([maps[i] for i in own])
    two = len(np.unique(side)) > 1

    def meet(left: tuple, right: tuple, w: int) -> None:
        (own, own_maps), (others, other_maps) = left, right
        height = _height(max(len(own), len(others)))
        x = SignatureTree(folded(own_maps, w), sizes[own], height)
        y = x if left is right else SignatureTree(folded(other_maps, w), sizes[others], height)
        ties, marks = [Below(lambda o=o: known[o]) for o in (own, others)], [Below(lambda o=o: marked[o]) for o in (own, others)]

        def settled(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            (a, b), (c, d) = ties[0](level, i), ties[1](level, j)
            return ((a == b) & (c == d) & (a == c)) | (marks[0](level, i)[0] & marks[1](level, j)[0])

        def visit(i: np.ndarray, j: np.ndarray) -> None:
            marked[own[i]] = marked[others[j]] = True
            for m in marks:
                m.changed()

        traverse(x, y, settled, visit, percent)

    for (s, w), part in parts.items():
        for (t, v), other in parts.items():
            if (s < t if two else True) and (v in (w, 2 * w) if not two else v in (w, 2 * w, w // 2)):
                meet(part, other, min(w, v))
    return marked


def _linked(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """``a, b`` of a forest of the links inside each block of a list."""
    for run in sorted_runs(batches, ["list", "part"]):
        if run.num_rows < 2:
            continue
        members: list[np.ndarray] = []
        for piece in run["text"].chunks:
            values, ends = sets(piece)
            members += [values[a:b].copy() for a, b in zip(ends, ends[1:], strict=False)]
        ids = run["cid"].to_numpy()
        links = forest(members, run["component"].to_numpy(), run["side"].to_numpy(), percent)
        if links:
            a, b = np.array(links).T
            yield pa.record_batch({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})


def _partnered(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The members of each block of a list that may have a partner there, by their bitmaps."""
    for run in sorted_runs(batches, ["list", "part"]):
        if run.num_rows < 2:
            continue
        maps = [np.frombuffer(m, np.uint64) for m in run["bitmap"].to_pylist()]
        columns = [run[c].to_numpy() for c in ("size", "component", "side")]
        hit = partnered(maps, *columns, percent)
        if hit.any():
            table = run.select(["list", "part", "side", "cid", "component"]).filter(pa.array(hit))
            yield from table.combine_chunks().to_batches()


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows the shingles that most of them hold, as far as a bounded count tells."""
    held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        values, _ = sets(batch.column(0))
        found, n = np.unique(values, return_counts=True)
        found, n = np.concatenate([held[0], found[n > 1]]), np.concatenate([held[1], n[n > 1]])
        found, where = np.unique(found, return_inverse=True)
        n = np.bincount(where, n, len(found)).astype(np.int64)
        most = np.argsort(-n, kind="stable")[:COUNTED]
        held = found[most], n[most]
    if len(held[0]):
        yield pa.record_batch({"token": pa.array(held[0].view(np.int64)), "n": pa.array(held[1])})


def loud_shingles(docs: DataFrame) -> np.ndarray:
    """The hashes, at most ``LOUD``, of shingles that most documents hold; sorted. Its size does not grow with the data."""
    counts = docs.select("text").mapInArrow(_counted, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    most = counts.orderBy(F.desc("n"), "token").limit(LOUD).select("token").toPandas()
    return np.sort(most["token"].to_numpy(np.int64).view(np.uint64))


def _sign(batch: pa.RecordBatch, loud: np.ndarray, percent: int) -> pa.RecordBatch:
    """The size, digest and bitmap of every row's set, and its prefix, the shingles that are not loud first."""
    values, ends = sets(batch.column(1))
    last = np.zeros(len(values), bool)
    if len(loud):
        last = loud[np.minimum(np.searchsorted(loud, values), len(loud) - 1)] == values
    sizes, kinds, prefixes, quiet, maps = np.diff(ends), [], [], [], []
    for a, b in zip(ends, ends[1:], strict=False):
        own, n = values[a:b], prefix_length(int(b - a), percent) if b > a else 0
        if last[a:b].any():
            own = np.concatenate([own[~last[a:b]], own[last[a:b]]])
        kinds.append(hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None)
        maps.append(bitmaps(values, np.array([a, b]), map_bits(int(b - a))).tobytes() if b > a else None)
        prefixes.append(own[:n].view(np.int64))
        quiet.append(min(n, int(b - a - last[a:b].sum())))
    spans = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
    tokens = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
    return pa.record_batch(
        {
            "doc_id": batch.column(0),
            "n_shingles": pa.array(sizes, pa.int64()),
            "set_hash": pa.array(kinds, pa.binary()),
            "text_hash": batch.column(2),
            "prefix": pa.ListArray.from_arrays(pa.array(spans), pa.array(tokens)),
            "n_quiet": pa.array(quiet, pa.int32()),
            "bitmap": pa.array(maps, pa.binary()),
        }
    )


def _lists(token: np.ndarray, cid: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> dict[str, np.ndarray]:
    """Of whole runs of equal shingles, by size, the members that may meet a similar set there for the first time."""
    new = np.append(True, token[1:] != token[:-1])
    run = np.cumsum(new) - 1
    length = np.bincount(run)[run]
    kept = np.zeros(len(token), bool)
    for d in range(1, SHORT):
        i = np.flatnonzero((run[:-d] == run[d:]) & (length[:-d] <= SHORT)) if d < len(token) else []
        if not len(i):
            break
        j = i + d
        # Two sets whose first common shingle comes at these places have no more in common than what is left of each.
        least = _overlap_needed(size[i], size[j], percent)
        good = (100 * size[i] >= percent * size[j]) & (size[i] - place[i] >= least) & (size[j] - place[j] >= least)
        kept[i[good]] = kept[j[good]] = True
    # In a longer run the neighbours by size tell whether there is a set of about the same size.
    near = (run[:-1] == run[1:]) & (length[:-1] > SHORT) & (100 * size[:-1] >= percent * size[1:])
    kept[:-1] |= near
    kept[1:] |= near
    cid, size, run = cid[kept], size[kept], run[kept]
    begin = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
    if not len(begin):
        return {}
    n = np.diff(np.append(begin, len(run)))
    # A list is named by its members: lists of the same members are one.
    name = np.bitwise_xor.reduceat(W.mix(cid.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)), begin).view(np.int64)
    columns = {"list": np.repeat(name, n), "n": np.repeat(n, n), "shingles": np.repeat(np.add.reduceat(size, begin), n)}
    return columns | {"cid": cid, "size": size}


def _shared(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Lists of the sets that meet under a shingle, from rows sorted by shingle and size; a run in memory is bounded.

    Longer runs, and those of loud shingles, come as they are, named by their shingle, without ``n`` and ``shingles``.
    """

    def whole(columns: list[np.ndarray]) -> pa.RecordBatch:
        found = _lists(*columns, percent)
        order = ("list", "n", "shingles", "cid", "size")
        return pa.record_batch([pa.array(found.get(c, np.zeros(0, np.int64)), pa.int64()) for c in order], list(order))

    def as_it_is(columns: list[np.ndarray]) -> pa.RecordBatch:
        token, cid, size, _ = columns
        none = pa.nulls(len(token), pa.int64())
        return pa.record_batch([pa.array(token), none, none, pa.array(cid), pa.array(size)], ["list", "n", "shingles", "cid", "size"])

    held, long_token = [np.zeros(0, np.int64)] * 4, None
    for batch in batches:
        if not batch.num_rows:
            continue
        token, cid, packed, salt = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("token", "cid", "packed", "salt"))
        columns = [token, cid, packed >> 32, packed & 0xFFFFFFFF]
        ready = (salt >= 0) | ((token == long_token) if long_token is not None else False)
        if ready.any():
            yield as_it_is([c[ready] for c in columns])
            columns = [c[~ready] for c in columns]
        columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        if not len(columns[0]):
            held = columns
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if last:
            yield whole([c[:last] for c in columns])
        held = [c[last:] for c in columns]
        if len(held[0]) > LONGEST:
            long_token = int(held[0][0])
            yield as_it_is(held)
            held = [np.zeros(0, np.int64)] * 4
    if len(held[0]):
        yield whole(held)


def _postings(heads: DataFrame, percent: int) -> DataFrame:
    """``list, n, shingles, cid, size``: the lists that classes meet in, each once."""
    spark = heads.sparkSession
    exploded = heads.select("cid", "size", "n_quiet", F.posexplode("prefix").alias("place", "token"))
    salt = F.when(F.col("place") >= F.col("n_quiet"), F.pmod(F.xxhash64("cid"), F.lit(_SALTS))).otherwise(-1).cast("int")
    rows = exploded.select("token", "cid", (F.col("size") * F.lit(1 << 32) + F.col("place")).alias("packed"), salt.alias("salt"))
    # Only runs that stay in one task are searched, so loud shingles are dealt out.
    sorted_rows = rows.repartition("token", "salt").sortWithinPartitions("token", "packed")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(1 << 16))  # the rows are short
    shape = "list bigint, n bigint, shingles bigint, cid bigint, size bigint"
    try:
        found = durable(sorted_rows.mapInArrow(partial(_shared, percent=percent), shape), "shared")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    long = found.where("n is null").select("list", "cid", "size")
    counts = long.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).where("n > 1")
    long = long.join(counts.hint("merge"), "list").select(*found.columns)
    return durable(found.where("n is not null").distinct().unionAll(long), "postings")


def _blocks(n: Column, shingles: Column) -> Column:
    """Blocks into which a list of so many sets with so many shingles is dealt."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1).cast("bigint"))


class _Rows:
    """Bitmaps and texts of the rows that stand for the classes."""

    def __init__(self, signed: DataFrame, docs: DataFrame):
        self.signed, self.docs = signed, docs

    def bitmaps(self, members: DataFrame) -> DataFrame:
        own = self.signed.select(F.col("rid").alias("cid"), F.col("n_shingles").alias("size"), "bitmap")
        return members.join(own.hint("merge"), "cid")

    def texts(self, members: DataFrame) -> DataFrame:
        """``members`` with ``text``. Only rows that may be wanted are shuffled with their texts, each once."""
        wanted = self.signed.select(F.col("rid").alias("cid"), "doc_id", "text_hash").join(members.select("cid").distinct().hint("merge"), "cid", "left_semi")
        wanted = durable(wanted.select("cid", F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("id_hash"), "text_hash"), "wanted-texts")
        # At most as many numbers as there are marks, whatever the data.
        mark = F.pmod("text_hash", F.lit(_MARKS))
        marks = F.broadcast(wanted.select(mark.cast("int").alias("mark")).distinct())
        rows = self.docs.select("text", "text_hash", F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("id_hash"), mark.cast("int").alias("mark"))
        near = rows.join(marks, "mark", "left_semi").select("text_hash", "id_hash", "text").dropDuplicates(["text_hash", "id_hash"])
        bodies = near.join(wanted.hint("merge"), ["text_hash", "id_hash"]).select("cid", "text")
        return members.join(bodies.hint("merge"), "cid")


def _links(members: DataFrame, rows: _Rows, percent: int) -> DataFrame:
    """Links among ``members``, rows ``list, part, side, cid, component``: first by bitmaps, then by the sets themselves."""
    dealt = rows.bitmaps(members).select("list", "part", "side", "cid", "component", "size", "bitmap")
    dealt = dealt.repartition("list", "part").sortWithinPartitions("list", "part")
    shape = "list bigint, part bigint, side bigint, cid bigint, component bigint"
    hits = durable(dealt.mapInArrow(partial(_partnered, percent=percent), shape), "partnered")
    dealt = rows.texts(hits).select("list", "part", "side", "cid", "component", "text")
    dealt = dealt.repartition("list", "part").sortWithinPartitions("list", "part")
    return dealt.mapInArrow(partial(_linked, percent=percent), "a bigint, b bigint")


def _open_lists(posted: DataFrame, met: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of the lists that hold several components and have not met in one block, dealt into blocks.

    The members of a list's largest component do not meet each other.
    """
    key = ["list", "n", "shingles"]
    sized = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("reach"))
    known = durable(groups.join(sized.hint("merge"), "component_id").select(F.col("id").alias("cid"), "component_id", "reach"), "known-components")
    unmet = posted.join(met.hint("merge"), key, "left_anti")
    placed = unmet.join(known.hint("merge"), "cid", "left").select(
        *key, "cid", "size", F.coalesce("component_id", "cid").alias("component"), F.coalesce("reach", F.lit(1)).alias("reach")
    )
    placed = durable(placed, "placed-postings")
    lists = placed.groupBy(*key).agg(
        F.min("component").alias("least"), F.max("component").alias("greatest"), F.max(F.struct("reach", "component"))["component"].alias("main")
    )
    lists = durable(lists.where("least <> greatest").select(*key, "main", (_blocks(F.col("n"), F.col("shingles")) == 1).alias("whole")), "open-lists")
    members = placed.join(lists.hint("merge"), key).withColumn("in_main", F.col("component") == F.col("main"))
    sides = members.where("not whole").groupBy(*key, "in_main").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("held"))
    own = _blocks(F.col("m"), F.col("held"))
    blocks = sides.groupBy(*key).agg(F.max(F.when(F.col("in_main"), own)).alias("mains"), F.max(F.when(~F.col("in_main"), own)).alias("others"))
    zero = F.lit(0).cast("bigint")
    small = members.where("whole").select("list", zero.alias("part"), zero.alias("side"), "cid", "component")
    count = F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))
    large = members.where("not whole").join(blocks.hint("merge"), key).withColumn("own", F.pmod(F.xxhash64("cid", "list"), count))
    numbers = lambda n: F.sequence(zero, F.col(n) - 1)
    part = lambda a, b, kind: (a * F.lit(1 << 30) + b + F.lit(kind << 61)).alias("part")
    side = F.col("own")
    # A block of the others meets every block of theirs and of the main component's.
    with_main = F.when(F.col("in_main"), F.transform(numbers("others"), lambda x: F.struct(part(side, x, 1), zero.alias("side"))))
    with_main = with_main.otherwise(F.transform(numbers("mains"), lambda x: F.struct(part(x, side, 1), F.lit(1).cast("bigint").alias("side"))))
    with_others = F.transform(numbers("others"), lambda x: F.struct(part(F.least(side, x), F.greatest(side, x), 2), side.alias("side")))
    meetings = F.when(F.col("in_main"), with_main).otherwise(F.concat(with_main, with_others))
    large = large.withColumn("meeting", F.explode(meetings)).select("list", "meeting.part", "meeting.side", "cid", "component")
    return small.unionAll(large)


def linked_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: its set's size and the smallest id that links reach."""
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text, F.length(text)).alias("text_hash"))
    loud = loud_shingles(docs)
    shape = "doc_id bigint, n_shingles bigint, set_hash binary, text_hash bigint, prefix array<bigint>, n_quiet int, bitmap binary"
    signed = per_batch(docs, partial(_sign, loud=loud, percent=percent), shape)
    signed = durable(signed.withColumn("rid", F.monotonically_increasing_id()), "signed-sets")
    rows = _Rows(signed, docs)
    # Equal sets are one class, named by one of its rows; all of them have the same prefix.
    alike = signed.where("set_hash is not null")
    heads = alike.groupBy("set_hash").agg(
        F.min("rid").alias("cid"), F.first("n_shingles").alias("size"), F.first("n_quiet").alias("n_quiet"), F.first("prefix").alias("prefix")
    )
    posted = _postings(heads, percent)
    key = ["list", "n", "shingles"]
    # Every class meets the others of its two smallest lists first.
    smallest = posted.groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct(*key))), 1, 2).alias("first"))
    first = smallest.select("cid", F.explode("first").alias("list")).select("cid", "list.*")
    first = durable(first.withColumn("part", F.pmod(F.xxhash64("cid", "list"), _blocks(F.col("n"), F.col("shingles")))), "first-lists")
    # Lists of one block that all their members chose are done with.
    met = first.where(_blocks(F.col("n"), F.col("shingles")) == 1).groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where("m = n").select(*key)
    begun = first.select("list", "part", F.lit(0).cast("bigint").alias("side"), "cid", F.col("cid").alias("component"))
    links = durable(_links(begun, rows, percent), "first-links")
    groups = durable(components(links), "first-components")
    opened = durable(_open_lists(posted, met, groups), "open-members")
    more, n_more = durable_counted(_links(opened, rows, percent), F.lit(True), "more-links")
    if n_more:
        groups = components(links.unionAll(more))
    classes = durable(alike.groupBy("set_hash").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("least")), "set-classes")
    tied = classes.join(groups.hint("merge"), F.col("cid") == F.col("id"), "left")
    tied = durable(tied.select("set_hash", "least", F.coalesce("component_id", "cid").alias("component")), "tied-classes")
    least = tied.groupBy("component").agg(F.min("least").alias("component_id"))
    named = durable(tied.join(least.hint("merge"), "component").select("set_hash", "component_id"), "named-classes")
    return signed.select("doc_id", "n_shingles", "set_hash").join(named.hint("merge"), "set_hash", "left").select(
        "doc_id", "n_shingles", F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
