"""Passages of a benchmark in documents: SimHash of item-sized windows, then exact weighted similarity.

An item is the multiset of its lower-cased word shingles; a window is as many consecutive shingles of a
document as the item has, or the whole document if that is shorter. A window matches an item when the sum
of the smaller counts is at least 0.75 of the sum of the larger ones.

1. Such a window holds at least ``1.5 / 1.75`` of its shingles in the benchmark. Sums over a document's shingles
   that are in the benchmark leave the windows that can match; none that matches is lost.
2. These windows have a 64-bit SimHash. A shingle votes once for each time it occurs, the n-th time with a hash of its own, so
   that votes are distinct and similarity is the share of equal ones, repeats or not. Fingerprints are cut into ``BLOCKS``
   blocks of eight bits; two within ``RADIUS`` bits have a block within ``RADIUS // BLOCKS`` bits, so bitmaps of the items that
   near to a value, for each block and value, hold every item within the radius. Shingle multisets of similarity
   0.75 differ in 11 bits on average (deviation 3), so the radius is more than five deviations away. At that radius
   the blocks leave out few of the other items; their distance and step 1 do. The index has 256 bytes an item.
3. The counts of a window and of the items found are compared exactly.

Documents are not shuffled. Items go to the tasks in slices of at most ``SLICE_BYTES`` of text, one pass over the
documents for each slice. Items of fewer than five words match where their word sequence occurs.

Columns ``doc_id, text`` and ``item_id, text`` are read. Null and empty texts match nothing. Rows without an id
are compared like others; repeated documents and items give repeated rows. Empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import words as W
from .frames import per_batch

SHINGLE, PERCENT = 5, 75
RADIUS, BLOCKS = 28, 8
SLICE_BYTES = 8 << 20

#: Which values of a block of eight bits are near to which.
_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= RADIUS // BLOCKS
#: Bytes of the lists of items that are looked at together.
_LISTED = 1 << 18
_FIRST = 1 << 20
_NTH = np.uint64(0x9E3779B97F4A7C15)


def _counts(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each value occurs in the ``size`` values that end with it, and in those that begin with it."""
    n = len(hashes)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    group = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) * n
    place, at = group + order, np.arange(n)
    ending, beginning = np.empty(n, np.int64), np.empty(n, np.int64)
    ending[order] = at + 1 - np.searchsorted(place, group + np.maximum(order - size + 1, 0))
    beginning[order] = np.searchsorted(place, group + np.minimum(order + size, n)) - at
    return ending, beginning


def _votes(hashes: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Running sums of the bits' votes, the ``nth`` occurrence of a value voting by a hash of its own."""
    own = np.where(nth > 1, W.mix(hashes + nth.astype(np.uint64) * _NTH), hashes)
    votes = ((own[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int32) * 2 - 1
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(votes, 0, dtype=np.int32)])


def fingerprints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of ``hashes[s : s + size]`` for each of the ascending ``starts``."""
    out = np.zeros(len(starts), np.uint64)
    shifts = np.arange(64, dtype=np.uint64)
    # Starts that lie close together share a running sum of votes; a far one begins a new sum.
    cuts = np.flatnonzero(np.diff(starts) > size) + 1
    for run in np.split(np.arange(len(starts)), cuts):
        for part in np.array_split(run, max(1, len(run) // 4096)):
            low, high = starts[part[0]], starts[part[-1]] + size
            # A value that enters the window is its last occurrence there; one that leaves takes the last vote of its kind along.
            ending, beginning = _counts(hashes[low:high], size)
            entered = _votes(hashes[low:high], ending)
            left = _votes(hashes[low:high], beginning) if (ending > 1).any() else entered
            at = starts[part] - low
            bits = (entered[at + size] - left[at] > 0).astype(np.uint64)
            out[part] = (bits << shifts).sum(1, dtype=np.uint64)
    return out


class _Items:
    """One slice of the benchmark: counts, and an index of fingerprints for each number of shingles."""

    def __init__(self, items: list[tuple[int | None, str]]):
        hashes, ends = W.word_hashes(pa.array([t for _, t in items], pa.string()), lower=True)
        self.short: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        self.counts: dict[int, tuple] = {}
        self.by_size: dict[int, list[int]] = defaultdict(list)
        known: list[np.ndarray] = []
        self.ids = [i for i, _ in items]
        for k, (a, b) in enumerate(pairwise(ends)):
            if 0 < b - a < SHINGLE:
                self.short[int(b - a)][int(W.rolling(hashes[a:b], int(b - a))[0])].append(k)
            elif b > a:
                own = W.rolling(hashes[a:b], SHINGLE)
                self.counts[k] = (own, *np.unique(own, return_counts=True))
                self.by_size[len(own)].append(k)
                known.append(own)
        self.known = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        # The items of each shingle, one after another.
        held = np.concatenate([self.counts[k][1] for k in self.counts]) if known else self.known
        of = np.repeat(np.fromiter(self.counts, np.int64, len(self.counts)), np.array([len(c[1]) for c in self.counts.values()], np.int64))
        order = np.argsort(held, kind="stable")
        self.holders, self.begins = of[order], np.append(np.searchsorted(held[order], self.known), len(held))
        self.first = np.zeros(_FIRST, bool)
        self.first[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.index: dict[int, tuple] = {}

    def holds(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles are in the benchmark."""
        out = self.first[(shingles >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        place = np.searchsorted(self.known, shingles[at])
        out[at] = self.known[np.minimum(place, len(self.known) - 1)] == shingles[at] if len(self.known) else False
        return out

    def near(self, size: int, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of a window's number and an item whose fingerprints are within the radius."""
        if size not in self.index:
            own = np.array([fingerprints(self.counts[k][0], np.zeros(1, np.int64), size)[0] for k in self.by_size[size]], np.uint64)
            # For every value of every block a bitmap of the items that are near to it there: 256 bytes an item.
            blocks = own.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
            self.index[size] = own, np.stack([np.packbits(_NEAR[:, blocks[:, b]], axis=1, bitorder="little") for b in range(BLOCKS)])
        own, tables = self.index[size]
        step = max(1, _LISTED // tables.shape[2])
        for at in range(0, len(prints), step):
            some = prints[at : at + step]
            blocks = some.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
            found = tables[0][blocks[:, 0]]
            for b in range(1, BLOCKS):
                found |= tables[b][blocks[:, b]]
            window, byte = np.nonzero(found)
            which, bit = np.nonzero(np.unpackbits(found[window, byte][:, None], axis=1, bitorder="little"))
            window, item = window[which], byte[which] * 8 + bit
            within = np.bitwise_count(some[window] ^ own[item]) <= RADIUS
            yield from zip((at + window[within]).tolist(), [self.by_size[size][i] for i in item[within].tolist()], strict=True)

    def sharing(self, window: np.ndarray) -> set[int]:
        """The items that hold one at least of a window's shingles."""
        place = np.searchsorted(self.known, np.unique(window))
        return set(np.concatenate([self.holders[self.begins[p] : self.begins[p + 1]] for p in place]).tolist())

    def similarity(self, window: np.ndarray, item: int) -> tuple[int, int]:
        """Sums of the smaller and of the larger counts."""
        _, values, counts = self.counts[item]
        own, own_counts = np.unique(window, return_counts=True)
        _, a, b = np.intersect1d(own, values, assume_unique=True, return_indices=True)
        both = int(np.minimum(own_counts[a], counts[b]).sum())
        return both, len(window) + int(counts.sum()) - both

    def matches(self, hashes: np.ndarray) -> dict[int, tuple[float, int]]:
        """The best similarity and its first word for each item that a document holds."""
        best: dict[int, tuple[float, int]] = {}
        for n, sequences in self.short.items():
            own = W.rolling(hashes, n)
            for place in np.flatnonzero(np.isin(own, np.fromiter(sequences, np.uint64, len(sequences))))[::-1]:
                for k in sequences[int(own[place])]:
                    best[k] = (1.0, int(place))
        own = W.rolling(hashes, SHINGLE)
        hit = self.holds(own)
        if not hit.any():
            return best
        before = np.concatenate([[0], np.cumsum(hit)])
        total = int(before[-1])
        for size in self.by_size:
            # A shorter document is one window as a whole.
            width = min(size, len(own))
            if (100 + PERCENT) * total < PERCENT * (width + size):
                continue
            held = before[width:] - before[: len(before) - width]
            # both >= 0.75 (width + size - both), that is 175 both >= 75 (width + size)
            starts = np.flatnonzero((100 + PERCENT) * held >= PERCENT * (width + size))
            if not len(starts):
                continue
            last, sharing = -1, set()
            for w, k in self.near(size, fingerprints(own, starts, width)):
                if w != last:
                    at = slice(starts[w], starts[w] + width)
                    last, sharing = w, self.sharing(own[at][hit[at]])
                if k not in sharing:
                    continue
                both, either = self.similarity(own[starts[w] : starts[w] + width], k)
                if 100 * both >= PERCENT * either and both / either > best.get(k, (0.0, 0))[0]:
                    best[k] = (both / either, int(starts[w]))
        return best


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Items in slices of bounded size, so that neither a task nor the driver holds a large benchmark."""
    items = durable(
        benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
        .where("text is not null"),
        "items",
    )
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n = 1 + total // SLICE_BYTES
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]


def _opened(cache: dict, rows: list) -> _Items:
    if "items" not in cache:
        cache["items"] = _Items(rows)
    return cache["items"]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, similarity, first_word`` of every document and item that match, by the best window, the first of equals."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = "doc_id bigint, item_id bigint, similarity double, first_word bigint"
    out = None
    for items in _slices(benchmark):
        shared, cache = docs.sparkSession.sparkContext.broadcast(items), {}

        def run(batch: pa.RecordBatch, shared=shared, cache=cache) -> pa.RecordBatch:
            known = _opened(cache, shared.value)
            hashes, ends = W.word_hashes(batch.column(1), lower=True)
            rows = []
            for doc_id, (a, b) in zip(batch.column(0).to_pylist(), pairwise(ends), strict=True):
                rows += [(doc_id, known.ids[k], s, at) for k, (s, at) in sorted(known.matches(hashes[a:b]).items())]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "similarity", "first_word"])

        found = per_batch(docs, run, shape)
        out = found if out is None else out.unionAll(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns; nothing is shuffled."""
    for items in _slices(benchmark):
        shared, cache = docs.sparkSession.sparkContext.broadcast(items), {}

        def run(batch: pa.RecordBatch, shared=shared, cache=cache) -> pa.RecordBatch:
            known = _opened(cache, shared.value)
            hashes, ends = W.word_hashes(batch.column("text"), lower=True)
            return batch.filter(pa.array([not known.matches(hashes[a:b]) for a, b in pairwise(ends)]))

        docs = per_batch(docs, run, docs.schema)
    return docs
