"""Two Bloom filters over 64-bit hashes: of those seen once and of those seen again.

Each task fills both over its rows; a hash that the first one holds already goes into the second.
Tasks' filters are merged segment by segment: a position set in both first filters is set in the
merged second one. So a hash that comes twice is never missed; others pass with a small chance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bounds of a filter's size; a filter is a power of two.
MIN_BITS, MAX_BITS = 1 << 19, 1 << 30
_SEGMENT = 1 << 15
#: Tasks that fill filters; each sends its filter once, so their number is bounded.
BUILDERS = 1024


def filter_bits(wanted: int) -> int:
    """The size of a filter with at least ``wanted`` positions, within the bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << max(0, wanted - 1).bit_length()))


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions of each hash in a filter of ``bits`` (a power of two) positions."""
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(34)) & mask if bits <= 1 << 30 else hashes >> np.uint64(34)


def has(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = len(filter_) * 8
    a, b = _places(hashes, bits)
    one = np.uint8(1)
    at = lambda p: (filter_[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & one
    return (at(a) & at(b)).astype(bool)


def _set(filter_: np.ndarray, hashes: np.ndarray) -> None:
    if len(hashes):
        p = np.unique(np.concatenate(_places(hashes, len(filter_) * 8)))
        byte = (p >> np.uint64(3)).astype(np.int64)
        begin = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
        filter_[byte[begin]] |= np.bitwise_or.reduceat(np.uint8(1) << (p & np.uint64(7)).astype(np.uint8), begin)


def _filters(bits: int, hashes_of: Callable[[pa.RecordBatch], np.ndarray]):
    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            hashes, counts = np.unique(hashes_of(batch), return_counts=True)
            _set(twice, hashes[(counts > 1) | has(once, hashes)])
            _set(once, hashes)
        for k in range(0, len(once), _SEGMENT):
            if once[k : k + _SEGMENT].any():
                yield pa.record_batch(
                    {
                        "segment": pa.array([k // _SEGMENT], pa.int32()),
                        "once": pa.array([once[k : k + _SEGMENT].tobytes()], pa.binary()),
                        "twice": pa.array([twice[k : k + _SEGMENT].tobytes()], pa.binary()),
                    }
                )

    return fill


def _merged(table: pa.Table) -> pa.Table:
    """One segment's filters of all tasks as one; at most ``BUILDERS`` rows of fixed size come together."""
    once = twice = np.uint8(0)
    for o, t in zip(table["once"], table["twice"], strict=True):
        o, t = (np.frombuffer(x.as_py(), np.uint8) for x in (o, t))
        twice = twice | t | (once & o)
        once = once | o
    return pa.table({"segment": table["segment"].slice(0, 1), "twice": pa.array([twice.tobytes()], pa.binary())})


def twice_filter(df: DataFrame, bits: int, hashes_of: Callable[[pa.RecordBatch], np.ndarray]) -> bytes:
    """The merged filter of hashes that ``hashes_of`` may give for two rows of ``df``.

    ``hashes_of`` gives each row's hashes once. The result has ``bits / 8`` bytes whatever the input,
    which is all that comes to the driver.
    """
    filled = df.coalesce(BUILDERS).mapInArrow(_filters(bits, hashes_of), "segment int, once binary, twice binary")
    merged = filled.groupBy("segment").applyInArrow(_merged, "segment int, twice binary")
    whole = bytearray(bits // 8)
    for row in merged.collect():
        whole[row.segment * _SEGMENT : row.segment * _SEGMENT + len(row.twice)] = row.twice
    return bytes(whole)
