"""Words, shingles and their 64-bit hashes for whole Arrow columns, without a Python step per word.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Its hash is a polynomial over
random 64-bit values of its bytes, followed by a mixing step. Null counts as empty text. A text
of any length is worked through in blocks of about a megabyte, so memory beyond the batch
itself is eight bytes a word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

BLANKS = b"\t\n\x0b\x0c\r "
_BLOCK = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _byte_values(lower: bool) -> np.ndarray:
    """A fixed random odd value for each byte, 0 for blanks; equal values for A-Z and a-z if asked."""
    stream = hashlib.shake_256(b"byte values").digest(256 * 8)
    values = np.frombuffer(stream, np.uint64) | _U(1)
    if lower:
        values[65:91] = values[97:123]
    values[list(BLANKS)] = 0
    return values


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = int(_MULTIPLIER)) -> np.ndarray:
    """At least ``n`` powers of ``base`` modulo 2^64, from the zeroth on."""
    known = _powers.get(base, np.ones(1, np.uint64))
    while len(known) < n:
        known = np.concatenate([known, known * _U(pow(base, len(known), 1 << 64))])
    _powers[base] = known
    return known


def ordered_sums(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run ``hashes[begin:end]`` that depends on the values and their order alone."""
    chain = mix(hashes ^ _U(0xA0761D6478BD642F))
    sums = np.append(_U(0), np.cumsum(chain * powers(len(chain))[: len(chain)], dtype=np.uint64))
    shift = powers(len(chain) + 1, pow(int(_MULTIPLIER), -1, 1 << 64))
    return mix((sums[end] - sums[begin]) * shift[begin] + (end - begin).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over the whole value."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offsets in them."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    content = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return content, offsets.astype(np.int64) - int(offsets[0])


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the column in order, and each row's offsets in them."""
    content, offsets = text_bytes(column)
    values, n = _VALUES[lower], len(content)
    hashes, starts, at = [], [], 0
    while at < n:
        end = min(at + _BLOCK, n)
        if end < n:
            # A block ends between two rows, or else before a blank of the row that is cut.
            row = int(np.searchsorted(offsets, end, "right")) - 1
            if offsets[row] > at:
                end = int(offsets[row])
            else:
                limit = int(offsets[row + 1])
                while end < limit and values[content[end]]:
                    blank = np.flatnonzero(values[content[end : min(end + _BLOCK, limit)]] == 0)
                    end = end + int(blank[0]) if len(blank) else min(end + _BLOCK, limit)
        value = values[content[at:end]]
        solid = value != 0
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        rows = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        first[rows] = solid[rows]
        begin = np.flatnonzero(first)
        if len(begin):
            lengths = np.diff(np.append(begin, end - at))
            place = np.arange(begin[0], end - at) - np.repeat(begin, lengths)
            value = value[begin[0] :] * powers(int(lengths.max()))[place]
            hashes.append(mix(np.add.reduceat(value, begin - begin[0])))
            starts.append(begin + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets).astype(np.int64)


def rolling(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """The hash of each run of ``size`` consecutive values; the last ``size - 1`` runs are missing."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, _U((seed * 0xD1342543DE82EF95 + size) % (1 << 64)))
    for j in range(size):
        out = (out ^ (out >> _U(32))) * _MULTIPLIER + hashes[j : j + n]
    return mix(out)


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every row in order, and each row's offsets in them.

    A row with fewer words than ``size`` has its whole sequence as one shingle; one without words has none.
    """
    n_words = np.diff(offsets)
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    place = np.repeat(offsets[:-1] - ends[:-1], counts) + np.arange(ends[-1])
    whole = rolling(hashes, size)
    out = whole[np.minimum(place, max(0, len(whole) - 1))] if len(whole) else np.zeros(ends[-1], np.uint64)
    for row in np.flatnonzero((n_words > 0) & (n_words < size)):
        out[ends[row]] = rolling(hashes[offsets[row] : offsets[row + 1]], int(n_words[row]))[0]
    return out, ends


def distinct_by_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted and without repeats."""
    values = values.copy()
    for begin, end in zip(offsets[:-1], offsets[1:], strict=True):
        values[begin:end].sort()
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], np.searchsorted(row[new], np.arange(len(offsets)))
