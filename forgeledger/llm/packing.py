"""Packing of tokenised documents into sequences of ``LENGTH`` tokens by best fit decreasing.

A document's tokens and one end token are cut into full windows first, which are sequences of their own.
What is left of each document is placed, longest first, into the open sequence with the least room
that still holds it; a segment tree over the amounts of free room finds it. Every task packs its own
rows, at most ``GROUP_TOKENS`` of leftovers at a time, so nothing is shuffled and memory is bounded.

Sequences are to be padded to ``LENGTH``, except those whose length is a power of two.

Columns ``doc_id`` and ``text`` are read. Null text counts as empty and has the end token alone; rows without
an id are packed as well, with a null id. Rows that repeat an id are documents of their own. An empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LENGTH = 2048
END_ID = 1
GROUP_TOKENS = 1 << 23
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 1_000_000


_MARKS = ".,;:!?"


class _Apart(Exception):
    """The text has blanks next to each other and is encoded whole."""


def _byte_names() -> dict[int, int]:
    """The characters by which a byte-level model names bytes: printable ones name themselves, the others, in order, those from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + n for n, b in enumerate(others)}


_BYTE_NAMES = _byte_names()


class PieceIds(dict):
    """Ids, as little-endian bytes, of a space and the letters up to the next space.

    A byte-level tokenizer of this kind starts a new piece at a space between two characters that are not
    blank, so such a text's ids are its parts' ids one after another. The same holds at a single line end.
    Letters, with a space before them or without, are one piece, which goes straight to the tokenizer's model.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.line_end = self.encode("\n")
        self.model = self.tokenizer.model

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, piece: str) -> bytes:
        """Ids of letters, with a space before them or without."""
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(_BYTE_NAMES))
        return b"".join([t.id.to_bytes(4, "little") for t in tokens])

    def __missing__(self, part: str) -> bytes:
        """Ids of a space and ``part``; a key that begins with a space, as no part does, asks for what follows it alone."""
        raw = part[:1] == " "
        rest = part[1:] if raw else part
        if not rest or rest[0].isspace() or rest[-1].isspace():
            raise _Apart
        head = rest.rstrip(_MARKS)
        if "\n" in rest:
            # A line end between two characters that are not blank is a piece of its own.
            first, *others = rest.split("\n")
            found = b"".join([self[" " + first if raw else first], *(self.line_end + self[" " + x] for x in others)])
        elif head != rest and head.isalpha():
            # Letters and the marks after them are separate pieces.
            found = self[" " + head if raw else head] + self[" " + rest[len(head) :]]
        else:
            found = (self.letters if rest.isalpha() else self.encode)(rest if raw else " " + rest)
        if len(self) >= REMEMBERED:
            self.clear()
        self[part] = found
        return found

    def of(self, text: str) -> bytes:
        parts = text.split(" ")
        if len(parts) < 3 or not parts[0] or parts[0][-1].isspace() or not parts[-1] or parts[-1][0].isspace():
            return self.encode(text) if text else b""
        try:
            if parts[-1][-1:].isspace():
                return b"".join([self[" " + parts[0]], *map(self.__getitem__, parts[1:-1]), self.encode(" " + parts[-1])])
            parts[0] = " " + parts[0]
            return b"".join(map(self.__getitem__, parts))
        except _Apart:
            return self.encode(text)


@lru_cache(maxsize=4)
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


class Room:
    """Open sequences by the room they have, and a segment tree that finds the least room that suffices."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def _count(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, room: int, sequence: int) -> None:
        if room:
            self.open[room].append(sequence)
            self._count(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The room and name of the tightest sequence that holds ``need``; it is no longer open."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        self._count(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """The sequence, numbered from 0, and the offset there of each piece of at most ``length`` tokens."""
    room, places, n = Room(length), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = room.take(lengths[i])
        if found is None:
            found, n = (length, n), n + 1
        places[i] = (found[1], length - found[0])
        room.put(found[0] - lengths[i], found[1])
    return places


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """One row for each piece: where it comes from, where it lies, and its ids if asked.

    ``tokenizer`` is the path, on every executor, of a byte-level tokenizer's file.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = piece_ids(tokenizer)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        n, rows, held, held_tokens = 0, [], [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.record_batch(arrays, names)

        def placed(n: int) -> tuple[list[tuple], int]:
            places = best_fit([p[2] for p in held])
            out = [(*p[:5], first + n + s, o, *p[5:]) for p, (s, o) in zip(held, places, strict=True)]
            return out, n + max((s + 1 for s, _ in places), default=0)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = ids.of(text or "") + END_ID.to_bytes(4, "little")
                total = len(whole) // 4
                for start in range(0, total, LENGTH):
                    part = whole[4 * start : 4 * (start + LENGTH)]
                    length = len(part) // 4
                    row = (doc_id, start, length, zlib.crc32(part), total, *([part] if with_ids else []))
                    if length == LENGTH:
                        rows.append((*row[:5], first + n, 0, *row[5:]))
                        n += 1
                    else:
                        held.append(row)
                        held_tokens += length
                if held_tokens >= GROUP_TOKENS:
                    done, n = placed(n)
                    rows += done
                    held, held_tokens = [], 0
            if rows:
                yield batch_of(rows)
                rows = []
        if held:
            yield batch_of(placed(n)[0])

    shape = SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, shape)
