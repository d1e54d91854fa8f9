"""Fill-in-middle rearrangement of documents by piece tables.

A document is a list of descriptors ``(buffer, start, length)``, in bytes, over two buffers that never
change: its own text and the sentinels. Cutting it into prefix, middle and suffix splits the descriptor
of the text, an arrangement permutes the descriptors together with those of the sentinels, and the
inverse permutation restores the text. Digests stream over the descriptors; no text is put together for them.

A text is cut between units ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``. Where, and into which
form, depends on a hash of the document's id alone, so that a task that runs again makes the same rows.

Columns ``doc_id`` and ``text`` are read; others are ignored. Null text counts as empty, and empty texts stay
plain. A row without an id is hashed with an empty id. Rows that repeat an id are rearranged alike. An empty
table gives no rows. Each row is worked on alone: nothing is shuffled, and a task holds one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .frames import per_batch

PREFIX, SUFFIX, MIDDLE = SENTINELS = (b"<P>", b"<S>", b"<M>")
_SENTINEL_BUFFER = b"".join(SENTINELS)
#: Of prefix, middle, suffix and the three sentinels: which comes when.
ORDERS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}

_BLANK = np.zeros(256, bool)
_BLANK[list(W.BLANKS)] = True


class PieceTable:
    """Descriptors over buffers that stay as they are."""

    def __init__(self, buffers: Sequence[bytes], pieces: Sequence[tuple[int, int, int]]):
        self.buffers, self.pieces = tuple(map(memoryview, buffers)), list(pieces)

    def cut(self, places: Sequence[int]) -> None:
        """Split descriptors so that a piece ends at each of the ascending ``places`` in the whole; pieces may be empty."""
        pieces, left, at = [], list(places), 0
        for buffer, start, length in self.pieces:
            done = 0
            while left and left[0] <= at + length:
                end = left.pop(0) - at
                pieces.append((buffer, start + done, end - done))
                done = end
            pieces.append((buffer, start + done, length - done))
            at += length
        self.pieces = pieces

    def arrange(self, order: Sequence[int]) -> None:
        self.pieces = [self.pieces[i] for i in order]

    def restore(self, order: Sequence[int]) -> None:
        """Undo ``arrange(order)``."""
        pieces = list(self.pieces)
        for at, i in enumerate(order):
            pieces[i] = self.pieces[at]
        self.pieces = pieces

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def text(self) -> str:
        return b"".join(self.stream()).decode()


def unit_ends(content: np.ndarray) -> np.ndarray:
    """Where each unit of a text's bytes ends."""
    if not len(content):
        return np.zeros(0, np.int64)
    blank = _BLANK[content]
    last = ~blank
    last[:-1] &= blank[1:]
    last[-1] = True
    return np.flatnonzero(last) + 1


def _chars(content: np.ndarray) -> int:
    return int(np.count_nonzero((content & 0xC0) != 0x80))


def choice(doc_id: int | None, n: int, seed: int, share: int, spm_share: int) -> tuple[int, int, str]:
    """Units before the middle, units before the suffix, and the form that a hash of the id asks for."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12))
    form = "plain" if h3 % 100 >= share else "spm" if h4 % 100 < spm_share else "psm"
    return min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1)), form


_PIECES = "array<struct<buffer: int, start: bigint, length: bigint>>"
_ARROW_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


def rearrange(docs: DataFrame, seed: int = 42, share: int = 50, spm_share: int = 80) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, pieces, output`` for every document.

    ``share`` percent of documents are rearranged, ``spm_share`` percent of them with the suffix first.
    ``n`` counts units; ``pieces`` are the descriptors, buffer 0 the text's bytes and 1 the sentinels
    ``<P><S><M>``; ``output`` is the text they describe.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        content, offsets = W.text_bytes(batch.column(1))
        rows = []
        for doc_id, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
            own = content[a:b]
            raw, ends = own.tobytes(), unit_ends(own)
            first, second, form = choice(doc_id, len(ends), seed, share, spm_share)
            if not raw or any(s in raw for s in SENTINELS):
                form = "plain"
            table = PieceTable((raw, _SENTINEL_BUFFER), [(0, 0, len(raw))])
            prefix = middle = None
            if form != "plain":
                x, y = (int(ends[i - 1]) if i else 0 for i in (first, second))
                table.cut((x, y))
                table.pieces += [(1, 3 * i, 3) for i in range(3)]
                table.arrange(ORDERS[form])
                prefix, middle = _chars(own[:x]), _chars(own[x:y])
            pieces = [dict(zip(("buffer", "start", "length"), p, strict=True)) for p in table.pieces]
            rows.append((doc_id, len(ends), form, prefix, middle, pieces, table.text()))
        columns = list(zip(*rows, strict=True))
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), _ARROW_PIECES, pa.string())
        names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output")
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))

    shape = f"doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, pieces {_PIECES}, output string"
    return per_batch(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, shape)


def original(output: bytes, form: str) -> PieceTable:
    """The text an output was made of, as descriptors over the output. The sentinels show where to cut it:
    its text has none, and none can arise where text meets a sentinel."""
    table = PieceTable((output,), [(0, 0, len(output))])
    if form != "plain":
        # In either form the first sentinel begins the output and the middle's comes last.
        second = output.index(SUFFIX if form == "psm" else PREFIX, 3)
        third = output.index(MIDDLE, second + 3)
        table.cut((3, second, second + 3, third, third + 3))
        table.restore(ORDERS[form])
        del table.pieces[3:]
    return table


def restore(rearranged: DataFrame, with_text: bool = True) -> DataFrame:
    """The rows with ``output_sha256`` and ``restored_sha256`` and, if asked, ``restored``, the original text.

    Only ``output`` and ``form`` are read; ``output`` and ``pieces`` are left out of the result.
    """
    rest = [f for f in rearranged.schema if f.name not in ("output", "pieces")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        outputs = batch.column(batch.schema.get_field_index("output")).cast(pa.binary()).to_pylist()
        forms = batch.column(batch.schema.get_field_index("form")).to_pylist()
        tables = [original(o, f) for o, f in zip(outputs, forms, strict=True)]
        columns = {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in rest}
        columns["output_sha256"] = pa.array([hashlib.sha256(o).hexdigest() for o in outputs], pa.string())
        columns["restored_sha256"] = pa.array([t.sha256() for t in tables], pa.string())
        if with_text:
            columns["restored"] = pa.array([t.text() for t in tables], pa.string())
        return pa.record_batch(columns)

    added = ["output_sha256 string", "restored_sha256 string", *(["restored string"] if with_text else [])]
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *added])
    return per_batch(rearranged.select(*(f.name for f in rest), "output"), run, shape)
