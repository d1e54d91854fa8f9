"""Removal of lines that several documents share, with a Bloom filter for each of two counts.

A line's key is the line without blanks at both ends, A-Z in lower case; keys of fewer than
``MIN_KEY`` code points never count. A key found in two documents loses all its lines except
those of the smallest document that holds it.

1. Tasks fill a filter of keys seen once and one of keys seen again, both over hashes that are
   distinct within a document. The filters are merged segment by segment (``bloom.py``); no repeated key is ever missed.
2. The twice-filter is broadcast; its size is fixed beforehand and bounded. Tasks send
   digests of suspected keys only, which are counted exactly; the smallest document is found there.
3. Only texts that hold a suspected key are shuffled, to meet the keys they lose.

A filter that is too small costs time and never changes a result. Columns ``doc_id`` and ``text`` are
read. Null text is one empty line. Rows without an id stay as they are and make no line repeated;
rows of one id are one document. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .bloom import filter_bits, has, twice_filter
from .frames import per_batch

MIN_KEY = 10
#: Filter positions for each document: eight for each of 32 lines.
BITS_PER_DOCUMENT = 256



def keys(text: str | None) -> list[bytes]:
    """The key of every line; keys that are too short to count are empty."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(b" \t\n\x0b\x0c\r").lower()
        if len(key) < MIN_KEY or (len(key) < 4 * MIN_KEY and len(key.decode()) < MIN_KEY):
            key = b""
        out.append(key)
    return out


def _hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of all keys, distinct within each document."""
    found: list[int] = []
    for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
        found += {xxhash.xxh3_64_intdigest(k) for k in keys(text) if k}
    return np.array(found, np.uint64)


def _kept(text: str | None, drop: set[bytes]) -> tuple[int, bytes]:
    lines = (text or "").encode().split(b"\n")
    stay = [line for line, key in zip(lines, keys(text), strict=True) if not key or _digest(key) not in drop] if drop else lines
    return len(lines) - len(stay), b"\n".join(stay)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def shared_lines_removed(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text_sha256, kept_text`` of every document; ``kept_text`` is the text that stays."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if bits is None:
        bits = filter_bits(docs.count() * BITS_PER_DOCUMENT)
    filter_ = docs.sparkSession.sparkContext.broadcast(twice_filter(docs.where("doc_id is not null"), bits, _hashes))

    def suspects(batch: pa.RecordBatch) -> list[list[bytes]]:
        own = np.frombuffer(filter_.value, np.uint8)
        out = []
        every = [[k for k in keys(t) if k] for t in batch.column(1).to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(k) for k in every])]).astype(np.int64)
        flat = [k for ks in every for k in ks]
        hit = has(own, np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat)))
        for a, b in pairwise(ends):
            out.append([flat[i] for i in a + np.flatnonzero(hit[a:b])] if b > a else [])
        return out

    def send(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out_ids, out_keys = batch.column(0).to_pylist(), [], []
        for doc_id, found in zip(ids, suspects(batch), strict=True):
            if doc_id is not None:
                for k in set(found):
                    out_ids.append(doc_id)
                    out_keys.append(_digest(k))
        return pa.record_batch({"doc_id": pa.array(out_ids, pa.int64()), "line": pa.array(out_keys, pa.binary())})

    sent = durable(per_batch(docs, send, "doc_id bigint, line binary"), "suspected-lines")
    repeated = durable(
        sent.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").drop("last"),
        "repeated-lines",
    )
    # A document's own lines come together again, no more than its text holds.
    lost = durable(
        sent.join(repeated, "line").where("doc_id <> first").groupBy("doc_id").agg(F.collect_set("line").alias("lost")), "lost-lines"
    )
    shape = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_text_sha256 string, kept_text string"

    def finish(ids, texts, drops) -> pa.RecordBatch:
        done = [_kept(t, set(d or ())) for t, d in zip(texts, drops, strict=True)]
        return pa.record_batch(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_lines": pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64()),
                "n_dropped": pa.array([n for n, _ in done], pa.int64()),
                "kept_text_sha256": pa.array([hashlib.sha256(k).hexdigest() for _, k in done], pa.string()),
                "kept_text": pa.array([k.decode() for _, k in done], pa.string()),
            }
        )

    def untouched(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = pa.array([i is None or not s for i, s in zip(batch.column(0).to_pylist(), suspects(batch), strict=True)])
        own = batch.filter(clean)
        return finish(own.column(0).to_pylist(), own.column(1).to_pylist(), [()] * own.num_rows)

    def suspected(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([i is not None and bool(s) for i, s in zip(batch.column(0).to_pylist(), suspects(batch), strict=True)]))

    touched = per_batch(docs, suspected, "doc_id bigint, text string").join(lost.hint("merge"), "doc_id", "left")
    changed = per_batch(touched, lambda b: finish(*(b.column(i).to_pylist() for i in range(3))), shape)
    return per_batch(docs, untouched, shape).unionAll(changed)
