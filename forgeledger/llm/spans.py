"""Removal of word passages that an earlier document holds, over a compacted de Bruijn graph.

Edges of the graph are windows of ``WINDOW`` consecutive words. Every window has an anchor, the
``ANCHOR``-word sequence in it with the least hash, so equal windows have equal anchors; a longest run
of windows with one anchor is a path, on average eighteen windows. Equal paths of all documents
are compacted to one row with the smallest document that holds them: its source.

- An anchor that one document alone holds cannot be part of a repeat. Two Bloom filters of anchors
  (``bloom.py``) leave most such paths where they are; the exact count drops the others.
- A path whose anchor has no other path does not branch: all its windows have the same documents.
- The other paths branch. They are read again at their coordinates in the source, once for each
  path however many copies it has, and their windows, joined by hash, give the smallest document
  for each window.

The paths of each document are then joined with what they lose, and only documents that lose words
meet their texts again. A word goes when a window that covers it starts in a smaller document too.

Columns ``doc_id`` and ``text`` are read. Null text has no words. A row without an id loses nothing and
takes nothing from others. Rows of one id with the same text are one document and are returned as
often as they come; rows of one id with different texts are not one document and their result is
not defined beyond not failing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import words as W
from .bloom import filter_bits, has, twice_filter
from .frames import per_batch

WINDOW, ANCHOR = 50, 16
_REACH = WINDOW - ANCHOR + 1
#: Filter positions for each document: eight for each of 128 anchors.
BITS_PER_DOCUMENT = 1024




def _paths(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, label, first window and number of windows of every path of one document."""
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    least, width = W.rolling(hashes, ANCHOR, seed=1), 1
    while width < _REACH:
        step = min(width, _REACH - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    spots = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    counts = np.diff(np.append(spots, n))
    return least[spots], W.ordered_sums(hashes, spots, spots + counts + WINDOW - 1), spots, counts


def _anchors(batch: pa.RecordBatch) -> np.ndarray:
    hashes, ends = W.word_hashes(batch.column(1))
    found = [np.unique(_paths(hashes[a:b])[0]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The windows of paths that branch, read at the coordinates of each path's source."""
    hashes, ends = W.word_hashes(batch.column(1))
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for row, (doc_id, places) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
        own = W.rolling(hashes[ends[row] : ends[row + 1]], WINDOW, seed=2)
        for place in places:
            own_windows = own[place["start"] : place["start"] + place["n"]]
            n = len(own_windows)
            for column, values in zip(
                out,
                (np.full(n, place["anchor"]), np.full(n, place["label"]), np.arange(n), own_windows.view(np.int64), np.full(n, doc_id)),
                strict=True,
            ):
                column.append(values)
    names = ("anchor", "label", "nth", "window", "doc_id")
    return pa.record_batch(
        {k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in zip(names, out, strict=True)}
    )


def _remaining(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Take the words out that lost windows cover."""
    n_words, n_removed, kept = [], [], []
    for doc_id, text, lost in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        words = (text or "").encode().split()
        edges = np.zeros(len(words) + 1, np.int64)
        for path in lost or ():
            firsts = path["firsts"]
            gone = np.arange(path["n"]) if len(firsts) == 1 else np.flatnonzero(np.array(firsts) < doc_id)
            np.add.at(edges, path["start"] + gone, 1)
            np.add.at(edges, path["start"] + gone + WINDOW, -1)
        covered = np.cumsum(edges)[:-1] > 0
        stay = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
        n_words.append(len(words))
        n_removed.append(len(words) - len(stay))
        kept.append(b" ".join(stay))
    return pa.record_batch(
        {
            "doc_id": batch.column(0),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            "kept_text": pa.array([k.decode() for k in kept], pa.string()),
        }
    )


def repeated_spans_removed(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text_sha256, kept_text`` of every document.

    ``kept_text`` has the words that stay, joined by one space. ``bits`` sets the size of the filters,
    which changes no result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if bits is None:
        bits = filter_bits(docs.count() * BITS_PER_DOCUMENT)
    filter_ = docs.sparkSession.sparkContext.broadcast(twice_filter(docs.where("doc_id is not null"), bits, _anchors))

    def suspected_paths(batch: pa.RecordBatch) -> list[tuple[np.ndarray, ...] | None]:
        own, out = np.frombuffer(filter_.value, np.uint8), []
        hashes, ends = W.word_hashes(batch.column(1))
        for doc_id, a, b in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
            paths = _paths(hashes[a:b])
            hit = has(own, paths[0]) if doc_id is not None else np.zeros(len(paths[0]), bool)
            out.append(tuple(c[hit] for c in paths) if hit.any() else None)
        return out

    def send(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(d, p) for d, p in zip(batch.column(0).to_pylist(), suspected_paths(batch), strict=True) if p]
        ids = [np.full(len(p[0]), d, np.int64) for d, p in found]
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (ids, *([p[i] for _, p in found] for i in range(4)))]
        return pa.record_batch(dict(zip(("doc_id", "anchor", "label", "start", "n"), map(_signed, columns), strict=True)))

    paths = durable(per_batch(docs, send, "doc_id bigint, anchor bigint, label bigint, start bigint, n bigint"), "paths")
    edges = durable(
        paths.groupBy("anchor", "label").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "path-sources"
    )
    shared = durable(
        edges.groupBy("anchor").agg(F.min("first").alias("a"), F.max("last").alias("b"), F.count(F.lit(1)).alias("labels"))
        .where("a <> b").select("anchor", "labels"),
        "shared-anchors",
    )
    repeated = durable(edges.join(shared, "anchor"), "repeated-paths")
    plain = repeated.where("labels = 1").select("anchor", "label", F.array("first").alias("firsts"))
    branching = repeated.where("labels > 1").select("anchor", "label", F.col("first").alias("doc_id"))
    # One place of each branching path in its source; a document's own places come together.
    places = (
        paths.join(branching, ["anchor", "label", "doc_id"]).groupBy("doc_id", "anchor", "label")
        .agg(F.min(F.struct("start", "n")).alias("place"))
        .groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "label", "place.start", "place.n")).alias("places"))
    )
    windows = durable(
        per_batch(docs.join(places.hint("merge"), "doc_id"), _windows, "anchor bigint, label bigint, nth bigint, window bigint, doc_id bigint"),
        "branching-windows",
    )
    firsts = durable(windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                     .where("first <> last").drop("last"), "repeated-windows")
    # Windows that no other document has are their own document's; they never count as lost.
    mixed = (
        windows.join(firsts, ["anchor", "window"], "left").groupBy("anchor", "label")
        .agg(F.sort_array(F.collect_set(F.struct("nth", F.coalesce("first", "doc_id").alias("first")))).alias("row"))
        .select("anchor", "label", F.col("row.first").alias("firsts"))
    )
    resolved = durable(plain.unionAll(mixed), "resolved-paths")
    lost = durable(
        paths.join(resolved, ["anchor", "label"]).where(F.array_min("firsts") < F.col("doc_id"))
        .groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "firsts")).alias("lost")),
        "lost-paths",
    )
    shape = "doc_id bigint, n_words bigint, n_removed bigint, kept_text_sha256 string, kept_text string"

    def split(suspect: bool):
        def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = batch.filter(pa.array([(p is not None) == suspect for p in suspected_paths(batch)]))
            return own if suspect else _remaining(own.append_column("lost", pa.nulls(own.num_rows)))

        return rows

    touched = per_batch(docs, split(True), "doc_id bigint, text string").join(lost.hint("merge"), "doc_id", "left")
    return per_batch(docs, split(False), shape).unionAll(per_batch(touched, _remaining, shape))
