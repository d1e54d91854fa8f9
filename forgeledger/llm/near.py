"""Near-duplicate groups by an inverted join on MinHash signature coordinates.

A document's set is its distinct shingles of lower-cased words. Documents with equal sets are one
class; everything below works on one document of each class.

Every class has a signature of ``COORDINATES`` minima. Two sets of similarity 0.75 agree in a
coordinate with that probability, so fewer than ``MATCHES`` of 48 agreements happen about once in a
million such pairs. Prefix: a pair with ``MATCHES`` agreements has one among any
``COORDINATES - MATCHES + 1`` coordinates, so classes are posted under these coordinate-value pairs
only. Skip: lists with one member go at once, and inside a list a pair counts only at the first
coordinate on which it agrees, when the sizes of its sets allow the similarity and when the rest
of the signatures brings it to ``MATCHES``. A list longer than ``BLOCK`` is dealt out as pairs of blocks.

Pairs never leave the tasks. A list gives its members that have partners; these are joined with
their texts, the full sets of a block are compared, and the block returns a spanning forest of the
links it finds, at most one row a member. The links' components are the groups.

Columns ``doc_id`` and ``text`` are read. Null and blank texts have empty sets and no links, rows of
one id that repeat a text are one document, an empty table gives no rows. A row without an id has no
links and a null component.
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
from .components import components
from .frames import per_batch, sorted_runs

SHINGLE = 5
COORDINATES, MATCHES = 48, 22
PREFIX = COORDINATES - MATCHES + 1
BLOCK = 2048
#: 100 * intersection >= PERCENT * union
PERCENT = 75

_FACTORS = W.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every row's distinct shingle hashes, sorted, and the rows' offsets."""
    return W.distinct_by_row(*W.shingles(*W.word_hashes(column, lower=True), SHINGLE))


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    values, ends = sets(batch.column(1))
    sizes = np.diff(ends)
    full = np.flatnonzero(sizes)
    minima = np.zeros((batch.num_rows, COORDINATES), np.uint32)
    if len(full):
        for k, factor in enumerate(_FACTORS):
            minima[full, k] = np.minimum.reduceat((values * factor) >> np.uint64(32), ends[full])
    kinds = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(ends, ends[1:], strict=False)]
    return pa.record_batch(
        {
            "doc_id": batch.column(0),
            "n_shingles": pa.array(sizes, pa.int64()),
            "set_hash": pa.array(kinds, pa.binary()),
            "signature": pa.array([row.tobytes() if n else None for row, n in zip(minima, sizes, strict=True)], pa.binary()),
        }
    )


def _post(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each prefix coordinate: the coordinate with its value, and the class."""
    signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)[:, :PREFIX]
    keys = signature.astype(np.int64) | (np.arange(PREFIX, dtype=np.int64) << 32)
    ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), PREFIX)
    return pa.record_batch({"posting": pa.array(keys.ravel()), "doc_id": pa.array(ids, pa.int64())})


def _partnered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every block of a posting list, the members that have a partner by their signatures."""
    for run in sorted_runs(batches, ["posting", "block"]):
        ids, sizes = run["doc_id"].to_numpy(), run["n_shingles"].to_numpy()
        order = np.argsort(sizes, kind="stable")
        ids, sizes = ids[order], sizes[order]
        # A byte of each minimum: two that agree always agree here, and others nearly never.
        raw = np.frombuffer(b"".join(run["signature"].to_pylist()), np.uint32).reshape(-1, COORDINATES)[order]
        marks = raw.astype(np.uint8)
        coordinate = run["posting"][0].as_py() >> 32
        side = run["side"].to_numpy()[order]
        crossing = bool(side.min() != side.max())
        hit = np.zeros(len(ids), bool)
        for i in range(len(ids) - 1):
            # Sizes ascend: partners of i end where the intersection cannot reach the share any more.
            stop = int(np.searchsorted(sizes, sizes[i] * 100 // PERCENT, "right"))
            if stop <= i + 1:
                continue
            agree = marks[i + 1 : stop] == marks[i]
            good = agree.sum(1) >= MATCHES
            if coordinate:
                good &= ~(raw[i + 1 : stop, :coordinate] == raw[i, :coordinate]).any(1)
            if crossing:
                good &= side[i + 1 : stop] != side[i]
            if good.any():
                hit[i] = True
                hit[i + 1 : stop] |= good
        if hit.any():
            n = int(hit.sum())
            yield pa.record_batch(
                {
                    "posting": pa.array(np.full(n, run["posting"][0].as_py()), pa.int64()),
                    "block": pa.array(np.full(n, run["block"][0].as_py()), pa.int64()),
                    "doc_id": pa.array(ids[hit], pa.int64()),
                }
            )


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    return i


def _confirmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the full sets of a block's members; a spanning forest of the links found."""
    for run in sorted_runs(batches, ["posting", "block"]):
        ids = run["doc_id"].to_numpy()
        members: list[np.ndarray] = []
        for piece in run["text"].chunks:
            values, ends = sets(piece)
            members += [values[a:b].copy() for a, b in zip(ends, ends[1:], strict=False)]
        order = sorted(range(len(ids)), key=lambda i: (len(members[i]), ids[i]))
        # An inverted list over the block: for each member the sizes of all intersections at once.
        lengths = np.array([len(members[i]) for i in order])
        every = np.concatenate([members[i] for i in order])
        owner = np.repeat(np.arange(len(order)), lengths)
        by_value = np.argsort(every, kind="stable")
        owners = owner[by_value]
        new = np.ones(len(every), bool)
        new[1:] = every[by_value][1:] != every[by_value][:-1]
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        group_of = np.empty(len(every), np.int64)
        group_of[by_value] = group
        end = np.append(begin[1:], len(every))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        parent = np.arange(len(order))
        for i in range(len(order)):
            groups = group_of[ends[i] : ends[i + 1]]
            shared = groups[end[groups] - begin[groups] > 1]
            if not len(shared):
                continue
            spans = end[shared] - begin[shared]
            starts = np.cumsum(spans) - spans
            partners = owners[np.arange(spans.sum()) - np.repeat(starts - begin[shared], spans)]
            common = np.bincount(partners, minlength=len(order))
            common[: i + 1] = 0
            for j in np.flatnonzero(100 * common >= PERCENT * (lengths[i] + lengths - common)):
                a, b = _root(parent, i), _root(parent, int(j))
                if a != b:
                    parent[max(a, b)] = min(a, b)
        roots = np.array([_root(parent, i) for i in range(len(order))])
        tied = np.flatnonzero(roots != np.arange(len(order)))
        if len(tied):
            own = ids[order]
            yield pa.record_batch({"a": pa.array(own[tied], pa.int64()), "b": pa.array(own[roots[tied]], pa.int64())})


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = durable(
        per_batch(docs, _sign, "doc_id bigint, n_shingles bigint, set_hash binary, signature binary"), "signatures"
    )
    alike = signed.where("set_hash is not null and doc_id is not null")
    classes = durable(alike.groupBy("set_hash").agg(F.min("doc_id").alias("class_id")), "classes")
    heads = durable(
        alike.select("doc_id", "n_shingles", "signature").join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id")
        .dropDuplicates(["doc_id", "signature"]),
        "class-heads",
    )
    postings = per_batch(heads.select("doc_id", "signature"), _post, "posting bigint, doc_id bigint")
    lists = durable(postings.groupBy("posting").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
    # Blocks are dealt by a hash of the id; every pair of blocks of a long list is one group.
    blocks = F.ceil(F.col("n") / BLOCK)
    listed = (
        postings.join(lists, "posting")
        .withColumn("side", F.pmod(F.xxhash64("doc_id"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        .where((F.col("n") <= BLOCK) | (F.col("side") != F.col("other")) | (blocks == 1))
        .withColumn("block", F.least("side", "other") * F.lit(1 << 31) + F.greatest("side", "other"))
    )
    # Pairs inside one block of a long list: a group of their own.
    inside = postings.join(lists.where(F.col("n") > BLOCK), "posting").withColumn("side", F.pmod(F.xxhash64("doc_id"), blocks))
    listed = listed.select("posting", "block", "side", "doc_id").unionAll(
        inside.select("posting", (F.lit(-1) - F.col("side")).alias("block"), "side", "doc_id")
    )
    members = listed.join(heads, "doc_id").select("posting", "block", "side", "doc_id", "n_shingles", "signature")
    partnered = durable(
        members.repartition("posting", "block").sortWithinPartitions("posting", "block")
        .mapInArrow(_partnered, "posting bigint, block bigint, doc_id bigint"),
        "partnered",
    )
    # Repeated rows of an id must not enter a block twice.
    texts = docs.join(partnered.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    links = (
        partnered.join(texts.hint("merge"), "doc_id").select("posting", "block", "doc_id", "text")
        .repartition("posting", "block").sortWithinPartitions("posting", "block")
        .mapInArrow(_confirmed, "a bigint, b bigint")
    )
    groups = components(links)
    named = durable(
        classes.join(groups, F.col("class_id") == F.col("id"), "left")
        .select("set_hash", F.coalesce("component_id", "class_id").alias("component_id")),
        "class-components",
    )
    return signed.join(named, "set_hash", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
