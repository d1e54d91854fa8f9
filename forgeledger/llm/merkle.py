"""Merkle manifest of a dataset as a persistent tree: a tampered leaf makes a version that copies its ancestors alone.

Leaves of a group lie in order, and every ``FANOUT`` consecutive nodes have one parent, the hash of their digests
put together, until one node is left, the group's subroot. The subroots, in the order of their groups, have a tree of
their own whose top is the root.

The tree is cut into aligned blocks of ``FANOUT ** levels`` nodes. A task holds one block as nodes that never
change; the blocks' tops are the leaves of the blocks above, so rounds over ever smaller written tables, one for
each ``levels`` levels, bring the root. Then every block learns, top down, what lies beside its path to the root:
one row a block. With it, and its own nodes, a block makes the proofs of its leaves, and for each tampered leaf a
version: a tree that shares every node but the leaf's ancestors in the block, and that goes on above the block by new
nodes over the siblings the block was told of. No version needs a row in the blocks above it, so the top is no
meeting point of all of them.

Positions come from ``order_in_group``, which cuts large groups into slices, so a group may hold any share of the rows. A missing
order value comes first, rows of one order value are ordered by their digests; equal rows stand next to each other. An
empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grouping import join_null_safe, order_in_group
from ..session import durable, durable_counted
from .frames import sorted_runs

FANOUT = 8
#: Levels of a block, whose nodes one task holds at a time.
LEVELS = 3


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Node(NamedTuple):
    digest: str
    below: tuple[Node, ...]


def parent(below: tuple[Node, ...]) -> Node:
    return Node(digest(n.digest for n in below), below)


def grown(leaves: list[str], levels: int | None) -> list[list[Node]]:
    """All nodes level by level, from the leaves up; ``levels`` of them above the leaves, or as many as it takes to one node."""
    made = [[Node(x, ()) for x in leaves]]
    while len(made[-1]) > 1 if levels is None else len(made) <= levels:
        last = made[-1]
        made.append([parent(tuple(last[i : i + FANOUT])) for i in range(0, len(last), FANOUT)])
    return made


def with_leaf(top: Node, height: int, at: int, leaf: str) -> list[Node]:
    """The new nodes of a version of ``top`` in which the leaf ``at`` is another one, from the leaf up.

    They are the leaf and its ancestors; all other nodes are those of ``top``.
    """
    if not height:
        return [Node(leaf, ())]
    i, rest = divmod(at, FANOUT ** (height - 1))
    new = with_leaf(top.below[i], height - 1, rest, leaf)
    return [*new, parent((*top.below[:i], new[-1], *top.below[i + 1 :]))]


Path = list[tuple[str, str]]


def paths(made: list[list[Node]]) -> list[Path]:
    """For each leaf the digests left and right of its path, put together level by level up to the top."""
    known: list[Path] = [[] for _ in made[-1]]
    for level in reversed(made[:-1]):
        digests = [n.digest for n in level]
        below = []
        for i in range(len(level)):
            run = i - i % FANOUT
            own = "".join(digests[run:i]), "".join(digests[i + 1 : run + FANOUT])
            below.append([own, *known[i // FANOUT]])
        known = below
    return known


def folded(leaf: str, path: Path) -> list[str]:
    """The nodes over ``leaf`` that its siblings make, from its parent up."""
    out = []
    for left, right in path:
        leaf = digest((left, leaf, right))
        out.append(leaf)
    return out


def _height(block: int, n: int, levels: int) -> int | None:
    """Levels to grow over a block of ``n`` nodes: as many as it takes where it is its group's only one."""
    return None if not block and n < FANOUT**levels else levels


_PATH = "array<struct<left: string, right: string>>"
_ARROW_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _by_block(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"position div {FANOUT**levels}"))


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """``number, position, digest`` of every block's top, from those of its nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in sorted_runs(batches, ["number", "block"]):
            at = block["block"][0].as_py()
            top = grown(block["digest"].to_pylist(), _height(at, block.num_rows, levels))[-1][0]
            yield pa.record_batch(
                {"number": block["number"].combine_chunks()[:1], "position": pa.array([at], pa.int64()), "digest": pa.array([top.digest])}
            )

    blocks = _by_block(nodes.select("number", "position", "digest"), levels)
    dealt = blocks.repartition("number", "block").sortWithinPartitions("number", "block", "position")
    return dealt.mapInArrow(run, "number bigint, position bigint, digest string")


def _climb(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The written tables of nodes at the feet of blocks, bottom up, and the table of every group's top."""
    feet = []
    while True:
        feet.append(nodes)
        nodes, more = durable_counted(_tops(nodes, levels), F.col("position") > 0, "block-tops")
        if not more:
            return feet, nodes


def _told(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """The rows of each block behind the row that tells what lies above it, in one task and in order."""
    tell = above.withColumnRenamed("position", "block").withColumn("position", F.lit(-1).cast("bigint"))
    both = _by_block(nodes, levels).unionByName(tell, allowMissingColumns=True)
    return both.repartition("number", "block").sortWithinPartitions("number", "block", "position")


def _above(block: pa.Table) -> tuple[Path, int, pa.Table]:
    """What lies beside a block's way to the root, how many of its levels are above the subroot, and the block's nodes."""
    path = [(x["left"], x["right"]) for x in block["path"][0].as_py()]
    return path, block["upper"][0].as_py(), block.slice(1)


def _descend(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``number, position, path, upper`` of every node, from those of its block: what lies beside its way to the root."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in sorted_runs(batches, ["number", "block"]):
            over, upper, rows = _above(block)
            made = grown(rows["digest"].to_pylist(), _height(rows["block"][0].as_py(), rows.num_rows, levels))
            own = [[{"left": a, "right": b} for a, b in [*path, *over]] for path in paths(made)]
            columns = {name: rows[name].combine_chunks() for name in ("number", "position")}
            uppers = pa.array([upper] * rows.num_rows, pa.int32())
            yield pa.record_batch(columns | {"path": pa.array(own, _ARROW_PATH), "upper": uppers})

    told = _told(nodes.select("number", "position", "digest"), above, levels).select(
        "number", "block", "digest", "position", "path", "upper"
    )
    return durable(told.mapInArrow(run, f"number bigint, position bigint, path {_PATH}, upper int"), "block-paths")


def _above_lowest(feet: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """What lies above each of the lowest blocks, from what lies above the groups' tops."""
    for nodes in reversed(feet[1:]):
        above = _descend(nodes, above, levels)
    return above


def _proofs(batches: Iterable[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """The proofs and versions of the leaves of blocks that know what lies above them."""
    for block in sorted_runs(batches, ["number", "block"]):
        over, upper, rows = _above(block)
        leaves = rows["digest"].to_pylist()
        made = grown(leaves, _height(rows["block"][0].as_py(), len(leaves), levels))
        top, height = made[-1][0], len(made) - 1
        whole = [top.digest, *folded(top.digest, over)]
        beyond = {top.digest: whole}
        proofs, roots, versions = [], [], []
        for i, (path, changed) in enumerate(zip(paths(made), rows["changed"].to_pylist(), strict=True)):
            if changed is None:
                reached, copied = [leaves[i], *folded(leaves[i], path)][-1], None
            else:
                copied = [n.digest for n in with_leaf(top, height, i, changed)]
                reached = copied[-1]
            goes_on = beyond[reached] if reached in beyond else [reached, *folded(reached, over)]
            proofs.append([a + b for a, b in [*path, *over]])
            roots.append(goes_on[-1])
            versions.append(copied and copied + goes_on[1:])
        n = len(leaves)
        yield pa.record_batch(
            {
                "doc_id": rows["doc_id"].combine_chunks(),
                "leaf": pa.array(leaves, pa.string()),
                "subroot": pa.array([whole[len(over) - upper]] * n, pa.string()),
                "root": pa.array([whole[-1]] * n, pa.string()),
                "proof": pa.array(proofs, pa.list_(pa.string())),
                "folded_root": pa.array(roots, pa.string()),
                "copied": pa.array(versions, pa.list_(pa.string())),
            }
        )


def field(column: Column) -> Column:
    """A value as the leaf's hash takes it: its UTF-8 byte count, a colon and itself; ``-`` for null."""
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*columns: Column) -> Column:
    """The digest of a row's columns."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, folded_root, copied`` for every leaf.

    A task holds blocks of ``FANOUT ** levels`` leaves; the result does not depend on it.

    ``leaves`` has ``group`` and ``doc_id``, by which it is ordered, ``leaf``, a digest, and ``changed``, the
    digest that a tampered leaf has instead, or null. ``subroot`` and ``root`` are those of the untampered tree.
    ``proof`` has the siblings' digests, put together for each level, from the leaf's to those below the root.
    ``folded_root`` is the root over the changed leaf, or else over the leaf itself and its siblings. ``copied``
    has the nodes that a tampered leaf's version does not share with the tree: the leaf and its ancestors up to
    the version's root; null where nothing was tampered with.
    """
    rows = durable(
        leaves.select(
            F.col("group").cast("string").alias("group"), F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("leaf").alias("digest"), "changed",
        ),
        "leaves",
    )
    placed = order_in_group(rows, ["group"], ["doc_id", "digest", "changed"])
    groups = order_in_group(rows.select("group").distinct(), [], ["group"], "number")
    placed = placed.withColumn("position", F.col("position") - 1)
    nodes = durable(join_null_safe(placed, groups, ["group"]).drop("group"), "placed-leaves")
    feet, subroots = _climb(nodes, levels)
    # The subroots are the leaves of one more tree, whose only group is 0.
    upper = subroots.select(F.lit(0).cast("bigint").alias("number"), (F.col("number") - 1).alias("position"), "digest")
    upper_feet, root = _climb(durable(upper, "subroots"), levels)
    nothing = root.select("number", "position", F.expr(f"cast(array() as {_PATH})").alias("path"), F.lit(0).alias("upper"))
    beside = _descend(upper_feet[0], _above_lowest(upper_feet, nothing, levels), levels)
    tops = beside.select(
        (F.col("position") + 1).alias("number"), F.lit(0).cast("bigint").alias("position"), "path", F.size("path").alias("upper")
    )
    told = _told(nodes, _above_lowest(feet, tops, levels), levels)
    told = told.select("number", "block", "doc_id", "digest", "changed", "path", "upper")
    shape = "doc_id bigint, leaf string, subroot string, root string, proof array<string>, folded_root string, copied array<string>"
    return told.mapInArrow(partial(_proofs, levels=levels), shape)
