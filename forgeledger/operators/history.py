"""Reachability in commit graphs.

Commit graphs are deep: a plain frontier join needs one round per commit of history. Here
every commit is first placed on a *line* with its depth below the newest commit of that line.
A commit that is reached on a line reaches all deeper commits of that line, therefore the set
reachable from a head is stored as one number per line it touches, and the frontier only
moves between lines.

Lines follow first parents. Where several commits have the same first parent, the line goes
on in the one with most first-parent descendants, so that the way down from any commit
changes lines at most log2(n) times. They are found in three steps, all by pointer doubling:

1. *Segments*: unbranched runs, also cut at about every 64th commit. Their lengths are small
   whatever the history looks like, so this takes about ten rounds over the commits.
2. *Weights*: descendants of each segment in the tree of segments.
3. *Lines*: the heaviest child continues the line. Steps 2 and 3 take log2(depth) rounds over
   the much smaller table of segments.

All joins are on (repo, commit), (repo, segment), (repo, line, block) and the like, never on
the repository alone, so a repository holding a third of all commits is spread like any other
data.

Inputs: ``commits(repo, sha, parent)``, one row per parent edge, parent null for a root. An
optional ``parent_no`` column (0 = first parent) makes lines follow the main history; it only
affects speed. Edges to commits that are not listed (a shallow boundary) are ignored.
"""

from __future__ import annotations

import itertools
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, durable_counted

if TYPE_CHECKING:
    from .reachability import CommitIndex

_CYCLE = "the commit graph has a cycle"
# About one commit in this many ends a segment.
_SEGMENT = 64
# Long stretches of a line are handled in blocks of this many commits.
_BLOCK = 65_536
# Links are matched per block of this many depths, so that a line with very many links and
# very many heads is worked on by many tasks.
_LINK_BLOCK = 1_024


class History:
    """Commits of an estate with their line and depth, and the links between lines."""

    def __init__(self, places: DataFrame, links: DataFrame):
        self.places = places  # repo, sha, line, depth
        self.links = links  # repo, from_line, block, from_depth, to_line, to_depth
        self.lengths = places.groupBy("repo", "line").agg((F.max("depth") + 1).alias("length"))
        self.last_blocks = links.groupBy("repo", "from_line").agg(F.max("block").alias("last_block"))

    def with_lengths(self, rows: DataFrame) -> DataFrame:
        """Rows of (repo, line) with the ``length`` of the line, which all its depths are smaller than."""
        return rows.join(self.lengths, ["repo", "line"])

    def reach(self, heads: DataFrame) -> DataFrame:
        return _search(self, heads)

    def is_ancestor(self, pairs: DataFrame) -> DataFrame:
        return _tested(self, pairs)


def first_parents(commits: DataFrame) -> DataFrame:
    """(repo, sha, parent), one row a commit, with its first parent."""
    if "parent_no" in commits.columns:
        preference = F.struct("parent_no", "parent")
    else:
        preference = F.col("parent")
    return commits.groupBy("repo", "sha").agg(F.min_by("parent", preference).alias("parent"))


def place_lines(nodes: DataFrame) -> DataFrame:
    """(repo, sha, line, depth) of commits with their first parents."""
    places, segments = _segments(nodes)
    lines = _heavy_lines(segments)
    return durable(
        places.join(lines, ["repo", "segment"]).select(
            "repo", "sha", "line", (F.col("inside") + F.col("offset")).alias("depth")
        ),
        "places",
    )


def place_commits(commits: DataFrame) -> History:
    """The graph for one question; ``reachability.CommitIndex`` keeps it for many and grows with the commits."""
    places = place_lines(durable(first_parents(commits), "nodes"))
    child = places.select("repo", "sha", F.col("line").alias("from_line"), F.col("depth").alias("from_depth"))
    parent = places.select(
        "repo", F.col("sha").alias("parent"), F.col("line").alias("to_line"), F.col("depth").alias("to_depth")
    )
    along = (F.col("from_line") == F.col("to_line")) & (F.col("to_depth") == F.col("from_depth") + 1)
    links = (
        commits.where("parent is not null")
        .select("repo", "sha", "parent")
        .join(child, ["repo", "sha"])
        .join(parent, ["repo", "parent"])
        .where(~along)
        .groupBy("repo", "from_line", "from_depth", "to_line")
        .agg(F.min("to_depth").alias("to_depth"))
    )
    return History(places, durable(links.withColumn("block", _block("from_depth")), "links"))


def _segments(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Place of every commit in its segment, and the segments with their parent and length."""
    above = nodes.where("parent is not null").groupBy("repo", "parent").agg(
        F.count(F.lit(1)).alias("n_children"), F.min("sha").alias("child")
    )
    runs_on = (F.col("n_children") == 1) & (F.pmod(F.xxhash64("repo", "parent"), F.lit(_SEGMENT)) != 0)
    above = above.where(runs_on).select("repo", F.col("parent").alias("sha"), "child")
    start = nodes.select("repo", "sha").join(above, ["repo", "sha"], "left")
    climbed = _climb(start.select("repo", "sha", "child", F.lit(1).cast("long").alias("step")))
    places = climbed.select("repo", "sha", F.col("top").alias("segment"), F.col("distance").alias("inside"))
    lengths = places.groupBy("repo", "segment").agg((F.max("inside") + 1).alias("length"))
    # The first parent of a segment's oldest commit has the newest place in its own segment,
    # because nothing runs on above it. Other first parents lie inside the same segment.
    tops = places.where("inside = 0").select("repo", F.col("segment").alias("parent"))
    down = (
        nodes.where("parent is not null")
        .join(tops, ["repo", "parent"])
        .join(places, ["repo", "sha"])
        .select("repo", "segment", F.col("parent").alias("parent_segment"))
    )
    segments = lengths.join(down, ["repo", "segment"], "left")
    return places, durable(segments, "segments")


def _climb(start: DataFrame) -> DataFrame:
    """Follow ``child`` links to the top: (repo, sha, child, step) to (repo, sha, top, distance).

    Every row is the child of at most one other. Rows that have arrived are not written again.
    """
    latest = start.select(
        "repo",
        "sha",
        F.coalesce("child", "sha").alias("top"),
        F.when(F.col("child").isNull(), F.lit(0)).otherwise(F.col("step")).cast("long").alias("distance"),
        F.col("child").isNull().alias("arrived"),
    )
    latest, moving = durable_counted(latest, ~F.col("arrived"), "climb")
    finished = latest.where("arrived")
    while moving:
        pending = latest.where("not arrived")
        target = finished.unionByName(pending).select(
            "repo",
            F.col("sha").alias("top"),
            F.col("top").alias("next_top"),
            F.col("distance").alias("next_distance"),
            F.col("arrived").alias("next_arrived"),
        )
        # All pending rows point the same number of links up, so no two share a target.
        moved = pending.join(target, ["repo", "top"]).select(
            "repo",
            "sha",
            F.col("next_top").alias("top"),
            (F.col("distance") + F.col("next_distance")).alias("distance"),
            F.col("next_arrived").alias("arrived"),
        )
        latest, left = durable_counted(moved, ~F.col("arrived"), "climb")
        if left == moving:
            raise RuntimeError(_CYCLE)  # without a cycle, some rows arrive in every round
        moving = left
        finished = finished.unionByName(latest.where("arrived"))
    return finished.select("repo", "sha", "top", "distance")


def _heavy_lines(segments: DataFrame) -> DataFrame:
    """(repo, segment, line, offset): the line each segment is part of, and where it starts there."""
    state = segments.select(
        "repo", "segment", F.col("parent_segment").alias("ancestor"), F.col("length").alias("weight")
    )
    moving = None
    while moving != 0:
        # Weights cover all descendants fewer than 2^k links away. Those further away, up to
        # twice as far, are below the descendants that have this segment as 2^k-th ancestor.
        pending = state.where("ancestor is not null")
        gained = pending.groupBy("repo", F.col("ancestor").alias("segment")).agg(F.sum("weight").alias("gain"))
        further = state.select("repo", F.col("segment").alias("ancestor"), F.col("ancestor").alias("next_ancestor"))
        moved = state.join(further, ["repo", "ancestor"], "left").join(gained, ["repo", "segment"], "left")
        state, left = durable_counted(
            moved.select(
                "repo",
                "segment",
                F.col("next_ancestor").alias("ancestor"),
                (F.col("weight") + F.coalesce("gain", F.lit(0))).alias("weight"),
            ),
            F.col("ancestor").isNotNull(),
            "weights",
        )
        if left and left == moving:
            raise RuntimeError(_CYCLE)
        moving = left
    child = segments.join(state.select("repo", "segment", "weight"), ["repo", "segment"]).where(
        "parent_segment is not null"
    )
    heaviest = child.groupBy("repo", F.col("parent_segment").alias("sha")).agg(
        F.max(F.struct("weight", "segment", "length")).alias("best")
    )
    start = segments.select("repo", F.col("segment").alias("sha")).join(heaviest, ["repo", "sha"], "left")
    climbed = _climb(start.select("repo", "sha", F.col("best.segment").alias("child"), F.col("best.length").alias("step")))
    return climbed.select(
        "repo", F.col("sha").alias("segment"), F.col("top").alias("line"), F.col("distance").alias("offset")
    )


def _block(depth: str) -> Column:
    return F.floor(F.col(depth) / _LINK_BLOCK).cast("long")


def reach(history: History, heads: DataFrame) -> DataFrame:
    """(repo, head, line, entry): from ``head`` every commit of ``line`` at depth >= entry.

    ``history`` is a ``History`` or a ``reachability.CommitIndex``. ``heads`` has (repo, head). Heads that are not in
    the history have no rows. The result has one row per head and line below it, so ask about the heads that
    matter (branch tips), not about every commit.
    """
    return history.reach(heads)


def _search(history: History, heads: DataFrame) -> DataFrame:
    """``reach`` in rounds; their number is the number of times a path changes lines, not its length."""
    key = ["repo", "head", "line"]
    start = history.places.select("repo", F.col("sha").alias("head"), "line", F.col("depth").alias("entry"))
    start = start.join(heads.select("repo", "head").distinct(), ["repo", "head"], "left_semi")
    fresh, moving = durable_counted(start.withColumn("before", F.lit(None).cast("long")), F.lit(True), "reach")
    known = fresh.select(*key, "entry")
    # Entries only ever decrease, so the loop ends by itself. A round writes what it improved and nothing else.
    for turn in itertools.count(1):
        best = known.groupBy(*key).agg(F.min("entry").alias("entry"))
        if not moving:
            return best
        if turn % 8 == 0:
            known = best = durable(best, "reached")
        # Only the newly covered stretch [entry, before) of a line can lead anywhere new.
        front = fresh.select("repo", "head", F.col("line").alias("from_line"), "entry", "before")
        # Lines without links drop out here, the others spread over their blocks.
        spread = front.join(history.last_blocks, ["repo", "from_line"]).where(_block("entry") <= F.col("last_block"))
        last = F.least("last_block", F.coalesce(_block("before"), "last_block"))
        blocks = spread.select(
            "repo", "head", "from_line", "entry", "before", F.explode(F.sequence(_block("entry"), last)).alias("block")
        )
        step = (
            blocks.join(history.links, ["repo", "from_line", "block"])
            .where((F.col("from_depth") >= F.col("entry")) & (F.col("before").isNull() | (F.col("from_depth") < F.col("before"))))
            .groupBy("repo", "head", F.col("to_line").alias("line"))
            .agg(F.min("to_depth").alias("reached"))
        )
        improved = (
            step.join(best.withColumnRenamed("entry", "before"), key, "left")
            .where("before is null or reached < before")
            .select(*key, F.col("reached").alias("entry"), "before")
        )
        fresh, moving = durable_counted(improved, F.lit(True), "reach")
        if moving:
            known = known.unionByName(fresh.select(*key, "entry"))


def is_ancestor(history: History, pairs: DataFrame) -> DataFrame:
    """Per (repo, old, new): whether old is reachable from new. A commit is its own ancestor.

    Null where either commit is unknown, which callers decide on.
    """
    return history.is_ancestor(pairs)


def _tested(history: History, pairs: DataFrame) -> DataFrame:
    """Depths decide pairs on one line, most moves of a branch; only the others are followed over the graph."""
    old = history.places.select("repo", F.col("sha").alias("old"), "line", "depth")
    new = history.places.select("repo", F.col("sha").alias("new"), F.col("line").alias("new_line"), F.col("depth").alias("new_depth"))
    wanted = pairs.select("repo", "old", "new").distinct()
    placed = durable(wanted.join(old, ["repo", "old"], "left").join(new, ["repo", "new"], "left"), "pairs")
    reached = _search(history, placed.where("line <> new_line").select("repo", F.col("new").alias("head")))
    entries = reached.select("repo", F.col("head").alias("new"), "line", "entry")
    joined = placed.join(entries, ["repo", "new", "line"], "left")
    along = F.when(F.col("line") == F.col("new_line"), F.col("new_depth")).otherwise(F.col("entry"))
    known = F.col("depth").isNotNull() & F.col("new_depth").isNotNull()
    hit = F.coalesce(along <= F.col("depth"), F.lit(False))
    return joined.select("repo", "old", "new", F.when(known, hit).alias("is_ancestor"))


def ancestor_counts(history: History, heads: DataFrame) -> DataFrame:
    """Commits reachable from each head, the head included. Arithmetic on lines, no enumeration."""
    return (
        history.with_lengths(reach(history, heads))
        .groupBy("repo", "head")
        .agg(F.sum(F.col("length") - F.col("entry")).alias("n_ancestors"))
    )


def force_push(history: History, moves: DataFrame) -> DataFrame:
    """Per ref move (repo, old, new): forced when old is not an ancestor of new.

    Where a commit is unknown the ancestry test fails, and that counts as forced.
    """
    tested = is_ancestor(history, moves)
    joined = moves.join(tested, ["repo", "old", "new"], "left")
    return joined.select(*moves.columns, (~F.coalesce("is_ancestor", F.lit(False))).alias("forced"))


def _new_stretches(history: History, moves: DataFrame) -> DataFrame:
    """Per (repo, old, new) and line: the stretch [first, past) that only ``new`` reaches."""
    pairs = moves.select("repo", "old", "new").distinct()
    end = lambda head, new: F.struct(F.col(head).alias("head"), F.lit(new).alias("is_new"))
    ends = pairs.select("*", F.explode(F.array(end("new", True), end("old", False))).alias("end")).select("repo", "old", "new", "end.*")
    reached = reach(history, ends.where("head is not null").select("repo", "head"))
    entry = lambda new: F.min(F.when(F.col("is_new") == new, F.col("entry")))
    spans = ends.join(reached, ["repo", "head"]).groupBy("repo", "old", "new", "line").agg(entry(True).alias("first"), entry(False).alias("stop"))
    return history.with_lengths(spans.where("first is not null")).select(
        "repo", "old", "new", "line", "first", F.least("length", F.coalesce("stop", "length")).alias("past")
    ).where("past > first")


def new_commit_counts(history: History, moves: DataFrame) -> DataFrame:
    """Commits reachable from ``new`` but not from ``old``, per move (repo, old, new).

    A repository without an old head reports exactly one new commit, its current head.
    Equal heads report none.
    """
    counted = (
        _new_stretches(history, moves.where("old is not null and old <> new"))
        .groupBy("repo", "old", "new")
        .agg(F.sum(F.col("past") - F.col("first")).alias("__n"))
    )
    joined = moves.join(counted, ["repo", "old", "new"], "left")
    count = F.when(F.col("old").isNull(), F.lit(1)).otherwise(F.coalesce("__n", F.lit(0))).cast("long")
    changed = F.col("old").isNull() | (F.col("old") != F.col("new"))
    return joined.select(*moves.columns, changed.alias("has_new_commits"), count.alias("new_commit_count"))


def new_commits(history: History, moves: DataFrame) -> DataFrame:
    """The commits behind ``new_commit_counts``, one row each."""
    stretches = _new_stretches(history, moves.where("old is not null and old <> new"))
    # Long stretches are cut into blocks first so that no single row carries a huge array.
    blocks = stretches.select(
        "repo", "old", "new", "line", "past",
        F.explode(F.sequence("first", F.col("past") - 1, F.lit(_BLOCK))).alias("start"),
    )
    depths = blocks.select(
        "repo", "old", "new", "line",
        F.explode(F.sequence("start", F.least(F.col("start") + _BLOCK, F.col("past")) - 1)).alias("depth"),
    )
    listed = depths.join(history.places, ["repo", "line", "depth"]).select("repo", "old", "new", "sha")
    initial = moves.where("old is null").select("repo", "old", "new", F.col("new").alias("sha")).distinct()
    return listed.unionByName(initial)


def divergence(
    commits: DataFrame | None, left: DataFrame, right: DataFrame, history: str = "union", right_commits: DataFrame | None = None,
    index: CommitIndex | None = None,
) -> DataFrame:
    """Branches on both sides whose tips differ and where neither is an ancestor of the other.

    ``index``, a ``reachability.CommitIndex`` of the histories to look at, takes the place of commits.

    ``history='left'`` looks at the left side's commits only, so a right tip unknown there
    counts as diverged even when the right side is simply ahead. ``'union'`` also uses
    ``right_commits`` and recognises that case. ``left``/``right`` have (repo, branch, tip).
    """
    if history not in ("union", "left"):
        raise ValueError(f"unknown history: {history}")
    if index is None and history == "union" and right_commits is not None:
        commits = commits.unionByName(right_commits).distinct()
    both = left.select("repo", "branch", F.col("tip").alias("left_tip")).join(
        right.select("repo", "branch", F.col("tip").alias("right_tip")), ["repo", "branch"]
    ).where("left_tip <> right_tip")
    placed = index or place_commits(commits)
    down = both.select("repo", F.col("left_tip").alias("new"), F.col("right_tip").alias("old"))
    up = both.select("repo", F.col("right_tip").alias("new"), F.col("left_tip").alias("old"))
    related = is_ancestor(placed, down.unionByName(up)).where("is_ancestor")
    behind = related.select("repo", F.col("new").alias("left_tip"), F.col("old").alias("right_tip"))
    ahead = related.select("repo", F.col("old").alias("left_tip"), F.col("new").alias("right_tip"))
    return both.join(behind.union(ahead), ["repo", "left_tip", "right_tip"], "left_anti").select(
        "repo", "branch", "left_tip", "right_tip"
    )

