"""The stored index of commits: appending equals building anew, and brute force; questions take few jobs."""

import random

import pytest
from pyspark.sql import functions as F

from forgeledger.operators import history as H
from forgeledger.operators import reachability as R
from forgeledger.sources.manifests import Ledger
from tests.test_history import ancestors, graph

COMMITS = "repo string, sha long, parent long"
PAIRS = "repo string, old long, new long"


def index_of(spark, path, batches, schema=COMMITS):
    index = R.CommitIndex(spark, str(path))
    for i, edges in enumerate(batches):
        assert index.extend(spark.createDataFrame(edges, schema), i)
    return index


def cut(edges, places):
    """Batches by commit number, so that parents come no later than their children."""
    bounds = [-1, *places, max(e[1] for e in edges)]
    return [[e for e in edges if a < e[1] <= b] for a, b in zip(bounds, bounds[1:], strict=False)]


def everything(known):
    nodes = sorted(known)
    return [(a[0], a[1], b[1]) for a in nodes for b in nodes if a[0] == b[0]]


def check(spark, rows, index, known):
    pairs = everything(known)
    got = {(r.repo, r.old, r.new): r.is_ancestor for r in H.is_ancestor(index, spark.createDataFrame(pairs, PAIRS)).collect()}
    assert got == {(r, o, n): (r, o) in known[(r, n)] for r, o, n in pairs}
    heads = spark.createDataFrame(sorted(known), "repo string, head long")
    assert rows(H.ancestor_counts(index, heads)) == sorted(((r, s, len(a)) for (r, s), a in known.items()), key=repr)
    rng = random.Random(8)
    moves = sorted({(r, rng.randrange(max(s, 1)), s) for r, s in known} & set(pairs))
    moved = spark.createDataFrame([*moves, ("r0", None, 0)], PAIRS)
    expected = [(r, o, n, s) for r, o, n in moves if o != n for _, s in known[(r, n)] - known[(r, o)]] + [("r0", None, 0, 0)]
    assert rows(H.new_commits(index, moved)) == sorted(expected, key=repr)


def test_appending_equals_brute_force_and_building_anew(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(R, "_LABEL_BLOCK", 3)
    rng = random.Random(4)
    edges = [e for i in range(4) for e in graph(rng, rng.randint(20, 45), f"r{i}")]
    known = ancestors(edges)
    appended = index_of(spark, tmp_path / "appended", cut(edges, [9, 22]))
    # Folders are merged like the digits of a binary counter, and those merged go.
    assert len(appended.ledger.current()["runs"]) == 2 and appended.expire(1) == 1
    check(spark, rows, appended, known)
    check(spark, rows, index_of(spark, tmp_path / "whole", [edges]), known)
    moves = spark.createDataFrame([(f"r{i}", 3, 19) for i in range(4)], PAIRS)
    assert jobs_of(spark, "forced", lambda: H.force_push(appended, moves).collect()) < 15
    assert jobs_of(spark, "counts", lambda: H.ancestor_counts(appended, moves.select("repo", F.col("new").alias("head"))).collect()) < 15
    assert jobs_of(spark, "new", lambda: H.new_commit_counts(appended, moves).collect()) < 15


def test_branches_merging_each_other_over_batches(spark, tmp_path, rows):
    edges = [("r0", 0, None, 0), ("r0", 1, 0, 0)]
    for i in range(1, 40):
        edges += [("r0", 2 * i, 2 * i - 2, 0), ("r0", 2 * i, 2 * i - 1, 1), ("r0", 2 * i + 1, 2 * i - 1, 0), ("r0", 2 * i + 1, 2 * i, 1)]
    index = index_of(spark, tmp_path / "i", cut(edges, [12]), COMMITS + ", parent_no int")
    check(spark, rows, index, ancestors([e[:3] for e in edges]))


def test_merged_branches_cost_one_label_each(spark, tmp_path, rows):
    """A side commit forks off and is merged back at every sixth commit; a release line merges main twice."""
    main = [("r", 0, None, 0)] + [("r", i, i - 1, 0) for i in range(1, 300)]
    side = [("r", 10_000 + i, i, 0) for i in range(0, 290, 6)]
    back = [("r", i + 4, 10_000 + i, 1) for i in range(0, 290, 6)]
    release = [("r", 20_000, 150, 0), ("r", 20_001, 20_000, 0), ("r", 20_001, 200, 1), ("r", 20_002, 20_001, 0), ("r", 20_002, 250, 1)]
    index = index_of(spark, tmp_path / "i", [main + side + back, release], COMMITS + ", parent_no int")
    labels = index._stored("labels")
    assert labels.join(index._stored("tips"), ["repo", "line"]).where("line = 0").count() == len(side)
    # Main twice, and of its merges those after the place where the release began and up to the second merge.
    later = sum(150 < i + 4 <= 250 for i in range(0, 290, 6))
    assert labels.where("line = 20000").count() == 2 + later
    heads = spark.createDataFrame([("r", 299), ("r", 20_002)], "repo string, head long")
    # All of main and the side commits; main up to the second merge, the side commits merged by then, and three more.
    merged = sum(i + 4 <= 250 for i in range(0, 290, 6))
    assert rows(H.ancestor_counts(index, heads)) == [("r", 20_002, 251 + merged + 3), ("r", 299, 300 + len(side))]


def test_lost_extensions_replay_and_known_commits(spark, tmp_path, rows, monkeypatch):
    first = [("r0", 0, None), ("r0", 1, 0), ("r0", 2, 1), ("r0", 2, 77)]
    second = [*first, ("r0", 3, 2), ("r0", 4, 1), ("r0", 5, 4), ("r0", 5, 3), ("r9", 1, None)]
    index = index_of(spark, tmp_path / "i", [first])
    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "publish", lambda *_: (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            index.extend(spark.createDataFrame(second, COMMITS), 1)
    assert index.places.count() == 3
    # A batch that was taken in changes nothing; one that was lost, with commits that came before, comes again.
    assert not index.extend(spark.createDataFrame([("r0", 9, 2)], COMMITS), 0)
    assert index.extend(spark.createDataFrame(second, COMMITS), 1)
    check(spark, rows, index, ancestors([e for e in dict.fromkeys(second) if e[2] != 77]))
    unknown = spark.createDataFrame([("r0", 9, 3), ("r0", 3, 77), ("zz", 1, 1)], PAIRS)
    assert [r.is_ancestor for r in H.is_ancestor(index, unknown).collect()] == [None] * 3


def test_an_index_without_commits(spark, tmp_path):
    with pytest.raises(ValueError):
        R.CommitIndex(spark, str(tmp_path / "none")).reach(spark.createDataFrame([], "repo string, head long"))


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
