import random

import pytest
from pyspark.sql import functions as F

from forgeledger.operators import changes as C
from forgeledger.operators import history as H

COMMITS = "repo string, sha long, parent long"


def graph(rng, n, repo):
    """A random history: mostly linear, with forks and merges of up to three parents."""
    edges = [(repo, 0, None)]
    for sha in range(1, n):
        parents = {sha - 1} if rng.random() < 0.6 else set(rng.sample(range(sha), min(sha, rng.randint(1, 3))))
        edges += [(repo, sha, p) for p in parents]
    return edges


def ancestors(edges):
    parents = {}
    for repo, sha, parent in edges:
        parents.setdefault((repo, sha), set())
        if parent is not None:
            parents[(repo, sha)].add((repo, parent))
    found = {}
    for node in sorted(parents, key=lambda x: x[1]):
        found[node] = {node}.union(*[found[p] for p in parents[node] if p in parents])
    return found


@pytest.fixture(scope="module")
def estate(spark):
    rng = random.Random(3)
    edges = [e for i in range(6) for e in graph(rng, rng.randint(1, 35), f"r{i}")]
    return edges, ancestors(edges), H.place_commits(spark.createDataFrame(edges, COMMITS))


def test_ancestry_equals_brute_force(spark, estate):
    edges, known, history = estate
    nodes = sorted(known)
    pairs = [(a[0], a[1], b[1]) for a in nodes for b in nodes if a[0] == b[0]]
    tested = H.is_ancestor(history, spark.createDataFrame(pairs, "repo string, old long, new long"))
    got = {(r.repo, r.old, r.new): r.is_ancestor for r in tested.collect()}
    assert got == {(r, o, n): (r, o) in known[(r, n)] for r, o, n in pairs}


def test_counts_and_new_commits_equal_brute_force(spark, estate, rows):
    edges, known, history = estate
    rng = random.Random(8)
    nodes = sorted(known)
    heads = spark.createDataFrame(nodes, "repo string, head long")
    assert rows(H.ancestor_counts(history, heads)) == sorted(((r, s, len(a)) for (r, s), a in known.items()), key=repr)
    moves = sorted({(r, rng.randrange(max(s, 1)), s) for r, s in nodes} | {(r, s, s) for r, s in nodes[:4]} | {(r, s, 0) for r, s in nodes[5:9]})
    moved = spark.createDataFrame([*moves, ("r0", None, 0)], "repo string, old long, new long")
    expected = [(r, o, n, s) for r, o, n in moves for _, s in known[(r, n)] - known[(r, o)]] + [("r0", None, 0, 0)]
    assert rows(H.new_commits(history, moved)) == sorted(expected, key=repr)
    counts = {(r.repo, r.old, r.new): (r.has_new_commits, r.new_commit_count) for r in H.new_commit_counts(history, moved).collect()}
    wanted = {(r, o, n): (o != n, len(known[(r, n)] - known[(r, o)])) for r, o, n in moves}
    assert counts == wanted | {("r0", None, 0): (True, 1)}


def test_deep_linear_history_takes_few_rounds(spark, rows):
    n = 5_000
    edges = spark.range(n).select(F.lit("r").alias("repo"), F.col("id").alias("sha"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    history = H.place_commits(edges)
    moves = spark.createDataFrame([("r", 10, n - 1)], "repo string, old long, new long")
    assert rows(H.new_commit_counts(history, moves), "new_commit_count") == [(n - 11,)]
    assert H.new_commits(history, moves).count() == n - 11


def test_two_branches_merging_into_each_other_take_few_rounds(spark, rows):
    # main 2i and dev 2i+1 merge each other at every step.
    edges = [("r", 0, None, 0), ("r", 1, 0, 0)]
    for i in range(1, 200):
        edges += [("r", 2 * i, 2 * i - 2, 0), ("r", 2 * i, 2 * i - 1, 1), ("r", 2 * i + 1, 2 * i - 1, 0), ("r", 2 * i + 1, 2 * i, 1)]
    history = H.place_commits(spark.createDataFrame(edges, COMMITS + ", parent_no int"))
    heads = spark.createDataFrame([("r", 399), ("r", 398)], "repo string, head long")
    assert H.reach(history, heads).count() == 4
    assert rows(H.ancestor_counts(history, heads)) == [("r", 398, 399), ("r", 399, 400)]


def test_many_blocks_of_links(spark, rows, monkeypatch):
    monkeypatch.setattr(H, "_LINK_BLOCK", 3)
    monkeypatch.setattr(H, "_BLOCK", 2)
    rng = random.Random(17)
    edges = graph(rng, 60, "r") + graph(rng, 45, "s")
    known = ancestors(edges)
    history = H.place_commits(spark.createDataFrame(edges, COMMITS))
    heads = spark.createDataFrame(sorted(known), "repo string, head long")
    assert rows(H.ancestor_counts(history, heads)) == sorted(((r, s, len(a)) for (r, s), a in known.items()), key=repr)
    moves = [("r", 20, 59), ("s", 7, 44), ("s", 44, 30)]
    expected = [(r, o, n, c) for r, o, n in moves for _, c in known[(r, n)] - known[(r, o)]]
    got = H.new_commits(history, spark.createDataFrame(moves, "repo string, old long, new long"))
    assert rows(got) == sorted(expected, key=repr)


def test_parent_order_does_not_change_results(spark, rows):
    edges = [("r", 0, None, 0), ("r", 1, 0, 0), ("r", 2, 0, 0), ("r", 3, 1, 0), ("r", 3, 2, 1)]
    heads = spark.createDataFrame([("r", 3)], "repo string, head long")
    with_order = H.place_commits(spark.createDataFrame(edges, COMMITS + ", parent_no int"))
    without = H.place_commits(spark.createDataFrame([e[:3] for e in edges], COMMITS))
    assert rows(H.ancestor_counts(with_order, heads)) == rows(H.ancestor_counts(without, heads)) == [("r", 3, 4)]


def test_cycle_is_reported(spark):
    ring = [("r", i, (i + 1) % 3) for i in range(3)]
    branched = [("s", i, (i + 1) % 3) for i in range(3)] + [("s", 10 + i, i) for i in range(3)]
    for edges in (ring, branched):
        with pytest.raises(RuntimeError, match="cycle"):
            H.place_commits(spark.createDataFrame(edges, COMMITS))


def test_side_branches_do_not_cut_the_main_line(spark, rows):
    # A side commit with a greater number forks off and is merged back at every sixth commit.
    main = [("r", 0, None, 0)] + [("r", i, i - 1, 0) for i in range(1, 600)]
    side = [("r", 10_000 + i, i, 0) for i in range(0, 590, 6)]
    back = [("r", i + 4, 10_000 + i, 1) for i in range(0, 590, 6)]
    history = H.place_commits(spark.createDataFrame(main + side + back, COMMITS + ", parent_no int"))
    heads = spark.createDataFrame([("r", 599)], "repo string, head long")
    reached = H.reach(history, heads)
    assert reached.count() == 1 + len(side)
    assert rows(H.ancestor_counts(history, heads)) == [("r", 599, 600 + len(side))]


FORK = [("r", 1, None), ("r", 2, 1), ("r", 3, 1)]


def test_force_push(spark, rows):
    history = H.place_commits(spark.createDataFrame(FORK, COMMITS))
    expected = {(1, 2): False, (2, 1): True, (2, 3): True, (2, 2): False, (77, 2): True, (1, 77): True}
    moves = spark.createDataFrame([("r", old, new) for old, new in expected], "repo string, old long, new long")
    assert {(r.old, r.new): r.forced for r in H.force_push(history, moves).collect()} == expected


def test_shallow_boundary(spark, rows):
    history = H.place_commits(spark.createDataFrame([("r", 5, 4), ("r", 6, 5)], COMMITS))
    assert rows(H.ancestor_counts(history, spark.createDataFrame([("r", 6)], "repo string, head long"))) == [("r", 6, 2)]


def test_divergence_with_either_history(spark, rows):
    left_commits = spark.createDataFrame(FORK, COMMITS)
    right_commits = spark.createDataFrame([("r", 1, None), ("r", 3, 1), ("r", 4, 2), ("r", 2, 1)], COMMITS)
    left = spark.createDataFrame([("r", "main", 2), ("r", "dev", 2), ("r", "same", 1), ("r", "mine", 2), ("r", "back", 2)], "repo string, branch string, tip long")
    right = spark.createDataFrame([("r", "main", 3), ("r", "dev", 4), ("r", "same", 1), ("r", "back", 1)], "repo string, branch string, tip long")
    union = H.divergence(left_commits, left, right, "union", right_commits)
    assert rows(union, "branch") == [("main",)]
    # The left history does not know commit 4, so the right side being ahead reads as a conflict.
    assert rows(H.divergence(left_commits, left, right, "left"), "branch") == [("dev",), ("main",)]
    with pytest.raises(ValueError):
        H.divergence(left_commits, left, right, "right")


def test_latest_state_and_merge(spark, rows):
    schema = "repo string, ts int, seq int, head string"
    log = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 2, 2, None), ("b", 1, 1, "z")], schema)
    state = C.latest_state(log)
    assert rows(state) == [("a", 2, 2, None), ("b", 1, 1, "z")]
    batch = spark.createDataFrame([("b", 5, 1, "n"), ("b", 4, 1, "o"), ("c", 1, 1, "p")], schema)
    assert rows(C.state_merge(state, batch)) == [("a", 2, 2, None), ("b", 5, 1, "n"), ("c", 1, 1, "p")]
    assert rows(C.tracked_repos(log)) == [("a",), ("b",)]


def test_branches_and_change_status(spark, rows):
    old = spark.createDataFrame([("r", "main"), ("r", "old"), ("s", "x")], "repo string, branch string")
    new = spark.createDataFrame([("r", "main"), ("r", "new"), ("r", "two")], "repo string, branch string")
    assert rows(C.branch_diff(old, new)) == [("r", 2, 1, True, True), ("s", 0, 1, False, True)]
    heads = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")], "repo string, head string")
    state = spark.createDataFrame([("b", "1"), ("c", "1"), ("d", "")], "repo string, last_commit string")
    assert rows(C.change_status(heads, state), "repo", "status", "has_new_commits") == [
        ("a", "first_sync", True), ("b", "unchanged", False), ("c", "changed", True), ("d", "first_sync", True)
    ]


def test_policies(spark, rows):
    refs = "repo string, branch string, tip long"
    source = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("r", "c", 3)], refs)
    target = spark.createDataFrame([("r", "a", 1), ("r", "b", 9), ("r", "d", 4)], refs)

    def outcome(policy):
        return rows(C.resolve_refs(source, target, policy), "branch", "action", "final_tip", "success")

    assert outcome("source_wins") == [("a", "none", 1, True), ("b", "force_target", 2, True), ("c", "force_target", 3, True), ("d", "delete_target", None, True)]
    assert outcome("target_wins") == [("a", "none", 1, True), ("b", "force_source", 9, True), ("c", "delete_source", None, True), ("d", "force_source", 4, True)]
    assert outcome("fail_fast") == [("a", "none", 1, True), ("b", "fail", None, False), ("c", "fail", None, False), ("d", "fail", None, False)]
    assert {r[1:] for r in outcome("coin_toss")} == {("Unknown resolution strategy: coin_toss", None, False)}


def test_directions_and_ref_counts(spark, rows):
    results = spark.createDataFrame(
        [("a", "source_to_target", True, 3, 1), ("a", "target_to_source", False, 0, 0), ("b", "source_to_target", True, 5, 2)],
        "repo string, direction string, success boolean, commits_synced long, branches_synced long",
    )
    assert rows(C.direction_totals(results)) == [("a", "bidirectional", False, 3, 1), ("b", "source_to_target", True, 5, 2)]
    commits = spark.createDataFrame([("r", 1, None), ("r", 2, 1), ("r", 2, 0)], COMMITS)
    refs = spark.createDataFrame([("r", "m"), ("s", "m")], "repo string, branch string")
    assert rows(C.ref_counts(commits, refs)) == [("r", 2, 1), ("s", 0, 1)]


def test_file_sets(spark, rows):
    old = spark.createDataFrame([("r", "a"), ("r", "b")], "repo string, file string")
    new = spark.createDataFrame([("r", "b"), ("r", "c")], "repo string, file string")
    assert rows(C.file_set_diff(old, new)) == [("r", "a", "removed"), ("r", "b", "unchanged"), ("r", "c", "added")]


@pytest.mark.parametrize("large", [False, True])
def test_version_history(spark, rows, large, request):
    if large:
        request.getfixturevalue("many_slices")
    sequence = "1 1 2 2 3 2 2 1 4 4 5 5".split()
    log = spark.createDataFrame([("r", i, v) for i, v in enumerate(sequence)] + [("s", 0, "1")], "repo string, ts int, version string")
    assert rows(C.version_audit(log)) == [("r", 10, "5", "4"), ("r", 2, "2", "1"), ("r", 4, "3", "2"), ("r", 5, "2", "3"), ("r", 7, "1", "2"), ("r", 8, "4", "1")]
    assert rows(C.version_rollbacks(log)) == [("r", 5, "2", "3"), ("r", 7, "1", "2")]
