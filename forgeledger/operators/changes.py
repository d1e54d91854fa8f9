"""Saved state, branch changes, reference conflicts and version history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import with_previous

POLICIES = ("source_wins", "target_wins", "fail_fast")


def latest_state(writes: DataFrame, keys: Sequence[str] = ("repo",), order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """The last write of every repository.

    A maximum over structs instead of a window: it combines before the shuffle, so a
    repository with very many writes sends one row per task.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in writes.columns if c not in keys and c not in order]
    last = F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("__last")
    return writes.groupBy(*keys).agg(last).select(*keys, *[F.col("__last")[c].alias(c) for c in [*order, *rest]])


def state_merge(
    snapshot: DataFrame, batch: DataFrame, keys: Sequence[str] = ("repo",), order: Sequence[str] = ("ts", "seq")
) -> DataFrame:
    """The snapshot after a batch of writes. Repositories outside the batch are unchanged."""
    newest = latest_state(batch, keys, order).select(*snapshot.columns)
    return snapshot.join(newest.select(*keys), list(keys), "left_anti").unionByName(newest)


def tracked_repos(state: DataFrame, key: str = "repo") -> DataFrame:
    return state.select(key).distinct()


def branch_status(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row per (repo, branch) of either side: new, deleted or kept."""
    keys = ["repo", "branch"]
    old = previous.select(*keys).distinct().withColumn("__old", F.lit(True))
    new = current.select(*keys).distinct().withColumn("__new", F.lit(True))
    status = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "deleted").otherwise("kept")
    return old.join(new, keys, "full").select(*keys, status.alias("status"))


def branch_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """New and deleted branch counts per repository; names are in ``branch_status``."""
    new, deleted = F.count_if(F.col("status") == "new"), F.count_if(F.col("status") == "deleted")
    counts = branch_status(previous, current).groupBy("repo").agg(
        new.alias("new_branch_count"), deleted.alias("deleted_branch_count")
    )
    return counts.select(
        "*",
        (F.col("new_branch_count") > 0).alias("has_new_branches"),
        (F.col("deleted_branch_count") > 0).alias("has_deleted_branches"),
    )


def change_status(heads: DataFrame, state: DataFrame) -> DataFrame:
    """first_sync, unchanged or changed. ``heads`` has (repo, head), ``state`` (repo, last_commit)."""
    joined = heads.select("repo", "head").join(state.select("repo", "last_commit"), "repo", "left")
    status = (
        F.when(F.col("last_commit").isNull() | (F.col("last_commit").cast("string") == ""), "first_sync")
        .when(F.col("last_commit") == F.col("head"), "unchanged")
        .otherwise("changed")
    )
    return joined.select("repo", "head", "last_commit", status.alias("status")).withColumn(
        "has_new_commits", F.col("status") != "unchanged"
    )


def resolve_refs(source: DataFrame, target: DataFrame, policy: str) -> DataFrame:
    """Outcome per (repo, branch) of forcing one side onto the other.

    ``final_tip`` is the tip both sides have afterwards, null where the branch goes away. With
    fail_fast, differing refs stay as they are and count as unsuccessful. An unknown policy
    gives an error row per ref instead of failing the job.
    """
    keys = ["repo", "branch"]
    both = source.select(*keys, F.col("tip").alias("source_tip")).join(
        target.select(*keys, F.col("tip").alias("target_tip")), keys, "full"
    )
    same = F.col("source_tip").eqNullSafe(F.col("target_tip"))
    if policy == "source_wins":
        action = F.when(same, "none").when(F.col("source_tip").isNull(), "delete_target").otherwise("force_target")
        final, success = F.col("source_tip"), F.lit(True)
    elif policy == "target_wins":
        action = F.when(same, "none").when(F.col("target_tip").isNull(), "delete_source").otherwise("force_source")
        final, success = F.col("target_tip"), F.lit(True)
    elif policy == "fail_fast":
        action = F.when(same, "none").otherwise("fail")
        final, success = F.when(same, F.col("source_tip")), same
    else:
        action, final, success = F.lit(f"Unknown resolution strategy: {policy}"), F.lit(None).cast("long"), F.lit(False)
    return both.select("*", action.alias("action"), final.alias("final_tip"), success.alias("success"))


def direction_totals(results: DataFrame, key: str = "repo") -> DataFrame:
    """Both directions of a repository as one result: success needs both, counts add up."""
    return results.groupBy(key).agg(
        F.when(F.count_distinct("direction") > 1, "bidirectional").otherwise(F.min("direction")).alias("direction"),
        F.bool_and("success").alias("success"),
        F.sum("commits_synced").alias("commits_synced"),
        F.sum("branches_synced").alias("branches_synced"),
    )


def ref_counts(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct commits and branches per repository.

    The two distincts run on (repo, value) keys, so one large repository is spread over the
    cluster and only the counts come together.
    """
    n_commits = commits.select("repo", "sha").distinct().groupBy("repo").agg(F.count("sha").alias("n_commits"))
    n_branches = refs.select("repo", "branch").distinct().groupBy("repo").agg(F.count("branch").alias("n_branches"))
    zero = F.lit(0).cast("long")
    return n_commits.join(n_branches, "repo", "full").select(
        "repo", F.coalesce("n_commits", zero).alias("n_commits"), F.coalesce("n_branches", zero).alias("n_branches")
    )


def file_set_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and unchanged tracked files, one row per (repo, file)."""
    keys = ["repo", "file"]
    before = old.select(*keys).distinct().withColumn("__old", F.lit(True))
    after = new.select(*keys).distinct().withColumn("__new", F.lit(True))
    status = (
        F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").otherwise("unchanged")
    )
    return before.join(after, keys, "full").select(*keys, status.alias("status"))


def version_audit(
    history: DataFrame, keys: Sequence[str] = ("repo",), order: Sequence[Column | str] = ("ts",), version: str = "version"
) -> DataFrame:
    """Every change of version with the version before it.

    Extension: stated as a requirement, with no implementation to compare with.
    """
    ordered = with_previous(history, keys, _columns(order), {version: "old_version"})
    return ordered.where(F.col("old_version").isNotNull() & (F.col("old_version") != F.col(version)))


def version_rollbacks(
    history: DataFrame, keys: Sequence[str] = ("repo",), order: Sequence[Column | str] = ("ts",), version: str = "version"
) -> DataFrame:
    """Changes that return to a version the same key had earlier.

    A change is a rollback when its version was first seen before it, so one minimum per
    (key, version) decides. Extension, as ``version_audit``.
    """
    keys, order = list(keys), list(order)
    changes = version_audit(history, keys, order, version)
    first = history.groupBy(*keys, version).agg(F.min(F.struct(*order)).alias("__first"))
    later = F.struct(*order) > F.col("__first")
    return changes.join(first, [*keys, version]).where(later).select(*changes.columns)


def _columns(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]
