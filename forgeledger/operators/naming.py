"""Mapping nested paths to flat names, and the migration plan built on it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .selection import with_longest_prefix


def map_names(
    df: DataFrame,
    strategy: str = "flatten",
    separator: str = "-",
    strip_root: bool = False,
    keep_last: int | None = None,
    custom: DataFrame | Mapping[str, str] | None = None,
    fallback: str = "flatten",
    path_col: str = "path",
    name: str = "target_name",
) -> DataFrame:
    """Add the target name of every path.

    ``custom`` holds (prefix, value) entries: an exact entry or the longest covering prefix
    decides, and paths without one use the ``fallback`` strategy.
    """
    path = F.col(path_col)
    if strategy != "custom":
        return df.withColumn(name, P.base_name(path, strategy, separator, strip_root, keep_last))
    if fallback == "custom":
        raise ValueError("the fallback of the custom strategy must be another strategy")
    other = P.base_name(path, fallback, separator, strip_root, keep_last)
    mapped = with_longest_prefix(df, custom if custom is not None else {}, path_col)
    chosen = P.replaced_prefix(path, F.col("hit.prefix"), F.col("hit.value"), separator)
    return mapped.select(*df.columns, F.when(F.col("hit").isNull(), other).otherwise(chosen).alias(name))


def topic_counts(df: DataFrame, strip_root: bool = False, path_col: str = "path") -> DataFrame:
    topics = df.select(F.explode(P.path_topics(F.col(path_col), strip_root)).alias("topic"))
    return topics.groupBy("topic").agg(F.count(F.lit(1)).alias("n_projects"))


def name_validity(df: DataFrame, name_col: str = "target_name") -> DataFrame:
    error = P.name_error(F.col(name_col))
    return df.select("*", error.isNull().alias("valid"), error.alias("error"))


def name_conflicts(df: DataFrame, name_col: str = "target_name", path_col: str = "path") -> DataFrame:
    """One row per (name, path) of every name that two or more paths map to, with their number.

    Rows instead of a list per name: a name shared by a third of the estate must not end up
    in one array. Names are counted before the shuffle; the join brings the paths back.
    """
    shared = (
        df.groupBy(name_col).agg(F.count(F.lit(1)).alias("n_paths")).where("n_paths > 1")
    )
    return df.select(name_col, path_col).join(shared, name_col).select(name_col, path_col, "n_paths")


def map_normalised(df: DataFrame, separator: str = "-", path_col: str = "path") -> DataFrame:
    """Flat name of the cleaned path; see ``blank_paths`` for the rows this leaves out."""
    path = F.col(path_col)
    name = F.replace(P.normalised_path(path), F.lit("/"), F.lit(separator))
    return df.where(~P.is_blank_path(path)).withColumn("target_name", name)


def map_labelled(df: DataFrame, label: str | None, separator: str = "-", path_col: str = "path") -> DataFrame:
    """Last part of the cleaned path with a fixed label in front."""
    path = F.col(path_col)
    name = P.last_part(P.normalised_path(path))
    if label:
        name = F.concat(F.lit(label + separator), name)
    return df.where(~P.is_blank_path(path)).withColumn("target_name", name)


def blank_paths(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows that have no usable path, with the reason."""
    path = F.col(path_col)
    reason = F.when(path.isNull(), "path is null").otherwise("path is empty")
    return df.where(P.is_blank_path(path)).withColumn("reject_reason", reason)


def target_settings(details: DataFrame, path_col: str = "path") -> DataFrame:
    """Settings of the target repository. Targets know public and private only."""
    return details.select(
        "id",
        P.last_part(F.col(path_col)).alias("name"),
        "description",
        "topics",
        F.coalesce(F.col("visibility").isin("private", "internal"), F.lit(False)).alias("private"),
        "default_branch",
    )


def missing_targets(plan: DataFrame, catalogue: DataFrame, name_col: str = "full_name") -> DataFrame:
    return plan.join(catalogue.select(name_col), name_col, "left_anti")


def present_targets(plan: DataFrame, catalogue: DataFrame, name_col: str = "full_name") -> DataFrame:
    return plan.join(catalogue.select(name_col), name_col, "left_semi")


def migration_plan(
    projects: DataFrame,
    catalogue: DataFrame,
    details: DataFrame,
    org: str,
    base_url: str,
    topics_strip_root: bool = False,
    **mapping,
) -> DataFrame:
    """The dry-run plan of a whole estate: one row per project.

    Names that break a rule keep their row with ``valid = false`` and an error. ``projects``
    needs id, path and web_url (an http_url is preferred where a listing has one);
    ``catalogue`` is the targets' full_name column; ``details`` is keyed by id. Conflicts do
    not block a migration; they are counted per row.
    """
    named = name_validity(map_names(projects, **mapping))
    full_name = F.concat(F.lit(org + "/"), F.col("target_name"))
    rows = named.select(
        "id",
        "path",
        F.coalesce(*[c for c in ("http_url", "web_url") if c in projects.columns], F.lit("")).alias("source_url"),
        "target_name",
        "valid",
        "error",
        F.when(F.col("valid"), full_name).alias("full_name"),
        F.when(F.col("valid"), F.concat(F.lit(base_url + "/"), full_name, F.lit(".git"))).alias("target_url"),
        P.path_topics(F.col("path"), topics_strip_root).alias("path_topics"),
    )
    clashes = (
        rows.where("valid").groupBy("target_name").agg(F.count(F.lit(1)).alias("n_same_name")).where("n_same_name > 1")
    )
    within = catalogue.where(F.startswith(F.col("full_name"), F.lit(org + "/")))
    known = within.select(F.substr("full_name", F.lit(len(org) + 2)).alias("target_name"), F.lit(True).alias("__exists"))
    # Both facts about a name come as one table, so the plan's rows move once for them.
    about_name = clashes.join(known.distinct(), "target_name", "full")
    info = details.withColumn("__found", F.lit(True))
    joined = rows.join(about_name, "target_name", "left").join(info, "id", "left")
    found = F.col("__found").isNotNull() & F.col("valid")
    return joined.select(
        *rows.columns,
        F.when(F.col("valid"), F.coalesce("n_same_name", F.lit(1))).cast("long").alias("n_same_name"),
        F.when(F.col("valid"), F.coalesce("__exists", F.lit(False))).alias("target_exists"),
        F.when(found, F.coalesce("description", F.lit(""))).alias("description"),
        F.when(found, F.coalesce("visibility", F.lit("private"))).alias("visibility"),
        F.when(found, F.coalesce("default_branch", F.lit("main"))).alias("default_branch"),
    )


def plan_summary(plan: DataFrame) -> DataFrame:
    """One row of counters.

    ``created``, ``sync_success`` and ``sync_error`` are outcome columns; a dry-run plan has
    none of them and counts zero. A failed creation leaves an error and no sync outcome, so
    it counts as neither synced nor failed.
    """
    columns = set(plan.columns)
    created = F.count_if(F.col("created")) if "created" in columns else F.lit(0).cast("long")
    if "sync_success" in columns:
        synced = F.count_if(F.col("sync_success"))
        failed = F.count_if(~F.col("sync_success"))
    else:
        synced = failed = F.lit(0).cast("long")
    # Distinct conflicting names without a distinct: the k rows of one name count 1/k each,
    # which is exact when rows are grouped by k first.
    by_size = plan.groupBy("valid", "n_same_name").agg(
        F.count(F.lit(1)).alias("n"), created.alias("created"), synced.alias("synced"), failed.alias("failed")
    )
    conflicts = F.when(F.col("valid") & (F.col("n_same_name") > 1), F.col("n") / F.col("n_same_name"))
    return by_size.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_repos"),
        F.coalesce(F.sum(F.when(F.col("valid"), F.col("n"))), F.lit(0)).alias("mapped_repos"),
        F.coalesce(F.sum(F.when(~F.col("valid"), F.col("n"))), F.lit(0)).alias("skipped_repos"),
        F.coalesce(F.sum(conflicts), F.lit(0)).cast("long").alias("conflicting_names"),
        F.coalesce(F.sum("created"), F.lit(0)).alias("created_repos"),
        F.coalesce(F.sum("synced"), F.lit(0)).alias("synced_repos"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_repos"),
    )
