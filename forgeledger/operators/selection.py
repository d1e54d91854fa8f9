"""Scanning the estate: which projects are in scope and under which settings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

#: Lengths of the pieces by which globs are indexed.
_PIECES = (1, 2, 4, 8, 16)

def subtree(projects: DataFrame, group: str, direct_only: bool = False, path_col: str = "path") -> DataFrame:
    """Projects below a group: at any depth, or its direct children only."""
    path = F.col(path_col)
    found = projects.where(F.startswith(path, F.lit(group + "/")))
    if direct_only:
        found = found.where(F.size(P.parts(path)) == len(group.split("/")) + 1)
    return found


def project_details(projects: DataFrame, details: DataFrame) -> DataFrame:
    """Attach details by id. Projects without details stay, and missing members get defaults."""
    known = details.withColumn("__found", F.lit(True))
    joined = projects.join(known, "id", "left")
    found = F.col("__found").isNotNull()
    return joined.select(
        *[projects[c] for c in projects.columns],
        F.coalesce("__found", F.lit(False)).alias("has_details"),
        F.when(found, F.coalesce("description", F.lit(""))).alias("description"),
        F.when(found, F.coalesce("topics", F.array().cast("array<string>"))).alias("topics"),
        F.when(found, F.coalesce("visibility", F.lit("private"))).alias("visibility"),
        F.when(found, F.coalesce("default_branch", F.lit("main"))).alias("default_branch"),
    )


def exclude_filter(
    df: DataFrame, column: str, globs: Iterable[str] = (), exact: DataFrame | None = None
) -> DataFrame:
    """Drop rows whose value matches an exclude entry.

    Entries come from configuration as exact names or ``*`` globs and become one predicate.
    ``exact`` is a table of further exact values in a column of the same name, of any size.
    """
    kept = df.where(~P.matches_any(F.col(column), globs))
    if exact is not None:
        kept = kept.join(exact.select(column), column, "left_anti")
    return kept


def exclude_by_group(df: DataFrame, entries: DataFrame, column: str = "path", group: str = "group_name") -> DataFrame:
    """Drop rows whose value matches an exclude entry of their own group.

    ``entries`` has (``group``, ``entry``), exact names or ``*`` globs, and may be of any size: names are joined by
    equality on both columns, globs by a piece that a matching value must hold. Null groups, values and entries match
    nothing.
    """
    own = entries.select(F.col(group).alias("__group"), F.col("entry").alias("__value"))
    is_glob = F.contains("__value", F.lit("*"))
    values = df.select(F.col(group).alias("__group"), F.col(column).alias("__value")).dropna().distinct()
    found = own.where(~is_glob).unionAll(_glob_matches(values, own.where(is_glob))).distinct()
    return df.join(found, (F.col(group) == F.col("__group")) & (F.col(column) == F.col("__value")), "left_anti")


def _glob_matches(values: DataFrame, globs: DataFrame) -> DataFrame:
    """The ``__group, __value`` rows of ``values`` that a glob of their group matches.

    A glob is indexed by the beginning of its longest literal part, cut to a length of ``_PIECES``, so that a value has few
    pieces to look up. Values and globs meet where group and piece are equal, never all of a group, and ``like`` confirms.
    """
    longest = F.array_max(F.transform(F.split("__value", r"\*"), lambda part: F.struct(F.length(part).alias("n"), part.alias("text"))))
    size = F.lit(0)
    for n in _PIECES:
        size = F.when(longest["n"] >= n, n).otherwise(size)
    # In a pattern only the glob's stars stand for other text.
    pattern = F.replace(F.regexp_replace("__value", r"([\\%_])", r"\\$1"), F.lit("*"), F.lit("%"))
    indexed = globs.where("__group is not null").select("__group", pattern.alias("__pattern"), size.alias("__size"), F.substring(longest["text"], F.lit(1), size).alias("__piece"))
    # A group uses at most as many sizes as there are.
    sizes = indexed.groupBy("__group").agg(F.collect_set("__size").alias("__sizes"))

    def pieces(n: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("__value") - n + 1, F.lit(1)))
        cut = F.transform(F.when(n == 0, F.array(F.lit(1))).otherwise(starts), lambda at: F.substring(F.col("__value"), at, n))
        return F.array_distinct(cut)

    held = values.join(sizes, "__group").select("__group", "__value", F.explode(F.array_distinct(F.flatten(F.transform("__sizes", pieces)))).alias("__piece"))
    met = held.join(indexed, ["__group", "__piece"]).where(F.like(F.col("__value"), F.col("__pattern")))
    return met.select("__group", "__value")


def config_overrides(
    df: DataFrame, overrides: DataFrame, keys: Sequence[str], defaults: Mapping[str, object]
) -> DataFrame:
    """Effective settings per row: the override where one is set, else the global default.

    Extension: stated as a requirement, with no implementation to compare with.
    """
    keys = list(keys)
    joined = df.join(overrides.select(*keys, *defaults), keys, "left")
    settings = [F.coalesce(F.col(name), F.lit(value)).alias(name) for name, value in defaults.items()]
    return joined.select(*[F.col(c) for c in df.columns], *settings)


def longest_prefix(paths: DataFrame, mapping: DataFrame, path_col: str = "path") -> DataFrame:
    """One row per distinct path: the longest ``prefix`` entry covering it, with its ``value``.

    Each path is turned into its ancestors and joined by equality, so no side has to fit in
    memory. The maximum over the ancestors of one path is taken before the shuffle.
    """
    ancestors = paths.select(path_col).distinct().select(
        path_col, F.explode(P.ancestor_paths(F.col(path_col))).alias("prefix")
    )
    hits = ancestors.join(mapping.select("prefix", "value"), "prefix")
    return hits.groupBy(path_col).agg(
        F.max_by(F.struct("prefix", "value"), F.length("prefix")).alias("hit")
    )


def with_longest_prefix(df: DataFrame, mapping: DataFrame | Mapping[str, str], path_col: str = "path") -> DataFrame:
    """``df`` plus ``hit`` = struct(prefix, value), null where nothing covers the path.

    A ``dict`` is part of the plan, whatever its size, and needs no shuffle; a table is joined.
    """
    if isinstance(mapping, Mapping):
        return df.withColumn("hit", P.literal_lookup(F.col(path_col), mapping))
    return df.join(longest_prefix(df, mapping, path_col), path_col, "left").select(*df.columns, "hit")


def org_routing(
    projects: DataFrame, mapping: DataFrame | Mapping[str, str], default_org: str, path_col: str = "path"
) -> DataFrame:
    """Target organisation per project: longest matching group, else the default."""
    routed = with_longest_prefix(projects, mapping, path_col)
    return routed.select(*projects.columns, F.coalesce(F.col("hit.value"), F.lit(default_org)).alias("target_org"))


def platform_counts(remotes: DataFrame, url_col: str = "url") -> DataFrame:
    return remotes.groupBy(P.platform(F.col(url_col)).alias("platform")).agg(F.count(F.lit(1)).alias("n_urls"))
