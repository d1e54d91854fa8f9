"""Column functions on project paths, repository names and remote URLs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .requirements import WHITESPACE

STRATEGIES = ("flatten", "prefix", "full_path", "custom")

# Rule texts of the name check, in the order in which the rules apply.
NAME_MAX_LENGTH = 100
ERR_LENGTH = "Name exceeds 100 characters: "
ERR_DOTS = "Name cannot be '.' or '..'"
ERR_GIT_SUFFIX = "Name cannot end with .git"
ERR_LEADING = "Name cannot start with hyphen, underscore, or period"
ERR_CHARACTERS = "Name contains invalid characters (only alphanumeric, -, _, . allowed)"


def parts(path: Column) -> Column:
    return F.split(path, "/")


def last_part(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def _last_n(items: Column, n: int) -> Column:
    """The last ``n`` items, or all of them when there are fewer."""
    return F.slice(items, F.greatest(F.size(items) - n, F.lit(0)) + 1, F.lit(n))


def _without_root(items: Column) -> Column:
    return F.when(F.size(items) > 1, F.slice(items, F.lit(2), F.size(items))).otherwise(items)


def _levels(keep_last: int | None) -> int | None:
    if keep_last is not None and keep_last < 0:
        raise ValueError("keep_last must not be negative")
    return keep_last or None


def flatten_name(path: Column, separator: str = "-", strip_root: bool = False, keep_last: int | None = None) -> Column:
    items = _without_root(parts(path)) if strip_root else parts(path)
    if _levels(keep_last):
        items = _last_n(items, keep_last)
    return F.array_join(items, separator)


def short_name(path: Column, separator: str = "-", keep_last: int | None = None) -> Column:
    if _levels(keep_last) is None:
        return last_part(path)
    return F.array_join(_last_n(parts(path), keep_last), separator)


def full_path_name(path: Column, separator: str = "_") -> Column:
    return F.replace(path, F.lit("/"), F.lit(separator))


def base_name(path: Column, strategy: str, separator: str, strip_root: bool, keep_last: int | None) -> Column:
    """A name by one of the strategies that need no mapping table."""
    if strategy == "flatten":
        return flatten_name(path, separator, strip_root, keep_last)
    if strategy == "prefix":
        return short_name(path, separator, keep_last)
    if strategy == "full_path":
        return full_path_name(path, separator)
    raise ValueError(f"unknown mapping strategy: {strategy}")


def ancestor_paths(path: Column) -> Column:
    """Every ancestor of a path and the path itself, shortest first."""
    items = parts(path)
    return F.transform(
        F.sequence(F.lit(1), F.size(items)), lambda i: F.array_join(F.slice(items, F.lit(1), i), "/")
    )


def replaced_prefix(path: Column, prefix: Column, replacement: Column, separator: str) -> Column:
    """The name for a path mapped by an exact entry or by a prefix entry."""
    rest = F.substr(path, F.length(prefix) + 2)
    return F.when(path == prefix, replacement).otherwise(
        F.concat(replacement, F.lit(separator), F.replace(rest, F.lit("/"), F.lit(separator)))
    )


def literal_lookup(path: Column, mapping: Mapping[str, str]) -> Column:
    """struct(prefix, value) of the longest entry covering the path, or null.

    The entries become two sorted arrays, one literal each, in which every ancestor is looked up by binary search.
    """
    names = sorted(mapping)  # code points sort like the bytes that Spark compares
    prefixes = F.from_json(F.lit(json.dumps(names)), "array<string>")
    values = F.from_json(F.lit(json.dumps([mapping[n] for n in names])), "array<string>")
    turns = F.sequence(F.lit(1), F.lit(len(names).bit_length()))

    def place(ancestor: Column) -> Column:
        def halve(reach: Column, _: Column) -> Column:
            middle = F.floor((reach["low"] + reach["high"]) / 2).cast("int")
            open_ = reach["low"] < reach["high"]
            before = F.get(prefixes, middle) < ancestor
            low = F.when(open_ & before, middle + 1).otherwise(reach["low"])
            high = F.when(open_ & ~before, middle).otherwise(reach["high"])
            return F.struct(low.alias("low"), high.alias("high"))

        whole = F.struct(F.lit(0).alias("low"), F.lit(len(names)).alias("high"))
        return F.aggregate(turns, whole, halve, lambda reach: reach["low"])

    found = F.transform(ancestor_paths(path), lambda p: F.struct(p.alias("prefix"), place(p).alias("at")))
    best = F.try_element_at(F.filter(found, lambda x: F.get(prefixes, x["at"]) == x["prefix"]), F.lit(-1))
    return F.when(best.isNotNull(), F.struct(best["prefix"].alias("prefix"), F.get(values, best["at"]).alias("value")))


def path_topics(path: Column, strip_root: bool = False) -> Column:
    items = parts(path)
    parents = F.slice(items, F.lit(1), F.size(items) - 1)
    if strip_root:
        parents = _without_root(parents)
    return F.transform(parents, lambda p: F.lower(p))


def name_error(name: Column) -> Column:
    """Text of the first broken naming rule, or null for a usable name."""
    return (
        F.when(F.length(name) > NAME_MAX_LENGTH, F.concat(F.lit(ERR_LENGTH), F.length(name).cast("string")))
        .when(name.isin(".", ".."), F.lit(ERR_DOTS))
        .when(F.endswith(name, F.lit(".git")), F.lit(ERR_GIT_SUFFIX))
        .when(name.rlike(r"^[-_.]"), F.lit(ERR_LEADING))
        .when(~name.rlike(r"^[a-zA-Z0-9._-]+$"), F.lit(ERR_CHARACTERS))
    )


def is_blank_path(path: Column) -> Column:
    return path.isNull() | (F.trim(path, F.lit(WHITESPACE)) == "")


def normalised_path(path: Column) -> Column:
    """No slashes at either end and no doubled slashes inside."""
    return F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), r"/+", "/")


def glob_regex(glob: str) -> str:
    """A ``*`` glob as an anchored regular expression."""
    return "^(?s:" + ".*".join(re.escape(piece) for piece in glob.split("*")) + r")\z"


def matches_any(value: Column, globs: Iterable[str]) -> Column:
    """True where the value equals an entry or matches one of the ``*`` globs."""
    globs = list(globs)
    exact = [g for g in globs if "*" not in g]
    wild = [glob_regex(g) for g in globs if "*" in g]
    hit = value.isin(exact) if exact else F.lit(False)
    if wild:
        hit = hit | value.rlike("|".join(wild))
    return F.coalesce(hit, F.lit(False))


def url_authority(url: Column) -> Column:
    """Everything between ``//`` and the path, in lower case: user info and port included."""
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def platform(url: Column) -> Column:
    """github, gitlab, ssh (scp-like addresses carry no URL authority) or unsupported."""
    host = url_authority(url)
    return (
        F.when(F.startswith(url, F.lit("git@")), "ssh")
        .when((host == "github.com") | F.endswith(host, F.lit(".github.com")), "github")
        .when(F.contains(host, F.lit("gitlab")), "gitlab")
        .otherwise("unsupported")
    )
