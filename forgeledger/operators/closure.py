"""Transitive closure of dependencies, breadth first."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.versions import satisfies
from ..session import durable, durable_counted
from .deps import requirement_edges

# A level is sent to every task, instead of exchanging all edges, while its places take no more than eight times as many bytes.
SENT_NUMBERS = 1 << 20

_SCHEMA = "package STRING, level BIGINT, requested_as STRING, version_spec STRING, status STRING, version STRING, place BINARY"


def resolve(roots: DataFrame, packages: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Every package reachable from ``roots(name, version_spec, ordinal)``, once.

    ``packages(name, version, requires)`` holds the latest version of every package; its
    requirements may come instead as ``edges(package, edge_no, name, version_spec)``. The requirement to reach a package decides: the one that a queue, filled in the order
    of the roots and of each package's list, would take first. That place is carried along as
    the path of list positions, which sorts like the queue within one level.

    ``status`` is resolved, conflict (the latest version fails the requirement) or missing
    (no such package). Only resolved packages are followed further.

    Tables on disk are many times smaller than in the driver's memory, so no join may be a broadcast because of a
    table's size; only levels of a few rows, which are counted, are sent.
    """
    edges = durable(requirement_edges(packages) if edges is None else edges, "edges")
    # Read at every level, so made once.
    latest = durable(packages.select(F.lower("name").alias("package"), "version"), "latest")
    place = F.to_binary(F.lpad(F.hex(F.col("ordinal").cast("long")), 16, "0"), F.lit("hex"))
    reached = roots.select(
        F.lower("name").alias("package"), F.col("name").alias("requested_as"), "version_spec", place.alias("place")
    )
    visited = None
    level = 0
    while True:
        first = reached.groupBy("package").agg(
            F.min_by(F.struct("requested_as", "version_spec", "place"), "place").alias("first")
        )
        if visited is not None:
            first = first.join(visited.select("package").hint("merge"), "package", "left_anti")
        offered = first.join(latest.hint("merge"), "package", "left")
        ok = satisfies("version", F.coalesce("first.version_spec", F.lit("")))
        frontier = offered.select(
            "package",
            F.lit(level).cast("long").alias("level"),
            "first.requested_as",
            "first.version_spec",
            F.when(F.col("version").isNull(), "missing").when(ok, "resolved").otherwise("conflict").alias("status"),
            "version",
            "first.place",
        )
        frontier, found = durable_counted(frontier, F.lit(True), "frontier")
        if not found:
            break
        visited = frontier if visited is None else visited.unionByName(frontier)
        if level % 8 == 7:
            visited = durable(visited, "visited")
        step = F.to_binary(F.lpad(F.hex(F.col("edge_no").cast("long")), 16, "0"), F.lit("hex"))
        # Each package is in the frontier once; a hot package's edges are split by adaptive
        # execution, and the group above combines copies of a hot dependency before shuffling.
        sent = found * (level + 8) <= SENT_NUMBERS
        reached = (
            frontier.where("status = 'resolved'")
            .select("package", "place")
            .hint("broadcast" if sent else "merge")
            .join(edges, "package")
            .select(
                F.lower("name").alias("package"),
                F.col("name").alias("requested_as"),
                edges["version_spec"],
                F.concat("place", step).alias("place"),
            )
        )
        level += 1
    if visited is None:
        return roots.sparkSession.createDataFrame([], _SCHEMA)
    return visited


def closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(package, level) reachable from ``roots(package)`` over ``edges(package, needs)``."""
    frontier = roots.select("package").distinct()
    visited = None
    for level in itertools.count():
        if visited is not None:
            frontier = frontier.join(visited.select("package"), "package", "left_anti")
        marked, found = durable_counted(frontier.withColumn("level", F.lit(level).cast("long")), F.lit(True), "frontier")
        if not found:
            return marked if visited is None else visited
        visited = marked if visited is None else visited.unionByName(marked)
        if level % 8 == 7:
            visited = durable(visited, "visited")
        frontier = marked.join(edges, "package").select(F.col("needs").alias("package")).distinct()
