"""Connected components of links between ids, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, durable_counted


def _towards(edges: DataFrame, larger: bool) -> DataFrame:
    """Join each id's larger (or smaller) neighbours to the smallest id of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = both if larger else edges
    least = near.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
    # Joining the smallest neighbours to written rows lets Spark split an id with very many links.
    joined = near.join(least, "src")
    if larger:
        out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    else:
        out = joined.select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionAll(
            least.select("src", F.col("least").alias("dst"))
        )
    return out.where("src <> dst").distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, component_id`` of every id that has a link, the component being its smallest id.

    ``links`` has two bigint columns. Every round sends the larger neighbours of each id to its
    smallest one and then the smaller ones likewise, each as a written table; the number of rounds
    grows with the logarithm of the longest path. It ends when every id is tied to one smaller id
    that is tied to none.
    """
    a, b = links.columns
    edges = durable(
        links.select(F.greatest(a, b).cast("bigint").alias("src"), F.least(a, b).cast("bigint").alias("dst"))
        .where("src <> dst").distinct(),
        "links",
    )
    while True:
        roots = edges.groupBy("src").agg(F.min("dst").alias("component_id"), F.count(F.lit(1)).alias("n"))
        checked, open_ids = durable_counted(
            roots.join(edges.select(F.col("src").alias("inner")).distinct(), F.col("component_id") == F.col("inner"), "left"),
            F.col("inner").isNotNull() | (F.col("n") > 1),
            "stars",
        )
        if not open_ids:
            ids = checked.select(F.col("src").alias("id"), "component_id")
            return ids.unionAll(ids.select(F.col("component_id").alias("id"), "component_id").distinct())
        edges = durable(_towards(durable(_towards(edges, True), "large-star"), False), "small-star")
