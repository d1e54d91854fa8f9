"""Ordered work inside groups of any size, by one plan whatever the size.

A window partitioned by a key sorts each key in one task, which fails for a key that holds a third of the table.
Here a large group is cut into slices of its order, and the window is partitioned by (key, slice).

Slices begin at rows that a hash picks, about one in ``SLICE_ROWS``, so that a small group has none. One narrow pass over
keys and order finds them; there are never more than ``MOST_SLICES``, those of the smallest hashes, so they
fit a broadcast whatever the size of the table. A row finds its slice by binary search among its group's. A second
narrow pass, over the groups that have slices, brings one row a slice: what the slices before it contribute. Full rows
are exchanged once, on (key, slice), and never written. Everything is column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: About as many rows begin a new slice of their group.
SLICE_ROWS = 1 << 18
#: Slices of all groups together, at most.
MOST_SLICES = 1 << 18


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null. Key columns of the result are the left ones.

    The right keys get names of their own, so the two sides may stem from the same table.
    """
    own = {key: f"__right_{i}" for i, key in enumerate(keys)}
    renamed = right.withColumnsRenamed(own)
    condition = F.lit(True)
    for key, name in own.items():
        condition = condition & F.col(key).eqNullSafe(F.col(name))
    return left.join(renamed, condition, how).drop(*own.values())


def _starts(narrow: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the places where its slices begin, in order. Groups without any are not listed."""
    picked = narrow.select(*keys, "__place", F.xxhash64(*keys, "__place").alias("__hash"))
    share = (1 << 64) // SLICE_ROWS
    picked = picked.where(F.col("__hash") < F.lit(-(1 << 63) + share)) if SLICE_ROWS > 1 else picked
    few = picked.orderBy("__hash").limit(MOST_SLICES)
    return F.broadcast(few.groupBy(*keys).agg(F.sort_array(F.collect_set("__place")).alias("__starts")))


def _slice() -> Column:
    """How many of its group's slices begin at or before the row's place, by binary search."""
    starts, place = F.col("__starts"), F.col("__place")

    def halve(reach: Column, _: Column) -> Column:
        middle = F.floor((reach["low"] + reach["high"]) / 2).cast("int")
        after = F.get(starts, middle) <= place
        low = F.when((reach["low"] < reach["high"]) & after, middle + 1).otherwise(reach["low"])
        high = F.when((reach["low"] < reach["high"]) & ~after, middle).otherwise(reach["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    whole = F.struct(F.lit(0).alias("low"), F.size(starts).alias("high"))
    turns = F.sequence(F.lit(1), F.lit(MOST_SLICES.bit_length() + 1))
    return F.when(starts.isNull(), 0).otherwise(F.aggregate(turns, whole, halve, lambda reach: reach["low"]))


class _Sliced:
    """Rows with their slice, and the same for the narrow columns of groups that have several."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], backwards: bool):
        # A table that is one group has a key that is the same everywhere, but not to the optimizer.
        single = (F.hash(*order) * 0).alias("__single")
        place = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
        self.keys = list(keys) or ["__single"]
        self.backwards = backwards
        placed = df.select("*", *([] if keys else [single]), place.alias("__place"))
        self.placed = placed
        self.starts = _starts(placed.select(*self.keys, "__place"), self.keys)
        found = join_null_safe(placed, self.starts, self.keys, "left")
        self.rows = found.withColumn("__slice", _slice()).drop("__starts", "__place")
        self.order = [F.col(o) if isinstance(o, str) else o for o in order]

    def window(self):
        """A group's rows of one slice, in order."""
        # Single columns sort faster than a struct of them, and need not travel twice.
        order = [o.desc_nulls_last() if self.backwards else o.asc_nulls_first() for o in self.order]
        return Window.partitionBy(*self.keys, "__slice").orderBy(*order)

    def summaries(self, *values: Column) -> DataFrame:
        """``values`` over the rows of each slice, for the groups that have several."""
        cut = join_null_safe(self.placed, self.starts, self.keys).withColumn("__slice", _slice()).drop("__starts")
        return cut.groupBy(*self.keys, "__slice").agg(*values)

    def along(self):
        """A group's slices, in order."""
        place = F.col("__slice")
        return Window.partitionBy(*self.keys).orderBy(place.desc() if self.backwards else place.asc())

    def with_summaries(self, rows: DataFrame, summaries: DataFrame) -> DataFrame:
        # One row a slice, and a group has at most one slice more than it has starts.
        return join_null_safe(rows, F.broadcast(summaries), [*self.keys, "__slice"], "left")


def order_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "position", backwards: bool = False
) -> DataFrame:
    """Exact 1-based rank of every row inside its group, from the first on or ``backwards`` from the last.

    ``order`` must be a total order; it is ascending, nulls first. Rows equal in all of it are numbered in any order.
    """
    sliced = _Sliced(df, keys, order, backwards)
    earlier = F.sum("__n").over(sliced.along().rowsBetween(Window.unboundedPreceding, -1))
    counts = sliced.summaries(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*sliced.keys, "__slice", F.coalesce(earlier, F.lit(0)).alias("__before"))
    ranked = sliced.rows.withColumn("__nth", F.row_number().over(sliced.window()))
    joined = sliced.with_summaries(ranked, before)
    return joined.select(*df.columns, (F.col("__nth") + F.coalesce("__before", F.lit(0))).cast("bigint").alias(name))


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: dict[str, str], following: bool = False
) -> DataFrame:
    """Attach columns of the preceding, or the ``following``, row of the same group; ``columns`` maps source to new name."""
    sliced = _Sliced(df, keys, order, following)
    last = (F.min_by if following else F.max_by)(F.struct(*columns), "__place")
    ends = sliced.summaries(last.alias("__last"))
    carried = ends.select(*sliced.keys, "__slice", F.lag("__last").over(sliced.along()).alias("__carried"))
    window = sliced.window()
    lagged = [F.lag(c).over(window).alias(f"__lag_{i}") for i, c in enumerate(columns)]
    rows = sliced.rows.select("*", F.row_number().over(window).alias("__nth"), *lagged)
    joined = sliced.with_summaries(rows, carried)
    starts = F.col("__nth") == 1
    values = [F.when(starts, F.col("__carried")[c]).otherwise(F.col(f"__lag_{i}")).alias(n) for i, (c, n) in enumerate(columns.items())]
    return joined.select(*df.columns, *values)
