import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from forgeledger.operators import grouping
from forgeledger.operators.grouping import join_null_safe, order_in_group, with_previous


def skewed(spark):
    """One group with most rows (ties on t included), small ones, and a null key."""
    rng = random.Random(5)
    data = [("hot", rng.randrange(30), i) for i in range(300)]
    data += [(f"k{i % 40}", rng.randrange(9), 1000 + i) for i in range(100)]
    data += [(None, i, 2000 + i) for i in range(20)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, t int, id int")


def test_rank_of_large_groups_equals_window(many_slices, rows):
    df = skewed(many_slices)
    order = [F.col("t"), F.col("id")]
    expected = df.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("long"))
    assert rows(order_in_group(df, ["k"], order)) == rows(expected)
    opposite = Window.partitionBy("k").orderBy(*[o.desc() for o in order])
    expected = df.withColumn("position", F.row_number().over(opposite).cast("long"))
    assert rows(order_in_group(df, ["k"], order, backwards=True)) == rows(expected)


def test_rank_over_the_whole_table(many_slices, rows):
    df = skewed(many_slices)
    expected = df.withColumn("position", F.row_number().over(Window.orderBy("id")).cast("long"))
    assert rows(order_in_group(df, [], [F.col("id")])) == rows(expected)


def test_previous_row_of_large_groups_equals_window(many_slices, rows):
    df = skewed(many_slices)
    order = [F.col("t"), F.col("id")]
    window = Window.partitionBy("k").orderBy(*order)
    expected = df.select("*", F.lag("t").over(window).alias("pt"), F.lag("id").over(window).alias("pid"))
    assert rows(with_previous(df, ["k"], order, {"t": "pt", "id": "pid"})) == rows(expected)
    expected = df.select("*", F.lead("t").over(window).alias("nt"), F.lead("id").over(window).alias("nid"))
    assert rows(with_previous(df, ["k"], order, {"t": "nt", "id": "nid"}, following=True)) == rows(expected)


def test_previous_values_that_are_null_are_not_skipped(many_slices, rows):
    df = many_slices.createDataFrame([("a", i, None if i % 3 else i) for i in range(40)], "k string, i int, v int")
    window = Window.partitionBy("k").orderBy("i")
    expected = df.withColumn("pv", F.lag("v").over(window))
    assert rows(with_previous(df, ["k"], [F.col("i")], {"v": "pv"})) == rows(expected)


def test_null_safe_join(spark, rows):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    assert rows(join_null_safe(left, left.select("k"), ["k"])) == [("a", 2), (None, 1)]


def test_odd_groups(many_slices, rows):
    data = [(x, i) for i, x in enumerate([float("nan"), None, 0.5, float("nan"), None])]
    df = many_slices.createDataFrame(data, "k double, i int")
    assert sorted((r.i, r.position) for r in order_in_group(df, ["k"], [F.col("i")]).collect()) == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)]
    none = df.where("i < 0")
    assert rows(order_in_group(none, ["k"], [F.col("i")])) == [] and rows(with_previous(none, ["k"], [F.col("i")], {"i": "p"})) == []
    one = many_slices.range(50).withColumn("k", F.lit(1))
    following = with_previous(one, [], [F.col("id")], {"id": "p"}, following=True)
    assert {r.id: r.p for r in following.collect()} == {i: i + 1 if i < 49 else None for i in range(50)}


def slices_of(df, key):
    return {r[0] for r in grouping._Sliced(df, ["k"], ["t", "id"], False).rows.where(F.col("k") == key).select("__slice").distinct().collect()}


def test_a_large_group_is_cut_and_rows_move_once(many_slices):
    df = skewed(many_slices)
    sliced = grouping._Sliced(df, ["k"], ["t", "id"], False)
    assert len(slices_of(df, "hot")) > 3
    sizes = [r[0] for r in sliced.rows.groupBy("k", "__slice").count().select("count").collect()]
    assert max(sizes) < 150
    frame = order_in_group(df, ["k"], ["t", "id"])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    # One exchange of full rows, on key and slice; all else is broadcast or one row a slice.
    assert "Python" not in plan and "rangepartitioning(k" not in plan and "SortMergeJoin" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_slices_are_bounded_in_number(many_slices, monkeypatch, rows):
    monkeypatch.setattr(grouping, "MOST_SLICES", 4)
    df = skewed(many_slices)
    assert 2 <= len(slices_of(df, "hot")) <= 5
    expected = df.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).cast("long"))
    assert rows(order_in_group(df, ["k"], ["t", "id"])) == rows(expected)


@pytest.mark.parametrize("slice_rows", [1, 2, 50, 1 << 18])
def test_any_size_of_slices_gives_the_same(spark, monkeypatch, rows, slice_rows):
    monkeypatch.setattr(grouping, "SLICE_ROWS", slice_rows)
    df = skewed(spark)
    window = Window.partitionBy("k").orderBy("t", "id")
    expected = df.select("*", F.row_number().over(window).cast("long").alias("position"))
    assert rows(order_in_group(df, ["k"], ["t", "id"])) == rows(expected)
    expected = df.select("*", F.lag("t").over(window).alias("p"), F.lag("id").over(window).alias("q"))
    assert rows(with_previous(df, ["k"], ["t", "id"], {"t": "p", "id": "q"})) == rows(expected)


def test_arrays_texts_and_ties_as_order(many_slices, rows):
    data = [("k", p, i % 3) for i, p in enumerate(["a/b", "a-b", "a", "", None, "a/b/c", "é", "a/b"] * 12)]
    df = many_slices.createDataFrame(data, "k string, p string, n int").withColumn("id", F.monotonically_increasing_id())
    df = many_slices.createDataFrame(df.collect(), df.schema)
    order = [F.split("p", "/"), F.col("n"), F.col("id")]
    expected = df.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("long"))
    assert rows(order_in_group(df, ["k"], order)) == rows(expected)
    # Rows that are equal in the whole order are numbered in some order, each number once.
    ties = order_in_group(df, ["k"], ["n"])
    assert sorted(r.position for r in ties.collect()) == list(range(1, 97))
