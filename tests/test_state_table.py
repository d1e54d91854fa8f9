"""Copy-on-write state and doubling update folders: what a batch rewrites, replay, lost writers, expiry."""

import random

import pytest
from pyspark.sql import functions as F

from forgeledger.operators.changes import latest_state
from forgeledger.sources.manifests import Ledger
from forgeledger.sources.state_table import StateTable
from forgeledger.sources.updates import UpdateTable

SCHEMA = "repo string, ts int, seq int, head string"


def writes(draw, n, repos):
    return [(f"r{draw.randrange(repos)}" if draw.random() < 0.98 else None, draw.randrange(50), i, f"h{draw.random():.5f}") for i in range(n)]


def test_batches_equal_the_last_write(spark, tmp_path, rows):
    draw = random.Random(4)
    table = StateTable(spark, str(tmp_path / "t"), SCHEMA, buckets=7)
    assert table.read().count() == 0 and table.versions() == []
    every = []
    for batch in range(5):
        # Sequence numbers make the order total over all batches.
        new = [(r, t, 1000 * batch + s, h) for r, t, s, h in writes(draw, 60, 40)]
        every += new
        assert table.merge(spark.createDataFrame(new, SCHEMA), batch)
        assert rows(table.read()) == rows(latest_state(spark.createDataFrame(every, SCHEMA)))
    assert table.versions() == [0, 1, 2, 3, 4]


def folders(table):
    return table.ledger.current()["folders"]


def test_untouched_buckets_are_kept_as_they_are(spark, tmp_path, rows):
    table = StateTable(spark, str(tmp_path / "t"), SCHEMA, buckets=16)
    table.merge(spark.createDataFrame([(f"r{i}", 1, 1, "a") for i in range(200)], SCHEMA), 0)
    before = folders(table)
    assert len(before) == 16
    table.merge(spark.createDataFrame([("r3", 2, 1, "b"), ("r3", 3, 1, "c")], SCHEMA), 1)
    after = folders(table)
    changed = [b for b in after if after[b] != before[b]]
    assert len(changed) == 1
    # The second batch wrote one folder with one bucket, and nothing else.
    own = after[changed[0]].rsplit("/", 1)[0]
    assert table.ledger.children(own).count(f"__bucket={changed[0]}") == 1
    assert [x for x in table.ledger.children(own) if "=" in x] == [f"__bucket={changed[0]}"]
    assert rows(table.read().where("repo = 'r3'")) == [("r3", 3, 1, "c")] and table.read().count() == 200
    assert rows(table.read(0).where("repo = 'r3'")) == [("r3", 1, 1, "a")]


def test_replay_and_late_writes(spark, tmp_path, rows):
    table = StateTable(spark, str(tmp_path / "t"), SCHEMA)
    table.merge(spark.createDataFrame([("a", 5, 1, "x")], SCHEMA), 3)
    assert not table.merge(spark.createDataFrame([("a", 9, 1, "again")], SCHEMA), 3)
    assert not table.merge(spark.createDataFrame([("a", 9, 1, "older batch")], SCHEMA), 2)
    table.merge(spark.createDataFrame([("a", 4, 1, "late"), ("b", 1, 1, "y")], SCHEMA), 4)
    assert rows(table.read()) == [("a", 5, 1, "x"), ("b", 1, 1, "y")]


@pytest.mark.parametrize("lost_at", ["prepare", "publish"])
def test_a_writer_lost_before_the_pointer_changes_nothing(spark, tmp_path, rows, monkeypatch, lost_at):
    table = StateTable(spark, str(tmp_path / "t"), SCHEMA, buckets=3)
    table.merge(spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "x")], SCHEMA), 0)
    before = rows(table.read())
    batch = spark.createDataFrame([("a", 2, 1, "y"), ("c", 1, 1, "z")], SCHEMA)

    def lost(*_):
        raise OSError("the writer is gone")

    with monkeypatch.context() as patch:
        patch.setattr(Ledger, lost_at, lost)
        with pytest.raises(OSError):
            table.merge(batch, 1)
    again = StateTable(spark, str(tmp_path / "t"), SCHEMA, buckets=99)
    assert rows(again.read()) == before and again.versions() == [0] and again.buckets == 3
    # The batch comes again and goes through; what the lost writer left is removed with old versions.
    assert again.merge(batch, 1)
    assert rows(again.read()) == [("a", 2, 1, "y"), ("b", 1, 1, "x"), ("c", 1, 1, "z")]
    assert again.expire(2) == 1 and again.versions() == [0, 1] and rows(again.read(0)) == before


def test_old_versions_expire(spark, tmp_path, rows):
    table = StateTable(spark, str(tmp_path / "t"), SCHEMA, buckets=4)
    for i in range(6):
        table.merge(spark.createDataFrame([(f"r{i % 3}", i, 1, f"h{i}"), (f"s{i}", 1, 1, "s")], SCHEMA), i)
    state = rows(table.read())
    assert table.expire(2) > 0 and table.versions() == [4, 5]
    assert rows(table.read()) == state and table.read(4).count() == 3 + 5
    with pytest.raises(ValueError):
        table.read(1)
    with pytest.raises(ValueError):
        table.expire(0)
    named = set(folders(table).values()) | set(table.ledger.kept()[1]["folders"].values())
    on_disk = {f"data/{d}/{b}" for d in table.ledger.children("data") for b in table.ledger.children(f"data/{d}") if "=" in b}
    assert on_disk == named


def test_lookup_reads_the_buckets_of_the_keys(spark, tmp_path, rows):
    table = StateTable(spark, str(tmp_path / "t"), SCHEMA, buckets=32)
    table.merge(spark.createDataFrame([(f"r{i}", 1, i, "a") for i in range(300)], SCHEMA), 0)
    found = table.lookup(spark.createDataFrame([("r7",), ("none",)], "repo string"))
    assert rows(found) == [("r7", 1, 7, "a")]
    assert len(found.inputFiles()) <= 2


def test_updates_open_one_folder_a_level(spark, tmp_path, rows):
    table, state = UpdateTable(spark, str(tmp_path / "u"), "k int, v int", ["k"]), {}
    assert table.read().count() == 0
    draw = random.Random(1)
    for batch in range(37):
        new = {draw.randrange(9): draw.randrange(1000) for _ in range(3)}
        state |= new
        assert table.add(spark.createDataFrame(list(new.items()), "k int, v int"), batch)
        assert len(table.folders()) == bin(batch + 1).count("1")
    assert not table.add(spark.createDataFrame([(1, -1)], "k int, v int"), 36)
    assert rows(table.read()) == sorted(state.items(), key=repr)
    assert table.expire(1) > 0 and rows(table.read()) == sorted(state.items(), key=repr)
    assert {f"data/{d}" for d in table.ledger.children("data")} == set(table.folders())


def test_a_thousand_batches_open_few_folders(spark, tmp_path, monkeypatch):
    """Only the bookkeeping: no rows are written."""
    table = UpdateTable(spark, str(tmp_path / "u"), "k int", ["k"])
    runs, opened = [], []
    for _ in range(1000):
        level, merged = 0, 0
        while runs and runs[-1] == level:
            runs.pop()
            level, merged = level + 1, merged + 1
        runs.append(level)
        opened.append(len(runs))
    assert max(opened) <= 10 and len(set(runs)) == len(runs)
    assert table.folders() == []


@pytest.mark.parametrize("lost_at", ["prepare", "publish"])
def test_a_lost_merge_of_updates_is_done_again(spark, tmp_path, rows, monkeypatch, lost_at):
    table = UpdateTable(spark, str(tmp_path / "u"), "k int, v int", ["k"])
    batch = lambda i: spark.createDataFrame([(1, i), (10 + i, i)], "k int, v int")
    for i in range(3):
        table.add(batch(i), i)
    before = rows(table.read())
    with monkeypatch.context() as patch:
        patch.setattr(Ledger, lost_at, lambda *_: (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            table.add(batch(3), 3)
    assert rows(table.read()) == before
    assert table.add(batch(3), 3) and rows(table.read()) == [(1, 3), (10, 0), (11, 1), (12, 2), (13, 3)]
    assert len(table.folders()) == 1


def test_null_keys_and_no_rows(spark, tmp_path, rows):
    table = StateTable(spark, str(tmp_path / "t"), SCHEMA)
    table.merge(spark.createDataFrame([], SCHEMA), 0)
    assert table.read().count() == 0 and table.versions() == [0]
    table.merge(spark.createDataFrame([(None, 1, 1, "a"), (None, 2, 1, "b")], SCHEMA).withColumn("repo", F.col("repo")), 1)
    assert rows(table.read()) == [(None, 2, 1, "b")]
