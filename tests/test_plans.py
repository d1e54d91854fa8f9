"""Plans that must keep their shape: pushed filters, pruned columns, early combining."""

import pytest
from pyspark.sql import functions as F

from forgeledger.operators import changes as C
from forgeledger.operators import naming as N
from forgeledger.operators import oplog as L
from forgeledger.operators import selection as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def projects(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "projects")
    df = spark.range(10).select("id", F.concat(F.lit("g/"), F.col("id").cast("string")).alias("path"), F.lit("x").alias("other"))
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_prefix_reaches_the_scan(projects):
    text = plan(S.subtree(projects, "g").select("id"))
    assert "StringStartsWith(path,g/)" in text and "ReadSchema: struct<id:bigint,path:string>" in text


def test_names_need_no_shuffle(projects):
    named = N.name_validity(N.map_names(projects, "custom", custom={"g": "h"}, fallback="flatten"))
    text = plan(S.exclude_filter(named, "path", ["a/*", "b"]))
    assert "Exchange" not in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_latest_state_combines_before_its_only_shuffle(projects):
    text = plan(C.latest_state(projects, ["other"], ["id"]))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_max_by" in text and "Window" not in text


def test_top_commits_keeps_n_rows_per_task(projects):
    logs = projects.select(F.lit(L.SYNC_COMPLETED).alias("message"), F.col("path").alias("repository"), F.col("id").alias("commits_synced"), F.col("id").alias("event_id"))
    assert "TakeOrderedAndProject" in plan(L.top_commits(logs))


def test_log_filters_reach_the_scan(spark, tmp_path):
    spark.sql("select timestamp_ntz'2025-01-01' as ts, 'ERROR' as level, 'a' as repository").write.parquet(str(tmp_path / "l"))
    text = plan(L.errors_per_bin(spark.read.parquet(str(tmp_path / "l"))))
    assert "EqualTo(level,ERROR)" in text and "repository" not in text
