"""Versioned snapshots of state tables on any file system Spark can write to.

A version is a folder ``version=N``, written once and never changed. Its ``_SUCCESS`` marker
is what publishes it, so a reader sees either the whole version or none of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    location, files = _folder(spark, path)
    return files.exists(location)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first."""
    location, files = _folder(spark, path)
    if not files.exists(location):
        return []
    found = []
    for entry in files.listStatus(location):
        name = entry.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name.startswith("version=") and files.exists(marker):
            found.append(int(name.split("=", 1)[1]))
    return sorted(found)


def read_snapshot(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The given or newest version; an empty table when there is none."""
    known = versions(spark, path)
    if version is None:
        version = known[-1] if known else None
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={version}")


def write_snapshot(df: DataFrame, path: str, version: int) -> bool:
    """Publish ``df`` as a version. A version that exists already is left alone."""
    if version in versions(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    return True
