"""Readers and writers. Locations are plain URIs, so every object store Spark can reach works."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.archives import ARCHIVE_SUFFIX, SIDECAR_SUFFIX

# Spark counts the opening of a file as ``spark.sql.files.openCostInBytes``, 4 MB. Where files have fewer bytes than this,
# a task takes that many times more of them, which is still no more than ``maxPartitionBytes``.
SMALL_BYTES = 64 << 10
SMALL_FILES = 64
# How the names of folders by key are written, as Spark's own writers do.
_NO_KEY = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = frozenset(map(chr, range(32))) | frozenset("\"#%'*/:=?\\\x7f{[]^")


def parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def stamp(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files: another text as soon as the table is another one."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(location)
    return ";".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of JSON logs; ``operators.oplog.log_scan`` types them."""
    return spark.read.text(path)


def log_line_stream(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def json_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Whole JSON files (manifests, sidecars, registry entries): key and text."""
    with _listing(spark):
        files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    return _bundled(files, _relative(F.col("_metadata.file_path"), path).alias("key"), "value")


def text_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Whole text files (requirement lists, attribute files): key and text."""
    return json_documents(spark, path, pattern).withColumnRenamed("value", "text")


def object_listing(spark: SparkSession, path: str, pattern: str = "*" + ARCHIVE_SUFFIX) -> DataFrame:
    """Objects below a location without reading them: key, size and time."""
    return _objects(
        spark,
        path,
        pattern,
        _relative(F.col("path"), path).alias("key"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("mtime"),
    )


def _opened(address: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of an address as Spark writes it, and the name there."""
    scheme, colon, rest = address.partition(":")
    rest = rest if rest.startswith("//") else "//" + rest
    return pyarrow.fs.FileSystem.from_uri(scheme + colon + quote(rest, safe="/:@"))


def _sha256(chunk: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column("path").to_pylist():
                store, name = _opened(path)
                digest = hashlib.sha256()
                with store.open_input_stream(name, compression=None) as stream:
                    while data := stream.read(chunk):
                        digest.update(data)
                digests.append(digest.hexdigest())
            yield pa.record_batch({"path": batch.column("path"), "size_bytes": batch.column("size_bytes"), "sha256": pa.array(digests, pa.string())})

    return run


def object_digests(spark: SparkSession, path: str, pattern: str = "*", chunk: int = 1 << 22, tasks: int | None = None) -> DataFrame:
    """SHA-256 of objects of any size: tasks open each object themselves and read it ``chunk`` bytes at a time."""
    listed = _objects(spark, path, pattern, "path", F.col("length").alias("size_bytes"))
    dealt = listed.repartition(tasks or spark.sparkContext.defaultParallelism, "path")
    digests = dealt.mapInArrow(_sha256(chunk), "path string, size_bytes bigint, sha256 string")
    return digests.select(_relative(F.col("path"), path).alias("key"), "size_bytes", "sha256")


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    return json_documents(spark, path, "*" + ARCHIVE_SUFFIX + SIDECAR_SUFFIX)


def write_lines(lines: DataFrame, path: str, key: str = "repo", order: str = "line_no", text: str = "line") -> None:
    """Text files with lines in order, below one folder per ``key``.

    Rows are range-partitioned on (key, order): a very long list is cut into several files
    whose name order is the line order.
    """
    ranged = lines.repartitionByRange(F.col(key), F.col(order)).sortWithinPartitions(key, order)
    ranged.select(key, F.col(text).alias("value")).write.partitionBy(key).text(path)


def _put(address: str, key: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(address)
        held, out, folder, hidden, n = None, None, "", "", 0

        def closed() -> None:
            # Whole objects appear at once, also where an attempt of a task is lost or runs twice.
            out.close()
            store.move(hidden, f"{folder}/part-00000.txt")

        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or name != held:
                    if out is not None:
                        closed()
                    held, n = name, n + 1
                    folder = f"{root}/{key}=" + "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in name)
                    hidden = f"{folder}/.part-{uuid.uuid4().hex}"
                    store.create_dir(folder)
                    out = store.open_output_stream(hidden, compression=None)
                out.write(text + b"\n")
        if out is not None:
            closed()
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    return run


def write_objects(lines: DataFrame, path: str, key: str, text: str, tasks: int | None = None) -> None:
    """One text object per ``key`` in a folder of its own, named as ``partitionBy(key)`` does. Tasks open the objects themselves:
    Spark's writers take milliseconds for a file, and publish one after the other."""
    spark = lines.sparkSession
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(location)
    name = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit(_NO_KEY)).alias("key")
    rows = lines.select(name, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    # A fixed number of partitions is not merged at run time, small as the rows are.
    dealt = rows.repartition(tasks or spark.sparkContext.defaultParallelism, "key").sortWithinPartitions("key")
    address = files.makeQualified(location).toString()
    dealt.mapInArrow(_put(address, key), "n bigint").write.format("noop").mode("overwrite").save()


def write_json_values(documents: DataFrame, path: str, text: str) -> None:
    documents.select(F.col(text).alias("value")).write.text(path)


def _objects(spark: SparkSession, path: str, pattern: str, *columns: str | Column) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    with _listing(spark):
        files = reader.option("pathGlobFilter", pattern).load(path)
    return _bundled(files, *columns)


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by some tasks a core, not by Spark's 10,000 tasks of a few folders each."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    given = spark.conf.get(name)
    spark.conf.set(name, min(int(given), max(256, 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, given)


def _bundled(files: DataFrame, *columns: str | Column) -> DataFrame:
    """Columns of files; small files come in tasks of ``SMALL_FILES`` times as many, if that leaves some tasks a core."""
    size = F.col("_metadata.file_size")
    small = files.where(size < SMALL_BYTES).select(*columns)
    dealt = small._jdf.queryExecution().toRdd().getNumPartitions()
    tasks = max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-dealt // SMALL_FILES))
    if dealt <= tasks:
        return files.select(*columns)
    return small.coalesce(tasks).unionAll(files.where(size >= SMALL_BYTES).select(*columns))


def _relative(full, base: str):
    """The part of a file URI below ``base``."""
    folder = base.split("://", 1)[-1].split(":", 1)[-1].strip("/")
    return F.regexp_replace(F.url_decode(F.replace(full, F.lit("+"), F.lit("%2B"))), "^.*?/+" + _quoted(folder) + "/", "")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"
