"""Session settings and durable intermediate tables."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings every operator relies on. All of them can be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Of a repeated member of a JSON object the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys are split at run time, also where the split costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session and make sure intermediates have a home."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    shared_folder(spark)
    return spark


def local_session(cores: str = "*", app: str = "forgeledger") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's checkpoint folder.

    A local session without one gets a new temporary folder. On a cluster a folder on one
    machine would be lost with that machine, so there the setting is required, and taken at its
    word: a shared mount and a local disk look alike from here.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="forgeledger-"))
    return context.getCheckpointDir()


_HOMES: set[str] = set()


def _home(spark: SparkSession) -> str:
    """The folder of all that an application writes for itself. It goes when the application's driver ends."""
    home = f"{shared_folder(spark).rstrip('/')}/forgeledger/{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        location = spark._jvm.org.apache.hadoop.fs.Path(home)
        files = location.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(location)
        files.deleteOnExit(location)
        _HOMES.add(home)
    return home


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table. All of one application's are in one folder."""
    return f"{_home(spark)}/{label}-{uuid.uuid4().hex}"


def application_path(spark: SparkSession, label: str, *of: str) -> str:
    """The path of something kept as long as the application, always the same for the same ``of``."""
    name = hashlib.sha256("\0".join(of).encode()).hexdigest()[:24]
    return f"{_home(spark)}/{label}-{name}"


def durable(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage of iterative jobs so that a lost executor costs one step, not the
    whole loop. Parquet keeps the next step's scan columnar and gives Spark real sizes for
    its join choices.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def durable_counted(df: DataFrame, condition: Column, label: str = "step") -> tuple[DataFrame, int]:
    """``durable``, with the number of rows that meet ``condition``, counted while writing."""
    seen = Observation()
    written = durable(df.observe(seen, F.count_if(condition).alias("n")), label)
    return written, seen.get["n"]

