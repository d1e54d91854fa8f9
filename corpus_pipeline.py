"""A training corpus from raw documents: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes what its predecessor kept, is written as Parquet and read again. All but the last
return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeledger.llm import decontaminate, exact, near, packing, quality
from forgeledger.llm.frames import prepare
from forgeledger.session import durable, scratch_path

#: No SQL can train the classifier or tokenise; the stages are tested against brute force instead.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """The documents with a number of each row's own in ``__row``, written so that it stays the same."""
    return durable(docs.withColumn("__row", F.monotonically_increasing_id()), "corpus-rows")


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows' numbers in place of ids, which may be missing or repeated."""
    return rows.select(F.col("__row").alias("doc_id"), "text")


def _first(rows: DataFrame, groups: DataFrame, *before: Column) -> DataFrame:
    """One row of each group: the first by ``before``, then by id, a missing id last, then by the text's digest.

    ``groups`` has ``doc_id``, a row's number, and ``group``. Where that is null, rows of equal id and text are a group.
    """
    own_id, text = F.col("doc_id").cast("bigint"), F.sha2("text", 256)
    placed = rows.select(
        F.col("__row").alias("nth"), F.struct(*before, own_id.isNull(), own_id, text, F.col("__row").alias("row")).alias("place"),
        F.struct(own_id, text).alias("itself"),
    )
    grouped = placed.join(groups.hint("merge"), placed["nth"] == groups["doc_id"])
    by = F.col("group"), F.when(F.col("group").isNull(), F.col("itself")).alias("alone")
    first = grouped.groupBy(*by).agg(F.min("place").alias("place")).select(F.col("place.row").alias("first_row"))
    return rows.join(first.hint("merge"), F.col("__row") == F.col("first_row"), "left_semi").drop("__row")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    prepare(spark)
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with most code points, then the smallest id."""
    prepare(spark)
    rows = _rows(docs)
    groups = exact.deduplicate(_numbered(rows)).select("doc_id", F.col("text_sha256").alias("group"))
    return _first(rows, groups, -F.coalesce(F.length("text"), F.lit(0)))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id.

    Documents without words are nobody's near copy and stay; rows that repeat one's id and text do not.
    """
    prepare(spark)
    rows = _rows(docs)
    groups = near.near_groups(_numbered(rows)).select("doc_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group"))
    return _first(rows, groups)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    prepare(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    prepare(spark)
    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's result written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"corpus-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
