"""Exact deduplication against a persistent digest index.

The index is a Parquet table, bucketed and sorted by the digest of the text without its blanks.
A new batch is reduced to one row per digest, an anti join by merging finds the digests that the
index lacks, and these are appended. Only digests are shuffled, never texts, and the index is not
shuffled at all. A batch that is run again finds its own digests and adds nothing.

Columns ``doc_id`` and ``text`` are read; others are ignored. Null text counts as empty, and all
empty texts are copies of each other. Of a batch's equal texts the one with most code points
stays, then the smallest id; a null id loses against any other. Rows that repeat an id and its
text are counted and share one verdict. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, scratch_path


def digest(text: Column) -> Column:
    """SHA-256 of the text without the characters ``[\\x20\\x09-\\x0D]``, as 32 bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r ", ""), 256))


class DigestIndex:
    """Digests of all texts seen so far and the document that stands for each.

    ``path`` is the index's folder, reachable from every executor; an index that is there already is
    opened again. ``buckets`` must be the same at each opening: choose it so that a bucket of some
    50 bytes a text fits a task (default: the session's shuffle partitions).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        location = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame) -> DataFrame:
        """Take a batch in. Returns ``doc_id, keep_id, group_size, kept, text_sha256`` for each row.

        ``keep_id`` is the document that stands for the text, of this batch or an earlier one;
        ``group_size`` counts the text's rows in this batch.
        """
        keyed = durable(
            docs.select(
                F.col("doc_id").cast("bigint").alias("doc_id"),
                F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"),
                digest(F.col("text")).alias("digest"),
            ),
            "digests",
        )
        # bitwise_not turns the order of ids round without leaving the range of the type.
        best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("reversed")))
        groups = durable(
            keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).select(
                "digest", "group_size", F.bitwise_not("best.reversed").alias("keep_id")
            ),
            "digest-groups",
        )
        new = groups.select("digest", "keep_id").join(self.rows().hint("merge"), "digest", "left_anti")
        new.repartition(self.buckets, "digest").write.insertInto(self.name)
        known = durable(groups.drop("keep_id").join(self.rows().hint("merge"), "digest"), "known-digests")
        # Both sides come from written tables, so that a digest of very many rows can be split at run time.
        return keyed.join(known.hint("merge"), "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def deduplicate(docs: DataFrame, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """``DigestIndex.add`` on the index at ``path``, or on a new one that starts empty."""
    return DigestIndex(docs.sparkSession, path or scratch_path(docs.sparkSession, "digest-index"), buckets).add(docs)
