"""Updates of keyed rows, batch by batch, in folders that double in size.

Every batch is one folder. Like the digits of a binary counter, two folders of one level become one of the next: it
has the last update of each key of both. So after n batches a reader opens one folder a level, log2(n) at
most, and a row is written again as often at most. Which folders count is in a manifest, see ``manifests``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifests import Ledger

_BATCH = "__batch"


class UpdateTable:
    """The last update of every key."""

    def __init__(self, spark: SparkSession, path: str, schema, keys: Sequence[str]):
        self.spark, self.schema, self.keys = spark, schema, list(keys)
        self.ledger = Ledger(spark, path)

    def _stored(self, folders: Sequence[str]) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema).select("*", F.lit(0).cast("bigint").alias(_BATCH))
        if not folders:
            return empty
        return self.spark.read.schema(empty.schema).parquet(*[f"{self.ledger.path}/{f}" for f in folders])

    def _last(self, rows: DataFrame) -> DataFrame:
        """The last update of every key, reduced before the shuffle."""
        rest = [c for c in rows.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), _BATCH).alias("__last"))
        return last.select(*self.keys, *[F.col("__last")[c].alias(c) for c in rest]).select(*rows.columns)

    def folders(self) -> list[str]:
        """The folders a reader opens, the largest first."""
        manifest = self.ledger.current()
        return [r["folder"] for r in manifest["runs"]] if manifest else []

    def read(self) -> DataFrame:
        return self._last(self._stored(self.folders())).drop(_BATCH)

    def add(self, batch: DataFrame, batch_id: int) -> bool:
        """Take a batch in, which has one row a key; one that was taken in already changes nothing."""
        before = self.ledger.current()
        if before and batch_id <= before["batch"]:
            return False
        runs, level = list(before["runs"]) if before else [], 0
        merged = []
        while runs and runs[-1]["level"] == level:
            merged.append(runs.pop()["folder"])
            level += 1
        stored = self._stored(merged)
        rows = batch.withColumn(_BATCH, F.lit(batch_id).cast("bigint")).select(*stored.columns)
        folder = self.ledger.new_folder()
        (self._last(stored.unionAll(rows)) if merged else rows).write.parquet(f"{self.ledger.path}/{folder}")
        self.ledger.publish(self.ledger.prepare({"batch": batch_id, "runs": [*runs, {"level": level, "folder": folder}]}))
        return True

    def expire(self, keep: int = 2) -> int:
        """Remove folders that none of the newest ``keep`` manifests names; returns how many."""
        return self.ledger.expire(keep, lambda manifest: [r["folder"] for r in manifest["runs"]])
