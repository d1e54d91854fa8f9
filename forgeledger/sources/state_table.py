"""A copy-on-write table of the latest row of each key.

Keys are hashed to buckets, each a folder of Parquet files that never changes. A batch of writes is reduced to its
latest row of each key, only the buckets that these fall into are read, merged and written anew, and the next
manifest names the new folders beside all others as they were. So the cost of a batch follows what it touches and
not the size of the estate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import latest_state
from ..session import durable
from .manifests import Ledger

_BUCKET = "__bucket"


class StateTable:
    """The last write of every key, by ``order``; versions are numbered by the batches that made them.

    ``buckets`` counts for a new table; choose it so that one bucket's rows fit a task, and so that a batch
    touches few of them. A table that is there already keeps its own number.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema, keys: Sequence[str] = ("repo",), order: Sequence[str] = ("ts", "seq"),
        buckets: int = 64,
    ):
        self.spark, self.schema, self.keys, self.order = spark, schema, list(keys), list(order)
        self.ledger = Ledger(spark, path)
        known = self.ledger.current()
        self.buckets = known["buckets"] if known else buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(_BUCKET)

    def _rows(self, manifest: dict | None, only: Sequence[int] | None = None) -> DataFrame:
        files = manifest["folders"] if manifest else {}
        wanted = [f"{self.ledger.path}/{f}" for b, f in files.items() if only is None or int(b) in set(only)]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*wanted)

    def versions(self) -> list[int]:
        """Batches whose versions can be read, oldest first."""
        return [m["batch"] for m in reversed(self.ledger.kept())]

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version or that of a batch; an empty table when there is none."""
        if version is None:
            return self._rows(self.ledger.current())
        for manifest in self.ledger.kept():
            if manifest["batch"] == version:
                return self._rows(manifest)
        raise ValueError(f"no version {version}")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, reading their buckets alone."""
        wanted = keys.select(*self.keys).distinct()
        return self._rows(self.ledger.current(), self._touched(wanted)).join(wanted, self.keys, "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        # As many numbers as there are buckets, at most.
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())

    def merge(self, batch: DataFrame, batch_id: int) -> bool:
        """Take a batch of writes in; a batch that was taken in already changes nothing.

        A write that arrives late does not replace a newer one.
        """
        before = self.ledger.current()
        if before and batch_id <= before["batch"]:
            return False
        newest = durable(latest_state(batch, self.keys, self.order), "state-batch")
        touched = self._touched(newest)
        columns = self._rows(None).columns
        both = self._rows(before, touched).unionByName(newest.select(*columns)).select("*", self._bucket())
        # One exchange: rows of a bucket are reduced where they are written.
        merged = latest_state(both.repartition(max(1, min(len(touched), 4096)), _BUCKET), [_BUCKET, *self.keys], self.order)
        folder = self.ledger.new_folder()
        merged.select(*columns, _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.ledger.path}/{folder}")
        made = {str(b): f"{folder}/{_BUCKET}={b}" for b in touched}
        folders = (before["folders"] if before else {}) | made
        self.ledger.publish(self.ledger.prepare({"batch": batch_id, "buckets": self.buckets, "folders": folders}))
        return True

    def expire(self, keep: int = 2) -> int:
        """Keep the newest ``keep`` versions; returns how many folders were removed."""
        return self.ledger.expire(keep, lambda manifest: manifest["folders"].values())
