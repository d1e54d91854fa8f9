"""A stored index of commit graphs that grows with the commits and answers ancestry by joins alone.

Commits lie on lines, at a place counted from the line's oldest commit on, so that new commits never move old ones.
Three small tables beside the places say what a commit reaches on other lines:

* *chains*: a line begins above a commit of another line, its base, which has a base again. A line's chain lists all
  lines below it with the place that it begins above. New lines are laid along the child with most descendants, so
  a chain is about as long as the logarithm of the history.
* *labels*: from some place on, a line reaches another one up to some place, by merges. A label is kept only where it
  reaches further than the chain and the labels below it, so a merged branch costs one label on the line that took
  it in, and none on the lines that begin above.

What a commit reaches on a line is thus the greatest of: its own place, its chain's places, and the labels of those lines up
to these places. That is two joins, whatever the depth of the history. Nothing a batch brings changes what is stored about older
commits: an extension places the new commits, continues lines or begins new ones, and labels its merges, in
rounds that end when a round brings no label that reaches further.

The index is folders under a manifest (see ``sources.manifests``): an extension that was lost half-way has changed
nothing, and one that is run again is left out. Folders are merged like the digits of a binary counter.

Joins are on (repo, sha) and (repo, line); a repository may hold any share of the commits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable, durable_counted
from ..sources.manifests import Ledger
from .history import first_parents, place_lines

#: Labels are matched per block of this many places, so that a line with very many of them is worked on by many tasks.
_LABEL_BLOCK = 1_024
_TABLES = ("places", "chains", "labels", "tips")


def _block(place: str):
    return F.floor(F.col(place) / _LABEL_BLOCK).cast("bigint")


class CommitIndex:
    """The stored index at ``path``; see ``extend`` and the questions of ``history``, which take it as their history.

    ``places`` has (repo, sha, line, depth), where depth is the place below zero, so that deeper commits have greater
    numbers, as the functions of ``history`` expect.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.ledger = spark, Ledger(spark, path)

    # --- stored tables ---------------------------------------------------------------------

    @staticmethod
    def _schemas(repo: str, sha: str) -> dict[str, str]:
        return {
            "places": f"repo {repo}, sha {sha}, line {sha}, place bigint",
            "chains": f"repo {repo}, line {sha}, up_line {sha}, up_place bigint",
            "labels": f"repo {repo}, line {sha}, place bigint, to_line {sha}, to_place bigint",
            "tips": f"repo {repo}, line {sha}, length bigint",
        }

    def _stored(self, name: str, manifest: dict | None = None, folders: list[str] | None = None) -> DataFrame:
        manifest = manifest or self.ledger.current()
        if manifest is None:
            raise ValueError("the index has no commits yet")
        schema = self._schemas(*manifest["types"])[name]
        wanted = [r["folder"] for r in manifest["runs"]] if folders is None else folders
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.ledger.path}/{f}/{name}" for f in wanted])

    @property
    def places(self) -> DataFrame:
        return self._stored("places").select("repo", "sha", "line", (-F.col("place")).alias("depth"))

    def with_lengths(self, rows: DataFrame) -> DataFrame:
        """Rows with the ``length`` that depths of a line are smaller than: no place is below zero."""
        return rows.withColumn("length", F.lit(1).cast("bigint"))

    # --- questions -------------------------------------------------------------------------

    def _ways(self, heads: DataFrame) -> DataFrame:
        """(repo, head, line, upto): the head's own line and those of its chain."""
        places = self._stored("places").withColumnsRenamed({"sha": "head", "place": "upto"})
        own = places.join(heads.select("repo", "head").distinct(), ["repo", "head"], "left_semi").select("repo", "head", "line", "upto")
        # The head's own line comes along with each line of its chain.
        way = F.explode(F.array(F.struct("line", "upto"), F.struct(F.col("up_line").alias("line"), F.col("up_place").alias("upto"))))
        ways = own.join(self._stored("chains"), ["repo", "line"], "left").select("repo", "head", way.alias("way"))
        return ways.select("repo", "head", "way.*").where("line is not null")

    def reach(self, heads: DataFrame) -> DataFrame:
        """(repo, head, line, entry): from ``head`` every commit of ``line`` at depth >= entry."""
        far = F.when(F.col("place") <= F.col("upto"), F.struct(F.col("to_line").alias("line"), F.col("to_place").alias("upto")))
        way = F.explode(F.array(F.struct("line", "upto"), far))
        every = self._ways(heads).join(self._stored("labels"), ["repo", "line"], "left").select("repo", "head", way.alias("way"))
        return every.select("repo", "head", "way.*").where("line is not null").groupBy("repo", "head", "line").agg((-F.max("upto")).alias("entry"))

    def is_ancestor(self, pairs: DataFrame) -> DataFrame:
        """Per (repo, old, new): whether old is reachable from new; null where either is unknown.

        Only the labels between the two commits' lines are looked at.
        """
        places = self._stored("places")
        old = places.select("repo", F.col("sha").alias("old"), F.col("line").alias("to_line"), F.col("place").alias("wanted"))
        new = places.select("repo", F.col("sha").alias("new"), "line", F.col("place").alias("upto"))
        asked = pairs.select("repo", "old", "new").distinct().join(old, ["repo", "old"], "left").join(new, ["repo", "new"], "left")
        # The new commit's own line comes along with each line of its chain.
        way = F.explode(F.array(F.struct("line", "upto"), F.struct(F.col("up_line").alias("line"), F.col("up_place").alias("upto"))))
        ways = asked.join(self._stored("chains"), ["repo", "line"], "left").select("repo", "old", "new", "to_line", "wanted", way.alias("way"))
        ways = ways.select("repo", "old", "new", "to_line", "wanted", "way.line", "way.upto")
        labels = self._stored("labels")
        found = ways.join(labels, ["repo", "line", "to_line"], "left")
        along = (F.col("line") == F.col("to_line")) & (F.col("wanted") <= F.col("upto"))
        merged = (F.col("place") <= F.col("upto")) & (F.col("to_place") >= F.col("wanted"))
        known = F.col("wanted").isNotNull() & F.col("upto").isNotNull()  # a missing chain's way is not the only one
        hit = F.coalesce(along, F.lit(False)) | F.coalesce(merged, F.lit(False))
        return found.groupBy("repo", "old", "new").agg(F.max(F.when(known, hit)).alias("is_ancestor"))

    # --- extension -------------------------------------------------------------------------

    def extend(self, commits: DataFrame, batch_id: int = 0) -> bool:
        """Take commits in: ``repo, sha, parent`` and optionally ``parent_no``, one row per parent edge.

        A commit's parents are in the same batch or an earlier one; edges to commits that never came are ignored, and so are
        commits that are there already. A batch that was taken in changes nothing.
        """
        before = self.ledger.current()
        if before and batch_id <= before["batch"]:
            return False
        types = before["types"] if before else [commits.schema[c].dataType.simpleString() for c in ("repo", "sha")]
        old = {name: self._stored(name, before or {"types": types, "runs": []}) for name in _TABLES}
        nodes = first_parents(commits).join(old["places"], ["repo", "sha"], "left_anti")
        nodes = durable(nodes, "index-nodes")
        spots, lines = self._new_lines(nodes, old)
        bases = lines.where("base_line is not null").select("repo", "line", "base_line", "base_place")
        made = {
            "places": durable(
                spots.join(lines.select("repo", "batch_line", "line", "offset"), ["repo", "batch_line"]).select(
                    "repo", "sha", "line", (F.col("offset") + F.col("up")).alias("place")
                ),
                "index-places",
            ),
            "tips": lines.select("repo", "line", (F.col("offset") + F.col("length")).alias("length")),
            "chains": self._new_chains(bases, old["chains"]),
        }
        made["labels"] = self._new_labels(commits, nodes, made, old)
        runs, level, merged = list(before["runs"]) if before else [], 0, []
        while runs and runs[-1]["level"] == level:
            merged.append(runs.pop()["folder"])
            level += 1
        folder = self.ledger.new_folder()
        for name in _TABLES:
            columns = old[name].columns
            rows = made[name].select(*columns)
            if merged:
                rows = self._stored(name, before, merged).unionAll(rows)
            rows.write.parquet(f"{self.ledger.path}/{folder}/{name}")
        self.ledger.publish(self.ledger.prepare({"batch": batch_id, "types": types, "runs": [*runs, {"level": level, "folder": folder}]}))
        return True

    def expire(self, keep: int = 2) -> int:
        """Remove folders that none of the newest ``keep`` versions has; returns how many."""
        return self.ledger.expire(keep, lambda manifest: [r["folder"] for r in manifest["runs"]])

    def _new_lines(self, nodes: DataFrame, old: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
        """The batch's commits on lines of their own, and how each of these continues or leaves another line."""
        placed = place_lines(nodes)
        lengths = placed.groupBy("repo", "line").agg((F.max("depth") + 1).alias("length"))
        spots = placed.join(lengths, ["repo", "line"]).select(
            "repo", "sha", F.col("line").alias("batch_line"), "length", (F.col("length") - 1 - F.col("depth")).alias("up")
        )
        spots = durable(spots, "index-spots")
        inside = spots.select("repo", F.col("sha").alias("parent"), F.col("batch_line").alias("in_line"), F.col("up").alias("in_up"))
        outside = old["places"].select("repo", F.col("sha").alias("parent"), F.col("line").alias("at_line"), F.col("place").alias("at_place"))
        tips = old["tips"].groupBy("repo", F.col("line").alias("at_line")).agg(F.max("length").alias("at_length"))
        first = spots.where("up = 0").join(nodes, ["repo", "sha"])
        first = first.join(inside, ["repo", "parent"], "left").join(outside, ["repo", "parent"], "left").join(tips, ["repo", "at_line"], "left")
        at_tip = F.col("at_place") == F.col("at_length") - 1
        first = durable(first.withColumn("at_tip", F.coalesce(at_tip, F.lit(False))), "index-first")
        # Of the lines above one tip the longest continues its line.
        goes_on = first.where("at_tip").groupBy("repo", "at_line").agg(F.max(F.struct("length", "batch_line"))["batch_line"].alias("batch_line"))
        goes_on = goes_on.select("repo", "batch_line", F.lit(True).alias("goes_on"))
        lines = first.join(goes_on, ["repo", "batch_line"], "left").select(
            "repo", "batch_line", "length", "in_line", "in_up", "at_place",
            F.when(F.col("goes_on"), F.col("at_line")).otherwise(F.col("sha")).alias("line"),
            F.when(F.col("goes_on"), F.col("at_place") + 1).otherwise(0).cast("bigint").alias("offset"),
            F.when(F.col("goes_on").isNull(), F.col("at_line")).alias("at_line"),
        )
        lines = durable(lines, "index-lines")
        below = lines.select("repo", F.col("batch_line").alias("in_line"), F.col("line").alias("below"), F.col("offset").alias("below_offset"))
        lines = lines.join(below, ["repo", "in_line"], "left").select(
            "repo", "batch_line", "length", "line", "offset", F.coalesce("below", "at_line").alias("base_line"),
            F.coalesce(F.col("below_offset") + F.col("in_up"), F.when(F.col("at_line").isNotNull(), F.col("at_place"))).alias("base_place"),
        )
        return spots, durable(lines, "index-lines")

    def _new_chains(self, bases: DataFrame, old: DataFrame) -> DataFrame:
        """(repo, line, up_line, up_place) of the new lines: their bases, the bases of these and so on."""
        below = bases.select("repo", F.col("line").alias("up_line"), "base_line", "base_place")
        front, n = durable_counted(
            bases.select("repo", "line", F.col("base_line").alias("up_line"), F.col("base_place").alias("up_place")), F.lit(True), "index-chains"
        )
        every = front
        while n:
            further = front.join(below, ["repo", "up_line"]).select(
                "repo", "line", F.col("base_line").alias("up_line"), F.col("base_place").alias("up_place")
            )
            front, n = durable_counted(further, F.lit(True), "index-chains")
            if n:
                every = every.unionAll(front)
        stored = old.select("repo", F.col("line").alias("up_line"), F.col("up_line").alias("next_line"), F.col("up_place").alias("next_place"))
        through = every.join(stored, ["repo", "up_line"]).select(
            "repo", "line", F.col("next_line").alias("up_line"), F.col("next_place").alias("up_place")
        )
        return durable(every.unionAll(through), "index-chains")

    def _new_labels(self, commits: DataFrame, nodes: DataFrame, made: dict[str, DataFrame], old: dict[str, DataFrame]) -> DataFrame:
        """(repo, line, place, to_line, to_place) that the batch's merges bring, and what they reach through others."""
        chains = durable(old["chains"].unionAll(made["chains"].select(*old["chains"].columns)), "index-chains")
        places = old["places"].unionAll(made["places"].select(*old["places"].columns))
        merges = commits.where("parent is not null").select("repo", "sha", "parent").join(
            nodes.withColumnRenamed("parent", "first_parent"), ["repo", "sha"]
        ).where("parent <> first_parent")
        to = places.select("repo", F.col("sha").alias("parent"), F.col("line").alias("to_line"), F.col("place").alias("to_place"))
        found = merges.join(made["places"], ["repo", "sha"]).join(to, ["repo", "parent"]).select("repo", "line", "place", "to_line", "to_place")
        labels = old["labels"].select("*", F.lit(None).cast("bigint").alias("reached"))
        batch = labels.limit(0)
        while True:
            fresh, n = durable_counted(self._further(found, labels, chains), F.lit(True), "index-labels")
            if not n:
                return batch.drop("reached")
            found = self._through(fresh, labels.unionAll(fresh)).unionAll(self._through(batch, fresh)).unionAll(
                # The chain of a line comes along where it is met for the first time.
                fresh.where("reached < 0").select("repo", "line", "place", F.col("to_line").alias("via"))
                .join(chains.withColumnsRenamed({"line": "via"}), ["repo", "via"])
                .select("repo", "line", "place", F.col("up_line").alias("to_line"), F.col("up_place").alias("to_place"))
            )
            labels, batch = labels.unionAll(fresh), batch.unionAll(fresh)

    @staticmethod
    def _further(found: DataFrame, labels: DataFrame, chains: DataFrame) -> DataFrame:
        """Of the labels found those that reach further than what is known at their place, with how far that reached."""
        best = found.where("line <> to_line").groupBy("repo", "line", "place", "to_line").agg(F.max("to_place").alias("to_place"))
        below = chains.select("repo", "line", F.col("up_line").alias("to_line"), "up_place")
        best = best.join(below, ["repo", "line", "to_line"], "left").where("up_place is null or to_place > up_place")
        key = ["repo", "line", "to_line"]
        near = labels.join(best.select(*key).distinct(), key, "left_semi").select(*best.columns[:-1], F.lit(None).cast("bigint").alias("up_place"), F.lit(0).alias("new"))
        both = best.withColumn("new", F.lit(1)).unionByName(near)
        earlier = Window.partitionBy(*key).orderBy("place", "new").rowsBetween(Window.unboundedPreceding, -1)
        both = both.withColumn("before", F.max("to_place").over(earlier)).where("new = 1 and (before is null or to_place > before)")
        reached = F.greatest(F.coalesce("before", F.lit(-1)), F.coalesce("up_place", F.lit(-1))).cast("bigint")
        return both.select("repo", "line", "place", "to_line", "to_place", reached.alias("reached"))

    @staticmethod
    def _through(labels: DataFrame, onward: DataFrame) -> DataFrame:
        """What ``labels`` reach through ``onward`` labels on the stretches that they are the first to reach."""
        via = onward.select(
            "repo", F.col("line").alias("via"), F.col("place").alias("at"), F.col("to_line").alias("far_line"), F.col("to_place").alias("far_place"),
            _block("place").alias("block"),
        )
        last = via.groupBy("repo", "via").agg(F.min("block").alias("first_block"), F.max("block").alias("last_block"))
        own = labels.select("repo", "line", "place", F.col("to_line").alias("via"), F.col("to_place").alias("upto"), "reached")
        spread = own.join(last, ["repo", "via"])
        begin = F.greatest(F.floor((F.col("reached") + 1) / _LABEL_BLOCK).cast("bigint"), "first_block")
        end = F.least(_block("upto"), "last_block")
        blocks = spread.where(begin <= end).select("*", F.explode(F.sequence(begin, end)).alias("block")).drop("first_block", "last_block")
        met = blocks.join(via, ["repo", "via", "block"]).where("at > reached and at <= upto")
        return met.select("repo", "line", "place", F.col("far_line").alias("to_line"), F.col("far_place").alias("to_place"))
