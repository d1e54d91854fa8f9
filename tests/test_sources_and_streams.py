import json
import random
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from forgeledger import schemas
from forgeledger import session as S
from forgeledger.operators import archives as A
from forgeledger.operators import deps as D
from forgeledger.operators import oplog as L
from forgeledger.sources import snapshots, tables
from forgeledger.streaming import jobs as J


def put(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_archive_folder(spark, tmp_path, rows):
    base = tmp_path / "my store+1"
    put(base, "x/a.tar.gz", b"abc")
    put(base, "x/a.tar.gz.meta.json", json.dumps({"archive_type": "full", "repository_name": "r"}))
    put(base, "x/deep/b c.tar.gz", b"de")
    put(base, "x/notes.txt", b"n")
    listing = A.archive_listing(tables.object_listing(spark, str(base)), tables.sidecars(spark, str(base)))
    assert rows(listing, "key", "filename", "size_bytes", "archive_type") == [("x/a.tar.gz", "a.tar.gz", 3, "full"), ("x/deep/b c.tar.gz", "b c.tar.gz", 2, None)]
    assert "content" not in str(tables.object_listing(spark, str(base))._jdf.queryExecution().executedPlan()).split("ReadSchema")[-1]
    digests = tables.object_digests(spark, str(base), "*.tar.gz", chunk=2)
    assert rows(digests, "key", "sha256")[0] == ("x/a.tar.gz", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")


def test_text_files_and_manifests(spark, tmp_path, rows):
    put(tmp_path, "r1/requirements.txt", "a>=1\nb\n")
    put(tmp_path, "r1/m.manifest.json", '{"type": "full",\n "lfs_enabled": false}')
    put(tmp_path, "r2/m.manifest.json", "{")
    texts = tables.text_files(spark, str(tmp_path), "requirements*.txt").withColumnRenamed("key", "manifest")
    assert rows(D.requirements_parse(texts), "manifest", "line_no", "name") == [("r1/requirements.txt", 0, "a"), ("r1/requirements.txt", 1, "b")]
    manifests = A.manifest_read(tables.json_documents(spark, str(tmp_path), "*.manifest.json"))
    assert rows(manifests, "key", "manifest_valid", "manifest.type") == [("r1/m.manifest.json", True, "full"), ("r2/m.manifest.json", False, None)]


def test_line_and_json_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("r", 2, "c"), ("r", 0, "a"), ("s", 0, "x"), ("r", 1, "b")], "repo string, line_no long, line string")
    tables.write_lines(lines, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "repo=r").glob("part-*")))
    assert text == "a\nb\nc\n"
    tables.write_json_values(spark.createDataFrame([('{"a": 1}',)], "d string"), str(tmp_path / "json"), "d")
    assert spark.read.schema("a int").json(str(tmp_path / "json")).first().a == 1
    tables.parquet(spark, _written(spark, tmp_path), "id bigint").count()


def test_objects_by_key_are_as_partitioned_files(spark, tmp_path):
    rows = [("a", "1"), ("b/c d=%", "2"), ("a", None), (None, "3"), ("", "4"), ("é", "ü"), ("a", "5\n6")]
    lines = spark.createDataFrame(rows, "repo string, line string")
    tables.write_objects(lines, str(tmp_path / "objects"), "repo", "line", tasks=3)
    lines.write.partitionBy("repo").text(str(tmp_path / "files"))

    def kept(root):
        return {d.name: sorted("".join(p.read_text() for p in d.glob("part-*.txt")).splitlines()) for d in root.iterdir() if d.is_dir()}

    assert kept(tmp_path / "objects") == kept(tmp_path / "files")
    assert all([p.name for p in d.iterdir()] == ["part-00000.txt"] for d in (tmp_path / "objects").iterdir())
    tables.write_objects(lines.limit(0), str(tmp_path / "none"), "repo", "line")
    assert tables.json_documents(spark, str(tmp_path / "none"), "*.txt").count() == 0


@pytest.fixture
def many_objects(spark, tmp_path):
    """300 small objects in folders of their own and two large ones, when Spark by itself reads each in a task of its own."""
    for n in range(300):
        put(tmp_path, f"repo={n}/part-0.txt", f"{n}\n")
    for n in (300, 301):
        put(tmp_path, f"repo={n}/part-0.txt", f"{n}\n" + "x" * tables.SMALL_BYTES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    yield str(tmp_path)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_small_documents_share_tasks(spark, many_objects):
    documents = tables.json_documents(spark, many_objects, "*.txt")
    assert sorted((r.key, r.value[:4].strip()) for r in documents.collect()) == sorted((f"repo={n}/part-0.txt", str(n)) for n in range(302))
    assert documents.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 2


def test_small_objects_are_listed_in_shared_tasks(spark, many_objects):
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    listing = tables.object_listing(spark, many_objects, "*.txt")
    sizes = {r.key: r.size_bytes for r in listing.collect()}
    assert len(sizes) == 302 and sizes["repo=7/part-0.txt"] == 2 and sizes["repo=300/part-0.txt"] == 4 + tables.SMALL_BYTES
    assert listing.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 2
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def _written(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    return str(tmp_path / "t")


def test_snapshots_are_published_once_and_whole(spark, tmp_path, rows):
    path, schema = str(tmp_path / "state"), "k int, v string"
    assert snapshots.versions(spark, path) == [] and snapshots.read_snapshot(spark, path, schema).count() == 0
    assert snapshots.write_snapshot(spark.createDataFrame([(1, "a")], schema), path, 0)
    assert snapshots.write_snapshot(spark.createDataFrame([(1, "b")], schema), path, 3)
    assert not snapshots.write_snapshot(spark.createDataFrame([(1, "late")], schema), path, 0)
    put(tmp_path, "state/version=9/part-0.parquet", b"half written")
    assert snapshots.versions(spark, path) == [0, 3]
    assert rows(snapshots.read_snapshot(spark, path, schema)) == [(1, "b")]
    assert rows(snapshots.read_snapshot(spark, path, schema, 0)) == [(1, "a")]


def test_schemas_parse(spark):
    for name in "PROJECTS PROJECT_DETAILS STATE COMMITS REFS OP_RESULTS ARCHIVES MANIFEST DEPENDENCIES REGISTRY_JSON".split():
        assert spark.createDataFrame([], getattr(schemas, name)).columns


def test_shared_folder_follows_the_session(spark):
    assert S.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir", spark.sparkContext.getCheckpointDir())
    assert S.scratch_path(spark, "x").startswith(S.shared_folder(spark))
    assert S.durable(spark.range(5)).count() == 5


def test_intermediates_go_with_the_application(tmp_path):
    """A driver of its own writes a step; when it has ended nothing is left of it."""
    program = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', sys.argv[2]).getOrCreate()\n"
        "from forgeledger.session import configure, durable, scratch_path\n"
        "import os; assert durable(configure(spark).range(9)).count() == 9\n"
        "assert os.listdir(sys.argv[2] + '/forgeledger')\n"
    )
    root = str(Path(__file__).resolve().parents[1])
    subprocess.run([sys.executable, "-c", program, root, str(tmp_path / "shared")], check=True, capture_output=True, timeout=180)
    assert list((tmp_path / "shared" / "forgeledger").iterdir()) == []


# --- streams ---------------------------------------------------------------------------

START = datetime(2025, 1, 1)
SCHEMA = "ts timestamp, level string, status string, repo string, seq int, operation_id int, url string, state string"


def feed(spark, folder, name, entries):
    """Add one file of (minute, level, status, repo, seq, operation_id, state) to a stream's folder."""
    data = [(START + timedelta(minutes=m), lv, st, r, s, o, f"u{o}", state) for m, lv, st, r, s, o, state in entries]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.fixture
def batches(spark, tmp_path):
    folder = tmp_path / "in"
    feed(spark, folder, "1", [(0, "ERROR", "failure", "a", 1, 1, "started"), (1, "INFO", "success", "a", 2, 1, "completed"), (6, "ERROR", "failure", "b", 3, 2, "started")])
    feed(spark, folder, "2", [(4, "ERROR", "failure", "a", 1, 3, "started"), (7, "ERROR", "success", "b", 5, 3, "failed"), (200, "INFO", "success", "c", 6, 4, "started"), (200, "INFO", "success", "c", 7, 5, "completed")])
    return folder


def test_stream_equals_batch(spark, batches, tmp_path, rows):
    batch = spark.read.schema(SCHEMA).parquet(str(batches))
    for name, build, twin in (
        ("errors", J.stream_errors, L.errors_per_bin(batch)),
        ("rate", J.stream_success_rate, L.success_rate(batch, "5 minutes", "1 minute")),
    ):
        live = build(stream(spark, batches))
        J.run_available(live, J.update_folder(str(tmp_path / name)), str(tmp_path / f"{name}-cp"))
        assert rows(J.read_updates(spark, str(tmp_path / name), live.schema, ["bin"])) == rows(twin)


def test_restart_adds_nothing_twice(spark, batches, tmp_path, rows):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):
        J.run_available(J.stream_errors(stream(spark, batches)), J.update_folder(out), checkpoint)
    first = rows(J.read_updates(spark, out, "bin timestamp, n_errors long", ["bin"]))
    feed(spark, batches, "3", [(201, "ERROR", "failure", "z", 9, 9, "started")])
    J.run_available(J.stream_errors(stream(spark, batches)), J.update_folder(out), checkpoint)
    second = rows(J.read_updates(spark, out, "bin timestamp, n_errors long", ["bin"]))
    assert sum(r[1] for r in first) == 4 and set(second) - set(first) == {(START + timedelta(minutes=200), 1)}


def test_state_snapshots(spark, batches, tmp_path, rows):
    schema = "repo string, ts timestamp, seq int, status string"
    sink = J.state_snapshot_sink(str(tmp_path / "state"), schema)
    live = stream(spark, batches).select("repo", "ts", "seq", "status")
    J.run_available(live, sink, str(tmp_path / "cp"), "append")
    assert snapshots.versions(spark, str(tmp_path / "state")) == [0, 1]
    got = snapshots.read_snapshot(spark, str(tmp_path / "state"), schema)
    assert rows(got, "repo", "seq") == [("a", 1), ("b", 5), ("c", 7)]
    before = rows(got)
    sink(spark.createDataFrame([("a", START, 99, "replay")], schema), 1)
    assert rows(snapshots.read_snapshot(spark, str(tmp_path / "state"), schema)) == before


def test_stream_pairing(spark, batches, tmp_path):
    source = stream(spark, batches)
    live = J.stream_operation_pairing(source.where("state = 'started'"), stream(spark, batches).where("state <> 'started'"), "30 minutes", "5 minutes")
    J.run_available(live, J.update_folder(str(tmp_path / "out")), str(tmp_path / "cp"), "append")
    paired = J.read_updates(spark, str(tmp_path / "out"), live.schema, ["operation_id"])
    # Operation 2 timed out; operation 4 has just started and is still open.
    assert {r.operation_id: r.end_state for r in paired.collect()} == {1: "completed", 2: None, 3: "failed"}
    starts = spark.read.schema(SCHEMA).parquet(str(batches)).where("state = 'started'").select("operation_id", "url", F.col("ts").alias("started_at"))
    closed = J.close_open_operations(paired, starts)
    assert {r.operation_id: r.outcome for r in closed.collect()} == {1: "completed", 2: "unfinished", 3: "failed", 4: "unfinished"}


@pytest.fixture
def many_files(spark, tmp_path):
    """Notices of 60 operations over 12 files: ends before starts, late ends, ends twice, none at all."""
    folder, rng, wanted = tmp_path / "notices", random.Random(6), {}
    files = [[] for _ in range(12)]
    for o in range(60):
        start = 10 * o
        file = o // 6
        files[file].append((start, "INFO", "x", "r", o, o, "started"))
        kind = rng.choice(["end", "end", "before", "twice", "late", "none"])
        end = start + rng.randint(1, 25)
        if kind == "none":
            wanted[o] = "unfinished"
            continue
        if kind == "late":
            # The end is more than the timeout after the start.
            files[min(file + 1, 10)].append((start + 45, "INFO", "x", "r", o, o, "completed"))
            wanted[o] = "unfinished"
            continue
        state = rng.choice(["completed", "failed"])
        wanted[o] = state
        place = max(file - 1, 0) if kind == "before" else min(file + rng.randint(0, 1), 10)
        files[place].append((end, "INFO", "x", "r", o, o, state))
        if kind == "twice":
            files[min(place + 1, 10)].append((end + 1, "INFO", "x", "r", o, o, "completed"))
    # A clock that moves past the last operation's time.
    files[11].append((10_000, "INFO", "x", "r", 0, -1, "tick"))
    return folder, files, wanted


def test_operations_close_once_over_restarts(spark, tmp_path, many_files):
    folder, files, wanted = many_files
    sink = J.update_folder(str(tmp_path / "out"))
    for at in (0, 4, 9):
        # Files come while the stream is down; each start goes on where the last one ended.
        for n, rows in enumerate(files[at : {0: 4, 4: 9, 9: 12}[at]], at):
            feed(spark, folder, str(n), rows)
        live = J.stream_closed_operations(stream(spark, folder), 1800, "300 minutes")
        J.run_available(live, sink, str(tmp_path / "cp"), "append")
    closed = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.operation_id for r in closed) == sorted(wanted)
    assert {r.operation_id: r.outcome for r in closed} == wanted
    assert all((r.ended_at is None) == (r.outcome == "unfinished") and r.url == f"u{r.operation_id}" for r in closed)


def test_stream_without_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    J.run_available(J.stream_errors(stream(spark, tmp_path / "in")), J.update_folder(str(tmp_path / "out")), str(tmp_path / "cp"))
    assert J.read_updates(spark, str(tmp_path / "out"), "bin timestamp, n_errors long", ["bin"]).count() == 0


def test_log_lines(spark, tmp_path):
    put(tmp_path, "in/a.log", '{"timestamp": "2025-01-01T00:00:00", "level": "ERROR"}\nbad\n')
    assert L.log_scan(tables.log_lines(spark, str(tmp_path / "in")), {}).where("corrupt_line is null").count() == 1
    live = L.log_scan(tables.log_line_stream(spark, str(tmp_path / "in")), {}).select("ts", "level", "corrupt_line")
    J.run_available(live, J.update_folder(str(tmp_path / "out")), str(tmp_path / "cp"), "append")
    assert spark.read.parquet(str(tmp_path / "out")).where("level = 'ERROR'").count() == 1
