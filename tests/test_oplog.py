from datetime import datetime

import pytest
from pyspark.sql import functions as F

from forgeledger.operators import oplog as L

LINES = [
    '{"timestamp": "2025-10-13T15:30:00.123", "level": "INFO", "logger": "a", "message": "m", "filename": "f.py", "lineno": 7, "session_id": "s", "depth": {"x": [1]}}',
    '{"timestamp": "2025-10-13T15:30:01", "level": "ERROR", "logger": "a", "message": "n", "filename": "f.py", "lineno": 8, "exception": "Traceback", "duration": "long"}',
    '{"timestamp": "2025-10-13T15:30:02", "duration": 2.5, "lineno": "x"}',
    "not json",
    "[1, 2]",
    "",
    "3",
]


def test_log_scan(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "i int, value string")
    got = L.log_scan(lines, {"session_id": "STRING", "duration": "DOUBLE"}).orderBy("i").select(
        "*", F.try_variant_get("record", "$.depth.x[0]", "int").alias("deep")
    ).collect()
    assert [r.ts for r in got[:3]] == [datetime(2025, 10, 13, 15, 30, 0, 123000), datetime(2025, 10, 13, 15, 30, 1), datetime(2025, 10, 13, 15, 30, 2)]
    assert (got[0].lineno, got[0].session_id, got[0].deep, got[0].exception) == (7, "s", 1, None)
    assert (got[1].exception, got[1].duration, got[2].duration, got[2].lineno) == ("Traceback", None, 2.5, None)
    assert [r.corrupt_line for r in got] == [None, None, None, *LINES[3:]]
    assert all(r.level is None and r.record is None for r in got[3:])


def log(spark, *entries):
    schema = (
        "event_id int, t string, repository string, level string, message string, status string, duration_seconds double, "
        "commits_synced int, branches_synced int"
    )
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], schema)
    return df.withColumn("ts", F.to_timestamp_ntz("t")).withColumn("session_id", F.lit("s"))


@pytest.fixture(scope="module")
def logs(spark):
    return log(
        spark,
        ("2025-01-01 00:00:01", "a", "INFO", L.SYNC_COMPLETED, "success", 2.0, 10, 1),
        ("2025-01-01 00:04:59", "a", "INFO", L.SYNC_COMPLETED, "success", 3.0, 30, 2),
        ("2025-01-01 00:05:00", "b", "ERROR", L.SYNC_FAILED, "failure", 20.0, None, None),
        ("2025-01-01 00:05:01", "b", "INFO", L.SYNC_COMPLETED, "success", 4.0, 30, 3),
        ("2025-01-01 00:12:00", "c", "ERROR", L.SYNC_FAILED, "failure", 1.0, None, None),
        ("2025-01-01 00:13:00", "d", "INFO", "Cloning", None, 99.0, 5, 5),
    )


def at(minute):
    return datetime(2025, 1, 1, 0, minute)


def test_averages_and_bins(logs, rows):
    assert rows(L.avg_duration_by_repo(logs)) == [("a", 2.5), ("b", 4.0)]
    assert rows(L.avg_sync_time(logs)) == [(3.0,)]
    assert rows(L.errors_per_bin(logs)) == [(at(10), 1), (at(5), 1)]
    assert rows(L.duration_timechart(logs, "5 minutes")) == [(at(0), "a", 2.5), (at(5), "b", 4.0)]
    assert rows(L.success_rate(logs)) == [(at(0), 2, 0, 1.0), (at(10), 0, 1, 0.0), (at(5), 1, 1, 0.5)]
    assert L.avg_sync_time(logs.limit(0)).first()[0] is None


def test_counts_and_filters(logs, rows):
    assert [r.event_id for r in L.top_commits(logs, 2).collect()] == [1, 3]
    assert rows(L.status_counts(logs)) == [("failure", 2), ("success", 3), (None, 1)]
    assert rows(L.failed_repos(logs)) == [("b",), ("c",)]
    assert rows(L.slow_operations(logs), "event_id") == [(2,), (5,)]
    assert rows(L.counter_totals(logs)) == [("a", 2, 0, 1, 40, 3), ("b", 1, 1, 1, 30, 3), ("c", 0, 1, 0, 0, 0), (None, 3, 2, 2, 70, 6)]
    assert rows(L.session_rollup(logs)) == [("s", 3, 3, 2, 70, 6, 779.0)]
    assert rows(L.error_table(logs.withColumn("error_type", F.lit("NetworkError"))), "repository") == [("b",), ("c",)]


@pytest.mark.parametrize("outcomes, expected", [([True, True, False], (3, 2, 1, 66.67)), ([], (0, 0, 0, 0.0)), ([True] + [False] * 799, (800, 1, 799, 0.12))])
def test_outcome_summary(spark, outcomes, expected):
    results = spark.createDataFrame([(o,) for o in outcomes], "success boolean")
    assert tuple(L.outcome_summary(results).first()) == expected


def test_search_and_audit(spark, rows):
    df = spark.createDataFrame([("a", "x done", "clone", "2025-01-01"), ("b", "x done", "push", "2025-01-01"), ("a", "y", "other", "2025-01-02")], "logger string, message string, operation string, t string").withColumn("ts", F.to_timestamp_ntz("t"))
    assert L.log_search(df, "a", "done").count() == 1 and L.log_search(df, text="x").count() == 2
    assert rows(L.audit_counts(df), "operation", "n") == [("clone", 1), ("push", 1)]
    assert L.audit_counts(df, L.ARCHIVE_AUDIT).isEmpty()


def test_alerts(spark, rows):
    df = spark.createDataFrame(
        [(1, False, 20000.0, 1.0), (2, True, 10000.0, 3601.0), (3, None, None, None)],
        "i int, checksum_verification boolean, archive_size_mb double, operation_duration_seconds double",
    )
    assert rows(L.threshold_alerts(df), "i", "alert", "severity") == [(1, "checksum_mismatch", "critical"), (1, "large_archive", "warning"), (2, "slow_operation", "warning")]


def test_errors_and_retries(spark, rows):
    df = spark.createDataFrame([("NetworkError", True), ("NetworkError", False), ("StorageError", True), ("Other", None), (None, True)], "error_type string, retryable boolean")
    assert rows(L.error_type_breakdown(df)) == [("NetworkError", 2, 1, 0.5), ("Other", 1, 0, 0.0), ("StorageError", 1, 0, 0.0)]
    assert rows(L.error_type_breakdown(df.drop("retryable")))[0] == ("NetworkError", 2, 2, 1.0)
    waits = spark.createDataFrame([("a", i) for i in range(8)], "op string, attempt int")
    assert rows(L.retry_backoff_cost(waits, ["op"])) == [("a", 8, 183.0, 91.5)]
    assert rows(L.retry_backoff_cost(waits, ["op"], jitter=False, longest=2))[0][2:] == (15.0, 15.0)
    tried = spark.createDataFrame([("a", 1), ("a", 3), ("b", None), ("b", 0)], "repository string, retry_attempt int")
    assert rows(L.retry_attempts(tried)) == [("a", 2, 3), ("b", 1, 0)]


def test_size_trend(spark, rows):
    df = spark.createDataFrame(
        [(1, "full", "2025-01-01 00:00:00", 100), (2, "full", "2025-01-01 00:00:50", 400), (3, "full", "2025-01-01 01:00:00", 9)],
        "event_id int, archive_type string, t string, size_bytes long",
    ).withColumn("ts", F.to_timestamp_ntz("t"))
    assert rows(L.archive_size_trend(df), "bytes_per_second") == [(6.0,), (None,)]


def test_stages(spark, rows):
    df = spark.createDataFrame([("s", "clone", 3.2), ("s", "clone", 0.1), ("s", "other", 9.0), ("t", "upload", 15.2)], "session_id string, operation string, duration_seconds double")
    assert rows(L.stage_timings(df, ["clone", "upload"])) == [("s", 3.3, 0.0), ("t", 0.0, 15.2)]


@pytest.mark.parametrize("large", [False, True])
def test_pairing(spark, rows, large, request):
    if large:
        request.getfixturevalue("many_slices")
    states = "started completed started failed started started completed failed started".split()
    df = spark.createDataFrame([("u", i, s) for i, s in enumerate(states)], "url string, i int, state string").withColumn("ts", F.timestamp_seconds(F.col("i") * F.col("i")))
    got = L.operation_pairing(df, [F.col("ts")]).orderBy("started_at").collect()
    assert [(r.outcome, r.duration_seconds) for r in got] == [("completed", 1.0), ("failed", 5.0), ("unfinished", None), ("completed", 11.0), ("unfinished", None)]


def test_secrets(spark, rows):
    df = spark.createDataFrame([(1, "my PASSWORD and ApiKey"), (2, "api-key\ntoken"), (3, "x" * 100_000 + "secret"), (4, "none")], "id int, text string")
    assert rows(L.secret_scan(df, "id")) == [(1, "api_key"), (1, "password"), (2, "api_key"), (2, "token"), (3, "secret")]
    assert rows(L.secret_counts(df, "id")) == [("api_key", 2), ("password", 1), ("secret", 1), ("token", 1)]


def test_context(spark, rows):
    logs = spark.createDataFrame([(1, "s", 10, "line"), (2, "s", None, "line"), (3, None, None, "line")], "i int, session_id string, operation_id int, user string")
    sessions = spark.createDataFrame([("s", "outer", "prod")], "session_id string, user string, env string")
    operations = spark.createDataFrame([(10, "inner", None)], "operation_id int, user string, env string")
    assert rows(L.context_enrich(logs, sessions, operations, ["user", "env"]), "i", "user", "env") == [(1, "inner", "prod"), (2, "outer", "prod"), (3, "line", None)]
