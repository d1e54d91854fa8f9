"""Reports over structured operation logs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.documents import json_object
from .grouping import with_previous

# The message of a finished sync, alert rules, secret patterns, error classes.
SYNC_COMPLETED = "Repository sync completed"
SYNC_FAILED = "Repository sync failed"

SECRET_PATTERNS = {
    "token": "(?i)token",
    "password": "(?i)password",
    "secret": "(?i)secret",
    "api_key": "(?i)api[_-]?key",
}

ERROR_CLASSES = {
    "AuthenticationError": False,
    "ConfigurationError": False,
    "GitOperationError": False,
    "NetworkError": True,
    "StorageError": False,
    "ArchiveError": False,
    "SyncConflictError": False,
}

# name -> (severity, condition)
ALERT_RULES = {
    "checksum_mismatch": ("critical", "checksum_verification = false"),
    "large_archive": ("warning", "archive_size_mb > 10000"),
    "slow_operation": ("warning", "operation_duration_seconds > 3600"),
}

SYNC_AUDIT = ("clone", "push", "create_repository", "delete_repository")
ARCHIVE_AUDIT = (
    "archive_created",
    "archive_uploaded",
    "archive_downloaded",
    "archive_extracted",
    "repository_pushed",
    "dependency_installed",
)


def exact_mean(column: str) -> Column:
    """Mean that does not depend on the order of the rows: summed as a decimal."""
    return F.sum(F.col(column).cast("decimal(18,4)")).cast("double") / F.count(column)


def window_start(ts: str, width: str = "5 minutes") -> Column:
    return F.window(ts, width)["start"]


def completed(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("message") == SYNC_COMPLETED)


# --- reading ---------------------------------------------------------------------------


def log_scan(lines: DataFrame, extras: Mapping[str, str], text: str = "value") -> DataFrame:
    """Log lines as a typed table.

    ``extras`` maps further members to their types; a member that cannot be read as its type
    becomes null. All members of the line stay reachable in ``record`` (a VARIANT). Lines
    that are not JSON objects have null members and keep their text in ``corrupt_line``.
    """
    # The generator keeps the parsed line as one value; as a plain column it would be parsed
    # again for every member below.
    parsed = lines.select("*", F.explode(F.array(json_object(F.col(text)))).alias("record"))
    fields = {**schemas.LOG_FIELDS, **extras}
    rest = [c for c in lines.columns if c != text]
    members = [
        F.try_variant_get("record", f"$['{name}']", kind.lower()).alias(name)
        for name, kind in fields.items()
        if name != "timestamp"
    ]
    # Times carry no zone, and no fraction when it is zero.
    ts = F.try_variant_get("record", "$.timestamp", "string").try_cast("timestamp_ntz").alias("ts")
    return parsed.select(
        *rest, ts, *members, "record", F.when(F.col("record").isNull(), F.col(text)).alias("corrupt_line")
    )


def context_enrich(
    logs: DataFrame, sessions: DataFrame, operations: DataFrame, fields: Sequence[str],
    session_key: str = "session_id", operation_key: str = "operation_id",
) -> DataFrame:
    """Attach context fields to lines: the operation's value, else the session's, else the line's."""
    outer = sessions.select(session_key, *[F.col(f).alias(f"__outer_{f}") for f in fields])
    inner = operations.select(operation_key, *[F.col(f).alias(f"__inner_{f}") for f in fields])
    joined = logs.join(outer, session_key, "left").join(inner, operation_key, "left")
    rest = [c for c in logs.columns if c not in fields]

    def value(name: str) -> Column:
        layers = [f"__inner_{name}", f"__outer_{name}", *([name] if name in logs.columns else [])]
        return F.coalesce(*layers).alias(name)

    return joined.select(*rest, *[value(f) for f in fields])


# --- filters ---------------------------------------------------------------------------


def log_search(logs: DataFrame, logger: str | None = None, text: str | None = None) -> DataFrame:
    found = logs
    if logger is not None:
        found = found.where(F.col("logger") == logger)
    if text is not None:
        found = found.where(F.contains(F.col("message"), F.lit(text)))
    return found


def error_table(logs: DataFrame) -> DataFrame:
    return logs.where("level = 'ERROR'").select("ts", "repository", "error_type", "message")


def failed_repos(logs: DataFrame) -> DataFrame:
    return logs.where("status = 'failure'").select("repository").distinct()


def slow_operations(logs: DataFrame, seconds: float = 10) -> DataFrame:
    return logs.where(F.col("duration_seconds") > seconds)


# --- rates and averages ----------------------------------------------------------------


def avg_duration_by_repo(logs: DataFrame) -> DataFrame:
    return completed(logs).groupBy("repository").agg(exact_mean("duration_seconds").alias("avg_duration"))


def avg_sync_time(logs: DataFrame) -> DataFrame:
    return completed(logs).agg(exact_mean("duration_seconds").alias("avg_duration"))


def errors_per_bin(logs: DataFrame, width: str = "5 minutes") -> DataFrame:
    errors = logs.where("level = 'ERROR'")
    return errors.groupBy(window_start("ts", width).alias("bin")).agg(F.count(F.lit(1)).alias("n_errors"))


def duration_timechart(logs: DataFrame, width: str = "1 day") -> DataFrame:
    return completed(logs).groupBy(window_start("ts", width).alias("bin"), "repository").agg(
        exact_mean("duration_seconds").alias("avg_duration")
    )


def success_rate(logs: DataFrame, width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """success / (success + failure) per window; windows without an outcome have no row."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    good, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failure")
    outcomes = logs.where("status in ('success', 'failure')")
    counts = outcomes.groupBy(window["start"].alias("bin")).agg(good.alias("n_success"), bad.alias("n_failure"))
    return counts.withColumn("success_rate", F.col("n_success") / (F.col("n_success") + F.col("n_failure")))


def archive_size_trend(
    samples: DataFrame, width: str = "1 hour", key: str = "archive_type", order: str = "event_id"
) -> DataFrame:
    """Change of the archive size gauge per second within each window; null for a single sample."""
    first, last = F.min(F.struct("ts", order, "size_bytes")), F.max(F.struct("ts", order, "size_bytes"))
    ends = samples.groupBy(key, window_start("ts", width).alias("bin")).agg(first.alias("a"), last.alias("b"))
    micros = F.unix_micros(F.col("b.ts").cast("timestamp")) - F.unix_micros(F.col("a.ts").cast("timestamp"))
    change = (F.col("b.size_bytes") - F.col("a.size_bytes")).cast("double")
    return ends.select(key, "bin", F.when(micros > 0, change / (micros / F.lit(1_000_000.0))).alias("bytes_per_second"))


# --- counts ----------------------------------------------------------------------------


def status_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def top_commits(logs: DataFrame, n: int = 10, tiebreak: str = "event_id") -> DataFrame:
    """The ``n`` syncs with most commits. Each task keeps only its own top n."""
    ordered = completed(logs).orderBy(F.col("commits_synced").desc_nulls_last(), F.col(tiebreak).asc())
    return ordered.select("repository", "commits_synced", tiebreak).limit(n)


def retry_attempts(logs: DataFrame) -> DataFrame:
    retried = logs.where("retry_attempt is not null")
    return retried.groupBy("repository").agg(
        F.count(F.lit(1)).alias("n_retries"), F.max("retry_attempt").alias("max_attempt")
    )


def outcome_summary(results: DataFrame) -> DataFrame:
    """total, successful, failed and the success rate in percent, 0.0 for no results."""
    counted = results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("success")).alias("successful"))
    rate = F.when(F.col("total") > 0, F.bround(F.col("successful") / F.col("total") * 100, 2)).otherwise(F.lit(0.0))
    return counted.select(
        "total", "successful", (F.col("total") - F.col("successful")).alias("failed"), rate.alias("success_rate")
    )


def counter_totals(logs: DataFrame) -> DataFrame:
    """Success and failure totals, commits and branches: per repository and overall.

    The overall row has a null repository and also counts the repositories. Repositories are
    reduced first, so the overall row adds up one row per repository.
    """
    outcomes = logs.where("status in ('success', 'failure')")
    per_repo = outcomes.groupBy("repository").agg(
        F.count_if(F.col("status") == "success").alias("success_total"),
        F.count_if(F.col("status") == "failure").alias("failure_total"),
        F.sum(F.when(F.col("status") == "success", F.col("commits_synced"))).alias("commits"),
        F.sum(F.when(F.col("status") == "success", F.col("branches_synced"))).alias("branches"),
    )
    zero = F.lit(0).cast("long")
    return per_repo.groupingSets([["repository"], []], "repository").agg(
        F.sum("success_total").alias("sync_success_total"),
        F.sum("failure_total").alias("sync_failure_total"),
        F.count_if(F.col("success_total") > 0).alias("repositories_synced_total"),
        F.coalesce(F.sum("commits"), zero).alias("commits_synced_total"),
        F.coalesce(F.sum("branches"), zero).alias("branches_synced_total"),
    )


def archive_bytes_by_type(archives: DataFrame) -> DataFrame:
    return archives.groupBy("archive_type").agg(F.sum("size_bytes").alias("archive_size_bytes"))


def audit_counts(logs: DataFrame, operations: Iterable[str] = SYNC_AUDIT, width: str = "1 day") -> DataFrame:
    audited = logs.where(F.col("operation").isin(*operations))
    return audited.groupBy(window_start("ts", width).alias("bin"), "operation").agg(F.count(F.lit(1)).alias("n"))


# --- alerts, errors and retries --------------------------------------------------------


def threshold_alerts(rows: DataFrame, rules: Mapping[str, tuple[str, str]] = ALERT_RULES) -> DataFrame:
    """One row per (row, matching rule). Works the same on a stream."""
    hits = [
        F.when(F.expr(condition), F.struct(F.lit(name).alias("alert"), F.lit(severity).alias("severity")))
        for name, (severity, condition) in rules.items()
    ]
    return rows.select("*", F.explode(F.array_compact(F.array(*hits))).alias("__hit")).select(
        *rows.columns, "__hit.alert", "__hit.severity"
    )


def error_type_breakdown(logs: DataFrame) -> DataFrame:
    """Count per error class and the share that a retry can help.

    Only network errors are retried, unless a line marks its error as not retryable.
    """
    classes = [F.lit(x) for pair in ERROR_CLASSES.items() for x in pair]
    retried = F.coalesce(F.try_element_at(F.create_map(*classes), F.col("error_type")), F.lit(False))
    flagged = F.coalesce("retryable", F.lit(True)) if "retryable" in logs.columns else F.lit(True)
    counts = logs.where("error_type is not null").groupBy("error_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(retried & flagged).alias("n_retryable")
    )
    return counts.withColumn("retryable_share", F.col("n_retryable") / F.col("n"))


def retry_backoff_cost(
    retries: DataFrame, keys: Sequence[str], attempt: str = "attempt",
    initial: float = 1.0, factor: float = 2.0, longest: float = 60.0, jitter: bool = True,
) -> DataFrame:
    """Scheduled waiting per operation; attempts count from 0. Jitter scales a wait by [0.5, 1)."""
    delay = F.least(F.lit(initial) * F.pow(F.lit(factor), F.col(attempt)), F.lit(longest))
    waits = retries.withColumn("__wait", delay.cast("decimal(18,4)"))
    total = waits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_waits"), F.sum("__wait").cast("double").alias("wait_high")
    )
    low = F.col("wait_high") * 0.5 if jitter else F.col("wait_high")
    return total.withColumn("wait_low", low)


def secret_scan(texts: DataFrame, key: str, text: str = "text", patterns: Mapping[str, str] = SECRET_PATTERNS) -> DataFrame:
    """One row per (row, pattern found in its text)."""
    hits = [F.when(F.col(text).rlike(regex), F.lit(name)) for name, regex in patterns.items()]
    return texts.select(key, text).select(key, F.explode(F.array_compact(F.array(*hits))).alias("pattern"))


def secret_counts(texts: DataFrame, key: str, text: str = "text", patterns: Mapping[str, str] = SECRET_PATTERNS) -> DataFrame:
    return secret_scan(texts, key, text, patterns).groupBy("pattern").agg(F.count(F.lit(1)).alias("n_rows"))


# --- sessions and operations -----------------------------------------------------------


def session_rollup(logs: DataFrame, key: str = "session_id") -> DataFrame:
    """Repositories, outcomes, commits, branches and elapsed seconds per session.

    Repositories are counted from (session, repository) rows, which combine before the
    shuffle and spread one very long session over many tasks.
    """
    status = F.col("status")
    seconds = (
        F.unix_micros(F.max("last").cast("timestamp")) - F.unix_micros(F.min("first").cast("timestamp"))
    ) / F.lit(1_000_000.0)
    per_repo = logs.groupBy(key, "repository").agg(
        F.count_if(status == "success").alias("good"),
        F.count_if(status == "failure").alias("bad"),
        F.sum(F.when(status == "success", F.col("commits_synced"))).alias("commits"),
        F.sum(F.when(status == "success", F.col("branches_synced"))).alias("branches"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
    zero = F.lit(0).cast("long")
    return per_repo.groupBy(key).agg(
        F.count_if((F.col("good") > 0) | (F.col("bad") > 0)).alias("total_repos"),
        F.sum("good").alias("successful"),
        F.sum("bad").alias("failed"),
        F.coalesce(F.sum("commits"), zero).alias("total_commits"),
        F.coalesce(F.sum("branches"), zero).alias("total_branches"),
        seconds.alias("elapsed_seconds"),
    )


def stage_timings(logs: DataFrame, stages: Sequence[str], key: str = "session_id") -> DataFrame:
    """One row per session with one duration column per stage, zero for a stage that did not run."""
    amount = F.col("duration_seconds").cast("decimal(18,4)")
    return logs.groupBy(key).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("operation") == stage, amount)).cast("double"), F.lit(0.0)).alias(f"{stage}_duration")
            for stage in stages
        ],
    )


def operation_pairing(notices: DataFrame, order: Sequence[Column], key: str = "url") -> DataFrame:
    """One row per started operation: duration and outcome of the notice after it.

    ``notices(url, state, ts, ...)`` holds started, completed and failed notices. A start that
    is followed by another start, or by nothing, is unfinished.
    """
    following = with_previous(notices, [key], order, {"state": "next_state", "ts": "next_ts"}, following=True)
    done = F.coalesce(F.col("next_state").isin("completed", "failed"), F.lit(False))
    micros = F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return following.where("state = 'started'").select(
        key,
        F.col("ts").alias("started_at"),
        F.when(done, F.col("next_state")).otherwise("unfinished").alias("outcome"),
        F.when(done, micros / F.lit(1_000_000.0)).alias("duration_seconds"),
    )
