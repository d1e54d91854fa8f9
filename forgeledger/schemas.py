"""Schemas of the estate's tables. Nothing is inferred at read time."""

PROJECTS = "id BIGINT, name STRING, path STRING, web_url STRING"
PROJECT_DETAILS = (
    "id BIGINT, name STRING, path STRING, description STRING, topics ARRAY<STRING>, visibility STRING, "
    "default_branch STRING, web_url STRING, http_url_to_repo STRING"
)
STATE = "repo STRING, last_commit STRING, branches ARRAY<STRING>, last_sync TIMESTAMP, repo_url STRING"
COMMITS = "repo STRING, sha STRING, parent STRING, parent_no INT"
REFS = "repo STRING, branch STRING, tip STRING"
OP_RESULTS = "url STRING, path STRING, success BOOLEAN, duration DOUBLE, error STRING"
ARCHIVES = (
    "backend STRING, key STRING, filename STRING, size_bytes BIGINT, mtime TIMESTAMP, checksum_sha256 STRING, "
    "archive_type STRING, repository_name STRING, metadata MAP<STRING,STRING>"
)

_DEPENDENCY = "STRUCT<name: STRING, version_spec: STRING>"
MANIFEST = (
    "type STRING, timestamp STRING, "
    "repository STRUCT<name: STRING, path: STRING, remote_url: STRING, head_sha: STRING>, "
    "archive STRUCT<filename: STRING, format: STRING, bundle_file: STRING>, "
    "parent_archive STRING, commit_range STRUCT<`from`: STRING, `to`: STRING>, "
    "lfs_enabled BOOLEAN, lfs_object_count BIGINT, "
    "dependencies MAP<STRING, STRUCT<manifest_file: STRING, dependency_count: BIGINT, "
    f"dependencies: ARRAY<{_DEPENDENCY}>>>"
)
DEPENDENCIES = (
    "repo STRING, manifest STRING, position BIGINT, name STRING, extras ARRAY<STRING>, version_spec STRING, "
    "markers STRING"
)
REGISTRY_JSON = (
    "info STRUCT<name: STRING, version: STRING, requires_dist: ARRAY<STRING>>, "
    "urls ARRAY<STRUCT<packagetype: STRING, url: STRING, digests: STRUCT<sha256: STRING>>>"
)
# The members every log line has, then the extras the reports use. Other members stay in `extras`.
LOG_FIELDS = {
    "timestamp": "STRING",
    "level": "STRING",
    "logger": "STRING",
    "message": "STRING",
    "filename": "STRING",
    "lineno": "BIGINT",
    "exception": "STRING",
}
