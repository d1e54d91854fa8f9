"""Archive catalogue, verification, chains, retention and storage use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.requirements import lines_of, stripped
from ..functions.documents import json_object
from .grouping import order_in_group

# File names, suffixes and report texts.
ARCHIVE_SUFFIX = ".tar.gz"
SIDECAR_SUFFIX = ".meta.json"
ERR_NO_MANIFEST = "manifest.json not found in archive"
ERR_BAD_MANIFEST = "manifest.json is corrupted"
ERR_NO_BUNDLE = "repository.bundle not found in archive"
ERR_BAD_BUNDLE = "Git bundle is invalid: "
ERR_NO_LFS = "lfs-objects directory not found but lfs_enabled is True"
ERR_FIRST_FULL = "First archive must be a full archive"

BYTES_PER_MB = 1_048_576


# --- catalogue -------------------------------------------------------------------------


def archive_listing(objects: DataFrame, sidecars: DataFrame, prefix: str | None = None) -> DataFrame:
    """Archives under a directory prefix with the metadata of their sidecar files.

    ``objects(key, size_bytes, mtime)`` is any object listing, ``sidecars(key, value)`` holds
    sidecar text by sidecar key. Checksums exist only where a sidecar has one.
    """
    found = objects.where(F.endswith(F.col("key"), F.lit(ARCHIVE_SUFFIX)))
    if prefix:
        found = found.where(F.startswith(F.col("key"), F.lit(prefix.rstrip("/") + "/")))
    side = sidecars.select(
        F.regexp_replace("key", r"\.meta\.json$", "").alias("key"),
        F.from_json("value", "MAP<STRING,STRING>").alias("metadata"),
    )
    joined = found.join(side, "key", "left")
    member = {name: F.try_element_at(F.col("metadata"), F.lit(name)) for name in ("checksum_sha256", "archive_type", "repository_name")}
    return joined.select(
        "key",
        F.element_at(F.split("key", "/"), -1).alias("filename"),
        "size_bytes",
        "mtime",
        *[value.alias(name) for name, value in member.items()],
        "metadata",
    )


def catalogue_union(listings: Mapping[str, DataFrame]) -> DataFrame:
    """Listings of several stores under one schema.

    Stores differ in what they report: the time is ``mtime``, ``last_modified`` or
    ``time_created``, and s3 listings carry no checksum. Missing columns become null.
    """
    if not listings:
        raise ValueError("no listings given")
    aligned = []
    for backend, listing in listings.items():
        times = [c for c in ("mtime", "last_modified", "time_created") if c in listing.columns]
        rows = listing.withColumn("mtime", F.coalesce(*times)) if times else listing
        rows = rows.drop("last_modified", "time_created")
        if backend == "s3":
            rows = rows.withColumn("checksum_sha256", F.lit(None).cast("string"))
        aligned.append(rows.withColumn("backend", F.lit(backend)))
    result = aligned[0]
    for rows in aligned[1:]:
        result = result.unionByName(rows, allowMissingColumns=True)
    return result


def archive_exists(requests: DataFrame, catalogue: DataFrame, key: str = "key") -> DataFrame:
    return requests.join(catalogue.select(key), key, "left_semi")


# --- digests ---------------------------------------------------------------------------


def content_sha256(objects: DataFrame, content: str = "content", digest: str = "sha256") -> DataFrame:
    """SHA-256 of every object; the content itself is not carried on."""
    rest = [c for c in objects.columns if c != content]
    return objects.select(*rest, F.sha2(F.col(content).cast("binary"), 256).alias(digest))


def checksum_verify(expected: DataFrame, actual: DataFrame, key: str = "key") -> DataFrame:
    """Whether each expected digest is the actual one. A missing object fails."""
    joined = expected.select(key, F.col("sha256").alias("expected")).join(
        actual.select(key, F.col("sha256").alias("actual")), key, "left"
    )
    return joined.select(key, F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("verified"))


# --- manifests and verdicts ------------------------------------------------------------


def manifest_read(files: DataFrame, text: str = "value") -> DataFrame:
    """Parsed manifests. Text that is not a JSON object is flagged and keeps its row."""
    rest = [c for c in files.columns if c != text]
    # Each text is parsed once: the generator keeps the result as one value.
    valid = json_object(F.col(text)).isNotNull()
    read = F.struct(valid.alias("manifest_valid"), F.from_json(F.col(text), schemas.MANIFEST).alias("manifest"))
    rows = files.select(*rest, F.inline(F.array(read)))
    return rows.withColumn("manifest", F.when(F.col("manifest_valid"), F.col("manifest")))


def archive_verdict(archives: DataFrame, manifests: DataFrame, contents: DataFrame) -> DataFrame:
    """Verdict and error texts per archive.

    ``archives(archive)`` lists what to check; ``manifests`` is ``manifest_read`` output by
    archive; ``contents(archive, bundle_found, bundle_ok, bundle_error, lfs_found,
    lfs_objects)`` summarises the members. Bundle validity is an input column: only the
    version control program can decide it.
    """
    joined = archives.select("archive").join(
        manifests.select("archive", "manifest_valid", "manifest"), "archive", "left"
    ).join(contents, "archive", "left")
    manifest_valid = F.coalesce("manifest_valid", F.lit(False))
    bundle_found = F.coalesce("bundle_found", F.lit(False))
    bundle_valid = bundle_found & F.coalesce("bundle_ok", F.lit(False))
    lfs = manifest_valid & F.coalesce("manifest.lfs_enabled", F.lit(False))
    lfs_found = F.coalesce("lfs_found", F.lit(False))
    actual = F.when(lfs_found, F.coalesce("lfs_objects", F.lit(0))).otherwise(F.lit(0)).cast("long")
    expected = F.coalesce("manifest.lfs_object_count", F.lit(0))
    mismatch = F.concat(
        F.lit("LFS object count mismatch: expected "), expected.cast("string"), F.lit(", found "), actual.cast("string")
    )
    errors = F.array_compact(
        F.array(
            F.when(F.col("manifest_valid").isNull(), F.lit(ERR_NO_MANIFEST)).when(~manifest_valid, F.lit(ERR_BAD_MANIFEST)),
            F.when(~bundle_found, F.lit(ERR_NO_BUNDLE)).when(
                ~bundle_valid, F.concat(F.lit(ERR_BAD_BUNDLE), F.coalesce("bundle_error", F.lit("")))
            ),
            F.when(lfs & ~lfs_found, F.lit(ERR_NO_LFS)).when(lfs & (actual != expected), mismatch),
        )
    )
    return joined.select(
        "archive",
        ((F.size(errors) == 0) & manifest_valid & bundle_valid).alias("valid"),
        errors.alias("errors"),
        manifest_valid.alias("manifest_valid"),
        bundle_valid.alias("bundle_valid"),
        F.when(lfs, lfs_found & (actual == expected)).alias("lfs_objects_verified"),
        F.when(lfs, actual).alias("lfs_object_count"),
    )


# --- chains ----------------------------------------------------------------------------


def chain_positions(archives: DataFrame, chain: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """0-based place of every archive in its chain."""
    return order_in_group(archives, chain, order, "__rank").withColumn("position", F.col("__rank") - 1).drop("__rank")


def chain_validate(positions: DataFrame, chain: Sequence[str], kind: str = "archive_type") -> DataFrame:
    """Per chain: the first archive is full and every later one incremental, or the first error.

    A minimum over the offending positions, so no chain is ever collected.
    """
    position = F.col("position")
    broken = F.when(position == 0, F.col(kind) != "full").otherwise(F.col(kind) != "incremental")
    found = positions.groupBy(*chain).agg(
        F.count(F.lit(1)).alias("n_archives"), F.min(F.when(broken, position)).alias("__bad")
    )
    text = F.when(F.col("__bad") == 0, F.lit(ERR_FIRST_FULL)).when(
        F.col("__bad") > 0,
        F.concat(F.lit("Archive "), F.col("__bad").cast("string"), F.lit(" must be an incremental archive")),
    )
    return found.select(*chain, "n_archives", F.col("__bad").isNull().alias("valid"), text.alias("error"))


def chain_head(archives: DataFrame, chain: Sequence[str], order: Sequence[str], head: str = "head_sha") -> DataFrame:
    """Head after applying a whole chain: that of its last archive."""
    return archives.groupBy(*chain).agg(F.max_by(head, F.struct(*order)).alias("final_head"))


def incremental_base(archives: DataFrame) -> DataFrame:
    """Base commit of each incremental archive, from the parent it names.

    Input ``archives(filename, archive_type, head_sha, parent_archive, range_from)``. The gap
    column (range start differs from the parent's head) is an extension.
    """
    children = archives.where(F.col("archive_type") == "incremental")
    parents = archives.select(
        F.col("filename").alias("parent_archive"), F.col("head_sha").alias("base_commit")
    )
    joined = children.join(parents, "parent_archive", "left")
    return joined.select(
        "filename",
        "parent_archive",
        "base_commit",
        "range_from",
        F.col("head_sha").alias("range_to"),
        F.col("base_commit").isNull().alias("parent_missing"),
        F.coalesce(F.col("range_from") != F.col("base_commit"), F.lit(False)).alias("gap"),
    )


# --- retention -------------------------------------------------------------------------


def _age_days(mtime: str, as_of: datetime) -> Column:
    micros = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(mtime).cast("timestamp"))
    return micros / F.lit(86_400_000_000.0)


def retention(
    archives: DataFrame,
    store: Sequence[str],
    as_of: datetime | None = None,
    max_age_days: float | None = None,
    max_count: int | None = None,
    mtime: str = "mtime",
    key: str = "key",
) -> DataFrame:
    """Every archive with ``delete``: too old (strictly), or not among the newest ``max_count``.

    An archive is kept only when it passes every given rule. Age counts back from ``as_of``; equal times are
    ordered by key, the greater key being the newer. Rows that repeat both count one by one, ordered by a hash of all
    their columns: of three equal rows and ``max_count=1`` two are deleted.
    """
    if max_age_days is None and max_count is None:
        raise ValueError("At least one of max_age_days or max_count must be specified")
    if max_age_days is not None and as_of is None:
        raise ValueError("as_of is needed with max_age_days")
    too_old = F.lit(False) if max_age_days is None else _age_days(mtime, as_of) > max_age_days
    if max_count is None:
        return archives.withColumn("delete", too_old)
    if max_count <= 0:
        return archives.withColumn("delete", F.lit(True))
    tie = F.xxhash64(*[name for name, kind in archives.dtypes if "map<" not in kind])
    ranked = order_in_group(archives, list(store), [mtime, key, tie], "__rank", backwards=True)
    return ranked.withColumn("delete", too_old | (F.col("__rank") > max_count)).drop("__rank")


def retention_summary(decisions: DataFrame, store: Sequence[str]) -> DataFrame:
    return decisions.groupBy(*store).agg(
        F.count_if(F.col("delete")).alias("deleted_count"), F.count_if(~F.col("delete")).alias("kept_count")
    )


# --- storage ---------------------------------------------------------------------------


def lfs_inventory(objects: DataFrame, key: str = "repo", size: str = "size_bytes") -> DataFrame:
    return objects.groupBy(key).agg(F.count(F.lit(1)).alias("object_count"), F.sum(size).alias("total_bytes"))


def storage_usage(objects: DataFrame, key: str = "repo", size: str = "size_bytes") -> DataFrame:
    """Bytes and megabytes per repository, halves rounded to even."""
    total = objects.groupBy(key).agg(F.sum(size).alias("total_size_bytes"))
    return total.withColumn("total_size_mb", F.bround(F.col("total_size_bytes") / BYTES_PER_MB, 2))


def transfer_estimate(sizes: DataFrame, mb_per_second: float, size_mb: str = "size_mb") -> DataFrame:
    """Seconds, minutes and a short text for moving each row's megabytes."""
    seconds = F.col(size_mb) / F.lit(float(mb_per_second))
    minutes = seconds / 60
    whole = minutes.cast("long")
    text = (
        F.when(minutes < 1, F.concat(seconds.cast("long").cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(whole.cast("string"), F.lit("m")))
        .otherwise(
            F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (whole % 60).cast("string"), F.lit("m"))
        )
    )
    return sizes.select("*", seconds.alias("seconds"), minutes.alias("minutes"), text.alias("readable"))


def archive_name_parse(archives: DataFrame, filename: str = "filename") -> DataFrame:
    """Repository, type and time from ``{repo}-{type}-{yyyyMMdd-HHmmss}.tar.gz``; null if it does not fit."""
    pattern = r"^(.+)-(full-deps|full|incremental)-(\d{8}-\d{6})\.tar\.gz$"

    def group(n: int) -> Column:
        return F.nullif(F.regexp_extract(filename, pattern, n), F.lit(""))

    return archives.select(
        "*",
        group(1).alias("parsed_repo"),
        group(2).alias("parsed_type"),
        F.try_to_timestamp(group(3), F.lit("yyyyMMdd-HHmmss")).cast("timestamp_ntz").alias("parsed_time"),
    )


def lfs_dedupe(objects: DataFrame, digest: str = "sha256", size: str = "size_bytes") -> DataFrame:
    """Copies and bytes saved per content held more than once.

    Extension: stated as a requirement, with no implementation to compare with.
    """
    copies = objects.groupBy(digest, size).agg(F.count(F.lit(1)).alias("copies"))
    return copies.where("copies > 1").select(
        digest, "copies", ((F.col("copies") - 1) * F.col(size)).alias("saved_bytes")
    )


def lfs_unreferenced(objects: DataFrame, references: DataFrame, key: str = "oid") -> DataFrame:
    """Objects that no commit refers to: the candidates for pruning."""
    return objects.join(references.select(key), key, "left_anti")


def lfs_patterns(files: DataFrame, key: str = "repo", text: str = "text") -> DataFrame:
    """Tracked patterns of attribute files, one row each, comment lines skipped."""
    lines = files.select(key, F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))
    line = stripped(F.col("line"))
    return (
        lines.select(key, "line_no", line.alias("line"))
        .where(~F.startswith(F.col("line"), F.lit("#")) & F.contains(F.col("line"), F.lit("filter=lfs")))
        .select(key, "line_no", F.split("line", r"\s+")[0].alias("pattern"))
    )


def lfs_enabled(files: DataFrame, key: str = "repo", text: str = "text") -> DataFrame:
    """The enabled flag looks at the raw text, comments included, unlike the pattern list."""
    return files.select(key, F.contains(F.col(text), F.lit("filter=lfs")).alias("lfs_enabled"))
