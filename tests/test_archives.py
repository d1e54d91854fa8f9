from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from forgeledger.operators import archives as A

NOW = datetime(2025, 1, 31, 12)


def aged(spark, ages, store="s"):
    return spark.createDataFrame(
        [(store, f"a{i:02}.tar.gz", NOW - timedelta(days=d)) for i, d in enumerate(ages)], "store string, key string, mtime timestamp"
    )


def deleted(df):
    return sorted(r.key[1:3] for r in df.where("delete").collect())


@pytest.mark.parametrize(
    "options, expected",
    [
        ({"max_age_days": 25, "max_count": 2}, ["02", "03", "04"]),
        ({"max_age_days": 25}, ["03", "04"]),
        ({"max_age_days": 20}, ["03", "04"]),
        ({"max_age_days": 19.5}, ["02", "03", "04"]),
        ({"max_count": 2}, ["02", "03", "04"]),
        ({"max_count": 5}, []),
        ({"max_count": 9}, []),
        ({"max_count": 0}, ["00", "01", "02", "03", "04"]),
        ({"max_age_days": 0, "max_count": 4}, ["01", "02", "03", "04"]),
    ],
)
def test_retention(spark, options, expected):
    decided = A.retention(aged(spark, [0, 10, 20, 30, 40]), ["store"], NOW, **options)
    assert deleted(decided) == expected
    assert decided.count() == 5
    summary = A.retention_summary(decided, ["store"]).first()
    assert (summary.deleted_count, summary.kept_count) == (len(expected), 5 - len(expected))


def test_retention_needs_a_rule_and_a_date(spark):
    with pytest.raises(ValueError):
        A.retention(aged(spark, [1]), ["store"], NOW)
    with pytest.raises(ValueError):
        A.retention(aged(spark, [1]), ["store"], max_age_days=1)


def test_equal_times_keep_the_greater_key_and_stores_are_separate(spark):
    df = aged(spark, [1, 1, 1]).union(aged(spark, [5], "t")).union(aged(spark, [5], None))
    decided = A.retention(df, ["store"], max_count=1)
    assert sorted((r.store or "", r.key[1:3]) for r in decided.where("delete").collect()) == [("s", "00"), ("s", "01")]


def test_counts_of_any_size_take_one_path(many_slices):
    df = aged(many_slices, range(1500))
    for count in (1, 999, 1000, 1001, 1499, 1500):
        assert A.retention(df, ["store"], max_count=count).where("delete").count() == 1500 - count


@pytest.mark.parametrize("count", [1, 2, 3, 5, 1001])
def test_repeated_rows_at_the_cut_count_one_by_one(many_slices, count):
    df = aged(many_slices, [7, 7, 3]).withColumn("key", F.lit("same"))
    df = df.unionAll(df.where("store = 's'")).withColumn("note", F.lit("n"))
    decided = A.retention(df, ["store"], max_count=count)
    assert decided.where("delete").count() == max(0, 6 - count)
    ages = [r.mtime for r in decided.where("not delete").collect()]
    assert sorted(ages, reverse=True) == sorted((r.mtime for r in df.collect()), reverse=True)[:count]


@pytest.fixture
def verdicts(spark):
    def run(manifest, bundle_found=True, bundle_ok=True, lfs_found=False, lfs=0):
        archives = spark.createDataFrame([(1,)], "archive int")
        files = spark.createDataFrame([(1, manifest)] if manifest is not None else [], "archive int, value string")
        members = spark.createDataFrame(
            [(1, bundle_found, bundle_ok, "boom", lfs_found, lfs)],
            "archive int, bundle_found boolean, bundle_ok boolean, bundle_error string, lfs_found boolean, lfs_objects long",
        )
        return A.archive_verdict(archives, A.manifest_read(files), members).first()

    return run


FULL = '{"type": "full", "lfs_enabled": %s, "lfs_object_count": 2}'


@pytest.mark.parametrize(
    "arguments, errors",
    [
        ((FULL % "false",), []),
        ((FULL % "true", True, True, True, 2), []),
        ((FULL % "true", True, True, True, 3), ["LFS object count mismatch: expected 2, found 3"]),
        ((FULL % "true",), [A.ERR_NO_LFS]),
        (('{"lfs_enabled": true}', True, True, True, 1), ["LFS object count mismatch: expected 0, found 1"]),
        (('{"lfs_enabled": true}', True, True, True, 0), []),
        ((None,), [A.ERR_NO_MANIFEST]),
        (("{broken",), [A.ERR_BAD_MANIFEST]),
        ((FULL % "false", False), [A.ERR_NO_BUNDLE]),
        ((FULL % "false", True, False), [A.ERR_BAD_BUNDLE + "boom"]),
        ((None, False), [A.ERR_NO_MANIFEST, A.ERR_NO_BUNDLE]),
    ],
)
def test_verdict(verdicts, arguments, errors):
    got = verdicts(*arguments)
    assert (got.valid, got.errors) == (not errors, errors)
    lfs = arguments[0] is not None and '"lfs_enabled": true' in arguments[0]
    assert (got.lfs_objects_verified is not None) == lfs


def test_archive_without_any_content(spark):
    archives = spark.createDataFrame([(7,)], "archive int")
    members = spark.createDataFrame([], "archive int, bundle_found boolean, bundle_ok boolean, bundle_error string, lfs_found boolean, lfs_objects long")
    manifests = A.manifest_read(spark.createDataFrame([], "archive int, value string"))
    assert A.archive_verdict(archives, manifests, members).first().errors == [A.ERR_NO_MANIFEST, A.ERR_NO_BUNDLE]


def test_manifest_members(spark):
    text = (
        '{"type": "incremental", "repository": {"name": "n", "head_sha": "h"}, "parent_archive": "p.tar.gz", '
        '"commit_range": {"from": "a", "to": "b"}, "dependencies": {"python": {"manifest_file": "requirements.txt", '
        '"dependency_count": 1, "dependencies": [{"name": "x", "version_spec": ">=1"}]}}, "other": 1}'
    )
    row = A.manifest_read(spark.createDataFrame([("k", text), ("j", "[1")], "key string, value string")).orderBy("key").collect()
    assert (row[0].manifest_valid, row[0].manifest) == (False, None)
    manifest = row[1].manifest
    assert (manifest.commit_range["from"], manifest.repository.head_sha, manifest.lfs_object_count) == ("a", "h", None)
    assert manifest.dependencies["python"].dependencies[0].version_spec == ">=1"


@pytest.mark.parametrize(
    "kinds, error",
    [
        ("full incremental incremental", None),
        ("incremental full", A.ERR_FIRST_FULL),
        ("full incremental full full", "Archive 2 must be an incremental archive"),
        ("full", None),
    ],
)
def test_chains(spark, kinds, error):
    df = spark.createDataFrame([("c", i, k, f"h{i}") for i, k in enumerate(kinds.split())], "chain string, t int, archive_type string, head_sha string")
    got = A.chain_validate(A.chain_positions(df, ["chain"], [F.col("t")]), ["chain"]).first()
    assert (got.valid, got.error, got.n_archives) == (error is None, error, len(kinds.split()))
    assert A.chain_head(df, ["chain"], ["t"]).first().final_head == f"h{len(kinds.split()) - 1}"


def test_incremental_base(spark, rows):
    df = spark.createDataFrame(
        [("f", "full", "1", None, None), ("i1", "incremental", "2", "f", "1"), ("i2", "incremental", "3", "i1", "1"), ("i3", "incremental", "4", "lost", "3")],
        "filename string, archive_type string, head_sha string, parent_archive string, range_from string",
    )
    assert rows(A.incremental_base(df), "filename", "base_commit", "range_to", "parent_missing", "gap") == [
        ("i1", "1", "2", False, False), ("i2", "2", "3", False, True), ("i3", None, "4", True, False)
    ]


def test_listing(spark, rows):
    objects = spark.createDataFrame(
        [("p/a.tar.gz", 1), ("p/q/b.tar.gz", 2), ("pp/c.tar.gz", 3), ("p/a.tar.gz.meta.json", 9), ("p/n.zip", 9)], "key string, size_bytes long"
    ).withColumn("mtime", F.lit(NOW))
    side = spark.createDataFrame([("p/a.tar.gz.meta.json", '{"archive_type": "full", "checksum_sha256": "c", "n": 1}')], "key string, value string")
    got = A.archive_listing(objects, side, "p")
    assert rows(got, "key", "filename", "archive_type", "checksum_sha256") == [("p/a.tar.gz", "a.tar.gz", "full", "c"), ("p/q/b.tar.gz", "b.tar.gz", None, None)]
    assert got.where("key = 'p/a.tar.gz'").first().metadata == {"archive_type": "full", "checksum_sha256": "c", "n": "1"}
    assert A.archive_listing(objects, side).count() == 3


def test_union_of_backends(spark, rows):
    local = spark.createDataFrame([("a", 1, "x")], "key string, mtime int, checksum_sha256 string")
    azure = spark.createDataFrame([("b", 2)], "key string, last_modified int")
    both = A.catalogue_union({"local": local, "s3": local, "azure": azure})
    assert rows(both, "backend", "key", "mtime", "checksum_sha256") == [("azure", "b", 2, None), ("local", "a", 1, "x"), ("s3", "a", 1, None)]
    with pytest.raises(ValueError):
        A.catalogue_union({})


def test_digests(spark, rows):
    content = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "key string, content binary")
    actual = A.content_sha256(content)
    expected = spark.createDataFrame(
        [("a", "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"), ("b", "0"), ("c", "0")], "key string, sha256 string"
    )
    assert rows(A.checksum_verify(expected, actual)) == [("a", True), ("b", False), ("c", False)]
    assert rows(A.archive_exists(expected, content), "key") == [("a",), ("b",)]


def test_sizes_round_half_to_even(spark):
    df = spark.createDataFrame([("r", 131072)], "repo string, size_bytes long")
    assert A.storage_usage(df).first().total_size_mb == 0.12
    assert tuple(A.lfs_inventory(df).first()) == ("r", 1, 131072)


@pytest.mark.parametrize("mb, text", [(100, "10s"), (599, "59s"), (600, "1m"), (35999, "59m"), (36000, "1h 0m"), (40000, "1h 6m")])
def test_transfer(spark, mb, text):
    assert A.transfer_estimate(spark.createDataFrame([(mb,)], "size_mb long"), 10).first().readable == text


@pytest.mark.parametrize(
    "name, expected",
    [
        ("my-repo-full-20250102-030405.tar.gz", ("my-repo", "full", datetime(2025, 1, 2, 3, 4, 5))),
        ("r-full-deps-20250102-030405.tar.gz", ("r", "full-deps", datetime(2025, 1, 2, 3, 4, 5))),
        ("full-incremental-20250102-030405.tar.gz", ("full", "incremental", datetime(2025, 1, 2, 3, 4, 5))),
        ("r-full-20259902-030405.tar.gz", ("r", "full", None)),
        ("r-other-20250102-030405.tar.gz", (None, None, None)),
    ],
)
def test_archive_names(spark, name, expected):
    assert tuple(A.archive_name_parse(spark.createDataFrame([(name,)], "filename string")).first())[1:] == expected


def test_large_file_patterns(spark, rows):
    text = "# *.old filter=lfs\n*.psd filter=lfs diff=lfs merge=lfs -text\r\n* text=auto\n\n  a/** \t filter=lfs"
    df = spark.createDataFrame([("r", text), ("s", "# filter=lfs"), ("t", "")], "repo string, text string")
    assert rows(A.lfs_patterns(df)) == [("r", 1, "*.psd"), ("r", 4, "a/**")]
    assert rows(A.lfs_enabled(df)) == [("r", True), ("s", True), ("t", False)]


def test_dedupe_and_unreferenced(spark, rows):
    df = spark.createDataFrame([("a", "h", 5), ("b", "h", 5), ("c", "g", 7)], "oid string, sha256 string, size_bytes long")
    assert rows(A.lfs_dedupe(df)) == [("h", 2, 5)]
    assert rows(A.lfs_unreferenced(df, df.where("oid = 'a'")), "oid") == [("b",), ("c",)]


def test_only_one_json_object_is_a_manifest(spark):
    good = ['{"type":"full"}', ' {"type":"x","type":"full"} ', '{"type":"full","lfs_object_count":2}']
    bad = ['{"type":"full"} garbage', "[1,2]", "5", '"a"', "null", "", '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1},null', "{", None]
    files = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "archive int, value string")
    found = {r.archive: (r.manifest_valid, r.manifest.type if r.manifest else None) for r in A.manifest_read(files).collect()}
    assert all(found[i] == (True, "full") for i in range(len(good)))
    assert all(found[i + len(good)] == (False, None) for i in range(len(bad))), found
