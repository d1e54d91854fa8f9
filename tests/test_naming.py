import random
import re

import pytest
from pyspark.sql import functions as F

from forgeledger.functions import paths as P
from forgeledger.operators import naming as N
from forgeledger.operators import selection as S


def names(spark, paths, **options):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    return [r.target_name for r in N.map_names(df, **options).orderBy("i").collect()]


DEEP = "company/backend/services/auth"


@pytest.mark.parametrize(
    "options, expected",
    [
        ({}, "company-backend-services-auth"),
        ({"separator": "_"}, "company_backend_services_auth"),
        ({"strip_root": True}, "backend-services-auth"),
        ({"keep_last": 2}, "services-auth"),
        ({"strip_root": True, "keep_last": 3}, "backend-services-auth"),
        ({"strip_root": True, "keep_last": 9}, "backend-services-auth"),
        ({"keep_last": 9}, "company-backend-services-auth"),
        ({"keep_last": 0}, "company-backend-services-auth"),
    ],
)
def test_flatten(spark, options, expected):
    assert names(spark, [DEEP], strategy="flatten", **options) == [expected]


def test_flatten_single_part_keeps_its_root(spark):
    assert names(spark, ["auth"], strip_root=True) == ["auth"]


@pytest.mark.parametrize("keep, expected", [(None, "auth"), (0, "auth"), (1, "auth"), (2, "services-auth"), (7, "company-backend-services-auth")])
def test_prefix(spark, keep, expected):
    assert names(spark, [DEEP], strategy="prefix", keep_last=keep, strip_root=True) == [expected]


def test_full_path_ignores_strip_and_keep(spark):
    assert names(spark, [DEEP], strategy="full_path", separator="_", strip_root=True, keep_last=1) == ["company_backend_services_auth"]


def test_negative_levels_and_unknown_strategy_are_rejected(spark):
    with pytest.raises(ValueError):
        names(spark, [DEEP], keep_last=-1)
    with pytest.raises(ValueError):
        names(spark, [DEEP], strategy="other")


CUSTOM = {"company/backend": "be", "company/backend/services": "svc", "company/web/shop": "store"}
CUSTOM_PATHS = [DEEP, "company/backend/tool", "company/web/shop", "company/backendish/x", "company/backend/services"]
CUSTOM_NAMES = ["svc-auth", "be-tool", "store", "x", "svc"]


def test_custom_longest_prefix_exact_boundary_and_fallback(spark):
    assert names(spark, CUSTOM_PATHS, strategy="custom", custom=CUSTOM, fallback="prefix") == CUSTOM_NAMES


def test_custom_table_equals_custom_dict(spark):
    table = spark.createDataFrame(list(CUSTOM.items()), "prefix string, value string")
    assert names(spark, CUSTOM_PATHS, strategy="custom", custom=table, fallback="prefix") == CUSTOM_NAMES


@pytest.mark.parametrize("n", [0, 1, 2, 3, 199, 200, 201, 5_000])
def test_custom_dict_of_any_size(spark, n):
    big = {f"other/{i}": str(i) for i in range(n)} | CUSTOM
    assert names(spark, CUSTOM_PATHS, strategy="custom", custom=big, fallback="prefix") == CUSTOM_NAMES


def test_lookup_in_a_literal_finds_what_a_join_finds(spark):
    rng = random.Random(9)
    part = lambda: rng.choice(["a", "b", "é", "ab", "a b", "a.b", "z", "\u4e2d"])
    path = lambda: "/".join(part() for _ in range(rng.randint(1, 6)))
    mapping = {path(): str(i) for i in range(150)}
    df = spark.createDataFrame([(p,) for p in {path() for _ in range(400)} | set(mapping)], "path string")
    table = spark.createDataFrame(list(mapping.items()), "prefix string, value string")
    literal, joined = (sorted((r.path, r.hit) for r in S.with_longest_prefix(df, m).collect()) for m in (mapping, table))
    assert [(p, h and tuple(h)) for p, h in literal] == [(p, h and tuple(h)) for p, h in joined]
    assert sum(h is None for _, h in literal) < len(literal) and S.with_longest_prefix(df, {}).where("hit is not null").count() == 0


def test_custom_without_entries_and_recursive_fallback(spark):
    assert names(spark, [DEEP], strategy="custom", custom={}, fallback="full_path", separator=".") == ["company.backend.services.auth"]
    with pytest.raises(ValueError):
        names(spark, [DEEP], strategy="custom", custom={}, fallback="custom")


@pytest.mark.parametrize(
    "path, strip, expected",
    [
        ("Company/Backend/auth", False, ["company", "backend"]),
        ("Company/Backend/auth", True, ["backend"]),
        ("company/auth", True, ["company"]),
        ("auth", False, []),
    ],
)
def test_topics(spark, path, strip, expected):
    df = spark.createDataFrame([(path,)], "path string").select(P.path_topics(F.col("path"), strip).alias("t"))
    assert df.first().t == expected


@pytest.mark.parametrize(
    "name, error",
    [
        ("my-repo", None),
        ("a" * 100, None),
        ("a" * 101, P.ERR_LENGTH + "101"),
        (".", P.ERR_DOTS),
        ("..", P.ERR_DOTS),
        ("x.git", P.ERR_GIT_SUFFIX),
        (".git", P.ERR_GIT_SUFFIX),
        ("-x", P.ERR_LEADING),
        ("_x", P.ERR_LEADING),
        (".x", P.ERR_LEADING),
        ("a b", P.ERR_CHARACTERS),
        ("a/b", P.ERR_CHARACTERS),
        ("ünder", P.ERR_CHARACTERS),
        ("", P.ERR_CHARACTERS),
        ("1.2_3-x", None),
        ("ends-with-a-line-end\n", None),
    ],
)
def test_name_rules(spark, name, error):
    got = N.name_validity(spark.createDataFrame([(name,)], "target_name string")).first()
    assert (got.valid, got.error) == (error is None, error)


def test_conflicts(spark, rows):
    df = spark.createDataFrame([("a/x",), ("b/x",), ("c/x",), ("a/y",), ("b/Y",)], "path string")
    got = rows(N.name_conflicts(N.map_names(df, "prefix")))
    assert got == [("x", "a/x", 3), ("x", "b/x", 3), ("x", "c/x", 3)]


def test_normalised_names_and_rejects(spark, rows):
    df = spark.createDataFrame([("//a//b/",), ("  ",), ("",), (None,), ("infra/k8s/prom",), ("/",)], "path string")
    assert rows(N.map_normalised(df), "path", "target_name") == [("/", ""), ("//a//b/", "a-b"), ("infra/k8s/prom", "infra-k8s-prom")]
    assert [r[1] for r in rows(N.map_labelled(df, "infra"), "path", "target_name")] == ["infra-", "infra-b", "infra-prom"]
    assert [r[1] for r in rows(N.map_labelled(df, None), "path", "target_name")] == ["", "b", "prom"]
    assert rows(N.blank_paths(df), "reject_reason") == [("path is empty",), ("path is empty",), ("path is null",)]


def estate(spark):
    projects = spark.createDataFrame(
        [(1, "g/a/x"), (2, "g/b/x"), (3, "g/-bad"), (4, "g/new")], "id bigint, path string"
    ).withColumn("web_url", F.concat(F.lit("https://h/"), "path"))
    targets = spark.createDataFrame([("org/x",)], "full_name string")
    details = spark.createDataFrame(
        [(1, None, None, None), (4, "d", "public", "develop")], "id bigint, description string, visibility string, default_branch string"
    )
    return N.migration_plan(projects, targets, details, "org", "https://t", strategy="prefix")


def test_plan(spark):
    plan = {r.id: r for r in estate(spark).collect()}
    assert (plan[1].n_same_name, plan[1].target_exists, plan[1].visibility, plan[1].default_branch) == (2, True, "private", "main")
    assert plan[2].description is None and plan[2].source_url == "https://h/g/b/x"
    assert (plan[3].valid, plan[3].target_url, plan[3].error) == (False, None, P.ERR_LEADING)
    assert (plan[4].target_url, plan[4].target_exists, plan[4].path_topics) == ("https://t/org/new.git", False, ["g"])


def test_plan_prefers_a_clone_address(spark):
    projects = spark.createDataFrame([(1, "g/a", "w", "h"), (2, "g/b", "w", None)], "id bigint, path string, web_url string, http_url string")
    none = spark.createDataFrame([], "full_name string")
    details = spark.createDataFrame([], "id bigint, description string, visibility string, default_branch string")
    plan = N.migration_plan(projects, none, details, "o", "https://t")
    assert {r.id: r.source_url for r in plan.collect()} == {1: "h", 2: "w"}


def test_summary_of_dry_run_and_of_outcomes(spark):
    plan = estate(spark)
    assert tuple(N.plan_summary(plan).first()) == (4, 3, 1, 1, 0, 0, 0)
    # Project 4 failed to be created: it has an error and no sync outcome.
    done = plan.withColumn("created", F.col("id") == 2).withColumn(
        "sync_success", F.when(F.col("id") == 1, True).when(F.col("id") == 2, False)
    )
    assert tuple(N.plan_summary(done).first()) == (4, 3, 1, 1, 1, 1, 1)
    assert tuple(N.plan_summary(plan.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0)


def test_target_settings(spark):
    df = spark.createDataFrame(
        [(1, "a/b", "", ["t"], v, "main") for v in ("private", "internal", "public")],
        "id int, path string, description string, topics array<string>, visibility string, default_branch string",
    )
    assert [(r.name, r.private) for r in N.target_settings(df).collect()] == [("b", True), ("b", True), ("b", False)]


def test_subtrees(spark, rows):
    df = spark.createDataFrame([("g/a",), ("g/s/b",), ("gx/c",), ("g",)], "path string")
    assert rows(S.subtree(df, "g")) == [("g/a",), ("g/s/b",)]
    assert rows(S.subtree(df, "g", direct_only=True)) == [("g/a",)]


def test_excludes(spark, rows):
    df = spark.createDataFrame([("backend/deprecated-x",), ("a/b/archive-1",), ("a.b",), ("axb",), ("gone",), (None,)], "path string")
    exact = spark.createDataFrame([("gone",)], "path string")
    assert rows(S.exclude_filter(df, "path", ["backend/deprecated-*", "*/archive-*", "a.*"], exact)) == [("axb",), (None,)]
    assert S.exclude_filter(df, "path").count() == 6


def test_excludes_of_a_group(spark, rows):
    df = spark.createDataFrame(
        [("g", "g/old-x"), ("h", "h/old-x"), ("g", "g/a_b"), ("g", "g/axb"), ("g", "g/p%q"), ("g", "g/c\\d"), ("g", None), (None, "g/old-x")],
        "group_name string, path string",
    )
    entries = spark.createDataFrame(
        [("g", "g/old-*"), ("g", "g/a_b"), ("g", "*_*"), ("g", "*p%q"), ("g", "g/c\\*"), ("h", "g/*"), ("h", None), (None, "*")],
        "group_name string, entry string",
    )
    assert rows(S.exclude_by_group(df, entries), "path") == rows(df.where("path is null or group_name is null or path in ('g/axb', 'h/old-x')"), "path")


def test_details_defaults(spark):
    projects = spark.createDataFrame([(1,), (2,)], "id bigint")
    details = spark.createDataFrame([(1, None, None, None, None)], "id bigint, description string, topics array<string>, visibility string, default_branch string")
    got = {r.id: tuple(r)[1:] for r in S.project_details(projects, details).collect()}
    assert got == {1: (True, "", [], "private", "main"), 2: (False, None, None, None, None)}


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://github.com/a/b", "github"),
        ("https://CODE.GitHub.com/a", "github"),
        ("https://notgithub.com/a", "unsupported"),
        ("https://tok@github.com/a", "unsupported"),
        ("https://gitlab.com/a", "gitlab"),
        ("https://gitlab.corp.example:8443/a b", "gitlab"),
        ("git@github.com:a/b.git", "ssh"),
        ("https://example.com/gitlab", "unsupported"),
        ("https://example.com?x=gitlab", "unsupported"),
        ("github.com/a", "unsupported"),
    ],
)
def test_platform(spark, url, expected):
    assert spark.createDataFrame([(url,)], "url string").select(P.platform(F.col("url"))).first()[0] == expected


def test_routing_and_overrides(spark, rows):
    df = spark.createDataFrame([("a/b/c",), ("a/x",), ("z",)], "path string")
    assert rows(S.org_routing(df, {"a": "one", "a/b": "two"}, "none")) == [("a/b/c", "two"), ("a/x", "one"), ("z", "none")]
    config = spark.createDataFrame([("a/x", 5, None)], "path string, depth int, mode string")
    got = rows(S.config_overrides(df, config, ["path"], {"depth": 0, "mode": "mirror"}))
    assert got == [("a/b/c", 0, "mirror"), ("a/x", 5, "mirror"), ("z", 0, "mirror")]


def test_blank_paths_in_any_white_space(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t",), ("\u00a0\u2003",), ("a",), ("\u200b",)], "path string")
    assert [r[0] for r in df.select(P.is_blank_path(df.path)).collect()] == [True, True, True, True, False, False]


def test_many_globs_in_one_group_meet_by_pieces(spark, rows):
    rng = random.Random(2)
    letters = "abcd/-._%*\\é"
    text = lambda n, of: "".join(rng.choice(of) for _ in range(rng.randint(0, n)))
    globs = {text(14, letters) + "*" + text(9, letters) for _ in range(1500)} - {"*"}
    globs = {g for g in globs if len(g.replace("*", "")) > 2}
    values = {text(30, letters.replace("*", "")) for _ in range(800)} | {g.replace("*", "xy") for g in list(globs)[:200]}
    entries = [("hot", g) for g in globs] + [("all", "**"), ("none", "q*"), (None, "*"), ("hot", None), ("exact", "a")]
    df = spark.createDataFrame([("hot", v) for v in values] + [(g, v) for g in ("all", "none", "exact", None, "other") for v in ("", "a", None)], "group_name string, path string")
    match = lambda g, v: re.fullmatch(".*".join(map(re.escape, g.split("*"))), v, re.S)
    hit = {(a, v) for a, v in {tuple(r) for r in df.collect()} if a is not None and v is not None for b, g in entries if a == b and g is not None and (match(g, v) if "*" in g else g == v)}
    kept = S.exclude_by_group(df, spark.createDataFrame(entries, "group_name string, entry string"))
    assert rows(kept) == sorted((tuple(r) for r in df.collect() if tuple(r) not in hit), key=repr)
    assert 100 < sum(a == "hot" for a, _ in hit) < len(values)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "__piece" in plan and "CartesianProduct" not in plan
