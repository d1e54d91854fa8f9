import json
import random
import re

import pytest
from pyspark.sql import functions as F

from forgeledger.functions import requirements as R
from forgeledger.functions.manifests import structured_entries
from forgeledger.operators import closure as K
from forgeledger.operators import deps as D


def files(spark, *entries):
    return spark.createDataFrame([("r", n, t) for n, t in entries], "repo string, manifest string, text string")


@pytest.mark.parametrize(
    "line, expected",
    [
        ("requests>=2.0", ("requests", [], ">=2.0", "")),
        ("Flask[async, dotenv]>=2.0,<3 ; python_version < '3.8'", ("Flask", ["async", "dotenv"], ">=2.0,<3", "python_version < '3.8'")),
        ("plain", ("plain", [], "", "")),
        ("pkg == 1.0  # why", ("pkg", [], "== 1.0", "")),
        ("pkg#x", ("pkg", [], "#x", "")),
        ("a.b_c-d~=1", ("a.b_c-d", [], "~=1", "")),
        ("naïve>=1", ("naïve", [], ">=1", "")),
        ("pkg; sys_platform == 'win32'", ("pkg", [], "", "sys_platform == 'win32'")),
        ("pkg>=1;", ("pkg", [], ">=1", "")),
        ("pkg[] >1", ("pkg", [], "[] >1", "")),
        ("pkg @ https://x/y", ("pkg", [], "@ https://x/y", "")),
        ("_odd>=1", None),
        ("élan>=1", None),
        (">=1", None),
    ],
)
def test_requirement_line(spark, line, expected):
    df = spark.createDataFrame([(line,)], "l string").select(F.inline(R.parse_line(F.col("l"))))
    got = df.first()
    assert (tuple(got) if got else None) == expected


def test_requirement_file(spark, rows):
    text = "# c\n\n-e .\n--index-url x\ngit+https://x\nhttps://y\na>=1\r\nb\rc ; m\x0bd   e\n  # x"
    df = files(spark, ("x/requirements.txt", text), ("Requirements-Dev.TXT", "f"), ("notes.txt", "g"), ("requirements.txt", ""))
    assert rows(D.requirements_parse(df), "name", "version_spec", "markers") == [
        ("a", ">=1", ""), ("b", "", ""), ("c", "", "m"), ("d", "", ""), ("e", "", ""), ("f", "", "")
    ]


STRUCTURED = [
    ("pyproject.toml", '[project]\ndependencies = ["a>=1", "b[x]==2; m", "_c"]', [("a", ">=1"), ("b", "==2")]),
    ("pyproject.toml", '[project]\nname = "x"\n[tool.poetry.dependencies]\npython = "^3"\na = "^1"\nb = {version = "2"}\nc = {git = "u"}\nd = 3', [("a", "^1"), ("b", "2"), ("c", ""), ("d", "")]),
    ("pyproject.toml", '[project]\ndependencies = []\n[tool.poetry.dependencies]\na = "1"', []),
    ("Pipfile", '[packages]\na = "*"\nb = "==1"\nc = {version = "*"}\nd = {path = "."}\n[dev-packages]\ne = "*"', [("a", ""), ("b", "==1"), ("c", "*"), ("d", "")]),
    ("setup.py", 'import x\nsetup(name="n", install_requires=["a>=1", VAR, "b"], extras={"e": ["z"]})', [("a", ">=1"), ("b", "")]),
    ("setup.py", "setuptools.setup(install_requires=['a'])\nother(install_requires=['b'])\nsetup(install_requires=LIST)", []),
    ("setup.py", "setup(", []),
    ("pyproject.toml", "not toml =", []),
    ("setup.cfg", "[x]", []),
]


@pytest.mark.parametrize("name, text, expected", STRUCTURED)
def test_structured_manifest(spark, name, text, expected):
    got = D.structured_manifest_parse(files(spark, ("sub/" + name, text))).orderBy("line_no").collect()
    assert [(r.name, r.version_spec) for r in got] == expected


@pytest.mark.parametrize(
    "name, text, reason",
    [
        ("Pipfile", "[[packages]]\nx = 1", "packages is not a table"),
        ("pyproject.toml", "tool = 1", "tool is not a table"),
        ("pyproject.toml", "project = 3", "project is not a table"),
        ("pyproject.toml", "[project]\ndependencies = [1, 2]", "dependencies is not a list of texts"),
        ("pyproject.toml", "a = " + "[" * 100_000, "nested too deeply"),
        ("setup.py", "setup(" + "(" * 5_000, "not valid Python"),
        ("setup.py", "x = " + "-" * 200_000 + "1", "nested too deeply"),
        ("setup.py", "a\0b", "not valid Python"),
        ("Pipfile", "x = [", "not valid TOML"),
        ("Pipfile", None, "no text"),
    ],
)
def test_unreadable_manifests_have_a_reason(name, text, reason):
    assert structured_entries(name, text) == ([], reason)


def test_an_unreadable_manifest_costs_no_other(spark, rows):
    df = files(spark, ("Pipfile", "x = ["), ("a/Pipfile", '[packages]\nflask = "*"'), ("setup.py", None), ("notes.md", None))
    assert rows(D.structured_manifest_parse(df), "manifest", "name") == [("a/Pipfile", "flask")]
    assert rows(D.structured_manifest_rejects(df)) == [("r", "Pipfile", "not valid TOML"), ("r", "setup.py", "no text")]



def tiny_paths(spark):
    return spark.createDataFrame([("r", p) for p in ("a-b/go.mod", "go.mod", "a/go.mod")], "repo string, file_path string")


def test_languages(spark, rows):
    paths = ["a/requirements.txt", "Pipfile", "x/y/app.csproj", "lib.gemspec", "Gemfile", "go.mod", "README.md", "REQUIREMENTS.TXT", "pom.xml.bak"]
    df = spark.createDataFrame([("r", p) for p in paths] + [("s", "pom.xml")], "repo string, file_path string")
    assert rows(D.detect_languages(df)) == [("r", "dotnet"), ("r", "go"), ("r", "python"), ("r", "ruby"), ("s", "java")]
    assert rows(D.repos_with_language(df, "java")) == [("s",)]
    with pytest.raises(ValueError):
        D.repos_with_language(df, "maven")
    ruby = D.language_metadata(df).where("language = 'ruby'")
    assert rows(ruby, "file_path", "position", "manifest_count") == [("Gemfile", 1, 2), ("lib.gemspec", 2, 2)]
    near = tiny_paths(spark)
    assert [r.file_path for r in D.language_metadata(near).orderBy("position").collect()] == ["a/go.mod", "a-b/go.mod", "go.mod"]
    names = [n for group in D.LANGUAGE_MANIFESTS.values() for n in group.split()]
    assert (len(D.LANGUAGE_MANIFESTS), len(names), len(set(names))) == (13, 53, 53)


def test_distinct_dependencies(spark, rows):
    df = spark.createDataFrame([("r", "a", "1"), ("s", "a", "1"), ("r", "a", "1"), ("r", "a", "2")], "repo string, name string, version_spec string")
    assert rows(D.dependency_distinct(df)) == [("a", "1", 2), ("a", "2", 1)]


def test_dependency_lists_come_in_whole_parts(many_slices):
    df = many_slices.createDataFrame([("r", f"n{i:02}", f">={i}") for i in range(25)] + [("s", "x", "")], "repo string, name string, version_spec string")
    got = D.dependency_manifest(df, [F.col("name")], part_size=10).orderBy("repo", "part").collect()
    assert [(r.repo, r.part, r.dependency_count, len(json.loads(r.dependencies))) for r in got] == [("r", 0, 25, 10), ("r", 1, 25, 10), ("r", 2, 25, 5), ("s", 0, 1, 1)]
    assert [d["name"] for r in got[:3] for d in json.loads(r.dependencies)] == [f"n{i:02}" for i in range(25)]


def test_registry_documents(spark):
    document = {
        "info": {"name": "A", "version": "1", "requires_dist": None, "summary": "s"},
        "urls": [
            {"packagetype": "bdist_wheel", "url": "h/1.whl", "digests": {"sha256": "x", "md5": "m"}},
            {"packagetype": "bdist_wheel", "url": "h/2.whl", "digests": {"sha256": "y"}},
            {"packagetype": "sdist", "url": "h/a.tgz"},
        ],
    }
    df = spark.createDataFrame([(json.dumps(document),), ("{bad",), ('{"info": {"name": "B", "version": "2"}}',)], "value string")
    flat = D.registry_flatten(df)
    got = {r.name: r for r in flat.collect()}
    assert tuple(got["A"]) == ("A", "1", [], "h/2.whl", "y", "h/a.tgz", "")
    assert tuple(got["B"]) == ("B", "2", [], "", "", "", "")
    assert {r.name: r.filename for r in D.artifact_choice(flat).collect()} == {"A": "2.whl", "B": "B-2.tar.gz"}
    assert D.artifact_choice(flat.withColumn("wheel_url", F.lit(""))).where("name = 'A'").first().filename == "a.tgz"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("six", ("six", "")),
        ("six>=1.4", ("six", ">=1.4")),
        ("six (>=1.4,<2) ; extra == 'x'", ("six", "<2,>=1.4")),
        ("a[b,c] ~= 1.0", ("a", "~=1.0")),
        ("a @ https://x/y.whl", ("a", "")),
        ("; extra == 'x'", None),
        ("a b", None),
        ("a >= ", None),
    ],
)
def test_registry_requirement(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(R.parse_registry_requirement(F.col("t"))).first()[0]
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    "version, spec, ok",
    [
        ("2.5.0", ">=2.0,<3", True),
        ("3.0", ">=2.0,<3", False),
        ("1.10", ">1.9", True),
        ("1.0", "", True),
        ("1.0", "garbage", True),
        ("1!1.0", ">=2", True),
        ("1.0+local", "==1.0", True),
        ("not a version", ">=1", False),
        ("1.4.2", "~=1.4.1", True),
    ],
)
def test_versions(spark, version, spec, ok):
    candidates = spark.createDataFrame([("Pkg", version)], "name string, version string")
    wanted = spark.createDataFrame([("pkg", spec), ("PKG", spec)], "name string, version_spec string")
    assert tuple(D.version_satisfies(candidates, wanted).first()) == ("pkg", version, ok, 1)
    conflicts = [tuple(r) for r in D.version_conflicts(candidates, wanted).collect()]
    assert conflicts == ([] if ok else [("pkg", spec, 2, version)])


def test_unresolved_and_offline(spark, rows):
    packages = spark.createDataFrame([("A",)], "name string")
    assert rows(D.unresolved_dependencies(spark.createDataFrame([("a",), ("B",), ("b",)], "name string"), packages)) == [("b",)]
    resolved = spark.createDataFrame([("r", i, f"f{i}") for i in range(3)], "repo string, i int, filename string")
    assert rows(D.offline_requirements(resolved, [F.col("i")])) == [("r", 0, D.OFFLINE_HEADER), ("r", 1, ""), ("r", 2, "f0"), ("r", 3, "f1"), ("r", 4, "f2")]


# --- closure ---------------------------------------------------------------------------


def queue_walk(roots, registry):
    """What a first-in-first-out queue does, one requirement at a time. Numeric versions only."""
    queue, seen, result = [(n, s, 0) for n, s in roots], set(), {}
    while queue:
        name, spec, level = queue.pop(0)
        key = name.lower()
        if key in seen:
            continue
        seen.add(key)
        if key not in registry:
            result[key] = (level, spec, "missing")
            continue
        version, needs = registry[key]
        bound = re.match(r"(>=|<)(\d+)$", spec)
        fine = not bound or (version >= int(bound[2]) if bound[1] == ">=" else version < int(bound[2]))
        result[key] = (level, spec, "resolved" if fine else "conflict")
        if fine:
            queue += [(n, s, level + 1) for n, s in needs]
    return result


def resolve(spark, roots, registry):
    packages = spark.createDataFrame(
        [(k.upper(), str(v), [n + s for n, s in needs]) for k, (v, needs) in registry.items()], "name string, version string, requires array<string>"
    )
    start = spark.createDataFrame([(n, s, i) for i, (n, s) in enumerate(roots)], "name string, version_spec string, ordinal int")
    return {r.package: (r.level, r.version_spec, r.status) for r in K.resolve(start, packages).collect()}


def test_diamond_is_resolved_once(spark):
    registry = {"a": (1, [("b", ""), ("c", "")]), "b": (1, [("D", ">=1")]), "c": (1, [("d", "<9")]), "d": (3, [])}
    assert resolve(spark, [("A", "")], registry) == {"a": (0, "", "resolved"), "b": (1, "", "resolved"), "c": (1, "", "resolved"), "d": (2, ">=1", "resolved")}


def test_conflict_and_missing_stop_there(spark):
    registry = {"a": (1, [("b", ""), ("c", ">=5")]), "b": (1, [("lost", "")]), "c": (2, [("d", "")]), "d": (1, [])}
    got = resolve(spark, [("a", "")], registry)
    assert got["c"] == (1, ">=5", "conflict") and got["lost"] == (2, "", "missing") and "d" not in got


def test_first_requirement_wins_like_the_queue(spark):
    rng = random.Random(11)
    names = [f"p{i}" for i in range(60)]
    registry = {
        n: (rng.randint(1, 9), [(rng.choice(names).title(), rng.choice(["", f">={rng.randint(1, 9)}", f"<{rng.randint(1, 9)}"])) for _ in range(rng.randint(0, 4))])
        for n in names[:50]
    }
    roots = [(rng.choice(names), "") for _ in range(6)]
    assert resolve(spark, roots, registry) == queue_walk(roots, registry)


def test_joins_send_only_levels_that_are_counted(spark, monkeypatch):
    """Small tables that Spark would broadcast stand for tables that are small on disk only."""
    plans, counted = [], K.durable_counted

    def seen(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return counted(df, *more)

    monkeypatch.setattr(K, "durable_counted", seen)
    rng = random.Random(3)
    registry = {f"p{i}": (rng.randint(1, 9), [(f"p{2 * i + k}", f">={rng.randint(1, 5)}") for k in range(3)]) for i in range(1, 40)}
    for numbers, sent in ((0, 0), (K.__dict__.get("SENT_NUMBERS", 0), 1)):
        plans.clear()
        monkeypatch.setattr(K, "SENT_NUMBERS", numbers, raising=False)
        assert resolve(spark, [("p1", "")], registry) == queue_walk([("p1", "")], registry)
        assert len(plans) > 4 and [p.count("BroadcastHashJoin") for p in plans] == [0] + [sent] * (len(plans) - 1)
        # The packages are read once, before the first level.
        assert not any(scan in p for p in plans[1:] for scan in ("LocalTableScan", "ExistingRDD"))


def test_cycles_end(spark, rows):
    assert resolve(spark, [("a", "")], {"a": (1, [("b", "")]), "b": (1, [("a", ">=9")])}) == {"a": (0, "", "resolved"), "b": (1, "", "resolved")}
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "package int, needs int")
    assert rows(K.closure(spark.createDataFrame([(1,)], "package int"), edges)) == [(1, 0), (2, 1), (3, 2)]


def test_deep_chain(spark):
    edges = spark.range(20).select(F.col("id").alias("package"), (F.col("id") + 1).alias("needs"))
    assert K.closure(spark.range(1).toDF("package"), edges).agg(F.max("level")).first()[0] == 20


def test_no_roots(spark):
    assert resolve(spark, [("zzz", "")], {"a": (1, [])}) == {"zzz": (0, "", "missing")}
    roots = spark.createDataFrame([], "name string, version_spec string, ordinal int")
    packages = spark.createDataFrame([], "name string, version string, requires array<string>")
    assert K.resolve(roots, packages).columns == ["package", "level", "requested_as", "version_spec", "status", "version", "place"]
    assert K.resolve(roots, packages).isEmpty()


def test_registry_requirements_are_read_as_the_standard_says(spark):
    from packaging.requirements import InvalidRequirement, Requirement

    specs = (
        "|>=1|>= 1.0|>=1,<2|>=1 <2|>=1 , <2|>=1,|(>=1)|(>=1|>=1)|( >=1 , !=1.5.* )|>=1.*|==1.*|>=1.0+local|==1.0+local.1|~=1|~=1.4.2|~=1.*|===odd!|"
        "<2.0rc1|<=1!2.0.post1|>1.0.dev3|==v1|>=1-2|>=x|=1|==|1.0|,>=1|>=1,,<2|[a]>=1|[a,b] (>=1)|[a b]>=1|[]>=1|[a,]|@ https://x/y.whl|@|!=1.0alpha"
    ).split("|")
    lines = [name + space + spec for name in ("foo", "Foo.b-a_r", "f", "foo_", "foo-", "-foo", "") for space in ("", " ") for spec in specs]
    got = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, l string").select(
        "i", R.parse_registry_requirement(F.col("l")).alias("r")
    )
    found = {r.i: r.r for r in got.collect()}
    for i, line in enumerate(lines):
        try:
            wanted = Requirement(line)
        except InvalidRequirement:
            wanted = None
        assert (found[i] is None) == (wanted is None), line
        if wanted:
            assert (found[i].name, sorted(found[i].version_spec.split(","))) == (wanted.name, sorted(str(wanted.specifier).split(","))), line
