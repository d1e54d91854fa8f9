"""Languages, dependency manifests and the package registry."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import requirements as R
from ..functions.manifests import STRUCTURED, structured_entries
from ..functions.versions import satisfies
from .grouping import join_null_safe, order_in_group

# Manifest file names per language; "*.ext" stands for any name with that ending.
LANGUAGE_MANIFESTS = {
    "python": "requirements.txt requirements-dev.txt requirements-test.txt pyproject.toml Pipfile Pipfile.lock "
    "setup.py setup.cfg poetry.lock conda.yml environment.yml",
    "nodejs": "package.json package-lock.json yarn.lock pnpm-lock.yaml npm-shrinkwrap.json",
    "java": "pom.xml build.gradle build.gradle.kts gradle.properties settings.gradle settings.gradle.kts",
    "go": "go.mod go.sum Gopkg.toml Gopkg.lock",
    "rust": "Cargo.toml Cargo.lock",
    "ruby": "Gemfile Gemfile.lock *.gemspec",
    "php": "composer.json composer.lock",
    "dotnet": "*.csproj *.fsproj *.vbproj packages.config project.json paket.dependencies paket.lock",
    "cpp": "conanfile.py conanfile.txt vcpkg.json CMakeLists.txt",
    "swift": "Package.swift Podfile Podfile.lock Cartfile Cartfile.resolved",
    "scala": "build.sbt build.sc",
    "ada": "alire.toml",
    "fortran": "fpm.toml",
}
LINE_MANIFESTS = ("requirements.txt", "requirements-dev.txt", "requirements-test.txt")
OFFLINE_HEADER = (
    "# Offline requirements - install with: pip install -r requirements.txt --no-index --find-links ."
)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_language(path: Column) -> Column:
    """Language of a manifest file by its name, null for other files."""
    name = base_name(path)
    result = F.lit(None).cast("string")
    for language, names in reversed(LANGUAGE_MANIFESTS.items()):
        exact = [n for n in names.split() if not n.startswith("*")]
        hit = name.isin(exact)
        for ending in (n[1:] for n in names.split() if n.startswith("*")):
            hit = hit | F.endswith(name, F.lit(ending))
        result = F.when(hit, F.lit(language)).otherwise(result)
    return result


def manifest_files(files: DataFrame, path: str = "file_path") -> DataFrame:
    return files.withColumn("language", file_language(F.col(path))).where("language is not null")


def detect_languages(files: DataFrame, key: str = "repo", path: str = "file_path") -> DataFrame:
    """Languages per repository, at any depth."""
    return manifest_files(files, path).select(key, "language").distinct()


def repos_with_language(files: DataFrame, language: str, key: str = "repo", path: str = "file_path") -> DataFrame:
    if language not in LANGUAGE_MANIFESTS:
        raise ValueError(f"no manifest names are known for {language}")
    return detect_languages(files, key, path).where(F.col("language") == language).select(key)


def language_metadata(files: DataFrame, key: str = "repo", path: str = "file_path") -> DataFrame:
    """Manifest files per (repository, language) in sorted order: one row per file with its
    place in the list, and the number of files of that repository and language. Paths sort
    part by part, so a folder's files come before those of a longer-named folder."""
    found = manifest_files(files, path).select(key, "language", path).distinct()
    counts = found.groupBy(key, "language").agg(F.count(F.lit(1)).alias("manifest_count"))
    placed = order_in_group(found, [key, "language"], [F.split(path, "/")])
    return placed.join(counts, [key, "language"])


def requirements_parse(files: DataFrame, text: str = "text", manifest: str = "manifest") -> DataFrame:
    """Dependency rows of line-based manifests, with the line number each came from."""
    supported = F.lower(base_name(F.col(manifest))).isin(*LINE_MANIFESTS)
    rest = [c for c in files.columns if c != text]
    kept = files.where(supported)
    lines = kept.select(*rest, F.posexplode(R.lines_of(F.col(text))).alias("line_no", "line"))
    lines = lines.withColumn("line", R.stripped(F.col("line"))).where(R.is_requirement(F.col("line")))
    return lines.select(*rest, "line_no", F.inline(R.parse_line(F.col("line"))))


def _structured_rows(files: DataFrame, text: str, manifest: str, keys: list[str]) -> DataFrame:
    """One row per entry of a readable file, and one with a ``reason`` per file that is not.

    Only reading the file formats runs in Python, in Arrow batches.
    """
    kept = files.where(F.lower(base_name(F.col(manifest))).isin(*STRUCTURED)).select(*keys, manifest, text)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = batch[manifest].str.rsplit("/", n=1).str[-1]
            flat = []
            for i, (name, content) in enumerate(zip(names, batch[text])):
                found, reason = structured_entries(name, content)
                flat += [(i, n, *entry, None) for n, entry in enumerate(found)]
                if reason:
                    flat.append((i, 0, None, None, reason))
            source, line_no, entry, spec, why = zip(*flat) if flat else ((),) * 5
            yield batch.drop(columns=[text]).iloc[list(source)].assign(
                line_no=pd.Series(line_no, dtype="int32").values,
                entry=pd.Series(entry, dtype=object).values,
                spec=pd.Series(spec, dtype=object).values,
                reason=pd.Series(why, dtype=object).values,
            )

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != text)
    return kept.mapInPandas(entries, f"{head}, line_no INT, entry STRING, spec STRING, reason STRING")


def structured_manifest_parse(
    files: DataFrame, text: str = "text", manifest: str = "manifest", keys: Sequence[str] = ("repo",)
) -> DataFrame:
    """Dependency rows of pyproject.toml, Pipfile and setup.py files.

    Requirement lines found inside are taken apart by the same expressions as line-based manifests.
    Files that cannot be read have no rows here; ``structured_manifest_rejects`` names them.
    """
    keys = list(keys)
    rows = _structured_rows(files, text, manifest, keys).where("reason is null")
    given = F.array(
        F.struct(
            F.col("entry").alias("name"),
            F.array().cast("array<string>").alias("extras"),
            F.col("spec").alias("version_spec"),
            F.lit("").alias("markers"),
        )
    )
    parsed = F.when(F.col("spec").isNotNull(), given).otherwise(R.parse_line(F.col("entry")))
    return rows.select(*keys, manifest, "line_no", F.inline(parsed))


def structured_manifest_rejects(
    files: DataFrame, text: str = "text", manifest: str = "manifest", keys: Sequence[str] = ("repo",)
) -> DataFrame:
    """Structured manifests that cannot be read, each with the ``reason``."""
    return _structured_rows(files, text, manifest, list(keys)).where("reason is not null").select(*keys, manifest, "reason")


def dependency_distinct(dependencies: DataFrame, key: str = "repo") -> DataFrame:
    """Distinct (name, version_spec) with the number of repositories using each.

    The distinct on all three columns spreads a package used everywhere over the cluster.
    """
    used = dependencies.select("name", "version_spec", key).distinct()
    return used.groupBy("name", "version_spec").agg(F.count(key).alias("n_repos"))


def dependency_rows(dependencies: DataFrame, order: Sequence[Column], key: str = "repo") -> DataFrame:
    """Each repository's dependencies with their ``position`` and the repository's full ``dependency_count``."""
    placed = order_in_group(dependencies, [key], order)
    counts = dependencies.groupBy(key).agg(F.count(F.lit(1)).alias("dependency_count"))
    return join_null_safe(placed, counts, [key])


def dependency_manifest(
    dependencies: DataFrame, order: Sequence[Column], key: str = "repo", part_size: int = 1_000
) -> DataFrame:
    """``dependency_rows`` as JSON lists of at most ``part_size`` entries, for writing.

    Every entry is in exactly one part and every part states the repository's full count, so
    a repository with very many dependencies never becomes one value.
    """
    placed = dependency_rows(dependencies, order, key)
    part = F.floor((F.col("position") - 1) / part_size).cast("long")
    entry = F.struct("position", F.struct("name", "version_spec").alias("item"))
    return (
        placed.groupBy(key, "dependency_count", part.alias("part"))
        .agg(F.sort_array(F.collect_list(entry)).alias("__list"))
        .select(key, "part", "dependency_count", F.to_json(F.col("__list.item")).alias("dependencies"))
    )


def registry_flatten(documents: DataFrame, text: str = "value") -> DataFrame:
    """Registry JSON to package rows. Of several files of a kind the last one counts."""
    # The generator keeps the parsed document as one value; as a plain column it would be
    # parsed again for every member below.
    doc = F.from_json(F.col(text), schemas.REGISTRY_JSON)
    rows = documents.select(text).select(F.explode(F.array(doc)).alias("doc")).where("doc.info is not null")

    def last(kind: str) -> Column:
        of_kind = F.filter(F.col("doc.urls"), lambda u: u["packagetype"] == kind)
        return F.try_element_at(of_kind, F.lit(-1))

    def member(kind: str, value: str) -> Column:
        found = last(kind)
        picked = found["digests"]["sha256"] if value == "sha256" else found[value]
        return F.coalesce(picked, F.lit(""))

    return rows.select(
        F.col("doc.info.name").alias("name"),
        F.col("doc.info.version").alias("version"),
        F.coalesce("doc.info.requires_dist", F.array().cast("array<string>")).alias("requires"),
        member("bdist_wheel", "url").alias("wheel_url"),
        member("bdist_wheel", "sha256").alias("wheel_sha256"),
        member("sdist", "url").alias("sdist_url"),
        member("sdist", "sha256").alias("sdist_sha256"),
    )


def requirement_edges(packages: DataFrame) -> DataFrame:
    """One row per requirement of a package, in listed order; text that does not parse is left out."""
    listed = packages.select(F.lower("name").alias("package"), F.posexplode("requires").alias("edge_no", "line"))
    parsed = listed.select("package", "edge_no", R.parse_registry_requirement(F.col("line")).alias("req"))
    return parsed.where("req is not null").select("package", "edge_no", "req.name", "req.version_spec")


def version_satisfies(candidates: DataFrame, requirements: DataFrame) -> DataFrame:
    """Per package: whether its candidate version meets every requirement on it.

    ``candidates(name, version)``, ``requirements(name, version_spec)``. Requirements are
    reduced to distinct pairs before the join, so a package required everywhere costs no more.
    """
    wanted = requirements.select(F.lower("name").alias("package"), "version_spec").distinct()
    latest = candidates.select(F.lower("name").alias("package"), "version")
    checked = wanted.join(latest, "package").withColumn("ok", satisfies("version", "version_spec"))
    return checked.groupBy("package", "version").agg(
        F.bool_and("ok").alias("compatible"), F.count(F.lit(1)).alias("n_specs")
    )


def version_conflicts(candidates: DataFrame, requirements: DataFrame) -> DataFrame:
    """Requirements that the candidate version of their package fails, with their number of uses."""
    uses = requirements.groupBy(F.lower("name").alias("package"), "version_spec").agg(
        F.count(F.lit(1)).alias("n_requirements")
    )
    latest = candidates.select(F.lower("name").alias("package"), "version")
    checked = uses.join(latest, "package").withColumn("ok", satisfies("version", "version_spec"))
    return checked.where("not ok").drop("ok")


def artifact_choice(packages: DataFrame) -> DataFrame:
    """File to install per package: wheel, else source file, else a name made up from the version."""
    def file_of(url: str) -> Column:
        return F.nullif(base_name(F.col(url)), F.lit(""))

    fallback = F.concat(F.col("name"), F.lit("-"), F.col("version"), F.lit(".tar.gz"))
    chosen = F.when(F.col("wheel_url") != "", file_of("wheel_url")).when(F.col("sdist_url") != "", file_of("sdist_url"))
    return packages.select("name", "version", F.coalesce(chosen, fallback).alias("filename"))


def offline_requirements(resolved: DataFrame, order: Sequence[Column], key: str = "repo") -> DataFrame:
    """Lines of each repository's offline requirements file: two header lines, then file names.

    Lines stay rows; see ``sources.tables.write_lines`` for writing them in line order.
    """
    placed = order_in_group(resolved, [key], order)
    line = F.struct((F.col("position") + 1).alias("line_no"), F.col("filename").alias("line"))
    header = [
        F.struct(F.lit(i).cast("long").alias("line_no"), F.lit(text).alias("line")) for i, text in enumerate([OFFLINE_HEADER, ""])
    ]
    # The first file of a repository brings the header lines along.
    lines = F.when(F.col("position") == 1, F.array(*header, line)).otherwise(F.array(line))
    return placed.select(key, F.inline(lines))


def unresolved_dependencies(required: DataFrame, packages: DataFrame) -> DataFrame:
    """Required package names that the registry does not have."""
    wanted = required.select(F.lower("name").alias("package")).distinct()
    return wanted.join(packages.select(F.lower("name").alias("package")), "package", "left_anti")
