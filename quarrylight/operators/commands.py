"""Test commands of test files, from their extension and the nearest package data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ascii_lower

# The files that name a package manager, in the order in which they count.
MANAGERS = [("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("package-lock.json", "npm"), ("npm-shrinkwrap.json", "npm"), ("bun.lock", "bun"), ("bun.lockb", "bun")]
JVM_BUILDS = [("gradlew", "gradle"), ("build.gradle", "gradle"), ("build.gradle.kts", "gradle"), ("pom.xml", "maven")]


def folder(path: Column) -> Column:
    """The folder of a path, empty for a root file."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def folders_above(path: Column) -> Column:
    """All folders of a path, the nearest first, the root (empty) last."""
    parts = F.split(folder(path), "/")
    return F.when(folder(path) == "", F.array(F.lit(""))).otherwise(F.reverse(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))


def test_commands(files: DataFrame, tests: DataFrame) -> DataFrame:
    """repo_id, path, command of every test; null where the language has none.

    Package folders are found by an equi-join of each test's own folders with those that hold package data.
    """
    name = F.regexp_extract("path", "([^/]+)$", 1)
    rank = F.coalesce(*[F.when(name == n, i) for i, (n, _) in enumerate(MANAGERS)])
    locks = files.select("repo_id", folder(F.col("path")).alias("_dir"), rank.alias("_r"), (name == "package.json").alias("_p")).filter("_p or _r is not null")
    # a folder with package data alone has the first manager
    packages = locks.groupBy("repo_id", "_dir").agg(F.min("_r").alias("_r"), F.bool_or("_p").alias("_p")).filter("_p").select("repo_id", "_dir", F.coalesce("_r", F.lit(0)).alias("_r"))
    above = tests.filter(ascii_lower(F.col("path")).rlike(r"\.(?:ts|tsx|js|jsx)$")).select("repo_id", "path", F.posexplode(folders_above(F.col("path"))).alias("_n", "_dir"))
    nearest = above.join(packages, ["repo_id", "_dir"]).groupBy("repo_id", "path").agg(F.min_by("_r", "_n").alias("_r"))
    builds = files.filter(F.col("path").isin(*[n for n, _ in JVM_BUILDS])).groupBy("repo_id").agg(F.min(F.when(F.col("path") == "pom.xml", 1).otherwise(0)).alias("_b"))
    low, p = ascii_lower(F.col("path")), F.col("path")
    manager = F.element_at(F.array(*[F.lit(m) for _, m in MANAGERS]), F.coalesce("_r", F.lit(0)) + 1)
    single = F.regexp_extract(p, r"^tests/([^/]+)\.rs$", 1)
    klass, full = F.regexp_extract(p, r"([^/]+)\.java$", 1), F.replace(F.regexp_extract(p, r"^src/test/java/(.+)\.java$", 1), F.lit("/"), F.lit("."))
    command = (
        F.when(low.endswith(".rs"), F.when(single != "", F.concat(F.lit("cargo test --test "), single)).otherwise("cargo test"))
        .when(low.endswith(".go"), F.concat(F.lit("go test ./"), folder(p)))
        .when(low.endswith(".py"), F.concat(F.lit("pytest "), p))
        .when(low.rlike(r"\.(?:ts|tsx|js|jsx)$"), F.concat(manager, F.lit(" test "), p))
        .when(low.endswith(".java") & (F.col("_b") == 0), F.concat(F.lit("./gradlew test --tests "), F.when(full != "", full).otherwise(klass)))
        .when(low.endswith(".java") & (F.col("_b") == 1), F.concat(F.lit("mvn -Dtest="), klass, F.lit(" test")))
        .when(low.endswith(".java"), F.concat(F.lit("java test "), p))
    )
    return tests.select("repo_id", "path").join(nearest, ["repo_id", "path"], "left").join(builds, "repo_id", "left").select("repo_id", "path", command.alias("command"))
