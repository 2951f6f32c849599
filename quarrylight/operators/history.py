"""Commit history: changed paths by commit, their labels, co-change hints, commits that a text names, log parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import normal_path
from .ranks import first_rows

#: Name-status letters (fixed values).
KINDS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "type_changed"}


def commit_files(commits: DataFrame, newest: int | None = None) -> DataFrame:
    """One row per commit and distinct changed path: repo_id, revision, sha, path, kind, at (the commit's time).

    Repeated commits are united by path. ``newest``: only so many of the latest commits of each sidecar.
    """
    keys = ["repo_id", "revision"]
    changed = F.transform("changed_paths", lambda c: F.struct(normal_path(c["path"]).alias("path"), c["change_kind"].alias("kind")))
    rows = commits.select(*keys, "sha", "committed_at", F.inline(changed)).filter("path is not null")
    rows = rows.groupBy(*keys, "sha", "path").agg(F.min("kind").alias("kind"), F.max("committed_at").alias("at"))
    if newest is None:
        return rows
    shas = rows.groupBy(*keys, "sha").agg(F.max("at").alias("at"))
    return rows.join(first_rows(shas, keys, [F.desc("at"), "sha"], newest), [*keys, "sha"], "left_semi")


def labelled(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Commit files with their scope: safe, generated, sensitive, or historical_only if the inventory lacks them."""
    inv = files.select("repo_id", "path", "role", F.lit(True).alias("_known"))
    scope = F.when(F.col("_known").isNull(), "historical_only").when(F.col("role") == "generated", "generated").when(F.col("role") == "sensitive", "sensitive").otherwise("safe")
    return rows.join(inv, ["repo_id", "path"], "left").withColumn("scope", scope).drop("_known")


def commit_labels(rows: DataFrame) -> DataFrame:
    """Per commit its sorted safe files and how many others it changed."""
    safe = F.array_sort(F.collect_set(F.when(F.col("scope") == "safe", F.col("path"))))
    return rows.groupBy("repo_id", "revision", "sha").agg(safe.alias("safe_files"), F.count_if(F.col("scope") != "safe").alias("excluded"))


def co_change_hints(rows: DataFrame, anchors: DataFrame, safe: DataFrame, limit: int = 20) -> DataFrame:
    """Safe paths changed in commits that touch an anchor (and are none), by commits: count, confidence, newest 3 shas.

    anchors: repo_id, revision, path. Counts have partial results and no commit pairs arise; the best paths of a sidecar
    and the newest commits of a path are cut before the exchange, so no task gathers a sidecar.
    """
    keys = ["repo_id", "revision"]
    touched = rows.join(anchors, [*keys, "path"], "left_semi").select(*keys, "sha").distinct()
    others = rows.join(touched, [*keys, "sha"], "left_semi").join(anchors, [*keys, "path"], "left_anti").join(safe.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    counts = others.groupBy(*keys, "path").agg(F.count(F.lit(1)).alias("n"))
    best = first_rows(counts.withColumnRenamed("n", "commit_count"), keys, [F.desc("commit_count"), "path"], limit)
    last = first_rows(others.select(*keys, "path", "sha", "at"), [*keys, "path"], [F.desc("at"), "sha"], 3, "_r")
    sample = last.groupBy(*keys, "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "sha"))), lambda x: F.substring(x["sha"], 1, 8)), ",").alias("sample"))
    return best.join(sample, [*keys, "path"]).withColumn("confidence", F.round(F.least(F.col("commit_count") / 5, F.lit(0.95)), 6))


def mentioned_shas(text: Column) -> Column:
    """7 to 40 hex digits that a text with the word commit names."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b([0-9a-f]{7,40})\b"), 1)
    return F.when(F.contains(F.lower(text), F.lit("commit")), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def named_commits(texts: DataFrame, commits: DataFrame) -> DataFrame:
    """Distinct repo_id, sha of the commits that texts of their repository name by 7 or more first digits.

    texts: repo_id, text. Equal first 7 digits are the join key, the rest is compared after.
    """
    terms = texts.select("repo_id", F.explode(mentioned_shas(F.col("text"))).alias("short")).distinct().withColumn("_k", F.substring("short", 1, 7))
    shas = commits.select("repo_id", "sha").distinct().withColumn("_k", F.substring("sha", 1, 7))
    return shas.join(terms, ["repo_id", "_k"]).filter(F.startswith("sha", F.col("short"))).select("repo_id", "sha").distinct()


def parse_name_status(rows: DataFrame, raw: str, *keep: str) -> DataFrame:
    """Rows of NUL-separated name-status output: renames and copies take two paths, the others one."""
    parts = F.split(F.col(raw), "\x00")
    # a small automaton over the tokens: state holds the open letter and, of a rename, the old path
    step = lambda s, t: F.when(
        s["letter"] == "",
        F.struct(F.substring(t, 1, 1).alias("letter"), F.lit("").alias("old"), s["out"].alias("out")),
    ).when(
        s["letter"].isin("R", "C") & (s["old"] == ""),
        F.struct(s["letter"].alias("letter"), t.alias("old"), s["out"].alias("out")),
    ).otherwise(F.struct(F.lit("").alias("letter"), F.lit("").alias("old"), F.array_append(s["out"], F.struct(s["letter"].alias("letter"), F.nullif(s["old"], F.lit("")).alias("old_path"), t.alias("path"))).alias("out")))
    start = F.struct(F.lit("").alias("letter"), F.lit("").alias("old"), F.expr("cast(array() as array<struct<letter:string,old_path:string,path:string>>)").alias("out"))
    found = F.aggregate(F.filter(parts, lambda x: x != ""), start, step)["out"]
    kind = F.lit("unknown")
    for k, v in KINDS.items():
        kind = F.when(F.col("c.letter") == k, v).otherwise(kind)
    return rows.select(*keep, F.explode(found).alias("c")).select(*keep, kind.alias("kind"), "c.old_path", "c.path")


def parse_log(rows: DataFrame, raw: str, *keep: str) -> DataFrame:
    """Rows of a name-only log: a line of ``commit <sha>`` opens a commit, other lines that are not blank are its paths."""
    lines = rows.select(*keep, F.posexplode(F.split(F.col(raw), "\n")).alias("_at", "_line"))
    sha = F.when(F.col("_line").rlike("^commit [0-9a-f]{7,40}$"), F.substring("_line", 8, 40))
    lines = lines.withColumn("sha", F.last(sha, ignorenulls=True).over(Window.partitionBy(*keep).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    return lines.filter((F.trim("_line") != "") & ~F.col("_line").startswith("commit ") & F.col("sha").isNotNull()).select(*keep, "sha", F.col("_line").alias("path"))
