"""Event logs and snapshots as JSON lines: readers with fixed schemas, validated append, versioned sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.store import repeated

TRACE = "schema_version int, trace_id string, task string, created bigint, target_paths array<string>"
FEEDBACK = "schema_version int, event_id string, session string, outcome string, budget string, created bigint, recommended_files array<string>, read_files array<string>, edited_files array<string>, source_text_logged boolean"
SIDECAR = "schema_version int, revision string, commits array<struct<sha string, files array<string>>>"


def read_log(spark: SparkSession, path: str, schema: str, limit: int | None = None, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines log, newest first; a malformed line fails the read if ``strict``, else it is dropped."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("pathGlobFilter", "*.json*").json(path)
    if "created" in rows.columns:
        rows = rows.orderBy(F.desc("created"), *[c for c in rows.columns if c.endswith("_id")][:1])
    return rows if limit is None else rows.limit(max(1, limit))


def read_sidecar(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Commits of a history sidecar, a row per commit; another version raises when it is met."""
    rows = spark.read.schema(SIDECAR).option("multiLine", True).json(path)
    ok = F.when(F.col("schema_version") == version, F.col("commits")).otherwise(F.raise_error(F.lit("unknown sidecar version")))
    return rows.select("revision", F.posexplode(ok).alias("ord", "c")).select("revision", "ord", "c.sha", "c.files")


def bad_feedback() -> Column:
    """Why a feedback row may not be appended; null if it may."""
    paths = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("recommended_files", "read_files", "edited_files")])
    return (
        F.when(F.coalesce("source_text_logged", F.lit(False)), "source text was logged")
        .when(~F.coalesce(F.col("schema_version") == 1, F.lit(False)), "unknown version")
        .when(F.coalesce(F.trim("session"), F.lit("")) == "", "empty session")
        .when(F.length("session") > 512, "session too long")
        .when(F.col("session").rlike("[\r\n]|```"), "session is not one plain line")
        .when(F.exists(paths, lambda p: p.isNull() | F.startswith(p, F.lit("/")) | p.rlike(r"(?:^|/)\.\.(?:/|$)")), "path is not inside the repository")
    )


def append_feedback(rows: DataFrame, path: str) -> DataFrame:
    """Append valid rows to the log; the rejected ones come back with their reason."""
    told = rows.withColumn("_why", bad_feedback())
    told.filter("_why is null").drop("_why").write.mode("append").json(path)
    return told.filter("_why is not null").withColumnRenamed("_why", "rejected")


def try_append(rows: DataFrame, path: str, what: str) -> DataFrame:
    """Append rows to a log; one row says how that went, and a failure is a status, no error: what, status, rows, message."""
    spark = rows.sparkSession
    try:
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
        told = ("appended", seen.get["n"], None)
    except Exception as e:  # noqa: BLE001
        told = ("failed", 0, str(e).split("\n")[0][:500])
    return spark.createDataFrame([(what, *told)], "what string, status string, rows bigint, message string")


def read_reports(spark: SparkSession, folder: str, schema: str, ident: str, created: str = "created") -> DataFrame:
    """Reports of a folder, a JSON document a file: the newest first, then by id; other files are left alone.

    A document that doesn't parse has a row with nulls and its text in ``_broken``.
    """
    rows = spark.read.schema(f"{schema}, _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", "*.json").json(folder)
    return rows.orderBy(F.desc_nulls_last(created), ident)


def read_workspace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The repositories of a workspace manifest, and its diagnostics: ids given twice, labels of several ids, absent parts."""
    rows = spark.read.schema("version int, repos array<struct<id string, label string, root string>>").option("multiLine", True).json(path)
    repos = rows.select("version", F.posexplode("repos").alias("ord", "r")).select("version", "ord", "r.*")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    absent = repos.select(F.lit("error").alias("severity"), F.when(blank(F.col("id")), "no_id").when(blank(F.col("root")), "no_root").alias("code"), F.col("ord").cast("string").alias("value"), F.lit(1).cast("bigint").alias("times")).filter("code is not null")
    return repos, repeated(repos, "id", "label").unionByName(absent)
