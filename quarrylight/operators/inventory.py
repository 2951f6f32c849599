"""The file inventory: current files, guarded reads, summaries, fingerprints, snapshot diff and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import area, language, role

SAFE = ("source", "test", "config", "schema", "docs")
#: Texts beyond this many bytes are not read.
MOST_BYTES = 1_000_000


def current_files(files: DataFrame) -> DataFrame:
    """The newest scan of each file, with its role, language and area by path."""
    cols = ("size_bytes", "hash", "generated", "ignored", "scanned_at")
    last = files.groupBy("repo_id", "path").agg(F.max_by(F.struct(*cols), F.struct("scanned_at", "hash")).alias("f")).select("repo_id", "path", "f.*")
    p = F.col("path")
    return last.withColumns({"role": role(p), "language": language(p), "area": area(p)})


def safe_files(files: DataFrame, roles: tuple[str, ...] = SAFE) -> DataFrame:
    """Files that other operators may use: of a telling role, not ignored, not marked as generated."""
    return files.filter(F.col("role").isin(*roles) & ~F.coalesce("ignored", F.lit(False)) & ~F.coalesce("generated", F.lit(False)))


def guarded_status(content: Column, excluded: Column, size: Column, most: int = MOST_BYTES) -> Column:
    """policy_excluded, oversized, unreadable, binary, non_utf8 or read: the first that holds, content being bytes."""
    return (
        F.when(excluded, "policy_excluded").when(size > most, "oversized").when(content.isNull(), "unreadable").when(F.contains(content, F.lit(bytearray(1))), "binary").when(~F.is_valid_utf8(content.cast("string")), "non_utf8").otherwise("read")
    )


def role_counts(files: DataFrame, *by: str) -> DataFrame:
    return files.groupBy(*by, "role").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"))


def fingerprint(files: DataFrame, *by: str) -> DataFrame:
    """One hash per group over its files in path order.

    Files are hashed into 64 path ranges of their own first, so that a task gathers 32 characters a file of one range.
    """
    row = F.md5(F.concat_ws("|", "path", "hash", F.col("size_bytes").cast("string"), "role"))
    part = F.substring(F.md5("path"), 1, 2)
    ranges = files.select(*by, part.alias("_part"), "path", row.alias("_row")).groupBy(*by, "_part").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "_row"))), lambda x: x["_row"]), "")).alias("_h"), F.count(F.lit(1)).alias("_n"))
    return ranges.groupBy(*by).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_h"))), lambda x: x["_h"]), "")).alias("fingerprint"), F.sum("_n").alias("files"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """Keys and state of every row that differs: created, deleted or changed."""
    a = old.select(*[F.col(k) for k in keys], F.struct(*same).alias("_old"))
    b = new.select(*[F.col(k) for k in keys], F.struct(*same).alias("_new"))
    both = a.join(b, keys, "full_outer")
    state = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(*keys, state.alias("state")).filter("state is not null")


def merged(store: DataFrame, incoming: DataFrame, keys: list[str], cols: list[str], prune: bool = True) -> DataFrame:
    """The store after a merge, each row with its outcome: inserted, updated, reused, kept or deleted."""
    s = store.select(*keys, F.struct(*cols).alias("_s"))
    i = incoming.select(*keys, F.struct(*cols).alias("_i"))
    outcome = F.when(F.col("_s").isNull(), "inserted").when(F.col("_i").isNull(), "deleted" if prune else "kept").when(F.col("_s").eqNullSafe(F.col("_i")), "reused").otherwise("updated")
    return s.join(i, keys, "full_outer").select(*keys, F.coalesce("_i", "_s").alias("_v"), outcome.alias("outcome")).select(*keys, "_v.*", "outcome")


def upserted(store: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, incoming rows before stored ones, the highest ``order`` first."""
    rows = store.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    cols = [c for c in store.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("_new", order)).alias("_v")).select(*keys, "_v.*")
