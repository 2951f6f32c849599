"""Stored tables: hashes reused by an incremental scan, keyed writes, a cache of results, checks of repeated keys."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import first_rows


def rehashed(current: DataFrame, cached: DataFrame, keys: list[str], same: list[str], content: str = "hash") -> DataFrame:
    """An incremental scan: the cached hash where everything in ``same`` is as it was, else an empty one to be worked out."""
    old = cached.select(*keys, F.struct(*same).alias("_same"), F.col(content).alias("_hash"))
    now = current.select(*keys, *same, F.struct(*same).alias("_now"))
    kept = F.col("_same").isNotNull() & F.col("_same").eqNullSafe(F.col("_now")) & F.col("_hash").isNotNull()
    return now.join(old, keys, "left").select(*keys, *same, F.when(kept, F.col("_hash")).otherwise("").alias(content), kept.alias("reused"))


def filled(store: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """A keyed write that keeps what the incoming row leaves out: each column is the new value, or the old where that is null."""
    cols = [c for c in store.columns if c not in keys]
    a = store.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_old"))
    b = incoming.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_new"))
    outcome = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").otherwise("updated")
    return a.join(b, keys, "full_outer").select(*keys, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in cols], outcome.alias("outcome"))


def repeated(rows: DataFrame, ident: str, label: str) -> DataFrame:
    """Diagnostics of a list of named things: an id given twice is an error, a label of several ids a warning."""
    ids = rows.filter(F.col(ident).isNotNull()).groupBy(F.col(ident).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    labels = rows.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("value")).agg(F.count_distinct(ident).alias("times")).filter("times > 1")
    return ids.select(F.lit("error").alias("severity"), F.lit("repeated_id").alias("code"), "value", "times").unionByName(labels.select(F.lit("warning").alias("severity"), F.lit("repeated_label").alias("code"), "value", "times"))


def bounded(limit: Column, default: int = 10, most: int = 50) -> Column:
    """A request's limit within 1 to ``most``."""
    return F.least(F.greatest(F.coalesce(limit, F.lit(default)), F.lit(1)), F.lit(most))


def ordered_distinct(values: Column) -> Column:
    """The values of a list without nulls, each at its first place."""
    return F.array_distinct(F.array_compact(values))


def first_groups(rows: DataFrame, keys: list[str], group: str, link: str, groups: int, links: int) -> DataFrame:
    """The first groups by name of each key, with their sizes and first links."""
    n = rows.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("members"))
    top = first_rows(n, keys, [F.asc(group)], groups, "_g").drop("_g")
    some = first_rows(rows.select(*keys, group, link).distinct(), [*keys, group], [F.asc(link)], links, "_l")
    return top.join(some.groupBy(*keys, group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_l", link))), lambda x: x[link]), ",").alias("links")), [*keys, group])


def cached_result(spark: SparkSession, folder: str, parts: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of a query kept under the hash of what they depend on (query, limit, fingerprint of the data).

    A result that is there is read, with its rows in the order in which they were kept only if they hold it; another is
    made, written whole, and read. Results of other fingerprints are other files, so none is ever stale.
    """
    at = f"{folder.rstrip('/')}/{hashlib.sha256(chr(0).join(parts).encode()).hexdigest()}"
    try:
        spark.read.text(f"{at}/_SUCCESS")
        return spark.read.parquet(at)
    except AnalysisException:
        make().write.mode("overwrite").parquet(at)
        return spark.read.parquet(at)
