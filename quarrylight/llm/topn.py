"""The N best items of every group, exactly, also where groups are huge, skewed or tied.

Method: the highest score of each item is taken by one aggregate over (group, item), which combines rows before its
exchange and spreads a group of any size over all tasks. A histogram of these scores per group, over a fixed monotone
scale, gives the lowest bin that still leaves at least N items at or above it. The thresholds of the ``GROUPS`` largest
groups, a table of two numbers a group and so of bounded size, are broadcast and drop the items below before anything
is ranked; smaller groups go on whole, since a threshold only saves work. Survivors are ranked by one row number, whose
limit the planner applies in every task before the exchange, so a hot group sends N rows a task at most, even where all
scores tie. Where N passes what the planner limits that way, a first rank inside (group, salt of the item) does the same.

The limits of groups travel as rows of the same windows, ahead of the group's items; they are never joined.

Bins are ``floor(16 * log1p(1024 * |score|))`` with the score's sign. The JVM's log1p is semi-monotonic, products and
floor are monotone, so a higher score never lies in a lower bin and the threshold is safe. Two groups whose keys have the
same hash get no threshold.

Defined results: rows with a null item, null or NaN score are left out; infinite scores count; an item counts once per
group with its highest score; ties go by item ascending in byte order; N below 1 is taken as 1, a null N as
``default_n``; of several limits of a group the largest holds; null keys form a group; extra columns of any name are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups whose thresholds are broadcast: two numbers each.
GROUPS = 100_000
#: Parts of a group in the first rank of large N.
SALTS = 16
#: The largest row number that the planner limits before an exchange (its default).
LIMITED = 999


def score_bin(score: Column) -> Column:
    """A monotone, coarse integer scale of doubles."""
    size = F.floor(16 * F.log1p(1024 * F.least(F.abs(score), F.lit(1e300)))).cast("int")
    return F.when(score < 0, -size - 1).otherwise(size)


def _ranked(items: DataFrame, limits: DataFrame | None, parts: list[str], n: int, most: int) -> DataFrame:
    """Rows of ``items`` whose rank within ``parts`` is at most the group's limit; ``most`` is the largest limit."""
    rows = items.select(*parts, "_item", "_score", F.lit(None).cast("int").alias("_want"))
    if limits is not None:
        rows = rows.unionByName(limits.select(*parts, F.lit(None).cast(items.schema["_item"].dataType).alias("_item"), F.lit(None).cast("double").alias("_score"), "_want"))
    order = Window.partitionBy(*parts).orderBy(F.asc_nulls_last("_want"), F.desc("_score"), F.asc("_item"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_r", F.row_number().over(order)).withColumn("_limit", F.max("_want").over(so_far)).filter(F.col("_r") <= most + 1)
    rows = rows.withColumn("_r", F.col("_r") - F.col("_limit").isNotNull().cast("int"))
    return rows.filter(F.col("_item").isNotNull() & (F.col("_r") <= F.coalesce("_limit", F.lit(n))))


def top_n_per_group(rows: DataFrame, keys: list[str], item: str, score: str, n: int | DataFrame = 10, n_col: str = "n", default_n: int = 10, groups: int = GROUPS) -> DataFrame:
    """Columns ``keys``, ``item``, ``score``, ``rank`` (from 1). ``n``: one number, or a table of ``keys`` and ``n_col``."""
    k = [f"_k{i}" for i in range(len(keys))]
    base = rows.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(item).alias("_item"), F.col(score).cast("double").alias("_score"))
    base = base.filter(F.col("_item").isNotNull() & F.col("_score").isNotNull() & ~F.isnan("_score"))
    items = base.groupBy(*k, "_item").agg(F.max("_score").alias("_score"))

    limits, most, n_all = None, 1, default_n
    if isinstance(n, DataFrame):
        limits = n.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(n_col).cast("int").alias("_want")).groupBy(*k).agg(F.max("_want").alias("_want"))
        limits = limits.select(*k, F.greatest(F.lit(1), F.coalesce("_want", F.lit(default_n))).alias("_want"))
        most = limits.agg(F.max("_want")).first()[0] or 1
    else:
        n_all = n
    n_all = max(1, n_all)
    most = max(most, n_all)

    bins = items.groupBy(*k, score_bin(F.col("_score")).alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    told = bins.withColumn("_want", F.lit(None).cast("int"))
    if limits is not None:
        told = told.unionByName(limits.select(*k, F.lit(None).cast("int").alias("_bin"), F.lit(0).cast("bigint").alias("_c"), "_want"))
    down = Window.partitionBy(*k).orderBy(F.desc_nulls_first("_bin")).rowsBetween(Window.unboundedPreceding, 0)
    low = (
        told.withColumn("_cum", F.sum("_c").over(down))
        .withColumn("_limit", F.coalesce(F.max("_want").over(down), F.lit(n_all)))
        .groupBy(*k)
        .agg(F.max("_cum").alias("_size"), F.max(F.when(F.col("_cum") >= F.col("_limit"), F.col("_bin"))).alias("_low"))
        .groupBy(_hash(k).alias("_h"))
        .agg(F.max("_size").alias("_size"), F.max("_low").alias("_low"), F.count(F.lit(1)).alias("_same"))
        .filter(F.col("_low").isNotNull() & (F.col("_same") == 1))
        .orderBy(F.desc("_size"), "_h")
        .limit(groups)
        .select(F.col("_h").alias("_lh"), "_low")
    )
    kept = items.join(F.broadcast(low), _hash(k) == F.col("_lh"), "left").filter(F.col("_low").isNull() | (score_bin(F.col("_score")) >= F.col("_low")))
    if most > LIMITED:
        salt = F.pmod(F.xxhash64("_item"), F.lit(SALTS)).cast("int")
        salted = None if limits is None else limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        kept = _ranked(kept.withColumn("_salt", salt), salted, [*k, "_salt"], n_all, most)
    best = _ranked(kept, limits, k, n_all, most)
    return best.select(*[F.col(a).alias(c) for a, c in zip(k, keys)], F.col("_item").alias("item"), F.col("_score").alias("score"), F.col("_r").alias("rank"))


def _hash(keys: list[str]) -> Column:
    """A hash of the keys in which nulls have their place."""
    return F.xxhash64(*[x for c in keys for x in (F.isnull(c), F.col(c))])
