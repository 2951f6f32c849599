"""Retrieval quality: recall, precision, reciprocal rank, roles, lift, ablation, token return, gaps and comparisons.

Averages over queries are macro means. Input is one table of ranked candidates: query, path, role, relevant, and a rank
per variant (null where the variant does not hold the row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import first_rows

from .feedback import ratio

BUDGET_TABLE = [("brief", 5, 4_000), ("standard", 10, 24_000), ("deep", 20, 100_000)]


def per_query(rows: DataFrame, rank: str, query: str = "query", ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Targets, hits and recall at each k, precision at the fixed k, and reciprocal rank within the last k, per query."""
    rel = F.col("relevant")
    agg = [F.count_if(rel).alias("targets")]
    for k in ks:
        agg.append(F.count_if(rel & (F.col(rank) <= k)).alias(f"hits_{k}"))
    agg.append(F.min(F.when(rel & (F.col(rank) <= ks[-1]), F.col(rank))).alias("_first"))
    out = rows.groupBy(query).agg(*agg).filter("targets > 0")
    for k in ks:
        out = out.withColumn(f"recall_{k}", ratio(F.col(f"hits_{k}"), F.col("targets"))).withColumn(f"precision_{k}", F.col(f"hits_{k}") / F.lit(float(k)))
    return out.withColumn("rr", F.coalesce(1.0 / F.col("_first"), F.lit(0.0))).drop("_first")


def metrics(rows: DataFrame, variants: dict[str, str], ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """A row per variant: queries, macro and micro recall, precision, mean reciprocal rank."""
    out = None
    for name, rank in variants.items():
        q = per_query(rows, rank, ks=ks)
        one = q.agg(
            F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(f"recall_{k}"), 6).alias(f"recall_{k}") for k in ks], *[F.round(F.avg(f"precision_{k}"), 6).alias(f"precision_{k}") for k in ks],
            F.round(ratio(F.sum(f"hits_{ks[-1]}"), F.sum("targets")), 6).alias("micro_recall"), F.round(F.avg("rr"), 6).alias("mrr"),
        ).select(F.lit(name).alias("variant"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def role_recall(rows: DataFrame, rank: str, k: int = 10) -> DataFrame:
    rel = rows.filter("relevant")
    return rel.groupBy("role").agg(F.count(F.lit(1)).alias("changed"), F.count_if(F.col(rank) <= k).alias("hits"), F.round(ratio(F.count_if(F.col(rank) <= k), F.count(F.lit(1))), 6).alias("recall"))


def token_return(rows: DataFrame, rank: str) -> DataFrame:
    """Per budget: useful files, useful per 1,000 tokens, what the budget adds to the one before, and if that is little."""
    spark = rows.sparkSession
    budgets = spark.createDataFrame([(n, i, k, t) for i, (n, k, t) in enumerate(BUDGET_TABLE)], "budget string, ord int, cutoff int, tokens int")
    counts = rows.agg(*[F.count_if(F.col("relevant") & (F.col(rank) <= k)).alias(n) for n, k, _ in BUDGET_TABLE])
    long = counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("budget"), F.col(n).alias("useful")) for n, _, _ in BUDGET_TABLE])))
    w = Window.orderBy("ord")  # three rows
    out = budgets.join(long, "budget").withColumn("marginal", F.col("useful") - F.coalesce(F.lag("useful").over(w), F.lit(0)))
    return out.select("budget", F.col("cutoff").cast("bigint").alias("cutoff"), F.col("tokens").cast("bigint").alias("tokens"), "useful", F.round(1000 * F.col("useful") / F.col("tokens"), 6).alias("per_1k"), "marginal", (F.col("marginal") == 0).alias("little_value"))


def gaps(rows: DataFrame, rank: str, other: str, k: int = 10) -> DataFrame:
    """Relevant rows that a variant misses, by kind of gap and role: count and the first three paths."""
    miss = rows.filter(F.col("relevant") & (F.col(rank).isNull() | (F.col(rank) > k)))
    gap = F.when(F.col(rank).isNull() & F.col(other).isNull(), "no_candidate_signal").when(F.col(other) <= k, "other_only_hit").otherwise("ranked_too_low")
    # three paths of each kind at most leave a task before the last aggregate
    paths = miss.groupBy(gap.alias("gap"), "role", "path").agg(F.count(F.lit(1)).alias("n"))
    some = first_rows(paths, ["gap", "role"], [F.asc("path")], 3).groupBy("gap", "role").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("examples"))
    kinds = paths.groupBy(F.col("gap").alias("_g"), F.col("role").alias("_r")).agg(F.sum("n").alias("misses"))
    return some.join(kinds, F.col("gap").eqNullSafe(F.col("_g")) & F.col("role").eqNullSafe(F.col("_r"))).select("gap", "role", "misses", "examples")


def top_missing(rows: DataFrame, rank: str, k: int = 10, limit: int = 20) -> DataFrame:
    miss = rows.filter(F.col("relevant") & (F.col(rank).isNull() | (F.col(rank) > k)))
    return miss.groupBy("path", "role").agg(F.count(F.lit(1)).alias("misses")).orderBy(F.desc("misses"), "path", "role").limit(limit)


def backends(rows: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """Two rankings: overlap in the first k, a top that changed, and who wins by reciprocal rank, over queries."""
    q = rows.groupBy("query").agg(
        F.count_if((F.col(a) <= k) & (F.col(b) <= k)).alias("both"), F.max(F.when(F.col(a) == 1, F.col("path"))).alias("ta"), F.max(F.when(F.col(b) == 1, F.col("path"))).alias("tb"),
        F.min(F.when(F.col("relevant"), F.col(a))).alias("fa"), F.min(F.when(F.col("relevant"), F.col(b))).alias("fb"),
    )
    win = F.when(F.col("fa").isNull() & F.col("fb").isNull(), "none").when(F.col("fb").isNull() | (F.col("fa") < F.col("fb")), "a").when(F.col("fa").isNull() | (F.col("fb") < F.col("fa")), "b").otherwise("tie")
    return q.groupBy(win.alias("winner")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("both"), 6).alias("overlap"), F.count_if(~F.col("ta").eqNullSafe(F.col("tb"))).alias("top_changed"))


def compared(base: DataFrame, head: DataFrame, key: str, value: str, drop: float) -> DataFrame:
    """Metric by metric head - base, and whether it dropped by more than is allowed."""
    j = base.select(key, F.col(value).alias("base")).join(head.select(key, F.col(value).alias("head")), key, "full_outer")
    return j.withColumn("delta", F.round(F.coalesce("head", F.lit(0.0)) - F.coalesce("base", F.lit(0.0)), 6)).withColumn("regressed", F.col("delta") < -drop)


def verdict(lift: Column, least: float = 0.01, most: float = 0.01) -> Column:
    return F.when(lift.isNull(), "insufficient_evidence").when(lift >= least, "lift").when(lift < -most, "regression").otherwise("neutral")
