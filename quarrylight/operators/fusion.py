"""Fusion of signals into ranked candidates, floors and quotas, reranking, and areas of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What each signal weighs, in tie order.
WEIGHTS = {
    "anchor": 2.0, "current_diff": 2.0, "co_change": 1.35, "symbol": 1.05, "lexical": 1.0, "related_test": 0.9, "lexical_expansion": 0.8, "memory": 0.75, "history": 0.65, "semantic": 0.45, "dependency": 0.45, "config": 0.25, "docs": 0.2,
}


def weight(signal: Column) -> Column:
    out = F.lit(0.0)
    for k, v in WEIGHTS.items():
        out = F.when(signal == k, v).otherwise(out)
    return out


def decayed(confidence: Column, rank: Column) -> Column:
    """A dependency's score by its rank: never above its confidence nor below 0.05."""
    return F.greatest(F.least(F.lit(0.05), confidence), F.least(confidence, confidence - 0.001 * F.least(rank, F.lit(200))))


def fused(signals: DataFrame, keys: list[str]) -> DataFrame:
    """keys with rank_score (sum of score * weight over all signals), each signal's best, the lexical rank, confidence.

    signals: keys, signal, score, lexical_rank. One aggregation with partial results.
    """
    rows = signals.withColumn("_w", F.col("score") * weight(F.col("signal")))
    best = rows.groupBy(*keys, "signal").agg(F.sum("_w").alias("_sum"), F.max("_w").alias("_best"), F.min("lexical_rank").alias("_rank"))
    out = best.groupBy(*keys).agg(
        F.round(F.sum("_sum"), 6).alias("rank_score"), F.min("_rank").alias("lexical_rank"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"),
        # a lexical score is that of the hits or of their expansion, whichever is higher
        *[F.round(F.max(F.when(F.col("signal").isin(*of), F.col("_best"))), 6).alias(f"{s}_score") for s, of in (("lexical", ("lexical", "lexical_expansion")), ("dependency", ("dependency",)), ("co_change", ("co_change",)))],
    )
    return out.withColumn("confidence", F.greatest(F.lit(0.15), F.least(F.lit(0.98), F.col("rank_score"))))


def selected(candidates: DataFrame, group: list[str], budget: int = 10) -> DataFrame:
    """Quota selection: each stage offers its best rows, rows a former stage has taken use up its quota too.

    Stages: lexical floor (half the budget, 1-5), history floor (a quarter, 1-3), dependency floor (a quarter, 1-3), then
    the rest by rank score; the budget goes to the first by stage and place.
    """
    clamp = lambda n, hi: max(1, min(hi, n))
    stages = [
        ("lexical", (F.col("role") == "source") & (F.col("lexical_score") >= 0.3), "lexical_score", clamp(-(-budget // 2), 5)),
        ("history", (F.col("role") == "source") & (F.col("co_change_score") >= 0.5), "co_change_score", clamp(-(-budget // 4), 3)),
        ("dependency", (F.col("role") == "source") & F.col("dependency_score").isNotNull(), "dependency_score", clamp(-(-budget // 4), 3)),
        ("rank", F.lit(True), "rank_score", budget),
    ]
    rows = candidates
    taken = []
    for i, (_, ok, by, quota) in enumerate(stages):
        # all places share one partitioning: rows of the stage stand first in their group
        fits = F.coalesce(ok, F.lit(False))
        place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(fits), F.desc_nulls_last(by), F.desc("rank_score"), "path"))
        rows = rows.withColumn(f"_p{i}", F.when(fits, place))
        taken.append(F.when(F.col(f"_p{i}") <= quota, F.struct(F.lit(i).alias("stage"), F.col(f"_p{i}").alias("place"))))
    rows = rows.withColumn("_s", F.array_min(F.array_compact(F.array(*taken)))).filter("_s is not null")
    name = F.element_at(F.array(*[F.lit(s[0]) for s in stages]), F.col("_s.stage") + 1)
    rows = rows.withColumn("slot", F.row_number().over(Window.partitionBy(*group).orderBy("_s.stage", "_s.place", "path"))).filter(F.col("slot") <= budget)
    return rows.select(*group, "path", "role", "rank_score", "signals", name.alias("stage"), F.col("slot").cast("bigint").alias("slot"))


def reranked(candidates: DataFrame, group: list[str]) -> DataFrame:
    """Protected rows first (sources with lexical evidence), then rank score plus 0.05 a signal."""
    protected = (F.col("role") == "source") & F.col("lexical_score").isNotNull()
    score = F.round(F.col("rank_score") + 0.05 * F.size(F.split("signals", ",")), 6)
    w = Window.partitionBy(*group).orderBy(F.desc("protected"), F.desc("rerank_score"), F.desc("rank_score"), "path")
    return candidates.withColumns({"protected": protected, "rerank_score": score}).withColumn("rerank", F.row_number().over(w).cast("bigint"))


def area_rollup(candidates: DataFrame, chosen: DataFrame, group: list[str]) -> DataFrame:
    """Per area of a plan: candidates, selected, coverage percent, and the pressure of what is left (3, 2 and 1 a file)."""
    picked = chosen.select(*group, "path", F.lit(True).alias("_picked"))
    rows = candidates.join(picked, [*group, "path"], "left").withColumn("_in", F.coalesce("_picked", F.lit(False)))
    left = lambda r: F.count_if((F.col("role") == r) & ~F.col("_in"))
    out = rows.groupBy(*group, "area").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("_in").alias("selected"), left("source").alias("_s"), left("test").alias("_t"), left("docs").alias("_d"), F.max("rank_score").alias("best"))
    pressure = 3 * F.col("_s") + 2 * F.col("_t") + F.col("_d")
    return out.select(*group, "area", "candidates", "selected", F.floor(100 * F.col("selected") / F.col("candidates")).cast("bigint").alias("coverage"), pressure.alias("pressure"), F.when(pressure >= 9, "high").when(pressure >= 3, "medium").otherwise("low").alias("priority"))
