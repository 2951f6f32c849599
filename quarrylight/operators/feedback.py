"""Session feedback: summaries, proxies of quality, outcomes by budget, learned weights and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGETS = {"brief": 4_000, "standard": 16_000, "deep": 64_000}


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def summary(events: DataFrame) -> DataFrame:
    """Events and distinct files by kind of event."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("file").alias("files"), F.countDistinct("user_id").alias("users"))


def outcomes(sessions: DataFrame) -> DataFrame:
    """By budget: sessions, pass, blocked and correction rates, files read and useful files per 1,000 tokens."""
    tokens = F.lit(0)
    for name, n in BUDGETS.items():
        tokens = F.when(F.col("budget") == name, n).otherwise(tokens)
    n = F.count(F.lit(1))
    return sessions.groupBy("budget").agg(
        n.alias("sessions"), F.round(ratio(F.count_if(F.col("outcome") == "passed"), n), 6).alias("pass_rate"), F.round(ratio(F.count_if(F.col("outcome") == "blocked"), n), 6).alias("blocked_rate"),
        F.round(ratio(F.count_if(F.col("corrected") > 0), n), 6).alias("correction_rate"), F.round(F.avg("read"), 6).alias("files_read"), F.round(ratio(1000 * F.sum("useful"), F.sum(tokens)), 6).alias("useful_per_1k"),
    )


def proxies(sessions: DataFrame) -> DataFrame:
    """Precision and recall of what was recommended, by budget: |recommended and useful| over either."""
    hit = F.size(F.array_intersect("recommended_files", "useful_files"))
    s = lambda c: F.sum(F.size(c))
    return sessions.groupBy("budget").agg(
        F.sum(hit).alias("hits"), s("recommended_files").alias("recommended"), s("useful_files").alias("useful"), F.round(ratio(F.sum(hit), s("recommended_files")), 6).alias("precision"), F.round(ratio(F.sum(hit), s("useful_files")), 6).alias("recall"), s(F.array_except("useful_files", "recommended_files")).alias("missing"),
    )


def learned_weights(rows: DataFrame, low: float = 0.5, high: float = 1.5) -> DataFrame:
    """Per signal the useful rows' share of its score mass against that of all rows, clamped."""
    total = rows.agg(F.sum(F.when(F.col("useful"), F.col("score"))).alias("_u"), F.sum("score").alias("_a"))
    by = rows.groupBy("signal").agg(F.coalesce(F.sum(F.when(F.col("useful"), F.col("score"))), F.lit(0.0)).alias("u"), F.sum("score").alias("a"))
    lift = ratio(F.col("u") / F.greatest(F.col("_u"), F.lit(1.0)), F.col("a") / F.greatest(F.col("_a"), F.lit(1.0)))
    return by.join(total).select("signal", F.round(F.greatest(F.lit(low), F.least(F.lit(high), lift)), 6).alias("weight"), F.round("u", 4).alias("useful_score"), F.round("a", 4).alias("score"))


def gates(values: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Long rows gate, value, threshold, passed of a one-row table, and whether all pass."""
    rows = values.select(F.inline(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("threshold")) for k, v in limits.items()])))
    rows = rows.withColumn("passed", F.col("value") + 1e-6 >= F.col("threshold"))
    return rows.unionByName(rows.agg(F.lit("all").alias("gate"), F.count_if("passed").cast("double").alias("value"), F.count(F.lit(1)).cast("double").alias("threshold"), F.bool_and("passed").alias("passed")))


def activated(profiles: DataFrame, profile_id: str) -> DataFrame:
    """The registry with one profile active and any other active one disabled; unknown or ineligible ids raise."""
    known = profiles.filter((F.col("profile_id") == profile_id) & F.col("default_eligible")).limit(1).count()
    if not known:
        raise ValueError(f"profile {profile_id} is unknown or not eligible")
    return profiles.withColumn("status", F.when(F.col("profile_id") == profile_id, "active").when(F.col("status") == "active", "disabled").otherwise(F.col("status")))
