"""More queries of retrieval quality and of workspaces, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, inventory
from ..operators.feedback import ratio
from ..operators.ranks import first_rows
from ..sources.tables import table
from . import code, ranking

STEPS = [round(0.1 * i, 1) for i in range(1, 10)]
CUTOFF = "2024-01-16"


def candidate_coverage(spark, sf_dir):
    """Relevant rows beyond the first two of a variant: which another variant's first five recover, and which no one has."""
    r = ranking.ranked(spark, sf_dir).filter("relevant and (rank_cut is null or rank_cut > 2)")
    return r.groupBy("role").agg(F.count(F.lit(1)).alias("missed"), F.count_if(F.col("rank_combined") <= 5).alias("recoverable"), F.count_if(F.col("rank_cut").isNull() & (F.col("rank_combined") > 5)).alias("no_candidate"))


def candidate_retention(spark, sf_dir):
    """Retained or dropped against target or not, by role, side by side."""
    r = ranking.ranked(spark, sf_dir)
    kept, rel = F.coalesce(F.col("rank_cut") <= 2, F.lit(False)), F.col("relevant")
    return r.groupBy("role").agg(F.count_if(kept & rel).alias("kept_target"), F.count_if(kept & ~rel).alias("kept_other"), F.count_if(~kept & rel).alias("dropped_target"), F.count_if(~kept & ~rel).alias("dropped_other"))


def threshold_sweep(spark, sf_dir):
    """Edges at or above each confidence, by kind; the thresholds are nine values in the row."""
    e = graph.clean_edges(table(spark, sf_dir, "edges")).select("kind", "confidence", F.explode(F.array(*[F.lit(s) for s in STEPS])).alias("threshold"))
    return e.groupBy("kind", "threshold").agg(F.count_if(F.col("confidence") >= F.col("threshold")).alias("kept"), F.round(ratio(F.count_if(F.col("confidence") >= F.col("threshold")), F.count(F.lit(1))), 6).alias("share"))


def cross_repo_names(spark, sf_dir):
    """File names that two or more repositories hold."""
    f = code.files(spark, sf_dir).select("repo_id", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    return f.groupBy("name").agg(F.countDistinct("repo_id").alias("repositories"), F.count(F.lit(1)).alias("files")).filter("repositories >= 2")


def train_test_lift(spark, sf_dir):
    """Event types whose mean value beats the mean on the days before a cutoff, tested on the days from it on."""
    e = table(spark, sf_dir, "events").withColumn("train", F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz"))
    mean = lambda c: F.avg(F.when(c, F.col("value")))
    all_ = e.agg(mean(F.col("train")).alias("a"), mean(~F.col("train")).alias("b"))
    by = e.groupBy("event_type").agg(mean(F.col("train")).alias("t"), mean(~F.col("train")).alias("u"))
    return by.join(all_).select("event_type", (F.round(F.col("t") - F.col("a"), 4) + 0.0).alias("train_lift"), (F.round(F.col("u") - F.col("b"), 4) + 0.0).alias("test_lift"), (F.round(F.col("t") - F.col("a"), 4) > 0).alias("eligible"))


def workspace_rollup(spark, sf_dir):
    """Per repository what it has, and a confidence: .45 with targets (else .05), +.25 tests, +.15 history, +.10 graph."""
    f = inventory.safe_files(code.files(spark, sf_dir)).groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("role") == "source").alias("sources"), F.count_if(F.col("role") == "test").alias("tests"), F.countDistinct("language").alias("languages"))
    c = table(spark, sf_dir, "commits").groupBy("repo_id").agg(F.countDistinct("sha").alias("commits"))
    e = graph.clean_edges(table(spark, sf_dir, "edges")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges"))
    j = f.join(c, "repo_id", "left").join(e, "repo_id", "left").fillna(0, ["commits", "edges"])
    on = lambda c, v: F.when(F.col(c) > 0, v).otherwise(0.0)
    conf = F.when(F.col("sources") > 0, 0.45).otherwise(0.05) + on("tests", 0.25) + on("commits", 0.15) + on("edges", 0.1)
    return j.withColumn("confidence", F.round(F.least(F.lit(0.95), conf), 6))


def slow_commits(spark, sf_dir):
    """The three commits of each repository that took longest to arrive, and the mean delay in seconds."""
    c = table(spark, sf_dir, "commits").select("repo_id", "sha", F.floor((F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("committed_at").cast("timestamp"))) / 1_000_000).alias("delay"))
    one = c.groupBy("repo_id", "sha").agg(F.min("delay").alias("delay"))
    top = first_rows(one, ["repo_id"], [F.desc("delay"), "sha"], 3)
    mean = one.groupBy("repo_id").agg(F.round(F.avg("delay"), 2).alias("mean_delay"))
    return top.join(mean, "repo_id").select("repo_id", "sha", "delay", F.col("rank").cast("bigint").alias("rank"), "mean_delay")


R = ranking.RANKED_SQL
SQL = {
    "candidate_coverage": R + " SELECT role, count(*) AS missed, count(*) FILTER (rank_combined <= 5) AS recoverable, count(*) FILTER (rank_cut IS NULL AND rank_combined > 5) AS no_candidate FROM r WHERE relevant AND (rank_cut IS NULL OR rank_cut > 2) GROUP BY 1",
    "candidate_retention": R + ", k AS (SELECT *, coalesce(rank_cut <= 2, false) AS kept FROM r) SELECT role, count(*) FILTER (kept AND relevant) AS kept_target, count(*) FILTER (kept AND NOT relevant) AS kept_other, count(*) FILTER (NOT kept AND relevant) AS dropped_target, count(*) FILTER (NOT kept AND NOT relevant) AS dropped_other FROM k GROUP BY 1",
    "threshold_sweep": code.W + f", x AS (SELECT kind, confidence, unnest({STEPS}::DOUBLE[]) AS threshold FROM edges_) SELECT kind, threshold, count(*) FILTER (confidence >= threshold) AS kept, round(count(*) FILTER (confidence >= threshold) / count(*)::DOUBLE, 6) AS share FROM x GROUP BY 1, 2",
    "cross_repo_names": code.W + "SELECT * FROM (SELECT regexp_extract(path, '([^/]+)$', 1) AS name, count(DISTINCT repo_id) AS repositories, count(*) AS files FROM files_ GROUP BY 1) WHERE repositories >= 2",
    "train_test_lift": f"WITH a AS (SELECT avg(value) FILTER (ts < TIMESTAMP '{CUTOFF}') AS a, avg(value) FILTER (ts >= TIMESTAMP '{CUTOFF}') AS b FROM events), t AS (SELECT event_type, avg(value) FILTER (ts < TIMESTAMP '{CUTOFF}') AS t, avg(value) FILTER (ts >= TIMESTAMP '{CUTOFF}') AS u FROM events GROUP BY 1) SELECT event_type, round(t - a, 4) + 0.0::DOUBLE AS train_lift, round(u - b, 4) + 0.0::DOUBLE AS test_lift, round(t - a, 4) > 0 AS eligible FROM t, a",
    "workspace_rollup": code.W + ", f AS (SELECT repo_id, count(*) AS files, count(*) FILTER (role = 'source') AS sources, count(*) FILTER (role = 'test') AS tests, count(DISTINCT language) AS languages FROM safe_ GROUP BY 1), c AS (SELECT repo_id, count(DISTINCT sha) AS commits FROM commits GROUP BY 1), e AS (SELECT repo_id, count(*) AS edges FROM edges_ GROUP BY 1), j AS (SELECT f.*, coalesce(commits, 0) AS commits, coalesce(edges, 0) AS edges FROM f LEFT JOIN c USING (repo_id) LEFT JOIN e USING (repo_id)) SELECT *, round(least(0.95, CASE WHEN sources > 0 THEN 0.45 ELSE 0.05 END + CASE WHEN tests > 0 THEN 0.25 ELSE 0 END + CASE WHEN commits > 0 THEN 0.15 ELSE 0 END + CASE WHEN edges > 0 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS confidence FROM j",
    "slow_commits": "WITH o AS (SELECT repo_id, sha, min(floor((epoch_us(ingested_at) - epoch_us(committed_at)) / 1000000.0)::BIGINT) AS delay FROM commits GROUP BY 1, 2), m AS (SELECT repo_id, round(avg(delay), 2) AS mean_delay FROM o GROUP BY 1) SELECT repo_id, sha, delay, rank, mean_delay FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY delay DESC, sha) AS rank FROM o) JOIN m USING (repo_id) WHERE rank <= 3",
}
QUERIES = {f.__name__: f for f in (candidate_coverage, candidate_retention, threshold_sweep, cross_repo_names, train_test_lift, workspace_rollup, slow_commits)}
