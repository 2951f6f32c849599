"""Queries of the operators over tables of records: pairs (p2) and top N (p3), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import normal_path
from ..session import work_path
from ..sources.tables import table
from .pairs import PairTable
from .topn import top_n_per_group

SIDECAR = {"repo_id": "string", "revision": "string"}


def commit_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A basket of normal paths per commit row of each sidecar; ``late`` if it came in more than a day after the commit."""
    paths = F.transform("changed_paths", lambda x: normal_path(x["path"]))
    late = F.coalesce(F.col("ingested_at") > F.col("committed_at") + F.expr("interval 1 day"), F.lit(True))
    return table(spark, sf_dir, "commits").select("repo_id", "revision", "sha", paths.alias("paths"), late.alias("late"))


def pair_scores(spark: SparkSession, sf_dir: str, min_count: int, each: bool) -> DataFrame:
    """Scores after two changes, timely commits and then late ones; ``each``: made after both, the second time for affected sidecars."""
    rows = commit_baskets(spark, sf_dir)
    pairs = PairTable(spark, work_path(spark, "pairs"), SIDECAR, min_count=min_count)
    for part in (rows.filter("not late"), rows.filter("late")):
        pairs.apply(part, "sha", "paths")
        if each:
            pairs.refresh()
    pairs.refresh()
    return pairs.scores()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of paths with at least 4 common commits and three times the chance count."""
    strong = pair_scores(spark, sf_dir, 4, each=False).filter(F.col("n_ab") * F.col("n") >= 3 * F.col("n_a") * F.col("n_b"))
    return strong.select("repo_id", "revision", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair seen twice or more, with counts and scores."""
    out = pair_scores(spark, sf_dir, 2, each=True)
    return out.select("repo_id", "revision", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"), "n", "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("confidence", 6).alias("confidence"))


P2_COUNTS = r"""
WITH c AS (SELECT repo_id, revision, sha, unnest(changed_paths).path AS raw FROM commits),
p AS (SELECT DISTINCT repo_id, revision, sha, regexp_replace(replace(trim(raw, ' '), chr(92), '/'), '^(\./+)+', '') AS path FROM c WHERE raw IS NOT NULL),
b AS (SELECT * FROM p WHERE path <> ''),
t AS (SELECT repo_id, revision, count(DISTINCT sha) AS n FROM b GROUP BY 1, 2),
m AS (SELECT repo_id, revision, path, count(*) AS k FROM b GROUP BY 1, 2, 3),
ab AS (SELECT x.repo_id, x.revision, x.path AS path_a, y.path AS path_b, count(*) AS n_ab
  FROM b x JOIN b y ON x.repo_id = y.repo_id AND x.revision = y.revision AND x.sha = y.sha AND x.path < y.path GROUP BY 1, 2, 3, 4),
s AS (SELECT ab.*, t.n, l.k AS n_a, r.k AS n_b FROM ab JOIN t USING (repo_id, revision)
  JOIN m l ON l.repo_id = ab.repo_id AND l.revision = ab.revision AND l.path = path_a
  JOIN m r ON r.repo_id = ab.repo_id AND r.revision = ab.revision AND r.path = path_b)
"""
P2_FOUND_SQL = P2_COUNTS + "SELECT repo_id, revision, path_a, path_b FROM s WHERE n_ab >= 4 AND n_ab * n >= 3 * n_a * n_b"
P2_SCORES_SQL = P2_COUNTS + (
    "SELECT repo_id, revision, path_a, path_b, n, n_a, n_b, n_ab, round(n_ab * n / (n_a * n_b)::DOUBLE, 6) AS lift,"
    " round(n_ab / n_a::DOUBLE, 6) AS confidence FROM s WHERE n_ab >= 2"
)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept paths of every search and the best targets of every source file."""
    hits = table(spark, sf_dir, "search_results").select(F.lit("search").alias("origin"), F.col("search_id").cast("string").alias("group_key"), "path", F.col("score").alias("value"))
    edges = table(spark, sf_dir, "edges").select(
        F.lit("edge").alias("origin"), F.concat("repo_id", F.lit("|"), "source_path").alias("group_key"), F.col("target_path").alias("path"), F.col("confidence").alias("value")
    )
    runs = table(spark, sf_dir, "search_runs").select(F.lit("search").alias("origin"), F.col("search_id").cast("string").alias("group_key"), F.coalesce(F.col("result_limit"), F.lit(10)).alias("n"))
    keys = ["origin", "group_key"]
    found = top_n_per_group(hits, keys, "path", "value", n=runs, default_n=10).unionByName(top_n_per_group(edges, keys, "path", "value", n=5))
    return found.select("origin", "group_key", F.col("item").alias("path"))


P3_FOUND_SQL = """
WITH lim AS (SELECT search_id, max(coalesce(result_limit, 10)) AS n FROM search_runs GROUP BY 1),
v AS (SELECT 'search' AS origin, s.search_id::VARCHAR AS group_key, s.path, max(s.score) AS value, greatest(1, coalesce(max(lim.n), 10)) AS n
  FROM search_results s LEFT JOIN lim USING (search_id) WHERE s.score IS NOT NULL AND NOT isnan(s.score) AND s.path IS NOT NULL GROUP BY 1, 2, 3
  UNION ALL
  SELECT 'edge', repo_id || '|' || source_path, target_path, max(confidence), 5 FROM edges
  WHERE confidence IS NOT NULL AND NOT isnan(confidence) AND target_path IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY origin, group_key ORDER BY value DESC, path) AS rn FROM v)
SELECT origin, group_key, path FROM r WHERE rn <= n
"""

QUERIES = {"p2_found": p2_found, "p2_scores": p2_scores, "p3_found": p3_found}
SQL = {"p2_found": P2_FOUND_SQL, "p2_scores": P2_SCORES_SQL, "p3_found": P3_FOUND_SQL}
