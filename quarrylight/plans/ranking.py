"""Queries over plans, vectors, feedback and retrieval quality, with their SQL. ``context_plan`` is the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions import vectors as V
from ..operators import evaluate, feedback, fusion, graph, semantic
from ..operators.ranks import best_items
from ..session import work_path
from ..sources.tables import table
from ..streaming import feeds

KEY = ["search_id", "repo_id"]


def plan_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long signals of every search: lexical hits, and what their three best lead to by edges and by common changes."""
    runs = table(spark, sf_dir, "search_runs").groupBy("search_id").agg(F.max(F.coalesce("result_limit", F.lit(10))).alias("n"))
    hits = best_items(table(spark, sf_dir, "search_results"), KEY, "path", "score", 24).withColumnRenamed("item", "path")
    hits = hits.join(runs, "search_id", "left")
    # hits beyond the search's own limit count as expansion
    lexical = hits.select(
        *KEY, "path", F.when(F.col("rank") <= F.greatest(F.lit(1), F.coalesce("n", F.lit(10))), "lexical").otherwise("lexical_expansion").alias("signal"), F.greatest(F.lit(0.15), F.least(F.lit(0.95), F.col("score") / 20)).alias("score"), F.col("rank").cast("bigint").alias("lexical_rank")
    )
    seeds = hits.filter("rank <= 3").select(*KEY, F.col("path").alias("seed"), "rank")
    e = graph.clean_edges(table(spark, sf_dir, "edges")).groupBy("repo_id", "source_path", "target_path").agg(F.max("confidence").alias("c"))
    near = seeds.join(e, (seeds["repo_id"] == e["repo_id"]) & (seeds["seed"] == e["source_path"])).select("search_id", seeds["repo_id"], F.col("target_path").alias("path"), F.col("rank"), "c")
    dependency = near.groupBy(*KEY, "path").agg(F.max(fusion.decayed(F.col("c"), F.col("rank"))).alias("score"))
    hints = table(spark, sf_dir, "co_change").select("repo_id", P.normal_path(F.col("anchor_path")).alias("seed"), P.normal_path(F.col("path")).alias("path"), "commit_count")
    hints = hints.groupBy("repo_id", "seed", "path").agg(F.max("commit_count").alias("k"))
    changed = seeds.join(hints, ["repo_id", "seed"]).groupBy(*KEY, "path").agg(F.max(F.least(F.lit(0.95), F.col("k") / 5)).alias("score"))
    none = F.lit(None).cast("bigint").alias("lexical_rank")
    out = lexical.unionByName(dependency.select(*KEY, "path", F.lit("dependency").alias("signal"), "score", none))
    return out.unionByName(changed.select(*KEY, "path", F.lit("co_change").alias("signal"), "score", none))


def candidates(spark, sf_dir) -> DataFrame:
    p = F.col("path")
    return fusion.fused(plan_signals(spark, sf_dir), [*KEY, "path"]).withColumns({"role": P.role(p), "area": P.area(p)})


def signal_fusion(spark, sf_dir):
    return candidates(spark, sf_dir).select(*KEY, "path", "rank_score", "lexical_rank", "signals", "lexical_score", "dependency_score", "co_change_score", F.round("confidence", 6).alias("confidence"))


def context_plan(spark, sf_dir):
    """Ten targets of every search, by quota, from fused signals."""
    return fusion.selected(candidates(spark, sf_dir), KEY, 10)


def rerank_metadata(spark, sf_dir):
    got = fusion.reranked(candidates(spark, sf_dir), KEY).filter("rerank <= 10")
    return got.select(*KEY, "path", "protected", "rerank_score", "rerank")


def plan_areas(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return fusion.area_rollup(c, fusion.selected(c, KEY, 10), KEY)


def signal_saturation(spark, sf_dir):
    """Searches with each signal, its rows and mean score."""
    s = plan_signals(spark, sf_dir)
    return s.groupBy("signal").agg(F.countDistinct("search_id").alias("searches"), F.count(F.lit(1)).alias("rows"), F.round(F.avg("score"), 6).alias("mean_score"))


def signal_ablation(spark, sf_dir):
    """Without each signal: how many of the first ten by rank score stay, over all searches."""
    s = plan_signals(spark, sf_dir).groupBy(*KEY, "path", "signal").agg(F.sum(F.col("score") * fusion.weight(F.col("signal"))).alias("w"))
    total = s.groupBy(*KEY, "path").agg(F.sum("w").alias("all"), *[F.coalesce(F.sum(F.when(F.col("signal") != x, F.col("w"))), F.lit(0.0)).alias(x) for x in ("lexical", "dependency", "co_change")])
    rank = lambda c: F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(F.round(c, 6)), "path"))
    r = total.select(*KEY, "path", rank("all").alias("r"), *[F.struct(F.lit(x).alias("signal"), F.when(F.col(x) > 0, rank(x)).alias("q")).alias(x) for x in ("lexical", "dependency", "co_change")])
    long = r.filter("r <= 10").select(F.explode(F.array("lexical", "dependency", "co_change")).alias("x"))
    return long.groupBy("x.signal").agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("x.q") <= 10).alias("kept"))


def facet_top5(spark, sf_dir):
    e = graph.clean_edges(table(spark, sf_dir, "edges"))
    out_ = e.select("repo_id", F.col("source_path").alias("path"), F.lit("imports").alias("kind"), F.col("target_path").alias("label"), F.col("confidence").alias("weight"))
    in_ = e.select("repo_id", F.col("target_path").alias("path"), F.lit("used_by").alias("kind"), F.col("source_path").alias("label"), F.round(F.col("confidence") * 0.9, 6).alias("weight"))
    return semantic.facets([out_, in_], ["repo_id", "path"])


def hash_embedding(spark, sf_dir):
    q = table(spark, sf_dir, "search_runs").select("search_id", T.words(F.col("query_text")).alias("terms")).groupBy("search_id").agg(F.max("terms").alias("terms"))
    v = V.hash_embedding(q, "search_id", "terms", 64)
    return v.select("search_id", F.array_join(F.transform("vector", lambda x: F.round(x * 1000).cast("bigint").cast("string")), ",").alias("vector"))


def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    got = semantic.cosine_top(v, v.filter("vec_id % 100 = 0"), 10)
    return got.select("query_id", F.col("item").alias("vec_id"), "score", F.col("rank").cast("bigint").alias("rank"))


def semantic_threshold(spark, sf_dir):
    """Of the 50 best hits of the stated queries those at or above 0.08, counted, with the best score."""
    v = table(spark, sf_dir, "embeddings")
    got = semantic.cosine_top(v, v.filter("vec_id % 100 = 0"), 50).filter("score >= 0.08")
    return got.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best"))


def semantic_hits(spark, sf_dir):
    """All hits of the stated queries at or above 0.08, counted, with the best score."""
    v = table(spark, sf_dir, "embeddings")
    return semantic.cosine_at_least(v, v.filter("vec_id % 100 = 0"), 0.08)


def ranked(spark, sf_dir) -> DataFrame:
    """Order lines as ranked candidates of a query: two rankings, relevance and role."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query"), F.col("l_partkey").cast("string").alias("path")).agg(F.max("l_extendedprice").alias("price"), F.max("l_quantity").alias("qty"), F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("rel"), F.min("l_linestatus").alias("role"))  # noqa: E741
    w = lambda c: F.row_number().over(Window.partitionBy("query").orderBy(F.desc(c), "path"))
    return l.select("query", "path", "role", (F.col("rel") == 1).alias("relevant"), w("price").alias("rank_combined"), w("qty").alias("rank_lexical"), F.when(F.col("qty") >= 10, w("qty")).alias("rank_cut"))


def recall_precision_mrr(spark, sf_dir):
    m = evaluate.metrics(ranked(spark, sf_dir), {"combined": "rank_combined", "lexical": "rank_lexical", "cut": "rank_cut"}, (2, 5))
    return m


def lift_verdicts(spark, sf_dir):
    m = evaluate.metrics(ranked(spark, sf_dir), {"combined": "rank_combined", "lexical": "rank_lexical", "cut": "rank_cut"}, (2, 5))
    base = m.filter("variant = 'lexical'").select(F.col("recall_2").alias("b"))
    lift = F.round(F.col("recall_2") - F.col("b"), 6)
    return m.join(base).select("variant", "recall_2", lift.alias("lift"), evaluate.verdict(lift).alias("verdict"))


def role_recall(spark, sf_dir):
    return evaluate.role_recall(ranked(spark, sf_dir), "rank_cut", 2)


def token_return(spark, sf_dir):
    return evaluate.token_return(ranked(spark, sf_dir), "rank_combined")


def gap_taxonomy(spark, sf_dir):
    return evaluate.gaps(ranked(spark, sf_dir), "rank_cut", "rank_combined", 2)


def top_missing(spark, sf_dir):
    return evaluate.top_missing(ranked(spark, sf_dir), "rank_cut", 2)


def backend_overlap(spark, sf_dir):
    return evaluate.backends(ranked(spark, sf_dir), "rank_combined", "rank_lexical", 2)


def suite_compare(spark, sf_dir):
    """Recall by role of two variants, with the drops beyond a limit."""
    r = ranked(spark, sf_dir)
    a = evaluate.role_recall(r, "rank_lexical", 2)
    return evaluate.compared(a, evaluate.role_recall(r, "rank_cut", 2), "role", "recall", 0.02)


def protected_evidence(spark, sf_dir):
    """Targets with lexical evidence that the first ten miss, by role."""
    c, chosen = candidates(spark, sf_dir), context_plan(spark, sf_dir).select(*KEY, "path", F.lit(True).alias("_in"))
    j = c.filter("lexical_score is not null").join(chosen, [*KEY, "path"], "left")
    return j.groupBy("role").agg(F.count(F.lit(1)).alias("protected"), F.count_if(F.col("_in").isNull()).alias("missed"), F.round(F.count_if(F.col("_in").isNull()) / F.count(F.lit(1)), 6).alias("miss_rate"))


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("file", F.get_json_object("props", "$.k"))


def sessions(spark, sf_dir) -> DataFrame:
    """A session per user and day: what was recommended, read, edited and corrected, and how it ended."""
    of = lambda t: F.collect_set(F.when(F.col("event_type") == t, F.col("file")))
    names = ("error", "view", "click", "purchase", "signup")
    s = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(*[of(t).alias(t) for t in names], F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    budget = F.element_at(F.array(F.lit("brief"), F.lit("standard"), F.lit("deep"), F.lit("plan_only")), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    outcome = F.when(F.col("last").isin("signup", "click"), "passed").when(F.col("last") == "error", "blocked").otherwise("open")
    return s.select("user_id", "day", budget.alias("budget"), outcome.alias("outcome"), F.size("purchase").alias("corrected"), F.size("view").alias("read"), F.size("click").alias("useful"), F.array_union("error", "view").alias("recommended_files"), F.array_union("click", "view").alias("useful_files"))


def feedback_summary(spark, sf_dir):
    return feedback.summary(events(spark, sf_dir))


def outcome_by_budget(spark, sf_dir):
    return feedback.outcomes(sessions(spark, sf_dir))


def policy_quality(spark, sf_dir):
    return feedback.proxies(sessions(spark, sf_dir))


def learned_weights(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("anchor", "lexical", "semantic", "symbol", "dependency", "related_test", "co_change")])
    rows = table(spark, sf_dir, "lineitem").select(F.element_at(names, (F.pmod("l_linenumber", F.lit(7)) + 1).cast("int")).alias("signal"), F.greatest(F.lit(0.15), F.least(F.lit(0.95), F.col("l_discount") * 10)).alias("score"), (F.col("l_returnflag") == "R").alias("useful"))
    return feedback.learned_weights(rows)


def policy_gates(spark, sf_dir):
    m = evaluate.metrics(ranked(spark, sf_dir), {"combined": "rank_combined"}, (2, 5))
    return feedback.gates(m, {"recall_2": 0.3, "precision_2": 0.1, "mrr": 0.9})


def lane_rollup(spark, sf_dir):
    """Lanes side by side: events, value and errors a lane, and the differences to the first lane."""
    e = events(spark, sf_dir).withColumn("lane", F.pmod("user_id", F.lit(3)))
    p = e.groupBy("event_type").pivot("lane", [0, 1, 2]).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("v"))
    return p.select("event_type", *[F.coalesce(f"{i}_n", F.lit(0)).alias(f"lane{i}") for i in range(3)], *[(F.coalesce(f"{i}_n", F.lit(0)) - F.coalesce("0_n", F.lit(0))).alias(f"delta{i}") for i in (1, 2)], *[F.col(f"{i}_v").alias(f"value{i}") for i in range(3)])


def retry_weighted(spark, sf_dir):
    """A mean value weighted by how often a user's lane was triggered."""
    u = events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("w"), F.avg("value").alias("v"))
    return u.groupBy("event_type").agg(F.round(F.sum(F.col("v") * F.col("w")) / F.sum("w"), 4).alias("weighted"), F.sum("w").alias("weight"))


def pack_tokens(spark, sf_dir):
    """Estimated tokens of documents by kind."""
    return table(spark, sf_dir, "documents").groupBy("doc_kind").agg(F.sum(T.token_estimate(F.col("text"))).cast("bigint").alias("tokens"), F.count("text").alias("documents"))


def event_windows(spark, sf_dir):
    """Daily windows of the event log, run through Structured Streaming to its end."""
    out, state = work_path(spark, "windows"), work_path(spark, "stream-state")
    stream = feeds.event_stream(spark, sf_dir, table(spark, sf_dir, "events"), "events.parquet")
    # event time needs a zone; the log's has none and is taken as UTC
    counts = feeds.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts")
    feeds.write_changes(counts, out, state).awaitTermination()
    return feeds.current_rows(spark, out, ["w", "event_type"]).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("value", 2).alias("value"))


HITS_SQL = """lim AS (SELECT search_id, max(coalesce(result_limit, 10)) AS n FROM search_runs GROUP BY 1),
sr AS (SELECT search_id, repo_id, path, max(score) AS score FROM search_results WHERE score IS NOT NULL AND NOT isnan(score) AND path IS NOT NULL GROUP BY 1, 2, 3),
hits AS (SELECT * FROM (SELECT sr.*, row_number() OVER (PARTITION BY search_id, repo_id ORDER BY score DESC, path) AS rank FROM sr) WHERE rank <= 24),
e AS (SELECT repo_id, source_path, target_path, max(greatest(0.0, least(1.0, coalesce(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END, 0.0))))::DOUBLE AS c FROM edges WHERE source_path IS NOT NULL AND target_path IS NOT NULL AND source_path <> target_path GROUP BY 1, 2, 3),
hint AS (SELECT repo_id, regexp_replace(replace(trim(anchor_path, ' '), chr(92), '/'), '^(\\./+)+', '') AS seed, regexp_replace(replace(trim(path, ' '), chr(92), '/'), '^(\\./+)+', '') AS path, max(commit_count) AS k FROM co_change GROUP BY 1, 2, 3),
sig AS (SELECT h.search_id, h.repo_id, path, CASE WHEN rank <= greatest(1, coalesce(n, 10)) THEN 'lexical' ELSE 'lexical_expansion' END AS signal, greatest(0.15, least(0.95, score / 20))::DOUBLE AS score, rank AS lexical_rank FROM hits h LEFT JOIN lim USING (search_id)
 UNION ALL SELECT search_id, h.repo_id, target_path, 'dependency', max(greatest(least(0.05, c), least(c, c - 0.001 * least(rank, 200))))::DOUBLE, NULL FROM hits h JOIN e ON e.repo_id = h.repo_id AND e.source_path = h.path WHERE rank <= 3 GROUP BY 1, 2, 3
 UNION ALL SELECT search_id, h.repo_id, i.path, 'co_change', max(least(0.95, k / 5.0))::DOUBLE, NULL FROM hits h JOIN hint i ON i.repo_id = h.repo_id AND i.seed = h.path WHERE rank <= 3 AND i.path IS NOT NULL GROUP BY 1, 2, 3),
wt AS (SELECT *, score * CASE signal WHEN 'co_change' THEN 1.35::DOUBLE WHEN 'lexical' THEN 1.0::DOUBLE WHEN 'lexical_expansion' THEN 0.8::DOUBLE WHEN 'dependency' THEN 0.45::DOUBLE END AS w FROM sig),
bs AS (SELECT search_id, repo_id, path, signal, sum(w) AS s, max(w) AS b, min(lexical_rank) AS lr FROM wt GROUP BY 1, 2, 3, 4),
cand0 AS (SELECT search_id, repo_id, path, round(sum(s), 6) AS rank_score, min(lr) AS lexical_rank, string_agg(signal, ',' ORDER BY signal) AS signals, round(max(CASE WHEN signal IN ('lexical', 'lexical_expansion') THEN b END), 6) AS lexical_score, round(max(CASE WHEN signal = 'dependency' THEN b END), 6) AS dependency_score, round(max(CASE WHEN signal = 'co_change' THEN b END), 6) AS co_change_score FROM bs GROUP BY 1, 2, 3),
cand AS (SELECT *, ROLE AS role, AREA AS area FROM cand0)""".replace("ROLE AS", P.role_sql("path") + " AS").replace("AREA AS", P.area_sql("path") + " AS")
PLAN_SQL = (
    "WITH "
    + HITS_SQL
    + """, o AS (SELECT *, role = 'source' AND coalesce(lexical_score >= 0.3, false) AS k0, role = 'source' AND coalesce(co_change_score >= 0.5, false) AS k1, role = 'source' AND dependency_score IS NOT NULL AS k2 FROM cand),
st AS (SELECT search_id, repo_id, path, role, rank_score, signals, 0 AS stage, row_number() OVER (PARTITION BY search_id, repo_id ORDER BY lexical_score DESC NULLS LAST, rank_score DESC, path) AS place, 5 AS quota FROM o WHERE k0
 UNION ALL SELECT search_id, repo_id, path, role, rank_score, signals, 1, row_number() OVER (PARTITION BY search_id, repo_id ORDER BY co_change_score DESC NULLS LAST, rank_score DESC, path), 3 FROM o WHERE k1
 UNION ALL SELECT search_id, repo_id, path, role, rank_score, signals, 2, row_number() OVER (PARTITION BY search_id, repo_id ORDER BY dependency_score DESC NULLS LAST, rank_score DESC, path), 3 FROM o WHERE k2
 UNION ALL SELECT search_id, repo_id, path, role, rank_score, signals, 3, row_number() OVER (PARTITION BY search_id, repo_id ORDER BY rank_score DESC, path), 10 FROM o),
mn AS (SELECT search_id, repo_id, path, any_value(role) AS role, any_value(rank_score) AS rank_score, any_value(signals) AS signals, min({'stage': stage, 'place': place}) AS s FROM st WHERE place <= quota GROUP BY 1, 2, 3),
plan AS (SELECT search_id, repo_id, path, role, rank_score, signals, ['lexical', 'history', 'dependency', 'rank'][s.stage + 1] AS stage, slot FROM (SELECT *, row_number() OVER (PARTITION BY search_id, repo_id ORDER BY s.stage, s.place, path) AS slot FROM mn) WHERE slot <= 10)"""
)
RANKED_SQL = """WITH l AS (SELECT l_orderkey AS query, l_partkey::VARCHAR AS path, max(l_extendedprice) AS price, max(l_quantity) AS qty, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS rel, min(l_linestatus) AS role FROM lineitem GROUP BY 1, 2),
r AS (SELECT query, path, role, rel = 1 AS relevant, row_number() OVER (PARTITION BY query ORDER BY price DESC, path) AS rank_combined, row_number() OVER (PARTITION BY query ORDER BY qty DESC, path) AS rank_lexical, CASE WHEN qty >= 10 THEN row_number() OVER (PARTITION BY query ORDER BY qty DESC, path) END AS rank_cut FROM l)"""


def _metric(name: str) -> str:
    c = f"rank_{name}"
    return (
        f"SELECT '{name}' AS variant, count(*) AS queries, round(avg(h2 / t::DOUBLE), 6) AS recall_2, round(avg(h5 / t::DOUBLE), 6) AS recall_5, round(avg(h2 / 2.0::DOUBLE), 6) AS precision_2, round(avg(h5 / 5.0::DOUBLE), 6) AS precision_5, round(sum(h5) / sum(t)::DOUBLE, 6) AS micro_recall, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr"
        f" FROM (SELECT query, count(*) FILTER (relevant) AS t, count(*) FILTER (relevant AND {c} <= 2) AS h2, count(*) FILTER (relevant AND {c} <= 5) AS h5, min(CASE WHEN relevant AND {c} <= 5 THEN {c} END) AS f FROM r GROUP BY 1) WHERE t > 0"
    )


METRICS_SQL = RANKED_SQL + ", m AS (" + " UNION ALL ".join(_metric(n) for n in ("combined", "lexical", "cut")) + ")"
ROLE_RECALL = "SELECT role, count(*) AS changed, count(*) FILTER ({c} <= 2) AS hits, round(count(*) FILTER ({c} <= 2) / count(*)::DOUBLE, 6) AS recall FROM r WHERE relevant GROUP BY 1"
SESSIONS_SQL = """WITH ev AS (SELECT *, json_extract_string(props, '$.k') AS file FROM events),
s0 AS (SELECT user_id, ts::DATE AS day, coalesce(list(DISTINCT file) FILTER (event_type = 'error'), []) AS er, coalesce(list(DISTINCT file) FILTER (event_type = 'view'), []) AS vw, coalesce(list(DISTINCT file) FILTER (event_type = 'click'), []) AS ck, coalesce(list(DISTINCT file) FILTER (event_type = 'purchase'), []) AS pu, arg_max(event_type, {'t': ts, 'i': event_id}) AS last FROM ev GROUP BY 1, 2),
s AS (SELECT *, ['brief', 'standard', 'deep', 'plan_only'][(user_id % 4) + 1] AS budget, CASE WHEN last IN ('signup', 'click') THEN 'passed' WHEN last = 'error' THEN 'blocked' ELSE 'open' END AS outcome, list_distinct(list_concat(er, vw)) AS rec, list_distinct(list_concat(ck, vw)) AS use FROM s0)"""
EMB_SQL = """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)"""
SQL = {
    "signal_fusion": f"WITH {HITS_SQL} SELECT search_id, repo_id, path, rank_score, lexical_rank, signals, lexical_score, dependency_score, co_change_score, round(greatest(0.15, least(0.98, rank_score)), 6)::DOUBLE AS confidence FROM cand",
    "context_plan": PLAN_SQL + " SELECT * FROM plan",
    "rerank_metadata": f"WITH {HITS_SQL}, z AS (SELECT *, role = 'source' AND lexical_score IS NOT NULL AS protected, round(rank_score + 0.05::DOUBLE * len(string_split(signals, ',')), 6) AS rerank_score FROM cand) SELECT search_id, repo_id, path, protected, rerank_score, rerank FROM (SELECT *, row_number() OVER (PARTITION BY search_id, repo_id ORDER BY protected DESC, rerank_score DESC, rank_score DESC, path) AS rerank FROM z) WHERE rerank <= 10",
    "plan_areas": PLAN_SQL + ", j AS (SELECT c.*, p.path IS NOT NULL AS picked FROM cand c LEFT JOIN plan p USING (search_id, repo_id, path)), a AS (SELECT search_id, repo_id, area, count(*) AS candidates, count(*) FILTER (picked) AS selected, 3 * count(*) FILTER (role = 'source' AND NOT picked) + 2 * count(*) FILTER (role = 'test' AND NOT picked) + count(*) FILTER (role = 'docs' AND NOT picked) AS pressure FROM j GROUP BY 1, 2, 3) SELECT search_id, repo_id, area, candidates, selected, (100 * selected) // candidates AS coverage, pressure, CASE WHEN pressure >= 9 THEN 'high' WHEN pressure >= 3 THEN 'medium' ELSE 'low' END AS priority FROM a",
    "signal_saturation": f"WITH {HITS_SQL} SELECT signal, count(DISTINCT search_id) AS searches, count(*) AS rows, round(avg(score), 6) AS mean_score FROM sig GROUP BY 1",
    "signal_ablation": f"WITH {HITS_SQL}, t AS (SELECT search_id, repo_id, path, sum(s) AS a, coalesce(sum(CASE WHEN signal <> 'lexical' THEN s END), 0) AS x1, coalesce(sum(CASE WHEN signal <> 'dependency' THEN s END), 0) AS x2, coalesce(sum(CASE WHEN signal <> 'co_change' THEN s END), 0) AS x3 FROM bs GROUP BY 1, 2, 3), r AS (SELECT *, "
    + ", ".join(f"row_number() OVER (PARTITION BY search_id, repo_id ORDER BY round({c}, 6) DESC, path) AS r{c}" for c in ("a", "x1", "x2", "x3"))
    + " FROM t) SELECT signal, count(*) AS targets, count(*) FILTER (x > 0 AND q <= 10) AS kept FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS signal, {c} AS x, r{c} AS q FROM r WHERE ra <= 10" for n, c in (("lexical", "x1"), ("dependency", "x2"), ("co_change", "x3")))
    + ") GROUP BY 1",
    "protected_evidence": PLAN_SQL + " SELECT c.role, count(*) AS protected, count(*) FILTER (p.path IS NULL) AS missed, round(count(*) FILTER (p.path IS NULL) / count(*)::DOUBLE, 6) AS miss_rate FROM cand c LEFT JOIN plan p USING (search_id, repo_id, path) WHERE lexical_score IS NOT NULL GROUP BY 1",
    "facet_top5": f"WITH {HITS_SQL}, ed AS (SELECT repo_id, source_path, target_path, kind, greatest(0.0, least(1.0, coalesce(max(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END), 0.0)))::DOUBLE AS confidence FROM edges WHERE source_path IS NOT NULL AND target_path IS NOT NULL AND source_path <> target_path GROUP BY 1, 2, 3, 4), f AS (SELECT DISTINCT * FROM (SELECT repo_id, source_path AS path, 'imports' AS kind, target_path AS label, confidence AS weight FROM ed UNION ALL SELECT repo_id, target_path, 'used_by', source_path, round(confidence * 0.9::DOUBLE, 6) FROM ed)), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, kind ORDER BY label, weight DESC) AS r FROM f) WHERE r <= 12) SELECT repo_id, path, count(*) AS facets, array_to_string((list(kind || ':' || label ORDER BY weight DESC, label, kind))[1:5], ',') AS top FROM n GROUP BY 1, 2",
    "hash_embedding": f"WITH q AS (SELECT search_id, max({T.words_sql('query_text')}) AS ws FROM search_runs GROUP BY 1), t AS (SELECT search_id, unnest(ws) AS t FROM q), b AS (SELECT search_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, sum(CASE WHEN ('0x' || substr(md5(t), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM t GROUP BY 1, 2), n AS (SELECT search_id, sqrt(sum(v * v)) AS n FROM b GROUP BY 1 HAVING sum(v * v) > 0), g AS (SELECT n.search_id, n.n, i FROM n, range(64) r(i)) SELECT g.search_id, string_agg(round(coalesce(v, 0) / n * 1000)::BIGINT::VARCHAR, ',' ORDER BY i) AS vector FROM g LEFT JOIN b ON b.search_id = g.search_id AND b.b = g.i GROUP BY 1",
    "cosine_topk": EMB_SQL + " SELECT * FROM r WHERE rank <= 10",
    "semantic_threshold": EMB_SQL + " SELECT query_id, count(*) AS hits, max(score) AS best FROM r WHERE rank <= 50 AND score >= 0.08 GROUP BY 1",
    "semantic_hits": EMB_SQL + " SELECT query_id, count(*) AS hits, max(score) AS best FROM p WHERE score >= 0.08 GROUP BY 1",
    "recall_precision_mrr": METRICS_SQL + " SELECT * FROM m",
    "lift_verdicts": METRICS_SQL + ", b AS (SELECT recall_2 AS b FROM m WHERE variant = 'lexical') SELECT variant, recall_2, round(recall_2 - b, 6) AS lift, CASE WHEN round(recall_2 - b, 6) >= 0.01 THEN 'lift' WHEN round(recall_2 - b, 6) < -0.01 THEN 'regression' ELSE 'neutral' END AS verdict FROM m, b",
    "role_recall": RANKED_SQL + " " + ROLE_RECALL.format(c="rank_cut"),
    "token_return": RANKED_SQL + ", c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS budget, {i} AS ord, {k} AS cutoff, {t} AS tokens, count(*) FILTER (relevant AND rank_combined <= {k}) AS useful FROM r" for i, (n, k, t) in enumerate(evaluate.BUDGET_TABLE)) + ") SELECT budget, cutoff::BIGINT AS cutoff, tokens::BIGINT AS tokens, useful, round(1000 * useful / tokens::DOUBLE, 6) AS per_1k, useful - coalesce(lag(useful) OVER (ORDER BY ord), 0) AS marginal, useful - coalesce(lag(useful) OVER (ORDER BY ord), 0) = 0 AS little_value FROM c",
    "gap_taxonomy": RANKED_SQL + ", g AS (SELECT *, CASE WHEN rank_cut IS NULL AND rank_combined IS NULL THEN 'no_candidate_signal' WHEN rank_combined <= 2 THEN 'other_only_hit' ELSE 'ranked_too_low' END AS gap FROM r WHERE relevant AND (rank_cut IS NULL OR rank_cut > 2)) SELECT gap, role, count(*) AS misses, array_to_string((list(DISTINCT path ORDER BY path))[1:3], ',') AS examples FROM g GROUP BY 1, 2",
    "top_missing": RANKED_SQL + " SELECT path, role, count(*) AS misses FROM r WHERE relevant AND (rank_cut IS NULL OR rank_cut > 2) GROUP BY 1, 2 ORDER BY misses DESC, path, role LIMIT 20",
    "backend_overlap": RANKED_SQL + ", q AS (SELECT query, count(*) FILTER (rank_combined <= 2 AND rank_lexical <= 2) AS both_, max(CASE WHEN rank_combined = 1 THEN path END) AS ta, max(CASE WHEN rank_lexical = 1 THEN path END) AS tb, min(CASE WHEN relevant THEN rank_combined END) AS fa, min(CASE WHEN relevant THEN rank_lexical END) AS fb FROM r GROUP BY 1) SELECT CASE WHEN fa IS NULL AND fb IS NULL THEN 'none' WHEN fb IS NULL OR fa < fb THEN 'a' WHEN fa IS NULL OR fb < fa THEN 'b' ELSE 'tie' END AS winner, count(*) AS queries, round(avg(both_), 6) AS overlap, count(*) FILTER (ta IS DISTINCT FROM tb) AS top_changed FROM q GROUP BY 1",
    "suite_compare": RANKED_SQL + f", a AS ({ROLE_RECALL.format(c='rank_lexical')}), b AS ({ROLE_RECALL.format(c='rank_cut')}) SELECT role, a.recall AS base, b.recall AS head, round(coalesce(b.recall, 0) - coalesce(a.recall, 0), 6) AS delta, round(coalesce(b.recall, 0) - coalesce(a.recall, 0), 6) < -0.02 AS regressed FROM a FULL JOIN b USING (role)",
    "feedback_summary": "SELECT event_type, count(*) AS events, count(DISTINCT json_extract_string(props, '$.k')) AS files, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "outcome_by_budget": SESSIONS_SQL + " SELECT budget, count(*) AS sessions, round(count(*) FILTER (outcome = 'passed') / count(*)::DOUBLE, 6) AS pass_rate, round(count(*) FILTER (outcome = 'blocked') / count(*)::DOUBLE, 6) AS blocked_rate, round(count(*) FILTER (len(pu) > 0) / count(*)::DOUBLE, 6) AS correction_rate, round(avg(len(vw)), 6) AS files_read, round(coalesce(1000.0 * sum(len(ck)) / nullif(sum(CASE budget WHEN 'brief' THEN 4000 WHEN 'standard' THEN 16000 WHEN 'deep' THEN 64000 ELSE 0 END), 0), 0)::DOUBLE, 6) AS useful_per_1k FROM s GROUP BY 1",
    "policy_quality": SESSIONS_SQL + " SELECT budget, sum(len(list_intersect(rec, use)))::BIGINT AS hits, sum(len(rec))::BIGINT AS recommended, sum(len(use))::BIGINT AS useful, round(sum(len(list_intersect(rec, use))) / sum(len(rec))::DOUBLE, 6) AS precision, round(sum(len(list_intersect(rec, use))) / sum(len(use))::DOUBLE, 6) AS recall, sum(len(list_filter(use, lambda x: NOT list_contains(rec, x))))::BIGINT AS missing FROM s GROUP BY 1",
    "learned_weights": "WITH r AS (SELECT ['anchor', 'lexical', 'semantic', 'symbol', 'dependency', 'related_test', 'co_change'][(l_linenumber % 7) + 1] AS signal, greatest(0.15::DOUBLE, least(0.95::DOUBLE, l_discount * 10)) AS score, l_returnflag = 'R' AS useful FROM lineitem), t AS (SELECT sum(score) FILTER (useful) AS u, sum(score) AS a FROM r), b AS (SELECT signal, coalesce(sum(score) FILTER (useful), 0) AS su, sum(score) AS sa FROM r GROUP BY 1) SELECT signal, round(greatest(0.5::DOUBLE, least(1.5::DOUBLE, (su / greatest(u, 1.0)) / (sa / greatest(a, 1.0)))), 6) AS weight, round(su, 4) AS useful_score, round(sa, 4) AS score FROM b, t",
    "policy_gates": METRICS_SQL + ", g AS (SELECT 'recall_2' AS gate, recall_2 AS value, 0.3::DOUBLE AS threshold FROM m WHERE variant = 'combined' UNION ALL SELECT 'precision_2', precision_2, 0.1 FROM m WHERE variant = 'combined' UNION ALL SELECT 'mrr', mrr, 0.9 FROM m WHERE variant = 'combined'), p AS (SELECT *, value + 1e-6 >= threshold AS passed FROM g) SELECT * FROM p UNION ALL SELECT 'all', count(*) FILTER (passed)::DOUBLE, count(*)::DOUBLE, bool_and(passed) FROM p",
    "lane_rollup": "SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS lane0, count(*) FILTER (user_id % 3 = 1) AS lane1, count(*) FILTER (user_id % 3 = 2) AS lane2, count(*) FILTER (user_id % 3 = 1) - count(*) FILTER (user_id % 3 = 0) AS delta1, count(*) FILTER (user_id % 3 = 2) - count(*) FILTER (user_id % 3 = 0) AS delta2, round(avg(value) FILTER (user_id % 3 = 0), 4) AS value0, round(avg(value) FILTER (user_id % 3 = 1), 4) AS value1, round(avg(value) FILTER (user_id % 3 = 2), 4) AS value2 FROM events GROUP BY 1",
    "retry_weighted": "SELECT event_type, round(sum(v * w) / sum(w), 4) AS weighted, sum(w)::BIGINT AS weight FROM (SELECT event_type, user_id, count(*) AS w, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1",
    "pack_tokens": r"SELECT doc_kind, sum(ceil(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) * 4 / 3.0))::BIGINT AS tokens, count(text) AS documents FROM documents GROUP BY 1",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
}
QUERIES = {
    f.__name__: f
    for f in (
        signal_fusion, context_plan, rerank_metadata, plan_areas, signal_saturation, signal_ablation, protected_evidence, facet_top5, hash_embedding, cosine_topk, semantic_threshold, semantic_hits, recall_precision_mrr, lift_verdicts, role_recall, token_return, gap_taxonomy, top_missing, backend_overlap, suite_compare,
        feedback_summary, outcome_by_budget, policy_quality, learned_weights, policy_gates, lane_rollup, retry_weighted, pack_tokens, event_windows,
    )
}
