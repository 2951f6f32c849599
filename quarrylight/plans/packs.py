"""Queries over packs, memory and facets of texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.paths import lower_sql
from ..operators import packs
from ..sources.tables import table
from . import code, ranking


def _terms(text):
    return F.array_distinct(F.filter(T.words(text), lambda t: (F.length(t) >= 3) & (T.weight(t) >= 1)))


def _tasks(spark, sf_dir):
    return table(spark, sf_dir, "search_runs").groupBy("search_id", "repo_id").agg(F.max("query_text").alias("q")).select("search_id", "repo_id", _terms(F.col("q")).alias("terms"))


def pack_snippets(spark, sf_dir):
    """Snippet windows of the first five targets of every search, for the standard budget."""
    targets, _, lines = packs.LIMITS["standard"]
    plan = ranking.context_plan(spark, sf_dir).filter(F.col("slot") <= targets).select("search_id", "repo_id", "path", "slot")
    plan = plan.join(_tasks(spark, sf_dir), ["search_id", "repo_id"])
    got = packs.snippets(plan, code.reads(spark, sf_dir), "terms", lines)
    return got.select("search_id", "repo_id", "path", "slot", "start_line", "end_line", "total_lines", "tokens")


def pack_budgets(spark, sf_dir):
    """What packs of the plans cost: sections and tokens by role."""
    got = pack_snippets(spark, sf_dir).withColumn("role", code.P.role(F.col("path")))
    return got.groupBy("role").agg(F.count(F.lit(1)).alias("sections"), F.sum("tokens").cast("bigint").alias("tokens"), F.max("end_line").alias("longest"))


def memory_overlap_top3(spark, sf_dir):
    """Decision records as memory cards: the three that share most with each task."""
    cards = table(spark, sf_dir, "documents").filter("doc_kind = 'adr' and text is not null")
    cards = cards.select(F.col("doc_id").alias("card_id"), "repo_id", _terms(F.col("text")).alias("terms"), F.least(F.lit(1.0), F.col("n_chars") / 2000).alias("confidence"))
    got = packs.memory_matches(_tasks(spark, sf_dir), cards)
    return got.select("search_id", "repo_id", "card_id", "overlap", "score", F.col("rank").cast("bigint").alias("rank"))


def query_facets(spark, sf_dir):
    """Facets that documents name, counted by kind of document."""
    d = table(spark, sf_dir, "documents").select("doc_kind", packs.facets_of(F.col("text")).alias("f"))
    n = lambda c: F.sum(F.size(f"f.{c}")).cast("bigint")
    return d.groupBy("doc_kind").agg(n("paths").alias("paths"), n("symbols").alias("symbols"), n("errors").alias("errors"), n("commits").alias("commits"))


TERMS = "list_distinct(list_filter({}, lambda t: length(t) >= 3 AND (" + T.weight_sql("t") + ") >= 1))"
TASKS_SQL = f"tasks AS (SELECT search_id, repo_id, {TERMS.format(T.words_sql('q'))} AS terms FROM (SELECT search_id, repo_id, max(query_text) AS q FROM search_runs GROUP BY 1, 2))"
SNIPPET_SQL = (
    ranking.PLAN_SQL
    + f""", {TASKS_SQL}, reads_ AS (SELECT repo_id, path, arg_max(text, {{'a': read_at, 'i': read_id}}) AS content FROM source_reads WHERE status = 'read' GROUP BY 1, 2),
tg AS (SELECT p.search_id, p.repo_id, p.path, p.slot, t.terms, string_split(r.content, chr(10)) AS l FROM plan p JOIN tasks t USING (search_id, repo_id) JOIN reads_ r ON r.repo_id = p.repo_id AND r.path = p.path WHERE slot <= 5),
h AS (SELECT *, list_position(list_transform(l, lambda x: len(list_filter(terms, lambda t: contains({lower_sql('x')}, t))) > 0), true) AS hit FROM tg),
b AS (SELECT *, greatest(1, coalesce(nullif(hit, 0), 1) - 5)::BIGINT AS start_line, len(l) AS total_lines FROM h),
sn AS (SELECT *, least(total_lines, start_line + 179)::BIGINT AS end_line FROM b),
fin AS (SELECT search_id, repo_id, path, slot, start_line, end_line, total_lines, ceil(len(list_filter(string_split_regex(array_to_string(l[start_line:end_line], chr(10)), '\\s+'), lambda x: x <> '')) * 4 / 3.0)::BIGINT AS tokens FROM sn)"""
)
SQL = {
    "pack_snippets": SNIPPET_SQL + " SELECT * FROM fin",
    "pack_budgets": SNIPPET_SQL + f" SELECT {code.P.role_sql('path')} AS role, count(*) AS sections, sum(tokens)::BIGINT AS tokens, max(end_line) AS longest FROM fin GROUP BY 1",
    "memory_overlap_top3": f"WITH {TASKS_SQL}, q AS (SELECT DISTINCT search_id, repo_id, unnest(terms) AS t FROM tasks), c AS (SELECT doc_id AS card_id, repo_id, least(1.0, n_chars / 2000.0)::DOUBLE AS confidence, unnest({TERMS.format(T.words_sql('text'))}) AS t FROM documents WHERE doc_kind = 'adr' AND text IS NOT NULL), n AS (SELECT search_id, q.repo_id, card_id, confidence, count(*) AS overlap FROM q JOIN c ON c.repo_id = q.repo_id AND c.t = q.t GROUP BY 1, 2, 3, 4), s AS (SELECT search_id, repo_id, card_id, overlap, round(least(0.16::DOUBLE * overlap, 0.64::DOUBLE) * greatest(confidence, 0.1), 6) AS score FROM n) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search_id, repo_id ORDER BY score DESC, card_id) AS rank FROM s) WHERE rank <= 3",
    "query_facets": rf"SELECT doc_kind, sum(len(list_distinct({code.EXPLICIT_SQL})))::BIGINT AS paths, sum(least(16, len(list_distinct(regexp_extract_all(coalesce(text, ''), '\b([a-z]+(?:_[a-z0-9]+)+|[a-z]+(?:[A-Z][a-z0-9]+)+)\b', 1)))))::BIGINT AS symbols, sum(least(8, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches({lower_sql('x')}, 'error|exception|panic|failed')))))::BIGINT AS errors, sum(CASE WHEN contains(lower(coalesce(text, '')), 'commit') THEN len(list_distinct(regexp_extract_all(lower(text), '\b([0-9a-f]{{7,40}})\b', 1))) ELSE 0 END)::BIGINT AS commits FROM documents GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (pack_snippets, pack_budgets, memory_overlap_top3, query_facets)}
