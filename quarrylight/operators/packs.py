"""Context packs: snippet windows of a plan's targets, token estimates by budget, memory cards, and facets of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.paths import ascii_lower, explicit_paths
from .history import mentioned_shas
from .ranks import first_rows

#: Targets, tests and lines a snippet that a budget holds (fixed values).
LIMITS = {"brief": (3, 2, 80), "standard": (5, 4, 180), "deep": (8, 6, 320)}


def snippet_bounds(hit: Column, most: Column, total: Column) -> tuple[Column, Column]:
    """First and last line of a window: five lines before the hit (line 1 without one), grown forward to ``most`` lines."""
    start = F.greatest(F.lit(1), F.coalesce(hit, F.lit(1)) - 5)
    return start, F.least(total, start + most - 1)


def snippets(targets: DataFrame, texts: DataFrame, terms: str, most: int) -> DataFrame:
    """``targets`` with start and end line, and estimated tokens, of the window at the first line that holds a term.

    texts: repo_id, path, content. The line is found by an expression over the split text; nothing is exploded.
    """
    rows = targets.join(texts, ["repo_id", "path"]).withColumn("_l", F.split("content", "\n"))
    hit = F.array_position(F.transform(F.col("_l"), lambda x: F.exists(terms, lambda t: F.contains(ascii_lower(x), t))), True)
    start, end = snippet_bounds(F.when(hit > 0, hit), F.lit(most), F.size("_l"))
    rows = rows.withColumns({"start_line": start.cast("bigint"), "end_line": end.cast("bigint"), "total_lines": F.size("_l").cast("bigint")})
    part = F.array_join(F.slice("_l", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    return rows.withColumn("tokens", T.token_estimate(part)).drop("_l", "content")


def memory_matches(tasks: DataFrame, cards: DataFrame, most: int = 3) -> DataFrame:
    """The best cards of each task in its repository: shared terms, score min(.16 n, .64) * max(confidence, .1).

    tasks: search_id, repo_id, terms; cards: card_id, repo_id, terms, confidence. Terms are the join key.
    """
    q = tasks.select("search_id", "repo_id", F.explode("terms").alias("t")).distinct()
    c = cards.select("card_id", "repo_id", "confidence", F.explode(F.array_distinct("terms")).alias("t"))
    n = q.join(c, ["repo_id", "t"]).groupBy("search_id", "repo_id", "card_id", "confidence").agg(F.count(F.lit(1)).alias("overlap"))
    score = F.round(F.least(0.16 * F.col("overlap"), F.lit(0.64)) * F.greatest(F.col("confidence"), F.lit(0.1)), 6)
    return first_rows(n.withColumn("score", score), ["search_id", "repo_id"], [F.desc("score"), "card_id"], most)


def facets_of(text: Column) -> Column:
    """What a task names: paths, identifiers (16 at most), error lines (8 at most) and commits."""
    names = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([a-z]+(?:_[a-z0-9]+)+|[a-z]+(?:[A-Z][a-z0-9]+)+)\b"), 1))
    errors = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ascii_lower(x).rlike("error|exception|panic|failed"))
    return F.struct(explicit_paths(text).alias("paths"), F.slice(names, 1, 16).alias("symbols"), F.slice(errors, 1, 8).alias("errors"), mentioned_shas(F.coalesce(text, F.lit(""))).alias("commits"))
