"""Queries over inventories, texts, history and the dependency graph, with their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import graph, history, inventory, lexical, store, symbols
from ..session import shared_dir
from ..sources.tables import spread, table

#: One task that search queries ask.
TASK = "fix the token ledger: resolve session rows in packages/cell-000/src/build/streamGauge.ts and sync-queue of the broker"
SNAPSHOT = "2025-05-01"
REFERENCING = ("typescript", "javascript", "python", "rust", "java", "kotlin")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.current_files(table(spark, sf_dir, "files"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current text of each file."""
    rows = table(spark, sf_dir, "source_reads").filter("status = 'read'")
    last = rows.groupBy("repo_id", "path").agg(F.max(F.struct("read_at", "read_id")).alias("last")).select("last.read_id")
    # texts are the streamed side: they stay where they were scanned unless the ids of current reads are too many to send
    texts = spread(rows.select("read_id", "repo_id", "path", F.col("text").alias("content")), "read_id")
    return texts.join(last, "read_id", "left_semi").drop("read_id")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current files with role, language and text."""
    f = files(spark, sf_dir).select("repo_id", "path", "role", "language", "ignored", "generated")
    return reads(spark, sf_dir).join(f, ["repo_id", "path"])


FILES_SQL = f"""files_ AS (SELECT repo_id, path, unnest(f), {P.role_sql('path')} AS role, {P.language_sql('path')} AS language, {P.area_sql('path')} AS area FROM (
  SELECT repo_id, path, arg_max({{'size_bytes': size_bytes, 'hash': hash, 'generated': generated, 'ignored': ignored, 'scanned_at': scanned_at}}, {{'a': scanned_at, 'h': hash}}) AS f FROM files GROUP BY 1, 2)),
reads_ AS (SELECT repo_id, path, arg_max(text, {{'a': read_at, 'i': read_id}}) AS content FROM source_reads WHERE status = 'read' GROUP BY 1, 2),
docs_ AS (SELECT f.repo_id, f.path, f.role, f.language, r.content FROM files_ f JOIN reads_ r USING (repo_id, path)),
safe_ AS (SELECT * FROM files_ WHERE role IN ('source','test','config','schema','docs') AND NOT coalesce(ignored, false) AND NOT coalesce(generated, false)),
edges_ AS (SELECT repo_id, source_path, target_path, kind, greatest(0.0, least(1.0, coalesce(max(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END), 0.0)))::DOUBLE AS confidence
  FROM edges WHERE source_path IS NOT NULL AND target_path IS NOT NULL AND source_path <> target_path GROUP BY 1, 2, 3, 4),
commit_raw AS (SELECT repo_id, revision, sha, committed_at, unnest(changed_paths) AS c FROM commits),
commit_files AS (SELECT repo_id, revision, sha, regexp_replace(replace(trim(c.path, ' '), chr(92), '/'), '^(\\./+)+', '') AS path, min(c.change_kind) AS kind, max(committed_at) AS at_ FROM commit_raw WHERE c.path IS NOT NULL AND trim(c.path, ' ') <> '' GROUP BY 1, 2, 3, 4),
labelled AS (SELECT c.*, CASE WHEN f.path IS NULL THEN 'historical_only' WHEN f.role = 'generated' THEN 'generated' WHEN f.role = 'sensitive' THEN 'sensitive' ELSE 'safe' END AS scope FROM commit_files c LEFT JOIN files_ f ON f.repo_id = c.repo_id AND f.path = c.path)"""
W = f"WITH {FILES_SQL} "


def role_counts(spark, sf_dir):
    return inventory.role_counts(files(spark, sf_dir), "repo_id")


def language_counts(spark, sf_dir):
    f = files(spark, sf_dir).filter("language is not null and role = 'source'").groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("files"))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("files"), "language")).cast("bigint")).filter("rank <= 2")


def path_classes(spark, sf_dir):
    """Role, language, area, family and stem of every path of the inventory, counted."""
    p = F.col("path")
    return files(spark, sf_dir).groupBy("role", "language", "area", P.family(p).alias("family")).agg(F.count(F.lit(1)).alias("files"), F.min(P.stem(p)).alias("first_stem"))


def area_rollup(spark, sf_dir):
    roles = ["source", "test", "config", "docs"]
    f = inventory.safe_files(files(spark, sf_dir))
    out = f.groupBy("repo_id", "area").agg(F.count(F.lit(1)).alias("paths"), *[F.count_if(F.col("role") == r).alias(r) for r in roles], F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"))
    profile = F.when(F.col("source") == 0, "support").when(F.col("test") == 0, "untested").otherwise("covered")
    return out.withColumn("profile", profile)


def area_mode_role(spark, sf_dir):
    """Each area's commonest role; ties go to the smaller name."""
    n = files(spark, sf_dir).groupBy("repo_id", "area", "role").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("repo_id", "area").agg(F.min_by("role", F.struct(-F.col("n"), "role")).alias("mode_role"), F.sum("n").alias("paths"))


def area_families_top(spark, sf_dir):
    n = files(spark, sf_dir).groupBy("repo_id", "area", P.family(F.col("path")).alias("family")).agg(F.count(F.lit(1)).alias("files"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id", "area").orderBy(F.desc("files"), "family")).cast("bigint")).filter("rank <= 8")


def broad_area_top4(spark, sf_dir):
    """The 4 shallowest files of each area, 48 a repository in area order."""
    f = inventory.safe_files(files(spark, sf_dir), ("source",)).withColumn("depth", (F.size(F.split("path", "/"))).cast("bigint"))
    near = f.withColumn("r", F.row_number().over(Window.partitionBy("repo_id", "area").orderBy("depth", "path"))).filter("r <= 4")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy("area", "r")).cast("bigint")).filter("rank <= 48").select("repo_id", "area", "path", "depth", "rank")


def inventory_fingerprint(spark, sf_dir):
    return inventory.fingerprint(files(spark, sf_dir), "repo_id")


def snapshot_diff(spark, sf_dir):
    """What the current inventory changed against the scans before a day."""
    t = table(spark, sf_dir, "files")
    old = inventory.current_files(t.filter(F.col("scanned_at") < F.lit(SNAPSHOT).cast("timestamp_ntz")))
    d = inventory.snapshot_diff(old, inventory.current_files(t), ["repo_id", "path"], ["hash", "size_bytes", "role"])
    return d.groupBy("repo_id", "state").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"))


def store_merge(spark, sf_dir):
    t = table(spark, sf_dir, "files")
    old = inventory.current_files(t.filter(F.col("scanned_at") < F.lit(SNAPSHOT).cast("timestamp_ntz")))
    m = inventory.merged(old, inventory.current_files(t), ["repo_id", "path"], ["hash", "size_bytes", "role"])
    return m.groupBy("repo_id", "outcome").agg(F.count(F.lit(1)).alias("files"))


def vector_upsert(spark, sf_dir):
    """Vectors of even ids replaced by a newer version, keyed by id; one row per key is left."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(1).alias("version"))
    new = v.filter("vec_id % 2 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("version"))
    return inventory.upserted(v, new, ["vec_id"], "version")


def read_status(spark, sf_dir):
    """Guarded read of the stored texts against the status that was stored."""
    r = table(spark, sf_dir, "source_reads").select("status", "reason", "text")
    s = inventory.guarded_status(F.encode("text", "UTF-8"), F.coalesce(F.col("reason") == "policy_excluded", F.lit(False)), F.coalesce(F.octet_length("text"), F.lit(0)))
    return r.groupBy("status", "reason", s.alias("guarded")).agg(F.count(F.lit(1)).alias("reads"))


def tokenized_queries(spark, sf_dir):
    """Terms of all queries with weight and count."""
    q = table(spark, sf_dir, "search_runs").select(F.explode(T.words(F.col("query_text"))).alias("term"))
    return q.groupBy("term").agg(F.count(F.lit(1)).alias("times")).withColumn("weight", T.weight(F.col("term")))


def identifier_parts(spark, sf_dir):
    """Pieces of the names in paths at case, digit and underscore boundaries."""
    f = files(spark, sf_dir).select(F.explode(F.array_distinct(T.parts(F.regexp_extract("path", r"([^/.]+)[^/]*$", 1)))).alias("part"))
    return f.groupBy("part").agg(F.count(F.lit(1)).alias("files"))


def task_information(spark, sf_dir):
    """How much each query says, and which say too little."""
    q = table(spark, sf_dir, "search_runs").select("search_id", "query_text").distinct()
    return q.select("search_id", T.information(F.col("query_text")).cast("bigint").alias("information")).withColumn("low", F.col("information") < 2)


def explicit_paths_found(spark, sf_dir):
    """Paths that documents name, counted."""
    d = table(spark, sf_dir, "documents").select(F.explode(P.explicit_paths(F.col("text"))).alias("path"))
    return d.groupBy("path").agg(F.count(F.lit(1)).alias("documents"))


def lexical_search(spark, sf_dir):
    return lexical.search(spark, docs(spark, sf_dir), TASK, 20, ("repo_id", "path")).select("repo_id", "path", "role", "score")


def search_index(spark, sf_dir) -> str:
    """Where the inverted index of the current files lies: kept for the state of their tables, made if it isn't there."""
    # the tables' files by name, size and time; no content is read
    of = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{sf_dir}/{n}.parquet" for n in ("files", "source_reads")])
    state = of.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")).alias("h"), F.count(F.lit(1)).alias("n")).first()
    at = f"{shared_dir(spark)}/quarrylight/index-{hashlib.sha256(repr(tuple(state)).encode()).hexdigest()[:32]}"
    store.cached_result(spark, f"{at}/done", ["index"], lambda: _made_index(spark, sf_dir, at))
    return at


def _made_index(spark, sf_dir, at: str) -> DataFrame:
    d = docs(spark, sf_dir)
    named = symbols.symbols(d).groupBy("repo_id", "path").agg(F.array_join(F.collect_list("name"), " ").alias("symbols"))
    d = d.join(named, ["repo_id", "path"], "left")
    fields = {"path": F.col("path"), "file_name": F.regexp_extract("path", r"([^/]+)$", 1), "symbols": F.col("symbols"), "content": F.col("content"), "role": F.col("role"), "language": F.col("language")}
    lexical.write_index(d, ["repo_id", "path"], fields, at)
    return spark.range(1)


def _bm25(spark, sf_dir, limit: int) -> DataFrame:
    got = lexical.bm25(spark, search_index(spark, sf_dir), ["repo_id", "path"], lexical.query_terms(spark, TASK))
    return got.select("repo_id", "path", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "repo_id", "path").limit(limit)


def bm25_search(spark, sf_dir):
    """The best files by BM25 of one task over six fields of the kept index."""
    return _bm25(spark, sf_dir, 25)


def hybrid_search(spark, sf_dir):
    """Eight times as many files by BM25 as asked for, with the exact hits before and beside them."""
    got = lexical.hybrid(_bm25(spark, sf_dir, 200), lexical_search(spark, sf_dir), ["repo_id", "path"])
    return got.select("repo_id", "path", F.round("score", 6).alias("score"), "exact").orderBy(F.desc("exact"), F.desc("score"), "repo_id", "path").limit(25)


def symbol_extract(spark, sf_dir):
    s = symbols.symbols(docs(spark, sf_dir))
    return s.groupBy("language", "kind", "exported").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("path").alias("paths"), F.min("name").alias("first_name"))


def symbol_search(spark, sf_dir):
    s = symbols.symbols(docs(spark, sf_dir))
    score = lexical.symbol_score(F.col("name"), F.col("path"), F.col("signature"), F.col("exported"), ["ledger", "session", "resolve"])
    return s.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "path", "line_no", "repo_id").limit(20).select("repo_id", "path", "name", "kind", "line_no", "score")


def symbol_reference_edges(spark, sf_dir):
    """Calls and references between safe sources and tests of the languages whose imports resolve."""
    safe = inventory.safe_files(files(spark, sf_dir), ("source", "test")).filter(F.col("language").isin(*REFERENCING)).select("repo_id", "path")
    d = docs(spark, sf_dir).join(safe, ["repo_id", "path"], "left_semi")
    return symbols.references(d, symbols.symbols(d))


def import_extract(spark, sf_dir):
    i = symbols.imports(docs(spark, sf_dir))
    return i.groupBy("language", "confidence").agg(F.count(F.lit(1)).alias("imports"), F.countDistinct("raw").alias("names"), F.min("raw").alias("first_raw"))


def import_resolve(spark, sf_dir):
    i = symbols.imports(docs(spark, sf_dir))
    f = files(spark, sf_dir).filter("role in ('source', 'test')").select("repo_id", "path")
    got = graph.resolved_imports(i, f, symbols.import_candidates(F.col("source_path"), F.col("raw"), F.col("language")))
    return got.select("repo_id", "source_path", "raw", "target_path")


def commit_labels(spark, sf_dir):
    rows = history.labelled(history.commit_files(table(spark, sf_dir, "commits")), files(spark, sf_dir))
    return history.commit_labels(rows).select("repo_id", "revision", "sha", F.array_join("safe_files", ",").alias("safe_files"), "excluded")


def change_kinds(spark, sf_dir):
    rows = history.labelled(history.commit_files(table(spark, sf_dir, "commits")), files(spark, sf_dir))
    return rows.groupBy("repo_id", "kind", "scope").agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("sha").alias("commits"))


def _anchors(rows: DataFrame) -> DataFrame:
    """The three most often changed files of each sidecar."""
    n = rows.groupBy("repo_id", "revision", "path").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("ord", F.row_number().over(Window.partitionBy("repo_id", "revision").orderBy(F.desc("n"), "path"))).filter("ord <= 3").select("repo_id", "revision", "path", "ord")


def cochange_hints(spark, sf_dir):
    rows = history.commit_files(table(spark, sf_dir, "commits"))
    safe = inventory.safe_files(files(spark, sf_dir))
    return history.co_change_hints(rows, _anchors(rows), safe, 20).select("repo_id", "revision", "path", "commit_count", "confidence", "sample")


def newest_commits(spark, sf_dir):
    """The 50 newest commits of each sidecar, with their distinct paths."""
    rows = history.commit_files(table(spark, sf_dir, "commits"), newest=50)
    return rows.groupBy("repo_id", "revision").agg(F.countDistinct("sha").alias("commits"), F.countDistinct("path").alias("paths"), F.count(F.lit(1)).alias("changes"))


def named_commits(spark, sf_dir):
    """Safe files of the commits that queries and documents of their repository name."""
    c = history.labelled(history.commit_files(table(spark, sf_dir, "commits")), files(spark, sf_dir))
    texts = table(spark, sf_dir, "search_runs").select("repo_id", F.col("query_text").alias("text")).unionByName(table(spark, sf_dir, "documents").select("repo_id", "text"))
    hit = c.join(history.named_commits(texts, c), ["repo_id", "sha"], "left_semi")
    return hit.groupBy("repo_id").agg(F.countDistinct(F.when(F.col("scope") == "safe", F.col("path"))).alias("safe_paths"), F.count_if(F.col("scope") != "safe").alias("excluded"))


def mentioned_commits(spark, sf_dir):
    """Safe files of all commits that another commit has as its parent, named in made texts by the first 8 digits."""
    c = history.labelled(history.commit_files(table(spark, sf_dir, "commits")), files(spark, sf_dir))
    named = table(spark, sf_dir, "commits").filter("parent_sha is not null").select(F.explode(history.mentioned_shas(F.concat(F.lit("see commit "), F.substring("parent_sha", 1, 8)))).alias("short")).distinct()
    hit = c.withColumn("short", F.substring("sha", 1, 8)).join(named, "short", "left_semi")
    return hit.groupBy("repo_id").agg(F.countDistinct(F.when(F.col("scope") == "safe", F.col("path"))).alias("safe_paths"), F.count_if(F.col("scope") != "safe").alias("excluded"))


def _edge_anchors(e: DataFrame) -> DataFrame:
    d = e.groupBy("repo_id", F.col("source_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("ord", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n"), "path"))).filter("ord <= 3").select("repo_id", "path", "ord")


def related_edges(spark, sf_dir):
    e = graph.clean_edges(table(spark, sf_dir, "edges"))
    got = graph.related_edges(e, _edge_anchors(e))
    return got.select("repo_id", "source_path", "target_path", "kind", "confidence", F.col("direction").cast("bigint").alias("direction"), F.col("anchor_ord").cast("bigint").alias("anchor_ord"))


def ranked_edges(spark, sf_dir):
    e = graph.clean_edges(table(spark, sf_dir, "edges"))
    got = graph.ranked_edges(graph.related_edges(e, _edge_anchors(e)), 40)
    return got.select("repo_id", "source_path", "target_path", "kind", F.col("shared").cast("bigint").alias("shared"), F.col("rank").cast("bigint").alias("rank"))


def two_hop_edges(spark, sf_dir):
    e = graph.clean_edges(table(spark, sf_dir, "edges"))
    return graph.two_hops(e, F.lit(True), second=(F.col("kind") == "reexport") | F.col("source_path").rlike(r"(?:^|/)__init__\.py$"))


def edge_import(spark, sf_dir):
    good, bad = graph.imported(graph.clean_edges(table(spark, sf_dir, "edges")), inventory.safe_files(files(spark, sf_dir), ("source", "test")))
    both = good.withColumn("outcome", F.lit("accepted")).unionByName(bad.withColumn("outcome", F.lit("rejected")))
    return both.groupBy("repo_id", "kind", "outcome").agg(F.count(F.lit(1)).alias("edges"), F.round(F.max("confidence"), 6).alias("best"))


def graph_nodes(spark, sf_dir):
    return graph.nodes(graph.clean_edges(table(spark, sf_dir, "edges")))


def graph_communities(spark, sf_dir):
    return graph.communities(graph.clean_edges(table(spark, sf_dir, "edges")))


def related_tests(spark, sf_dir):
    return graph.test_links(inventory.safe_files(files(spark, sf_dir)))


EXPLICIT_SQL = r"""list_filter(list_transform(string_split_regex(coalesce(text, ''), '\s+'), lambda t: translate(regexp_replace(regexp_replace(replace(regexp_replace(t, '^[MARKS]+|[MARKS]+$', '', 'g'), chr(92), '/'), '([^:]):+$', '\1'), '^(?:\./)+', ''), 'UP', 'LOW')),
 lambda p: contains(p, '/') AND regexp_matches(p, 'KNOWN'))"""
EXPLICIT_SQL = (
    EXPLICIT_SQL.replace("MARKS", r"!\"#$%&''()*+,;<=>?@\[\]^`{|}~").replace("UP'", P.UPPER + "'").replace("LOW'", P.LOWER + "'").replace("KNOWN", "(?:" + "|".join(x.replace(".", r"\.") for x in P.NAMED_EXTENSIONS) + ")$")
)
SCORE_TERMS = "(SELECT * FROM (VALUES {}) v(term, times, weight))"


def _task_terms() -> list[tuple[str, int, float]]:
    """The task's terms, worked out once by hand-free Python with the same rules, for the SQL text."""
    import re

    low = TASK.lower()
    got = [w for w in re.split("[^a-z0-9_]+", low) if w] + [r.replace("-", "_") for r in re.findall(r"[a-z0-9_]+(?:-[a-z0-9_]+)+", low) if len(r.split("-")) <= 5 and all(len(x) >= 2 and x not in T.STOP_WORDS for x in r.split("-"))]
    weight = lambda w: 0.0 if w in T.STOP_WORDS else 0.25 if w in T.LANGUAGE_WORDS else 0.1 if w in T.NODE_WORDS else 1.0
    return sorted((w, got.count(w), weight(w)) for w in set(got) if weight(w) > 0)


TERMS_SQL = SCORE_TERMS.format(", ".join(f"('{t}', {n}, {w}::DOUBLE)" for t, n, w in _task_terms()))
LOW_PATH, LOW_TEXT = P.lower_sql("path"), P.lower_sql("coalesce(content, '')")
LEXICAL_SQL = W + f"""
, d AS (SELECT repo_id, path, role, {LOW_PATH} AS p, regexp_extract({LOW_PATH}, '([^/]+)$', 1) AS n, {LOW_TEXT} AS c, {LOW_PATH} = 'packages/cell-000/src/build/streamgauge.ts' AS named FROM docs_),
s AS (SELECT d.*, t.times, t.weight AS w, contains(p, term) AS ip, contains(n, term) AS in_, {T.occurrences_sql('c', 'term')} AS o FROM d, {TERMS_SQL} t),
a AS (SELECT repo_id, path, role, p, named, sum(times * w * (CASE WHEN ip THEN 8.0 * CASE WHEN named THEN 1 ELSE 0.25 END ELSE 0 END + CASE WHEN in_ THEN 5.0 * CASE WHEN named THEN 1 ELSE 0.25 END ELSE 0 END + CASE WHEN o > 0 THEN 2 + least(o, 10) ELSE 0 END
 - CASE WHEN NOT ip AND NOT in_ AND o = 0 THEN 1 ELSE 0 END)::DOUBLE) + CASE WHEN named THEN 50 ELSE 0 END AS x, bool_or(o > 0) OR named AS told FROM s GROUP BY 1, 2, 3, 4, 5)
SELECT repo_id, path, role, round(x + CASE role WHEN 'source' THEN 1.0 WHEN 'test' THEN 0.7 WHEN 'config' THEN 0.4 WHEN 'schema' THEN 0.4 WHEN 'docs' THEN 0.4 ELSE 0.0 END, 6)::DOUBLE AS score FROM a WHERE x > 0 AND told ORDER BY score DESC, repo_id, path LIMIT 20"""
PARTS_SQL = r"list_filter(string_split_regex(" + P.lower_sql(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(NAME, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')") + ", '[^a-z0-9]+'), lambda x: x <> '')"


def _first_sql(rules, value) -> str:
    return "CASE " + " ".join(f"WHEN language = '{r[0]}' AND regexp_matches(line, '{(r[-1] if isinstance(r[-1], str) else r[1]).replace(chr(39), chr(39) * 2)}') THEN {value(r)}" for r in rules) + " END"


LINES_SQL = r", lines_ AS (SELECT repo_id, path, language, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT *, string_split_regex(content, '\r?\n') AS l FROM docs_))"
EXPORTED_SQL = "CASE " + " ".join(f"WHEN language = '{k}' THEN regexp_matches(line, '{v}')" for k, v in symbols.EXPORTED.items() if k != "kotlin") + " ELSE false END"
SYMBOLS_SQL = LINES_SQL + f""", sym0 AS (SELECT *, {_first_sql(symbols.SYMBOLS, lambda r: f"{{'kind': '{r[1]}', 'name': regexp_extract(line, '{r[2].replace(chr(39), chr(39) * 2)}', 1)}}")} AS f, {EXPORTED_SQL} AS exported FROM lines_),
sym AS (SELECT DISTINCT repo_id, path, language, f.name AS name, f.kind AS kind, line_no, left(trim(line, ' '), 200) AS signature, exported FROM sym0 WHERE f IS NOT NULL AND f.name <> '')"""
BM25_SQL = W + SYMBOLS_SQL + f"""
, sn AS (SELECT repo_id, path, string_agg(name, ' ') AS names FROM sym GROUP BY 1, 2), dd AS (SELECT docs_.*, names FROM docs_ LEFT JOIN sn USING (repo_id, path)),
f AS (SELECT repo_id, path, 'path' AS field, 3.5::DOUBLE AS boost, {T.words_sql('path')} AS ws FROM dd UNION ALL SELECT repo_id, path, 'file_name', 4.0, {T.words_sql("regexp_extract(path, '([^/]+)$', 1)")} FROM dd UNION ALL SELECT repo_id, path, 'content', 1.0, {T.words_sql('content')} FROM dd
 UNION ALL SELECT repo_id, path, 'symbols', 6.0, {T.words_sql('names')} FROM dd UNION ALL SELECT repo_id, path, 'role', 0.4, {T.words_sql('role')} FROM dd UNION ALL SELECT repo_id, path, 'language', 0.3, {T.words_sql('language')} FROM dd),
z AS (SELECT field, count(*) AS docs, avg(len(ws)) AS ml FROM f GROUP BY 1),
p AS (SELECT repo_id, path, field, boost, len(ws) AS l, unnest(ws) AS term FROM f),
h AS (SELECT repo_id, path, p.field, boost, l, p.term, t.weight, count(*) AS tf FROM p JOIN {TERMS_SQL} t ON t.term = p.term GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM h GROUP BY 1, 2)
SELECT repo_id, path, round(sum(boost * weight * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / ml))), 6)::DOUBLE AS score FROM h JOIN df USING (field, term) JOIN z USING (field) GROUP BY 1, 2 ORDER BY score DESC, repo_id, path LIMIT 25"""
IMPORTS_SQL = LINES_SQL + f""", imp0 AS (SELECT *, {_first_sql(symbols.IMPORTS, lambda r: f"{{'raw': regexp_extract(line, '{r[1].replace(chr(39), chr(39) * 2)}', 1), 'c': {r[2]}::DOUBLE}}")} AS f FROM lines_),
imp AS (SELECT repo_id, path AS source_path, language, f.raw AS raw, max(f.c) AS confidence FROM imp0 WHERE f IS NOT NULL AND f.raw <> '' GROUP BY 1, 2, 3, 4)"""
EDGE_ANCHORS_SQL = ", ea AS (SELECT * FROM (SELECT repo_id, source_path AS path, row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, source_path) AS ord FROM edges_ GROUP BY 1, 2) WHERE ord <= 3)"
RELATED_SQL = EDGE_ANCHORS_SQL + ", rel AS (SELECT repo_id, source_path, target_path, kind, confidence, min(d)::BIGINT AS direction, min(ord) AS anchor_ord FROM (SELECT e.*, 0 AS d, a.ord FROM edges_ e JOIN ea a ON a.repo_id = e.repo_id AND a.path = e.source_path UNION ALL SELECT e.*, 1, a.ord FROM edges_ e JOIN ea a ON a.repo_id = e.repo_id AND a.path = e.target_path) GROUP BY 1, 2, 3, 4, 5)"
STEM_TOKENS = r"list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_extract({}, '([^/]+?)(?:\.[^/]*)?$', 1), '([a-z])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''))"
OLD_SQL = f"""old_ AS (SELECT repo_id, path, unnest(f), {P.role_sql('path')} AS role FROM (SELECT repo_id, path, arg_max({{'size_bytes': size_bytes, 'hash': hash}}, {{'a': scanned_at, 'h': hash}}) AS f FROM files WHERE scanned_at < TIMESTAMP '{SNAPSHOT}' GROUP BY 1, 2))"""
DIFF_SQL = W + f", {OLD_SQL}, j AS (SELECT coalesce(o.repo_id, n.repo_id) AS repo_id, coalesce(o.path, n.path) AS path, o.path IS NULL AS created, n.path IS NULL AS deleted, o.hash IS NOT DISTINCT FROM n.hash AND o.size_bytes IS NOT DISTINCT FROM n.size_bytes AND o.role IS NOT DISTINCT FROM n.role AS same FROM old_ o FULL JOIN files_ n ON o.repo_id = n.repo_id AND o.path = n.path)"
DIR = "regexp_replace(path, '/?[^/]*$', '')"
MIRROR = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace('/' || DIR || '/', '/(?:tests?|spec)/', '/', 'g'), '/(?:src|main)/', '/', 'g'), '/(?:src|main)/', '/', 'g'), '^/+|/+$', '', 'g')".replace("DIR", DIR)

SQL = {
    "role_counts": W + "SELECT repo_id, role, count(*) AS files, sum(coalesce(size_bytes, 0))::BIGINT AS bytes FROM files_ GROUP BY 1, 2",
    "language_counts": W + "SELECT * FROM (SELECT repo_id, language, count(*) AS files, row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, language) AS rank FROM files_ WHERE language IS NOT NULL AND role = 'source' GROUP BY 1, 2) WHERE rank <= 2",
    "path_classes": W + f"SELECT role, language, area, {P.family_sql('path')} AS family, count(*) AS files, min({P.stem_sql('path')}) AS first_stem FROM files_ GROUP BY 1, 2, 3, 4",
    "area_rollup": W + "SELECT *, CASE WHEN source = 0 THEN 'support' WHEN test = 0 THEN 'untested' ELSE 'covered' END AS profile FROM (SELECT repo_id, area, count(*) AS paths, count(*) FILTER (role = 'source') AS source, count(*) FILTER (role = 'test') AS test, count(*) FILTER (role = 'config') AS config, count(*) FILTER (role = 'docs') AS docs, sum(coalesce(size_bytes, 0))::BIGINT AS bytes FROM safe_ GROUP BY 1, 2)",
    "area_mode_role": W + "SELECT repo_id, area, arg_min(role, {'n': -n, 'r': role}) AS mode_role, sum(n)::BIGINT AS paths FROM (SELECT repo_id, area, role, count(*) AS n FROM files_ GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "area_families_top": W + f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, area ORDER BY files DESC, family) AS rank FROM (SELECT repo_id, area, {P.family_sql('path')} AS family, count(*) AS files FROM files_ GROUP BY 1, 2, 3)) WHERE rank <= 8",
    "broad_area_top4": W + ", n AS (SELECT repo_id, area, path, len(string_split(path, '/')) AS depth, row_number() OVER (PARTITION BY repo_id, area ORDER BY len(string_split(path, '/')), path) AS r FROM safe_ WHERE role = 'source') SELECT repo_id, area, path, depth, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY area, r) AS rank FROM n WHERE r <= 4) WHERE rank <= 48",
    "inventory_fingerprint": W + ", p AS (SELECT repo_id, left(md5(path), 2) AS part, md5(string_agg(md5(concat_ws('|', path, hash, size_bytes::VARCHAR, role)), '' ORDER BY path)) AS h, count(*) AS n FROM files_ GROUP BY 1, 2) SELECT repo_id, md5(string_agg(h, '' ORDER BY part)) AS fingerprint, sum(n)::BIGINT AS files FROM p GROUP BY 1",
    "snapshot_diff": DIFF_SQL + " SELECT repo_id, CASE WHEN created THEN 'created' WHEN deleted THEN 'deleted' ELSE 'changed' END AS state, count(*) AS files, min(path) AS first_path FROM j WHERE created OR deleted OR NOT same GROUP BY 1, 2",
    "store_merge": DIFF_SQL + " SELECT repo_id, CASE WHEN created THEN 'inserted' WHEN deleted THEN 'deleted' WHEN same THEN 'reused' ELSE 'updated' END AS outcome, count(*) AS files FROM j GROUP BY 1, 2",
    "vector_upsert": "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN label + 100 ELSE label END AS label, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM embeddings",
    "read_status": "SELECT status, reason, CASE WHEN reason = 'policy_excluded' THEN 'policy_excluded' WHEN octet_length(encode(text)) > 1000000 THEN 'oversized' WHEN text IS NULL THEN 'unreadable' WHEN contains(text, chr(0)) THEN 'binary' ELSE 'read' END AS guarded, count(*) AS reads FROM source_reads GROUP BY 1, 2, 3",
    "tokenized_queries": f"SELECT term, count(*) AS times, {T.weight_sql('term')} AS weight FROM (SELECT unnest({T.words_sql('query_text')}) AS term FROM search_runs) GROUP BY 1",
    "identifier_parts": W + f"SELECT part, count(*) AS files FROM (SELECT unnest(list_distinct({PARTS_SQL.replace('NAME', 'nm')})) AS part FROM (SELECT regexp_extract(path, '([^/.]+)[^/]*$', 1) AS nm FROM files_)) GROUP BY 1",
    "task_information": "SELECT search_id, information, information < 2 AS low FROM (SELECT search_id, coalesce(list_sum(list_transform(list_filter(string_split_regex(coalesce(query_text, ''), '[^A-Za-z0-9_]+'), lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$') AND (" + T.weight_sql(P.lower_sql("x")) + ") > 0), lambda x: CASE WHEN regexp_matches(x, '[a-z][A-Z]|_|[A-Za-z][0-9]') THEN 2 ELSE 1 END)), 0)::BIGINT AS information FROM (SELECT DISTINCT search_id, query_text FROM search_runs))",
    "explicit_paths_found": f"SELECT path, count(*) AS documents FROM (SELECT unnest(list_distinct({EXPLICIT_SQL})) AS path FROM documents) GROUP BY 1",
    "lexical_search": LEXICAL_SQL,
    "bm25_search": BM25_SQL,
    "hybrid_search": f"WITH bm AS ({BM25_SQL.replace('LIMIT 25', 'LIMIT 200')}), ex AS ({LEXICAL_SQL}) SELECT coalesce(bm.repo_id, ex.repo_id) AS repo_id, coalesce(bm.path, ex.path) AS path, round(CASE WHEN coalesce(ex.score, 0) > 0 THEN ex.score * 100 ELSE bm.score END, 6)::DOUBLE AS score, coalesce(ex.score, 0) > 0 AS exact FROM bm FULL JOIN ex ON bm.repo_id = ex.repo_id AND bm.path = ex.path ORDER BY exact DESC, score DESC, 1, 2 LIMIT 25",
    "symbol_extract": W + SYMBOLS_SQL + " SELECT language, kind, exported, count(*) AS symbols, count(DISTINCT path) AS paths, min(name) AS first_name FROM sym GROUP BY 1, 2, 3",
    "import_extract": W + IMPORTS_SQL + " SELECT language, confidence, count(*) AS imports, count(DISTINCT raw) AS names, min(raw) AS first_raw FROM imp GROUP BY 1, 2",
    "commit_labels": W + "SELECT repo_id, revision, sha, coalesce(string_agg(path, ',' ORDER BY path) FILTER (scope = 'safe'), '') AS safe_files, count(*) FILTER (scope <> 'safe') AS excluded FROM labelled GROUP BY 1, 2, 3",
    "change_kinds": W + "SELECT repo_id, kind, scope, count(*) AS changes, count(DISTINCT sha) AS commits FROM labelled GROUP BY 1, 2, 3",
    "cochange_hints": W + """, an AS (SELECT * FROM (SELECT repo_id, revision, path, row_number() OVER (PARTITION BY repo_id, revision ORDER BY count(*) DESC, path) AS ord FROM commit_files GROUP BY 1, 2, 3) WHERE ord <= 3),
touched AS (SELECT DISTINCT c.repo_id, c.revision, c.sha FROM commit_files c JOIN an USING (repo_id, revision, path)),
o AS (SELECT c.* FROM commit_files c JOIN touched t USING (repo_id, revision, sha) WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.repo_id = c.repo_id AND an.revision = c.revision AND an.path = c.path) AND EXISTS (SELECT 1 FROM safe_ s WHERE s.repo_id = c.repo_id AND s.path = c.path)),
h AS (SELECT repo_id, revision, path, count(DISTINCT sha) AS commit_count, array_to_string(list_transform((list(sha ORDER BY at_ DESC, sha))[1:3], lambda x: left(x, 8)), ',') AS sample FROM o GROUP BY 1, 2, 3)
SELECT repo_id, revision, path, commit_count, round(least(commit_count / 5.0, 0.95), 6)::DOUBLE AS confidence, sample FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, revision ORDER BY commit_count DESC, path) AS rk FROM h) WHERE rk <= 20""",
    "newest_commits": W + ", n AS (SELECT repo_id, revision, sha FROM (SELECT repo_id, revision, sha, row_number() OVER (PARTITION BY repo_id, revision ORDER BY max(at_) DESC, sha) AS r FROM commit_files GROUP BY 1, 2, 3) WHERE r <= 50) SELECT repo_id, revision, count(DISTINCT sha) AS commits, count(DISTINCT path) AS paths, count(*) AS changes FROM commit_files JOIN n USING (repo_id, revision, sha) GROUP BY 1, 2",
    "named_commits": W + r""", said AS (SELECT repo_id, lower(query_text) AS t FROM search_runs UNION ALL SELECT repo_id, lower(text) FROM documents), terms AS (SELECT DISTINCT repo_id, unnest(regexp_extract_all(t, '\b([0-9a-f]{7,40})\b', 1)) AS short FROM said WHERE contains(t, 'commit'))
SELECT repo_id, count(DISTINCT CASE WHEN scope = 'safe' THEN path END) AS safe_paths, count(*) FILTER (scope <> 'safe') AS excluded FROM labelled l WHERE EXISTS (SELECT 1 FROM terms t WHERE t.repo_id = l.repo_id AND starts_with(l.sha, t.short)) GROUP BY 1""",
    "mentioned_commits": W + "SELECT repo_id, count(DISTINCT CASE WHEN scope = 'safe' THEN path END) AS safe_paths, count(*) FILTER (scope <> 'safe') AS excluded FROM labelled WHERE left(sha, 8) IN (SELECT left(parent_sha, 8) FROM commits WHERE parent_sha IS NOT NULL) GROUP BY 1",
    "related_edges": W + RELATED_SQL + " SELECT * FROM rel",
    "ranked_edges": W + RELATED_SQL + f", s AS (SELECT *, len(list_intersect({STEM_TOKENS.format('source_path')}, {STEM_TOKENS.format('target_path')})) AS shared FROM rel) SELECT repo_id, source_path, target_path, kind, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY direction, anchor_ord, shared DESC, confidence DESC, source_path, target_path, kind) AS rank FROM s) WHERE rank <= 40",
    "two_hop_edges": W + "SELECT a.repo_id, a.source_path, b.target_path, round(max(greatest(0.0, least(1.0, a.confidence * b.confidence * 0.85::DOUBLE))), 6)::DOUBLE AS confidence, count(DISTINCT a.target_path) AS ways FROM edges_ a JOIN edges_ b ON a.repo_id = b.repo_id AND a.target_path = b.source_path WHERE a.source_path <> b.target_path AND (b.kind = 'reexport' OR regexp_matches(b.source_path, '(?:^|/)__init__\\.py$')) GROUP BY 1, 2, 3",
    "edge_import": W + ", s AS (SELECT repo_id, path FROM safe_ WHERE role IN ('source', 'test')) SELECT repo_id, kind, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.repo_id = e.repo_id AND s.path = e.source_path) AND EXISTS (SELECT 1 FROM s WHERE s.repo_id = e.repo_id AND s.path = e.target_path) THEN 'accepted' ELSE 'rejected' END AS outcome, count(*) AS edges, round(max(confidence), 6) AS best FROM edges_ e GROUP BY 1, 2, 3",
    "graph_nodes": W + "SELECT repo_id, path, max(confidence) AS weight, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT repo_id, source_path AS path, confidence, 1 AS o, 0 AS i FROM edges_ UNION ALL SELECT repo_id, target_path, confidence, 0, 1 FROM edges_) GROUP BY 1, 2",
    "symbol_reference_edges": W + SYMBOLS_SQL + f""", sd AS (SELECT d.* FROM docs_ d JOIN safe_ USING (repo_id, path) WHERE d.role IN ('source', 'test') AND d.language IN {REFERENCING}),
nm AS (SELECT s.repo_id, s.path, name, arg_min(exported, {{'l': line_no, 'k': kind}}) AS exported FROM sym s JOIN sd USING (repo_id, path) WHERE length(name) >= 3 AND (exported OR length(name) >= 4) GROUP BY 1, 2, 3)
SELECT d.repo_id, d.path AS source_path, n.path AS target_path, name AS symbol, CASE WHEN contains(content, name || '(') OR contains(content, name || '::') THEN 'calls' ELSE 'references' END AS kind, (CASE WHEN contains(content, name || '(') THEN 0.82 WHEN exported THEN 0.72 ELSE 0.58 END)::DOUBLE AS confidence
FROM sd d JOIN nm n ON d.repo_id = n.repo_id AND d.path <> n.path AND contains(content, name) AND regexp_matches(content, '(^|[^A-Za-z0-9_])' || regexp_escape(name) || '([^A-Za-z0-9_]|$)')""",
    "symbol_search": W + SYMBOLS_SQL + ", q AS (SELECT unnest(['ledger', 'session', 'resolve']) AS t), z AS (SELECT sym.*, t, "
    + f"{P.lower_sql('name')} AS n, contains({P.lower_sql('path')}, t) AS ip, contains({P.lower_sql('signature')}, t) AS sg FROM sym, q), a AS (SELECT repo_id, path, name, kind, line_no, exported, sum((CASE WHEN n = t THEN 24 WHEN starts_with(n, t) THEN 16 WHEN contains(n, t) THEN 12 ELSE 0 END) + CASE WHEN ip THEN 4 ELSE 0 END + CASE WHEN sg THEN 2 ELSE 0 END - CASE WHEN NOT contains(n, t) AND NOT ip AND NOT sg THEN 2 ELSE 0 END)::DOUBLE AS x FROM z GROUP BY 1, 2, 3, 4, 5, 6) SELECT repo_id, path, name, kind, line_no, x + CASE WHEN exported THEN 1 ELSE 0 END AS score FROM a WHERE x > 0 ORDER BY score DESC, path, line_no, repo_id LIMIT 20",
    "related_tests": W + f", f AS (SELECT repo_id, path, role, {P.stem_sql('path')} AS stem, {DIR} AS dir, {MIRROR} AS mirror FROM safe_) SELECT s.repo_id, s.path AS source_path, t.path AS test_path, round(least(0.95, 0.55 + CASE WHEN s.dir = t.dir THEN 0.25 WHEN s.mirror = t.mirror THEN 0.2 ELSE 0 END), 6)::DOUBLE AS confidence FROM f s JOIN f t ON s.repo_id = t.repo_id AND s.stem = t.stem WHERE s.role = 'source' AND t.role = 'test' AND length(s.stem) >= 3",
    "graph_communities": W + ", n AS (SELECT DISTINCT repo_id, path FROM (SELECT repo_id, source_path AS path FROM edges_ UNION ALL SELECT repo_id, target_path FROM edges_)), c AS (SELECT repo_id, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS community, count(*) AS nodes FROM n GROUP BY 1, 2), e AS (SELECT repo_id, CASE WHEN contains(source_path, '/') THEN split_part(source_path, '/', 1) ELSE '.' END AS community, count(*) AS edges FROM edges_ WHERE CASE WHEN contains(source_path, '/') THEN split_part(source_path, '/', 1) ELSE '.' END = CASE WHEN contains(target_path, '/') THEN split_part(target_path, '/', 1) ELSE '.' END GROUP BY 1, 2) SELECT repo_id, community, nodes, coalesce(edges, 0) AS edges FROM c LEFT JOIN e USING (repo_id, community)",
}
QUERIES = {
    f.__name__: f
    for f in (
        role_counts, language_counts, path_classes, area_rollup, area_mode_role, area_families_top, broad_area_top4, inventory_fingerprint, snapshot_diff, store_merge, vector_upsert, read_status, tokenized_queries, identifier_parts, task_information, explicit_paths_found, lexical_search, bm25_search, hybrid_search,
        symbol_extract, symbol_search, symbol_reference_edges, import_extract, import_resolve, commit_labels, change_kinds, cochange_hints, newest_commits, mentioned_commits, named_commits, related_edges, ranked_edges, two_hop_edges, edge_import, graph_nodes, graph_communities, related_tests,
    )
}
