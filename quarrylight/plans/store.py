"""Queries over stored tables, names and texts by line, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions.vectors import norm
from ..operators import inventory, store
from ..operators.ranks import first_rows
from ..session import work_path
from ..sources.tables import table
from .code import LEXICAL_SQL, SNAPSHOT, W, files, lexical_search, reads

TABLES = ["files", "source_reads", "symbol_reports", "commits", "co_change", "edges", "search_runs", "search_results", "documents", "eval_items", "level_labels"]


def incremental_scan(spark, sf_dir):
    """The current inventory against the one cached on a day: how many hashes are reused."""
    t = table(spark, sf_dir, "files")
    old = inventory.current_files(t.filter(F.col("scanned_at") < F.lit(SNAPSHOT).cast("timestamp_ntz")))
    rows = store.rehashed(inventory.current_files(t), old, ["repo_id", "path"], ["size_bytes", "role", "generated"])
    return rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.count_if("reused").alias("reused"), F.count_if(F.col("hash") == "").alias("to_hash"))


def commit_scan(spark, sf_dir):
    """Title and first parent of the 20 newest commits of each sidecar that have safe files; the limit comes before the filter."""
    c = table(spark, sf_dir, "commits").groupBy("repo_id", "revision", "sha").agg(F.max("title").alias("title"), F.max("parent_sha").alias("parent"), F.max("committed_at").alias("at"), F.max(F.coalesce(F.size("safe_changed_files"), F.lit(0))).cast("bigint").alias("safe"))
    top = first_rows(c, ["repo_id", "revision"], [F.desc_nulls_last("at"), F.asc("sha")], 20)
    return top.filter("safe > 0").select("repo_id", "revision", "sha", "title", "parent", "safe", F.col("rank").cast("bigint").alias("rank"))


def table_counts(spark, sf_dir):
    """Rows of every table, counted in one job."""
    out = None
    for name in TABLES:
        one = table(spark, sf_dir, name).select(F.lit(name).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("rows"))


def domain_cards(spark, sf_dir):
    """The first six parts of each repository with their files and four links."""
    f = inventory.safe_files(files(spark, sf_dir)).withColumn("domain", F.regexp_extract("path", "^([^/]+)/", 1)).filter("domain <> ''")
    return store.first_groups(f, ["repo_id"], "domain", "path", 6, 4)


def repeated_keys(spark, sf_dir):
    """Searches listed twice, and query texts that several searches share."""
    return store.repeated(table(spark, sf_dir, "search_runs"), "search_id", "query_text")


def query_vector_upsert(spark, sf_dir):
    """One stored query vector per repository and query: the newest request's."""
    q = table(spark, sf_dir, "search_runs").filter("query_text is not null").select("repo_id", F.md5("query_text").alias("query_hash"), "search_id", "requested_at")
    old, new = q.filter(F.col("requested_at") < F.lit(SNAPSHOT).cast("timestamp_ntz")), q.filter(F.col("requested_at") >= F.lit(SNAPSHOT).cast("timestamp_ntz"))
    kept = inventory.upserted(old.withColumn("at", F.struct("requested_at", "search_id")).drop("requested_at"), new.withColumn("at", F.struct("requested_at", "search_id")).drop("requested_at"), ["repo_id", "query_hash"], "at")
    return kept.select("repo_id", "query_hash", "search_id")


def card_upsert(spark, sf_dir):
    """Documents as cards of a path: later ones fill and replace what earlier ones hold."""
    d = table(spark, sf_dir, "documents").filter("repo_id is not null and path is not null").select("repo_id", "path", "doc_kind", "lang", "n_chars", "doc_id", "created_at")
    day = F.lit(SNAPSHOT).cast("timestamp_ntz")
    last = lambda x: x.groupBy("repo_id", "path").agg(F.max_by(F.struct("doc_kind", "lang", "n_chars"), F.struct("created_at", "doc_id")).alias("v")).select("repo_id", "path", "v.*")
    both = store.filled(last(d.filter(F.col("created_at") < day)), last(d.filter(F.col("created_at") >= day)), ["repo_id", "path"])
    return both.groupBy("repo_id", "outcome").agg(F.count(F.lit(1)).alias("cards"), F.sum("n_chars").alias("chars"), F.count("lang").alias("with_lang"))


def cached_search(spark, sf_dir):
    """The lexical search of one task through the cache: made once, then read."""
    make = lambda: lexical_search(spark, sf_dir)
    at = work_path(spark, "searches")
    parts = ["lexical", "20", sf_dir]
    store.cached_result(spark, at, parts, make)
    return store.cached_result(spark, at, parts, make)


def bounded_limits(spark, sf_dir):
    q = table(spark, sf_dir, "search_runs").select(store.bounded(F.col("result_limit")).cast("bigint").alias("limit"), "search_id")
    return q.groupBy("limit").agg(F.count_distinct("search_id").alias("searches"))


def ordered_paths(spark, sf_dir):
    """The changed paths of each commit row as they came, each once."""
    paths = store.ordered_distinct(F.transform("changed_paths", lambda c: P.normal_path(c["path"])))
    c = table(spark, sf_dir, "commits").select("repo_id", "revision", "sha", "ingested_at", paths.alias("p")).filter(F.size("p") > 0)
    return c.groupBy("repo_id", "revision").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("p")).alias("paths"), F.count_distinct(F.element_at("p", 1)).alias("first_paths"), F.count_distinct(F.array_join("p", ",")).alias("orders"))


def repo_uuids(spark, sf_dir):
    """Version 5 UUIDs of the repositories' addresses."""
    r = table(spark, sf_dir, "files").select("repo_id").filter("repo_id is not null").distinct()
    return r.select("repo_id", T.name_uuid(F.concat(F.lit("file:///"), F.col("repo_id"))).alias("uuid"))


def area_addresses(spark, sf_dir):
    """Addresses of areas, percent-encoded, and whether they decode to the area again."""
    a = files(spark, sf_dir).select("area").distinct()
    code = T.percent_encoded(F.col("area"))
    return a.select("area", F.concat(F.lit("area://"), code).alias("address"), (T.percent_decoded(code) == F.col("area")).alias("same"))


def scan_times(spark, sf_dir):
    """First and last scan of each repository in microseconds and seconds since 1970."""
    t = table(spark, sf_dir, "files").filter("scanned_at is not null").select("repo_id", F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("us"))
    return t.groupBy("repo_id").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.floor(F.max("us") / 1000000).cast("bigint").alias("last_s"))


def line_slices(spark, sf_dir):
    """Lines 3 to 7 of the current text of every file, by an address with a line range."""
    r = reads(spark, sf_dir).withColumn("range", T.line_range(F.concat(F.lit("file:///"), F.col("path"), F.lit("#L3-L7"))))
    s = T.lines_between(F.col("content"), F.col("range.first"), F.col("range.last"))
    return r.select("repo_id", "path", F.md5(F.encode(s, "UTF-8")).alias("digest"), F.size(F.split(s, "\n")).cast("bigint").alias("lines"))


def shell_words(spark, sf_dir):
    """Paths as words of a shell: those that need quotes, and all in quotes or not."""
    p = table(spark, sf_dir, "commits").select(F.inline("changed_paths")).filter("path is not null").select("path").distinct()
    return p.select("path", T.shell_quoted(F.col("path")).alias("word"))


def evidence_defaults(spark, sf_dir):
    """All files of the repositories with the score of one task, 0 without a match, summed by role."""
    hits = lexical_search(spark, sf_dir).select("repo_id", "path", "score")
    f = files(spark, sf_dir).select("repo_id", "path", "role")
    return f.join(hits, ["repo_id", "path"], "left").groupBy("role").agg(F.count(F.lit(1)).alias("files"), F.count("score").alias("matched"), F.round(F.sum(F.coalesce("score", F.lit(0.0))), 6).alias("score"))


def signal_contribution(spark, sf_dir):
    """Results of each role per search, over all searches that have results."""
    r = table(spark, sf_dir, "search_results").filter("path is not null").select("search_id", "path", P.role(F.col("path")).alias("role")).distinct()
    n = r.groupBy("role").agg(F.count(F.lit(1)).alias("results"), F.count_distinct("search_id").alias("searches"))
    return n.withColumn("per_search", F.round(F.col("results") / F.col("searches"), 6))


def vector_scan(spark, sf_dir):
    """Vectors kept as JSON text, read back by their dimension, and their length."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.to_json("embedding").alias("json"))
    back = v.withColumn("v", F.from_json("json", "array<double>")).filter(F.size("v") == 64)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.round(F.avg(norm(F.col("v"))), 4).alias("length"))


SQL = {
    "incremental_scan": f"WITH {{O}}, n AS (SELECT * FROM files_) SELECT n.repo_id, count(*) AS files, count(*) FILTER (ok) AS reused, count(*) FILTER (NOT ok) AS to_hash FROM (SELECT n.repo_id, o.path IS NOT NULL AND n.size_bytes IS NOT DISTINCT FROM o.size_bytes AND n.generated IS NOT DISTINCT FROM o.generated AND o.hash IS NOT NULL AS ok FROM n LEFT JOIN o USING (repo_id, path)) n GROUP BY 1".replace(
        "{O}", W.removeprefix("WITH ").strip() + f", o AS (SELECT repo_id, path, unnest(f) FROM (SELECT repo_id, path, arg_max({{'size_bytes': size_bytes, 'hash': hash, 'generated': generated}}, {{'t': scanned_at, 'h': hash}}) AS f FROM files WHERE scanned_at < TIMESTAMP '{SNAPSHOT}' GROUP BY 1, 2))"
    ),
    "commit_scan": "WITH c AS (SELECT repo_id, revision, sha, max(title) AS title, max(parent_sha) AS parent, max(committed_at) AS at_, max(coalesce(len(safe_changed_files), 0))::BIGINT AS safe FROM commits GROUP BY 1, 2, 3) SELECT repo_id, revision, sha, title, parent, safe, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, revision ORDER BY at_ DESC NULLS LAST, sha) AS rank FROM c) WHERE rank <= 20 AND safe > 0",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in TABLES),
    "domain_cards": W + ", d AS (SELECT repo_id, path, regexp_extract(path, '^([^/]+)/', 1) AS domain FROM safe_), g AS (SELECT repo_id, domain, count(*) AS members, array_to_string(list_sort(list(path))[1:4], ',') AS links FROM d WHERE domain <> '' GROUP BY 1, 2) SELECT repo_id, domain, members, links FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY domain) AS r FROM g) WHERE r <= 6",
    "repeated_keys": "SELECT 'error' AS severity, 'repeated_id' AS code, search_id::VARCHAR AS value, count(*) AS times FROM search_runs WHERE search_id IS NOT NULL GROUP BY 3 HAVING count(*) > 1 UNION ALL SELECT 'warning', 'repeated_label', query_text, count(DISTINCT search_id) FROM search_runs WHERE query_text IS NOT NULL GROUP BY 3 HAVING count(DISTINCT search_id) > 1",
    "query_vector_upsert": f"SELECT repo_id, md5(query_text) AS query_hash, arg_max(search_id, {{'n': requested_at >= TIMESTAMP '{SNAPSHOT}', 'r': requested_at, 's': search_id}}) AS search_id FROM search_runs WHERE query_text IS NOT NULL AND requested_at IS NOT NULL GROUP BY 1, 2",
    "card_upsert": f"""WITH d AS (SELECT repo_id, path, created_at < TIMESTAMP '{SNAPSHOT}' AS old, arg_max({{'k': doc_kind, 'l': lang, 'n': n_chars}}, {{'c': created_at, 'd': doc_id}}) AS v FROM documents WHERE repo_id IS NOT NULL AND path IS NOT NULL AND created_at IS NOT NULL GROUP BY 1, 2, 3),
a AS (SELECT * FROM d WHERE old), b AS (SELECT * FROM d WHERE NOT old), j AS (SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, CASE WHEN a.path IS NULL THEN 'inserted' WHEN b.path IS NULL THEN 'kept' ELSE 'updated' END AS outcome, coalesce(b.v.n, a.v.n) AS n, coalesce(b.v.l, a.v.l) AS l FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.path = b.path)
SELECT repo_id, outcome, count(*) AS cards, sum(n)::BIGINT AS chars, count(l) AS with_lang FROM j GROUP BY 1, 2""",
    "cached_search": LEXICAL_SQL,
    "bounded_limits": "SELECT least(greatest(coalesce(result_limit, 10), 1), 50)::BIGINT AS \"limit\", count(DISTINCT search_id) AS searches FROM search_runs GROUP BY 1",
    "ordered_paths": r"""WITH p AS (SELECT repo_id, revision, sha, list_filter(list_transform(changed_paths, lambda c: regexp_replace(replace(trim(c.path, ' '), chr(92), '/'), '^(\./+)+', '')), lambda x: x IS NOT NULL AND x <> '') AS l FROM commits),
u AS (SELECT repo_id, revision, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM p WHERE len(l) > 0) SELECT repo_id, revision, count(*) AS rows, sum(len(l))::BIGINT AS paths, count(DISTINCT l[1]) AS first_paths, count(DISTINCT array_to_string(l, ',')) AS orders FROM u GROUP BY 1, 2""",
    "repo_uuids": "WITH h AS (SELECT DISTINCT repo_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('file:///' || repo_id)) AS h FROM files WHERE repo_id IS NOT NULL) SELECT repo_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][('0x' || substr(h, 17, 1))::INT % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h",
    "area_addresses": W + "SELECT DISTINCT area, 'area://' || url_encode(area) AS address, url_decode(url_encode(area)) = area AS same FROM files_",
    "scan_times": "SELECT repo_id, min(epoch_us(scanned_at)) AS first_us, max(epoch_us(scanned_at)) AS last_us, (max(epoch_us(scanned_at)) // 1000000)::BIGINT AS last_s FROM files WHERE scanned_at IS NOT NULL GROUP BY 1",
    "line_slices": W + r"SELECT repo_id, path, md5(array_to_string(string_split(content, chr(10))[3:7], chr(10))) AS digest, greatest(1, len(string_split(content, chr(10))[3:7]))::BIGINT AS lines FROM reads_ WHERE content IS NOT NULL",
    "shell_words": "WITH p AS (SELECT DISTINCT c.path AS path FROM (SELECT unnest(changed_paths) AS c FROM commits) WHERE c.path IS NOT NULL) SELECT path, CASE WHEN regexp_matches(path, '^[A-Za-z0-9_./@%+=:,-]+$') THEN path ELSE chr(39) || replace(path, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) END AS word FROM p",
    "evidence_defaults": "WITH hit AS (" + LEXICAL_SQL + "), " + W.removeprefix("WITH ") + "SELECT f.role, count(*) AS files, count(hit.score) AS matched, round(sum(coalesce(hit.score, 0.0)), 6)::DOUBLE AS score FROM files_ f LEFT JOIN hit ON hit.repo_id = f.repo_id AND hit.path = f.path GROUP BY 1",
    "signal_contribution": f"SELECT role, count(*) AS results, count(DISTINCT search_id) AS searches, round(count(*) / count(DISTINCT search_id)::DOUBLE, 6) AS per_search FROM (SELECT DISTINCT search_id, path, {P.role_sql('path')} AS role FROM search_results WHERE path IS NOT NULL) GROUP BY 1",
    "vector_scan": "SELECT label, count(*) AS vectors, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 4) AS length FROM embeddings WHERE len(embedding) = 64 GROUP BY 1",
}
QUERIES = {
    f.__name__: f
    for f in (
        incremental_scan, commit_scan, table_counts, domain_cards, repeated_keys, query_vector_upsert, card_upsert, cached_search, bounded_limits, ordered_paths, repo_uuids, area_addresses, scan_times, line_slices, shell_words, evidence_defaults, signal_contribution, vector_scan,
    )
}
