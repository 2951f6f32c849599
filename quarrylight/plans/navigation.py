"""Queries around a plan: floors, next reads, tests and their commands, seeds, task families, replayed commits; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import tasks as K
from ..functions import text as T
from ..operators import commands, floors, fusion, graph, history, inventory, symbols
from ..operators.ranks import best_items, first_rows
from ..sources.tables import table
from .code import FILES_SQL, W, files, reads
from .ranking import HITS_SQL, KEY, PLAN_SQL, candidates


def _searches(spark, sf_dir) -> DataFrame:
    """One row per search: its repository and longest query text."""
    q = table(spark, sf_dir, "search_runs").filter("query_text is not null")
    return q.groupBy("search_id", "repo_id").agg(F.max_by("query_text", F.struct(F.length("query_text"), "query_text")).alias("query_text"))


def _hits(spark, sf_dir, n: int = 24) -> DataFrame:
    return best_items(table(spark, sf_dir, "search_results"), KEY, "path", "score", n).withColumnRenamed("item", "path")


def edge_orders(spark, sf_dir) -> DataFrame:
    """search_id, repo_id, path and the best family of the edges that lead to it from the three best hits."""
    seeds = _hits(spark, sf_dir, 3).select(*KEY, F.col("path").alias("source_path"))
    e = graph.clean_edges(table(spark, sf_dir, "edges")).select("repo_id", "source_path", F.col("target_path").alias("path"), floors.edge_order(F.col("kind")).alias("o"))
    return seeds.join(e, ["repo_id", "source_path"]).groupBy(*KEY, "path").agg(F.min("o").alias("edge_order"))


def floor_lists(spark, sf_dir):
    """The floors of every search: lexical, dependency, history, config, scripts and nested readmes."""
    c = candidates(spark, sf_dir).join(edge_orders(spark, sf_dir), [*KEY, "path"], "left")
    return floors.floor_lists(c, KEY, 10)


def next_reads(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return floors.next_reads(c, fusion.selected(c, KEY, 10), KEY)


def plan_tests(spark, sf_dir):
    return floors.tests_in_two_passes(candidates(spark, sf_dir), KEY, 10)


def test_commands(spark, sf_dir):
    """Every test file with its command and confidence 1."""
    f = files(spark, sf_dir)
    return commands.test_commands(f, f.filter("role = 'test'")).withColumn("confidence", F.lit(1.0))


def task_families(spark, sf_dir):
    """The family of every query, and whether it spans areas."""
    q = _searches(spark, sf_dir)
    return q.select("search_id", "repo_id", K.multi_area(T.words(F.col("query_text"))).alias("multi_area"), K.family(F.col("query_text")).alias("family"))


def broad_validation(spark, sf_dir):
    """Searches whose tests lie in three areas and are ten or more, or whose query has two broad words."""
    t = _hits(spark, sf_dir).withColumn("role", P.role(F.col("path"))).filter("role = 'test'")
    tests = t.groupBy(*KEY).agg(F.count_distinct(floors.first_part(F.col("path"))).alias("areas"), F.count(F.lit(1)).alias("tests"))
    q = _searches(spark, sf_dir).select(*KEY, K.broad_words(T.words(F.col("query_text")), K.VALIDATING).cast("bigint").alias("words"))
    j = q.join(tests, KEY, "left").select(*KEY, "words", F.coalesce("areas", F.lit(0)).alias("areas"), F.coalesce("tests", F.lit(0)).alias("tests"))
    return j.withColumn("broad", (F.col("areas") >= 3) & ((F.col("tests") >= 10) | (F.col("words") >= 2)))


def source_roots(spark, sf_dir):
    """The roots of a search's source hits; without one, the repository's commonest source root."""
    root = floors.first_part(F.col("path"))
    fit = ~root.isin(*OTHER_ROOTS) & (P.role(F.col("path")) == "source")
    hits = _hits(spark, sf_dir).filter(fit).select(*KEY, root.alias("root")).distinct()
    n = files(spark, sf_dir).filter(fit).groupBy("repo_id", root.alias("root")).agg(F.count(F.lit(1)).alias("n"))
    mode = n.groupBy("repo_id").agg(F.min_by("root", F.struct(-F.col("n"), "root")).alias("root"))
    every = table(spark, sf_dir, "search_runs").select(*KEY).distinct()
    rest = every.join(hits.select(*KEY).distinct(), KEY, "left_anti").join(mode, "repo_id").select(*KEY, "root")
    return hits.withColumn("from", F.lit("hits")).unionByName(rest.withColumn("from", F.lit("mode")))


# First parts that are no source root.
OTHER_ROOTS = ["examples", "tests", "test", "docs", "doc", "scripts"]


def expansion_seeds(spark, sf_dir):
    """Seeds of the search for tests: the three best hits, then what changed with them, then both ends of their edges; sources and unknown files alone, in that order, each once."""
    hits = _hits(spark, sf_dir, 3).select(*KEY, "path", F.col("rank").alias("ord"))
    anchors = hits.select(*KEY, F.col("path").alias("seed"), "ord")
    co = table(spark, sf_dir, "co_change").select("repo_id", P.normal_path(F.col("anchor_path")).alias("seed"), P.normal_path(F.col("path")).alias("path")).filter("path is not null").distinct()
    near = anchors.join(co, ["repo_id", "seed"]).select(*KEY, "path", (F.col("ord") + 100).alias("ord"))
    e = graph.clean_edges(table(spark, sf_dir, "edges")).select("repo_id", "source_path", "target_path").distinct()
    out = anchors.join(e.withColumnRenamed("source_path", "seed"), ["repo_id", "seed"]).select(*KEY, F.col("target_path").alias("path"), (F.col("ord") + 200).alias("ord"))
    in_ = anchors.join(e.withColumnRenamed("target_path", "seed"), ["repo_id", "seed"]).select(*KEY, F.col("source_path").alias("path"), (F.col("ord") + 200).alias("ord"))
    role = P.role(F.col("path"))
    rows = hits.unionByName(near).unionByName(out).unionByName(in_).filter(role.isin("source", "unknown"))
    first = rows.groupBy(*KEY, "path").agg(F.min("ord").alias("ord"))
    return first_rows(first, KEY, [F.asc("ord"), F.asc("path")], 40, "place").select(*KEY, "path", F.col("ord").cast("bigint").alias("ord"), F.col("place").cast("bigint").alias("place"))


def commit_candidates(spark, sf_dir):
    """A synthetic history candidate per anchor: its hints' commits over five, 0.1 to 0.95, times the history weight."""
    c = table(spark, sf_dir, "co_change").select("repo_id", "revision", P.normal_path(F.col("anchor_path")).alias("anchor"), P.normal_path(F.col("path")).alias("path"), "commit_count").filter("path is not null")
    one = c.groupBy("repo_id", "revision", "anchor", "path").agg(F.max("commit_count").alias("k"))
    score = F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.sum("k") / 5))
    return one.groupBy("repo_id", "revision", "anchor").agg(F.sum("k").alias("commits"), F.round(score, 6).alias("score"), F.round(score * fusion.WEIGHTS["history"], 6).alias("weighted"))


def edge_profile(spark, sf_dir):
    """Per kind of edge: candidates it brings from the three best hits, those among the first ten hits, and the searches affected."""
    hits = _hits(spark, sf_dir)
    seeds = hits.filter("rank <= 3").select(*KEY, F.col("path").alias("source_path"))
    e = graph.clean_edges(table(spark, sf_dir, "edges")).select("repo_id", "source_path", F.col("target_path").alias("path"), "kind")
    near = seeds.join(e, ["repo_id", "source_path"]).select(*KEY, "path", "kind").distinct()
    top = hits.filter("rank <= 10").select(*KEY, "path", F.lit(True).alias("_top"))
    return near.join(top, [*KEY, "path"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("_top").alias("selected"), F.count_distinct(F.when(F.col("_top"), F.col("search_id"))).alias("searches"))


def retrieval_targets(spark, sf_dir):
    """Per sidecar the changed paths of all commits that an earlier commit of it changed too, which alone can be retrieved, and the new ones."""
    c = history.commit_files(table(spark, sf_dir, "commits"))
    before = F.min("at").over(Window.partitionBy("repo_id", "revision", "path"))
    rows = c.withColumn("old", F.coalesce(before < F.col("at"), F.lit(False)))
    return rows.groupBy("repo_id", "revision").agg(F.count_distinct("sha").alias("commits"), F.count_if("old").alias("targets"), F.count_if(~F.col("old")).alias("new_files"))


def commit_replay(spark, sf_dir):
    """Each commit's title as a task: files of the sidecar ranked by words shared with their names, and how many of the changed ones are among the first ten."""
    commits = table(spark, sf_dir, "commits").filter("title is not null").groupBy("repo_id", "revision", "sha").agg(F.max("title").alias("title"))
    words = commits.select("repo_id", "revision", "sha", F.explode(F.array_distinct(F.filter(T.words(F.col("title")), lambda w: F.length(w) >= 4))).alias("w"))
    changed = history.commit_files(table(spark, sf_dir, "commits")).select("repo_id", "revision", "sha", "path").distinct()
    name = F.regexp_extract("path", r"([^/.]+)[^/]*$", 1)
    known = changed.select("repo_id", "revision", "path").distinct().select("repo_id", "revision", "path", F.explode(F.array_distinct(T.parts(name))).alias("w"))
    score = words.join(known, ["repo_id", "revision", "w"]).groupBy("repo_id", "revision", "sha", "path").agg(F.count(F.lit(1)).alias("n"))
    top = first_rows(score, ["repo_id", "revision", "sha"], [F.desc("n"), F.asc("path")], 10)
    hit = changed.join(top, ["repo_id", "revision", "sha", "path"], "left")
    per = hit.groupBy("repo_id", "revision", "sha").agg(F.count(F.lit(1)).alias("t"), F.count("rank").alias("h"), F.min("rank").alias("f"))
    return per.groupBy("repo_id").agg(F.count(F.lit(1)).alias("commits"), F.round(F.avg(F.col("h") / F.col("t")), 6).alias("recall_10"), F.round(F.avg(F.coalesce(1 / F.col("f"), F.lit(0.0))), 6).alias("mrr_10"))


def exact_primary(spark, sf_dir):
    """Whether exact hits alone answer a search: as many as its limit, as five, or any for a single long identifier."""
    q = _searches(spark, sf_dir).select(*KEY, F.filter(T.words(F.col("query_text")), lambda w: T.weight(w) > 0).alias("w"))
    limit = table(spark, sf_dir, "search_runs").groupBy(*KEY).agg(F.greatest(F.lit(1), F.max(F.coalesce("result_limit", F.lit(10)))).alias("n"))
    exact = table(spark, sf_dir, "search_results").filter("score >= 5 and not isnan(score) and path is not null").groupBy(*KEY).agg(F.count_distinct("path").alias("exact"))
    j = limit.join(q, KEY, "left").join(exact, KEY, "left").select(*KEY, F.coalesce("exact", F.lit(0)).alias("exact"), F.col("n").cast("bigint").alias("n"), F.coalesce("w", F.array().cast("array<string>")).alias("w"))
    alone = (F.col("exact") > 0) & (F.size("w") == 1) & (F.length(F.element_at(F.concat("w", F.array(F.lit(""))), 1)) >= 8)
    return j.select(*KEY, "exact", "n", ((F.col("exact") >= F.col("n")) | (F.col("exact") >= F.least("n", F.lit(5))) | alone).alias("primary"))


def file_prefilter(spark, sf_dir):
    """The 128 files of all repositories likeliest for a task by path, language and role, before any vector is made."""
    low = P.ascii_lower(F.col("path"))
    hits = sum((F.when(F.contains(low, F.lit(t)), 4.0).otherwise(0.0) for t in PREFILTER_TERMS), F.lit(0.0))
    bonus = F.when(F.col("language").isin(*PREFILTER_TERMS), 0.5).otherwise(0.0) + F.when(F.col("role").isin(*PREFILTER_TERMS), 0.4).otherwise(0.0)
    f = inventory.safe_files(files(spark, sf_dir)).withColumn("score", F.round(hits + bonus, 6)).filter("score > 0")
    return f.orderBy(F.desc("score"), "path", "repo_id").limit(128).select("repo_id", "path", "role", "score")


PREFILTER_TERMS = ["broker", "session", "token", "ledger", "python", "source"]


def neighborhood(spark, sf_dir):
    """Around each repository's best-linked file: eight neighbours by confidence and direction, and the roles they have."""
    e = graph.clean_edges(table(spark, sf_dir, "edges"))
    degree = e.groupBy("repo_id", F.col("source_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    anchor = degree.groupBy("repo_id").agg(F.min_by("path", F.struct(-F.col("n"), "path")).alias("path")).withColumn("ord", F.lit(0))
    r = graph.related_edges(e, anchor).withColumn("path", F.when(F.col("direction") == 0, F.col("target_path")).otherwise(F.col("source_path")))
    best = r.groupBy("repo_id", "path").agg(F.max("confidence").alias("confidence"), F.min("direction").cast("bigint").alias("direction"))
    top = first_rows(best, ["repo_id"], [F.desc("confidence"), F.asc("direction"), F.asc("path")], 8, "place")
    return top.select("repo_id", "path", P.role(F.col("path")).alias("role"), "direction", F.round("confidence", 6).alias("confidence"), F.col("place").cast("bigint").alias("place"))


def anchored_targets(spark, sf_dir):
    """Anchors of the hints against the inventory: their role (source where it is unknown), and those that are not there."""
    a = table(spark, sf_dir, "co_change").select("repo_id", P.normal_path(F.col("anchor_path")).alias("path")).filter("path is not null").distinct()
    f = files(spark, sf_dir).select("repo_id", "path", F.col("role").alias("_r"))
    return a.join(f, ["repo_id", "path"], "left").select("repo_id", "path", F.coalesce("_r", F.lit("source")).alias("role"), F.col("_r").isNotNull().alias("available"))


def signal_support(spark, sf_dir):
    """Signals that at least two repositories support: searches with the signal among their ten targets."""
    c = fusion.selected(candidates(spark, sf_dir), KEY, 10).select(*KEY, F.explode(F.split("signals", ",")).alias("signal"))
    n = c.groupBy("signal").agg(F.count_distinct("repo_id").alias("repositories"), F.count_distinct("search_id").alias("searches"), F.count(F.lit(1)).alias("targets"))
    return n.withColumn("supported", F.col("repositories") >= 2)


def written_imports(spark, sf_dir) -> DataFrame:
    """The edges of kind import as a source of its language would write them: relative paths, dotted modules, crate paths."""
    e = graph.clean_edges(table(spark, sf_dir, "edges")).filter("kind = 'import'")
    language, bare = P.language(F.col("source_path")), F.regexp_replace("target_path", r"\.[^./]+$", "")
    depth = F.size(F.split("source_path", "/")) - 1
    raw = (
        F.when(language.isin("javascript", "typescript"), F.concat(F.when(depth == 0, "./").otherwise(F.repeat(F.lit("../"), depth)), bare)).when(language == "python", F.replace(bare, F.lit("/"), F.lit(".")))
        .when(language == "rust", F.concat(F.lit("crate::"), F.replace(bare, F.lit("/"), F.lit("::")))).when(language == "java", F.replace(bare, F.lit("/"), F.lit(".")))
    )
    return e.select("repo_id", "source_path", language.alias("language"), raw.alias("raw")).filter("raw is not null").distinct()


def _resolved(spark, sf_dir) -> DataFrame:
    f = files(spark, sf_dir).filter("role in ('source', 'test')").select("repo_id", "path")
    return graph.resolved_imports(written_imports(spark, sf_dir), f, symbols.import_candidates(F.col("source_path"), F.col("raw"), F.col("language")))


def resolved_imports(spark, sf_dir):
    """Written imports with the file of the repository that they mean."""
    return _resolved(spark, sf_dir)


def dependency_edges(spark, sf_dir):
    """Resolved imports and the stored edges as one list, imports first, then the order in which edges came; counted by kind."""
    none = F.lit(None).cast("timestamp_ntz")
    found = _resolved(spark, sf_dir).select("repo_id", "source_path", "target_path", F.lit("import").alias("kind"), F.lit(0).alias("from"), none.alias("at"), F.lit(0.9).alias("confidence"))
    stored = table(spark, sf_dir, "edges").select("repo_id", "source_path", "target_path", "kind", F.lit(1).alias("from"), F.col("ingested_at").alias("at"), F.when(F.isnan("confidence"), None).otherwise(F.col("confidence")).alias("confidence"))
    rows = graph.deduplicated(found.unionByName(stored), [F.asc("from"), F.asc_nulls_last("at"), F.desc_nulls_last("confidence")])
    return rows.groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("from") == 0).alias("resolved"), F.round(F.sum("confidence"), 4).alias("confidence"))


def anchor_tests(spark, sf_dir):
    """The ten tests of each repository that the hints' anchors are tied to most: by name, directory, mirrored directory, mention and terms."""
    a = table(spark, sf_dir, "co_change").select("repo_id", P.normal_path(F.col("anchor_path")).alias("path")).filter("path is not null").distinct()
    a = a.withColumn("ord", F.row_number().over(Window.partitionBy("repo_id").orderBy("path")) - 1)
    t = inventory.safe_files(files(spark, sf_dir), ("test",)).select("repo_id", "path").join(reads(spark, sf_dir), ["repo_id", "path"], "left")
    top = first_rows(graph.scored_tests(graph.source_keys(a), t), ["repo_id"], [F.desc("score"), F.asc("test_path")], 10, "place")
    return top.select("repo_id", "test_path", "score", F.col("place").cast("bigint").alias("place"))


def _ends(values: list[str]) -> str:
    return "(?:" + "|".join(v.replace(".", r"\.") for v in values) + ")$"


def _values(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


ROOT = "regexp_extract(path, '^/*([^/]+)', 1)"
AUX = f"CASE WHEN {ROOT} IN ({_values(floors.AUXILIARY)}) THEN 1 ELSE 0 END"
LOW = P.lower_sql("path")
SEARCHES = "sq AS (SELECT search_id, repo_id, arg_max(query_text, {'l': length(query_text), 't': query_text}) AS query_text FROM search_runs WHERE query_text IS NOT NULL GROUP BY 1, 2)"
SEEDS = "sd AS (SELECT search_id, repo_id, path AS seed, rank FROM hits WHERE rank <= 3)"
HIT_ROWS = HITS_SQL[: HITS_SQL.index("e AS (SELECT")].rstrip().rstrip(",")
EDGE_KIND = "ek AS (SELECT DISTINCT repo_id, source_path, target_path, kind FROM edges WHERE source_path IS NOT NULL AND target_path IS NOT NULL AND source_path <> target_path)"
NORMAL = r"regexp_replace(replace(trim({}, ' '), chr(92), '/'), '^(\./+)+', '')"


def _floor(name: str, where: str, a: str, b: str, v: str, r: str) -> str:
    most = floors.limits(10)[name]
    return f"SELECT search_id, repo_id, '{name}' AS floor, row_number() OVER (PARTITION BY search_id, repo_id ORDER BY {a}, {b}, {v} DESC, {r} NULLS LAST, rank_score DESC, path) AS place, {most} AS most, path FROM c WHERE {where}"


FLOOR_SQL = (
    f"WITH {HITS_SQL}, {SEEDS}, {EDGE_KIND}, eo AS (SELECT search_id, sd.repo_id, target_path AS path, min(CASE WHEN kind LIKE 'precision%' THEN 0 WHEN kind IN ('import', 'imports') THEN 1 WHEN kind IN ('reexport', 'python_reexport') THEN 3 ELSE 2 END) AS eo FROM sd JOIN ek ON ek.repo_id = sd.repo_id AND source_path = seed GROUP BY 1, 2, 3),"
    " c AS (SELECT cand.*, eo.eo FROM cand LEFT JOIN eo USING (search_id, repo_id, path)), fl AS ("
    + " UNION ALL ".join([
        _floor("lexical", "role = 'source' AND lexical_score >= 0.3", AUX, "0", "lexical_score", "lexical_rank"),
        _floor("dependency", "role = 'source' AND dependency_score IS NOT NULL", AUX, "coalesce(eo, 9)", "dependency_score", "NULL"),
        _floor("history", "role = 'source' AND co_change_score >= 0.5 AND (dependency_score IS NOT NULL OR lexical_score IS NOT NULL)", AUX, f"CASE WHEN regexp_matches(path, '{_ends(floors.ENTRY_ENDS)}') THEN 0 ELSE 1 END", "co_change_score", "NULL"),
        _floor("config", "role = 'config' AND lexical_score >= 0.3", "0", "0", "lexical_score", "lexical_rank"),
        _floor("script", f"regexp_matches({LOW}, '{floors.SCRIPT}') AND lexical_score >= 0.3", f"CASE WHEN regexp_matches({LOW}, '{floors.SCRIPT_LATER}') THEN 1 WHEN regexp_matches({LOW}, '{floors.SCRIPT_FIRST}') THEN 0 ELSE 2 END", "0", "lexical_score", "lexical_rank"),
        _floor("readme", f"role = 'docs' AND regexp_matches({LOW}, '{floors.README}')", f"CASE WHEN regexp_matches(path, '{floors.README_FIRST}') THEN 0 ELSE 1 END", "0", "coalesce(lexical_score, 0)", "NULL"),
    ])
    + ") SELECT search_id, repo_id, floor, place, path FROM fl WHERE place <= most"
)
PRIORITY = "CASE " + " ".join(f"WHEN x = '{k}' THEN {v}" for k, v in floors.READ_ORDER.items()) + " END"
MANAGER = "CASE coalesce(n.r, 0) " + " ".join(f"WHEN {i} THEN '{m}'" for i, (_, m) in enumerate(commands.MANAGERS)) + " END"
LOCK_RANK = "CASE regexp_extract(path, '([^/]+)$', 1) " + " ".join(f"WHEN '{n}' THEN {i}" for i, (n, _) in enumerate(commands.MANAGERS)) + " END"
DIR = "regexp_replace(path, '/?[^/]*$', '')"
FAMILY = (
    "CASE WHEN broad >= 2 THEN 'broad_scope' WHEN info < 2 THEN 'low_information' WHEN named THEN 'explicit_path' WHEN regexp_matches(lower(query_text), 'ERRORS') THEN 'stack_or_error' WHEN regexp_matches(query_text, 'IDENT') THEN 'symbol_identifier' WHEN regexp_matches(lower(query_text), 'COMMIT') THEN 'commit_clue' ELSE 'domain_phrase' END"
).replace("ERRORS", K.ERRORS).replace("IDENT", K.IDENTIFIER).replace("COMMIT", K.COMMIT)
INFO = (
    "list_sum(list_transform(list_filter(string_split_regex(query_text, '[^A-Za-z0-9_]+'), lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$') AND WEIGHT > 0), lambda x: CASE WHEN regexp_matches(x, '[a-z][A-Z]|_|[A-Za-z][0-9]') THEN 2 ELSE 1 END))"
).replace("WEIGHT", f"({T.weight_sql('lower(x)')})")
NAMED = r"len(list_filter(string_split_regex(query_text, '\s+'), lambda p: contains(p, '/') AND regexp_matches(lower(p), 'KNOWN'))) > 0".replace("KNOWN", "(?:" + "|".join(x.replace(".", r"\.") for x in P.NAMED_EXTENSIONS) + r")\W*$")
ROOT_OK = f"{ROOT} NOT IN ({_values(OTHER_ROOTS)}) AND ({P.role_sql('path')}) = 'source'"
PRE = " + ".join(f"CASE WHEN contains({LOW}, '{t}') THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END" for t in PREFILTER_TERMS)
PARTS = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(NAME, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
NAME = r"regexp_extract(path, '([^/.]+)[^/]*$', 1)"

BARE = r"regexp_replace(target_path, '\.[^./]+$', '')"
CANDS = {
    "('javascript', 'typescript')": [f"{BARE} || '{e}'" for e in ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")], "('python')": [f"{BARE} || '{e}'" for e in (".py", "/__init__.py")],
    "('rust')": [f"{BARE} || '.rs'", f"{BARE} || '/mod.rs'", f"regexp_replace({BARE}, '/[^/]*$', '') || '.rs'"], "('java')": [f"{BARE} || '.java'", f"{BARE} || '.kt'"],
}
RAW = f"CASE WHEN lang IN ('javascript', 'typescript') THEN CASE WHEN contains(source_path, '/') THEN repeat('../', len(string_split(source_path, '/')) - 1) ELSE './' END || {BARE} WHEN lang IN ('python', 'java') THEN replace({BARE}, '/', '.') WHEN lang = 'rust' THEN 'crate::' || replace({BARE}, '/', '::') END"
RESOLVED_SQL = (
    f"im0 AS (SELECT DISTINCT repo_id, source_path, target_path, {P.language_sql('source_path')} AS lang FROM edges_ WHERE kind = 'import'), im AS (SELECT *, {RAW} AS raw, CASE "
    + " ".join(f"WHEN lang IN {k} THEN [{', '.join(v)}]" for k, v in CANDS.items())
    + " END AS cands FROM im0 WHERE lang IN ('javascript', 'typescript', 'python', 'rust', 'java')), ic AS (SELECT DISTINCT repo_id, source_path, raw, unnest(list_transform(cands, lambda c, i: {'pos': i - 1, 'cand': c})) AS c FROM im),"
    " rf AS (SELECT repo_id, path FROM files_ WHERE role IN ('source', 'test')),"
    " hit AS (SELECT ic.repo_id, source_path, raw, c.pos AS pos, CASE WHEN rf.path = c.cand THEN 0 ELSE 1 END AS how, rf.path AS path FROM ic JOIN rf ON rf.repo_id = ic.repo_id AND (rf.path = c.cand OR ends_with(rf.path, '/' || c.cand))),"
    " rs AS (SELECT repo_id, source_path, raw, arg_min(path, {'p': pos, 'h': how, 't': path}) AS target_path, min({'p': pos, 'h': how}).p::BIGINT AS candidate FROM hit GROUP BY 1, 2, 3), res AS (SELECT * FROM rs WHERE source_path <> target_path)"
)
TEST_TERMS = PARTS.replace("NAME", "regexp_extract(path, '([^/.]+)[^/]*$', 1)")
ANCHOR_TESTS_SQL = W + f""", a0 AS (SELECT DISTINCT repo_id, {NORMAL.format('anchor_path')} AS path FROM co_change WHERE anchor_path IS NOT NULL), a1 AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) - 1 AS ord FROM a0 WHERE path <> ''),
sk AS (SELECT repo_id, lower(path) AS path, {P.stem_sql('path')} AS stem, regexp_replace(lower(path), '/?[^/]*$', '') AS dir, list_distinct(list_filter({TEST_TERMS}, lambda x: length(x) >= 3)) AS terms, greatest(5 - ord, 0) AS bonus FROM a1),
sm AS (SELECT *, regexp_replace(dir, '^[^/]+/?', '') AS rest FROM sk), tt AS (SELECT f.repo_id, f.path AS test_path, regexp_extract(lower(f.path), '([^/]+)$', 1) AS name, '/' || regexp_replace(lower(f.path), '/?[^/]*$', '') || '/' AS dir, lower(coalesce(r.content, '')) AS body FROM safe_ f LEFT JOIN reads_ r USING (repo_id, path) WHERE f.role = 'test'),
st AS (SELECT tt.repo_id, test_path, sum(CASE WHEN length(stem) >= 3 AND contains(name, stem) THEN 16.0::DOUBLE + bonus ELSE 0 END + CASE WHEN sm.dir <> '' AND contains(tt.dir, '/' || sm.dir || '/') THEN 4.0::DOUBLE ELSE 0 END
 + CASE WHEN rest <> '' AND ({' OR '.join(f"contains(tt.dir, '/{x}/' || rest || '/')" for x in graph.TEST_ROOTS)}) THEN 7.0::DOUBLE + bonus ELSE 0 END + CASE WHEN list_contains(list_transform(regexp_extract_all(body, '([a-z0-9_./-]*[a-z0-9_])', 1), lambda x: regexp_replace(x, '^(?:\\.{{0,2}}/)+', '')), sm.path) THEN 8.0::DOUBLE ELSE 0 END) AS tied FROM tt JOIN sm ON sm.repo_id = tt.repo_id GROUP BY 1, 2),
tm AS (SELECT DISTINCT repo_id, unnest(terms) AS w FROM sk), wd AS (SELECT repo_id, test_path, w, count(*) AS n FROM (SELECT repo_id, test_path, unnest(string_split_regex(body, '[^a-z0-9]+')) AS w FROM tt) WHERE length(w) >= 3 GROUP BY 1, 2, 3),
tl AS (SELECT wd.repo_id, test_path, sum(1.5::DOUBLE + least(n, 5)) AS terms FROM wd JOIN tm ON tm.repo_id = wd.repo_id AND tm.w = wd.w GROUP BY 1, 2),
z AS (SELECT tt.repo_id, tt.test_path, round(CASE WHEN coalesce(tied, 0) = 0 THEN CASE WHEN terms IS NOT NULL THEN least(terms, 6.0::DOUBLE) END ELSE tied + coalesce(terms, 0.0) END, 6)::DOUBLE AS score FROM tt LEFT JOIN st USING (repo_id, test_path) LEFT JOIN tl USING (repo_id, test_path))
SELECT repo_id, test_path, score, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, test_path) AS place FROM z WHERE score IS NOT NULL) WHERE place <= 10"""

SQL = {
    "resolved_imports": W + ", " + RESOLVED_SQL + " SELECT repo_id, source_path, raw, target_path, candidate FROM res",
    "dependency_edges": W + ", " + RESOLVED_SQL + """, al AS (SELECT repo_id, source_path, target_path, 'import' AS kind, 0 AS src, NULL::TIMESTAMP AS at_, 0.9::DOUBLE AS confidence FROM res UNION ALL SELECT repo_id, source_path, target_path, kind, 1, ingested_at, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END FROM edges WHERE source_path IS NOT NULL AND target_path IS NOT NULL AND source_path <> target_path),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, source_path, target_path, kind ORDER BY src, at_ NULLS LAST, confidence DESC NULLS LAST) AS r FROM al) WHERE r = 1) SELECT repo_id, kind, count(*) AS edges, count(*) FILTER (src = 0) AS resolved, round(sum(confidence), 4) AS confidence FROM fr GROUP BY 1, 2""",
    "anchor_tests": ANCHOR_TESTS_SQL,
    "floor_lists": FLOOR_SQL,
    "next_reads": PLAN_SQL + f""", j AS (SELECT c.*, p.path IS NOT NULL AS picked FROM cand c LEFT JOIN plan p USING (search_id, repo_id, path)),
lf AS (SELECT search_id, repo_id, area, count(*) FILTER (role IN ('source','config','schema') AND NOT picked) AS s, count(*) FILTER (role = 'test' AND NOT picked) AS t FROM j GROUP BY 1, 2, 3),
n AS (SELECT search_id, repo_id, area, path, row_number() OVER (PARTITION BY search_id, repo_id, area ORDER BY CASE WHEN role IN ('source','config','schema') THEN 0 WHEN role = 'test' THEN 1 WHEN role = 'docs' THEN 2 ELSE 3 END,
 list_min(list_transform(string_split(signals, ','), lambda x: {PRIORITY})), greatest(lexical_score, dependency_score, co_change_score) DESC NULLS LAST, greatest(0.15, least(0.98, rank_score)) DESC, path) AS place FROM j WHERE NOT picked),
m AS (SELECT n.*, CASE WHEN s >= 12 OR t >= 8 THEN 8 WHEN s >= 6 OR t >= 4 THEN 6 ELSE 4 END AS "limit" FROM n JOIN lf USING (search_id, repo_id, area)) SELECT search_id, repo_id, area, path, place, "limit"::BIGINT AS "limit" FROM m WHERE place <= "limit" """,
    "plan_tests": f"WITH {HITS_SQL}, p AS (SELECT *, CASE WHEN co_change_score IS NULL THEN 1 ELSE 0 END AS pass FROM cand WHERE role = 'test') SELECT search_id, repo_id, path, pass::BIGINT AS pass, slot FROM (SELECT *, row_number() OVER (PARTITION BY search_id, repo_id ORDER BY pass, rank_score DESC, path) AS slot FROM p) WHERE slot <= 10",
    "test_commands": W + f""", lk AS (SELECT repo_id, {DIR} AS dir, min({LOCK_RANK}) AS r, bool_or(regexp_extract(path, '([^/]+)$', 1) = 'package.json') AS p FROM files_ GROUP BY 1, 2),
pk AS (SELECT repo_id, dir, coalesce(r, 0) AS r FROM lk WHERE p), ts AS (SELECT repo_id, path FROM files_ WHERE role = 'test'),
nr AS (SELECT ts.repo_id, ts.path, arg_max(pk.r, length(pk.dir)) AS r FROM ts JOIN pk ON pk.repo_id = ts.repo_id AND (pk.dir = '' OR starts_with(ts.path, pk.dir || '/')) GROUP BY 1, 2),
bd AS (SELECT repo_id, min(CASE WHEN path = 'pom.xml' THEN 1 ELSE 0 END) AS b FROM files_ WHERE path IN ({_values([n for n, _ in commands.JVM_BUILDS])}) GROUP BY 1)
SELECT t.repo_id, t.path, CASE WHEN lower(t.path) LIKE '%.rs' THEN CASE WHEN regexp_matches(t.path, '^tests/[^/]+\\.rs$') THEN 'cargo test --test ' || regexp_extract(t.path, '^tests/([^/]+)\\.rs$', 1) ELSE 'cargo test' END WHEN lower(t.path) LIKE '%.go' THEN 'go test ./' || {DIR.replace('path', 't.path')}
 WHEN lower(t.path) LIKE '%.py' THEN 'pytest ' || t.path WHEN regexp_matches(lower(t.path), '\\.(?:ts|tsx|js|jsx)$') THEN {MANAGER} || ' test ' || t.path
 WHEN lower(t.path) LIKE '%.java' AND b = 0 THEN './gradlew test --tests ' || CASE WHEN regexp_matches(t.path, '^src/test/java/.+\\.java$') THEN replace(regexp_extract(t.path, '^src/test/java/(.+)\\.java$', 1), '/', '.') ELSE regexp_extract(t.path, '([^/]+)\\.java$', 1) END
 WHEN lower(t.path) LIKE '%.java' AND b = 1 THEN 'mvn -Dtest=' || regexp_extract(t.path, '([^/]+)\\.java$', 1) || ' test' WHEN lower(t.path) LIKE '%.java' THEN 'java test ' || t.path END AS command, 1.0::DOUBLE AS confidence
FROM ts t LEFT JOIN nr n ON n.repo_id = t.repo_id AND n.path = t.path LEFT JOIN bd ON bd.repo_id = t.repo_id""",
    "task_families": f"WITH {SEARCHES}, f AS (SELECT *, len(list_intersect({T.words_sql('query_text')}, [{_values(K.BROAD)}])) AS broad, coalesce({INFO}, 0) AS info, {NAMED} AS named FROM sq) SELECT search_id, repo_id, broad >= 2 AS multi_area, {FAMILY} AS family FROM f",
    "broad_validation": f"WITH {HIT_ROWS}, {SEARCHES}, t AS (SELECT search_id, repo_id, count(DISTINCT {ROOT}) AS areas, count(*) AS tests FROM hits WHERE ({P.role_sql('path')}) = 'test' GROUP BY 1, 2), j AS (SELECT search_id, repo_id, len(list_intersect({T.words_sql('query_text')}, [{_values(K.VALIDATING)}]))::BIGINT AS words, coalesce(areas, 0) AS areas, coalesce(tests, 0) AS tests FROM sq LEFT JOIN t USING (search_id, repo_id)) SELECT *, areas >= 3 AND (tests >= 10 OR words >= 2) AS broad FROM j",
    "source_roots": f"WITH {HIT_ROWS}, {FILES_SQL}, h AS (SELECT DISTINCT search_id, repo_id, {ROOT} AS root FROM hits WHERE {ROOT_OK}), n AS (SELECT repo_id, {ROOT} AS root, count(*) AS n FROM files_ WHERE {ROOT_OK} GROUP BY 1, 2), mo AS (SELECT repo_id, arg_min(root, {{'n': -n, 'r': root}}) AS root FROM n GROUP BY 1), al AS (SELECT DISTINCT search_id, repo_id FROM search_runs)"
    " SELECT search_id, repo_id, root, 'hits' AS \"from\" FROM h UNION ALL SELECT al.search_id, al.repo_id, mo.root, 'mode' FROM al JOIN mo ON mo.repo_id = al.repo_id WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.search_id = al.search_id AND h.repo_id = al.repo_id)",
    "expansion_seeds": f"WITH {HITS_SQL}, {SEEDS}, ee AS (SELECT DISTINCT repo_id, source_path, target_path FROM e), a AS (SELECT search_id, repo_id, path, rank AS ord FROM hits WHERE rank <= 3 UNION ALL SELECT search_id, sd.repo_id, path, rank + 100 FROM sd JOIN hint ON hint.repo_id = sd.repo_id AND hint.seed = sd.seed WHERE path IS NOT NULL AND path <> ''"
    " UNION ALL SELECT search_id, sd.repo_id, target_path, rank + 200 FROM sd JOIN ee ON ee.repo_id = sd.repo_id AND source_path = seed UNION ALL SELECT search_id, sd.repo_id, source_path, rank + 200 FROM sd JOIN ee ON ee.repo_id = sd.repo_id AND target_path = seed),"
    f" m AS (SELECT search_id, repo_id, path, min(ord) AS ord FROM a WHERE ({P.role_sql('path')}) IN ('source', 'unknown') GROUP BY 1, 2, 3) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search_id, repo_id ORDER BY ord, path) AS place FROM m) WHERE place <= 40",
    "commit_candidates": f"WITH c AS (SELECT repo_id, revision, {NORMAL.format('anchor_path')} AS anchor, {NORMAL.format('path')} AS path, max(commit_count) AS k FROM co_change WHERE path IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT repo_id, revision, anchor, sum(k)::BIGINT AS commits, round(greatest(0.1::DOUBLE, least(0.95::DOUBLE, sum(k) / 5.0::DOUBLE)), 6) AS score, round(greatest(0.1::DOUBLE, least(0.95::DOUBLE, sum(k) / 5.0::DOUBLE)) * 0.65::DOUBLE, 6) AS weighted FROM c WHERE path <> '' GROUP BY 1, 2, 3",
    "edge_profile": f"WITH {HIT_ROWS}, {SEEDS}, {EDGE_KIND}, n AS (SELECT DISTINCT search_id, sd.repo_id, target_path AS path, kind FROM sd JOIN ek ON ek.repo_id = sd.repo_id AND source_path = seed) SELECT kind, count(*) AS candidates, count(h.path) AS selected, count(DISTINCT CASE WHEN h.path IS NOT NULL THEN n.search_id END) AS searches FROM n LEFT JOIN (SELECT * FROM hits WHERE rank <= 10) h ON h.search_id = n.search_id AND h.repo_id = n.repo_id AND h.path = n.path GROUP BY 1",
    "retrieval_targets": W + ", o AS (SELECT *, coalesce(min(at_) OVER (PARTITION BY repo_id, revision, path) < at_, false) AS old FROM commit_files) SELECT repo_id, revision, count(DISTINCT sha) AS commits, count(*) FILTER (old) AS targets, count(*) FILTER (NOT old) AS new_files FROM o GROUP BY 1, 2",
    "commit_replay": W + f""", tt AS (SELECT repo_id, revision, sha, max(title) AS title FROM commits WHERE title IS NOT NULL GROUP BY 1, 2, 3), tw AS (SELECT DISTINCT repo_id, revision, sha, w FROM (SELECT repo_id, revision, sha, unnest({T.words_sql('title')}) AS w FROM tt) WHERE length(w) >= 4),
kp AS (SELECT DISTINCT repo_id, revision, path FROM commit_files), kw AS (SELECT DISTINCT repo_id, revision, path, w FROM (SELECT repo_id, revision, path, unnest({PARTS.replace('NAME', NAME)}) AS w FROM kp)),
sc AS (SELECT tw.repo_id, tw.revision, sha, path, count(*) AS n FROM tw JOIN kw ON kw.repo_id = tw.repo_id AND kw.revision = tw.revision AND kw.w = tw.w GROUP BY 1, 2, 3, 4), tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, revision, sha ORDER BY n DESC, path) AS rank FROM sc) WHERE rank <= 10),
pc AS (SELECT c.repo_id, c.revision, c.sha, count(*) AS t, count(rank) AS h, min(rank) AS f FROM (SELECT DISTINCT repo_id, revision, sha, path FROM commit_files) c LEFT JOIN tp USING (repo_id, revision, sha, path) GROUP BY 1, 2, 3)
SELECT repo_id, count(*) AS commits, round(avg(h / t::DOUBLE), 6) AS recall_10, round(avg(coalesce(1.0::DOUBLE / f, 0.0)), 6) AS mrr_10 FROM pc GROUP BY 1""",
    "exact_primary": f"WITH {SEARCHES}, l AS (SELECT search_id, repo_id, greatest(1, max(coalesce(result_limit, 10)))::BIGINT AS n FROM search_runs GROUP BY 1, 2), x AS (SELECT search_id, repo_id, count(DISTINCT path) AS exact FROM search_results WHERE score >= 5 AND NOT isnan(score) AND path IS NOT NULL GROUP BY 1, 2),"
    f" j AS (SELECT search_id, repo_id, coalesce(exact, 0) AS exact, n, list_filter({T.words_sql('query_text')}, lambda w: ({T.weight_sql('w')}) > 0) AS w FROM l LEFT JOIN sq USING (search_id, repo_id) LEFT JOIN x USING (search_id, repo_id)) SELECT search_id, repo_id, exact, n, exact >= n OR exact >= least(n, 5) OR (exact > 0 AND len(w) = 1 AND length(w[1]) >= 8) AS \"primary\" FROM j",
    "file_prefilter": W + f"SELECT * FROM (SELECT repo_id, path, role, round({PRE} + CASE WHEN language IN ({_values(PREFILTER_TERMS)}) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN role IN ({_values(PREFILTER_TERMS)}) THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM safe_) WHERE score > 0 ORDER BY score DESC, path, repo_id LIMIT 128",
    "neighborhood": W + f""", dg AS (SELECT repo_id, source_path AS path, count(*) AS n FROM edges_ GROUP BY 1, 2), an AS (SELECT repo_id, arg_min(path, {{'n': -n, 'p': path}}) AS path FROM dg GROUP BY 1),
nb AS (SELECT a.repo_id, e.target_path AS path, e.confidence, 0 AS d FROM an a JOIN edges_ e ON e.repo_id = a.repo_id AND e.source_path = a.path UNION ALL SELECT a.repo_id, e.source_path, e.confidence, 1 FROM an a JOIN edges_ e ON e.repo_id = a.repo_id AND e.target_path = a.path),
g AS (SELECT repo_id, path, max(confidence) AS confidence, min(d)::BIGINT AS direction FROM nb GROUP BY 1, 2) SELECT repo_id, path, {P.role_sql('path')} AS role, direction, round(confidence, 6) AS confidence, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY confidence DESC, direction, path) AS place FROM g) WHERE place <= 8""",
    "anchored_targets": W + f", a AS (SELECT DISTINCT repo_id, {NORMAL.format('anchor_path')} AS path FROM co_change WHERE anchor_path IS NOT NULL) SELECT a.repo_id, a.path, coalesce(f.role, 'source') AS role, f.role IS NOT NULL AS available FROM a LEFT JOIN files_ f USING (repo_id, path) WHERE a.path <> ''",
    "signal_support": PLAN_SQL + ", x AS (SELECT search_id, repo_id, unnest(string_split(signals, ',')) AS signal FROM plan) SELECT signal, count(DISTINCT repo_id) AS repositories, count(DISTINCT search_id) AS searches, count(*) AS targets, count(DISTINCT repo_id) >= 2 AS supported FROM x GROUP BY 1",
}
QUERIES = {
    f.__name__: f
    for f in (
        floor_lists, next_reads, plan_tests, test_commands, task_families, broad_validation, source_roots, expansion_seeds, commit_candidates, edge_profile, retrieval_targets, commit_replay, exact_primary, file_prefilter, neighborhood, anchored_targets, signal_support, resolved_imports, dependency_edges, anchor_tests,
    )
}
