"""The dependency graph: edges of anchors, two-hop re-exports, import resolution, neighbourhood, communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ascii_lower, stem
from ..functions.text import parts
from .ranks import first_rows


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct repo_id, source_path, target_path, kind with the highest confidence in 0-1; self edges dropped."""
    c = F.when(F.isnan("confidence"), None).otherwise(F.col("confidence"))
    rows = edges.filter("source_path is not null and target_path is not null and source_path <> target_path")
    return rows.groupBy("repo_id", "source_path", "target_path", "kind").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.max(c), F.lit(0.0)))).alias("confidence"))


def imported(edges: DataFrame, safe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose two ends are both safe files, and those rejected."""
    s, t = safe.select("repo_id", F.col("path").alias("source_path")), safe.select("repo_id", F.col("path").alias("target_path"))
    good = edges.join(s, ["repo_id", "source_path"], "left_semi").join(t, ["repo_id", "target_path"], "left_semi")
    bad = edges.join(s, ["repo_id", "source_path"], "left_anti").unionByName(edges.join(s, ["repo_id", "source_path"], "left_semi").join(t, ["repo_id", "target_path"], "left_anti"))
    return good, bad


def related_edges(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges with an anchor at either end: two equi-joins and their distinct union, with the direction.

    anchors: repo_id, path, ord. direction: 0 if the source is an anchor, 1 if the target alone is.
    """
    out_ = edges.join(anchors.select("repo_id", F.col("path").alias("source_path"), F.col("ord").alias("_o")), ["repo_id", "source_path"]).withColumn("_d", F.lit(0))
    in_ = edges.join(anchors.select("repo_id", F.col("path").alias("target_path"), F.col("ord").alias("_o")), ["repo_id", "target_path"]).withColumn("_d", F.lit(1)).select(out_.columns)
    keys = ["repo_id", "source_path", "target_path", "kind", "confidence"]
    return out_.unionByName(in_).groupBy(*keys).agg(F.min("_d").alias("direction"), F.min("_o").alias("anchor_ord"))


def stem_tokens(path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(?:\.[^/]*)?$", 1), "([a-z])([A-Z])", "$1_$2")), "[^a-z0-9]+"), lambda x: x != ""))


def ranked_edges(edges: DataFrame, limit: int) -> DataFrame:
    """Per repository by direction, anchor order, shared stem words and confidence."""
    shared = F.size(F.array_intersect(stem_tokens(F.col("source_path")), stem_tokens(F.col("target_path"))))
    w = Window.partitionBy("repo_id").orderBy("direction", "anchor_ord", F.desc("shared"), F.desc("confidence"), "source_path", "target_path", "kind")
    return edges.withColumn("shared", shared).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def two_hops(edges: DataFrame, through: Column, decay: float = 0.85, second: Column | None = None) -> DataFrame:
    """Edges a -> c over b where ``through`` holds for b (``_via``): confidence c1 * c2 * decay, the highest per pair.

    ``second``: which edges may lead on, such as re-exports alone; that keeps hubs that merely import from multiplying.
    """
    on = edges if second is None else edges.filter(second)
    a = edges.select("repo_id", "source_path", F.col("target_path").alias("_via"), F.col("confidence").alias("_c1"))
    b = on.select(F.col("repo_id").alias("_r"), F.col("source_path").alias("_b"), F.col("target_path"), F.col("confidence").alias("_c2"))
    rows = a.filter(through).join(b, (F.col("repo_id") == F.col("_r")) & (F.col("_via") == F.col("_b"))).filter("source_path <> target_path")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_c1") * F.col("_c2") * decay))
    return rows.groupBy("repo_id", "source_path", "target_path").agg(F.round(F.max(conf), 6).alias("confidence"), F.countDistinct("_via").alias("ways"))


def resolved_imports(imports: DataFrame, files: DataFrame, candidates: Column) -> DataFrame:
    """The first candidate path of each import that the repository holds: exact, else as the end of a path.

    ``candidates`` is an ordered array of paths. Suffix matches use precomputed ends of paths, so both are equi-joins.
    """
    keys = ["repo_id", "source_path", "raw"]
    rows = imports.select(*keys, F.posexplode(candidates).alias("pos", "cand"))
    exact = rows.join(files.select("repo_id", F.col("path").alias("cand")), ["repo_id", "cand"]).select(*keys, "pos", F.lit(0).alias("how"), F.col("cand").alias("target_path"))
    parts = F.split("path", "/")
    ends = files.select("repo_id", "path", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("cand")).filter(F.instr("path", "/") > 0)
    suffix = rows.join(ends, ["repo_id", "cand"]).select(*keys, "pos", F.lit(1).alias("how"), F.col("path").alias("target_path"))
    best = exact.unionByName(suffix).groupBy(*keys).agg(F.min_by("target_path", F.struct("pos", "how", "target_path")).alias("target_path"), F.min(F.struct("pos", "how")).alias("_m"))
    return best.filter("source_path <> target_path").select(*keys, "target_path", F.col("_m.pos").cast("bigint").alias("candidate"))


def nodes(edges: DataFrame) -> DataFrame:
    """repo_id, path, highest edge weight, out- and in-degree."""
    ends = edges.select("repo_id", F.inline(F.array(F.struct(F.col("source_path").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_path").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))), "confidence")
    return ends.groupBy("repo_id", "path").agg(F.max("confidence").alias("weight"), F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def communities(edges: DataFrame) -> DataFrame:
    """Nodes and inner edges by the top part of the path."""
    top = lambda c: F.when(F.instr(c, "/") > 0, F.substring_index(c, "/", 1)).otherwise(".")
    n = nodes(edges).groupBy("repo_id", top("path").alias("community")).agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.filter(top("source_path") == top("target_path")).groupBy("repo_id", top("source_path").alias("community")).agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e, ["repo_id", "community"], "left").select("repo_id", "community", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def test_links(files: DataFrame) -> DataFrame:
    """Tests that belong to a source by stem, same directory or mirrored directory, with a score, in one repository.

    Stems are the join key, so no test meets every source.
    """
    f = files.select("repo_id", "path", "role", stem(F.col("path")).alias("stem"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"))
    mirror = F.concat(F.lit("/"), F.col("dir"), F.lit("/"))
    for part in ("/(?:tests?|spec)/", "/(?:src|main)/", "/(?:src|main)/"):
        mirror = F.regexp_replace(mirror, part, "/")
    mirror = F.regexp_replace(mirror, "^/+|/+$", "")
    f = f.withColumn("mirror", mirror).filter(F.length("stem") >= 3)
    s = f.filter("role = 'source'").select("repo_id", F.col("path").alias("source_path"), "stem", F.col("dir").alias("sdir"), F.col("mirror").alias("smirror"))
    t = f.filter("role = 'test'").select("repo_id", F.col("path").alias("test_path"), "stem", F.col("dir").alias("tdir"), F.col("mirror").alias("tmirror"))
    score = 0.55 + F.when(F.col("sdir") == F.col("tdir"), 0.25).otherwise(0.0) + F.when((F.col("sdir") != F.col("tdir")) & (F.col("smirror") == F.col("tmirror")), 0.2).otherwise(0.0)
    return s.join(t, ["repo_id", "stem"]).select("repo_id", "source_path", "test_path", F.round(F.least(F.lit(0.95), score), 6).alias("confidence"))


def deduplicated(edges: DataFrame, order: list) -> DataFrame:
    """Edges of several sources as one list: no self edges, of each source, target and kind the first by ``order``."""
    rows = edges.filter("source_path is not null and target_path is not null and source_path <> target_path")
    return first_rows(rows, ["repo_id", "source_path", "target_path", "kind"], order, 1, "_first").drop("_first")


#: Scores of a test for a source: its name holds the stem, it lies in the directory or in a mirrored one, its text has the path; a term of the name, and what the terms alone may give.
NAMED, SHARED_DIR, MIRRORED, MENTIONED, TERM, TERMS_ALONE = 16.0, 4.0, 7.0, 8.0, 1.5, 6.0
#: Where tests of a source directory lie: instead of its first part.
TEST_ROOTS = ("tests", "test", "spec", "__tests__")


def source_keys(anchors: DataFrame) -> DataFrame:
    """repo_id, path (lower case), stem, dir, mirrors, terms and priority bonus of the sources whose tests are wanted.

    anchors: repo_id, path, ord (from 0).
    """
    low = ascii_lower(F.col("path"))
    folder = F.regexp_replace(low, "/?[^/]*$", "")
    rest = F.regexp_replace(folder, "^[^/]+/?", "")
    mirrors = F.when(rest != "", F.transform(F.array(*[F.lit(x) for x in TEST_ROOTS]), lambda x: F.concat(x, F.lit("/"), rest))).otherwise(F.array().cast("array<string>"))
    terms = F.array_distinct(F.filter(parts(F.regexp_extract("path", r"([^/.]+)[^/]*$", 1)), lambda x: F.length(x) >= 3))
    return anchors.select("repo_id", low.alias("path"), stem(F.col("path")).alias("stem"), folder.alias("dir"), mirrors.alias("mirrors"), terms.alias("terms"), F.greatest(F.lit(5) - F.col("ord"), F.lit(0)).alias("bonus"))


def scored_tests(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """repo_id, test_path, score of every test that anything ties to a source; terms of several sources count once.

    sources: rows of ``source_keys``; tests: repo_id, path, content. Containment is met by equality: a test's name gives its
    substrings, its path its runs of folders, its text its words and the paths it names, each once a test.
    """
    low, name = ascii_lower(F.col("path")), ascii_lower(F.regexp_extract("path", "([^/]+)$", 1))
    subs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_name") - 2)), lambda i: F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length("_name") - i + 1)), lambda n: F.substring(F.col("_name"), i, n)))))
    folders = F.split(F.regexp_replace("_low", "/?[^/]*$", ""), "/")
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(folders)), lambda i: F.transform(F.sequence(F.lit(1), F.size(folders) - i + 1), lambda n: F.array_join(F.slice(folders, i, n), "/")))))
    t = tests.select("repo_id", F.col("path").alias("test_path"), low.alias("_low"), name.alias("_name"), ascii_lower(F.coalesce("content", F.lit(""))).alias("_text"))
    key = ["repo_id", "test_path"]

    def met(values: Column, source: DataFrame, worth: Column) -> DataFrame:
        return t.select(*key, F.explode(values).alias("_v")).join(source, ["repo_id", "_v"]).select(*key, worth.alias("score"))

    bonus = F.col("bonus")
    by = lambda c: sources.filter(F.col(c) != "").select("repo_id", F.col(c).alias("_v"), "bonus")
    named = met(subs, by("stem").filter(F.length("_v") >= 3), NAMED + bonus)
    shared = met(runs, by("dir"), F.lit(SHARED_DIR))
    # of a source's mirrored directories one counts
    mirrored = t.select(*key, F.explode(runs).alias("_v")).join(sources.select("repo_id", "path", "bonus", F.explode("mirrors").alias("_v")), ["repo_id", "_v"]).groupBy(*key, "path").agg(F.max("bonus").alias("bonus"))
    mirrored = mirrored.select(*key, (MIRRORED + bonus).alias("score"))
    mentioned = met(F.array_distinct(F.transform(F.regexp_extract_all("_text", F.lit(r"([a-z0-9_./-]*[a-z0-9_])"), F.lit(1)), lambda x: F.regexp_replace(x, r"^(?:\.{0,2}/)+", ""))), by("path"), F.lit(MENTIONED))
    words = t.select(*key, F.explode(F.filter(F.split("_text", "[^a-z0-9]+"), lambda w: F.length(w) >= 3)).alias("_v")).groupBy(*key, "_v").agg(F.count(F.lit(1)).alias("n"))
    terms = sources.select("repo_id", F.explode("terms").alias("_v")).distinct()
    told = words.join(terms, ["repo_id", "_v"]).groupBy(*key).agg(F.sum(TERM + F.least("n", F.lit(5))).alias("terms"))
    tied = named.unionByName(shared).unionByName(mirrored).unionByName(mentioned).groupBy(*key).agg(F.sum("score").alias("tied"))
    both = tied.join(told, key, "full_outer")
    score = F.when(F.col("tied").isNull(), F.least(F.col("terms"), F.lit(TERMS_ALONE))).otherwise(F.col("tied") + F.coalesce("terms", F.lit(0.0)))
    return both.select(*key, F.round(score, 6).alias("score"))
