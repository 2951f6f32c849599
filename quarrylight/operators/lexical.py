"""Lexical search over texts: exact term scores, BM25 over several fields, and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.paths import ascii_lower, explicit_paths

# What a role adds, what an archive leaves, and the fields' boosts.
ROLE_BONUS = {"source": 1.0, "test": 0.7, "config": 0.4, "schema": 0.4, "docs": 0.4}
ARCHIVE = 0.35
BOOSTS = {"path": 3.5, "file_name": 4.0, "symbols": 6.0, "content": 1.0, "role": 0.4, "language": 0.3}
ARCHIVED = r"^\.planning/milestones/|^\.planning/e2e/.*\.json$"


def query_terms(spark: SparkSession, query: str) -> DataFrame:
    """The query's weighted terms (repeated ones counted), a table as long as the query."""
    q = spark.range(1).select(F.lit(query).alias("q"))
    terms = q.select(F.explode(F.concat(T.words(F.col("q")), T.aliases(F.col("q")))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("times")).withColumn("weight", T.weight(F.col("term"))).filter("weight > 0")


def role_bonus(role: Column) -> Column:
    out = F.lit(0.0)
    for k, v in ROLE_BONUS.items():
        out = F.when(role == k, v).otherwise(out)
    return out


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def exact_scores(docs: DataFrame, terms: list[tuple[str, float]], explicit: list[str] = ()) -> DataFrame:
    """``docs`` (path, role, content and more) with ``score``, rows above 0 only.

    The terms of one query are a short list: they are folded over inside one expression, so that a scan of the texts is
    all that runs, without explosion or shuffle.
    """
    low = F.struct(ascii_lower(F.col("path")).alias("p"), F.regexp_extract(ascii_lower(F.col("path")), r"([^/]+)$", 1).alias("f"), ascii_lower(F.coalesce(F.col("content"), F.lit(""))).alias("c"))
    asked = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in terms]) if terms else F.expr("cast(array() as array<struct<t:string,w:double>>)")

    def scored(d: Column) -> Column:
        named = d["p"].isin(*explicit) if explicit else F.lit(False)
        part = F.when(named | F.lit(not explicit), 1.0).otherwise(0.25)

        def add(a: Column, x: Column) -> Column:
            def points(h: Column) -> Column:
                hit = F.when(h["p"], 8.0 * part).otherwise(0.0) + F.when(h["f"], 5.0 * part).otherwise(0.0) + F.when(h["n"] > 0, 2.0 + F.least(h["n"], F.lit(10))).otherwise(0.0)
                miss = F.when(~h["p"] & ~h["f"] & (h["n"] == 0), 1.0).otherwise(0.0)
                return F.struct((a["score"] + x["w"] * (hit - miss)).alias("score"), (a["told"] | (h["n"] > 0)).alias("told"))

            return let(F.struct(F.contains(d["p"], x["t"]).alias("p"), F.contains(d["f"], x["t"]).alias("f"), T.occurrences(d["c"], x["t"]).alias("n")), points)

        return F.aggregate(asked, F.struct(F.when(named, 50.0).otherwise(0.0).alias("score"), named.alias("told")), add)

    # a generator works the score out once and drops the row there and then; a filter would be pushed and repeat it
    keep = F.filter(F.transform(F.array(low), scored), lambda x: (x["score"] > 0) & (F.lit(not explicit) | x["told"]))
    rows = docs.select("*", F.inline(F.transform(keep, lambda x: F.struct(x["score"].alias("_score")))))
    total = (F.col("_score") + role_bonus(F.col("role"))) * F.when(ascii_lower(F.col("path")).rlike(ARCHIVED), ARCHIVE).otherwise(1.0)
    return rows.withColumn("score", F.round(total, 6)).drop("_score")


def search(spark: SparkSession, docs: DataFrame, query: str, limit: int = 20, ties: tuple[str, ...] = ("path",)) -> DataFrame:
    """The best documents of one query: score down, then ``ties``."""
    # as many rows as the query has terms
    terms = [(r["term"], r["weight"]) for r in query_terms(spark, query).orderBy("term").collect() for _ in range(r["times"])]
    explicit = spark.range(1).select(explicit_paths(F.lit(query)).alias("p")).first()["p"]
    return exact_scores(docs, terms, explicit).orderBy(F.desc("score"), *ties).limit(max(1, limit))


#: Parts of the kept index; a query reads those of its terms.
INDEX_PARTS = 16


def postings(words: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """key, field, term, tf and the field's length: the inverted index as a table. words: key and a word array per field."""
    rows = words.select(*key, F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("w")) for n in fields])).alias("f"))
    rows = rows.select(*key, F.col("f.field").alias("field"), F.size("f.w").alias("len"), F.explode("f.w").alias("term"))
    return rows.groupBy(*key, "field", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def write_index(docs: DataFrame, key: list[str], fields: dict[str, Column], path: str) -> None:
    """Keep the inverted index of the documents below ``path``: postings by parts of their terms, and sizes of the fields.

    Texts are read and cut into words once; postings and sizes come from the words that were written.
    """
    spark, names = docs.sparkSession, list(fields)
    docs.select(*key, *[T.words(c).alias(n) if n not in key else T.words(c).alias(f"_{n}") for n, c in fields.items()]).write.mode("overwrite").parquet(f"{path}/words")
    words = spark.read.parquet(f"{path}/words").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[F.col(f"_{n}" if n in key else n).alias(n) for n in names])
    part = F.pmod(F.xxhash64("term"), F.lit(INDEX_PARTS)).cast("int")
    rows = postings(words, [f"_k{i}" for i in range(len(key))], names).withColumnsRenamed({f"_k{i}": k for i, k in enumerate(key)})
    rows.withColumn("part", part).sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    sums = words.agg(F.count(F.lit(1)).alias("docs"), *[F.avg(F.size(n)).alias(n) for n in names])
    sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col("docs"), F.col(n).alias("mean_len")) for n in names]))).write.mode("overwrite").parquet(f"{path}/sizes")


def bm25(spark: SparkSession, path: str, key: list[str], terms: DataFrame, boosts: dict[str, float] = BOOSTS, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score by BM25 over a kept index, summed over fields with their boosts; ``terms`` (term, weight) is one query's.

    Only the parts of the query's terms are read, and of them the row groups that can hold a term.
    """
    # as many as the query has terms
    told = {r["term"]: r["weight"] for r in terms.select("term", "weight").collect()}
    rows = spark.read.parquet(f"{path}/postings")
    if not told:
        return rows.limit(0).select(*key, F.lit(0.0).alias("score"))
    parts = F.array_distinct(F.transform(F.array(*[F.lit(t) for t in told]), lambda t: F.pmod(F.xxhash64(t), F.lit(INDEX_PARTS)).cast("int")))
    weights = F.create_map(*[F.lit(x) for kv in told.items() for x in kv])
    some = spark.range(1).select(parts.alias("p")).first()["p"]
    hits = rows.filter(F.col("part").isin(some) & F.col("term").isin(list(told))).drop("part").withColumn("weight", F.element_at(weights, F.col("term")))
    df = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    boost = F.lit(0.0)
    for n, v in boosts.items():
        boost = F.when(F.col("field") == n, v).otherwise(boost)
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    return hits.join(df, ["field", "term"]).join(spark.read.parquet(f"{path}/sizes"), "field").groupBy(*key).agg(F.sum(boost * F.col("weight") * idf * tf).alias("score"))


def hybrid(ranked: DataFrame, exact: DataFrame, key: list[str]) -> DataFrame:
    """key, score, exact: an exact score counts a hundredfold and before any other; exact hits that the ranking lacks come in beside it."""
    a = ranked.select(*key, F.col("score").alias("_bm25"))
    b = exact.select(*key, F.col("score").alias("_exact"))
    told = F.coalesce(F.col("_exact") > 0, F.lit(False))
    return a.join(b, key, "full_outer").select(*key, F.when(told, F.col("_exact") * 100).otherwise(F.col("_bm25")).alias("score"), told.alias("exact"))


def symbol_score(name: Column, path: Column, signature: Column, exported: Column, terms: list[str]) -> Column:
    """24 for the exact name, 16 for its start, 12 within; +4 path, +2 signature, -2 for a miss, +1 if exported."""
    n, p, s = ascii_lower(name), ascii_lower(path), ascii_lower(signature)
    score = F.lit(0.0)
    for term in terms:
        t = F.lit(term)
        hit = F.when(n == t, 24.0).when(F.startswith(n, t), 16.0).when(F.contains(n, t), 12.0).otherwise(0.0)
        more = F.when(F.contains(p, t), 4.0).otherwise(0.0) + F.when(F.contains(s, t), 2.0).otherwise(0.0)
        score = score + hit + more - F.when((hit == 0) & (more == 0), 2.0).otherwise(0.0)
    return F.when(score > 0, score + F.when(F.coalesce(exported, F.lit(False)), 1.0).otherwise(0.0)).otherwise(0.0)
