"""Floor lists of a plan: for every search the best rows of each kind of evidence, with its own order and limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ascii_lower
from .ranks import first_rows

# Roots that hold no product source, archives of plans, ends of module entry points and of scripts.
AUXILIARY = ["bench", "benches", "benchmark", "benchmarks", "demo", "demos", "example", "examples", "notebook", "notebooks", "sample", "samples"]
ENTRY_ENDS = ["/src/lib.rs", "/src/main.rs", "/src/mod.rs", "/__init__.py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
SCRIPT = r"\.(?:sh|bash|zsh)$|(?:^|/)makefile$"
SCRIPT_LATER = "deploy|release|publish|ship"
SCRIPT_FIRST = "bootstrap|start|run|smoke|check|test"
README = r"/readme\.md$"
README_FIRST = "^(?:docs|paper)/"


def first_part(path: Column) -> Column:
    return F.regexp_extract(path, "^/*([^/]+)", 1)


def source_order(path: Column) -> Column:
    """0 for product source, 1 below an auxiliary root."""
    return F.when(first_part(path).isin(*AUXILIARY), 1).otherwise(0)


def entry_order(path: Column) -> Column:
    """0 for the entry point of a module."""
    return F.when(path.rlike("(?:" + "|".join(x.replace(".", r"\.") for x in ENTRY_ENDS) + ")$"), 0).otherwise(1)


def script_order(path: Column) -> Column:
    low = ascii_lower(path)
    return F.when(low.rlike(SCRIPT_LATER), 1).when(low.rlike(SCRIPT_FIRST), 0).otherwise(2)


def readme_order(path: Column) -> Column:
    return F.when(path.rlike(README_FIRST), 0).otherwise(1)


def edge_order(kind: Column) -> Column:
    """The family of an edge's label: precise, imports, others, re-exports."""
    return F.when(kind.startswith("precision"), 0).when(kind.isin("import", "imports"), 1).when(kind.isin("reexport", "python_reexport"), 3).otherwise(2)


def limits(budget: int) -> dict[str, int]:
    """Rows of each floor under a file budget."""
    up = lambda n: -(-budget // n)
    clamp = lambda n, lo, hi: max(lo, min(hi, n))
    return {"lexical": clamp(up(2), 1, 5), "dependency": clamp(up(4), 1, 3), "history": clamp(up(4), 1, 3), "config": clamp(budget // 8, 1, 2), "script": clamp(up(4), 1, 3), "readme": clamp(budget // 10, 1, 1)}


def floor_lists(candidates: DataFrame, keys: list[str], budget: int = 10) -> DataFrame:
    """keys, floor, place, path. candidates: keys, path, role, rank_score, lexical_rank, ``*_score``, edge_order.

    One pass gives each row the floors it belongs to; one window with a literal limit ranks them all.
    """
    path, role = F.col("path"), F.col("role")
    lex, dep, co = F.col("lexical_score"), F.col("dependency_score"), F.col("co_change_score")
    source = role == "source"
    none = F.lit(None).cast("bigint")
    rules = [
        ("lexical", source & (lex >= 0.3), source_order(path), F.lit(0), lex, F.col("lexical_rank")),
        ("dependency", source & dep.isNotNull(), source_order(path), F.coalesce("edge_order", F.lit(9)), dep, none),
        ("history", source & (co >= 0.5) & (dep.isNotNull() | lex.isNotNull()), source_order(path), entry_order(path), co, none),
        ("config", (role == "config") & (lex >= 0.3), F.lit(0), F.lit(0), lex, F.col("lexical_rank")),
        ("script", ascii_lower(path).rlike(SCRIPT) & (lex >= 0.3), script_order(path), F.lit(0), lex, F.col("lexical_rank")),
        ("readme", (role == "docs") & ascii_lower(path).rlike(README), readme_order(path), F.lit(0), F.coalesce(lex, F.lit(0.0)), none),
    ]
    most = limits(budget)
    floors = [F.when(ok, F.struct(F.lit(n).alias("floor"), F.lit(most[n]).alias("_most"), a.alias("_a"), b.alias("_b"), v.alias("_v"), r.alias("_r"))) for n, ok, a, b, v, r in rules]
    rows = candidates.select(*keys, "path", "rank_score", F.explode(F.array_compact(F.array(*floors))).alias("f")).select(*keys, "path", "rank_score", "f.*")
    order = [F.asc("_a"), F.asc("_b"), F.desc("_v"), F.asc_nulls_last("_r"), F.desc("rank_score"), F.asc("path")]
    return first_rows(rows, [*keys, "floor"], order, max(most.values()), "place").filter("place <= _most").select(*keys, "floor", F.col("place").cast("bigint").alias("place"), "path")


def tests_in_two_passes(candidates: DataFrame, keys: list[str], budget: int = 10) -> DataFrame:
    """Tests of a plan: those that changed with a seed before all others, each by rank score."""
    tests = candidates.filter("role = 'test'").withColumn("pass", F.when(F.col("co_change_score").isNotNull(), 0).otherwise(1))
    return first_rows(tests, keys, [F.asc("pass"), F.desc("rank_score"), F.asc("path")], budget, "slot").select(*keys, "path", F.col("pass").cast("bigint").alias("pass"), F.col("slot").cast("bigint").alias("slot"))


# Signals in the order in which they make a file worth reading next.
READ_ORDER = {"anchor": 0, "current_diff": 0, "lexical": 1, "symbol": 2, "co_change": 3, "dependency": 4, "lexical_expansion": 5, "memory": 6, "semantic": 7, "related_test": 8, "history": 9, "config": 9, "docs": 9}


def next_reads(candidates: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Per area what to read beyond the plan: 4, 6 or 8 files, more where more source or tests are left."""
    picked = chosen.select(*keys, "path", F.lit(True).alias("_in"))
    rows = candidates.join(picked, [*keys, "path"], "left")
    source = F.col("role").isin("source", "config", "schema")
    out = F.col("_in").isNull()
    left = rows.groupBy(*keys, "area").agg(F.count_if(source & out).alias("_s"), F.count_if((F.col("role") == "test") & out).alias("_t"))
    limit = F.when((F.col("_s") >= 12) | (F.col("_t") >= 8), 8).when((F.col("_s") >= 6) | (F.col("_t") >= 4), 6).otherwise(4)
    role = F.when(source, 0).when(F.col("role") == "test", 1).when(F.col("role") == "docs", 2).otherwise(3)
    order = F.array_min(F.transform(F.split("signals", ","), lambda x: F.element_at(F.create_map(*[F.lit(y) for kv in READ_ORDER.items() for y in kv]), x)))
    strength = F.greatest("lexical_score", "dependency_score", "co_change_score")
    near = first_rows(rows.filter(out).withColumns({"_a": role, "_b": order, "_c": strength}), [*keys, "area"], [F.asc("_a"), F.asc("_b"), F.desc_nulls_last("_c"), F.desc("confidence"), F.asc("path")], 8, "place")
    near = near.join(left.select(*keys, "area", limit.alias("limit")), [*keys, "area"]).filter(F.col("place") <= F.col("limit"))
    return near.select(*keys, "area", "path", F.col("place").cast("bigint").alias("place"), F.col("limit").cast("bigint").alias("limit"))
