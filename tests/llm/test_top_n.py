import math
import random

from pyspark.sql import functions as F

from quarrylight.llm.topn import score_bin, top_n_per_group


def brute(rows, n):
    best = {}
    for k, i, s in rows:
        if i is None or s is None or math.isnan(s):
            continue
        best.setdefault(k, {})
        best[k][i] = max(s, best[k].get(i, -math.inf))
    return {(k, i) for k, v in best.items() for i, _ in sorted(v.items(), key=lambda x: (-x[1], x[0].encode()))[: max(1, n(k))]}


def make(spark, rows):
    return spark.createDataFrame([(k, i, s, 1, 2, "x") for k, i, s in rows], "k string, i string, s double, _salt int, n int, item string")


def test_random_groups_with_ties_and_dirt(spark):
    rnd = random.Random(5)
    values = [0.0, -0.0, 0.5, 0.5, 1.0, 3.25, -2.0, math.nan, None, math.inf, -math.inf, 1e308]
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice([None, "é", "z", "Z", "a", *[f"p{j}" for j in range(40)]]), rnd.choice(values)) for _ in range(1500)]
    got = {(r.k, r.item) for r in top_n_per_group(make(spark, rows), ["k"], "i", "s", n=7).collect()}
    assert got == brute(rows, lambda k: 7)


def test_limits_per_group(spark):
    rows = [(k, f"p{j}", float(j % 5)) for k in "abcd" for j in range(30)]
    lim = spark.createDataFrame([("a", 3), ("a", 3), ("b", 0), ("c", None)], "k string, n int")
    got = {(r.k, r.item) for r in top_n_per_group(make(spark, rows), ["k"], "i", "s", n=lim, default_n=10).collect()}
    assert got == brute(rows, lambda k: {"a": 3, "b": 0}.get(k, 10))


def test_one_group_of_ties(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.format_string("p%05d", "id").alias("i"), F.lit(1.0).alias("s"))
    got = [r.item for r in top_n_per_group(df, ["k"], "i", "s", n=4).orderBy("rank").collect()]
    assert got == ["p00000", "p00001", "p00002", "p00003"]


def test_limits_beyond_the_planner_and_groups_beyond_the_thresholds(spark):
    rows = [(k, f"p{j:05d}", float(j % 7)) for k in "abc" for j in range(3000)]
    lim = spark.createDataFrame([("a", 1500), ("b", 2), (None, 5)], "k string, n int")
    want = brute(rows, lambda k: {"a": 1500, "b": 2}.get(k, 10))
    for groups in (0, 1, 100):
        got = {(r.k, r.item) for r in top_n_per_group(make(spark, rows), ["k"], "i", "s", n=lim, default_n=10, groups=groups).collect()}
        assert got == want


def test_null_keys_and_ranks(spark):
    rows = [(None, f"p{j}", float(j)) for j in range(20)] + [("", f"p{j}", float(-j)) for j in range(20)]
    lim = spark.createDataFrame([(None, 3), ("zz", 4)], "k string, n int")
    got = {(r.k, r.item, r.rank) for r in top_n_per_group(make(spark, rows), ["k"], "i", "s", n=lim, default_n=2).collect()}
    assert got == {(None, "p19", 1), (None, "p18", 2), (None, "p17", 3), ("", "p0", 1), ("", "p1", 2)}


def test_empty(spark):
    assert top_n_per_group(make(spark, []), ["k"], "i", "s").count() == 0


def test_bins_never_invert(spark):
    rnd = random.Random(1)
    vals = sorted({rnd.choice([-1, 1]) * rnd.random() * 10 ** rnd.randint(-9, 9) for _ in range(3000)} | {0.0, math.inf, -math.inf})
    bins = [r.b for r in spark.createDataFrame([(v,) for v in vals], "v double").orderBy("v").select(score_bin(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins)
