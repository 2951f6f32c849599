import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from quarrylight.llm import pairs as P
from quarrylight.session import work_path

SCHEMA = "g string, id string, items array<string>, _n bigint, bucket int"


def brute(baskets):
    n, one, two = Counter(), Counter(), Counter()
    for (g, _), items in baskets.items():
        s = sorted({i for i in items or [] if i is not None})
        if s:
            n[g] += 1
        for a in s:
            one[g, a] += 1
        for a, b in itertools.combinations(s, 2):
            two[g, a, b] += 1
    return {(g, a, b): (n[g], one[g, a], one[g, b], k) for (g, a, b), k in two.items()}


def rows(table, **kw):
    if not kw:
        table.refresh()
    return {(r.g, r.item_a, r.item_b): (r.n, r.n_a, r.n_b, r.n_ab) for r in table.scores(**kw).collect()}


def frame(spark, baskets):
    return spark.createDataFrame([(g, i, items, 7, 1) for (g, i), items in baskets.items()], SCHEMA)


def test_increments_equal_brute_force(spark):
    rnd = random.Random(3)
    make = lambda: [rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 6))]
    first = {(rnd.choice(["x", "y", None]), str(i)): make() for i in range(60)}
    t = P.PairTable(spark, work_path(spark, "t"), {"g": "string"}, buckets=4)
    t.apply(frame(spark, first), "id", "items")
    assert rows(t) == brute(first)
    # some change, some vanish, some come, some are as before
    change = {k: make() for k in list(first)[:15]} | {k: [] for k in list(first)[15:25]} | {("z", str(i)): make() + [None] for i in range(10)} | {k: first[k] for k in list(first)[30:35]}
    t.apply(frame(spark, change), "id", "items", replace=True)
    now = {**first, **change}
    touched = {g for g, _ in change if first.get((g, _)) != change[g, _]}
    part = rows(t, affected=True)
    assert part == {k: v for k, v in brute(now).items() if k[0] in touched}
    assert rows(t) == brute(now)
    # opened again, the table goes on where it was
    t = P.PairTable(spark, t.path, {"g": "string"})
    assert rows(t) == brute(now)
    more = {("x", "200"): ["a", "b"], ("n", "1"): ["a", "c"]}
    t.apply(frame(spark, more), "id", "items")
    assert set(rows(t, affected=True)) >= {("n", "a", "c")} and {g for g, _, _ in rows(t, affected=True)} == {"x", "n"}
    assert rows(t) == brute({**now, **more})


def test_a_basket_is_the_union_of_its_rows_over_changes(spark):
    t = P.PairTable(spark, work_path(spark, "t"), {"g": "string"})
    t.apply(frame(spark, {("x", "1"): ["a", "b"], ("x", "2"): ["a"]}), "id", "items")
    t.apply(frame(spark, {("x", "1"): ["b", "c"]}), "id", "items")
    assert rows(t) == brute({("x", "1"): ["a", "b", "c"], ("x", "2"): ["a"]})
    t.apply(frame(spark, {("x", "1"): ["c", "b"]}), "id", "items", replace=True)
    assert rows(t) == brute({("x", "1"): ["b", "c"], ("x", "2"): ["a"]})
    t.apply(frame(spark, {("x", "1"): []}), "id", "items", replace=True)
    assert rows(t) == {}
    t.apply(frame(spark, {("x", "1"): ["b", "a"]}), "id", "items")
    assert rows(t) == brute({("x", "1"): ["a", "b"], ("x", "2"): ["a"]})


def test_untouched_buckets_are_not_rewritten(spark):
    t = P.PairTable(spark, work_path(spark, "t"), {"g": "string"}, buckets=32)
    t.apply(frame(spark, {(f"g{i}", str(i)): ["a", "b", "c"] for i in range(200)}), "id", "items")
    t.refresh()
    t.apply(frame(spark, {("g7", "999"): ["a", "b"]}), "id", "items")
    t.refresh()
    for name, most in (("baskets", 1), ("marginals", 3), ("pairs", 1), ("scores", 1)):
        assert sum(g == 2 for g in t.at[name].values()) <= most < len(t.at[name]) - 5, name


def test_buckets_grow_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "FULL", 8)
    rnd = random.Random(8)
    make = lambda n: {(rnd.choice("xy"), str(i)): rnd.sample("abcdefgh", 4) for i in range(n)}
    t, now = P.PairTable(spark, work_path(spark, "t"), {"g": "string"}), make(4)
    t.apply(frame(spark, now), "id", "items")
    few = t.buckets
    assert rows(t) == brute(now)
    more = {(g, f"n{i}"): v for (g, i), v in make(60).items()}
    t.apply(frame(spark, more), "id", "items")
    assert t.buckets >= 4 * few
    assert rows(t) == brute({**now, **more})
    last = {("x", "n3"): ["a", "h"]}
    t.apply(frame(spark, last), "id", "items", replace=True)
    assert rows(t) == brute({**now, **more, **last})


def test_items_of_one_code_are_told_apart(spark, monkeypatch):
    real = F.xxhash64

    def weak(*cols):
        # under the first seed all codes are the same for two items of three
        h = real(*cols)
        return F.when((cols[0] == 0) & (F.pmod(h, F.lit(3)) > 0), F.lit(7).cast("bigint")).otherwise(h) if len(cols) == 4 else h

    monkeypatch.setattr(P.F, "xxhash64", weak)
    data = {("x", "1"): list("abcd"), ("x", "2"): list("bcd"), ("y", "1"): list("ab")}
    t = P.PairTable(spark, work_path(spark, "t"), {"g": "string"})
    t.apply(frame(spark, data), "id", "items")
    assert t.seed == 1
    assert rows(t) == brute(data)


def test_block_lists_are_rows(spark):
    wide = spark.createDataFrame([("b", list(range(4_000)))], "id string, _codes array<bigint>")
    plan = P.basket_pairs(wide, [], ["id"])
    assert plan.count() == 4_000 * 3_999 // 2
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" in text


def test_no_group(spark):
    df = spark.createDataFrame([("1", ["a", "b"]), ("2", ["b", "a", "c"])], "id string, items array<string>")
    t = P.PairTable(spark, work_path(spark, "t"), {})
    t.apply(df, "id", "items")
    t.refresh()
    assert {(r.item_a, r.item_b, r.n, r.n_ab) for r in t.scores().collect()} == {("a", "b", 2, 2), ("a", "c", 2, 1), ("b", "c", 2, 1)}
    t.apply(df.limit(1), "id", "items")
    t.refresh()
    assert t.scores().count() == 3


def test_empty_changes_and_nulls(spark):
    t = P.PairTable(spark, work_path(spark, "t"), {"g": "string"}, buckets=2)
    t.apply(frame(spark, {}), "id", "items")
    assert rows(t) == {}
    t.apply(frame(spark, {("x", "1"): None, ("x", "2"): [None, "a", "a"], ("x", "3"): ["a", "b"]}), "id", "items")
    assert rows(t) == {("x", "a", "b"): (2, 2, 1, 1)}
    t.apply(frame(spark, {}), "id", "items")
    assert rows(t) == {("x", "a", "b"): (2, 2, 1, 1)}


def test_wide_basket_is_spread_and_whole(spark):
    items = [f"i{n:04d}" for n in range(P.WIDE + 70)]
    t = P.PairTable(spark, work_path(spark, "t"), {"g": "string"}, buckets=2)
    t.apply(frame(spark, {("x", "1"): items, ("x", "2"): items[:3]}), "id", "items")
    got = rows(t)
    assert len(got) == len(items) * (len(items) - 1) // 2
    assert sum(v[3] for v in got.values()) == len(got) + 3


def test_repeated_basket_rows_are_united(spark):
    df = spark.createDataFrame([("x", "1", ["a", "b"], 0, 0), ("x", "1", ["b", "a"], 0, 0), ("x", "1", ["c"], 0, 0)], SCHEMA)
    t = P.PairTable(spark, work_path(spark, "t"), {"g": "string"}, buckets=2)
    t.apply(df, "id", "items")
    assert rows(t) == brute({("x", "1"): ["a", "b", "c"]})
