import uuid

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import tasks, text
from quarrylight.operators import commands, floors, store
from quarrylight.session import work_path

CAND = "s bigint, path string, role string, rank_score double, lexical_rank bigint, lexical_score double, dependency_score double, co_change_score double, edge_order int, signals string, area string, confidence double"


def cand(spark, rows):
    """rows: path, role, lexical, dependency, co-change."""
    full = [(1, p, r, (a or 0) + (d or 0) + (c or 0), i if a else None, a, d, c, None, ",".join(n for n, v in (("co_change", c), ("dependency", d), ("lexical", a)) if v) or "lexical", "x", 0.5) for i, (p, r, a, d, c) in enumerate(rows)]
    return spark.createDataFrame(full, CAND)


def test_floors(spark):
    df = cand(spark, [
        ("examples/a.ts", "source", 0.9, None, None), ("src/b.ts", "source", 0.4, None, 0.8), ("src/c.ts", "source", 0.2, 0.1, None), ("src/index.ts", "source", None, 0.3, 0.6), ("src/d.ts", "source", None, None, 0.9),
        ("app.toml", "config", 0.5, None, None), ("b.toml", "config", 0.4, None, None), ("tools/release.sh", "unknown", 0.9, None, None), ("tools/check.sh", "unknown", 0.3, None, None), ("x/README.md", "docs", 0.2, None, None), ("docs/y/readme.md", "docs", None, None, 0.1),
    ])
    got = {}
    for r in sorted(floors.floor_lists(df, ["s"], 10).collect(), key=lambda r: r.place):
        got.setdefault(r.floor, []).append(r.path)
    assert got == {
        "lexical": ["src/b.ts", "examples/a.ts"], "dependency": ["src/index.ts", "src/c.ts"], "history": ["src/index.ts", "src/b.ts"], "config": ["app.toml"], "script": ["tools/check.sh", "tools/release.sh"], "readme": ["docs/y/readme.md"],
    }
    assert floors.limits(4) == {"lexical": 2, "dependency": 1, "history": 1, "config": 1, "script": 1, "readme": 1}
    assert floors.floor_lists(df.limit(0), ["s"]).count() == 0


def test_tests_that_changed_come_first(spark):
    df = cand(spark, [("a_test.go", "test", 0.9, None, None), ("b_test.go", "test", 0.1, None, 0.2), ("c.go", "source", 0.9, None, None)])
    assert [(r.path, r["pass"]) for r in floors.tests_in_two_passes(df, ["s"]).orderBy("slot").collect()] == [("b_test.go", 0), ("a_test.go", 1)]


def test_next_reads_take_more_where_more_is_left(spark):
    rows = [(f"s{i:02d}.py", "source", 0.5, None, None) for i in range(13)] + [("t.py", "test", 0.9, None, None)]
    df = cand(spark, rows)
    picked = df.filter("path = 's00.py'").select("s", "path")
    got = floors.next_reads(df, picked, ["s"]).orderBy("place").collect()
    assert len(got) == 8 and got[0].path == "s01.py" and {r.limit for r in got} == {8}


def test_task_families(spark):
    cases = {"run the smoke workflow": "broad_scope", "fix the": "low_information", "look at src/a.ts please": "explicit_path", "panic while loading cache": "stack_or_error", "rename loadCache everywhere": "symbol_identifier", "what did that commit touch": "commit_clue", "cache eviction policy": "domain_phrase"}
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    assert {r.q: r.f for r in df.select("q", tasks.family(F.col("q")).alias("f")).collect()} == cases


def test_names_and_lines(spark):
    names = ["file:///a", "x", "", "ü/ß"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.u for r in df.select(text.name_uuid(F.col("n")).alias("u")).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert [r.u for r in df.select(text.percent_decoded(text.percent_encoded(F.concat("n", F.lit("a+b c*~%")))).alias("u")).collect()] == [n + "a+b c*~%" for n in names]
    words = {"a/b.py": "a/b.py", "a b": "'a b'", "it's": "'it'\\''s'", "": "''"}
    df = spark.createDataFrame([(n,) for n in words], "n string")
    assert {r.n: r.w for r in df.select("n", text.shell_quoted(F.col("n")).alias("w")).collect()} == words
    marks = {"f#L3-L7": (3, 7), "f#L4": (4, 4), "f#L9-L2": None, "f": None, "f#L0": None}
    df = spark.createDataFrame([(n,) for n in marks], "n string")
    assert {r.n: tuple(r.r) if r.r else None for r in df.select("n", text.line_range(F.col("n")).alias("r")).collect()} == marks
    df = spark.createDataFrame([("a\nb\nc",)], "t string")
    assert df.select(text.lines_between(F.col("t"), F.lit(2), F.lit(9)).alias("x")).first().x == "b\nc"


@pytest.mark.parametrize(
    ("files", "path", "want"),
    [
        (["a/package.json", "a/yarn.lock", "package.json"], "a/b/x.test.ts", "yarn test a/b/x.test.ts"), (["package.json", "package-lock.json"], "a/x.spec.js", "npm test a/x.spec.js"), (["package.json"], "x.test.tsx", "pnpm test x.test.tsx"), ([], "x.test.ts", "pnpm test x.test.ts"), ([], "tests/a.rs", "cargo test --test a"), ([], "tests/a/b.rs", "cargo test"),
        ([], "p/q_test.go", "go test ./p"), ([], "tests/test_a.py", "pytest tests/test_a.py"), (["pom.xml"], "src/test/java/a/BTest.java", "mvn -Dtest=BTest test"), (["build.gradle", "pom.xml"], "src/test/java/a/BTest.java", "./gradlew test --tests a.BTest"), ([], "t/BTest.java", "java test t/BTest.java"), ([], "a.rb", None),
    ],
)
def test_commands(spark, files, path, want):
    f = spark.createDataFrame([("r", p) for p in [*files, path]] + [("q", "yarn.lock")], "repo_id string, path string")
    got = commands.test_commands(f, f.filter(F.col("path") == path)).collect()
    assert [(r.path, r.command) for r in got] == [(path, want)]


def test_rehashed_and_filled(spark):
    cols = "path string, size int, hash string"
    old = spark.createDataFrame([("a", 1, "h1"), ("b", 2, "h2"), ("c", None, "h3"), ("d", 4, None)], cols)
    now = spark.createDataFrame([("a", 1, "x"), ("b", 3, "x"), ("c", None, "x"), ("d", 4, "x"), ("e", 5, "x")], cols)
    assert {r.path: (r.hash, r.reused) for r in store.rehashed(now, old, ["path"], ["size"]).collect()} == {"a": ("h1", True), "b": ("", False), "c": ("h3", True), "d": ("", False), "e": ("", False)}
    new = spark.createDataFrame([("a", None, "n"), ("f", 6, "f")], cols)
    assert {(r.path, r.size, r.hash, r.outcome) for r in store.filled(old, new, ["path"]).collect()} == {("a", 1, "n", "updated"), ("b", 2, "h2", "kept"), ("c", None, "h3", "kept"), ("d", 4, None, "kept"), ("f", 6, "f", "inserted")}


def test_cached_result(spark):
    at, made = work_path(spark, "cache"), []

    def make():
        made.append(1)
        return spark.range(len(made))

    assert [store.cached_result(spark, at, ["q", "1"], make).count() for _ in range(3)] == [1, 1, 1]
    assert store.cached_result(spark, at, ["q", "2"], make).count() == 2 and len(made) == 2
    # parts are told apart, not joined
    assert store.cached_result(spark, at, ["q1", ""], make).count() == 3


def test_repeated_and_groups(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, None), (None, "b")], "id int, label string")
    assert {(r.code, r.value, r.times) for r in store.repeated(df, "id", "label").collect()} == {("repeated_id", "1", 2), ("repeated_label", "a", 2)}
    df = spark.createDataFrame([("k", g, p) for g in "cab" for p in "zyx"], "k string, g string, p string")
    assert {(r.g, r.members, r.links) for r in store.first_groups(df, ["k"], "g", "p", 2, 2).collect()} == {("a", 3, "x,y"), ("b", 3, "x,y")}
