from pyspark.sql import functions as F

from quarrylight.functions import paths as P
from quarrylight.functions import text as T
from quarrylight.functions import vectors as V


def each(spark, values, f):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return {r.x: r.y for r in df.select("x", f(F.col("x")).alias("y")).collect()}


def test_roles(spark):
    want = {
        "src/auth/session.ts": "source", "tests/auth/session.test.ts": "test", ".env": "sensitive", "deploy/.env.local": "sensitive", "keys/id_rsa": "sensitive", "dist/app.min.js": "generated", "a/node_modules/b.js": "generated", "pnpm-lock.yaml": "generated",
        "db/migrations/1.sql": "schema", "package.json": "config", "a/b.toml": "config", "docs/x.html": "docs", "README.md": "docs", "pkg/x_test.go": "test", "main.kt": "source", "a.bin": "unknown", "src/secrets.py": "sensitive",
    }
    assert each(spark, want, P.role) == want


def test_areas(spark):
    want = {
        "src/auth/session.ts": "src/auth", "README.md": ".", ".github/workflows/ci.yml": ".github/workflows", "src/main.rs": "src", "src/main/java/org/acme/a/b/c/X.java": "src/main/java/org/acme/a/b", "src/main/java/X.java": "src/main/java", "a/b/c/d": "a/b", "": ".",
    }
    assert each(spark, want, P.area) == want


def test_explicit_paths(spark):
    got = each(spark, ["Fix `src/Auth/session.ts`, and ./a\\b.py: now", "see src/a.rs:12 and plain.py", None], P.explicit_paths)
    assert got["Fix `src/Auth/session.ts`, and ./a\\b.py: now"] == ["a/b.py", "src/auth/session.ts"]
    assert got["see src/a.rs:12 and plain.py"] == []
    assert got[None] == []


def test_words_and_information(spark):
    assert each(spark, ["Fix requireSession, bug_9"], T.words)["Fix requireSession, bug_9"] == ["fix", "requiresession", "bug_9"]
    assert each(spark, ["sync-queue of a-b and x-the-y"], T.aliases)["sync-queue of a-b and x-the-y"] == ["sync_queue"]
    info = each(spark, ["Fixes #1061", "fix bug", "fix requireSession bug"], T.information)
    assert [v < 2 for v in info.values()] == [True, True, False]


def test_formats(spark):
    assert each(spark, ["a b*~/é"], T.percent_encoded)["a b*~/é"] == "a%20b%2A~%2F%C3%A9"
    assert each(spark, ["<a & 'b'>"], T.escaped)["<a & 'b'>"] == "&lt;a &amp; &#39;b&#39;&gt;"
    assert each(spark, ["Hello, Wörld 2"], T.slug)["Hello, Wörld 2"] == "hello-w-rld-2"
    assert each(spark, ["one two three"], T.token_estimate)["one two three"] == 4
    assert each(spark, ["HTTPServer2Go_x"], T.parts)["HTTPServer2Go_x"] == ["http", "server", "2", "go", "x"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, ["auth", "token", "auth"]), (2, [])], "k int, t array<string>")
    rows = V.hash_embedding(df, "k", "t", 64).collect()
    assert [r.k for r in rows] == [1]
    assert abs(sum(x * x for x in rows[0].vector) - 1) < 1e-9
    assert len(rows[0].vector) == 64
