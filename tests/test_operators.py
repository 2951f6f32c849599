from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quarrylight.functions.paths import normal_path
from quarrylight.operators.ranks import best_items
from quarrylight.session import shared_dir
from quarrylight.operators import evaluate, feedback, graph, history, inventory, lexical, semantic, symbols


def test_name_status(spark):
    raw = "M\x00a.py\x00R100\x00old.py\x00new.py\x00D\x00gone.py\x00A\x00b.py\x00"
    df = spark.createDataFrame([("s", raw), ("t", "")], "sha string, raw string")
    got = [(r.sha, r.kind, r.old_path, r.path) for r in history.parse_name_status(df, "raw", "sha").collect()]
    assert got == [("s", "modified", None, "a.py"), ("s", "renamed", "old.py", "new.py"), ("s", "deleted", None, "gone.py"), ("s", "added", None, "b.py")]


def test_log(spark):
    raw = "commit abcdef1\n\na.py\nb/c.py\n\ncommit 1234567\nd.py\n"
    df = spark.createDataFrame([("r", raw)], "repo string, raw string")
    assert {(r.sha, r.path) for r in history.parse_log(df, "raw", "repo").collect()} == {("abcdef1", "a.py"), ("abcdef1", "b/c.py"), ("1234567", "d.py")}


def test_guarded_read(spark):
    df = spark.createDataFrame([(bytearray(b"ok"), False, 2), (bytearray(b"a\x00b"), False, 3), (bytearray(b"\xff\xfe"), False, 2), (bytearray(b"x"), True, 1), (bytearray(b"x"), False, 2_000_000), (None, False, 1)], "c binary, e boolean, s bigint")
    assert [r.x for r in df.select(inventory.guarded_status(F.col("c"), F.col("e"), F.col("s")).alias("x")).collect()] == ["read", "binary", "non_utf8", "policy_excluded", "oversized", "unreadable"]


def test_guarded_read_finds_any_zero_byte(spark):
    cases = {b"\x10\x01\x00": "binary", b"\x00": "binary", b"\x10\x01": "read", b"": "read", b"\x50\x05": "read", b"\x00\x10\x00": "binary"}
    df = spark.createDataFrame([(bytearray(k), False, 3) for k in cases], "c binary, e boolean, s bigint")
    assert [r.x for r in df.select(inventory.guarded_status(F.col("c"), F.col("e"), F.col("s")).alias("x")).collect()] == list(cases.values())


def test_gap_examples_are_the_first_three(spark):
    rows = [(q, f"p{(q * 37) % 90:02d}", "r", True, None if q % 2 else 20, None) for q in range(200)]
    df = spark.createDataFrame(rows, "query int, path string, role string, relevant boolean, a int, b int")
    got = {r.gap: (r.misses, r.examples) for r in evaluate.gaps(df, "a", "b").collect()}
    want = {}
    for _, p, _, _, a, _ in rows:
        want.setdefault("no_candidate_signal" if a is None else "ranked_too_low", []).append(p)
    assert got == {k: (len(v), ",".join(sorted(set(v))[:3])) for k, v in want.items()}


def test_normal_path(spark):
    cases = {"./a/b.py": "a/b.py", " a\\b ": "a/b", "././x": "x", "": None, "  ": None, ".github/x": ".github/x"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.n for r in df.select("p", normal_path(F.col("p")).alias("n")).collect()} == cases


def test_best_items(spark):
    rows = [("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 3.0), ("a", None, 9.0), ("a", "z", float("nan")), ("b", "w", None), (None, "v", 0.5)]
    df = spark.createDataFrame(rows, "k string, i string, s double")
    assert {(r.k, r["item"], r["rank"]) for r in best_items(df, ["k"], "i", "s", 2).collect()} == {("a", "x", 1), ("a", "y", 2), (None, "v", 1)}


def test_no_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", getConf=lambda: conf))
    with pytest.raises(ValueError):
        shared_dir(fake)


def test_merge_and_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4"), ("c", None)], "path string, hash string")
    assert {(r.path, r.state) for r in inventory.snapshot_diff(old, new, ["path"], ["hash"]).collect()} == {("b", "changed"), ("d", "created")}
    assert {(r.path, r.hash, r.outcome) for r in inventory.merged(old, new, ["path"], ["hash"]).collect()} == {("a", "1", "reused"), ("b", "9", "updated"), ("d", "4", "inserted"), ("c", None, "reused")}


def test_lexical_score(spark):
    docs = spark.createDataFrame([("src/auth/session.ts", "source", "requireSession session"), ("docs/a.md", "docs", "nothing"), ("src/x.ts", "source", None)], "path string, role string, content string")
    got = {r.path: r.score for r in lexical.search(spark, docs, "fix requireSession", 10).collect()}
    # content once: 2 + 1, role 1
    assert got == {"src/auth/session.ts": 4.0}
    assert lexical.search(spark, docs, "the of a", 10).count() == 0
    named = lexical.search(spark, docs, "look at src/auth/session.ts", 10).collect()
    assert named[0].path == "src/auth/session.ts" and named[0].score > 50


def test_symbols_and_imports(spark):
    docs = spark.createDataFrame(
        [("r", "a.py", "python", "import os\nfrom .b import c\nclass A:\n    def m(self):\n        pass\ndef f():\n    pass\n"), ("r", "b.ts", "typescript", "import { x } from './c';\nexport interface I {}\nexport const f = (a: number) => a;\n"), ("r", "c.go", "go", 'import "fmt"\nfunc (s *S) M() {}\nfunc F() {}\ntype T struct {}\n')],
        "repo_id string, path string, language string, content string",
    )
    got = {(r.path, r.kind, r.name, r.line_no) for r in symbols.symbols(docs).collect()}
    assert got == {("a.py", "class", "A", 3), ("a.py", "method", "m", 4), ("a.py", "function", "f", 6), ("b.ts", "interface", "I", 2), ("b.ts", "function", "f", 3), ("c.go", "method", "M", 2), ("c.go", "function", "F", 3), ("c.go", "struct", "T", 4)}
    assert {(r.source_path, r.raw) for r in symbols.imports(docs).collect()} == {("a.py", "os"), ("a.py", ".b"), ("b.ts", "./c"), ("c.go", "fmt")}


def test_import_resolution(spark):
    imports = spark.createDataFrame([("r", "src/a/x.ts", "typescript", "../b/y"), ("r", "pkg/m.py", "python", ".util"), ("r", "src/main/java/A.java", "java", "org.acme.B"), ("r", "src/lib.rs", "rust", "crate::net::client"), ("r", "pkg/m.py", "python", "missing")], "repo_id string, source_path string, language string, raw string")
    files = spark.createDataFrame([("r", p) for p in ("src/b/y.ts", "src/b/y/index.ts", "pkg/util.py", "src/main/java/org/acme/B.java", "src/net/client.rs")] + [("q", "src/b/y.ts")], "repo_id string, path string")
    got = graph.resolved_imports(imports, files, symbols.import_candidates(F.col("source_path"), F.col("raw"), F.col("language")))
    assert {(r.raw, r.target_path) for r in got.collect()} == {("../b/y", "src/b/y.ts"), (".util", "pkg/util.py"), ("org.acme.B", "src/main/java/org/acme/B.java"), ("crate::net::client", "src/net/client.rs")}


def test_two_hops_and_tests(spark):
    e = spark.createDataFrame([("r", "a", "b/__init__.py", "import", 0.9), ("r", "b/__init__.py", "c", "reexport", 0.8)], "repo_id string, source_path string, target_path string, kind string, confidence double")
    got = graph.two_hops(e, F.col("_via").endswith("__init__.py")).collect()
    assert [(r.source_path, r.target_path, r.confidence) for r in got] == [("a", "c", 0.612)]
    f = spark.createDataFrame([("r", "src/auth/session.ts", "source"), ("r", "tests/auth/session.test.ts", "test"), ("r", "src/auth/session.spec.ts", "test")], "repo_id string, path string, role string")
    assert {(r.test_path, r.confidence) for r in graph.test_links(f).collect()} == {("tests/auth/session.test.ts", 0.75), ("src/auth/session.spec.ts", 0.8)}


def test_metrics_of_one_query(spark):
    rows = spark.createDataFrame([(1, "a", "source", True, 1), (1, "b", "test", True, 2), (1, "c", "source", False, 3)], "query int, path string, role string, relevant boolean, rank int")
    m = evaluate.metrics(rows, {"v": "rank"}, (5, 10)).first()
    assert (m.recall_10, m.precision_10, m.mrr) == (1.0, 0.2, 1.0)
    t = {r.budget: r for r in evaluate.token_return(rows.filter("path <> 'b'"), "rank").collect()}
    assert [round(t[b].per_1k, 6) for b in ("brief", "standard", "deep")] == [0.25, 0.041667, 0.01]
    assert t["standard"].little_value


def test_profiles(spark):
    p = spark.createDataFrame([("a", "active", True), ("b", "draft", True), ("c", "draft", False)], "profile_id string, status string, default_eligible boolean")
    assert {(r.profile_id, r.status) for r in feedback.activated(p, "b").collect()} == {("a", "disabled"), ("b", "active"), ("c", "draft")}
    for bad in ("c", "zzz"):
        try:
            feedback.activated(p, bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_cosine_against_brute_force(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(300, 8)).astype("float32")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "vec_id bigint, embedding array<float>")
    got = semantic.cosine_top(df, df.filter("vec_id % 100 = 0"), 5, block=2).collect()
    u = v.astype("float64")
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in (0, 100, 200):
        s = u @ u[q]
        s[q] = -9
        assert [r["item"] for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == np.argsort(-s)[:5].tolist()


def test_snippets_and_memory(spark):
    from quarrylight.operators import packs

    t = spark.createDataFrame([("s", "r", "a", ["beta"]), ("s", "r", "b", ["none"])], "search_id string, repo_id string, path string, terms array<string>")
    x = spark.createDataFrame([("r", "a", "\n".join(["l"] * 9 + ["has Beta here"] + ["l"] * 9)), ("r", "b", "only")], "repo_id string, path string, content string")
    got = {r.path: (r.start_line, r.end_line, r.total_lines) for r in packs.snippets(t, x, "terms", 8).collect()}
    assert got == {"a": (5, 12, 19), "b": (1, 1, 1)}
    tasks = spark.createDataFrame([("s", "r", ["x", "y"])], "search_id string, repo_id string, terms array<string>")
    cards = spark.createDataFrame([(i, "r", ["x"] * (i + 1) + (["y"] if i == 2 else []), 0.5) for i in range(6)] + [(9, "q", ["x"], 1.0)], "card_id int, repo_id string, terms array<string>, confidence double")
    assert [(r.card_id, r.overlap) for r in packs.memory_matches(tasks, cards).orderBy("rank").collect()] == [(2, 2), (0, 1), (1, 1)]


def test_facets(spark):
    from quarrylight.operators import packs

    df = spark.createDataFrame([("Commit abcdef12 broke requireSession in src/a.py:\nError: bad_name", ), (None,)], "t string")
    rows = [r.f for r in df.select(packs.facets_of(F.col("t")).alias("f")).collect()]
    assert (rows[0].paths, rows[0].symbols, rows[0].errors, rows[0].commits) == (["src/a.py"], ["requireSession", "bad_name"], ["Error: bad_name"], ["abcdef12"])
    assert rows[1].paths == [] and rows[1].commits == []


def test_cosine_hits_are_counted_whole(spark):
    import random

    rnd = random.Random(5)
    vectors = {i: [rnd.gauss(0.3, 1) for _ in range(8)] for i in range(300)}
    vectors[7] = [0.0] * 8
    df = spark.createDataFrame([*vectors.items(), (900, None)], "vec_id bigint, embedding array<float>").repartition(5)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / max(1e-12, (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5)
    want = {q: sum(cos(vectors[q], v) >= 0.08 for i, v in vectors.items() if i != q) for q in (0, 100, 200)}
    got = {r.query_id: r.hits for r in semantic.cosine_at_least(df, df.filter("vec_id % 100 = 0"), 0.08, block=2).collect()}
    assert got == want and min(got.values()) > 50
    assert semantic.cosine_at_least(df.limit(0), df.limit(0), 0.08).count() == 0


def test_references_between_files(spark):
    rows = [
        ("r", "a.py", "python", "def loadRows(x):\n    pass\ndef _hide():\n    pass\ndef ab():\n    pass\n"),
        ("r", "b.py", "python", "from a import loadRows\nz = loadRows(1)\n"), ("r", "c.py", "python", "# _hide and reloadRows(2) and ab(1)\nx = loadRows\n"),
        ("r", "d.py", "python", "myloadRows(1)\n"), ("q", "b.py", "python", "loadRows(1)\n"), ("r", "e.js", "javascript", "export const $go = (a) => a;\n"), ("r", "f.js", "javascript", "$go(1);\n"), ("r", "n.py", "python", None),
    ]
    docs = spark.createDataFrame(rows, "repo_id string, path string, language string, content string")
    got = {(r.source_path, r.target_path, r.symbol): (r.kind, r.confidence) for r in symbols.references(docs, symbols.symbols(docs)).collect()}
    # a longer name's call counts as in the survey: the form is looked for by its end
    assert got == {("b.py", "a.py", "loadRows"): ("calls", 0.82), ("c.py", "a.py", "loadRows"): ("calls", 0.82), ("c.py", "a.py", "_hide"): ("references", 0.58), ("f.js", "e.js", "$go"): ("calls", 0.82)}


def test_commits_that_texts_name(spark):
    a, b, c = "abcdef1234567890" + "0" * 24, "abcdef1999999999" + "1" * 24, "7654321fedcba000" + "2" * 24
    texts = spark.createDataFrame([("r", "see commit ABCDEF12345 and commit 12345"), ("r", None), ("r", "7654321 without the word"), ("q", f"Commit {c}, twice {c}"), (None, f"commit {b}")], "repo_id string, text string")
    commits = spark.createDataFrame([(r, s, "p") for r in ("r", "q") for s in (a, b, c, c)] + [("r", None, "p")], "repo_id string, sha string, path string")
    assert sorted((x.repo_id, x.sha) for x in history.named_commits(texts, commits).collect()) == [("q", c), ("r", a)]


def test_kept_index_and_hybrid(spark, tmp_path):
    docs = spark.createDataFrame([("a/ledger.py", "token ledger token", "LedgerBook"), ("b.py", "token", None), ("c.md", None, "x")], "path string, content string, symbols string")
    fields = {"path": F.col("path"), "content": F.col("content"), "symbols": F.col("symbols")}
    at = str(tmp_path / "index")
    lexical.write_index(docs, ["path"], fields, at)
    terms = spark.createDataFrame([("token", 1.0), ("ledger", 1.0), ("absent", 1.0)], "term string, weight double")
    got = {r.path: r.score for r in lexical.bm25(spark, at, ["path"], terms).collect()}
    assert set(got) == {"a/ledger.py", "b.py"} and got["a/ledger.py"] > got["b.py"] > 0
    assert lexical.bm25(spark, at, ["path"], terms.limit(0)).count() == 0
    exact = spark.createDataFrame([("b.py", 2.0), ("d.py", 1.0), ("a/ledger.py", 0.0)], "path string, score double")
    both = {r.path: (r.score, r.exact) for r in lexical.hybrid(lexical.bm25(spark, at, ["path"], terms), exact, ["path"]).collect()}
    assert both == {"b.py": (200.0, True), "d.py": (100.0, True), "a/ledger.py": (got["a/ledger.py"], False)}


def test_two_hops_over_reexports_alone(spark):
    e = spark.createDataFrame([("r", "a", "hub", "import", 0.9), ("r", "hub", "c", "reexport", 0.8), ("r", "hub", "d", "import", 0.8)], "repo_id string, source_path string, target_path string, kind string, confidence double")
    got = graph.two_hops(e, F.lit(True), second=F.col("kind") == "reexport").collect()
    assert [(r.source_path, r.target_path, r.confidence) for r in got] == [("a", "c", 0.612)]
    rows = spark.createDataFrame([("r", "a", "b", "import", 2), ("r", "a", "b", "import", 1), ("r", "a", "a", "import", 0), ("r", "a", None, "import", 0), ("r", "a", "b", "call", 3)], "repo_id string, source_path string, target_path string, kind string, at int")
    assert {(r.kind, r["at"]) for r in graph.deduplicated(rows, [F.asc("at")]).collect()} == {("import", 1), ("call", 3)}


def test_scored_tests(spark):
    a = spark.createDataFrame([("r", "src/auth/tokenStore.ts", 0), ("r", "lib/other.ts", 7)], "repo_id string, path string, ord int")
    t = spark.createDataFrame([("r", "tests/auth/tokenStore.test.ts", None), ("r", "x/a.test.ts", "import '../src/auth/tokenstore.ts'"), ("r", "x/b.test.ts", "store store store store store store token"), ("r", "x/c.test.ts", "nothing"), ("q", "tests/auth/tokenStore.test.ts", None)], "repo_id string, path string, content string")
    got = {r.test_path: r.score for r in graph.scored_tests(graph.source_keys(a), t).collect()}
    # name 16 + 5, mirrored 7 + 5; mention 8; terms alone at most 6
    assert got == {"tests/auth/tokenStore.test.ts": 33.0, "x/a.test.ts": 8.0, "x/b.test.ts": 6.0}
