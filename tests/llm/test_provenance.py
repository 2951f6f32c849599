import random

from quarrylight.llm import provenance as V


def code(seed, n=30):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(4))
    return [f"{word()} = {word()}({word()}, {word()})" for _ in range(n)]


def text(lines):
    return "\n".join(lines) + "\n"


def test_text_kinds():
    assert V.text_kind("// Code generated by x v1. DO NOT EDIT.\npackage a\n") == "generated"
    assert V.text_kind("// Licensed to us\n\n// @generated by tool from a.idl\nclass A {}\n") == "generated"
    assert V.text_kind("// Vendored from foolib 1.2.3; see upstream for changes\nx\n") == "vendored"
    assert V.text_kind('const banner = "Code generated by us. DO NOT EDIT.";\n') is None
    assert V.text_kind("// the header of generated files (@generated) is added below\nlet a = 1;\n") is None
    assert V.text_kind("// this index is generated from the cell at startup\nlet a = 1;\n") is None
    assert V.text_kind("// never edit vendored copies here, patch them upstream\nlet a = 1;\n") is None
    assert V.text_kind("!function(){" + "var a=1;function b(c){return c?c+1:c.d}" * 30 + "}();") == "minified"
    assert V.text_kind("TABLE = [\n" + "".join("  " + ",".join(str(i * j) for j in range(20)) + ",\n" for i in range(20)) + "]\n") == "data"
    assert V.text_kind("".join(f"export const FIELD_{i} = {i};\n" for i in range(30))) == "generated"
    assert V.text_kind(text(code(1))) is None
    assert V.text_kind("") is None and V.text_kind("\n \n") is None


def test_statements_of_origin_anywhere():
    body = text(code(1))
    head = "".join(f"// licence line {i}\n" for i in range(20))
    for said in ("// Code generated by protoweave v1. DO NOT EDIT.", "// @generated by schemaloom from a.schema", "// <auto-generated> tool: x </auto-generated>", "// This file was produced automatically by x; manual changes are lost.", "# Machine-made from api/rule.yaml; edit the source, then rebuild", "// Generated by the patch compiler. Source: patch.idl"):
        assert V.text_kind(body + said + "\n") == "generated", said
        assert V.text_kind(body + said + "\n" + body) == "generated", said
        assert V.text_kind(head + said + "\n" + body) == "generated", said
    assert V.text_kind(body + "// do not edit\n") == "generated"
    assert V.text_kind("/*\n" + "licence\n" * 15 + "Code generated by x. DO NOT EDIT.\n*/\n" + body) == "generated"
    assert V.text_kind(head + "// Vendored from foolib 1.2.3; see upstream for changes\n" + body) == "vendored"
    assert V.text_kind(body + "// Vendored from foolib 1.2.3\n") == "vendored"
    # a remark on the lines beside it, and a statement inside a literal, say nothing of the file
    for other in ("// do not modify!", "// auto-generated ids stay", "// copied from foolib 1.2.3", "s = `\n// Code generated by us. DO NOT EDIT.\n`", 'T = """\n# Code generated by us. DO NOT EDIT.\n"""', "// the header of generated files (@generated) is added below"):
        assert V.text_kind(body + other + "\n" + text(code(2))) is None, other


def files_of(spark, rows):
    full = [(r, p, s, h, f"2025-01-0{d} 00:00:00", True) for r, p, s, h, d in rows]
    return spark.createDataFrame(full, "repo_id string, path string, size_bytes bigint, hash string, at string, code boolean").selectExpr("repo_id", "path", "size_bytes", "hash", "cast(at as timestamp_ntz) as scanned_at", "code as cls")


def run(spark, reads, files, texts):
    rows = [(r, p, 100 if s is None else None if s < 0 else s, h, d) for r, p, s, h, d in files]
    return {(r.repo_id, r.path): r.kind for r in V.foreign_files(files_of(spark, rows), reads(texts)).collect()}


def test_paths_copies_and_twins(spark, reads):
    lib, own = code(1), code(2)
    edited = lib[:26] + code(3, 4)
    files = [
        ("a", "third_party/lib/x.py", None, "h1", 1), ("b", "src/x.py", None, "h2", 1), ("b", "src/x.py", None, "h2", 1), ("c", "src/renamed.py", None, "h1", 1), ("a", "src/own.py", None, "h3", 1), ("d", "src/lost.py", None, "h1", 1), ("d", "src/alone.py", None, "h9", 1), ("d", "src/big_table.ts", 4_000_000, "h8", 1), ("d", "Cargo.lock", None, "h7", 1), ("e", "src/vast.rs", -1, "hv", 1),
        ("d", "build/hand.py", None, "h6", 1), ("d", "docs/vendor/lib/readme.md", None, "h5", 1), ("d", "a.min.js", None, "h4", 1), ("d", "src/empty.py", 0, "he", 1), ("e", "src/empty2.py", 0, "he", 1), (None, "src/n.py", None, None, 1),
    ]
    texts = [("a", "third_party/lib/x.py", text(lib)), ("b", "src/x.py", text(edited)), ("c", "src/renamed.py", text(lib).replace("\n", "\r\n")), ("a", "src/own.py", text(own)), ("d", "build/hand.py", text(code(5))), ("d", "src/empty.py", ""), (None, "src/n.py", text(code(9))), ("e", "src/vast.rs", None, "skipped", "2025-01-01 00:00:00", "oversized")]
    assert run(spark, reads, files, texts) == {
        ("a", "third_party/lib/x.py"): "vendored", ("b", "src/x.py"): "vendored", ("c", "src/renamed.py"): "vendored", ("d", "src/lost.py"): "vendored", ("d", "src/big_table.ts"): "data", ("d", "Cargo.lock"): "lock", ("e", "src/vast.rs"): "data", ("d", "a.min.js"): "minified",
    }


def test_empty(spark, reads):
    assert run(spark, reads, [], []) == {}


def test_containment_against_brute_force(spark):
    rnd = random.Random(4)
    pool = [code(s, 40) for s in range(6)]
    rows = []
    for i in range(120):
        base = rnd.choice(pool)
        keep = rnd.sample(base, rnd.randint(5, 40))
        new = code(1000 + i, rnd.randint(0, 30))
        rows.append((rnd.choice("abc"), V.line_hashes(text(keep + new))))
    df = spark.createDataFrame(rows, "repo_id string, lines array<bigint>")
    want = set()
    for r, ls in rows:
        a = set(ls)
        if len(a) >= V.LEAST and any(q != r and (a == set(o) or len(o) >= V.LEAST and len(a & set(o)) >= max(V.SHARED, -(-V.SHARE * len(a) // 1))) for q, o in rows):
            want.add(tuple(ls))
    for first in (32, 1):
        got = {r.cls for r in V.copied_classes(df, first=first).collect()}
        from pyspark.sql import functions as F

        known = {r.c: tuple(r.lines) for r in df.select(F.xxhash64("lines").alias("c"), "lines").collect()}
        assert {known[c] for c in got} == want


def test_statements_in_other_words():
    body = "\nfunction f(a) {\n  return a + 1;\n}\n"
    for head, kind in (
        ("// machine produced by swagger-codegen", "generated"), ("// regenerate, never hand edit", "generated"), ("// created with stringer", "generated"), ("// Produced by bison 3.8", "generated"), ("/*! jQuery JavaScript Library v3.6.0 */", "vendored"), ("/* lodash 4.17.21 | MIT License */", "vendored"),
        ("// created by Jane Doe", None), ("// written with care, not generated by the compiler", None), ("// never edit vendored copies here, patch them upstream", None), ("// the header of generated files (@generated) is added below", None), ("// Licensed to the project under one licence", None),
    ):
        assert V.text_kind(head + body) == kind, head
