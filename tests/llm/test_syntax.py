import pytest

from quarrylight.llm import grammar as G
from quarrylight.llm import syntax

GOOD = {
    "javascript": [
        "", "#!/usr/bin/env node\nlet a = 1", "const f = async ({a = 1, ...r}, [b, , c] = []) => { await g(a?.b ?? c); };", "class A extends (B) { static #x = 1; get y() { return this.#x } static { init() } async *z() { yield* w } }", "for (const [k, v] of Object.entries(o)) if (k in v) continue; else break",
        "const re = /[({[]\\/\"'/g, t = `a ${`b ${1 + 1} }`} {`;", "label: for (;;) { break label }", "({a, b = 2} = c); [x, y] = [y, x]", "export default function () {}\nexport * as n from './m.js'", "import d, { a as b } from 'x'\nimport * as y from \"y\"", "a = b\n++c\nreturnValue = 1", "switch (x) { case 1: f(); break; default: }",
        "x = a ? b : c => d", "if (a) ; else { }", "try { f() } catch { } finally { }", "var conflict = `\n<<<<<<< HEAD\n=======\n>>>>>>> x\n`", "/* <<<<<<< HEAD */ f(1_000n, 0xff, .5e-3)", "new Foo", "new (a.b())(c)", "do x++; while (x < 5)\nf()", "a = b / c / d", "throw new Error('x')", "x = function* () { yield }", "async () => { for await (const x of y) {} }", "o = {get a() { return 1 }, set a(v) {}, async b() {}, [c]: 1, 'd': 2, 3: 4, e}",
    ],
    "typescript": [
        "export interface A<T extends B = C> extends D { readonly x?: string; [k: string]: any; f(a: number): void; new (x: T): A<T> }", "type U = 'a' | { kind: 'b'; n: number }[] | ((x: string) => void)", "const m: Map<string, Array<Map<string, number>>> = new Map();", "function f<T>(this: T, a?: number, ...b: T[]): asserts a is number {}", "let x = y as unknown as Z, q = w!, s = v satisfies T;",
        "abstract class C<T> implements I { private readonly a: string; constructor(public b = 1) { super() } abstract f(): void; declare x: number; g?(): void }", "enum E { A = 1, B }", "declare module 'm' { export const a: string }", "namespace N { export type T = keyof typeof x }", "const g = <T,>(a: T): T => a;", "import type { A } from 'a'; export type { A }", "type M = { [K in keyof T]?: T[K] }", "const h = async (a: B[]): Promise<void> => { f<string>(a) };", "let t: [a: string, b?: number];", "@dec() class D { @p x = 1 }", "const c = a < b && c > d", "type C2 = A extends infer X ? X : never",
        "function o(a: string): void;\nfunction o(a: any) {}", "var k: number | undefined = 3",
    ],
    "go": [
        "package a\n", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\nfunc (t *T) F(a, b int, c ...string) (n int, err error) {\n\tfor i, x := range c {\n\t\tif v, ok := m[x]; ok {\n\t\t\treturn\n\t\t}\n\t}\n\tswitch y := t.(type) {\n\tcase nil, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\t}\n\tgo func() {}()\n\treturn T{A: 1}.A, nil\n}\n",
        "package a\nfunc M[K comparable, V int | ~string](m map[K]V) {}\nvar x = map[string][]int{\"a\": {1, 2}}\nvar r = 'a' + '\\n'\nvar s = `raw\n{`\n", "package a\nconst (\n\tA = iota\n\tB\n)\ntype I interface {\n\tF(int) error\n\t~int | string\n}\n", "package a\nfunc f() {\n\tif x := g(T{1}); x > 0 {\n\t}\n\tfor {\n\t\tbreak\n\t}\nL:\n\tfor i := 0; i < 3; i++ {\n\t\tcontinue L\n\t}\n\ta[1:2:3], b = <-c, &d\n}\n",
    ],
    "java": [
        "package a.b;\nimport java.util.*;\npublic class A<T extends B & C> extends D implements E { int[] x = {1, 2}, y[]; @Override public <R> R f(final T t, int... n) throws X { return (R) t; } static { } A() { this(1); } }", "record P(int x, String y) { P { } }", "enum E { A(1) { void f() {} }, B; E(int i) {} }", "sealed interface S permits A, B { default void f() {} int X = 1; }", "@interface N { String v() default \"\"; }",
        "class A { void f() { var s = switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; for (String a : b) c.forEach(x -> g(x, 1)); Runnable r = () -> {}; Map<String, List<int[]>> m = new HashMap<>(); if (o instanceof String q && q.isEmpty()) {} try (var z = open()) {} catch (A | B e) {} finally {} int i = (int) 3L >>> 2; i >>= 1; a = b < c ? d : e; f(A::new, int[]::new); String t = \"\"\"\n x \"y\" \"\"\"; synchronized (this) { assert i > 0 : \"m\"; } do { } while (true); l: for (;;) { break l; } char c = '\\''; } }",
    ],
    "rust": [
        "", "#![allow(x)]\nuse a::{b, c::*, d as e};\n#[derive(Debug)]\npub struct S<'a, T: Clone + 'a> where T: Copy { pub x: &'a T, y: [u8; 4] }\npub(crate) enum E { A, B(u8), C { x: i32 } = 3 }", "impl<T> Tr for S<T> where T: Fn(u8) -> u8 { type X = Vec<Vec<T>>; const N: usize = 1; fn f(&mut self, (a, b): (u8, u8)) -> Result<T, Box<dyn Error + Send>> { match x { Some(n @ 1..=5) | None if n > 2 => {} _ => return Err(e)?, } } }",
        "fn f() { let Some(x) = y else { return }; if let A::B { x, .. } = z && true { } let c = |a: u8, b| -> u8 { a }; for i in 0..10 { continue } 'l: loop { break 'l } let v: Vec<_> = it.map(|x| x.0).collect::<Vec<_>>(); println!(\"{}\", v); S { x: 1, ..d }; a >>= 2; let s = r#\"raw \"x\" }\"#; let ch = '{'; unsafe { *p = 1 } (x as u8) < 3; while let Some(x) = s.pop() {} }", "/* outer /* inner */ ( */ mod m { macro_rules! mm { ($x:expr) => { $x } } }\ntrait T: A + B { fn f(&self); }\nextern \"C\" { fn g(); }\nstatic A: &str = \"x\\\ny\";\nasync fn h<const N: usize>() -> impl Iterator<Item = u8> + '_ { async move { x.await }; todo!() }",
    ],
    "python": ["", "x = 1\n", "\ufeffdef f():\n    return f'{x!r}'\n", "match a:\n    case [1, *_]: pass\n"],
}
BAD = {
    "javascript": ["const x: number = 1", "import type { A } from 'a'", "function f( {", "<<<<<<< HEAD\na = 1", "const a = {b: 1", "if (a { }", "let x = 'open", "f(`${a`)", "a as B", "return 1", "def f():\n  pass", "{\"a\": 1, \"b\": 2}", "const = 3", "1 = x", "x = {a = 1}", "class { }", "/* never", "for (x of) {}", "catch (e) {}"],
    "typescript": ["interface A { x: }", "const x: = 1", "type T = ", "function f(): { return 1 }", "=======", "enum { A }", "let a: Map<string, = 1", "package a\n"],
    "go": ["", "package a\nfunc f() {", "package a\nfunc f( {\n}", "func f() {}", "package a\nx := 1", "package a\nvar x = \"open\n", "package a\nfunc f() {\n\tif x \n\t{\n\t}\n}\n", "package a\n<<<<<<< HEAD\n", "package a\nimport y\n", "package a\nfunc f() { x y }\n"],
    "java": ["class A {", "class A { void f() { int x = ; } }", "class A { public String f Object x) { } }", "void", "class A { void f() { x } }", "class A { String s = \"open; }", "package a", "<!DOCTYPE html>", "class A { void f() { if x { } } }", "class A { int f( { } }"],
    "rust": ["fn f( {}", "fn f() { let x = }", "struct S { x u8 }", "fn f() { match x { A => } }", "use a::b", "let x = 1;", "fn f() -> { }", "pubcrate) fn f() {}", "fn f() { r#\"open\" }", "package a;", "Some prose here. More prose."],
    "python": ["def f(:\n  pass", "x = [1,", "if x\n  y", "<<<<<<< HEAD\n", "\tx\n  y = 1\n z"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_valid(language):
    for text in GOOD[language]:
        assert G.fault(language, text) is None, text


@pytest.mark.parametrize("language", sorted(BAD))
def test_invalid(language):
    for text in BAD[language]:
        assert G.fault(language, text) is not None, text


def test_every_cut_of_a_valid_text_ends():
    """No parser hangs or raises anything of its own on truncated text."""
    for language, texts in GOOD.items():
        text = max(texts, key=len)
        for i in range(0, len(text), 3):
            G.fault(language, text[:i])


def test_deep_nesting_is_no_fault():
    deep = "(" * 30_000 + "1" + ")" * 30_000
    assert G.fault("javascript", f"x = {deep}") is None


def test_faults_in_deep_nesting_are_found():
    for language, text in (
        ("javascript", "x = " + "(" * 30_000 + "1 +* 2" + ")" * 30_000), ("python", "x = " + "-" * 100_000 + "1 1 1"), ("rust", "fn f() { let x = " + "(" * 2_000 + "1 + / 2" + ")" * 2_000 + "; }"),
        ("go", "package a\nvar x = " + "(" * 2_000 + "1 +* " + ")" * 2_000 + "\n"), ("java", "class A { int x = " + "(" * 2_000 + "1 +* 2" + ")" * 2_000 + "; }"),
    ):
        assert G.fault(language, text) not in (None, G.TOO_DEEP), language
    assert G.fault("python", "x = " + "-" * 100_000 + "1") is None


def test_what_no_parser_follows_is_no_success(monkeypatch):
    monkeypatch.setattr(G, "MOST_FRAMES", 9_000)
    assert G.fault("javascript", "x = " + "(" * 30_000 + "1" + ")" * 30_000) == G.TOO_DEEP
    assert G.foreign("python", "x = " + "(" * 30_000 + "1" + ")" * 30_000) is None


def test_foreign():
    assert G.foreign("javascript", GOOD["typescript"][0]) == "typescript"
    assert G.foreign("python", GOOD["go"][1]) == "go"
    assert G.foreign("go", "<<<<<<< HEAD {") is None


def test_language_of():
    assert [G.language_of(p) for p in ("a/B.PY", "x.tsx", "a.b/c", None, "k.rs", ".js")] == ["python", None, None, None, "rust", "javascript"]


def test_faulty_files(spark, reads):
    df = reads([
        ("r", "a.py", "x = (", "read", "2025-01-01 00:00:00"), ("r", "a.py", "x = 1", "read", "2025-01-02 00:00:00"),  # mended since
        ("r", "b.py", "x = 1", "read", "2025-01-01 00:00:00"), ("r", "b.py", "x = (", "read", "2025-01-03 00:00:00"), ("r", "b.py", None, "skipped", "2025-01-04 00:00:00"),
        ("r", "c.js", "const a: string = ''"), ("r", "d.js", "  \n"), ("r", "e.js", None), ("r", "f.md", "("), ("r", "g.go", "package g\n"), (None, "h.go", "{"), ("r", "c.js", "const a: string = ''", "read", "2024-01-01 00:00:00"),
    ])
    assert {(r.repo_id, r.path) for r in syntax.faulty_files(df).collect()} == {("r", "b.py"), ("r", "c.js"), (None, "h.go")}
    state = {r.path: (r.state, r.foreign) for r in syntax.current_syntax(df).collect()}
    assert state["c.js"] == ("wrong_extension", "typescript") and state["d.js"] == ("blank", None)
    reports = spark.createDataFrame([(1, "r", "b.py", [("parse_gap",)], "2025-01-01"), (2, "r", "g.go", None, "2025-01-01"), (3, "r", "c.js", [], None)], "report_id bigint, repo_id string, path string, diagnostics array<struct<code string>>, reported_at string")
    rates = {(r.repo_id, r.language): (r.files, r.faulty, r.hinted_faulty) for r in syntax.fault_rates(df, reports).collect()}
    assert rates == {("r", "python"): (2, 1, 1), ("r", "javascript"): (1, 1, 0), ("r", "go"): (1, 0, 0), (None, "go"): (1, 1, 0)}
    assert syntax.faulty_files(df.limit(0)).count() == 0
