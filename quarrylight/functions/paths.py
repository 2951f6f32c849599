"""Expressions over repository paths: role, language, area, family, stems and paths named in a text.

Each rule is a list of fixed values and a builder, so that the same lists give the Spark expression and the SQL text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Which path is of which role, by the whole last part, its start, its end, or anything in the path.
SENSITIVE = {
    "names": [".env", ".npmrc", ".yarnrc.yml", ".pypirc", ".netrc", "id_rsa", "id_ed25519", "credentials", "terraform.tfstate", "serviceaccountkey.json"],
    "starts": [".env."],
    "ends": [".pem", ".key", ".p12", ".pfx", ".crt", ".cer", ".dump", ".sql.gz", ".tfstate"],
    "in_name": ["firebase-adminsdk"],
    "in_path": ["/.env.", "/.ssh/", "secret", "credentials"],
    "path_starts": [".ssh/"],
}
GENERATED = {
    "names": ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "cargo.lock"],
    "ends": [".min.js", ".min.css"],
    "dirs": ["node_modules", ".gradle", ".fastembed_cache", "src/main 2", "src/test 2", "target", "dist", "build", "coverage", "vendor"],
    "in_path": ["/build "],
    "path_starts": ["build "],
}
TEST = {"dirs": ["tests", "test", "spec"], "in_name": [".test.", ".spec."], "ends": ["_test.go", "_test.py"], "starts": ["test_"]}
SCHEMA = {"in_path": ["/migrations/", "/schema/"], "ends": [".graphql", ".graphqls", ".proto", ".prisma", ".sql"]}
CONFIG = {
    "names": ["package.json", "pyproject.toml", "cargo.toml", "go.mod", "go.sum", "tsconfig.json", "vite.config.ts", "next.config.js", "dockerfile", "compose.yaml", "docker-compose.yml"],
    "path_ends": [".config.js", ".config.ts", ".toml", ".yaml", ".yml"],
}
DOCS = {"path_starts": ["docs/"], "names": ["readme.md", "agents.md"], "ends": [".md", ".mdx", ".rst", ".txt"]}
LANGUAGES = {
    "rust": ["rs"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx", "mjs", "cjs"], "python": ["py"], "go": ["go"], "java": ["java"], "kotlin": ["kt", "kts"], "scala": ["scala"], "csharp": ["cs"], "ruby": ["rb"], "php": ["php"], "dart": ["dart"],
    "c": ["c", "h"], "cpp": ["cc", "cpp", "cxx", "hpp"], "swift": ["swift"], "sql": ["sql"],
}
#: Extensions that make a token with a slash an explicit path (fixed values).
NAMED_EXTENSIONS = [".c", ".cc", ".cpp", ".cs", ".css", ".go", ".h", ".hpp", ".html", ".java", ".js", ".json", ".jsx", ".kt", ".md", ".mjs", ".php", ".py", ".rb", ".rs", ".scala", ".swift", ".toml", ".ts", ".tsx", ".yaml", ".yml"]
ROLES = (("sensitive", SENSITIVE), ("generated", GENERATED), ("test", TEST), ("schema", SCHEMA), ("config", CONFIG), ("docs", DOCS))


def pattern(rule: dict[str, list[str]]) -> str:
    """One regular expression (of both engines) for a rule, over a lower-case path."""
    e = lambda xs: "|".join(re.sub(r"([.+*?^$()\[\]{}|\\-])", r"\\\1", x) for x in xs)
    forms = {
        "names": "(?:^|/)(?:{})$", "starts": "(?:^|/)(?:{})[^/]*$", "ends": "(?:{})$", "in_name": "(?:{})[^/]*$", "in_path": "(?:{})", "path_starts": "^(?:{})", "path_ends": "(?:{})$", "dirs": "(?:^|/)(?:{})/",
    }
    return "|".join(forms[k].format(e(v)) for k, v in rule.items())


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def normal_path(path: Column) -> Column:
    """A changed path as the file table writes it: no outer blanks, forward slashes, no leading ``./``; empty is null."""
    clean = F.regexp_replace(F.translate(F.trim(path), "\\", "/"), r"^(\./+)+", "")
    return F.when(clean != "", clean)


def language(path: Column) -> Column:
    """The language of an extension, null without one."""
    known = F.create_map(*[F.lit(x) for name, exts in LANGUAGES.items() for e in exts for x in (e, name)])
    return F.try_element_at(known, F.regexp_extract(ascii_lower(path), r"\.([^./]+)$", 1))


def role(path: Column) -> Column:
    """sensitive, generated, test, schema, config, docs, source or unknown: the first rule that holds."""
    low = ascii_lower(path)
    out = None
    for name, rule in ROLES:
        hit = low.rlike(pattern(rule))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(language(path).isNotNull(), "source").otherwise("unknown")


def area(path: Column) -> Column:
    """The context area: two parts of a dotted root, ``.`` of a root file, a package below a JVM root, else two parts."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    join = lambda k: F.array_join(F.slice(parts, 1, k), "/")
    jvm = F.array_join(F.slice(parts, 1, 3), "/").isin("src/main/java", "src/test/java", "src/main/kotlin", "src/test/kotlin")
    depth = F.greatest(F.lit(0), n - 4)
    return (
        F.when(n == 0, ".")
        .when(F.startswith(F.element_at(parts, 1), F.lit(".")), join(2))
        .when(n == 1, ".")
        .when((n == 2) & F.contains(F.element_at(parts, 2), F.lit(".")), F.element_at(parts, 1))
        .when(jvm & (n >= 3), F.array_join(F.slice(parts, F.lit(1), (F.lit(3) + F.least(depth, F.lit(4))).cast("int")), "/"))
        .otherwise(join(2))
    )


def family(path: Column) -> Column:
    """``parent/*.ext`` of a path."""
    return F.concat(F.regexp_replace(path, r"[^/]*$", ""), F.lit("*"), F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    """The last part without extension and without what marks a test."""
    name = F.regexp_replace(ascii_lower(F.regexp_extract(path, r"([^/]+)$", 1)), r"\.[^.]*$", "")
    return F.regexp_replace(name, r"^test_|_test$|\.test$|\.spec$|(?:test|tests)$", "")


def explicit_paths(text: Column) -> Column:
    """Sorted distinct path tokens of a text that hold a slash and end with a known extension."""
    marks = r"!\"#$%&'()*+,;<=>?@\[\]^`{|}~"
    clean = lambda t: ascii_lower(F.regexp_replace(F.regexp_replace(F.translate(F.regexp_replace(t, f"^[{marks}]+|[{marks}]+$", ""), "\\", "/"), r"([^:]):+$", "$1"), r"^(?:\./)+", ""))
    known = "(?:" + "|".join(x.replace(".", r"\.") for x in NAMED_EXTENSIONS) + ")$"
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), clean), lambda p: F.contains(p, F.lit("/")) & p.rlike(known))))


# -- the same rules as SQL text


def lower_sql(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def language_sql(path: str) -> str:
    ext = rf"regexp_extract({lower_sql(path)}, '\.([^./]+)$', 1)"
    return "CASE " + " ".join(f"WHEN {ext} IN ({', '.join(repr(e) for e in v)}) THEN '{k}'" for k, v in LANGUAGES.items()) + " END"


def role_sql(path: str) -> str:
    low = lower_sql(path)
    return "CASE " + " ".join(f"WHEN regexp_matches({low}, '{pattern(r)}') THEN '{n}'" for n, r in ROLES) + f" WHEN ({language_sql(path)}) IS NOT NULL THEN 'source' ELSE 'unknown' END"


def area_sql(path: str) -> str:
    p = f"list_filter(string_split({path}, '/'), lambda x: x <> '')"
    j = lambda k: f"array_to_string(({p})[1:{k}], '/')"
    n = f"len({p})"
    return (
        f"CASE WHEN {n} = 0 THEN '.' WHEN starts_with(({p})[1], '.') THEN {j(2)} WHEN {n} = 1 THEN '.' WHEN {n} = 2 AND contains(({p})[2], '.') THEN ({p})[1]"
        f" WHEN {n} >= 3 AND {j(3)} IN ('src/main/java','src/test/java','src/main/kotlin','src/test/kotlin') THEN array_to_string(({p})[1:3 + least(greatest(0, {n} - 4), 4)], '/') ELSE {j(2)} END"
    )


def family_sql(path: str) -> str:
    return rf"regexp_replace({path}, '[^/]*$', '') || '*' || regexp_extract({path}, '(\.[^./]+)$', 1)"


def stem_sql(path: str) -> str:
    return rf"regexp_replace(regexp_replace({lower_sql(f'regexp_extract({path}, {chr(39)}([^/]+)${chr(39)}, 1)')}, '\.[^.]*$', ''), '^test_|_test$|\.test$|\.spec$|(?:test|tests)$', '', 'g')"
