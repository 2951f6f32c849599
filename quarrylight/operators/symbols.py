"""Symbols and imports by line scanners: patterns per language, over the lines of a text, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: language, kind, pattern of a line with the name as group 1; the first that matches a line counts.
SYMBOLS = [
    ("python", "method", r"^\s+(?:async )?def ([A-Za-z_]\w*)"), ("python", "function", r"^(?:async )?def ([A-Za-z_]\w*)"), ("python", "class", r"^\s*class ([A-Za-z_]\w*)"),
    ("javascript", "class", r"^\s*(?:export )?(?:default )?class ([A-Za-z_$][\w$]*)"), ("javascript", "function", r"^\s*(?:export )?(?:default )?(?:async )?function\*? ([A-Za-z_$][\w$]*)"), ("javascript", "function", r"^\s*(?:export )?const ([A-Za-z_$][\w$]*) = (?:async )?(?:\([^)]*\)|[A-Za-z_$][\w$]*) =>"),
    ("typescript", "class", r"^\s*(?:export )?(?:default )?(?:abstract )?class ([A-Za-z_$][\w$]*)"), ("typescript", "interface", r"^\s*(?:export )?interface ([A-Za-z_$][\w$]*)"), ("typescript", "type", r"^\s*(?:export )?type ([A-Za-z_$][\w$]*)\b.*="), ("typescript", "enum", r"^\s*(?:export )?(?:const )?enum ([A-Za-z_$][\w$]*)"),
    ("typescript", "function", r"^\s*(?:export )?(?:default )?(?:async )?function\*? ([A-Za-z_$][\w$]*)"), ("typescript", "function", r"^\s*(?:export )?const ([A-Za-z_$][\w$]*)[^=]* = (?:async )?\([^=]*=>"),
    ("rust", "function", r"^\s*(?:pub(?:\([^)]*\))? )?(?:async |const |unsafe )*fn ([A-Za-z_]\w*)"), ("rust", "struct", r"^\s*(?:pub(?:\([^)]*\))? )?struct ([A-Za-z_]\w*)"), ("rust", "enum", r"^\s*(?:pub(?:\([^)]*\))? )?enum ([A-Za-z_]\w*)"), ("rust", "trait", r"^\s*(?:pub(?:\([^)]*\))? )?trait ([A-Za-z_]\w*)"), ("rust", "type", r"^\s*(?:pub(?:\([^)]*\))? )?type ([A-Za-z_]\w*)"), ("rust", "module", r"^\s*(?:pub(?:\([^)]*\))? )?mod ([A-Za-z_]\w*)"),
    ("go", "method", r"^func \([^)]*\) ([A-Za-z_]\w*)"), ("go", "function", r"^func ([A-Za-z_]\w*)"), ("go", "interface", r"^type ([A-Za-z_]\w*) interface\b"), ("go", "struct", r"^type ([A-Za-z_]\w*) struct\b"), ("go", "type", r"^type ([A-Za-z_]\w*) "),
    ("java", "class", r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed) )*class ([A-Za-z_]\w*)"), ("java", "interface", r"^\s*(?:(?:public|private|protected|static) )*interface ([A-Za-z_]\w*)"), ("java", "enum", r"^\s*(?:(?:public|private|protected|static) )*enum ([A-Za-z_]\w*)"),
    ("java", "method", r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|default) )+(?:<[^>]+> )?[\w<>\[\], ?.]+ ([A-Za-z_]\w*)\("),
    ("kotlin", "function", r"^\s*(?:(?:public|private|internal|protected|override|suspend|inline|open) )*fun (?:<[^>]+> )?([A-Za-z_]\w*)"), ("kotlin", "class", r"^\s*(?:(?:public|private|internal|data|sealed|open|abstract|enum) )*class ([A-Za-z_]\w*)"),
]
EXPORTED = {"python": r"^(?:async )?(?:def|class) [^_]", "javascript": r"^\s*export ", "typescript": r"^\s*export ", "rust": r"^\s*pub", "go": r"^(?:func (?:\([^)]*\) )?|type )[A-Z]", "java": r"^\s*public ", "kotlin": r"^\s*(?!private )\w"}
#: language, pattern of an imported name, confidence (fixed values).
IMPORTS = [
    ("javascript", r"^\s*(?:import|export)\b[^'\"]*from ['\"]([^'\"]+)['\"]", 0.95), ("javascript", r"^\s*import ['\"]([^'\"]+)['\"]", 0.9), ("javascript", r"require\(['\"]([^'\"]+)['\"]\)", 0.8),
    ("typescript", r"^\s*(?:import|export)\b[^'\"]*from ['\"]([^'\"]+)['\"]", 0.95), ("typescript", r"^\s*import ['\"]([^'\"]+)['\"]", 0.9), ("typescript", r"require\(['\"]([^'\"]+)['\"]\)", 0.8),
    ("python", r"^\s*from ([.\w]+) import ", 0.9), ("python", r"^\s*import ([.\w]+)", 0.75), ("rust", r"^\s*(?:pub )?mod (\w+);", 0.9), ("rust", r"^\s*(?:pub )?use ((?:crate|super)(?:::\w+)+)", 0.7), ("java", r"^\s*import (?:static )?([\w.]+);", 0.9), ("kotlin", r"^\s*import ([\w.]+)$", 0.9), ("go", r"^\s*import (?:\w+ )?\"([^\"]+)\"", 0.9),
]


def lines(docs: DataFrame, text: str = "content") -> DataFrame:
    """repo_id, path, language, line_no (from 1), line of every text."""
    rows = docs.select("repo_id", "path", "language", F.posexplode(F.split(F.col(text), "\r?\n")).alias("at", "line"))
    return rows.select("repo_id", "path", "language", (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


def _first(rules: list[tuple], value) -> Column:
    out = None
    for rule in rules:
        hit = (F.col("language") == rule[0]) & F.col("line").rlike(rule[-1] if isinstance(rule[-1], str) else rule[1])
        out = F.when(hit, value(rule)) if out is None else out.when(hit, value(rule))
    return out


def symbols(docs: DataFrame, text: str = "content") -> DataFrame:
    """Distinct symbols: repo_id, path, language, name, kind, line_no, signature (200 characters), exported."""
    rows = lines(docs, text).filter(F.col("line").rlike(r"\b(?:def|class|function|const|interface|type|enum|fn|struct|trait|mod|func|fun)\b|\("))
    found = _first(SYMBOLS, lambda r: F.struct(F.lit(r[1]).alias("kind"), F.regexp_extract("line", r[2], 1).alias("name")))
    public = F.lit(False)
    for k, v in EXPORTED.items():
        public = F.when(F.col("language") == k, F.col("line").rlike(v)).otherwise(public)
    rows = rows.withColumn("f", found).filter("f is not null and f.name <> ''")
    return rows.select("repo_id", "path", "language", "f.name", "f.kind", "line_no", F.substring(F.trim("line"), 1, 200).alias("signature"), public.alias("exported")).dropDuplicates(["repo_id", "path", "name", "kind", "line_no"])


def references(docs: DataFrame, found: DataFrame, text: str = "content") -> DataFrame:
    """Edges to the symbols that other files of a repository name: repo_id, source_path, target_path, symbol, kind, confidence.

    found: rows of ``symbols``. The distinct identifiers of a text meet the symbols by equality; whether a name is called
    (``name(``, ``name::``) is told where the text is read, so that no text is moved. A name with ``$`` counts as a whole
    run of letters and ``$``. Of symbols of one name in a file the first decides whether it is exported.
    """
    name = F.col("name")
    named = found.filter((F.length(name) >= 3) & (F.col("exported") | (F.length(name) >= 4)))
    named = named.groupBy("repo_id", F.col("path").alias("target_path"), name.alias("symbol")).agg(F.min_by("exported", F.struct("line_no", "kind")).alias("exported"))
    body = F.coalesce(F.col(text), F.lit(""))
    every = lambda p, g: F.array_distinct(F.regexp_extract_all(body, F.lit(p), F.lit(g)))
    terms = F.array_union(every("([A-Za-z0-9_]+)", 1), every(r"([A-Za-z0-9_$]*\$[A-Za-z0-9_$]*)", 1))
    rows = docs.select("repo_id", F.col("path").alias("source_path"), terms.alias("terms"), every(r"([A-Za-z0-9_$]+)\(", 1).alias("calls"), every(r"([A-Za-z0-9_$]+)::", 1).alias("scopes"))
    ends = lambda of: lambda t: F.exists(of, lambda c: F.endswith(c, t))
    rows = rows.select("repo_id", "source_path", F.explode(F.transform(F.filter("terms", lambda t: F.length(t) >= 3), lambda t: F.struct(t.alias("symbol"), ends("calls")(t).alias("called"), ends("scopes")(t).alias("scoped")))).alias("t"))
    hit = rows.select("repo_id", "source_path", "t.*").join(named, ["repo_id", "symbol"]).filter("source_path <> target_path")
    kind = F.when(F.col("called") | F.col("scoped"), "calls").otherwise("references")
    return hit.select("repo_id", "source_path", "target_path", "symbol", kind.alias("kind"), F.when(F.col("called"), 0.82).when(F.col("exported"), 0.72).otherwise(0.58).alias("confidence"))


def imports(docs: DataFrame, text: str = "content") -> DataFrame:
    """Distinct imports: repo_id, source_path, language, raw, confidence (the highest of its lines)."""
    rows = lines(docs, text).filter(F.col("line").rlike(r"import|require|export|\buse\b|\bmod\b"))
    found = _first(IMPORTS, lambda r: F.struct(F.regexp_extract("line", r[1], 1).alias("raw"), F.lit(r[2]).alias("confidence")))
    rows = rows.withColumn("f", found).filter("f is not null and f.raw <> ''")
    return rows.groupBy("repo_id", F.col("path").alias("source_path"), "language", F.col("f.raw").alias("raw")).agg(F.max("f.confidence").alias("confidence"))


def import_candidates(source: Column, raw: Column, language: Column) -> Column:
    """Ordered candidate paths of an import: relative ones from the source's directory, names as paths."""
    folder = F.filter(F.split(F.regexp_replace(source, "/?[^/]*$", ""), "/"), lambda x: x != "")
    ups = F.size(F.regexp_extract_all(raw, F.lit(r"(\.\./)"), 1))
    bare = F.regexp_replace(raw, r"^(?:\.\.?/)+", "")
    base = F.array_join(F.concat(F.slice(folder, F.lit(1), F.greatest(F.lit(0), F.size(folder) - ups)), F.split(bare, "/")), "/")
    scripts = F.transform(F.array(*[F.lit(e) for e in ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")]), lambda e: F.concat(base, e))
    dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    name = F.translate(F.regexp_replace(raw, r"^\.+", ""), ".", "/")
    up = F.array_join(F.slice(folder, F.lit(1), F.greatest(F.lit(0), F.size(folder) - dots + 1)), "/")
    module = F.when(dots > 0, F.concat(up, F.lit("/"), name)).otherwise(name)
    python = F.transform(F.array(F.lit(".py"), F.lit("/__init__.py")), lambda e: F.concat(module, e))
    crate = F.regexp_replace(F.regexp_replace(raw, "^(?:crate|super)::", ""), "::", "/")
    rust = F.array(F.concat(crate, F.lit(".rs")), F.concat(crate, F.lit("/mod.rs")), F.concat(F.regexp_replace(crate, "/[^/]*$", ""), F.lit(".rs")))
    java = F.array(F.concat(F.translate(raw, ".", "/"), F.lit(".java")), F.concat(F.translate(raw, ".", "/"), F.lit(".kt")))
    return F.when(language.isin("javascript", "typescript") & F.startswith(raw, F.lit(".")), scripts).when(language == "python", python).when(language == "rust", rust).when(language.isin("java", "kotlin"), java).otherwise(F.array(F.lit("")))
