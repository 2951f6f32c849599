"""Files that nobody wrote by hand in their repository: generated, minified, third-party copies, data stored as code.

Three sources of evidence, the first found names the kind:

* the path: lock files, folders of installed packages, names of minified and of generated files;
* the text's tokens: statements of generation or of origin in comments anywhere in the text, lines of one shape repeated, white
  space and name length of minified text, share of numbers and of long literals in data; a file that was too large to
  be read is data;
* other files: an inverted index of line hashes gives the exact share of a file's lines that one file of another
  repository holds (at least ``SHARE`` of them, ``SHARED`` lines; whole copies from ``LEAST`` lines on); files without text follow files of the same hash.

Containment without all pairs: files of equal line sets form one class, a class in two repositories is a copy. A class of
one repository can be contained elsewhere only if enough of its lines occur elsewhere at all; that is one aggregate over
lines. The few survivors probe the index with their rarest lines (prefix filter: any container must share one of them),
first against at most ``FIRST`` classes a line, those left over against all. Candidates are verified on whole line sets.

Defined results: the newest scan of a file counts, its newest read with status ``read`` gives the text; null language,
size or flag is allowed; configuration and docs are no cases but for lock files; repeated rows count once; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import first_rows
from ..session import map_arrow, work_path
from .reads import extension, newest

CODE = ("py", "ts", "js", "rs", "go", "java", "tsx", "jsx", "mjs", "cjs", "kt", "c", "cc", "h", "cpp", "cs", "rb", "php", "swift", "scala")
LOCKS = r"(?i)(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|cargo\.lock|poetry\.lock|pipfile\.lock|composer\.lock|gemfile\.lock|go\.sum|uv\.lock|bun\.lockb?|packages\.lock\.json|podfile\.lock|pubspec\.lock|mix\.lock|flake\.lock|gradle\.lockfile)$"
VENDORED = r"(?:^|/)(?:(?:node_modules|bower_components|site-packages|dist-packages|third[_-]?party|vendor(?:ed)?)/.+|(?:extern/libs|externals?|extern|deps|libs)/[^/]+/.+)$"
MINIFIED = r"(?i)[.\-]min\.(?:js|mjs|cjs)$"
GENERATED_NAME = r"(?:\.pb\.(?:go|cc|h)|_pb2(?:_grpc)?\.py|_pb\.(?:js|ts|d\.ts)|\.pb\.(?:js|ts)|\.g\.(?:ts|dart|cs)|[a-z]Proto\.java|OuterClass\.java|_gen\.(?:rs|go|ts|py)|\.gen\.(?:go|ts|rs)|\.generated\.\w+|_generated\.\w+|\.designer\.cs)$"
BUNDLE_NAME = r"(?:\.bundle\.js|-all\.js|\.[0-9a-f]{8}\.js)$"
OVERSIZED = 1_000_000

SHARE, LEAST, SHARED, FIRST, LINE = 0.6, 8, 12, 32, 8

COMMENT = re.compile(r"^\s*(?://+!?|#+!?|/\*+!?|\*+|--|;+|<!--|\"\"\"|''')\s*(.*?)\s*(?:\*+/|-->|\"\"\"|''')?\s*$")
#: What makes files: a word with ``gen``, ``compiler`` and the like in it, or a name with a version.
MAKER = r"(?:the )?(?:[\w.@/-]*(?:gen|codegen|generator|compiler|protoc|bindings?|stringer|builder|transpiler|bundler)[\w.@/-]*|[\w.@/-]+ v?\d+\.\d[\w.]*)"
GENERATED_HEAD = re.compile(
    r"code generated (?:by|from)\b|^@generated\b|@generated (?:by|from)\b|\bauto-?\s?generated\b|automatically generated|^generated (?:by|from|with|using)\b|this (?:file|code|module|source)\b.{0,40}\b(?:generated|produced automatically|created automatically|machine.made)"
    r"|\b(?:machine|tool)[ -](?:made|generated|produced|written|created|emitted)\b|do not (?:edit|modify)(?: by hand| manually|\.|!|$)|(?:never|don'?t|do not) hand[ -]?(?:edit|modify)|(?:manual )?(?:changes|edits) (?:are|will be) (?:lost|overwritten)"
    rf"|generated by .{{1,60}}(?:compiler|generator|do not edit)|\b(?:produced|emitted|created|written|made|output) (?:automatically )?(?:by|with|using) {MAKER}(?![\w.])|\bre-?generate (?:this|it|the file|with|by|using)\b|\bre-?generate[,;] ",
    re.IGNORECASE,
)
GENERATED_NOT = re.compile(r"\bnot (?:auto-?|machine[ -])?(?:generated|produced|made)\b", re.IGNORECASE)
#: Statements that speak of a whole file wherever they stand.
GENERATED_FILE = re.compile(
    r"code generated (?:by|from)\b|^@generated\b|^<auto-?generated\b|^auto-?\s?generated (?:file\b|code\b|by\b|from\b|on build\b)|^generated (?:by|from|with|using)\b.{1,80}(?:compiler|generator|do not (?:edit|modify)|source:)"
    r"|^this (?:file|module|source)\b.{0,40}\b(?:generated|produced automatically|created automatically|machine.made)|^machine.(?:made|generated) (?:by|from)\b",
    re.IGNORECASE,
)
VENDORED_HEAD = re.compile(
    r"\b(?:vendored|copied|taken|imported|forked)(?: \w+)? from\b.*\d|third.party code|^origin:.*\b(?:release|version|v?\d+\.\d+)"
    # a library's banner: its name and version, with a licence, a site or what it is
    r"|^(?:@(?:license|preserve)\s+)?[a-z@][\w .@/-]{1,60}?\s+v?\d+\.\d+(?:\.\d+)?\b.*(?:licen[cs]ed?\b|\(c\)|copyright|https?://)|^(?:@(?:license|preserve)\s+)?[\w .@/-]{2,60}\b(?:library|framework|plugin|polyfill|toolkit),? v?\d+\.\d+",
    re.IGNORECASE,
)
#: Of these every statement of origin holds one; a text without it has none.
TOLD = (
    "generate", "machine", "tool-", "tool ", "produced", "emitted", "created", "written", "made", "output", " automatically", "do not edit", "do not modify", "hand", "changes are", "changes will be", "edits are", "edits will be", "vendored", "copied", "taken", "imported", "forked", "third", "origin:",
    "license", "licence", "(c)", "copyright", "http", "library", "framework", "plugin", "polyfill", "toolkit",
)
#: Lines that stand before the code proper.
PROLOGUE = re.compile(r"#!|[\"']use \w+[\"'];?$|<\?php|(?:package|import|from|use|using|namespace|mod|extern crate|require|#include|#pragma|#ifndef|#define|#!?\[)\b|[()]$|\"[\w./-]+\"$")
OPENED_RAW = re.compile(r'\br#"(?!.*"#)')
NAME, LONG, DIGITS = re.compile(r"[A-Za-z_]\w*"), re.compile(r"[A-Za-z0-9+/=]{60,}"), re.compile(r"\d+")
ARMORED = re.compile(r"-----BEGIN [A-Z ]+-----")


def remarks(lines: list[str]) -> Iterator[tuple[int, str]]:
    """Place and wording of every comment line, block comments and leading strings included, but none inside of literals."""
    closing, comment = "", False
    for i, line in enumerate(lines):
        if closing:
            if comment:
                yield i, line.split(closing)[0].lstrip("*! \t").strip()
            if line.count(closing) % 2:
                closing = ""
        elif line.startswith("/*") and "*/" not in line:
            closing, comment = "*/", True
            yield i, line.lstrip("/*! \t")
        elif (mark := line[:3]) in ('"""', "'''") and line.count(mark) == 1:
            closing, comment = mark, True
            yield i, line[3:].strip()
        elif m := COMMENT.match(line):
            yield i, m.group(1)
        else:
            closing = '"#' if OPENED_RAW.search(line) else next((q for q in ('"""', "'''", "`") if line.count(q) % 2), "")
            comment = False


def comment_kind(lines: list[str]) -> str | None:
    """What the comments of a text say of its origin.

    Above the code and below it they speak of the file, whatever their wording; between code only statements that name
    the file or its generator do, since others ("do not modify", "copied from") are about the lines beside them.
    """
    said = dict(remarks(lines))
    head = next((i for i, x in enumerate(lines) if i not in said and not PROLOGUE.match(x)), len(lines))
    tail = len(lines)
    # comment lines at the end stand in no literal: that would have to be closed behind them
    while tail > head and (m := COMMENT.match(lines[tail - 1])):
        tail -= 1
        said[tail] = m.group(1)
    for i in sorted(said):
        text, outer = said[i], i < head or i >= tail
        if (GENERATED_HEAD if outer else GENERATED_FILE).search(text) and not GENERATED_NOT.search(text):
            return "generated"
        if outer and VENDORED_HEAD.search(text) and not text.lower().startswith("never "):
            return "vendored"
    return None


def text_kind(text: str) -> str | None:
    """The kind that a source text's head and token composition show, if any."""
    text = text.lstrip("﻿")
    lines = [s for x in text.split("\n") if (s := x.strip())]
    if not lines:
        return None
    low = text.lower()
    if any(w in low for w in TOLD) and (said := comment_kind(lines)):
        return said
    n = len(text)
    space = sum(map(text.count, " \n\t\r")) / n
    numbers = sum(map(text.count, "0123456789,")) / n
    literals = sum(len(x) for x in LONG.findall(text)) / n
    if numbers > 0.6 or (literals > 0.75 and not ARMORED.search(text)):
        return "data"
    names = NAME.findall(text)
    if space < 0.08 and n > 300 and names and sum(map(len, names)) / len(names) < 4:
        return "minified"
    if len(lines) >= 8 and 1 - len({DIGITS.sub("0", s) for s in lines}) / len(lines) >= 0.65:
        return "generated"
    return None


def line_hashes(text: str) -> list[int]:
    """Sorted distinct 64-bit hashes of a text's telling lines, white space made alike."""
    out = set()
    for x in text.lstrip("﻿").split("\n"):
        s = " ".join(x.split())
        if len(s) >= LINE and any(c.isalnum() for c in s):
            out.add(xxhash.xxh64_intdigest(s) - (1 << 63))
    return sorted(out)


def read_features(reads: DataFrame) -> DataFrame:
    """Per read of a code file: repo_id, path, read_at, read_id, text_kind, lines, blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(4).to_pylist()]
            kinds, lines = [text_kind(t) for t in texts], [line_hashes(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(kinds, pa.string()), pa.array(lines, pa.list_(pa.int64())), pa.array([not t.strip() for t in texts])],
                names=["repo_id", "path", "read_at", "read_id", "text_kind", "lines", "blank"],
            )

    rows = reads.filter((F.col("status") == "read") & extension().isin(*CODE))
    rows = rows.select("repo_id", "path", F.col("read_at").cast("timestamp").alias("read_at"), F.col("read_id").cast("bigint").alias("read_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "repo_id string, path string, read_at timestamp, read_id bigint, text_kind string, lines array<bigint>, blank boolean")


def _same_file(a: DataFrame, b: DataFrame) -> Column:
    return a["repo_id"].eqNullSafe(b["_repo"]) & a["path"].eqNullSafe(b["_path"])


def current_files(files: DataFrame, reads: DataFrame) -> DataFrame:
    """repo_id, path, size_bytes, hash, code, path_kind, text_kind, lines, blank, has_text: a row per current file."""
    scan = files.groupBy("repo_id", "path").agg(F.max_by(F.struct("size_bytes", "hash"), newest("scanned_at", "hash")).alias("_f")).select("repo_id", "path", "_f.*")
    read = read_features(reads).groupBy("repo_id", "path").agg(F.max_by(F.struct("text_kind", "lines", "blank"), newest("read_at", "read_id")).alias("_t"))
    read = read.select(F.col("repo_id").alias("_repo"), F.col("path").alias("_path"), "_t.*", F.lit(True).alias("_read"))
    large = reads.filter("reason = 'oversized'").select(F.col("repo_id").alias("_lr"), F.col("path").alias("_lp"), F.lit(True).alias("_large")).distinct()
    code, path = extension().isin(*CODE), F.col("path")
    kind = (
        F.when(path.rlike(LOCKS), "lock")
        .when(code & path.rlike(VENDORED), "vendored")
        .when(code & path.rlike(MINIFIED), "minified")
        .when(code & path.rlike(GENERATED_NAME), "generated")
        .when(code & F.col("_read").isNull() & path.rlike(BUNDLE_NAME), "minified")
        .when(code & F.col("_read").isNull() & (F.coalesce(F.col("size_bytes") >= OVERSIZED, F.lit(False)) | F.col("_large").isNotNull()), "data")
    )
    both = scan.join(read, _same_file(scan, read), "left").join(large, scan["repo_id"].eqNullSafe(F.col("_lr")) & scan["path"].eqNullSafe(F.col("_lp")), "left")
    return both.select(
        "repo_id", "path", "size_bytes", "hash", code.alias("code"), kind.alias("path_kind"), "text_kind", "lines", F.coalesce("blank", F.lit(False)).alias("blank"), F.col("_read").isNotNull().alias("has_text")
    )


def copied_classes(rows: DataFrame, share: float = SHARE, least: int = LEAST, shared_least: int = SHARED, first: int = FIRST) -> DataFrame:
    """Classes (``cls``, a hash of the line set) that lie in another repository too, wholly or by ``share`` of their lines.

    rows: repo_id, lines (sorted distinct hashes), as many rows as files.
    """
    spark = rows.sparkSession
    n = F.size("lines")
    classes = (
        rows.filter(n >= least)
        .withColumn("cls", F.xxhash64("lines"))
        .groupBy("cls")
        .agg(F.min("repo_id").alias("lo"), F.max("repo_id").alias("hi"), F.max("lines").alias("lines"))
        .withColumn("n", F.size("lines"))
    )
    at = work_path(spark, "classes")
    classes.write.parquet(at)
    classes = spark.read.parquet(at)
    twins = classes.filter("lo <> hi").select("cls")

    index = classes.select("cls", "lo", "hi", "n", F.explode("lines").alias("h"))
    spread = index.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("lo").alias("l"), F.max("hi").alias("r"))
    shared = spread.filter("l <> r").select("h", "df")
    alone = index.filter("lo = hi").join(shared, "h").groupBy("cls", "lo", "n").agg(F.count(F.lit(1)).alias("s"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("by"))
    # a container must share one of the n - ceil(share * n) + 1 rarest lines; n - s of the lines occur nowhere else
    need = F.ceil(F.lit(share) * F.col("n"))
    alone = alone.filter((F.col("s") >= need) & (F.col("s") >= shared_least))
    probes = alone.select(F.col("cls").alias("a"), F.col("lo").alias("a_repo"), need.alias("a_need"), F.explode(F.slice("by", F.lit(1), (F.col("s") - need + 1).cast("int"))).alias("_p")).select("a", "a_repo", "a_need", F.col("_p.df").alias("df"), F.col("_p.h").alias("h"))
    at = work_path(spark, "probes")
    probes.write.parquet(at)
    probes = spark.read.parquet(at)

    def verified(pairs: DataFrame) -> DataFrame:
        left = classes.select(F.col("cls").alias("a"), F.col("lines").alias("la"), F.col("n").alias("na"))
        right = classes.select(F.col("cls").alias("b"), F.col("lines").alias("lb"))
        both = F.size(F.array_intersect("la", "lb"))
        near = pairs.distinct().join(left, "a").join(right, "b").filter((both >= F.ceil(F.lit(share) * F.col("na"))) & (both >= shared_least))
        return near.select(F.col("a").alias("cls")).distinct()

    wanted = index.join(probes.select("h").distinct(), "h", "left_semi")
    other = (F.col("lo") != F.col("a_repo")) | (F.col("hi") != F.col("a_repo"))
    # the first classes of a line in the order of their hash, per part of the line's classes, so that no task holds a hot line
    part = F.pmod(F.col("cls"), F.lit(16))
    few = first_rows(wanted.withColumn("_part", part), ["h", "_part"], [F.asc("cls")], first).select("h", "cls", "lo", "hi", "n")
    # a container is as long as what it must share
    fits = (F.col("a") != F.col("cls")) & other & (F.col("n") >= F.col("a_need"))
    found = verified(probes.join(few, "h").filter(fits).select("a", F.col("cls").alias("b")))
    at = work_path(spark, "contained")
    found.write.parquet(at)
    found = spark.read.parquet(at)
    rest = probes.filter(F.col("df") > first).join(found.select(F.col("cls").alias("a")), "a", "left_anti")
    late = verified(rest.join(index, "h").filter(fits).select("a", F.col("cls").alias("b")))
    return twins.unionByName(found).unionByName(late).distinct()


def foreign_files(files: DataFrame, reads: DataFrame) -> DataFrame:
    """repo_id, path, kind of every file that nobody wrote by hand in its repository."""
    spark = files.sparkSession
    at = work_path(spark, "files")
    current_files(files, reads).withColumn("cls", F.when(F.size("lines") >= LEAST, F.xxhash64("lines"))).write.parquet(at)
    now = spark.read.parquet(at)
    # only hand-looking texts need a container; vendored ones serve as containers; other kinds repeat by nature
    plain = now.filter("code and has_text and not blank and (text_kind is null or text_kind = 'vendored') and (path_kind is null or path_kind = 'vendored')")
    copies = copied_classes(plain.select("repo_id", "lines")).withColumn("_copy", F.lit(True))
    known = now.join(copies, "cls", "left").withColumn("kind", F.coalesce("path_kind", "text_kind", F.when(F.col("code") & F.col("_copy") & ~F.col("blank"), "vendored")))
    known = known.select("repo_id", "path", "hash", "size_bytes", "code", "blank", "has_text", "kind")
    # files without text: what others of the same content are
    untold = known.filter("kind is null and code and not has_text and hash is not null and coalesce(size_bytes, 1) > 0")
    told = (
        known.filter("code and hash is not null")
        .groupBy("hash")
        .agg(F.min("repo_id").alias("_lo"), F.max("repo_id").alias("_hi"), F.min("kind").alias("_kind"), F.bool_or(F.col("blank") | (F.col("size_bytes") == 0)).alias("_blank"))
        .filter("not coalesce(_blank, false) and (_kind is not null or _lo <> _hi)")
        .select("hash", F.coalesce("_kind", F.lit("vendored")).alias("kind"))
    )
    return known.filter("kind is not null and (code or kind = 'lock')").select("repo_id", "path", "kind").unionByName(untold.drop("kind").join(told, "hash").select("repo_id", "path", "kind"))
