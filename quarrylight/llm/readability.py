"""The reading level of running prose, from 1 (easiest) to 5.

Method: per document the smallest frequency-ranked vocabulary that covers ``SHARE`` of its words (its coverage rank), and
sentence complexity (words per sentence); both are calibrated on annotated documents in SQL.

Words are ranked per language by how many short sentences (up to ``SHORT`` words) hold them, then by their count in all
text: long sentences of demanding texts would otherwise make rare words look common. Ranks come from a histogram of
counts, not from a sort of the vocabulary; words of equal counts share a rank. The logarithms of both measures are set
against their mean, spread and quantiles within the document's language, which makes languages comparable that have few
labels, and the level is the rounded least-squares fit (a cubic) of the annotators' mean, over all languages and drawn
from there to each language's own labels. The fit needs one aggregate row of sums a language.

The rank table is written once. Its ``KNOWN`` first words a language, a table of bounded size, are broadcast and cover
almost all documents; a document whose share lies beyond them goes on with its words, which meet the whole table in a
join on (language, word): the same measure, whatever the vocabulary's size.

Languages are told by function words of four (``FUNCTION_WORDS``); texts of all others form one group with one vocabulary.

Defined results: headings, fenced and bare code, tables and logs are left out; documents with fewer than ``LEAST`` words
of prose, null and empty texts get no row; labels that are null or outside 1-5 are ignored, repeated ones of an annotator
count once; without labels the levels are fifths of the mean quantile; equal documents get equal levels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow, work_path

LEAST, SHARE, SHORT, KNOWN, STEPS, DRAW = 50, 0.7, 12, 60_000, 200, 10.0

#: Function words that tell a language (fixed values).
FUNCTION_WORDS = {
    "en": "the a an this that each every some is are was were of to and in on for with by not its their our we they it be".split(),
    "de": "der die das den dem des ein eine einer und oder ist sind war nicht mit für durch ohne gegen hat auf von zu im".split(),
    "fr": "le la les un une des du de et ou est sont pas avec pour dans sans sur par que qui au ce cette".split(),
    "es": "el la los las un una unos y o es son no con para en sin por del de que se al lo su".split(),
}
_OF = {w: k for k, ws in FUNCTION_WORDS.items() for w in ws if sum(w in x for x in FUNCTION_WORDS.values()) == 1}

SPAN, TAGS, LINK = re.compile(r"`[^`\n]*`"), re.compile(r"</?[A-Za-z][^<>\n]*>|&\w+;"), re.compile(r"https?://\S+|\]\([^)\s]*\)|\S+/\S+\.\w{1,5}\b")
LOG = re.compile(r"^\s*[\[(]?(?:\d{4}-\d\d-\d\d[T ]|\d\d:\d\d:\d\d|\d{10,})|^\s*(?:INFO|WARN(?:ING)?|DEBUG|ERROR|TRACE|FATAL)\b[ :]")
MARK = re.compile(r"^\s*(?:(?:[-*+>•]|\d+[.)]|//+|#(?=\s+[a-z])|\|(?!.*\|))\s+)+")
CODE = re.compile(
    r"[{;}\])]\s*$(?<!\)\.)|^\s*[}\])@]|:=|=>|->|==|!=|&&|\|\||\w\(.*\)\s*[:{;]?\s*$|[\w\])]\s[-+*/]?=\s|^\s*(?:def|class|func|fn|pub|import|from|return|package|use|private|public|static|switch|case|const|let|var|async|export|function|raise|except|elif|match|impl|struct|enum|interface|type)\b.*[(){}:;=<>'\"`]"
)
ANY_SIGN = re.compile(r"[{}()\[\];:=<>!&|@\"'`_\\$%^*+~-]")
SIGNS = re.compile(r"[{}()\[\];=<>_\\|@$%^&*+~]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
END = re.compile(r"[.!?…]+(?=[\s\"'”»)]|$)|:(?=\s+[A-ZÀ-ÝÄÖÜ])|\n\n+")


def prose(text: str) -> str:
    """The running prose of a text; a blank line parts what can't be one sentence."""
    out: list[str] = []
    fence = code = False
    for line in text.replace("\\n", "\n").split("\n"):
        s = line.strip()
        if s.startswith(("```", "~~~")):
            fence = not fence
            out.append("")
            continue
        if fence or not s:
            out.append("")
            continue
        if re.match(r"#{1,6}\s+[^a-z\s]", s) or (s.startswith("|") and s.count("|") > 1) or LOG.match(line) or re.fullmatch(r"[-=_*~#+ ]{3,}", s):
            out.append("")
            continue
        bare = MARK.sub("", line)
        started = bare != line and not line.lstrip().startswith((">", "//", "#", "|", "* "))
        if "`" in bare:
            bare = SPAN.sub(" ", bare)
        if "<" in bare or "&" in bare:
            bare = TAGS.sub(" ", bare)
        if "/" in bare or "](" in bare:
            bare = LINK.sub(" ", bare)
        bare = bare.strip()
        if code and line[:2] in ("  ", "\t") or (code and line[:1] == "\t") or bare[:3] in ('"""', "'''"):
            out.append("")  # what is set in after code belongs to it, as docstrings and comments do
            continue
        signed = bool(ANY_SIGN.search(bare))  # no sign, no code: most prose lines need no more than this
        code = signed and bool(CODE.search(bare))
        if code or (signed and len(SIGNS.findall(bare)) > 0.06 * len(bare) + 1) or not WORD.search(bare):
            out.append("")
            continue
        if started or re.match(r"<(?:p|li|h\d|div|tr)\b", s):
            out.append("")
        out.append(bare)
    return "\n".join(out)


def measured(text: str | None) -> tuple[str, int, int, dict[str, list[int]]] | None:
    """Language, words, sentences, and per word its count and that in short sentences; nothing below ``LEAST`` words."""
    if not text or len(text) < 2 * LEAST:
        return None
    words = sentences = 0
    counts: dict[str, list[int]] = {}
    tell: Counter[str] = Counter()
    for sentence in END.split(prose(text)):
        found = WORD.findall(sentence.lower())
        if len(found) < 3:
            continue
        sentences += 1
        words += len(found)
        for w in found:
            c = counts.get(w)
            if c is None:
                counts[w] = c = [0, 0]
            c[0] += 1
            if (k := _OF.get(w)) is not None:
                tell[k] += 1
        if len(found) <= SHORT:
            for w in set(found):
                counts[w][1] += 1
    if words < LEAST:
        return None
    return (max(sorted(tell), key=tell.__getitem__) if tell else "other"), words, sentences, counts


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang, words, sentences and the arrays word, n, short of every document with enough prose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (m := measured(t))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([list(r[4]) for r in rows], pa.list_(pa.string())), pa.array([[c[0] for c in r[4].values()] for r in rows], pa.list_(pa.int32())), pa.array([[c[1] for c in r[4].values()] for r in rows], pa.list_(pa.int32())),
                ],
                names=["doc_id", "lang", "words", "sentences", "word", "n", "short"],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.length("text") >= 2 * LEAST)
    return map_arrow(rows, run, "doc_id bigint, lang string, words bigint, sentences bigint, word array<string>, n array<int>, short array<int>")


def word_ranks(found: DataFrame) -> DataFrame:
    """lang, word, rank: how many words of the language are held by more short sentences (or as many, and are commoner)."""
    from pyspark.sql import Window

    words = found.select("lang", F.inline(F.arrays_zip("word", "n", "short"))).groupBy("lang", "word").agg(F.sum("short").alias("s"), F.sum("n").alias("n"))
    steps = words.groupBy("lang", "s", "n").agg(F.count(F.lit(1)).alias("k"))
    down = Window.partitionBy("lang").orderBy(F.desc("s"), F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("rank", F.sum("k").over(down)).drop("k")
    return words.join(steps, ["lang", "s", "n"]).select("lang", "word", "rank")


def coverage(found: DataFrame, ranks: DataFrame, share: float = SHARE, known: int = KNOWN) -> DataFrame:
    """doc_id, lang, x (log of the coverage rank), y (log of words per sentence)."""
    spark = found.sparkSession
    at = work_path(spark, "ranks")
    ranks.write.parquet(at)
    ranks = spark.read.parquet(at)
    table: dict[str, dict[str, int]] = {}
    # at most ``known`` words of each language have such a rank
    for r in ranks.filter(F.col("rank") <= known).toLocalIterator():
        table.setdefault(r[0], {})[r[1]] = r[2]
    sent = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, rest, times = [], [], []
            for lang, total, words, counts in zip(*(b.column(i).to_pylist() for i in (1, 2, 4, 5))):
                told = sent.value.get(lang, {}).get
                need, seen, end = -(-share * total // 1), 0, None
                for at_, n in sorted((k, n) for w, n in zip(words, counts) if (k := told(w)) is not None):
                    seen += n
                    if seen >= need:
                        end = at_
                        break
                out.append(end)
                rest.append(words if end is None else None)
                times.append(counts if end is None else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.int64()), pa.array(rest, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))], names=["doc_id", "lang", "words", "sentences", "at", "word", "n"])

    at = work_path(spark, "covered")
    map_arrow(found.select("doc_id", "lang", "words", "sentences", "word", "n"), run, "doc_id bigint, lang string, words bigint, sentences bigint, at bigint, word array<string>, n array<int>").write.parquet(at)
    rows = spark.read.parquet(at)
    keys = ["doc_id", "lang", "words", "sentences"]
    long = rows.filter("at is null").withColumn("_h", F.monotonically_increasing_id()).select(*keys, "_h", F.inline(F.arrays_zip("word", "n")))
    by = long.join(ranks, ["lang", "word"]).groupBy(*keys, "_h").agg(F.array_sort(F.collect_list(F.struct("rank", "n"))).alias("r"))
    need = F.ceil(F.lit(share) * F.col("words"))
    ends = F.aggregate("r", F.struct(F.lit(0).cast("bigint").alias("c"), F.lit(0).cast("bigint").alias("at")), lambda a, e: F.struct((a["c"] + e["n"]).alias("c"), F.when(a["c"] < need, e["rank"]).otherwise(a["at"]).alias("at")))
    both = rows.filter("at is not null").select(*keys, "at").unionByName(by.select(*keys, ends["at"].alias("at")))
    return both.select("doc_id", "lang", F.log("at").alias("x"), F.log(F.col("words") / F.col("sentences")).alias("y"))


def _quantile(value: Column, steps: Column) -> Column:
    """The share of a language's documents below a value, from its quantiles."""
    return F.size(F.filter(steps, lambda q: q < value)) / F.lit(float(STEPS))


def _sum(terms: list[Column], weights: np.ndarray) -> Column:
    return sum((t * F.lit(float(w)) for t, w in zip(terms, weights)), F.lit(0.0))


def fitted(sums: dict[str, np.ndarray], n: int, pairs: list[tuple[int, int]]) -> dict[str | None, np.ndarray]:
    """Least-squares weights over all languages (under None), and each language's own, drawn towards those by ``DRAW``."""

    def solved(v: np.ndarray, ridge: float, towards: np.ndarray) -> np.ndarray:
        a = np.zeros((n, n))
        for (i, j), s in zip(pairs, v):
            a[i, j] = a[j, i] = s
        return np.linalg.solve(a + ridge * np.eye(n), v[len(pairs) :] + ridge * towards)

    both = solved(sum(sums.values()), 0.05, np.zeros(n))
    return {None: both} | {k: solved(v, DRAW, both) for k, v in sorted(sums.items()) if k is not None}


def reading_levels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, reading_level (1-5), and the measures, of every document with enough running prose."""
    spark = docs.sparkSession
    at = work_path(spark, "prose")
    measures(docs, doc_id, text).write.parquet(at)
    found = spark.read.parquet(at)
    at = work_path(spark, "coverage")
    coverage(found, word_ranks(found)).write.parquet(at)
    rows = spark.read.parquet(at)

    points = F.array(*[F.lit(i / STEPS) for i in range(1, STEPS)])
    spread = rows.groupBy("lang").agg(
        *[f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))],
        *[F.percentile_approx(c, points, 10_000).alias(f"{c}_q") for c in ("x", "y")],
    )
    scaled = rows.join(spread, "lang").select(
        "doc_id", "lang", "x", "y",
        *[F.coalesce((F.col(c) - F.col(f"{c}_mean")) / F.nullif(F.col(f"{c}_sd"), F.lit(0.0)), F.lit(0.0)).alias(f"{c}z") for c in ("x", "y")],
        *[_quantile(F.col(c), F.col(f"{c}_q")).alias(f"{c}p") for c in ("x", "y")],
    )
    one = labels.filter(F.col("reading_level").between(1, 5)).groupBy("doc_id", "annotator").agg(F.avg("reading_level").alias("v"))
    target = one.groupBy("doc_id").agg(F.avg("v").alias("level"))
    x, y = F.col("xz"), F.col("yz")
    term = [x, y, F.col("xp"), F.col("yp"), x * x, y * y, x * y, x * x * x, y * y * y, F.lit(1.0)]
    pairs = [(i, j) for i in range(len(term)) for j in range(i, len(term))]
    # a row per language that has labels; at most as many as FUNCTION_WORDS knows, and "other"
    sums = scaled.join(target, "doc_id").groupBy("lang").agg(*[F.sum(term[i] * term[j]) for i, j in pairs], *[F.sum(t * F.col("level")) for t in term]).collect()
    if sums:
        weights = fitted({r[0]: np.array(r[1:], dtype=float) for r in sums}, len(term), pairs)
        guess = _sum(term, weights[None])
        for lang, w in weights.items():
            if lang is not None:
                guess = F.when(F.col("lang") == lang, _sum(term, w)).otherwise(guess)
    else:
        guess = 0.5 + 5 * (F.col("xp") + F.col("yp")) / 2
    level = F.least(F.lit(5), F.greatest(F.lit(1), F.round(guess))).cast("bigint")
    return scaled.select("doc_id", level.alias("reading_level"), "lang", F.round("x", 4).alias("log_coverage_rank"), F.round("y", 4).alias("log_sentence_words"))
