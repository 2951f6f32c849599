"""Source files whose text is no valid syntax of their language.

Every text is parsed by the grammar of the language that its extension stands for. A text that fails is tried against
all other grammars in the order of a token-based ranking: a foreign success names a wrong extension, failure of all
grammars names corruption. Texts are parsed where they are read; only flags of a few bytes are shuffled to find each
file's current read, so a repository of any size costs no more than its rows.

Defined results: of the reads with status ``read`` the newest counts, equal times go by the higher id; a current text
that is null or blank is no case; paths without a known extension are not reported; repeated rows count once; a text
nested deeper than the parsers follow (``too_deep``) counts as faulty, since no parse of it succeeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow

from . import grammar
from .reads import extension, newest


def parsed_reads(reads: DataFrame) -> DataFrame:
    """Per read of a file with a language: repo_id, path, read_at, read_id, language, state, foreign.

    state: ``ok``, ``blank``, ``wrong_extension``, ``corrupt`` or ``too_deep``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states, others, languages = [], [], []
            for path, text in zip(b.column(1).to_pylist(), b.column(4).to_pylist()):
                language = grammar.language_of(path)
                languages.append(language)
                if not text or not grammar.clean(text).strip():
                    states.append("blank")
                    others.append(None)
                    continue
                other = None
                state = "ok"
                if wrong := grammar.fault(language, text):
                    other = grammar.foreign(language, text)
                    state = "wrong_extension" if other else "too_deep" if wrong == grammar.TOO_DEEP else "corrupt"
                states.append(state)
                others.append(other)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(languages, pa.string()), pa.array(states, pa.string()), pa.array(others, pa.string())],
                names=["repo_id", "path", "read_at", "read_id", "language", "state", "foreign"],
            )

    rows = reads.filter((F.col("status") == "read") & extension().isin(*grammar.EXTENSIONS))
    rows = rows.select("repo_id", "path", F.col("read_at").cast("timestamp").alias("read_at"), F.col("read_id").cast("bigint").alias("read_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "repo_id string, path string, read_at timestamp, read_id bigint, language string, state string, foreign string")


def current_syntax(reads: DataFrame) -> DataFrame:
    """One row per file with a language: repo_id, path, language, state, foreign of its current read."""
    last = F.max_by(F.struct("language", "state", "foreign"), newest("read_at", "read_id"))
    return parsed_reads(reads).groupBy("repo_id", "path").agg(last.alias("_last")).select("repo_id", "path", "_last.*")


def faulty_files(reads: DataFrame) -> DataFrame:
    """repo_id and path of files whose current text does not parse in their language."""
    return current_syntax(reads).filter(F.col("state").isin("wrong_extension", "corrupt", "too_deep")).select("repo_id", "path")


def fault_rates(reads: DataFrame, reports: DataFrame) -> DataFrame:
    """Per repository and language: files with text, faults by kind, their rate, and how the hint does.

    ``hinted``: files whose newest symbol report has a diagnostic of an incomplete parse, an unreliable hint.
    """
    newest_report = F.max_by(F.col("diagnostics"), newest("reported_at", "report_id"))
    hint = F.exists(F.coalesce(F.col("_d"), F.array()), lambda d: F.coalesce(d["code"].isin("parse_gap", "symbol_partial"), F.lit(False)))
    hints = reports.groupBy("repo_id", "path").agg(newest_report.alias("_d")).select(F.col("repo_id").alias("_r"), F.col("path").alias("_p"), hint.alias("_hint"))
    files = current_syntax(reads).filter("state <> 'blank'")
    rows = files.join(hints, files["repo_id"].eqNullSafe(hints["_r"]) & files["path"].eqNullSafe(hints["_p"]), "left")
    bad, said = F.col("state") != "ok", F.coalesce(F.col("_hint"), F.lit(False))
    return rows.groupBy("repo_id", "language").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(bad).alias("faulty"), F.count_if(F.col("state") == "wrong_extension").alias("wrong_extension"), F.count_if(F.col("state") == "corrupt").alias("corrupt"), F.count_if(F.col("state") == "too_deep").alias("too_deep"),
        F.round(F.count_if(bad) / F.count(F.lit(1)), 6).alias("rate"), F.count_if(said).alias("hinted"), F.count_if(said & bad).alias("hinted_faulty"),
    )
