"""Expressions over a task's text: whether it spans areas, and of which family it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .paths import explicit_paths

# Words of tasks that span areas, and of tasks that ask for a broad validation.
BROAD = [
    "archive", "archives", "artifact", "artifacts", "ci", "channel", "doc", "docs", "eval", "evaluate", "evaluation", "harden", "historical", "lint", "measure", "measured", "metric", "metrics", "orchestration", "product", "promote", "promotion", "proof", "retrieval", "run", "runs", "smoke", "stabilize", "target", "targets", "workflow",
]
VALIDATING = ["ci", "eval", "evaluation", "harden", "orchestration", "run", "runs", "smoke", "stabilize", "workflow"]


def broad_words(terms: Column, words: list[str] = BROAD) -> Column:
    """How many of the words a task has."""
    return F.size(F.array_intersect(terms, F.array(*[F.lit(w) for w in words])))


def multi_area(terms: Column) -> Column:
    """Two broad words; each named pair (a workflow with its check, an orchestration with its run) holds two of them too."""
    return broad_words(terms) >= 2


def family(text: Column) -> Column:
    """The first that holds: broad_scope, low_information, explicit_path, stack_or_error, symbol_identifier, commit_clue, domain_phrase."""
    return (
        F.when(multi_area(T.words(text)), "broad_scope").when(T.information(text) < 2, "low_information").when(F.size(explicit_paths(text)) > 0, "explicit_path").when(F.lower(text).rlike(ERRORS), "stack_or_error")
        .when(text.rlike(IDENTIFIER), "symbol_identifier").when(F.lower(text).rlike(COMMIT), "commit_clue").otherwise("domain_phrase")
    )


ERRORS = r"\b(?:error|exception|panic|traceback|stack trace|failed|failure)\b"
IDENTIFIER = "[a-z][A-Z]|[A-Za-z0-9]_[A-Za-z0-9]|[A-Za-z]::[A-Za-z]"
COMMIT = r"\bcommit\b"
