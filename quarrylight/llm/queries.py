"""Queries over training text, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread, table
from . import algorithms, encode, leaks, provenance, readability, secrets, syntax


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "source_reads"), "read_id")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.faulty_files(_reads(spark, sf_dir))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.fault_rates(_reads(spark, sf_dir), table(spark, sf_dir, "symbol_reports"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.credential_lines(_reads(spark, sf_dir)).select("read_id", "line_no")


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redacted(_reads(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.foreign_files(table(spark, sf_dir, "files"), _reads(spark, sf_dir)).select("repo_id", "path")


def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.foreign_files(table(spark, sf_dir, "files"), _reads(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_documents(_documents(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.reading_levels(_documents(spark, sf_dir), table(spark, sf_dir, "level_labels")).select("doc_id", "reading_level")


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p4_found": p4_found, "p4_redacted": p4_redacted, "p5_found": p5_found, "p5_kinds": p5_kinds, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found} | algorithms.QUERIES
SQL: dict[str, str] = dict(algorithms.SQL)
