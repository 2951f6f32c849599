"""A repository tree as a table: files below a root, with role, language, hash, and what is pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import language, role
from ..operators.inventory import MOST_BYTES, guarded_status

#: Directories that are never entered.
PRUNED = r"(?:^|/)(?:\.git|node_modules|target|dist|build|coverage|vendor|\.gradle|\.venv|__pycache__|\.ssh|\.aws)/"


def scan(spark: SparkSession, root: str, ignore: list[str] = (), sensitive: bool = False, generated: bool = False) -> DataFrame:
    """path, size_bytes, modified_at, hash, role, language, status, text of every file below a root.

    A file above the guarded size is neither opened nor hashed. ``ignore``: regular expressions of paths left out. Sensitive and generated files are left out unless asked for.
    """
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.regexp_replace(F.col("path"), r"^.*?\Q" + base.split("://")[-1] + r"\E/", "")
    known = [path.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")]
    # the size is known before a file is opened: of larger files no content is asked for
    small = rows.filter(F.col("length") <= MOST_BYTES).select(*known, "content")
    large = rows.filter(F.col("length") > MOST_BYTES).select(*known, F.lit(None).cast("binary").alias("content"))
    rows = small.unionByName(large)
    rows = rows.filter(~F.col("path").rlike(PRUNED))
    for pattern in ignore:
        rows = rows.filter(~F.col("path").rlike(pattern))
    rows = rows.withColumns({"role": role(F.col("path")), "language": language(F.col("path"))})
    if not sensitive:
        rows = rows.filter("role <> 'sensitive'")
    if not generated:
        rows = rows.filter("role <> 'generated'")
    status = guarded_status(F.col("content"), F.lit(False), F.col("size_bytes"))
    return rows.withColumns({"hash": F.sha2("content", 256), "status": status}).withColumn("text", F.when(F.col("status") == "read", F.col("content").cast("string"))).drop("content")
