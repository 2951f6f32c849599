"""Current texts and file facts that several operators need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(path: str = "path") -> Column:
    """The lower-case extension of a path's last part; empty without one."""
    return F.lower(F.regexp_extract(F.col(path), r"\.([^./\\]+)$", 1))


def newest(at: str, tie: str) -> Column:
    """The order of reads or scans: by time, then by id; a null time is the oldest."""
    return F.struct(F.col(at), F.col(tie))
