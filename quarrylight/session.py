"""Session settings and the shared work folder."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that queries expect (UTC, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quarrylight")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine, as in tests, a temporary folder is made and set; on a
    cluster no machine-local folder would do, and a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarrylight-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for a written table that cuts lineage."""
    return f"{shared_dir(spark)}/quarrylight/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors, wherever the driver was started.

    The package's files go out once per application as an archive that Spark's own file server hands to the executors.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    name = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]
    at = Path(tempfile.mkdtemp(prefix="quarrylight-")) / f"quarrylight-{name}.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)


def map_arrow(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema)
