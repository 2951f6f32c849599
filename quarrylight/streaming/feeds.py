"""Structured Streaming over event logs: windowed counts, and a merge of inventory changes batch by batch."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.inventory import upserted


def event_stream(spark: SparkSession, folder: str, like: DataFrame, name: str = "*.parquet") -> DataFrame:
    """New parquet files of a folder as a stream, a file at a time, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1).parquet(folder)


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and summed value by window and type; rows later than ``late`` may be left out.

    In update mode the state holds the windows within ``late`` of the newest event alone.
    """
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))


def write_changes(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run through what is there; each batch writes the windows it changed as ``epoch=n`` below ``path``.

    Update mode: windows behind the watermark leave the state. A batch that is run again overwrites its own epoch.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of each key what the last epoch wrote that changed it."""
    rows = spark.read.parquet(path)
    cols = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "epoch").alias("_v")).select(*keys, "_v.*")


def _parts(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The newest generation of each bucket of a keyed table, from the names of its files."""
    try:
        names = spark.read.parquet(path).inputFiles()
    except AnalysisException:
        return {}
    found: dict[int, int] = {}
    for name in names:
        if m := re.search(r"/gen=(\d+)/_bucket=(\d+)/", name):
            gen, bucket = int(m[1]), int(m[2])
            if before is None or gen < before:
                found[bucket] = max(gen, found.get(bucket, -1))
    return found


def current_table(spark: SparkSession, path: str, only: set[int] | None = None, before: int | None = None) -> DataFrame | None:
    """The rows of a keyed table, of some buckets or all; None where there are none."""
    at = [f"{path}/gen={g}/_bucket={b}" for b, g in sorted(_parts(spark, path, before).items()) if only is None or b in only]
    return spark.read.parquet(*at) if at else None


def merge_stream(changes: DataFrame, keys: list[str], order: str, path: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Merge each batch of changes into a keyed table in hash buckets; only buckets that a batch touches are written anew.

    A batch that is run again after a failure starts from what earlier batches wrote, so it counts once; a table or a
    checkpoint that is renewed alone starts from what is there.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.hash(*keys), F.lit(buckets)).cast("int")
        new = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("_v")).select(*keys, "_v.*").withColumn("_bucket", part)
        new.persist()
        hit = {r[0] for r in new.select("_bucket").distinct().collect()}
        old = current_table(spark, path, hit, epoch)
        rows = new.drop("_bucket") if old is None else upserted(old, new.drop("_bucket"), keys, order)
        rows.withColumn("_bucket", part).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/gen={epoch}")
        new.unpersist()

    return changes.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
