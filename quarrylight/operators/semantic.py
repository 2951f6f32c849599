"""Vector search: stated queries against all vectors, in blocks, and facets that explain a hit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import map_arrow

from .ranks import best_items

#: Query vectors that a block holds and broadcasts (64 dimensions: about 1 MB a thousand).
BLOCK = 2_000


def _blocks(vectors: DataFrame, queries: DataFrame, key: str, vector: str, block: int) -> tuple[DataFrame, Iterator[Broadcast]]:
    """The rows as item and v, and the stated queries in blocks: ids and vectors of length 1."""
    spark = vectors.sparkSession
    rows = [(r[0], r[1]) for r in queries.select(F.col(key).cast("bigint"), F.col(vector)).filter(F.col(vector).isNotNull()).orderBy(key).toLocalIterator()]
    base = vectors.select(F.col(key).cast("bigint").alias("item"), F.col(vector).cast("array<float>").alias("v")).filter("v is not null and item is not null")

    def sent() -> Iterator[Broadcast]:
        for at in range(0, max(1, len(rows)), block):
            part = rows[at : at + block]
            ids = np.array([r[0] for r in part], dtype=np.int64)
            q = np.zeros((0, 1))
            if len(part):
                q = np.array([r[1] for r in part], dtype=np.float64).reshape(len(part), -1)
                q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
            yield spark.sparkContext.broadcast((ids, q))

    return base, sent()


def _scores(b: pa.RecordBatch, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items of a batch, and their cosine with each query of a block; minus infinity for the query itself."""
    items = b.column(0).to_numpy()
    v = np.stack([np.asarray(x, dtype=np.float64) for x in b.column(1).to_pylist()])
    s = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)) @ q.T
    s[items[:, None] == ids[None, :]] = -np.inf
    return items, s


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, item, score, rank: the k most alike vectors of each query, itself left out.

    Queries are a stated set. They go out in blocks of a fixed size; each batch of rows meets a block in one matrix
    product and keeps k rows a query, so that what is shuffled doesn't grow with the rows' dimension.
    """
    base, blocks = _blocks(vectors, queries, key, vector, block)
    out = None
    for sent in blocks:

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for b in batches:
                if not len(ids) or not b.num_rows:
                    continue
                items, s = _scores(b, ids, q)
                n = min(k + 1, len(items))
                # a little more than k, so that ties at the edge are settled by the exact step
                low = np.partition(s, len(items) - n, axis=0)[len(items) - n]
                i, j = np.nonzero((s >= low[None, :]) & np.isfinite(s))
                yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(items[i]), pa.array(np.round(s[i, j], 6))], names=["query_id", "item", "score"])

        got = map_arrow(base, run, "query_id bigint, item bigint, score double")
        out = got if out is None else out.unionByName(got)
    return best_items(out, ["query_id"], "item", "score", k)


def cosine_at_least(vectors: DataFrame, queries: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, hits, best: all vectors whose cosine with a query is ``least`` or more, counted, and the highest one.

    Each batch of rows meets a block of queries in one matrix product and gives one row a query; then one sum.
    """
    base, blocks = _blocks(vectors, queries, key, vector, block)
    out = None
    for sent in blocks:

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for b in batches:
                if not len(ids) or not b.num_rows:
                    continue
                s = np.round(_scores(b, ids, q)[1], 6)
                hits = (s >= least).sum(axis=0)
                j = np.flatnonzero(hits)
                yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(hits[j].astype(np.int64)), pa.array(s.max(axis=0)[j])], names=["query_id", "hits", "best"])

        got = map_arrow(base, run, "query_id bigint, hits bigint, best double")
        out = got if out is None else out.unionByName(got)
    return out.groupBy("query_id").agg(F.sum("hits").alias("hits"), F.max("best").alias("best"))


def facets(parts: list[DataFrame], keys: list[str], most: int = 12, top: int = 5) -> DataFrame:
    """keys and the ``top`` facets (kind, label) by weight; of each kind at most ``most``, the first by label.

    parts: tables of keys, kind, label, weight.
    """
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("label", F.desc("weight")))).filter(F.col("_r") <= most)
    best = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "label", "kind")))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("facets"), F.array_join(F.transform(F.slice(best, 1, top), lambda x: F.concat(x["kind"], F.lit(":"), x["label"])), ",").alias("top"))
