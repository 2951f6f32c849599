"""Vector expressions: dot product, norm and a hashed term embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def hash_embedding(rows: DataFrame, key: str, terms: str, dims: int = 64) -> DataFrame:
    """``key`` and ``vector``: each term adds +1 or -1 to a bucket of its md5, then the vector is made a unit."""
    dims = max(8, min(4096, dims))
    h = F.md5(F.col("t"))
    bucket = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dims
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = rows.select(key, F.explode(terms).alias("t")).groupBy(key, bucket.alias("b")).agg(F.sum(sign).alias("v"))
    # at most ``dims`` entries a key
    got = sums.filter("v <> 0").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    dense = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)) / F.col("n"))
    return got.select(key, dense.alias("vector"))
