"""The first rows of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_rows(rows: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, for one fixed number and rows that are distinct already.

    A row number below a literal lets the planner keep ``n`` rows a group and task before the exchange, so a group of
    any size sends as many rows as there are tasks times ``n``.
    """
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def best_items(rows: DataFrame, keys: list[str], item: str, score: str, n: int) -> DataFrame:
    """keys, item, score, rank: the ``n`` best items of each group by their highest score, ties by item.

    Rows without an item or with a null or NaN score are left out.
    """
    best = rows.filter(F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*keys, F.col(item).alias("item")).agg(F.max(score).alias("score"))
    return first_rows(best, keys, [F.desc("score"), "item"], n)
