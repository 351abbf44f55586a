"""Places in an order without sorting a growing table in one task.

Rows are dealt out by parts that agree with the order; totals of parts are few, so the running sums over parts are
small, and the sums within a part stay in its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Ranges that a key is dealt out by.
PARTS = 256


def by_ranges(rows: DataFrame, key: str, part: str = "_part", parts: int = PARTS) -> DataFrame:
    """Adds the number of the range that a key falls in; bounds are keys drawn by hash, so ranges hold about as many rows.

    The draw is bounded by ``parts``; one row of bounds is sent to all tasks.
    """
    drawn = rows.select(F.col(key).alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(parts - 1)
    bounds = drawn.agg(F.array_sort(F.collect_list("k")).alias("_bounds"))
    placed = rows.join(F.broadcast(bounds), F.lit(True), "left")
    return placed.withColumn(part, F.size(F.filter("_bounds", lambda b: b <= F.col(key)))).drop("_bounds")


def before(rows: DataFrame, group: list[str], part: str, order: list[Column | str], weights: dict[str, Column]) -> DataFrame:
    """Adds, for each named weight, its sum over the rows of a group that stand before a row in the order."""
    totals = rows.groupBy(*group, part).agg(*[F.sum(w).alias(f"_{n}") for n, w in weights.items()])
    earlier = W.partitionBy(*(group or [F.lit(0)])).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*group, part, *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in weights])
    inside = W.partitionBy(*group, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = {n: F.col(f"_{n}") + F.coalesce(F.sum(w).over(inside), F.lit(0)) for n, w in weights.items()}
    return rows.join(totals, [*group, part]).withColumns(sums).drop(*[f"_{n}" for n in weights])
