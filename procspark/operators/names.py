"""Names as numbers: a dictionary of activities or resources in the order in which a log first has them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import before, by_ranges


def dictionary(events: DataFrame, column: str, order: str = "arrival", number: str = "id") -> DataFrame:
    """``(id, name, n)``: names numbered from 0 in the order of the least ``order`` that has them, and how often they come.

    Names of one least order, which only logs with repeated numbers have, follow each other by name.  They are ordered
    within ranges of that order, so many names, as of users, aren't sorted in one task.  Null is no name.
    """
    names = events.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.min(order).alias("_first"), F.count("*").alias("n"))
    placed = before(by_ranges(names, "_first"), [], "_part", ["_first", "name"], {"_id": F.lit(1)})
    return placed.select(F.col("_id").cast("bigint").alias(number), "name", "n")


def encode(events: DataFrame, names: DataFrame, column: str, number: str) -> DataFrame:
    """Events with a number in place of a name; a name that the dictionary hasn't got, or null, is null.

    The dictionary isn't broadcast by request: Spark does so where it is small, and splits a hot name's events where not.
    """
    ids = names.select(F.col("name").alias(column), F.col("id").alias(number))
    return events.join(ids, column, "left").drop(column)


def decode(events: DataFrame, names: DataFrame, number: str, column: str) -> DataFrame:
    """The reverse of ``encode``."""
    return events.join(names.select(F.col("id").alias(number), F.col("name").alias(column)), number, "left").drop(number)
