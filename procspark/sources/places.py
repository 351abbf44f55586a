"""Numbers for the records of files, in the order of paths and of places, without a shuffle of the records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def numbered(records: DataFrame) -> DataFrame:
    """Adds ``ordinal``, from 0, to rows that come straight from files, perhaps filtered.

    Rows are counted for each split that a task reads; the running sums go over splits.
    """
    # The lower bits count the rows that a task reads, and rows of a split stand together.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    own = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    placed = records.select("*", *own).withColumn("_place", place)
    splits = placed.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_place").alias("first"))
    earlier = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("_file", "_block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("_offset"))
    # A row for each split, some hundred bytes: sent to all tasks, as else the records themselves would be shuffled.
    joined = placed.join(F.broadcast(splits), ["_file", "_block"]).withColumn("ordinal", F.col("_offset") + F.col("_place"))
    return joined.drop("_file", "_block", "_place", "_offset")
