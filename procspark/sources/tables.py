"""An XES file as two typed tables in one job, with the counts and types of what was written taken from the write itself."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.typed import columns, texts
from ..operators.eventlog import EventLog
from . import xes

#: The two kinds of rows.
CASE, EVENT = "case", "event"


def convert(spark: SparkSession, path: str, out: str) -> dict:
    """Events and cases of an XES file as Parquet under ``out``, in folders ``kind=event`` and ``kind=case``, and a manifest.

    One job reads the file and writes both tables.  Counts, sums, the span of time and the schemas of the attributes come from metrics that the
    write gathers on its way, so nothing is scanned again.  Returns the manifest, which is written as JSON last: a folder without it
    isn't finished.
    """
    rows = typed_rows(spark, path)
    seen, event = Observation("tables"), F.col("kind") == EVENT
    watched = rows.observe(
        seen,
        F.count_if(~event).alias("cases"), F.count_if(event).alias("events"), F.coalesce(F.sum("value_cents"), F.lit(0)).alias("value_cents"),
        F.count_if(event & (F.col("resource") == "")).alias("events_without_resource"), F.count_if(event & (F.col("precision") == "day")).alias("day_precision_events"),
        F.min("ts_s").alias("first_ts"), F.max("ts_s").alias("last_ts"),
        F.schema_of_variant_agg(F.when(~event, F.col("props"))).alias("case_schema"), F.schema_of_variant_agg(F.when(event, F.col("props"))).alias("event_schema"),
    )
    watched.write.partitionBy("kind").mode("overwrite").parquet(f"{out}/tables")
    manifest = {"source": path, **seen.get}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
    return manifest


def typed_rows(spark: SparkSession, path: str) -> DataFrame:
    """A row for each case and each event with a time of an XES file, told apart by ``kind``; the file is read once."""
    rows = xes.with_case_ids(xes.read_traces(spark, path))
    # A trace's own attributes go first, as if they were an event's.
    each = rows.select("case_id", "ordinal", F.posexplode(F.concat(F.array(F.to_json("props")), F.col("events"))).alias("place", "x"))
    each = xes.with_event_columns(each.select("case_id", "ordinal", (F.col("place") - 1).alias("i"), F.parse_json("x").alias("v")), xes.VALUE)
    case = F.col("i") < 0
    only = lambda c: F.when(~case, F.col(c)).alias(c)
    named = each.select(
        F.when(case, CASE).otherwise(EVENT).alias("kind"), "case_id", "ordinal", only("arrival"), only("activity"), only("ts"), only("resource"), only("value_cents"),
        only("precision"), F.when(case, F.col("v")).otherwise(F.col("props")).alias("props"),
    )
    return named.where((F.col("kind") == CASE) | F.col("ts").isNotNull()).withColumn("ts_s", F.unix_seconds("ts")).drop("ts")


def load(spark: SparkSession, out: str, ranks: dict[str, int] | None = None, log_id: str = "log") -> EventLog:
    """The log of two tables; a folder without a manifest is an error."""
    spark.read.text(f"{out}/manifest")
    rows = spark.read.parquet(f"{out}/tables")
    events = rows.where(F.col("kind") == EVENT).withColumn("attrs", texts(F.col("props"), nested=False)).drop("kind", "ordinal")
    cases = rows.where(F.col("kind") == CASE).select("case_id", texts(F.col("props"), nested=False).alias("attrs"), "props")
    return EventLog.build(events, ranks, cases, log_id=log_id)


def case_table(spark: SparkSession, out: str) -> DataFrame:
    """Cases with a typed column for each attribute, found in the table; lists, objects and mixed attributes are texts."""
    return columns(spark.read.parquet(f"{out}/tables/kind={CASE}").select("case_id", "props"))
