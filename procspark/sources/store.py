"""The event store: a Parquet dataset for each table, partitioned by log and version.

Saving a log writes a new version of it, and its row in ``logs`` last, which is what readers go by; so a save that
fails half-way leaves the log as it was, and other logs aren't touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import resource_kind
from ..operators.eventlog import EventLog
from ..operators.names import dictionary
from ..operators.ranking import before, by_ranges
from ..operators.variants import variant_counts
from ..session import cut

TABLES = ("logs", "activities", "resources", "cases", "events", "variants")
#: Object-centric tables: declared, and empty until a source provides objects.
OBJECTS = T.StructType([T.StructField(n, T.StringType()) for n in ("log_id", "object_id", "object_type", "attributes")])
EVENT_OBJECTS = T.StructType([T.StructField("log_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("object_id", T.StringType())])


def save(log: EventLog, path: str) -> None:
    """Write a log; another one with its id is replaced, by its row in ``logs``, once all tables are written.

    Events keep their place in the case and in the log, and their tie flags, so that loading needs no order of its own.
    """
    spark = log.events.sparkSession
    # Six tables and a sample for ranges read the numbered events, whose order and numbers are worked out once.
    events = cut(log.numbered(), "numbered")
    sums = events.agg(F.count("*").alias("event_count"), F.coalesce(F.sum(F.col("tie_broken").cast("bigint")), F.lit(0)).alias("tie_broken"))
    about = [F.lit(getattr(log, k)).alias(k) for k in ("source", "license", "attribution", "doi")]
    cases = log.cases.join(events.select("case_id", "case_index").distinct(), "case_id")
    counts = by_ranges(variant_counts(events), "first_case")
    variants = before(counts, [], "_part", ["first_case"], {"k": F.lit(1)}).select((F.col("k") + 1).alias("variant_seq"), "variant", "n", "first_case")
    # One row each.
    about_log = sums.crossJoin(log.cases.agg(F.count("*").alias("case_count"))).select(*about, "event_count", "case_count", "tie_broken")
    tables = {
        "activities": dictionary(events, "activity", "seq", "activity_id"),
        "resources": dictionary(events, "resource", "seq", "resource_id").withColumn("kind", resource_kind(F.col("name"))),
        "cases": cases,
        "events": events.repartitionByRange("case_id").sortWithinPartitions("case_id", "pos"),
        "variants": variants,
        "objects": spark.createDataFrame([], OBJECTS).drop("log_id"),
        "event_objects": spark.createDataFrame([], EVENT_OBJECTS).drop("log_id"),
    }
    version, before_this = uuid.uuid4().hex, _version(spark, path, log.log_id)
    for name, df in tables.items():
        df.withColumn("log_id", F.lit(log.log_id)).withColumn("version", F.lit(version)).write.partitionBy("log_id", "version").mode("append").parquet(f"{path}/{name}")
    row = about_log.withColumn("version", F.lit(version)).withColumn("log_id", F.lit(log.log_id)).write.partitionBy("log_id").mode("overwrite")
    row.option("partitionOverwriteMode", "dynamic").parquet(f"{path}/logs")
    if before_this:
        _drop(spark, [f"{path}/{name}/log_id={_escaped(spark, log.log_id)}/version={before_this}" for name in tables])


def _escaped(spark: SparkSession, name: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)


def _drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _version(spark: SparkSession, path: str, log_id: str) -> str | None:
    """The version of a stored log; none for a log, or a store, that isn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/logs")
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return None
    found = logs(spark, path).where(F.col("log_id") == log_id).first()
    return found.version if found else None


def logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/logs").orderBy("log_id")


def load(spark: SparkSession, path: str, log_id: str) -> EventLog:
    """A stored log, in its stored order; an unknown id is an error that lists the known ones.

    The id is a partition of the dataset, so only this log's files are read.
    """
    found = logs(spark, path).where(F.col("log_id") == log_id).first()
    if found is None:
        known = ", ".join(r.log_id for r in logs(spark, path).select("log_id").collect())
        raise KeyError(f"no log {log_id!r} in {path}; there are: {known}")
    mine = f"log_id={_escaped(spark, log_id)}/version={found.version}"
    events, cases = (spark.read.parquet(f"{path}/{name}/{mine}") for name in ("events", "cases"))
    cases = cases.drop("case_index")
    return EventLog(events, cases, log_id, found.source, found.license, found.attribution, found.doi)


def as_bucketed_table(log: EventLog, table: str, buckets: int) -> None:
    """Events as a catalog table, bucketed and sorted by case: windows by case over it need no shuffle."""
    log.events.write.bucketBy(buckets, "case_id").sortBy("case_id", "pos").mode("overwrite").saveAsTable(table)
