"""A session with the settings that the library relies on."""

import re
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that ends shuffle files with the query that made them; for writes, after which nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the bytes that a task reads of a shuffle, where it may choose.
TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def session(app: str = "procspark", **conf: str) -> SparkSession:
    """UTC is mandatory (all event times are UTC); adaptive execution splits skewed joins and sizes partitions."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names; a folder in the warehouse only where Spark runs locally."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{base.rstrip('/')}/procspark-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """A table written to a new scratch folder and read again: what several branches use is computed once, and lost executors cost little."""
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Other settings of the session for the queries that run inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def dealt(table: DataFrame, key: str, rows: int = 1 << 18) -> DataFrame:
    """A written table dealt by a key to so many tasks that each has about ``rows``, whatever its size; counting needs its files' footers only."""
    return table.repartition(max(1, -(-table.count() // rows)), key)
