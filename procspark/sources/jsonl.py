"""JSON lines, spans and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of a JSON-lines file; a line that can't be read is an error that shows it."""
    kind = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
    text = spark.read.text(path).where(F.trim("value") != "")
    both = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    parsed = text.select(F.from_json("value", both, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    first = kind.fields[0]
    bad = F.raise_error(F.concat(F.lit("can't read the line "), F.col("_bad"))).cast(first.dataType)
    return parsed.withColumn(first.name, F.when(F.col("_bad").isNotNull(), bad).otherwise(F.col(first.name))).drop("_bad")


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def runs(df: DataFrame) -> DataFrame:
    return df.orderBy("started_at", "run_id")


def spans(df: DataFrame, run_id: str | None = None, kind: str | None = None) -> DataFrame:
    """Spans in order, of one run or kind if given."""
    if run_id is not None:
        df = df.where(F.col("run_id") == run_id)
    if kind is not None:
        df = df.where(F.col("kind") == kind)
    return df.orderBy("started_at", "step", "span_id")


def transcript(messages: DataFrame, run_id: str) -> DataFrame:
    return messages.where(F.col("run_id") == run_id).orderBy("message_id")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key; new ones replace old ones."""
    from ..operators.spans import latest

    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, key, "_new").drop("_new")
