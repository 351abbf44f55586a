"""Referential checks, repeated keys, quotas, and the deterministic stratified sample of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import flow_of, json_numbers
from ..schema import FLOW
from .eventlog import EventLog
from .ranking import before


def gaps(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose reference isn't null and isn't known."""
    there = known.select(F.col(known_key).alias("_known")).distinct()
    return rows.where(F.col(key).isNotNull()).join(there, F.col(key) == F.col("_known"), "left_anti")


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def repeated_texts(rows: DataFrame, text: str) -> DataFrame:
    """Texts that are equal but for case and outer white space."""
    return repeated_keys(rows.select(F.lower(F.trim(text)).alias("text")), "text")


def below_quota(rows: DataFrame, key: str, quotas: DataFrame) -> DataFrame:
    """Groups with fewer rows than ``quotas(key, least)`` asks for, also those with none."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return quotas.join(counts, key, "left").na.fill(0, ["n"]).where("n < least")


def unaccounted_numbers(texts: DataFrame, text: str, known: list[float]) -> DataFrame:
    """Numbers in texts that the policy sheet doesn't hold."""
    facts = F.array(*[F.lit(float(x)) for x in known]).cast("array<double>")
    return texts.withColumn("unknown", F.array_except(json_numbers(F.col(text)), facts)).where(F.size("unknown") > 0)


def case_hash(case_id: Column, salt: str) -> Column:
    """Hex of the first eight bytes of a salted SHA-256; as text it sorts as the number does."""
    return F.substring(F.sha2(F.concat(F.lit(salt), case_id), 256), 1, 16)


def allocation(cases: DataFrame, target: int, floor: int) -> DataFrame:
    """Cases to draw from each flow: in proportion, ``floor`` at least, never more than there are."""
    per = cases.groupBy("flow").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))
    wanted = F.greatest(F.lit(floor), F.bround(F.lit(float(target)) * F.col("n") / total).cast("bigint"))
    return per.select("flow", "n", F.least(F.col("n"), wanted).alias("wanted"))


def stratified_sample(log: EventLog, target: int, floor: int = 0, salt: str = "procspark", unknown: str = "(unrecorded)") -> EventLog:
    """The same cases in every run: of each flow those with the least salted hashes.

    Cases are counted by the hash's leading digits, so a flow of any size is ordered in small parts.
    """
    flow = flow_of(F.col("attrs"), FLOW)
    cases = log.cases.select("case_id", F.when(flow == "", unknown).otherwise(flow).alias("flow"), case_hash(F.col("case_id"), salt).alias("h"))
    placed = before(cases.withColumn("part", F.substring("h", 1, 4)), ["flow"], "part", ["h", "case_id"], {"nth": F.lit(1)})
    drawn = placed.join(allocation(cases, target, floor), "flow").where("nth < wanted")
    return log.keep(drawn, sample=str(target))
