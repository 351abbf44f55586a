"""The event log: raw events put in canonical order, and the questions that need no more than that order.

Everything that looks at neighbours within a case is a window over ``(case_id, pos)``; all such windows share one
shuffle by case.  First-seen ties are broken by the least case id and position, which needs no global numbering.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import activity_rank
from ..schema import CASES, DAY, EVENTS, RAW, SECOND
from .ranking import before, by_ranges

def by_case():
    """The window over a case in order."""
    return W.partitionBy("case_id").orderBy("pos")


def raw_events(df: DataFrame) -> DataFrame:
    """Missing raw columns get their defaults: no hint, arrival, resource, value, precision, tie or attributes.

    Times may come as ``ts`` (a timestamp) in place of ``ts_s``; fractions of a second are dropped, toward zero.  A VARIANT
    column ``props`` with typed attributes is kept.
    """
    if "ts_s" not in df.columns:
        micros = F.unix_micros(F.col("ts").cast("timestamp"))
        df = df.withColumn("ts_s", F.when(micros < 0, -F.floor(-micros / 1_000_000)).otherwise(F.floor(micros / 1_000_000)).cast("bigint"))
    defaults = {
        "sort_hint": F.lit(0), "arrival": F.lit(0), "resource": F.lit(""), "value_cents": F.lit(0), "precision": F.lit(SECOND),
        "tie_broken": F.lit(False), "attrs": F.create_map(),
    }
    out = []
    for f in RAW.fields:
        col = F.col(f.name) if f.name in df.columns else defaults[f.name]
        col = F.coalesce(col.cast(f.dataType), defaults[f.name].cast(f.dataType)) if f.name in defaults else col.cast(f.dataType)
        out.append(col.alias(f.name))
    return df.select(*out, *_typed(df))


def _typed(df: DataFrame) -> list[str]:
    """The column of typed attributes (VARIANT), where there is one."""
    return ["props"] if "props" in df.columns else []


def canonical(raw: DataFrame, ranks: Mapping[str, int] | None = None) -> DataFrame:
    """Events in order of time, hint, declared rank and arrival within their case; ties are flagged.

    A tie is an event whose predecessor in the case has the same time and hint, or one that came flagged.
    """
    raw = raw_events(raw)
    w = W.partitionBy("case_id").orderBy("ts_s", "sort_hint", activity_rank(F.col("activity"), ranks or {}), "arrival")
    same = (F.col("ts_s") == F.lag("ts_s").over(w)) & (F.col("sort_hint") == F.lag("sort_hint").over(w))
    return raw.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).withColumn(
        "tie_broken", F.col("tie_broken") | F.coalesce(same, F.lit(False))
    )


def merge_case_attributes(rows: DataFrame) -> DataFrame:
    """One map for each case from rows ``(case_id, arrival, attrs)``: for each key the last value counts."""
    each = rows.select("case_id", "arrival", F.explode("attrs").alias("key", "value"))
    last = each.groupBy("case_id", "key").agg(F.max_by("value", "arrival").alias("value"))
    return last.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))


def cases_of(events: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """One row for each case with events; attributes of other cases are dropped."""
    cases = events.groupBy("case_id").agg(
        F.min("ts_s").alias("start_ts"), F.max("ts_s").alias("end_ts"), F.count("*").alias("event_count")
    )
    empty = F.create_map().cast("map<string,string>")
    if attributes is None:
        return cases.withColumn("attrs", empty)
    return cases.join(attributes.select("case_id", "attrs", *_typed(attributes)), "case_id", "left").withColumn("attrs", F.coalesce("attrs", empty))


@dataclass(frozen=True)
class EventLog:
    """Ordered events, cases, and where they come from; lazy, as its two DataFrames are."""

    events: DataFrame
    cases: DataFrame
    log_id: str = "log"
    source: str = ""
    license: str = ""
    attribution: str = ""
    doi: str = ""
    filters: dict[str, str] = field(default_factory=dict)

    @classmethod
    def build(cls, raw: DataFrame, ranks: Mapping[str, int] | None = None, attributes: DataFrame | None = None, **about: str) -> EventLog:
        events = canonical(raw, ranks)
        return cls(events, cases_of(events, attributes), **about)

    @classmethod
    def empty(cls, spark, log_id: str = "empty") -> EventLog:
        return cls(spark.createDataFrame([], EVENTS), spark.createDataFrame([], CASES), log_id)

    def keep(self, cases: DataFrame, **filters: str) -> EventLog:
        """The given cases, whole, with order and tie flags as they are."""
        ids = cases.select("case_id")
        return replace(
            self, events=self.events.join(ids, "case_id", "left_semi"), cases=self.cases.join(ids, "case_id", "left_semi"), filters=self.filters | filters
        )

    def select(self, case_ids: Iterable[str] | DataFrame) -> EventLog:
        """The named cases; a name that the log hasn't got is an error.  Many names come as a table with ``case_id``."""
        if isinstance(case_ids, DataFrame):
            missing = case_ids.select("case_id").join(self.cases, "case_id", "left_anti").first()
            if missing is not None:
                raise KeyError(f"log {self.log_id} has no case {missing.case_id!r}")
            return self.keep(case_ids)
        wanted = sorted(set(case_ids))
        there = {r.case_id for r in self.cases.where(F.col("case_id").isin(wanted)).select("case_id").collect()}
        if missing := [c for c in wanted if c not in there]:
            raise KeyError(f"log {self.log_id} has no case {missing[0]!r}")
        inside = F.col("case_id").isin(wanted)
        return replace(self, events=self.events.where(inside), cases=self.cases.where(inside))

    def trace(self, case_id: str) -> DataFrame:
        """The events of one case, in order; an unknown case is an error."""
        return self.select([case_id]).events.orderBy("pos")

    def traces(self) -> DataFrame:
        """One row for each case, with its events as an array in order and its duration."""
        what = F.struct("pos", "activity", "ts_s", "resource", "value_cents", "tie_broken")
        got = self.events.groupBy("case_id").agg(F.array_sort(F.collect_list(what)).alias("events"))
        return got.join(self.cases, "case_id").withColumn("duration_s", F.col("end_ts") - F.col("start_ts"))

    def with_case_attributes(self) -> DataFrame:
        """Events beside the attributes of their case."""
        return self.events.join(self.cases.select("case_id", F.col("attrs").alias("case_attrs")), "case_id", "left")

    def activity_frequency(self) -> DataFrame:
        return self.events.groupBy("activity").agg(F.count("*").alias("n"))

    def resource_frequency(self) -> DataFrame:
        return self.events.groupBy("resource").agg(F.count("*").alias("n"))

    def time_span(self) -> DataFrame:
        return self.events.agg(F.min("ts_s").alias("first_ts"), F.max("ts_s").alias("last_ts"))

    def tie_broken_cases(self) -> DataFrame:
        return self.events.where("tie_broken").groupBy("case_id").agg(F.count("*").alias("ties"))

    def summary(self) -> DataFrame:
        """One row of counts; ``resources`` counts the empty name as one more, ``named_resources`` doesn't.

        Distinct names are counted after they are grouped, so no set of values grows in one task.
        """
        from .variants import variant_counts

        total = self.events.agg(
            F.count("*").alias("events"),
            F.coalesce(F.sum(F.col("tie_broken").cast("bigint")), F.lit(0)).alias("tie_broken_events"),
            F.coalesce(F.sum((F.col("precision") == DAY).cast("bigint")), F.lit(0)).alias("day_precision_events"),
            F.min("ts_s").alias("first_ts"),
            F.max("ts_s").alias("last_ts"),
        )
        activities = self.activity_frequency().agg(F.count("*").alias("activities"))
        named = self.resource_frequency().where("resource <> ''").agg(F.count("*").alias("named_resources"))
        cases = self.cases.agg(F.count("*").alias("cases"))
        variants = variant_counts(self.events).agg(F.count("*").alias("variants"))
        out = total
        for one in (activities, named, cases, variants):
            out = out.crossJoin(one)  # one row each
        return out.withColumn("resources", F.col("named_resources") + 1)

    def numbered(self) -> DataFrame:
        """Events with ``seq``, their place in the whole log, and ``case_index``; cases are dealt out by ranges of their id."""
        ranged = by_ranges(self.cases.select("case_id", "event_count"), "case_id")
        placed = before(ranged, [], "_part", ["case_id"], {"case_index": F.lit(1), "offset": F.col("event_count")})
        placed = placed.select("case_id", "case_index", "offset")
        return self.events.drop("seq", "case_index").join(placed, "case_id").withColumn("seq", F.col("offset") + F.col("pos")).drop("offset")
