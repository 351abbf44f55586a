"""Directly-follows graphs: edges with timings, mergeable duration histograms, starts, ends, and comparison."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import bucket_middle, duration_bucket, share
from .eventlog import EventLog, by_case


def pairs(events: DataFrame) -> DataFrame:
    """Each event with its predecessor in the case: ``src``, ``dst``, seconds between, and the later one's tie flag."""
    return (
        events.select(
            "case_id",
            "pos",
            F.lag("activity").over(by_case()).alias("src"),
            F.col("activity").alias("dst"),
            (F.col("ts_s") - F.lag("ts_s").over(by_case())).alias("seconds"),
            F.col("tie_broken").cast("bigint").alias("tie"),
        )
        .where(F.col("src").isNotNull())
    )


@dataclass(frozen=True)
class DFG:
    """``edges(src, dst, n, cases, total_s, min_s, max_s, ties)`` and the small tables around it."""

    edges: DataFrame
    histogram: DataFrame
    starts: DataFrame
    ends: DataFrame
    activities: DataFrame
    case_count: DataFrame

    def filter_edges(self, min_count: int = 0, keep_fraction: float | None = None) -> DFG:
        """Edges of ``min_count`` or more; of those, the heaviest ones until a fraction of their total is reached.

        The edge that crosses the budget stays.  Starts, ends and activities stay as they are.
        """
        edges = self.edges.where(F.col("n") >= min_count)
        if keep_fraction is not None:
            heaviest = W.orderBy(F.col("n").desc(), "first_case", "first_pos")
            before = F.coalesce(F.sum("n").over(heaviest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            total = F.sum("n").over(W.partitionBy(F.lit(0)))
            ranked = edges.withColumn("before", before).withColumn("budget", total * F.lit(keep_fraction))
            edges = ranked.where("before < budget").drop("before", "budget")
        return replace(self, edges=edges, histogram=self.histogram.join(edges.select("src", "dst"), ["src", "dst"], "left_semi"))

    def edge_total(self) -> DataFrame:
        return self.edges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def self_loops(self) -> DataFrame:
        return self.edges.where("src = dst").select(F.col("src").alias("activity"), "n")

    def degrees(self) -> DataFrame:
        """Distinct successors and predecessors of each activity."""
        out = self.edges.groupBy(F.col("src").alias("activity")).agg(F.count("*").alias("successors"))
        into = self.edges.groupBy(F.col("dst").alias("activity")).agg(F.count("*").alias("predecessors"))
        both = self.activities.select("activity").join(out, "activity", "left").join(into, "activity", "left")
        return both.na.fill(0, ["successors", "predecessors"])

    def top_edges(self, k: int = 10) -> DataFrame:
        return self.edges.orderBy(F.col("n").desc(), "first_case", "first_pos").limit(k)

    def bottlenecks(self, k: int = 10, min_count: int = 5) -> DataFrame:
        """Edges on which most time passes in all."""
        return self.edges.where(F.col("n") >= min_count).orderBy(F.col("total_s").desc(), "first_case", "first_pos").limit(k)

    def means(self) -> DataFrame:
        return self.edges.withColumn("mean_s", F.col("total_s") / F.col("n"))

    def quantiles(self, points: Iterable[float]) -> DataFrame:
        """Approximate quantiles of seconds for each edge, one column each, from the histogram.

        The first bucket that reaches the rank gives its geometric middle, kept between the least and greatest
        duration; a point of 0 or less gives the least.
        """
        w = W.partitionBy("src", "dst").orderBy("bucket")
        running = self.histogram.withColumn("upto", F.sum("n").over(w))
        merged = running.select("src", "dst", "bucket", "upto").join(self.edges.select("src", "dst", "n", "min_s", "max_s"), ["src", "dst"])
        middle = bucket_middle(F.col("bucket"))
        columns = []
        for q in points:
            name = f"q{round(q * 100):02d}"
            if q <= 0:
                columns.append(F.min("min_s").cast("double").alias(name))
                continue
            reached = F.min(F.when(F.col("upto") >= F.col("n") * F.lit(q), F.struct("bucket", middle.alias("v"))))["v"]
            columns.append(F.greatest(F.min("min_s").cast("double"), F.least(F.max("max_s").cast("double"), reached)).alias(name))
        return merged.groupBy("src", "dst").agg(*columns)


def build(log: EventLog, activities: Iterable[str] | None = None) -> DFG:
    """The graph of a log; with an allow-list, other events are taken out before neighbours are looked at.

    Cases of an edge are counted by grouping twice, by case and then by edge, so there is no set of cases.
    """
    events = log.events
    if activities is not None:
        events = events.where(F.col("activity").isin(list(activities)))
    steps = pairs(events)
    first = F.min(F.struct("case_id", "pos"))
    within = steps.groupBy("case_id", "src", "dst").agg(
        F.count("*").alias("n"), F.sum("seconds").alias("total_s"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"),
        F.sum("tie").alias("ties"), F.min("pos").alias("pos"),
    )
    edges = within.groupBy("src", "dst").agg(
        F.sum("n").alias("n"), F.count("*").alias("cases"), F.sum("total_s").alias("total_s"), F.min("min_s").alias("min_s"),
        F.max("max_s").alias("max_s"), F.sum("ties").alias("ties"), first.alias("first"),
    )
    edges = edges.select("*", F.col("first.case_id").alias("first_case"), F.col("first.pos").alias("first_pos")).drop("first")
    histogram = steps.groupBy("src", "dst", duration_bucket(F.col("seconds")).alias("bucket")).agg(F.count("*").alias("n"))
    ends = events.groupBy("case_id").agg(F.min_by("activity", "pos").alias("s"), F.max_by("activity", "pos").alias("e"))
    starts = ends.groupBy(F.col("s").alias("activity")).agg(F.count("*").alias("n"))
    finishes = ends.groupBy(F.col("e").alias("activity")).agg(F.count("*").alias("n"))
    counts = events.groupBy("activity").agg(F.count("*").alias("n"))
    return DFG(edges, histogram, starts, finishes, counts, log.cases.agg(F.count("*").alias("cases")))


def diff(left: DFG, right: DFG) -> DataFrame:
    """Edges of two graphs by name: counts, shares of each side's total, their difference, and where only one has it."""
    one = left.edges.select("src", "dst", F.col("n").alias("l")).crossJoin(left.edge_total().select(F.col("n").alias("lt")))
    two = right.edges.select("src", "dst", F.col("n").alias("r")).crossJoin(right.edge_total().select(F.col("n").alias("rt")))
    both = one.join(two, ["src", "dst"], "full_outer")
    ls, rs = F.coalesce(F.col("l") / F.col("lt"), F.lit(0.0)), F.coalesce(F.col("r") / F.col("rt"), F.lit(0.0))
    return both.select(
        "src",
        "dst",
        F.coalesce("l", F.lit(0)).alias("left_count"),
        F.coalesce("r", F.lit(0)).alias("right_count"),
        ls.alias("left_share"),
        rs.alias("right_share"),
        (rs - ls).alias("share_delta"),
        F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("").alias("only_in"),
    )


def alphabet_overlap(left: EventLog, right: EventLog) -> DataFrame:
    """How many activities two logs share; ``warning`` says so if there are none."""
    one = left.events.select("activity").distinct().withColumn("l", F.lit(1))
    two = right.events.select("activity").distinct().withColumn("r", F.lit(1))
    both = one.join(two, "activity", "full_outer").agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"), F.count("*").alias("together")
    )
    said = F.when((F.col("shared") == 0) & (F.col("together") > 0), "the logs share no activity").otherwise("")
    return both.select("shared", "together", share(F.col("shared"), F.col("together")).alias("overlap"), said.alias("warning"))
