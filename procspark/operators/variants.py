"""Variants: distinct sequences of activities, how much they cover, rework, and what the order of ties changes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import activity_rank, share
from ..session import cut
from .eventlog import EventLog, by_case, canonical
from .ranking import before, by_ranges

#: Shares of cases for which the coverage curve counts variants.
POINTS = (0.5, 0.8, 0.9, 0.95, 0.99)


def sequences(events: DataFrame) -> DataFrame:
    """``variant``, the array of activities, for each case."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "activity")))
    got = events.groupBy("case_id").agg(ordered.alias("e"), (F.max("ts_s") - F.min("ts_s")).alias("duration_s"))
    return got.select("case_id", F.col("e.activity").alias("variant"), "duration_s")


def variant_counts(events: DataFrame) -> DataFrame:
    return sequences(events).groupBy("variant").agg(F.count("*").alias("n"), F.min("case_id").alias("first_case"))


def _levels(counts: DataFrame) -> DataFrame:
    """``n``, ``v`` variants with so many cases each, ``c0`` cases and ``v0`` variants of more frequent ones, and all cases.

    The window runs over distinct counts, whose sum is the number of cases, so they are few.
    """
    by_n = counts.groupBy("n").agg(F.count("*").alias("v"))
    earlier = W.orderBy(F.col("n").desc()).rowsBetween(W.unboundedPreceding, -1)
    over = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    return by_n.select(
        "n", "v", over(F.col("n") * F.col("v"), earlier).alias("c0"), over(F.col("v"), earlier).alias("v0"),
        F.sum(F.col("n") * F.col("v")).over(W.partitionBy(F.lit(0))).alias("total"),
    )


def _first_ones(reached: Callable[[Column], Column], guess: Column) -> Column:
    """How many of a level's variants, the first seen ones first, have fewer cases before them than asked for.

    ``reached`` tests the k-th one, from 0; ``guess`` is within one of the answer, and rounding decides at its edge.
    """
    low = F.greatest(F.lit(0), guess - 2)
    near = F.filter(F.sequence(low, low + 4), lambda k: (k < F.col("v")) & reached(k))
    return F.least(F.col("v"), low) + F.size(near)


def medians(seq: DataFrame) -> DataFrame:
    """The upper median of durations of each variant, from counts of days, and then of seconds in the middle day."""
    place = lambda w: F.coalesce(F.sum("k").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = seq.groupBy("variant", "duration_s").agg(F.count("*").alias("k")).withColumn("day", F.floor(F.col("duration_s") / 86400))
    days = counts.groupBy("variant", "day").agg(F.sum("k").alias("k"))
    by = W.partitionBy("variant")
    days = days.select("variant", "day", "k", place(by.orderBy("day")).alias("d0"), F.floor(F.sum("k").over(by) / 2).alias("half"))
    middle = days.where("d0 <= half and half < d0 + k").drop("k")
    inside = counts.join(middle, ["variant", "day"]).withColumn("s0", F.col("d0") + place(by.orderBy("duration_s")))
    return inside.where("s0 <= half and half < s0 + k").select("variant", F.col("duration_s").alias("median_s"))


def variant_table(log: EventLog, examples: int = 3) -> DataFrame:
    """Variants by rank: share, cumulative share, the first cases, and the upper median of durations.

    Variants are ranked by their count, and among equal counts by ranges of their first case; a common variant's cases
    are cut to the first ones before they meet, and its median comes from counts.  Equal sequences are told by 128 bits of hash.
    """
    # Written once, with 128 bits of hash in place of the sequence: nothing is ordered again or joined by long arrays.
    whole = cut(sequences(log.events).withColumn("key", F.struct(F.xxhash64("variant").alias("a"), F.xxhash64(F.lit(1), "variant").alias("b"))), "sequences")
    seq = whole.select(F.col("key").alias("variant"), "case_id", "duration_s")
    counts = cut(seq.groupBy("variant").agg(F.count("*").alias("n"), F.min("case_id").alias("first_case")), "counts")
    nth = F.row_number().over(W.partitionBy("variant").orderBy("case_id"))
    few = seq.select("variant", "case_id", nth.alias("i")).where(F.col("i") <= examples)
    few = few.groupBy("variant").agg(F.array_sort(F.collect_list("case_id")).alias("examples"))
    ranked = before(by_ranges(counts, "first_case"), ["n"], "_part", ["first_case"], {"k": F.lit(1)}).drop("_part").join(_levels(counts), "n")
    table = ranked.join(few, "variant").join(medians(seq), "variant").drop("variant")
    table = table.join(whole.select(F.col("case_id").alias("first_case"), "variant"), "first_case")
    return table.select(
        (F.col("v0") + F.col("k") + 1).cast("int").alias("variant_rank"), "variant", "n", (F.col("n") / F.col("total")).alias("case_share"),
        ((F.col("c0") + (F.col("k") + 1) * F.col("n")) / F.col("total")).alias("cumulative_share"), "examples", "median_s",
    )


def coverage_curve(log: EventLog, points: Iterable[float] = POINTS) -> DataFrame:
    """For each share of cases, how many of the most frequent variants reach it."""
    levels = _levels(variant_counts(log.events))

    def wanted(p: float) -> Column:
        guess = F.floor((F.lit(p) * F.col("total") - F.col("c0")) / F.col("n"))
        return F.coalesce(F.sum(_first_ones(lambda k: (F.col("c0") + k * F.col("n")) / F.col("total") < F.lit(p), guess)), F.lit(0))

    points = [float(p) for p in points]
    wide = levels.agg(*[wanted(p).alias(f"p{i}") for i, p in enumerate(points)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(p).alias("coverage"), F.col(f"p{i}").alias("variants")) for i, p in enumerate(points)])))


def cases_covering(log: EventLog, coverage: float) -> DataFrame:
    """Cases of the most frequent variants, up to and with the one that reaches the coverage; 0 gives none."""
    counts = variant_counts(log.events)
    budget = F.col("total") * F.lit(float(coverage))
    guess = F.floor((budget - F.col("c0")) / F.col("n"))
    levels = _levels(counts).select("n", "v", _first_ones(lambda k: F.col("c0") + k * F.col("n") < budget, guess).alias("take"))
    placed = counts.join(levels.where("take > 0"), "n")
    # Only the level in which the coverage is reached needs an order.
    edge = before(by_ranges(placed.where("take < v"), "first_case"), ["n"], "_part", ["first_case"], {"k": F.lit(1)}).where("k < take")
    chosen = placed.where("take = v").select("variant").union(edge.select("variant"))
    return sequences(log.events).join(chosen, "variant", "left_semi").select("case_id")


def collapsed_counts(log: EventLog) -> DataFrame:
    """Variants with immediate repeats of an activity counted as one."""
    previous = F.lag("activity").over(by_case())
    kept = log.events.withColumn("same", F.coalesce(previous == F.col("activity"), F.lit(False))).where(~F.col("same"))
    return variant_counts(kept)


def rework(log: EventLog) -> DataFrame:
    """How often a case repeats an activity, beyond the first time."""
    per = log.events.groupBy("case_id", "activity").agg((F.count("*") - 1).alias("repeats"))
    return per.where("repeats > 0")


def rework_by_activity(log: EventLog) -> DataFrame:
    return rework(log).groupBy("activity").agg(F.sum("repeats").alias("repeats"), F.count("*").alias("cases"))


def top_rework(log: EventLog, k: int = 5) -> DataFrame:
    """The ``k`` activities that are repeated most, by name where they tie; beside ``summary``."""
    return rework_by_activity(log).orderBy(F.desc("repeats"), "activity").limit(k)


def rework_ratio(log: EventLog) -> DataFrame:
    """Repeats as a share of all events, and the share of cases that have any."""
    per_case = log.events.groupBy("case_id", "activity").agg(F.count("*").alias("n")).groupBy("case_id").agg(
        F.sum("n").alias("events"), F.sum(F.col("n") - 1).alias("repeats")
    )
    return per_case.agg(
        share(F.coalesce(F.sum("repeats"), F.lit(0)), F.coalesce(F.sum("events"), F.lit(0))).alias("rework_ratio"),
        F.count_if(F.col("repeats") > 0).alias("cases_with_rework"),
    )


def self_loop_ratio(log: EventLog) -> DataFrame:
    """Immediate repeats as a share of all events."""
    same = (F.col("activity") == F.lag("activity").over(by_case())).cast("bigint")
    marked = log.events.select(F.coalesce(same, F.lit(0)).alias("same"))
    return marked.agg(share(F.coalesce(F.sum("same"), F.lit(0)), F.count("*")).alias("self_loop_ratio"))


def summary(log: EventLog) -> DataFrame:
    """One row: cases, variants, the largest variant's share, collapsed variants, rework and self-loop ratios."""
    counts = variant_counts(log.events).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("cases"), F.count("*").alias("variants"),
        share(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).alias("most_common_share"),
    )
    collapsed = collapsed_counts(log).agg(F.count("*").alias("collapsed_variants"))
    return counts.crossJoin(collapsed).crossJoin(rework_ratio(log)).crossJoin(self_loop_ratio(log))  # one row each


def order_sensitivity(raw: DataFrame, ranks: Mapping[str, int]) -> DataFrame:
    """What the declared rank changes: one row that compares arrival order with ranked order.

    ``raw`` must come in source order (its ``arrival``), not from a log that was ranked before.  Only a tie between
    different activities can change a sequence; those are counted as consequential.
    """
    plain = canonical(raw)
    rank = activity_rank(F.col("activity"), ranks)
    previous = F.lag("activity").over(by_case())
    marked = plain.withColumn("consequential", F.col("tie_broken") & (previous != F.col("activity"))).withColumn("rank", rank)
    # The ranked sequence is the same rows in another order, so one shuffle by case serves both.
    ordered = lambda *by: F.array_sort(F.collect_list(F.struct(*by, "pos", "activity")))["activity"]
    grouped = marked.groupBy("case_id").agg(
        F.count("*").alias("events"), F.sum(F.col("tie_broken").cast("bigint")).alias("ties"),
        F.count_if("consequential").alias("consequential"),
        ordered().alias("arrived"), ordered("ts_s", "sort_hint", "rank").alias("ranked"),
    )
    total = grouped.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.count("*").alias("cases"),
        F.coalesce(F.sum("ties"), F.lit(0)).alias("tie_broken_events"), F.count_if(F.col("ties") > 0).alias("cases_affected"),
        F.coalesce(F.sum("consequential"), F.lit(0)).alias("consequential_ties"),
        F.count_if(F.col("arrived") != F.col("ranked")).alias("cases_whose_sequence_changed"),
    )
    one = grouped.select("arrived").distinct().agg(F.count("*").alias("variants_arrival_order"))
    two = grouped.select("ranked").distinct().agg(F.count("*").alias("variants_declared_order"))
    out = total.crossJoin(one).crossJoin(two)  # one row each
    return out.select(
        "*",
        (F.col("variants_arrival_order") - F.col("variants_declared_order")).alias("variants_collapsed"),
        share(F.col("tie_broken_events"), F.col("events")).alias("tie_broken_share"),
        share(F.col("consequential_ties"), F.col("events")).alias("consequential_tie_share"),
    )
