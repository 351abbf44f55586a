"""Reports over logs and spans: what a log holds, how a sample differs from it, findings of each run, and traces with their observations."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import flow_of, resource_kind
from ..policy import Policy
from ..schema import FLOW, SECOND
from ..session import cut, dealt
from . import rules, spans, variants
from .eventlog import EventLog


def top_coverage(log: EventLog, k: int = 20) -> DataFrame:
    """One row: the share of cases in the ``k`` most frequent variants."""
    levels = variants._levels(variants.variant_counts(log.events))
    taken = F.least(F.col("v"), F.greatest(F.lit(0), F.lit(k) - F.col("v0")))
    return levels.agg(F.coalesce(F.sum(F.col("n") * taken) / F.max("total"), F.lit(0.0)).alias("coverage"))


def scan(log: EventLog, named: Mapping[str, str] | None = None) -> DataFrame:
    """``(statistic, name, n)`` of a whole log: totals, activities, flows, kinds of resources, and cases by length.

    ``named`` maps a statistic to the case attribute whose distinct values it counts.  Values are grouped before they
    are counted, so no set grows in one task.
    """
    row = lambda df, statistic, name, n: df.select(F.lit(statistic).alias("statistic"), name.alias("name"), n.alias("n"))
    one = lambda df, statistic, n: row(df.agg(n.cast("bigint").alias("n")), statistic, F.lit(""), F.col("n"))
    each = lambda df, statistic, name: row(df.groupBy(name.alias("name")).agg(F.count("*").alias("n")), statistic, F.col("name"), F.col("n"))
    e, c = log.events, log.cases
    parts = [
        one(c, "cases", F.count("*")), one(e, "events", F.count("*")), one(e, "day_precision_events", F.count_if(F.col("precision") != SECOND)),
        one(variants.variant_counts(e), "variants", F.count("*")), each(e, "activity", F.col("activity")), each(e, "kind", resource_kind(F.col("resource"))),
        each(c, "flow", flow_of(F.col("attrs"), FLOW)), each(c, "events_in_case", F.col("event_count").cast("string")),
    ]
    for statistic, key in (named or {}).items():
        values = c.select(flow_of(F.col("attrs"), key).alias("x")).where("x <> ''").distinct()
        parts.append(one(values, statistic, F.count("*")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def disclosure(full: EventLog, sample: EventLog) -> DataFrame:
    """Each statistic of the log beside the sample's, with shares of events or cases; what either lacks is 0."""
    one, two = scan(full), scan(sample)
    both = one.withColumnRenamed("n", "in_log").join(two.withColumnRenamed("n", "in_sample"), ["statistic", "name"], "full_outer").na.fill(0, ["in_log", "in_sample"])
    totals = both.where("statistic in ('cases', 'events')").agg(
        *[F.max(F.when(F.col("statistic") == t, F.col(c))).alias(f"{c}_{t}") for t in ("cases", "events") for c in ("in_log", "in_sample")]
    )
    of_events = F.col("statistic").isin("activity", "kind", "events", "day_precision_events")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.when(of_events, F.col(f"{c}_events")).otherwise(F.col(f"{c}_cases"))), F.lit(0.0))
    wide = both.crossJoin(totals)  # one row
    return wide.select("statistic", "name", "in_log", share("in_log").alias("log_share"), "in_sample", share("in_sample").alias("sample_share"))


def _of_key(name: str) -> Column:
    return F.get_json_object("case_id", f"$.{name}")


def log_of_runs(span_rows: DataFrame, runs: DataFrame, tools: Mapping[str, str], policy: Policy, attributes: DataFrame | None = None) -> EventLog:
    """Business events of all runs as one log, in which a case is an item within a run.

    ``attributes`` (case_id, attrs) has attributes of items, such as their flow; without it, rules for some flows have
    nothing in scope, which ``findings_scope`` shows.
    """
    raw = spans.layered(span_rows, runs, "business", tools).withColumn("run_id", F.col("attrs")["run_id"])
    key = F.to_json(F.struct("run_id", F.col("case_id").alias("item_key")))
    raw = raw.withColumn("own", key)
    cases = raw.select(F.col("own").alias("case_id"), F.col("case_id").alias("item")).distinct()
    if attributes is not None:
        cases = cases.join(attributes.select(F.col("case_id").alias("item"), "attrs"), "item", "left").select("case_id", "attrs")
    else:
        cases = cases.select("case_id", F.create_map().cast("map<string,string>").alias("attrs"))
    log = EventLog.build(raw.drop("case_id", "run_id").withColumnRenamed("own", "case_id"), policy.activity_rank, cases)
    return replace(log, log_id="runs")


def _judged(span_rows: DataFrame, runs: DataFrame, tools: Mapping[str, str], policy: Policy, attributes: DataFrame | None) -> EventLog:
    """The log of runs with what rules look at, put in order once for all of them, in tasks of bounded size."""
    log = log_of_runs(span_rows, runs, tools, policy, attributes)
    events = log.events.select("case_id", "pos", "activity", "ts_s", "resource", "value_cents", "tie_broken")
    cases = log.cases.select("case_id", "attrs")
    return replace(log, events=dealt(cut(events, "events"), "case_id"), cases=dealt(cut(cases, "cases"), "case_id"))


def findings_by_run(span_rows: DataFrame, runs: DataFrame, tools: Mapping[str, str], policy: Policy, attributes: DataFrame | None = None) -> DataFrame:
    """What the rules find in each run's own business events, for all runs in one pass: ``run_id`` beside a violation.

    A case is an item within a run, so every window and aggregate of the rules stays within the run, and a rule that
    can't be answered for one run is off in that run alone.
    """
    log = _judged(span_rows, runs, tools, policy, attributes)
    found = rules.evaluate(log, policy, part=_of_key("run_id")).violations
    return found.select(
        _of_key("run_id").alias("run_id"), _of_key("item_key").alias("case_id"), "rule_id", "at_seq", "order_assumed", "summary", "detail"
    )


def findings_scope(span_rows: DataFrame, runs: DataFrame, tools: Mapping[str, str], policy: Policy, attributes: DataFrame | None = None) -> DataFrame:
    """``(run_id, rule_id, in_scope, violations, status)`` for each run with business events and each rule.

    The status tells a rule that found nothing (``evaluated``) from one without any case to look at (``nothing in
    scope``) and from one that the run's events can't answer (``not applicable``).
    """
    log = _judged(span_rows, runs, tools, policy, attributes)
    run = _of_key("run_id")
    got = rules.evaluate(log, policy, part=run)
    found = got.violations.groupBy(run.alias("part"), "rule_id").agg(F.count("*").alias("violations"))
    off = got.not_applicable.select("part", "rule_id", F.lit(True).alias("off"))
    df = rules.scoped(log, policy, run).join(found, ["part", "rule_id"], "left").join(off, ["part", "rule_id"], "left")
    status = F.when(F.col("off"), "not applicable").when(F.col("in_scope") == 0, "nothing in scope").otherwise("evaluated")
    return df.select(F.col("part").alias("run_id"), "rule_id", "in_scope", F.coalesce("violations", F.lit(0)).alias("violations"), status.alias("status"))


def milliseconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def longest_traces(traces: DataFrame, observations: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` traces with the most observations: ``trace_id``, ``observations`` and the ``seconds`` from first to last.

    ``traces`` has trace_id, ``observations`` trace_id, start_time and end_time, which may be null.
    """
    seen = traces.select("trace_id").join(observations, "trace_id").groupBy("trace_id").agg(
        F.count("*").alias("observations"), F.min("start_time").alias("t0"), F.max(F.coalesce("end_time", "start_time")).alias("t1")
    )
    out = seen.select("trace_id", "observations", F.round(milliseconds(F.col("t0"), F.col("t1")) / 1000, 2).alias("seconds"))
    return out.orderBy(F.desc("observations"), F.desc("seconds"), "trace_id").limit(k)


def mixed_versions(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Keys that come with more than one version, and the versions; versions of a key are few, so they are listed."""
    pairs = rows.where(F.coalesce(F.col(key), F.lit("")) != "").select(key, version).distinct()
    return pairs.groupBy(key).agg(F.array_sort(F.collect_list(version)).alias("versions")).where(F.size("versions") > 1)


def usage(rows: DataFrame, model: str, tokens: str, names: tuple[str, ...]) -> DataFrame:
    """Calls of each model and sums of entries of a map of tokens; a missing name is ``unmeasured``, a missing entry 0."""
    sums = [F.coalesce(F.sum(F.element_at(tokens, F.lit(n))), F.lit(0)).alias(f"{n}_tokens") for n in names]
    return rows.groupBy(F.coalesce(model, F.lit("unmeasured")).alias("model")).agg(F.count("*").alias("calls"), *sums)


def next_number(rows: DataFrame, key: str, number: str, keys: DataFrame) -> DataFrame:
    """The number that each key gives next; 0 for a key without rows."""
    most = rows.groupBy(key).agg(F.max(number).alias("most"))
    return keys.select(key).distinct().join(most, key, "left").select(key, (F.coalesce("most", F.lit(-1)) + 1).alias("next"))


def most_common(rows: DataFrame, name: Column, k: int) -> DataFrame:
    """The ``k`` most frequent names, ties by name; each task keeps its own ``k`` rows only.  Null and empty names count as such."""
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)
