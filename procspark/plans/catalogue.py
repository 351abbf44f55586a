"""The registered queries: each a plan over the standard tables, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import checks, controls, dfg, filters, rules, variants
from ..operators import spans as sp
from ..operators.eventlog import EventLog
from ..schema import FLOW
from ..functions import typed
from ..session import cut, scratch_dir
from ..sources import csv, otlp, tables, xes
from .views import (
    EVENTS_RAW, EVENTS_SQL, ITEMS_SQL, LINES_SQL, ORDERS_SQL, POLICY, RANKS, SPANS_SQL, TOOLS, events_log, events_raw, items, lines_log, messages,
    orders_log, runs, spans, table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            # A query may begin with more table expressions of its own.
            SQL[fn.__name__] = ("WITH " + ",\n".join(ctes) + ("" if sql.startswith(",") else "\n") if ctes else "") + sql
        return fn

    return register


def _ids(log: EventLog) -> DataFrame:
    return log.cases.select("case_id", "event_count")


# Event log


@query("SELECT case_id, pos, activity, ts_s, resource, value_cents, tie_broken FROM ev", EVENTS_SQL)
def canonical_order(s, d):
    return events_log(s, d).events.select("case_id", "pos", "activity", "ts_s", "resource", "value_cents", "tie_broken")


@query("SELECT case_id, pos, activity, ts_s, tie_broken FROM le", LINES_SQL)
def canonical_lines(s, d):
    return lines_log(s, d).events.select("case_id", "pos", "activity", "ts_s", "tie_broken")


@query(
    "SELECT CAST(row_number() OVER (ORDER BY case_id, pos) - 1 AS BIGINT) AS seq, CAST(dense_rank() OVER (ORDER BY case_id) - 1 AS BIGINT) AS case_index, case_id, pos FROM ev",
    EVENTS_SQL,
)
def log_positions(s, d):
    return events_log(s, d).numbered().select("seq", "case_index", "case_id", "pos")


@query("SELECT case_id, start_ts, end_ts, event_count, flow, end_ts - start_ts AS duration_s FROM ca", EVENTS_SQL)
def case_table(s, d):
    c = events_log(s, d).cases
    return c.select("case_id", "start_ts", "end_ts", "event_count", F.col("attrs")[FLOW].alias("flow"), (F.col("end_ts") - F.col("start_ts")).alias("duration_s"))


@query(
    """SELECT (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM ca) AS cases, (SELECT CAST(count_if(tie_broken) AS BIGINT) FROM ev) AS tie_broken_events,
  (SELECT count(DISTINCT activity) FROM ev) AS activities, (SELECT count(DISTINCT resource) FROM ev) AS named_resources, (SELECT count(DISTINCT resource) + 1 FROM ev) AS resources,
  (SELECT count(DISTINCT v) FROM (SELECT string_agg(activity, '>' ORDER BY pos) AS v FROM ev GROUP BY case_id)) AS variants,
  (SELECT min(ts_s) FROM ev) AS first_ts, (SELECT max(ts_s) FROM ev) AS last_ts""",
    EVENTS_SQL,
)
def log_summary(s, d):
    return events_log(s, d).summary().drop("day_precision_events")


@query("SELECT activity, count(*) AS n FROM ev GROUP BY 1", EVENTS_SQL)
def activity_frequency(s, d):
    return events_log(s, d).activity_frequency()


@query("SELECT resource, count(*) AS n FROM ev GROUP BY 1", EVENTS_SQL)
def resource_frequency(s, d):
    return events_log(s, d).resource_frequency()


@query("SELECT case_id, count(*) AS ties FROM ev WHERE tie_broken GROUP BY 1", EVENTS_SQL)
def tie_broken_cases(s, d):
    return events_log(s, d).tie_broken_cases()


@query("SELECT min(ts_s) AS first_ts, max(ts_s) AS last_ts FROM ev", EVENTS_SQL)
def time_span(s, d):
    return events_log(s, d).time_span()


@query(
    "SELECT case_id, string_agg(activity, '>' ORDER BY pos) AS trace, CAST(sum(value_cents) AS BIGINT) AS value_cents, max(ts_s) - min(ts_s) AS duration_s FROM ev GROUP BY 1",
    EVENTS_SQL,
)
def traces(s, d):
    t = events_log(s, d).traces()
    total = F.aggregate("events.value_cents", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return t.select("case_id", F.array_join("events.activity", ">").alias("trace"), total.alias("value_cents"), "duration_s")


@query("SELECT ev.case_id, pos, activity, ca.flow FROM ev LEFT JOIN ca USING (case_id)", EVENTS_SQL)
def events_with_case_attributes(s, d):
    e = events_log(s, d).with_case_attributes()
    return e.select("case_id", "pos", "activity", F.col("case_attrs")[FLOW].alias("flow"))


@query("SELECT DISTINCT resource, CASE WHEN resource LIKE 'user%' THEN 'human' ELSE 'unknown' END AS kind FROM ev", EVENTS_SQL)
def resource_kind(s, d):
    return events_log(s, d).events.select("resource").distinct().withColumn("kind", expr.resource_kind(F.col("resource")))


# Directly-follows graph

_PAIRS = """pr AS (SELECT case_id, pos, lag(activity) OVER w AS src, activity AS dst, ts_s - lag(ts_s) OVER w AS sec, tie_broken FROM {t} WINDOW w AS (PARTITION BY case_id ORDER BY pos)),
ed AS (SELECT src, dst, count(*) AS n, count(DISTINCT case_id) AS cases, CAST(sum(sec) AS BIGINT) AS total_s, min(sec) AS min_s, max(sec) AS max_s,
  CAST(count_if(tie_broken) AS BIGINT) AS ties, arg_min(case_id, case_id || lpad(CAST(pos AS VARCHAR), 9, '0')) AS fc, min(struct_pack(c := case_id, p := pos)) AS f FROM pr WHERE src IS NOT NULL GROUP BY 1, 2)"""
_EV_PAIRS, _OE_PAIRS = _PAIRS.format(t="ev"), _PAIRS.format(t="oe")
_EDGE = ("src", "dst", "n", "cases", "total_s", "min_s", "max_s", "ties")
_EDGE_SQL = "SELECT src, dst, n, cases, total_s, min_s, max_s, ties FROM ed"


@query(_EDGE_SQL, ORDERS_SQL, _OE_PAIRS)
def dfg_edges(s, d):
    return dfg.build(orders_log(s, d)).edges.select(*_EDGE)


@query(_EDGE_SQL, EVENTS_SQL, _EV_PAIRS)
def dfg_edges_events(s, d):
    return dfg.build(events_log(s, d)).edges.select(*_EDGE)


@query(
    """SELECT 'start' AS side, activity, count(*) AS n FROM (SELECT arg_min(activity, pos) AS activity FROM ev GROUP BY case_id) GROUP BY 2
UNION ALL SELECT 'end', activity, count(*) FROM (SELECT arg_max(activity, pos) AS activity FROM ev GROUP BY case_id) GROUP BY 2""",
    EVENTS_SQL,
)
def dfg_starts_ends(s, d):
    g = dfg.build(events_log(s, d))
    return g.starts.select(F.lit("start").alias("side"), "activity", "n").union(g.ends.select(F.lit("end"), "activity", "n"))


_BUCKET = "CASE WHEN sec <= 0 THEN 0 ELSE CAST(least(53, 1 + floor(ln(sec) / ln(pow(10, 1.0::DOUBLE / 6)))) AS INTEGER) END"
_HIST = f"hi AS (SELECT src, dst, {_BUCKET} AS bucket, count(*) AS n FROM pr WHERE src IS NOT NULL GROUP BY 1, 2, 3)"


@query("SELECT src, dst, bucket, n FROM hi", EVENTS_SQL, _EV_PAIRS, _HIST)
def dfg_edge_histogram(s, d):
    return dfg.build(events_log(s, d)).histogram


@query(
    """SELECT src, dst, CAST(any_value(min_s) AS DOUBLE) AS q00, round(greatest(any_value(min_s), least(any_value(max_s), min(CASE WHEN upto >= 0.5 * n THEN mid END))), 4) AS q50,
  round(greatest(any_value(min_s), least(any_value(max_s), min(CASE WHEN upto >= 0.9 * n THEN mid END))), 4) AS q90
FROM (SELECT src, dst, bucket, sum(hi.n) OVER (PARTITION BY src, dst ORDER BY bucket) AS upto, CASE WHEN bucket <= 0 THEN 0.0 ELSE pow(10, (bucket - 0.5::DOUBLE) / 6) END AS mid FROM hi)
JOIN ed USING (src, dst) GROUP BY 1, 2""",
    EVENTS_SQL, _EV_PAIRS, _HIST,
)
def dfg_edge_quantiles(s, d):
    q = dfg.build(events_log(s, d)).quantiles([0, 0.5, 0.9])
    return q.select("src", "dst", "q00", F.round("q50", 4).alias("q50"), F.round("q90", 4).alias("q90"))


@query("SELECT src AS activity, n FROM ed WHERE src = dst", EVENTS_SQL, _EV_PAIRS)
def dfg_self_loops(s, d):
    return dfg.build(events_log(s, d)).self_loops()


@query(
    """SELECT activity, coalesce(o.n, 0) AS successors, coalesce(i.n, 0) AS predecessors FROM (SELECT DISTINCT activity FROM ev)
LEFT JOIN (SELECT src, count(*) AS n FROM ed GROUP BY 1) o ON o.src = activity LEFT JOIN (SELECT dst, count(*) AS n FROM ed GROUP BY 1) i ON i.dst = activity""",
    EVENTS_SQL, _EV_PAIRS,
)
def dfg_degree(s, d):
    return dfg.build(events_log(s, d)).degrees()


@query("SELECT src, dst, n FROM ed ORDER BY n DESC, f LIMIT 5", EVENTS_SQL, _EV_PAIRS)
def dfg_top_edges(s, d):
    return dfg.build(events_log(s, d)).top_edges(5).select("src", "dst", "n")


@query("SELECT src, dst, n, total_s, total_s / n AS mean_s FROM ed WHERE n >= 5 ORDER BY total_s DESC, f LIMIT 5", EVENTS_SQL, _EV_PAIRS)
def dfg_bottlenecks(s, d):
    return dfg.build(events_log(s, d)).bottlenecks(5).select("src", "dst", "n", "total_s", (F.col("total_s") / F.col("n")).alias("mean_s"))


@query("SELECT src, dst, n FROM ed WHERE n >= 100", EVENTS_SQL, _EV_PAIRS)
def dfg_min_count(s, d):
    return dfg.build(events_log(s, d)).filter_edges(min_count=100).edges.select("src", "dst", "n")


@query(
    "SELECT src, dst, n FROM (SELECT src, dst, n, coalesce(sum(n) OVER (ORDER BY n DESC, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM ed) WHERE b < 0.6::DOUBLE * t",
    EVENTS_SQL, _EV_PAIRS,
)
def dfg_keep_fraction(s, d):
    return dfg.build(events_log(s, d)).filter_edges(keep_fraction=0.6).edges.select("src", "dst", "n")


@query(_EDGE_SQL, EVENTS_SQL, "al AS (SELECT * FROM ev WHERE activity IN ('view', 'purchase'))", _PAIRS.format(t="al"))
def dfg_allow_list(s, d):
    return dfg.build(events_log(s, d), ["view", "purchase"]).edges.select(*_EDGE)


_SIDES = """f0 AS (SELECT ev.* EXCLUDE (flow), ca.flow FROM ev JOIN ca USING (case_id)),
p2 AS (SELECT flow, lag(activity) OVER w AS src, activity AS dst FROM f0 WINDOW w AS (PARTITION BY case_id ORDER BY pos)),
a AS (SELECT src, dst, count(*) AS n FROM p2 WHERE src IS NOT NULL AND flow = 'flow0' GROUP BY 1, 2), b AS (SELECT src, dst, count(*) AS n FROM p2 WHERE src IS NOT NULL AND flow = 'flow1' GROUP BY 1, 2)"""


@query(
    """SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, coalesce(a.n, 0) AS left_count, coalesce(b.n, 0) AS right_count,
  round(coalesce(a.n / (SELECT sum(n) FROM a), 0), 9) AS left_share, round(coalesce(b.n / (SELECT sum(n) FROM b), 0), 9) AS right_share,
  round(coalesce(b.n / (SELECT sum(n) FROM b), 0) - coalesce(a.n / (SELECT sum(n) FROM a), 0), 9) AS share_delta,
  CASE WHEN b.n IS NULL THEN 'left' WHEN a.n IS NULL THEN 'right' ELSE '' END AS only_in FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst""",
    EVENTS_SQL, _SIDES,
)
def dfg_diff(s, d):
    log = events_log(s, d)
    out = dfg.diff(dfg.build(filters.by_flow(log, "flow0")), dfg.build(filters.by_flow(log, "flow1")))
    shares = {c: F.round(c, 9) for c in ("left_share", "right_share", "share_delta")}
    return out.withColumns(shares)


@query(
    """SELECT CAST(count_if(l AND r) AS BIGINT) AS shared, count(*) AS together, CAST(count_if(l AND r) AS DOUBLE) / count(*) AS overlap, CASE WHEN count_if(l AND r) = 0 THEN 'the logs share no activity' ELSE '' END AS warning
FROM (SELECT activity, bool_or(s = 0) AS l, bool_or(s = 1) AS r FROM (SELECT 0 AS s, activity FROM ev UNION ALL SELECT 1, activity FROM oe) GROUP BY 1)""",
    EVENTS_SQL, ORDERS_SQL,
)
def alphabet_overlap(s, d):
    return dfg.alphabet_overlap(events_log(s, d), orders_log(s, d))


# Variants

_VARIANTS = """vs AS (SELECT case_id, string_agg(activity, '>' ORDER BY pos) AS variant, max(ts_s) - min(ts_s) AS dur FROM ev GROUP BY 1),
vc AS (SELECT variant, count(*) AS n, min(case_id) AS fc FROM vs GROUP BY 1),
vr AS (SELECT *, sum(n) OVER () AS t, row_number() OVER (ORDER BY n DESC, fc) AS rk, coalesce(sum(n) OVER (ORDER BY n DESC, fc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM vc)"""


@query("SELECT variant, n FROM vc", EVENTS_SQL, _VARIANTS)
def variant_counts(s, d):
    v = variants.variant_counts(events_log(s, d).events)
    return v.select(F.array_join("variant", ">").alias("variant"), "n")


@query(
    """SELECT CAST(rk AS INTEGER) AS variant_rank, variant, n, round(n / t, 9) AS case_share, round((b + n) / t, 9) AS cumulative_share,
  (SELECT string_agg(case_id, ',' ORDER BY case_id) FROM (SELECT case_id FROM vs WHERE vs.variant = vr.variant ORDER BY case_id LIMIT 3)) AS examples,
  m AS median_s FROM vr JOIN (SELECT variant AS v2, list_sort(list(dur))[count(*) // 2 + 1] AS m FROM vs GROUP BY 1) ON v2 = variant""",
    EVENTS_SQL, _VARIANTS,
)
def variant_table(s, d):
    t = variants.variant_table(events_log(s, d))
    return t.select(
        "variant_rank", F.array_join("variant", ">").alias("variant"), "n", F.round("case_share", 9).alias("case_share"),
        F.round("cumulative_share", 9).alias("cumulative_share"), F.array_join("examples", ",").alias("examples"), "median_s",
    )


@query("SELECT p AS coverage, CAST(count_if(b / t < p) AS BIGINT) AS variants FROM vr, (SELECT unnest([0.5::DOUBLE, 0.8, 0.9, 0.95, 0.99]) AS p) GROUP BY 1", EVENTS_SQL, _VARIANTS)
def coverage_curve(s, d):
    return variants.coverage_curve(events_log(s, d))


@query("SELECT case_id FROM vs JOIN vr USING (variant) WHERE b < 0.5::DOUBLE * t", EVENTS_SQL, _VARIANTS)
def cases_covering(s, d):
    return variants.cases_covering(events_log(s, d), 0.5)


_COLLAPSED = """cl AS (SELECT v AS variant, count(*) AS n FROM (SELECT case_id, string_agg(activity, '>' ORDER BY pos) AS v FROM
  (SELECT *, lag(activity) OVER (PARTITION BY case_id ORDER BY pos) AS p FROM ev) WHERE p IS DISTINCT FROM activity GROUP BY 1) GROUP BY 1)"""


@query("SELECT variant, n FROM cl", EVENTS_SQL, _COLLAPSED)
def collapsed_variants(s, d):
    return variants.collapsed_counts(events_log(s, d)).select(F.array_join("variant", ">").alias("variant"), "n")


@query("SELECT activity, CAST(sum(k - 1) AS BIGINT) AS repeats, count(*) AS cases FROM (SELECT case_id, activity, count(*) AS k FROM ev GROUP BY 1, 2) WHERE k > 1 GROUP BY 1", EVENTS_SQL)
def rework_by_activity(s, d):
    return variants.rework_by_activity(events_log(s, d))


_REWORK = "(SELECT (count(*) - count(DISTINCT case_id || '|' || activity)) / count(*) FROM ev)"
_REWORKED = "(SELECT count(DISTINCT case_id) FROM (SELECT case_id FROM ev GROUP BY case_id, activity HAVING count(*) > 1))"
_LOOPS = "(SELECT CAST(count_if(activity = p) AS DOUBLE) / count(*) FROM (SELECT activity, lag(activity) OVER (PARTITION BY case_id ORDER BY pos) AS p FROM ev))"


@query(f"SELECT {_REWORK} AS rework_ratio, {_REWORKED} AS cases_with_rework", EVENTS_SQL)
def rework_ratio(s, d):
    return variants.rework_ratio(events_log(s, d))


@query(f"SELECT {_LOOPS} AS self_loop_ratio", EVENTS_SQL)
def self_loop_ratio(s, d):
    return variants.self_loop_ratio(events_log(s, d))


@query(
    f"""SELECT (SELECT count(*) FROM ca) AS cases, (SELECT count(*) FROM vc) AS variants, (SELECT max(n) / (SELECT count(*) FROM ca) FROM vc) AS most_common_share,
  (SELECT count(*) FROM cl) AS collapsed_variants, {_REWORK} AS rework_ratio, {_REWORKED} AS cases_with_rework, {_LOOPS} AS self_loop_ratio""",
    EVENTS_SQL, _VARIANTS, _COLLAPSED,
)
def variant_summary(s, d):
    return variants.summary(events_log(s, d))


@query(
    """SELECT (SELECT count(*) FROM er) AS events, count(*) AS cases, CAST(sum(t) AS BIGINT) AS tie_broken_events, CAST(count_if(t > 0) AS BIGINT) AS cases_affected, CAST(sum(c) AS BIGINT) AS consequential_ties,
  CAST(count_if(a <> r) AS BIGINT) AS cases_whose_sequence_changed, count(DISTINCT a) AS variants_arrival_order, count(DISTINCT r) AS variants_declared_order,
  count(DISTINCT a) - count(DISTINCT r) AS variants_collapsed, CAST(sum(t) AS DOUBLE) / (SELECT count(*) FROM er) AS tie_broken_share, CAST(sum(c) AS DOUBLE) / (SELECT count(*) FROM er) AS consequential_tie_share
FROM (SELECT case_id, count_if(tie) AS t, count_if(tie AND pa <> activity) AS c, string_agg(activity, '>' ORDER BY ts_s, arrival) AS a, string_agg(activity, '>' ORDER BY ts_s, rnk, arrival) AS r FROM
  (SELECT *, coalesce(ts_s = lag(ts_s) OVER w, false) AS tie, lag(activity) OVER w AS pa FROM er WINDOW w AS (PARTITION BY case_id ORDER BY ts_s, arrival)) GROUP BY 1)""",
    EVENTS_RAW,
)
def order_sensitivity(s, d):
    return variants.order_sensitivity(events_raw(s, d), RANKS)


# Filters

_CASES = "SELECT case_id, event_count FROM ca WHERE "


@query(_CASES + "flow IN ('flow1', 'flow2')", EVENTS_SQL)
def filter_flow(s, d):
    return _ids(filters.by_flow(events_log(s, d), "flow1", "flow2"))


@query("SELECT case_id, event_count FROM oc WHERE flow = 'BUILDING'", ORDERS_SQL)
def filter_attr(s, d):
    return _ids(filters.by_case_attribute(orders_log(s, d), FLOW, "BUILDING"))


@query("SELECT case_id, count(*) AS event_count FROM ev WHERE case_id IN (SELECT case_id FROM vs JOIN vr USING (variant) WHERE b < 0.7::DOUBLE * t) GROUP BY 1", EVENTS_SQL, _VARIANTS)
def filter_coverage(s, d):
    return _ids(filters.by_variant_coverage(events_log(s, d), 0.7))


@query(_CASES + "case_id IN (SELECT case_id FROM ev WHERE activity = 'error')", EVENTS_SQL)
def filter_contains(s, d):
    return _ids(filters.containing_activity(events_log(s, d), "error"))


@query(_CASES + "case_id NOT IN (SELECT case_id FROM ev WHERE activity IN ('error', 'signup'))", EVENTS_SQL)
def filter_excludes(s, d):
    return _ids(filters.excluding_activity(events_log(s, d), "error", "signup"))


_MID = "(SELECT CAST(avg(ts_s) AS BIGINT) // 3600 * 3600 FROM ev)"


def _middle(log: EventLog) -> int:
    return int(log.events.agg((F.floor(F.round(F.avg("ts_s")) / 3600) * 3600).cast("bigint")).first()[0])


@query(_CASES + f"start_ts >= {_MID} AND end_ts <= {_MID} + 864000", EVENTS_SQL)
def filter_time_contained(s, d):
    log = events_log(s, d)
    t = _middle(log)
    return _ids(filters.by_timeframe(log, t, t + 864000))


@query(_CASES + f"end_ts >= {_MID} AND start_ts <= {_MID} + 864000", EVENTS_SQL)
def filter_time_intersecting(s, d):
    log = events_log(s, d)
    t = _middle(log)
    return _ids(filters.by_timeframe(log, t, t + 864000, "intersecting"))


@query(_CASES + f"start_ts >= {_MID}", EVENTS_SQL)
def filter_time_started(s, d):
    log = events_log(s, d)
    return _ids(filters.by_timeframe(log, _middle(log), None, "started"))


@query(_CASES + "event_count BETWEEN 3 AND 5", EVENTS_SQL)
def filter_length(s, d):
    return _ids(filters.by_case_length(events_log(s, d), 3, 5))


@query(_CASES + "case_id IN (SELECT case_id FROM ev GROUP BY 1 HAVING arg_min(activity, pos) = 'view' AND max(ts_s) - min(ts_s) > 7200)", EVENTS_SQL)
def filter_where(s, d):
    return _ids(filters.where(events_log(s, d), "events[0].activity = 'view' and duration_s > 7200"))


# Rules

_FACTS = """fa AS (SELECT case_id, min(pos) FILTER (activity = 'purchase') AS first_clear, min(pos) FILTER (activity = 'view') AS first_receipt, min(pos) FILTER (activity = 'error') AS first_delete,
  CAST(sum(value_cents) FILTER (activity = 'view') AS BIGINT) AS receipt_cents, CAST(sum(value_cents) FILTER (activity = 'click') AS BIGINT) AS invoice_cents, CAST(count(*) FILTER (activity = 'view') AS BIGINT) AS receipt_events,
  coalesce(min(nullif(value_cents, 0)) < max(nullif(value_cents, 0)), false) AS distinct_values, bool_or(tie_broken) AS tied, min(flow) AS flow FROM ev GROUP BY 1),
na AS (SELECT min(case_id) AS c FROM fa WHERE flow IN ('flow0', 'flow1') AND receipt_cents IS NOT NULL AND invoice_cents IS NOT NULL AND NOT distinct_values)"""
_GR = "SELECT case_id, first_clear AS at_seq, tied AS order_assumed, 'CTRL-GR' AS rule_id FROM fa WHERE flow IN ('flow0', 'flow1') AND first_clear IS NOT NULL AND (first_receipt IS NULL OR first_receipt > first_clear)"
_TOL = """SELECT case_id, first_clear AS at_seq, tied AS order_assumed, 'CTRL-TOLERANCE' AS rule_id FROM fa, na WHERE flow IN ('flow0', 'flow1') AND distinct_values
  AND invoice_cents - receipt_cents > 0 AND invoice_cents - receipt_cents > greatest(500.0::DOUBLE, receipt_cents * 2.0::DOUBLE / 100) AND (c IS NULL OR case_id < c)"""
_SOD = """SELECT DISTINCT x.case_id, CAST((SELECT min(pos) FROM ev e WHERE e.case_id = x.case_id AND e.activity = 'purchase') AS INTEGER) AS at_seq, false AS order_assumed, 'CTRL-SOD' AS rule_id, x.resource, x.activity AS first
  FROM ev x JOIN ev y ON x.case_id = y.case_id AND x.resource = y.resource AND y.activity = 'purchase' WHERE x.activity IN ('view', 'click') AND x.resource <> ''"""
_BLK = """SELECT case_id, pos AS at_seq, tied AS order_assumed, 'CTRL-BLOCK' AS rule_id FROM (SELECT case_id, pos, activity, bool_or(tie_broken) OVER (PARTITION BY case_id) AS tied,
  coalesce(bool_or(activity = 'signup') OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was FROM ev) WHERE activity = 'error' AND NOT was"""
_DEL = """SELECT case_id, min(pos) AS at_seq, any_value(tied) AS order_assumed, 'CTRL-DELETED' AS rule_id FROM ev JOIN fa USING (case_id) WHERE pos > first_delete AND activity IN ('purchase', 'click', 'view') GROUP BY 1"""
_VIOLATION = ("case_id", "at_seq", "order_assumed", "rule_id")


def _rule(s, d, rule_id: str) -> DataFrame:
    return rules.evaluate(events_log(s, d), POLICY, [rule_id]).violations


@query("SELECT case_id, first_clear, first_receipt, first_delete, receipt_cents, invoice_cents, receipt_events, distinct_values, tied, flow FROM fa", EVENTS_SQL, _FACTS)
def case_facts(s, d):
    return rules.case_facts(events_log(s, d), POLICY).drop("clear_ts", "receipt_ts")


@query(_GR, EVENTS_SQL, _FACTS)
def rule_precedence(s, d):
    return _rule(s, d, "CTRL-GR").select(*_VIOLATION)


@query(_TOL, EVENTS_SQL, _FACTS)
def rule_tolerance(s, d):
    return _rule(s, d, "CTRL-TOLERANCE").select(*_VIOLATION)


@query(_SOD, EVENTS_SQL)
def rule_sod(s, d):
    v = _rule(s, d, "CTRL-SOD")
    return v.select(*_VIOLATION, F.col("detail")["resource"].alias("resource"), F.col("detail")["first"].alias("first"))


@query(_BLK, EVENTS_SQL)
def rule_block(s, d):
    return _rule(s, d, "CTRL-BLOCK").select(*_VIOLATION)


@query(_DEL, EVENTS_SQL, _FACTS)
def rule_deleted(s, d):
    return _rule(s, d, "CTRL-DELETED").select(*_VIOLATION)


@query(
    f"""SELECT r.rule_id, NOT (r.rule_id = 'CTRL-TOLERANCE' AND c IS NOT NULL) AS evaluated, CASE WHEN r.rule_id = 'CTRL-TOLERANCE' AND c IS NOT NULL THEN NULL ELSE coalesce(v.n, 0) END AS violations,
  CASE WHEN r.rule_id = 'CTRL-TOLERANCE' AND c IS NOT NULL THEN NULL ELSE coalesce(v.cases, 0) END AS cases,
  CASE WHEN r.rule_id = 'CTRL-TOLERANCE' AND c IS NOT NULL THEN NULL WHEN r.rule_id IN ('CTRL-GR', 'CTRL-TOLERANCE') THEN gr ELSE al END AS in_scope_cases
FROM (SELECT unnest(['CTRL-GR', 'CTRL-TOLERANCE', 'CTRL-SOD', 'CTRL-BLOCK', 'CTRL-DELETED']) AS rule_id) r, na, (SELECT count(*) AS al, CAST(count_if(flow IN ('flow0', 'flow1')) AS BIGINT) AS gr FROM ca)
LEFT JOIN (SELECT rule_id, count(*) AS n, count(DISTINCT case_id) AS cases FROM (SELECT case_id, rule_id FROM ({_GR}) UNION ALL SELECT case_id, rule_id FROM ({_TOL}) UNION ALL SELECT case_id, rule_id FROM ({_SOD})
  UNION ALL SELECT case_id, rule_id FROM ({_BLK}) UNION ALL SELECT case_id, rule_id FROM ({_DEL})) GROUP BY 1) v ON v.rule_id = r.rule_id""",
    EVENTS_SQL, _FACTS,
)
def rules_report(s, d):
    got = rules.report(rules.evaluate(events_log(s, d), POLICY))
    return got.select("rule_id", "evaluated", "violations", "cases", "in_scope_cases")


# Controls


@query("SELECT item_key, decision, decision = 'match' AS within_tolerance, var AS variance_cents, tol AS tolerance_cents FROM mt", ITEMS_SQL)
def three_way_match(s, d):
    m = controls.three_way_match(items(s, d), POLICY)
    return m.select("item_key", "decision", "within_tolerance", "variance_cents", "tolerance_cents")


@query(
    """SELECT item_key, CASE WHEN paused THEN 'refused:paused' WHEN NOT permitted THEN 'refused:permission_denied' WHEN item_deleted THEN 'refused:deleted'
  WHEN invoice IS NULL OR already_queued THEN 'refused:no_open_invoice' WHEN payment_blocked THEN 'refused:blocked' WHEN decision = 'missing_gr' THEN 'refused:missing_receipt'
  WHEN decision <> 'match' THEN 'queued:tolerance_override' WHEN sod_conflict THEN 'queued:sod_conflict' WHEN invoice > CASE WHEN role = 'controller' THEN 300000 ELSE 100000 END THEN 'queued:above_limit' ELSE 'cleared' END AS outcome FROM mt""",
    ITEMS_SQL,
)
def approval_ladder(s, d):
    m = controls.three_way_match(items(s, d), POLICY).withColumn("limit_cents", controls.clearing_limit_cents(F.col("role"), POLICY))
    return controls.clearing_ladder(m, POLICY).select("item_key", "outcome")


@query(
    """SELECT DISTINCT a.o_orderkey AS invoice_id, b.o_orderkey AS duplicate_of, a.o_custkey AS vendor_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey < a.o_orderkey
WHERE abs(CAST(round_even(a.o_totalprice * 100, 0) AS BIGINT) - CAST(round_even(b.o_totalprice * 100, 0) AS BIGINT)) <= 5000 AND abs(date_diff('day', a.o_orderdate::DATE, b.o_orderdate::DATE)) <= 90"""
)
def duplicate_invoice(s, d):
    o = table(s, d, "orders")
    inv = o.select(F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("vendor_id"), F.bround(F.col("o_totalprice") * 100).cast("bigint").alias("value_cents"), F.to_date("o_orderdate").alias("invoice_date"))
    return controls.duplicate_invoices(inv, POLICY).distinct()


@query(
    """SELECT a.o_orderkey AS invoice_id, a.o_orderpriority AS vendor_id, min(b.o_orderkey) AS duplicate_of FROM orders a JOIN orders b ON a.o_orderpriority = b.o_orderpriority AND b.o_orderkey < a.o_orderkey
WHERE abs(CAST(round_even(a.o_totalprice * 100, 0) AS BIGINT) - CAST(round_even(b.o_totalprice * 100, 0) AS BIGINT)) <= 5000 AND abs(date_diff('day', a.o_orderdate::DATE, b.o_orderdate::DATE)) <= 90 GROUP BY 1, 2"""
)
def first_duplicate_invoice(s, d):
    """Priorities stand for vendors: five of them, so that each has very many invoices."""
    o = table(s, d, "orders")
    inv = o.select(F.col("o_orderkey").alias("invoice_id"), F.col("o_orderpriority").alias("vendor_id"), F.bround(F.col("o_totalprice") * 100).cast("bigint").alias("value_cents"), F.to_date("o_orderdate").alias("invoice_date"))
    return controls.first_duplicates(inv, POLICY)


@query("SELECT DISTINCT case_id AS item_key, resource AS actor_id FROM ev a WHERE activity = 'purchase' AND EXISTS (SELECT 1 FROM ev b WHERE b.case_id = a.case_id AND b.resource = a.resource AND b.activity IN ('view', 'click'))", EVENTS_SQL)
def sod_history(s, d):
    e = events_log(s, d).events.select(F.col("case_id").alias("item_key"), F.col("resource").alias("actor_id"), "activity")
    return controls.duty_conflicts(e.where("activity = 'purchase'"), e, POLICY).select("item_key", "actor_id").distinct()


@query(
    """SELECT o_orderkey, g AS role, CASE g WHEN 'controller' THEN true WHEN 'buyer' THEN c_mktsegment = 'BUILDING' ELSE c_nationkey = 7 END AS visible
FROM orders JOIN customer ON c_custkey = o_custkey, (SELECT unnest(['controller', 'buyer', 'ap_clerk']) AS g)"""
)
def scope_filter(s, d):
    """Which orders each role sees, for a buyer of one segment and a clerk of one nation: all of them are judged."""
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    o = o.select("o_orderkey", "c_mktsegment", "c_nationkey", F.explode(F.array(*map(F.lit, ("controller", "buyer", "ap_clerk")))).alias("role"))
    seen = controls.can_view_item(F.col("role"), F.lit("BUILDING"), F.col("c_mktsegment"), F.lit(7), F.col("c_nationkey"))
    return o.select("o_orderkey", "role", seen.alias("visible"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE)::VARCHAR AS due, CAST(CAST(o_orderdate AS DATE) + 10 AS DATE)::VARCHAR AS discount_until, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) > 100000 AS needs_approval FROM orders")
def payment_terms(s, d):
    o, day = table(s, d, "orders"), F.to_date("o_orderdate")
    needs = controls.clearing_needs_approval(F.bround(F.col("o_totalprice") * 100).cast("bigint"), POLICY)
    return o.select("o_orderkey", controls.due_date(day, POLICY).cast("string").alias("due"), controls.discount_deadline(day, POLICY).cast("string").alias("discount_until"), needs.alias("needs_approval"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_size > 0 AND 100.0::DOUBLE * (l_quantity - p_size) / nullif(p_size, 0) <= 5 AS fits FROM lineitem JOIN part ON l_partkey = p_partkey")
def quantity_tolerance(s, d):
    both = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", controls.quantity_within_tolerance(F.col("p_size").cast("double"), F.col("l_quantity"), POLICY).alias("fits"))


# Samples, keys and references


@query(
    """, dr AS (SELECT case_id, flow, row_number() OVER (PARTITION BY flow ORDER BY substr(sha256('procspark' || case_id), 1, 16), case_id) AS k FROM ca),
al AS (SELECT flow, least(count(*), greatest(20, CAST(round_even(200.0::DOUBLE * count(*) / (SELECT count(*) FROM ca), 0) AS BIGINT))) AS w FROM ca GROUP BY 1)
SELECT dr.case_id, ca.event_count FROM dr JOIN al USING (flow) JOIN ca ON ca.case_id = dr.case_id WHERE k <= w""",
    EVENTS_SQL,
)
def stratified_hash_sample(s, d):
    return _ids(checks.stratified_sample(events_log(s, d), 200, 20))


@query("SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY 1")
def latest_per_key(s, d):
    return sp.latest(table(s, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(s, d):
    return checks.repeated_keys(table(s, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')")
def referential_gaps(s, d):
    """Customers without an order since 2000; orders of any time have no gaps in these tables."""
    recent = table(s, d, "orders").where("o_orderdate >= timestamp_ntz'2000-01-01'")
    return checks.gaps(table(s, d, "customer"), "c_custkey", recent, "o_custkey").select("c_custkey")


@query("SELECT lower(trim(text)) AS text, count(*) AS n FROM (SELECT text FROM conversations UNION ALL SELECT text FROM documents) WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_messages(s, d):
    both = table(s, d, "conversations").select("text").union(table(s, d, "documents").select("text"))
    return checks.repeated_texts(both.where("text is not null"), "text")


@query(
    """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum,
  CAST(count_if(CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50) AS BIGINT) AS k_high FROM events GROUP BY 1"""
)
def json_props_report(s, d):
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$['k']").cast("bigint"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum("k").alias("k_sum"), F.count_if(F.col("k") >= 50).alias("k_high"))


# Spans and costs

_COST = """sd AS (SELECT run_id, step, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o, CAST(sum(cache_read_tokens) AS BIGINT) AS cr, CAST(sum(cache_write_tokens) AS BIGINT) AS cw FROM sp WHERE kind = 'model' GROUP BY 1, 2),
sm AS (SELECT sd.*, CASE model WHEN 'model-a' THEN (i * 2.0::DOUBLE + cr * 2.0::DOUBLE * 0.1 + cw * 2.0::DOUBLE * 1.25 + o * 10.0::DOUBLE) / 1000000
  WHEN 'vendor/model-b' THEN (i * 5.0::DOUBLE + cr * 5.0::DOUBLE * 0.1 + cw * 5.0::DOUBLE * 1.25 + o * 25.0::DOUBLE) / 1000000 END AS usd, model FROM sd LEFT JOIN rn USING (run_id)),
tk AS (SELECT run_id, step, list(activity) FILTER (activity IS NOT NULL) AS names, list_sort(list(DISTINCT item_key) FILTER (item_key IS NOT NULL)) AS items, count(*) AS calls FROM sp WHERE kind = 'tool' GROUP BY 1, 2),
ri AS (SELECT run_id, min(item_key) AS one, max(item_key) AS other FROM sp WHERE kind = 'tool' AND item_key IS NOT NULL GROUP BY 1),
ct AS (SELECT sm.*, CASE WHEN len(names) > 0 THEN names WHEN calls IS NOT NULL THEN ['(lookup only)'] ELSE ['(final reply)'] END AS acts,
  coalesce(items, [CASE WHEN one = other THEN one ELSE '(unattributed)' END]) AS its FROM sm LEFT JOIN tk USING (run_id, step) LEFT JOIN ri USING (run_id)),
xa AS (SELECT unnest(acts) AS target, len(acts) AS k, i, o, cr, cw, usd FROM ct), xc AS (SELECT unnest(its) AS target, len(its) AS k, i, o, cr, cw, usd FROM ct)"""
_SUMS = "CAST(sum(i // k) AS BIGINT) AS input_tokens, CAST(sum(o // k) AS BIGINT) AS output_tokens, CAST(sum(cr // k) AS BIGINT) AS cache_read_tokens, CAST(sum(cw // k) AS BIGINT) AS cache_write_tokens"


def _money(df: DataFrame, *columns: str) -> DataFrame:
    # Rounded as a decimal, so that the order of a sum doesn't decide ties.
    return df.select(*columns, *sp.TOKENS, F.round(F.col("usd").cast("decimal(38, 9)"), 6).cast("double").alias("usd"))


@query(
    "SELECT run_id, model, count(*) AS steps, usd_known AS priced, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(cr) AS BIGINT) AS cache_read_tokens, CAST(sum(cw) AS BIGINT) AS cache_write_tokens, CAST(round(CAST(coalesce(sum(usd), 0) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS usd FROM (SELECT *, usd IS NOT NULL AS usd_known FROM sm) GROUP BY 1, 2, 4 HAVING sum(i + o + cr + cw) > 0",
    SPANS_SQL, _COST,
)
def cost_by_run(s, d):
    return _money(sp.cost_by_run(spans(s, d), runs(s, d), POLICY), "run_id", "model", "steps", "priced")


@query(f"SELECT target AS activity, {_SUMS}, CAST(round(CAST(coalesce(sum(usd / k), 0) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS usd, CAST(count_if(k > 1) AS BIGINT) AS split_shares FROM xa GROUP BY 1", SPANS_SQL, _COST)
def cost_by_activity(s, d):
    return _money(sp.cost_by_activity(spans(s, d), runs(s, d), POLICY), "activity", "split_shares")


@query(f"SELECT target AS case_id, {_SUMS}, CAST(round(CAST(coalesce(sum(usd / k), 0) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS usd FROM xc GROUP BY 1", SPANS_SQL, _COST)
def cost_by_case(s, d):
    return _money(sp.cost_by_case(spans(s, d), runs(s, d), POLICY), "case_id")


_BUSINESS = """bl AS (SELECT item_key AS case_id, CASE name WHEN 'clear_invoice' THEN 'Clear Invoice' ELSE 'Record Goods Receipt' END AS activity, t, step, span_id FROM sp
  WHERE kind = 'tool' AND item_key IS NOT NULL AND name IN ('clear_invoice', 'record_receipt') AND outcome = 'done'),
bv AS (SELECT case_id, string_agg(activity, ' -> ' ORDER BY t, step, span_id) AS variant FROM bl GROUP BY 1)"""


@query(
    f"""SELECT bv.variant IS NOT NULL AS in_log, coalesce(bv.variant, '') AS variant, count(*) AS cases, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, CAST(round(CAST(sum(usd) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS usd
FROM (SELECT target AS case_id, {_SUMS}, coalesce(sum(usd / k), 0) AS usd FROM xc GROUP BY 1) LEFT JOIN bv USING (case_id) GROUP BY 1, 2""",
    SPANS_SQL, _COST, _BUSINESS,
)
def cost_by_variant(s, d):
    log = sp.to_log(spans(s, d), runs(s, d), "business", TOOLS, POLICY)
    return _money(sp.cost_by_variant(spans(s, d), runs(s, d), log, POLICY), "in_log", "variant", "cases")


@query(
    """SELECT item_key AS case_id, CASE WHEN outcome = 'done' THEN b WHEN outcome = 'queued' THEN b || ' Queued for Approval' ELSE 'Attempted ' || b END AS activity, count(*) AS n
FROM (SELECT *, CASE name WHEN 'clear_invoice' THEN 'Clear Invoice' ELSE 'Record Goods Receipt' END AS b FROM sp WHERE kind = 'tool' AND item_key IS NOT NULL AND name IN ('clear_invoice', 'record_receipt')) GROUP BY 1, 2""",
    SPANS_SQL,
)
def span_outcome_layers(s, d):
    raw = sp.layered(spans(s, d), runs(s, d), "attempts", TOOLS)
    return raw.groupBy("case_id", "activity").agg(F.count("*").alias("n"))


@query("SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY t, step, span_id) - 1 AS INTEGER) AS pos, activity, t AS ts_s FROM bl", SPANS_SQL, _BUSINESS)
def span_business_log(s, d):
    return sp.to_log(spans(s, d), runs(s, d), "business", TOOLS, POLICY).events.select("case_id", "pos", "activity", "ts_s")


@query(
    """SELECT span_id FROM (SELECT span_id, coalesce(bool_or(NOT ok) OVER (PARTITION BY run_id, name ORDER BY t, step, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS again
  FROM sp WHERE kind = 'tool' AND name IN ('clear_invoice', 'record_receipt')) WHERE again""",
    SPANS_SQL,
)
def retry_after_refusal(s, d):
    """Retries of a tool within a run, whose calls are all taken to be on one item, as these tables have none otherwise."""
    steps = sp.tool_steps(spans(s, d)).withColumn("item_key", F.lit("item"))
    return sp.retries(steps, list(TOOLS)).select("span_id")


@query(
    """SELECT rn.run_id, coalesce(turns, 0) AS turns, coalesce(calls, 0) AS tool_calls, coalesce(refusals, 0) AS refusals, coalesce(attempts, 0) AS write_attempts, coalesce(done, 0) AS writes_succeeded, coalesce(qd, 0) AS writes_queued, coalesce(ni, 0) > 1 AS multi_item
FROM rn LEFT JOIN (SELECT run_id, count(*) AS turns FROM sp WHERE role = 'assistant' GROUP BY 1) USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS calls, CAST(count_if(NOT ok) AS BIGINT) AS refusals, CAST(count_if(name <> 'get_item') AS BIGINT) AS attempts, CAST(count_if(name <> 'get_item' AND outcome = 'done') AS BIGINT) AS done,
  CAST(count_if(name <> 'get_item' AND outcome = 'queued') AS BIGINT) AS qd, count(DISTINCT item_key) AS ni FROM sp WHERE kind = 'tool' GROUP BY 1) USING (run_id)""",
    SPANS_SQL,
)
def run_features(s, d):
    f = sp.run_features(runs(s, d), spans(s, d), messages(s, d), list(TOOLS))
    return f.select("run_id", "turns", "tool_calls", "refusals", "write_attempts", "writes_succeeded", "writes_queued", "multi_item")


# Exchange formats


@query(
    "SELECT case_id, pos, substr(sha256('events' || chr(0) || case_id), 1, 32) AS trace_id, substr(sha256('events' || chr(0) || case_id || chr(0) || pos || chr(0) || activity), 1, 16) AS span_id FROM ev",
    EVENTS_SQL,
)
def otlp_ids(s, d):
    e = events_log(s, d).events
    return e.select("case_id", "pos", otlp.trace_id("events", F.col("case_id")).alias("trace_id"), otlp.span_id("events", F.col("case_id"), F.col("pos"), F.col("activity")).alias("span_id"))


@query("SELECT case_id, pos, activity, ts_s, resource, value_cents, tie_broken FROM ev", EVENTS_SQL)
def otlp_roundtrip(s, d):
    path = scratch_dir(s)
    otlp.write(events_log(s, d), path)
    return otlp.read(s, path).events.select("case_id", "pos", "activity", "ts_s", "resource", "value_cents", "tie_broken")


@query("SELECT case_id, pos, activity, ts_s, resource, value_cents, tie_broken FROM ev", EVENTS_SQL)
def csv_roundtrip(s, d):
    path = scratch_dir(s)
    csv.write_events(events_log(s, d), path)
    back = EventLog.build(csv.read_events(s, path, line_breaks=False), None)
    return back.events.select("case_id", "pos", "activity", "ts_s", "resource", "value_cents", "tie_broken")


@query("SELECT case_id, pos, activity, ts_s, resource, value_cents, tie_broken FROM ev", EVENTS_SQL)
def xes_roundtrip(s, d):
    path = scratch_dir(s)
    xes.write(events_log(s, d), path, value=xes.VALUE)
    raw, _ = xes.read(s, path)
    return EventLog.build(raw, None).events.select("case_id", "pos", "activity", "ts_s", "resource", "value_cents", "tie_broken")


_TYPED_SQL = """SELECT id AS event_id, key, any_value(type) AS type, any_value(value) AS value FROM (
  SELECT event_id AS id, json_extract_string(props, '$.k') AS k, value AS v, user_id AS u FROM events) e,
  LATERAL (VALUES ('whole', 'int', k), ('fraction', 'float', concat(CAST(u % 100 AS VARCHAR), '.5')), ('truth', 'bool', CASE WHEN u % 2 = 0 THEN 'True' ELSE 'False' END),
    ('digits', 'str', concat('00', k)), ('list', 'list', concat('[', k, ',"', u, '"]')), ('object', 'object', concat('{"a":', k, ',"b":', CASE WHEN u % 2 = 0 THEN 'true' ELSE 'false' END, '}'))) t(key, type, value)
GROUP BY 1, 2"""


def _typed_log(s, d) -> EventLog:
    """Events with attributes of all types, a case each."""
    e = table(s, d, "events")
    k, u = F.get_json_object("props", "$.k"), F.col("user_id").cast("string")
    truth = F.when(F.col("user_id") % 2 == 0, "true").otherwise("false")
    parts = [
        F.lit('{"whole":'), k, F.lit(',"fraction":'), (F.col("user_id") % 100).cast("string"), F.lit('.5,"truth":'), truth, F.lit(',"digits":"00'), k,
        F.lit('","list":['), k, F.lit(',"'), u, F.lit('"],"object":{"a":'), k, F.lit(',"b":'), truth, F.lit("}}"),
    ]
    raw = e.select(F.col("event_id").cast("string").alias("case_id"), F.col("event_type").alias("activity"), F.col("ts"), F.parse_json(F.concat(*parts)).alias("props"))
    return EventLog.build(raw, log_id="typed", attributes=raw.select("case_id", F.create_map().cast("map<string,string>").alias("attrs"), "props"))


def _typed_rows(df: DataFrame) -> DataFrame:
    each = df.select(F.col("case_id").cast("bigint").alias("event_id"), F.explode(typed.members(F.col("props"))).alias("key", "v"))
    return each.select("event_id", "key", typed.kind(F.col("v")).alias("type"), typed.text(F.col("v")).alias("value"))


@query(_TYPED_SQL)
def otlp_typed(s, d):
    """Types and values of attributes of events, after they were written as spans and read."""
    path = scratch_dir(s)
    otlp.write(_typed_log(s, d), path, compress=True)
    return _typed_rows(otlp.read(s, path).events)


@query("SELECT ev.case_id, pos, activity, ts_s, resource, value_cents, tie_broken, ca.flow FROM ev JOIN ca ON ca.case_id = ev.case_id", EVENTS_SQL)
def xes_tables(s, d):
    """Events and case attributes of an XES file, after one job has made both tables of it."""
    path = scratch_dir(s)
    xes.write(events_log(s, d), f"{path}/xes", value=xes.VALUE)
    tables.convert(s, f"{path}/xes", f"{path}/out")
    log = tables.load(s, f"{path}/out")
    flow = log.cases.select("case_id", F.element_at("attrs", F.lit(FLOW)).alias("flow"))
    return log.events.select("case_id", "pos", "activity", "ts_s", "resource", "value_cents", "tie_broken").join(flow, "case_id")


@query(_TYPED_SQL)
def xes_typed(s, d):
    """Types and values of attributes of cases and events, after they were written as XES and read; both have the same."""
    path = scratch_dir(s)
    xes.write(_typed_log(s, d), path)
    events, cases = xes.tables_of(cut(xes.read_traces(s, path), "traces"))
    names = F.col("key") != xes.NAME
    return _typed_rows(events).intersect(_typed_rows(cases).where(names))


@query("""SELECT key, type, false AS mixed FROM (VALUES ('whole', 'int'), ('fraction', 'float'), ('truth', 'bool'), ('digits', 'str'), ('list', 'list'), ('object', 'object')) t(key, type)
WHERE (SELECT count(*) FROM events) > 0 UNION ALL SELECT 'odd', 'str', true WHERE (SELECT count(DISTINCT user_id % 2) FROM events) = 2""")
def attribute_types(s, d):
    """The type of each attribute key over the whole log, and the keys whose values differ in type."""
    odd = F.when(F.col("case_id").cast("bigint").isNotNull() & (F.element_at(typed.members(F.col("props")), F.lit("truth")).cast("boolean")), F.lit('{"odd":1}')).otherwise('{"odd":"x"}')
    log = _typed_log(s, d)
    more = log.events.select("case_id", F.parse_json(odd).alias("props"))
    return typed.types(log.events.select("case_id", "props").unionByName(more))


_PLANTED = ("event missing", "event stands twice", "times differ", "sequence differs", "values differ", "ties differ", "case missing", "case attributes differ", "event not in the log", "resources differ")


@query(
    "SELECT case_id, problem FROM (SELECT case_id, CASE CAST(split_part(case_id, '_', 1) AS BIGINT) % 30 "
    + " ".join(f"WHEN {i} THEN '{x if x != 'event missing' else 'case missing'}'" for i, x in enumerate(_PLANTED) if i)
    + " WHEN 0 THEN CASE WHEN event_count = 1 THEN 'case missing' ELSE 'event missing' END END AS problem FROM ca) WHERE problem IS NOT NULL",
    EVENTS_SQL,
)
def export_conservation(s, d):
    """Faults planted in a third of all users' cases, each found and named, and no others."""
    log = events_log(s, d)
    plant = lambda df: df.withColumn("u", (F.split_part("case_id", F.lit("_"), F.lit(1)).cast("bigint") % 30).cast("int"))
    e = plant(log.events)
    at = lambda i: (F.col("u") == i) & (F.col("pos") == 0)
    changed = e.where(~at(0) & (F.col("u") != 6)).withColumns({
        "ts_s": F.when(at(2), F.col("ts_s") + 1).otherwise(F.col("ts_s")), "activity": F.when(at(3), "other").otherwise(F.col("activity")),
        "value_cents": F.when(at(4), F.col("value_cents") + 1).otherwise(F.col("value_cents")), "tie_broken": F.when(at(5), ~F.col("tie_broken")).otherwise(F.col("tie_broken")),
        "resource": F.when(at(9), "nobody").otherwise(F.col("resource")),
    })
    more = e.where(at(1)).unionByName(e.where(at(8)).withColumn("pos", F.lit(1_000_000)))
    cases = plant(log.cases).withColumn("attrs", F.when(F.col("u") == 7, F.create_map(F.lit(FLOW), F.lit("another"))).otherwise(F.col("attrs")))
    return otlp.conservation(log, changed.unionByName(more), cases.where("u <> 6"))


@query("SELECT case_id, pos, activity, ts_s, resource, value_cents, tie_broken FROM ev", EVENTS_SQL)
def store_roundtrip(s, d):
    from ..sources import store

    path = scratch_dir(s)
    store.save(events_log(s, d), path)
    return store.load(s, path, "events").events.select("case_id", "pos", "activity", "ts_s", "resource", "value_cents", "tie_broken")


# More queries register themselves; they need the decorator above.
from . import reports, reviews  # noqa: E402, F401
