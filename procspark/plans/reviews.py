"""Registered queries of reviews of runs and of names as numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import controls, names, reports, reviews
from ..operators import spans as sp
from ..session import cut, scratch_dir
from ..sources import jsonl
from .catalogue import SQL, query
from .reports import _DUTIES
from .views import EVENTS_SQL, SPANS_SQL, TOOLS, events_log, messages, runs, spans, table

_WRITES = list(TOOLS)

#: Features of runs with retries of a tool on an item, and rules broken.
_REVIEWED = f"""rf AS ({SQL["run_features"][SQL["run_features"].index("SELECT rn.run_id"):]}),
rt AS (SELECT run_id, count(*) AS retries FROM (SELECT run_id, coalesce(bool_or(NOT ok) OVER (PARTITION BY run_id, name, item_key ORDER BY t, step, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS again
  FROM sp WHERE kind = 'tool' AND name IN ('clear_invoice', 'record_receipt')) WHERE again GROUP BY 1),
rr AS (SELECT run_id, count(*) AS n FROM sp WHERE kind = 'tool' AND NOT ok AND name IN ('clear_invoice', 'record_receipt') GROUP BY 1),
sv AS (SELECT run_id, count(*) AS violations FROM (SELECT run_id, item_key FROM sp WHERE activity IS NOT NULL AND item_key IS NOT NULL GROUP BY 1, 2
  HAVING bool_or(activity = 'Record Goods Receipt') AND bool_or(activity = 'Clear Invoice')) GROUP BY 1),
rv AS (SELECT rf.*, coalesce(retries, 0) AS retries, coalesce(rr.n, 0) > 1 AS again, coalesce(violations, 0) AS violations, 1700000000 + CAST(substr(run_id, 4) AS BIGINT) * 3600 AS started
  FROM rf LEFT JOIN rt USING (run_id) LEFT JOIN rr USING (run_id) LEFT JOIN sv USING (run_id))"""


def _records(s, d):
    r, rows = runs(s, d), spans(s, d)
    return reviews.records(r, rows, messages(s, d), _WRITES, reports.findings_by_run(rows, r, TOOLS, _DUTIES))


@query(
    """SELECT run_id, array_to_string(list_filter([CASE WHEN retries > 0 THEN 'retried' END, CASE WHEN multi_item THEN 'several items' END, CASE WHEN again THEN 'refused again' END,
  CASE WHEN writes_queued > 0 THEN 'queued' END, CASE WHEN violations > 0 THEN 'rules broken' END], lambda x: x IS NOT NULL), ',') AS flags, retries, CAST(violations AS BIGINT) AS violations FROM rv""",
    SPANS_SQL, _REVIEWED,
)
def trace_flags(s, d):
    return _records(s, d).select("run_id", F.array_join(reviews.flags(), ",").alias("flags"), "retries", "violations")


@query(
    """SELECT * FROM (SELECT 'arrival' AS ordered, run_id FROM rv ORDER BY started, run_id LIMIT 15) UNION ALL SELECT * FROM (SELECT 'retries', run_id FROM rv ORDER BY retries > 0 DESC, write_attempts DESC, run_id LIMIT 15)
UNION ALL SELECT * FROM (SELECT 'multi-item', run_id FROM rv ORDER BY multi_item DESC, started, run_id LIMIT 15) UNION ALL SELECT * FROM (SELECT 'refusals', run_id FROM rv ORDER BY refusals DESC, run_id LIMIT 15)
UNION ALL SELECT * FROM (SELECT 'violations', run_id FROM rv ORDER BY violations DESC, run_id LIMIT 15)""",
    SPANS_SQL, _REVIEWED,
)
def review_orders(s, d):
    """The first fifteen runs in each order for reviewing them; the features are written once."""
    f = cut(_records(s, d).select("run_id", "started_at", "retried_after_refusal", "write_attempts", "multi_item", "refusals", "violations"), "features")
    out = None
    for order in ("arrival", "retries", "multi-item", "refusals", "violations"):
        top = sp.review(f, order).limit(15).select(F.lit(order).alias("ordered"), "run_id")
        out = top if out is None else out.union(top)
    return out


#: Fixed values of the queries below: patterns, the expressions that detect them, and a pattern that nothing detects.
PATTERNS = [
    reviews.Pattern("tried again", "a refused write is tried once more on its item", detect="retried_after_refusal", examples=("refusal",)),
    reviews.Pattern("claimed too early", "the reply speaks of success, and nothing was written", detect="writes_succeeded = 0 and write_attempts > 0"),
    reviews.Pattern("drifted", "the run touches more than one item", "rejected", detect="multi_item"),
    reviews.Pattern("tone", "people only can tell"),
]

_NOTES = """nt AS (SELECT span_id AS note_id, run_id, role AS author, t AS noted_at, outcome AS note,
  CASE n % 5 WHEN 0 THEN 'tried again' WHEN 1 THEN 'drifted' WHEN 2 THEN 'tone' WHEN 3 THEN 'odd' END AS pattern FROM sp),
ln AS (SELECT run_id, author, arg_max(note_id, (noted_at, note_id)) AS note_id, max(noted_at) AS at_s, count(*) AS notes FROM nt GROUP BY 1, 2),
lp AS (SELECT ln.*, nt.note, nt.pattern FROM ln JOIN nt USING (note_id))"""


def _notes(s, d):
    """Each span as a note of its role, added in two parts to a table of notes."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("tried again", "drifted", "tone", "odd")]), F.expr("cast(n % 5 + 1 as int)"))
    rows = spans(s, d)
    said = rows.select(F.col("span_id").alias("note_id"), "run_id", F.col("role").alias("author"), F.col("started_at").alias("noted_at"), sp.outcome().alias("note"), F.when(F.col("n") % 5 < 4, kind).alias("pattern"))
    path = scratch_dir(s) + "/notes"
    reviews.add_notes(said.where("pattern is null"), path)
    reviews.add_notes(said.where("pattern is not null"), path)
    return reviews.read_notes(s, path)


@query("SELECT run_id, author, note_id, at_s, note, pattern, notes FROM lp", SPANS_SQL, _NOTES)
def trace_notes(s, d):
    got = reviews.latest_notes(_notes(s, d))
    return got.select("run_id", "author", "note_id", F.unix_seconds("noted_at").alias("at_s"), "note", "pattern", "notes")


@query(
    """SELECT pattern, CASE WHEN status IS NULL THEN 'undeclared' WHEN status = 'candidate' AND coalesce(noted, 0) >= 3 THEN 'confirmed' ELSE status END AS status, coalesce(detected, 0) AS detected, coalesce(noted, 0) AS noted, coalesce(n_both, 0) AS both_n, first_noted
FROM (VALUES ('tried again', 'candidate'), ('claimed too early', 'candidate'), ('drifted', 'rejected'), ('tone', 'candidate')) p(pattern, status)
FULL JOIN (SELECT pattern, count(d) AS detected, count(m) AS noted, count(d + m) AS n_both, min(CASE WHEN m = 1 THEN run_id END) AS first_noted FROM (
  SELECT run_id, pattern, 1 AS d FROM (SELECT run_id, 'tried again' AS pattern FROM rv WHERE retries > 0 UNION ALL SELECT run_id, 'claimed too early' FROM rv WHERE writes_succeeded = 0 AND write_attempts > 0 UNION ALL SELECT run_id, 'drifted' FROM rv WHERE multi_item))
  FULL JOIN (SELECT DISTINCT run_id, pattern, 1 AS m FROM lp WHERE pattern IS NOT NULL) USING (run_id, pattern) GROUP BY 1) USING (pattern)""",
    SPANS_SQL, _REVIEWED, _NOTES,
)
def trace_patterns(s, d):
    got = reviews.pattern_report(_records(s, d), _notes(s, d), PATTERNS)
    return got.select("pattern", "status", "detected", "noted", F.col("both").alias("both_n"), "first_noted")


@query(
    """, tx AS (SELECT concat('run', conv_id) AS run_id, turn * 2 + CASE WHEN role = 'user' THEN 1 ELSE 0 END AS mid, role, coalesce(max(text), '') AS said FROM conversations GROUP BY conv_id, turn, role)
SELECT rn.run_id, coalesce(text, '') AS text, coalesce(calls, '') AS calls FROM rn LEFT JOIN (SELECT run_id, string_agg(concat(role, ': ', said), chr(10) ORDER BY mid, role, said) AS text FROM tx GROUP BY 1) USING (run_id)
LEFT JOIN (SELECT run_id, string_agg(concat(name, '/', CASE WHEN ok THEN 'ok' ELSE 'no' END), ' ' ORDER BY t, step, span_id) AS calls FROM sp WHERE kind = 'tool' GROUP BY 1) USING (run_id)""",
    SPANS_SQL,
)
def trace_export(s, d):
    """Records as JSON lines, read back."""
    path = scratch_dir(s) + "/traces"
    jsonl.write(_records(s, d), path)
    got = jsonl.read(s, path, "run_id string, text string, calls array<struct<tool:string,ok:boolean>>")
    return got.select("run_id", "text", F.array_join(F.transform("calls", lambda c: F.concat_ws("/", c["tool"], F.when(c["ok"], "ok").otherwise("no"))), " ").alias("calls"))


# Names as numbers


@query("SELECT CAST(row_number() OVER (ORDER BY f) - 1 AS BIGINT) AS id, name, n FROM (SELECT activity AS name, min(arrival) AS f, count(*) AS n FROM ev GROUP BY 1)", EVENTS_SQL)
def activity_dictionary(s, d):
    return names.dictionary(events_log(s, d).events, "activity")


_NUMBERED = "ai AS (SELECT activity, row_number() OVER (ORDER BY min(arrival)) - 1 AS a FROM ev GROUP BY 1), ri AS (SELECT resource, row_number() OVER (ORDER BY min(arrival)) - 1 AS r FROM ev GROUP BY 1)"


@query("SELECT case_id, pos, CAST(a AS BIGINT) AS activity_id, CAST(r AS BIGINT) AS resource_id, ev.activity, ev.resource FROM ev JOIN ai USING (activity) JOIN ri USING (resource)", EVENTS_SQL, _NUMBERED)
def encoded_events(s, d):
    """Events with numbers in place of names, and the names that the numbers stand for."""
    events = events_log(s, d).events.select("case_id", "pos", "activity", "resource", "arrival")
    one, two = names.dictionary(events, "activity"), names.dictionary(events, "resource")
    coded = names.encode(names.encode(events, one, "activity", "activity_id"), two, "resource", "resource_id").select("case_id", "pos", "activity_id", "resource_id")
    return names.decode(names.decode(coded.select("*", F.col("activity_id").alias("a"), F.col("resource_id").alias("r")), one, "a", "activity"), two, "r", "resource")


@query("SELECT 'activity' AS what, * FROM (SELECT activity AS name, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, name LIMIT 3) UNION ALL SELECT 'flow', * FROM (SELECT flow, count(*) AS n FROM ca GROUP BY 1 ORDER BY n DESC, flow LIMIT 3) UNION ALL SELECT 'resource', * FROM (SELECT resource, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, resource LIMIT 10)", EVENTS_SQL)
def most_common(s, d):
    """The most frequent activities, flows and resources."""
    log = events_log(s, d)
    parts = (("activity", log.events, F.col("activity"), 3), ("flow", log.cases, reports.flow_of(F.col("attrs"), reports.FLOW), 3), ("resource", log.events, F.col("resource"), 10))
    out = None
    for what, rows, name, k in parts:
        top = reports.most_common(rows, name, k).select(F.lit(what).alias("what"), "name", "n")
        out = top if out is None else out.union(top)
    return out


@query(
    """SELECT l_orderkey, l_linenumber, o_custkey, s_name FROM lineitem JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = l_orderkey
LEFT JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 5000) v ON s_suppkey = l_suppkey"""
)
def item_context(s, d):
    """Line items with their order, which must be there, and their supplier, which may be missing."""
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    orders = table(s, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey")
    vendors = table(s, d, "supplier").where("s_acctbal > 5000").select("s_suppkey", "s_name")
    return controls.with_context(lines, orders, "o_orderkey", vendors, "s_suppkey").select("l_orderkey", "l_linenumber", "o_custkey", "s_name")
