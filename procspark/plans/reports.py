"""Registered queries of reports, scenario checks and control helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, controls, dfg, reports, scenarios, variants
from ..operators import spans as sp
from ..policy import Policy
from ..schema import FLOW
from ..sources import csv
from .catalogue import _BLK, _DEL, _EV_PAIRS, _FACTS, _GR, _TOL, _VARIANTS, SQL, query
from .views import EVENTS_RAW, EVENTS_SQL, ITEMS_SQL, POLICY, SPANS_SQL, TOOLS, events_log, events_raw, items, runs, spans, table

# Logs


@query("SELECT src, dst, total_s / n AS mean_s FROM ed", EVENTS_SQL, _EV_PAIRS)
def dfg_means(s, d):
    return dfg.build(events_log(s, d)).means().select("src", "dst", "mean_s")


@query("SELECT (SELECT sum(n) FROM (SELECT n FROM vc ORDER BY n DESC LIMIT 20)) / (SELECT sum(n) FROM vc) AS coverage", EVENTS_SQL, _VARIANTS)
def top_variant_coverage(s, d):
    return reports.top_coverage(events_log(s, d))


_SCAN = """SELECT 'cases' AS statistic, '' AS name, count(*) AS n FROM {c} UNION ALL SELECT 'events', '', count(*) FROM {e} UNION ALL SELECT 'day_precision_events', '', 0
UNION ALL SELECT 'variants', '', count(*) FROM (SELECT DISTINCT string_agg(activity, '>' ORDER BY pos) FROM {e} GROUP BY case_id)
UNION ALL SELECT 'activity', activity, count(*) FROM {e} GROUP BY 2 UNION ALL SELECT 'kind', CASE WHEN resource LIKE 'user%' THEN 'human' ELSE 'unknown' END, count(*) FROM {e} GROUP BY 2
UNION ALL SELECT 'flow', flow, count(*) FROM {c} GROUP BY 2 UNION ALL SELECT 'events_in_case', CAST(event_count AS VARCHAR), count(*) FROM {c} GROUP BY 2"""


@query(_SCAN.format(e="ev", c="ca") + " UNION ALL SELECT 'flows', '', count(DISTINCT flow) FROM ca", EVENTS_SQL)
def log_scan(s, d):
    return reports.scan(events_log(s, d), {"flows": FLOW})


@query(
    """SELECT statistic, name, coalesce(a.n, 0) AS in_log, coalesce(a.n, 0) / CASE WHEN statistic IN ('activity', 'kind', 'events', 'day_precision_events') THEN (SELECT count(*) FROM ev) ELSE (SELECT count(*) FROM ca) END AS log_share,
  coalesce(b.n, 0) AS in_sample, coalesce(b.n, 0) / CASE WHEN statistic IN ('activity', 'kind', 'events', 'day_precision_events') THEN (SELECT count(*) FROM es) ELSE (SELECT count(*) FROM cs) END AS sample_share
FROM a FULL JOIN b USING (statistic, name)""",
    EVENTS_SQL,
    "sm AS (" + SQL["stratified_hash_sample"] + "), es AS (SELECT ev.* FROM ev WHERE case_id IN (SELECT case_id FROM sm)), cs AS (SELECT ca.* FROM ca WHERE case_id IN (SELECT case_id FROM sm))",
    f"a AS ({_SCAN.format(e='ev', c='ca')}), b AS ({_SCAN.format(e='es', c='cs')})",
)
def sample_disclosure(s, d):
    log = events_log(s, d)
    return reports.disclosure(log, checks.stratified_sample(log, 200, 20))


@query(
    """SELECT count(*) AS our_rows, (SELECT count(*) FROM er WHERE activity <> 'error' AND rnk <> 10) AS their_rows, count(DISTINCT case_id) AS our_cases,
  (SELECT count(DISTINCT case_id) FROM er WHERE activity <> 'error' AND rnk <> 10) AS their_cases, (SELECT count(DISTINCT case_id) FROM er WHERE activity <> 'error' AND rnk <> 10) AS shared_cases,
  (SELECT count(*) FROM (SELECT case_id FROM er GROUP BY 1 HAVING count_if(activity <> 'error' AND rnk <> 10) BETWEEN 1 AND count(*) - 1)) AS differing_counts FROM er""",
    EVENTS_RAW,
)
def table_cross_check(s, d):
    ours = events_raw(s, d)
    return csv.cross_check(ours, ours.where("activity not in ('error', 'view')"))


@query(
    """SELECT case_id, CASE WHEN a.n IS NULL THEN 'only theirs' WHEN b.n IS NULL THEN 'only ours' ELSE 'other number of rows' END AS problem, coalesce(a.n, 0) AS our_rows, coalesce(b.n, 0) AS their_rows
FROM (SELECT case_id, count(*) AS n FROM er WHERE rnk <> 20 GROUP BY 1) a FULL JOIN (SELECT case_id, count(*) AS n FROM er WHERE activity <> 'error' AND rnk <> 10 GROUP BY 1) b USING (case_id) WHERE a.n IS DISTINCT FROM b.n""",
    EVENTS_RAW,
)
def table_differences(s, d):
    ours = events_raw(s, d)
    return csv.differing_cases(ours.where("activity <> 'click'"), ours.where("activity not in ('error', 'view')"))


@query("SELECT activity, CAST(sum(n - 1) AS BIGINT) AS repeats, count(*) AS cases FROM (SELECT case_id, activity, count(*) AS n FROM ev GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1 ORDER BY repeats DESC, activity LIMIT 3", EVENTS_SQL)
def top_rework_activities(s, d):
    return variants.top_rework(events_log(s, d), 3)


# Spans


@query(
    """SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY t, step, span_id) - 1 AS INTEGER) AS pos, activity, t AS ts_s, resource FROM (
  SELECT coalesce(item_key, concat('run:', substr(run_id, 1, 8))) AS case_id, CASE WHEN kind = 'model' THEN 'Agent Deliberation' ELSE name END AS activity,
  CASE WHEN kind = 'model' THEN concat('agent:', model) ELSE concat('tool:', name) END AS resource, t, step, span_id FROM sp JOIN rn USING (run_id))""",
    SPANS_SQL,
)
def span_internal_log(s, d):
    log = sp.to_log(spans(s, d), runs(s, d), "internal", TOOLS, POLICY)
    return log.events.select("case_id", "pos", "activity", "ts_s", "resource")


#: Both duties done on an item within a run, whoever plays the agent.
_DUTIES = Policy(conflicting_pairs=(("Record Goods Receipt", "Clear Invoice"),))


@query(
    """SELECT run_id, item_key AS case_id, 'CTRL-SOD' AS rule_id FROM sp WHERE activity IS NOT NULL AND item_key IS NOT NULL GROUP BY 1, 2
HAVING bool_or(activity = 'Record Goods Receipt') AND bool_or(activity = 'Clear Invoice')""",
    SPANS_SQL,
)
def findings_by_run(s, d):
    """Items of a run are taken two by two, so that some have both duties."""
    return reports.findings_by_run(spans(s, d), runs(s, d), TOOLS, _DUTIES).select("run_id", "case_id", "rule_id")


#: Events as spans of agents: a run is a day, an item a user, so a case is a user's day; what the rules find in each run.
_FOUND = f"""nr AS (SELECT split_part(case_id, '_', 2) AS run, min(split_part(case_id, '_', 1)) AS c FROM fa
  WHERE flow IN ('flow0', 'flow1') AND receipt_cents IS NOT NULL AND invoice_cents IS NOT NULL AND NOT distinct_values GROUP BY 1),
fo AS (SELECT split_part(case_id, '_', 2) AS run, split_part(case_id, '_', 1) AS item, rule_id, at_seq, order_assumed FROM ({_GR} UNION ALL {_TOL.replace("FROM fa, na", "FROM fa").replace(" AND (c IS NULL OR case_id < c)", "")}
  UNION ALL SELECT case_id, CAST(min(pos) FILTER (activity = 'purchase') AS INTEGER), false, 'CTRL-SOD' FROM ev GROUP BY 1 HAVING bool_or(activity = 'purchase') AND bool_or(activity = 'view')
  UNION ALL SELECT case_id, CAST(min(pos) FILTER (activity = 'purchase') AS INTEGER), false, 'CTRL-SOD' FROM ev GROUP BY 1 HAVING bool_or(activity = 'purchase') AND bool_or(activity = 'click')
  UNION ALL {_BLK} UNION ALL {_DEL})),
ff AS (SELECT fo.* FROM fo LEFT JOIN nr USING (run) WHERE rule_id <> 'CTRL-TOLERANCE' OR c IS NULL OR item < c)"""
_DONE = {x: x for x in ("view", "click", "purchase", "error", "signup")}


def _agents(s, d):
    """Spans, runs and attributes of items, from events."""
    e = events_raw(s, d)
    item, day = F.substring_index("case_id", "_", 1), F.substring_index("case_id", "_", -1)
    rows = e.select(
        F.col("arrival").cast("string").alias("span_id"), day.alias("run_id"), F.lit("tool").alias("kind"), F.col("activity").alias("name"), F.col("arrival").alias("step"),
        F.timestamp_seconds("ts_s").alias("started_at"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), item.alias("item_key"), "value_cents",
        F.lit('{"result":{}}').alias("attributes"), "case_attrs",
    )
    about = [F.lit(x).alias(x) for x in ("actor_id", "role", "model", "prompt_version", "scenario_id", "killswitch")]
    flows = rows.groupBy(F.col("item_key").alias("case_id")).agg(F.min(F.col("case_attrs")[FLOW]).alias("flow"))
    attributes = flows.select("case_id", F.create_map(F.lit(FLOW), "flow").alias("attrs"))
    return rows, rows.select("run_id").distinct().select("run_id", *about), attributes


@query("SELECT run AS run_id, item AS case_id, rule_id, at_seq, order_assumed FROM ff", EVENTS_SQL, _FACTS, _FOUND)
def findings_of_all_rules(s, d):
    rows, who, attributes = _agents(s, d)
    return reports.findings_by_run(rows, who, _DONE, POLICY, attributes).drop("summary", "detail")


@query(
    """SELECT run_id, rule_id, in_scope, coalesce(n, 0) AS violations, CASE WHEN rule_id = 'CTRL-TOLERANCE' AND run_id IN (SELECT run FROM nr) THEN 'not applicable' WHEN in_scope = 0 THEN 'nothing in scope' ELSE 'evaluated' END AS status
FROM (SELECT split_part(case_id, '_', 2) AS run_id, rule_id, count(*) FILTER (rule_id NOT IN ('CTRL-GR', 'CTRL-TOLERANCE') OR flow IN ('flow0', 'flow1')) AS in_scope
  FROM ca, (VALUES ('CTRL-GR'), ('CTRL-TOLERANCE'), ('CTRL-SOD'), ('CTRL-BLOCK'), ('CTRL-DELETED')) r(rule_id) GROUP BY 1, 2)
LEFT JOIN (SELECT run AS run_id, rule_id, count(*) AS n FROM ff GROUP BY 1, 2) USING (run_id, rule_id)""",
    EVENTS_SQL, _FACTS, _FOUND,
)
def findings_scope(s, d):
    rows, who, attributes = _agents(s, d)
    return reports.findings_scope(rows, who, _DONE, POLICY, attributes)


@query(
    """SELECT run_id AS trace_id, count(*) AS observations, round(CAST((max(t) + 30) * 1000 - min(t) * 1000 AS DOUBLE) / 1000, 2) AS seconds FROM sp GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10""",
    SPANS_SQL,
)
def longest_traces(s, d):
    o = spans(s, d).select(F.col("run_id").alias("trace_id"), F.col("started_at").alias("start_time"), F.timestamp_add("SECOND", F.lit(30), "started_at").alias("end_time"))
    return reports.longest_traces(runs(s, d).select(F.col("run_id").alias("trace_id")), o)


@query("SELECT item_key, list_aggregate(list_sort(list(DISTINCT name)), 'string_agg', ',') AS versions FROM sp WHERE item_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) > 1", SPANS_SQL)
def mixed_versions(s, d):
    return reports.mixed_versions(spans(s, d), "item_key", "name").select("item_key", F.array_join("versions", ",").alias("versions"))


@query(
    """SELECT coalesce(CASE model WHEN 'scripted' THEN NULL ELSE model END, 'unmeasured') AS model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN n % 2 = 0 THEN output_tokens ELSE 0 END) AS BIGINT) AS output_tokens
FROM sp JOIN rn USING (run_id) WHERE kind = 'model' GROUP BY 1""",
    SPANS_SQL,
)
def usage_by_model(s, d):
    """Token counts come as a map that doesn't always have the output."""
    own = F.map_concat(F.create_map(F.lit("input"), F.col("input_tokens")), F.when(F.col("n") % 2 == 0, F.create_map(F.lit("output"), F.col("output_tokens"))).otherwise(F.create_map().cast("map<string,bigint>")))
    rows = spans(s, d).where("kind = 'model'").join(runs(s, d).select("run_id", F.when(F.col("model") != "scripted", F.col("model")).alias("model")), "run_id")
    return reports.usage(rows.withColumn("tokens", own), "model", "tokens", ("input", "output"))


@query("SELECT run_id, refusals FROM (SELECT rn.run_id, coalesce(r, 0) AS refusals FROM rn LEFT JOIN (SELECT run_id, CAST(count_if(NOT ok) AS BIGINT) AS r FROM sp WHERE kind = 'tool' GROUP BY 1) USING (run_id)) ORDER BY refusals DESC, run_id LIMIT 20", SPANS_SQL)
def review_refusals(s, d):
    from .views import messages

    features = sp.run_features(runs(s, d), spans(s, d), messages(s, d), list(TOOLS))
    return sp.review(features, "refusals").select("run_id", "refusals").limit(20)


@query("SELECT conv_id, max(turn) + 1 AS next FROM conversations GROUP BY 1 UNION ALL SELECT -1, 0")
def next_numbers(s, d):
    c = table(s, d, "conversations")
    return reports.next_number(c, "conv_id", "turn", c.select("conv_id").union(s.range(-1, 0).toDF("conv_id")))


@query("SELECT conv_id, turn, substr(sha256(coalesce(text, '')), 1, 12) AS version FROM conversations WHERE role = 'system'")
def prompt_versions(s, d):
    c = table(s, d, "conversations").where("role = 'system'")
    return c.select("conv_id", "turn", scenarios.version_hash(F.coalesce("text", F.lit(""))).alias("version"))


# Controls


@query(
    """SELECT item_key, CASE WHEN paused THEN 'refused:paused' WHEN NOT permitted THEN 'refused:permission_denied' WHEN item_deleted THEN 'refused:deleted' WHEN sod_conflict THEN 'refused:sod_conflict'
  WHEN NOT coalesce(item_key % 7 > 0 AND 100.0::DOUBLE * (item_key % 9 - item_key % 7) / nullif(item_key % 7, 0) <= 5, false) THEN 'refused:quantity' ELSE 'recorded' END AS outcome FROM it""",
    ITEMS_SQL,
)
def receipt_ladder(s, d):
    df = items(s, d).withColumns({"ordered": F.col("item_key") % 7, "received": F.col("item_key") % 9})
    return controls.receipt_ladder(df, POLICY).select("item_key", "outcome")


@query(
    """SELECT item_key, decision, decision = 'match' AS within_tolerance, po / 100 AS po_value_eur, receipt / 100 AS receipt_value_eur, invoice / 100 AS invoice_value_eur, var / 100 AS variance_eur, tol / 100 AS tolerance_eur,
  coalesce(100.0::DOUBLE * var / nullif(receipt, 0), 0) AS variance_pct FROM mt""",
    ITEMS_SQL,
)
def match_result(s, d):
    return controls.match_result(controls.three_way_match(items(s, d), POLICY)).drop("reasons")


_PAUSED = {"writes": ["clear_invoice", "record_receipt"], "all": ["clear_invoice", "record_receipt", "get_item"]}


@query("SELECT span_id, NOT ((conv_id % 3 = 1 AND name IN ('clear_invoice', 'record_receipt')) OR (conv_id % 3 = 2 AND name <> 'chat')) AS allowed FROM sp", SPANS_SQL)
def killswitch_gate(s, d):
    level = F.element_at(F.array(F.lit("off"), F.lit("writes"), F.lit("all")), (F.col("conv_id") % 3 + 1).cast("int"))
    return spans(s, d).select("span_id", controls.is_allowed(F.col("name"), level, _PAUSED).alias("allowed"))


@query(
    """SELECT item_key, role, role = 'ap_clerk' AND flow = 'flow1' AS clears, role = 'controller' AS decides FROM it""",
    ITEMS_SQL,
)
def role_actions(s, d):
    df = items(s, d)
    sees = controls.can_view_item(F.col("role"), F.lit(""), F.lit(""), F.lit("flow1"), F.col("flow"))
    return df.select("item_key", "role", controls.can_act("clear_invoice", F.col("role"), sees).alias("clears"), controls.can_act("decide_approval", F.col("role"), sees).alias("decides"))


@query("SELECT l_orderkey AS item_key, CAST(sum(CAST(round_even(l_extendedprice * 100, 0) AS BIGINT)) AS BIGINT) AS receipt_value_cents FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def valid_receipts(s, d):
    r = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("item_key"), F.bround(F.col("l_extendedprice") * 100).cast("bigint").alias("value_cents"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("cancelled_at"),
    )
    return controls.valid_receipts(r)


@query(
    """SELECT o_custkey AS item_key, arg_min(o_orderkey, struct_pack(t := o_orderdate, i := o_orderkey)) AS invoice_id FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1"""
)
def first_open_invoice(s, d):
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "queued_for_approval").otherwise("cancelled")
    inv = table(s, d, "orders").select(F.col("o_custkey").alias("item_key"), F.col("o_orderkey").alias("invoice_id"), status.alias("status"), F.col("o_orderdate").alias("recorded_at"))
    return controls.first_invoice(inv).select("item_key", "invoice_id")


@query(
    """SELECT item_key, flow, po / 100 AS po_value_eur, receipt / 100 AS receipt_value_eur, invoice / 100 AS invoice_value_eur, item_key % 11 = 0 AS payment_blocked, role = 'controller' AS released, item_deleted AS deleted FROM it""",
    ITEMS_SQL,
)
def public_items(s, d):
    df = items(s, d).withColumns({"released_at": F.when(F.col("role") == "controller", F.col("o_orderdate")), "deleted_at": F.when(F.col("item_deleted"), F.col("o_orderdate"))})
    return controls.public_items(df, ["item_key", "flow"])


@query(
    """SELECT k.l_orderkey, k.l_linenumber, n - 1 AS siblings, (SELECT min(x.l_linenumber) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) x WHERE x.l_orderkey = k.l_orderkey AND x.l_linenumber <> k.l_linenumber) AS first_sibling
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) k JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) c USING (l_orderkey)"""
)
def item_siblings(s, d):
    return controls.siblings(table(s, d, "lineitem"), "l_orderkey", "l_linenumber")


# Scenarios: opening turns of conversations, grounded in customers


@query("SELECT event_type, n, least FROM (SELECT q.event_type, count(event_id) AS n, least FROM (VALUES ('view', 1), ('signup', 100000000), ('refund', 5)) q(event_type, least) LEFT JOIN events e ON e.event_type = q.event_type GROUP BY 1, 3) WHERE n < least")
def quota_shortfalls(s, d):
    quotas = s.createDataFrame([("view", 1), ("signup", 100_000_000), ("refund", 5)], "event_type string, least bigint")
    return checks.below_quota(table(s, d, "events"), "event_type", quotas).select("event_type", "n", "least")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def unaccounted_numbers(s, d):
    return checks.unaccounted_numbers(table(s, d, "events"), "props", [float(x) for x in range(50)]).select("event_id")


_SCENARIOS = """sc AS (SELECT concat('sc', o_orderkey // 2) AS id, concat('Please look at ', o_orderdate) AS opening, concat('c', o_custkey) AS actor, CASE WHEN o_orderkey % 10 = 0 THEN 'clerk' ELSE 'buyer' END AS role,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS item_key, CASE WHEN o_orderkey % 8 = 0 THEN 'open' ELSE 'none' END AS state, o_orderstatus AS intent, o_orderkey % 3 AS followups FROM orders)"""
_KNOWN = "SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1"


def _scenarios(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(
        F.concat(F.lit("sc"), F.expr("o_orderkey div 2")).alias("id"), F.concat(F.lit("Please look at "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("opening_message"),
        F.concat(F.lit("c"), "o_custkey").alias("actor_id"), F.when(k % 10 == 0, "clerk").otherwise("buyer").alias("role"), F.when(k % 4 != 0, k).alias("item_key"),
        F.when(k % 8 == 0, "open").otherwise("none").alias("item_state"), F.col("o_orderstatus").alias("intent"), F.lit(2).alias("turn_count"), F.array_repeat(F.lit("x"), (k % 3).cast("int")).alias("followups"),
    )


@query(
    f"""SELECT id, problem, count(*) AS n FROM (
  SELECT id, 'actor is not in the world' AS problem FROM sc WHERE substr(actor, 2)::BIGINT % 7 = 0 UNION ALL SELECT id, 'role is not the actor''s' FROM sc WHERE substr(actor, 2)::BIGINT % 7 <> 0 AND role <> 'buyer'
  UNION ALL SELECT id, 'item does not exist' FROM sc WHERE item_key IS NOT NULL AND item_key NOT IN ({_KNOWN}) UNION ALL SELECT id, 'state without an item' FROM sc WHERE item_key IS NULL AND state <> 'none'
  UNION ALL SELECT id, 'turn count is not 1 and the followups' FROM sc WHERE followups <> 1 UNION ALL SELECT id, 'unknown intent' FROM sc WHERE intent NOT IN ('O', 'F')
  UNION ALL SELECT id, 'id is not unique' FROM sc GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT id, 'opening message is not unique' FROM sc WHERE opening IN (SELECT opening FROM sc GROUP BY 1 HAVING count(*) > 1)) GROUP BY 1, 2""",
    _SCENARIOS,
)
def scenario_problems(s, d):
    actors = table(s, d, "customer").where("c_custkey % 7 <> 0").select(F.concat(F.lit("c"), "c_custkey").alias("actor_id"), F.lit("buyer").alias("role"))
    known = table(s, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("item_key"))
    found = scenarios.problems(_scenarios(s, d), actors, known, {"intent": ("O", "F")})
    return found.groupBy("id", "problem").agg(F.count("*").alias("n"))


#: Orders as scenarios whose flow, policy and damaged case refer to priorities, customers and line items.
_REFERENCES = """rf AS (SELECT o_orderkey AS id, o_orderpriority AS flow, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS policy, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS dq,
  CASE WHEN o_orderkey % 2 = 0 THEN 'challenge' END AS grp FROM orders)"""


@query(
    """SELECT id, 'flow is not known' AS problem FROM rf WHERE flow IS NOT NULL AND flow NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority > '2')
UNION ALL SELECT id, 'applicable_policy is not known' FROM rf WHERE policy IS NOT NULL AND policy NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT id, 'data_quality_case_id is not known' FROM rf WHERE dq IS NOT NULL AND dq NOT IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT id, 'a damaged record outside its group' FROM rf WHERE dq IS NOT NULL AND grp IS NULL""",
    _REFERENCES,
)
def scenario_references(s, d):
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    rows = o.select(
        k.alias("id"), F.col("o_orderpriority").alias("flow"), F.when(k % 3 > 0, F.col("o_custkey")).alias("applicable_policy"), F.when(k % 5 == 0, k).alias("data_quality_case_id"),
        F.when(k % 2 == 0, "challenge").alias("scenario_group"),
    )
    known = {
        "flow": o.where("o_orderpriority > '2'").select("o_orderpriority").distinct(), "applicable_policy": o.where("o_orderstatus = 'P'").select("o_custkey").distinct(),
        "data_quality_case_id": table(s, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct(),
    }
    return scenarios.unknown_references(rows, known).union(scenarios.misplaced(rows))


@query("SELECT id, count(*) AS n FROM sc WHERE id NOT IN (SELECT concat('sc', l_orderkey // 2) FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1", _SCENARIOS)
def scenarios_pending(s, d):
    status = F.when(F.col("l_returnflag") == "R", "completed").otherwise("failed")
    results = table(s, d, "lineitem").select(F.concat(F.lit("sc"), F.expr("l_orderkey div 2")).alias("scenario_id"), status.alias("status"))
    return scenarios.pending(_scenarios(s, d), results).groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('R'), ('X')) x(intent) WHERE intent NOT IN (SELECT o_orderstatus FROM orders)")
def scenario_unused(s, d):
    return scenarios.unused(_scenarios(s, d), "intent", ("R", "X"))


@query(
    """SELECT flow, declared, seen FROM (SELECT coalesce(o.flow, b.flow) AS flow, coalesce(declared, 0) AS declared, o.flow IS NOT NULL AS seen FROM (SELECT DISTINCT concat('flow', user_id % 4) AS flow FROM events) o
FULL JOIN (VALUES ('flow0', 1), ('flow1', 2), ('flow9', 1)) b(flow, declared) ON o.flow = b.flow) WHERE declared <> 1 OR NOT seen"""
)
def flow_bucket_drift(s, d):
    flows = table(s, d, "events").select(F.concat(F.lit("flow"), F.col("user_id") % 4).alias("flow"))
    return scenarios.bucket_drift(flows, "flow", {"needed": ("flow0", "flow1"), "not_needed": ("flow1", "flow9")})


@query(r"SELECT n_nationkey, list_aggregate(list_sort(list_distinct(regexp_extract_all(t, '\b((?:[A-Z]{3,}-)(?:[0-9]+|[A-Z]+))\b', 1))), 'string_agg', ',') AS ids FROM (SELECT n_nationkey, concat(n_name, '-', n_regionkey, ' needs ', n_name, '-GR and AB-1, as ', n_name, '-', n_regionkey) AS t FROM nation)")
def requirement_ids(s, d):
    name = F.col("n_name")
    text = F.concat(name, F.lit("-"), "n_regionkey", F.lit(" needs "), name, F.lit("-GR and AB-1, as "), name, F.lit("-"), "n_regionkey")
    return table(s, d, "nation").select("n_nationkey", F.nullif(F.array_join(scenarios.requirement_ids(text), ","), F.lit("")).alias("ids"))


@query("SELECT n_nationkey AS doc, 'limit' AS key, CAST(n_regionkey AS VARCHAR) AS claimed, '2' AS actual FROM nation WHERE n_regionkey <> 2")
def declared_facts(s, d):
    docs = table(s, d, "nation").select(F.col("n_nationkey").alias("doc"), F.lit("limit").alias("key"), F.col("n_regionkey").cast("string").alias("claimed"))
    return scenarios.declared_facts(docs, {"limit": "2"})
