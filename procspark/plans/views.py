"""Event logs, spans and business items over the standard tables, each with the same view in SQL.

The SQL halves are lists of common table expressions, so a query's SQL starts with the ones it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.eventlog import EventLog
from ..policy import Policy
from ..schema import FLOW

#: Activity ranks for the events log; undeclared activities have rank 0.
RANKS = {"view": 10, "click": 20, "purchase": 30}
POLICY = Policy(
    activity_rank=RANKS,
    clear="purchase", invoice="click", receipts=("view",), remove_block="error", set_block="signup", delete="error",
    gr_required_flows=("flow0", "flow1"), invoice_matching_not_applicable_flows=("flow3",),
    conflicting_pairs=(("view", "purchase"), ("click", "purchase")),
    tolerance_abs_eur=5, tolerance_pct=2.0, clearing_auto_approve_limit_eur=1000, approval_limits_eur={"controller": 3000},
    duplicate_invoice_window_days=90, duplicate_invoice_value_tolerance_eur=50,
    prices={"model-a": (2.0, 10.0), "model-b": (5.0, 25.0)},
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(col: str):
    return F.unix_seconds(F.col(col).cast("timestamp"))


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-days of the events table; times are cut to the hour, which makes ties."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("case_id"), F.col("event_type").alias("activity"),
        (F.floor(seconds("ts") / 3600) * 3600).alias("ts_s"), F.col("event_id").alias("arrival"),
        F.concat(F.lit("user_"), (F.get_json_object("props", "$.k").cast("bigint") % 20).cast("string")).alias("resource"),
        F.bround(F.col("value") * 100).cast("bigint").alias("value_cents"),
        F.create_map(F.lit(FLOW), F.concat(F.lit("flow"), (F.col("user_id") % 4).cast("string"))).alias("case_attrs"),
    )


EVENTS_RAW = """er AS (SELECT concat(user_id, '_', strftime(ts, '%Y%m%d')) AS case_id, event_type AS activity,
  CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS ts_s, event_id AS arrival,
  concat('user_', CAST(json_extract_string(props, '$.k') AS BIGINT) % 20) AS resource,
  CAST(round_even(value * 100, 0) AS BIGINT) AS value_cents, concat('flow', user_id % 4) AS flow,
  CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 20 WHEN 'purchase' THEN 30 ELSE 0 END AS rnk FROM events)"""
EVENTS_SQL = EVENTS_RAW + """,
ev AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, coalesce(ts_s = lag(ts_s) OVER w, false) AS tie_broken
  FROM er WINDOW w AS (PARTITION BY case_id ORDER BY ts_s, rnk, arrival)),
ca AS (SELECT case_id, min(ts_s) AS start_ts, max(ts_s) AS end_ts, count(*) AS event_count, min(flow) AS flow FROM ev GROUP BY 1)"""


def events_log(spark: SparkSession, sf_dir: str) -> EventLog:
    raw = events_raw(spark, sf_dir)
    attrs = raw.groupBy("case_id").agg(F.min(F.col("case_attrs")[FLOW]).alias("flow"))
    attrs = attrs.select("case_id", F.create_map(F.lit(FLOW), F.col("flow")).alias("attrs"))
    return EventLog.build(raw.drop("case_attrs"), RANKS, attrs, log_id="events", source="events")


def orders_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """Orders of a customer in a year, by status."""
    o = table(spark, sf_dir, "orders")
    raw = o.select(
        F.concat_ws("_", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")).alias("case_id"), F.col("o_orderstatus").alias("activity"),
        seconds("o_orderdate").alias("ts_s"), F.col("o_orderkey").alias("arrival"), F.lit("").alias("resource"),
        F.bround(F.col("o_totalprice") * 100).cast("bigint").alias("value_cents"),
    )
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cust"), "c_mktsegment")
    cases = raw.select("case_id").distinct().withColumn("cust", F.substring_index("case_id", "_", 1))
    attrs = cases.join(c, "cust").select("case_id", F.create_map(F.lit(FLOW), F.col("c_mktsegment")).alias("attrs"))
    return EventLog.build(raw, None, attrs, log_id="orders", source="orders")


ORDERS_SQL = """orw AS (SELECT concat(o_custkey, '_', year(o_orderdate)) AS case_id, o_orderstatus AS activity, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts_s,
  o_orderkey AS arrival, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS value_cents, o_custkey FROM orders),
oe AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, coalesce(ts_s = lag(ts_s) OVER w, false) AS tie_broken
  FROM orw WINDOW w AS (PARTITION BY case_id ORDER BY ts_s, arrival)),
oc AS (SELECT case_id, min(ts_s) AS start_ts, max(ts_s) AS end_ts, count(*) AS event_count, min(c_mktsegment) AS flow FROM oe JOIN customer ON c_custkey = o_custkey GROUP BY 1)"""


def lines_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """Line items of an order, by return flag and status."""
    li = table(spark, sf_dir, "lineitem")
    raw = li.select(
        F.col("l_orderkey").cast("string").alias("case_id"), F.concat("l_returnflag", "l_linestatus").alias("activity"), seconds("l_shipdate").alias("ts_s"),
        (F.col("l_linenumber") * F.lit(10**12).cast("bigint") + F.col("l_partkey") * 10**5 + F.col("l_suppkey")).alias("arrival"),
        F.bround(F.col("l_extendedprice") * 100).cast("bigint").alias("value_cents"),
    )
    return EventLog.build(raw, None, None, log_id="lines", source="lineitem")


LINES_SQL = """lr AS (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, concat(l_returnflag, l_linestatus) AS activity, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts_s,
  l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS arrival FROM lineitem),
le AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, coalesce(ts_s = lag(ts_s) OVER w, false) AS tie_broken
  FROM lr WINDOW w AS (PARTITION BY case_id ORDER BY ts_s, arrival))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent spans from conversations: user turns are model calls, other turns tool calls."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn", "role").agg(F.max(F.length("text")).cast("bigint").alias("n"))
    tool = F.col("role") != "user"
    pick = (F.col("conv_id") + F.col("turn")) % 5
    name = F.when(pick < 2, "clear_invoice").when(pick < 3, "record_receipt").otherwise("get_item")
    ok = (F.col("n") % 3) != 0
    queued = (F.col("n") % 7) == 0
    status = F.when(ok & queued, '{"result":{"status":"queued_for_approval"}}').when(~ok & (F.col("n") % 2 == 0), '{"result":{"error":"paused"}}').otherwise('{"result":{}}')
    k = lambda m: F.when(~tool, F.col("n") * m % 1000).otherwise(F.lit(0)).cast("bigint")
    return c.select(
        F.concat_ws("-", F.lit("s"), "conv_id", "turn", "role").alias("span_id"), F.concat(F.lit("run"), F.col("conv_id").cast("string")).alias("run_id"),
        F.when(tool, "tool").otherwise("model").alias("kind"), F.when(tool, name).otherwise("chat").alias("name"), F.expr("turn div 2").cast("bigint").alias("step"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("started_at"), ok.alias("ok"),
        F.when(~ok, "refused").alias("error"),
        F.when(tool & (pick < 4), F.concat(F.lit("item"), ((F.col("conv_id") + F.expr("turn div 4")) % 50).cast("string"))).alias("item_key"),
        F.when(tool & ok & ~queued & (pick < 3), F.when(pick < 2, "Clear Invoice").otherwise("Record Goods Receipt")).alias("activity"),
        F.when(tool, F.col("n") * 10).cast("bigint").alias("value_cents"), status.alias("attributes"),
        k(3).alias("input_tokens"), k(5).alias("output_tokens"), k(7).alias("cache_read_tokens"), k(11).alias("cache_write_tokens"), "conv_id", "turn", "role", "n",
    )


SPANS_SQL = """cv AS (SELECT conv_id, turn, role, CAST(max(length(text)) AS BIGINT) AS n FROM conversations GROUP BY 1, 2, 3),
sp0 AS (SELECT *, role <> 'user' AS tool, (conv_id + turn) % 5 AS pick, n % 3 <> 0 AS ok, n % 7 = 0 AS q FROM cv),
sp AS (SELECT concat('s-', conv_id, '-', turn, '-', role) AS span_id, concat('run', conv_id) AS run_id, CASE WHEN tool THEN 'tool' ELSE 'model' END AS kind,
  CASE WHEN NOT tool THEN 'chat' WHEN pick < 2 THEN 'clear_invoice' WHEN pick < 3 THEN 'record_receipt' ELSE 'get_item' END AS name,
  CAST(turn // 2 AS BIGINT) AS step, 1700000000 + conv_id * 3600 + turn * 60 AS t, ok,
  CASE WHEN ok AND q THEN 'queued' WHEN ok THEN 'done' WHEN n % 2 = 0 THEN 'paused' ELSE 'refused' END AS outcome,
  CASE WHEN tool AND pick < 4 THEN concat('item', (conv_id + turn // 4) % 50) END AS item_key,
  CASE WHEN tool AND ok AND NOT q AND pick < 2 THEN 'Clear Invoice' WHEN tool AND ok AND NOT q AND pick < 3 THEN 'Record Goods Receipt' END AS activity,
  CASE WHEN tool THEN 0 ELSE n * 3 % 1000 END AS input_tokens, CASE WHEN tool THEN 0 ELSE n * 5 % 1000 END AS output_tokens,
  CASE WHEN tool THEN 0 ELSE n * 7 % 1000 END AS cache_read_tokens, CASE WHEN tool THEN 0 ELSE n * 11 % 1000 END AS cache_write_tokens,
  conv_id, turn, role, n FROM sp0),
rn AS (SELECT run_id, CASE min(conv_id) % 3 WHEN 0 THEN 'model-a' WHEN 1 THEN 'vendor/model-b' ELSE 'scripted' END AS model FROM sp GROUP BY 1)"""
TOOLS = {"clear_invoice": "Clear Invoice", "record_receipt": "Record Goods Receipt"}


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    kind = F.col("conv_id") % 3
    return c.select(
        F.concat(F.lit("run"), F.col("conv_id").cast("string")).alias("run_id"), F.when(kind == 0, "model-a").when(kind == 1, "vendor/model-b").otherwise("scripted").alias("model"),
        F.lit("actor").alias("actor_id"), F.lit("ap_clerk").alias("role"), F.lit("v1").alias("prompt_version"), F.lit("").alias("scenario_id"), F.lit("off").alias("killswitch"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("conv_id") * 3600).alias("started_at"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn", "role").agg(F.max("text").alias("content"))
    return c.select(F.concat(F.lit("run"), F.col("conv_id").cast("string")).alias("run_id"), (F.col("turn") * 2 + (F.col("role") == "user").cast("int")).alias("message_id"), "role", "content")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase-order items from orders and their line items."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    got = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.when(F.col("l_linestatus") == "F", F.bround(F.col("l_extendedprice") * 100).cast("bigint"))).alias("receipt_value_cents"),
        F.sum(F.when(F.col("l_returnflag") != "R", F.bround(F.col("l_extendedprice") * 100).cast("bigint"))).alias("invoice_value_cents"),
    )
    return o.join(got, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("item_key"), F.concat(F.lit("flow"), (F.col("o_orderkey") % 4).cast("string")).alias("flow"),
        F.bround(F.col("o_totalprice") * 100).cast("bigint").alias("po_value_cents"), "receipt_value_cents", "invoice_value_cents",
        (F.col("o_orderkey") % 17 == 0).alias("item_deleted"), (F.col("o_orderkey") % 11 == 0).alias("payment_blocked"),
        (F.col("o_orderkey") % 13 == 0).alias("already_queued"), (F.col("o_orderkey") % 19 == 0).alias("sod_conflict"),
        (F.col("o_orderkey") % 23 == 0).alias("paused"), (F.col("o_orderkey") % 29 != 0).alias("permitted"),
        F.when(F.col("o_orderkey") % 5 == 0, "controller").otherwise("ap_clerk").alias("role"), "o_custkey", "o_orderdate",
    )


ITEMS_SQL = """li AS (SELECT l_orderkey, sum(CASE WHEN l_linestatus = 'F' THEN CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) END) AS r,
  sum(CASE WHEN l_returnflag <> 'R' THEN CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) END) AS i FROM lineitem GROUP BY 1),
it AS (SELECT o_orderkey AS item_key, concat('flow', o_orderkey % 4) AS flow, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS po, CAST(r AS BIGINT) AS receipt, CAST(i AS BIGINT) AS invoice,
  o_orderkey % 17 = 0 AS item_deleted, o_orderkey % 11 = 0 AS payment_blocked, o_orderkey % 13 = 0 AS already_queued, o_orderkey % 19 = 0 AS sod_conflict,
  o_orderkey % 23 = 0 AS paused, o_orderkey % 29 <> 0 AS permitted, CASE WHEN o_orderkey % 5 = 0 THEN 'controller' ELSE 'ap_clerk' END AS role
  FROM orders LEFT JOIN li ON l_orderkey = o_orderkey),
m0 AS (SELECT *, flow IN ('flow0', 'flow1') AS needs, CASE WHEN flow IN ('flow0', 'flow1') THEN receipt ELSE po END AS bl FROM it),
m1 AS (SELECT *, CAST(round_even(greatest(500.0, coalesce(nullif(bl, 0), po) * 2.0::DOUBLE / 100), 0) AS BIGINT) AS tol, coalesce(invoice - nullif(bl, 0), 0) AS var FROM m0),
mt AS (SELECT *, CASE WHEN item_deleted THEN 'item_deleted' WHEN invoice IS NULL THEN 'no_invoice' WHEN needs AND receipt IS NULL THEN 'missing_gr'
  WHEN var > tol THEN 'price_variance' ELSE 'match' END AS decision FROM m1)"""
