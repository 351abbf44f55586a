"""Agent spans: their outcomes and layers, the event log they make, what they cost, and features of each run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import literal_map
from ..policy import Policy
from .eventlog import EventLog, merge_case_attributes
from .variants import sequences

#: The layers of a span log, and names of spending that no activity or case has caused.
LAYERS = ("business", "attempts", "internal")
LOOKUP_ONLY, FINAL_REPLY, UNATTRIBUTED = "(lookup only)", "(final reply)", "(unattributed)"
TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def result_field(name: str) -> Column:
    return F.get_json_object("attributes", f"$.result.{name}")


def outcome() -> Column:
    """done, queued, paused or refused."""
    queued = result_field("status") == "queued_for_approval"
    return F.when(F.col("ok") & F.coalesce(queued, F.lit(False)), "queued").when(F.col("ok"), "done").when(result_field("error") == "paused", "paused").otherwise("refused")


def recorded_activity(activity: Column, ok: Column, status: Column) -> Column:
    """Only a write that succeeded and wasn't queued carries its activity."""
    return F.when(ok & (F.coalesce(status, F.lit("")) != "queued_for_approval"), activity)


def permission_denied(error: Column) -> Column:
    return F.coalesce(error == "permission_denied", F.lit(False))


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last version of each key."""
    w = W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def layered(
    spans: DataFrame,
    runs: DataFrame,
    layer: str,
    tools: Mapping[str, str],
    attempts: Mapping[str, str] | None = None,
    queued: Mapping[str, str] | None = None,
) -> DataFrame:
    """Raw events of a layer, with the attributes of their run.

    ``business`` has what write tools did, ``attempts`` also what was queued or refused, ``internal`` every span.  The
    case is the business object; in the internal layer the run, where a span has none.
    """
    if layer not in LAYERS:
        raise ValueError(f"layer must be one of {', '.join(LAYERS)}, not {layer!r}")
    about = ("actor_id", "role", "model", "prompt_version", "scenario_id", "killswitch")
    own = ("span_id", "run_id", "kind", "name", "step", "started_at", "ok", "error", "item_key", "value_cents", "attributes")
    df = spans.select(*own).join(runs.select("run_id", *about), "run_id", "left").withColumn("outcome", outcome())
    agent = F.concat(F.lit("agent:"), F.coalesce("model", F.lit("unknown")))
    if layer == "internal":
        model = F.col("kind") == "model"
        case = F.coalesce(F.nullif("item_key", F.lit("")), F.concat(F.lit("run:"), F.substring("run_id", 1, 8)))
        activity = F.when(model, "Agent Deliberation").otherwise(F.col("name"))
        resource = F.when(model, agent).otherwise(F.concat(F.lit("tool:"), "name"))
    else:
        df = df.where((F.col("kind") == "tool") & (F.coalesce("item_key", F.lit("")) != ""))
        business = F.element_at(literal_map(tools, "string"), F.col("name"))
        waiting = F.coalesce(F.element_at(literal_map(queued or {}, "string"), F.col("name")), F.concat(business, F.lit(" Queued for Approval")))
        tried = F.coalesce(F.element_at(literal_map(attempts or {}, "string"), F.col("name")), F.concat(F.lit("Attempted "), business))
        activity = F.when(F.col("outcome") == "done", business)
        if layer == "attempts":
            activity = F.when(business.isNull(), F.lit(None)).when(F.col("outcome") == "queued", waiting).when(F.col("outcome") != "done", tried).otherwise(activity)
        case, resource = F.col("item_key"), agent
    details = {
        "span_id": F.col("span_id"), "run_id": F.col("run_id"), "tool": F.col("name"), "ok": F.col("ok"), "error": F.col("error"),
        "outcome": F.when(F.col("kind") == "tool", F.col("outcome")).otherwise(""), "step": F.col("step"),
    }
    micros = F.unix_micros(F.col("started_at").cast("timestamp"))
    return df.select(
        case.alias("case_id"), activity.alias("activity"), F.floor(micros / 1_000_000).alias("ts_s"), micros.alias("sort_hint"),
        F.dense_rank().over(W.partitionBy(case).orderBy("started_at", "step", "span_id")).cast("bigint").alias("arrival"),
        resource.alias("resource"), F.coalesce("value_cents", F.lit(0)).cast("bigint").alias("value_cents"),
        F.create_map(*[x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]).alias("attrs"),
        F.create_map(F.lit("source"), F.lit("agent"), *[x for k in about for x in (F.lit(k), F.coalesce(F.col(k), F.lit("")))]).alias("case_attrs"),
    ).where("activity is not null")


def to_log(spans: DataFrame, runs: DataFrame, layer: str, tools: Mapping[str, str], policy: Policy, items: DataFrame | None = None, **names) -> EventLog:
    """The event log of a layer; case attributes come from the item, then from its spans, the last one winning."""
    raw = layered(spans, runs, layer, tools, **names)
    own = raw.select("case_id", "arrival", F.col("case_attrs").alias("attrs"))
    if items is not None:
        own = own.union(items.select("case_id", F.lit(0).cast("bigint"), "attrs"))
    return EventLog.build(raw, policy.activity_rank, merge_case_attributes(own), source=f"spans layer={layer}")


def usd(policy: Policy) -> Column:
    """Dollars of a row's tokens under its model's price; null where the model, or its name's last part, has none.

    Amounts are counted in billionths first, so sums don't depend on their order.
    """
    rates = {k: v[0] for k, v in policy.prices.items()}, {k: v[1] for k, v in policy.prices.items()}
    tail = F.element_at(F.split("model", "/"), -1)
    rate_in, rate_out = (F.coalesce(F.element_at(literal_map(r, "double"), F.col("model")), F.element_at(literal_map(r, "double"), tail)) for r in rates)
    amount = (
        F.col("input_tokens") * rate_in + F.col("cache_read_tokens") * rate_in * policy.cache_read_multiplier
        + F.col("cache_write_tokens") * rate_in * policy.cache_write_multiplier + F.col("output_tokens") * rate_out
    )
    return amount / 1_000_000


def _spent(spans: DataFrame, runs: DataFrame, policy: Policy) -> DataFrame:
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in TOKENS]
    steps = spans.where("kind = 'model'").groupBy("run_id", "step").agg(*sums)
    return steps.join(runs.select("run_id", "model"), "run_id", "left").withColumn("usd", usd(policy))


def _pooled(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(
        *[F.sum(c).alias(c) for c in TOKENS], F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"), F.bool_or(F.col("usd").isNotNull()).alias("priced"),
        F.count_if(F.col("k") > 1).alias("split_shares"),
    )


def _shares(df: DataFrame) -> DataFrame:
    """A step's tokens in equal whole shares for its targets; what doesn't divide is lost, dollars aren't."""
    return df.select("target", F.expr("size(targets)").alias("k"), *[F.expr(f"{c} div size(targets)").alias(c) for c in TOKENS], (F.col("usd") / F.size("targets")).alias("usd"))


def cost_by_run(spans: DataFrame, runs: DataFrame, policy: Policy) -> DataFrame:
    """Tokens and dollars of each run that spent any; ``priced`` tells no cost from unknown cost."""
    got = _spent(spans, runs, policy).groupBy("run_id", "model").agg(
        *[F.sum(c).alias(c) for c in TOKENS], F.count("*").alias("steps"), F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"), F.bool_or(F.col("usd").isNotNull()).alias("priced")
    )
    return got.where(" + ".join(TOKENS) + " > 0")


def cost_by_activity(spans: DataFrame, runs: DataFrame, policy: Policy) -> DataFrame:
    """Spending of each activity: a step's spending goes to its tools' activities, in equal shares.

    Steps whose tools record no activity are lookups; steps without tools are final replies.  An activity that a step
    has twice gets two shares.
    """
    tools = spans.where("kind = 'tool'").groupBy("run_id", "step").agg(F.collect_list(F.nullif("activity", F.lit(""))).alias("names"))
    df = _spent(spans, runs, policy).join(tools, ["run_id", "step"], "left")
    targets = F.when(F.size("names") > 0, F.col("names")).when(F.col("names").isNotNull(), F.array(F.lit(LOOKUP_ONLY))).otherwise(F.array(F.lit(FINAL_REPLY)))
    df = df.withColumn("targets", targets).select("*", F.explode("targets").alias("target"))
    return _pooled(_shares(df), "target").withColumnRenamed("target", "activity")


def cost_by_case(spans: DataFrame, runs: DataFrame, policy: Policy) -> DataFrame:
    """Spending of each business object: a step's goes to the items it touched, each once.

    Steps without an item go to the run's only item, or to nobody.
    """
    touched = spans.where("kind = 'tool' and item_key <> ''").select("run_id", "step", "item_key").distinct()
    items = touched.groupBy("run_id", "step").agg(F.sort_array(F.collect_list("item_key")).alias("items"))
    only = touched.groupBy("run_id").agg(F.min("item_key").alias("one"), F.max("item_key").alias("other"))
    df = _spent(spans, runs, policy).join(items, ["run_id", "step"], "left").join(only, "run_id", "left")
    alone = F.when(F.col("one") == F.col("other"), F.col("one"))
    df = df.withColumn("targets", F.coalesce("items", F.array(F.coalesce(alone, F.lit(UNATTRIBUTED)))))
    return _pooled(_shares(df.select("*", F.explode("targets").alias("target"))), "target").withColumnRenamed("target", "case_id")


def cost_by_variant(spans: DataFrame, runs: DataFrame, log: EventLog, policy: Policy) -> DataFrame:
    """Spending of each variant; cases that the log hasn't got are pooled under ``in_log`` false."""
    named = sequences(log.events).select("case_id", F.array_join("variant", " -> ").alias("variant"), F.lit(True).alias("in_log"))
    df = cost_by_case(spans, runs, policy).join(named, "case_id", "left")
    df = df.withColumn("in_log", F.coalesce("in_log", F.lit(False))).withColumn("variant", F.coalesce("variant", F.lit("")))
    return df.groupBy("in_log", "variant").agg(F.count("*").alias("cases"), *[F.sum(c).alias(c) for c in TOKENS], F.sum("usd").alias("usd"))


def tool_steps(spans: DataFrame) -> DataFrame:
    """Tool calls with what their result says."""
    return spans.where("kind = 'tool'").select(
        "run_id", "step", "started_at", "span_id", F.col("name").alias("tool"), "item_key", "ok", "error",
        result_field("status").alias("status"), result_field("decision").alias("decision"),
        F.get_json_object("attributes", "$.arguments").alias("arguments"),
    )


def retries(steps: DataFrame, writes: list[str]) -> DataFrame:
    """Write calls that follow a refused call of the same tool on the same item within the run."""
    w = W.partitionBy("run_id", "tool", "item_key").orderBy("started_at", "step", "span_id").rowsBetween(W.unboundedPreceding, -1)
    seen = F.coalesce(F.max((~F.col("ok")).cast("int")).over(w), F.lit(0)) == 1
    return steps.where(F.col("tool").isin(writes)).withColumn("retry", seen).where("retry").drop("retry")


def run_features(runs: DataFrame, spans: DataFrame, messages: DataFrame, writes: list[str]) -> DataFrame:
    """A row for each run: turns, tool calls, refusals, items, writes, retries and the final reply."""
    steps = tool_steps(spans)
    write, queued = F.col("tool").isin(writes), F.coalesce(F.col("status") == "queued_for_approval", F.lit(False))
    calls = steps.groupBy("run_id").agg(
        F.count("*").alias("tool_calls"), F.array_sort(F.collect_set("tool")).alias("distinct_tools"), F.count_if(~F.col("ok")).alias("refusals"),
        F.array_sort(F.collect_set(F.nullif("item_key", F.lit("")))).alias("items"), F.count_if(write).alias("write_attempts"),
        F.count_if(write & F.col("ok") & ~queued).alias("writes_succeeded"), F.count_if(write & queued).alias("writes_queued"),
        (F.count_if(write & ~F.col("ok")) > 1).alias("repeated_refusals"),
    )
    again = retries(steps, writes).groupBy("run_id").agg(F.count("*").alias("retries"))
    assistant = F.col("role") == "assistant"
    said = messages.groupBy("run_id").agg(
        F.count_if(assistant).alias("turns"), F.max_by(F.when(assistant, F.col("content")), F.when(assistant, F.col("message_id"))).alias("final_reply")
    )
    df = runs.join(said, "run_id", "left").join(calls, "run_id", "left").join(again, "run_id", "left")
    df = df.na.fill(0, ["turns", "tool_calls", "refusals", "write_attempts", "writes_succeeded", "writes_queued", "retries"])
    none = F.array().cast("array<string>")
    return (
        df.withColumn("items", F.coalesce("items", none)).withColumn("distinct_tools", F.coalesce("distinct_tools", none))
        .withColumn("repeated_refusals", F.coalesce("repeated_refusals", F.lit(False))).withColumn("final_reply", F.coalesce("final_reply", F.lit("")))
        .withColumn("multi_item", F.size("items") > 1).withColumn("retried_after_refusal", F.col("retries") > 0)
    )


def review(features: DataFrame, order: str = "arrival", violations: DataFrame | None = None) -> DataFrame:
    """Runs in an order for reviewing them: arrival, retries, multi-item, refusals or violations."""
    if violations is not None:
        features = features.join(violations.groupBy("run_id").agg(F.count("*").alias("violations")), "run_id", "left").na.fill(0, ["violations"])
    orders = {
        "arrival": [F.col("started_at")],
        "retries": [F.col("retried_after_refusal").desc(), F.col("write_attempts").desc()],
        "multi-item": [F.col("multi_item").desc(), F.col("started_at")],
        "refusals": [F.col("refusals").desc()],
        "violations": [F.col("violations").desc()],
    }
    if order not in orders:
        raise ValueError(f"order must be one of {', '.join(orders)}, not {order!r}")
    return features.orderBy(*orders[order], "run_id")
