"""Control rules over cases, with their denominators, and with "not applicable" where a log can't answer.

One aggregate by case gathers all facts that the rules look at; each rule is a plan over those facts or over events,
and all of them give the same columns: rule_id, case_id, at_seq (0-based place in the case), order_assumed, summary,
detail.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import flow_of
from ..policy import Policy
from ..schema import FLOW
from .eventlog import EventLog, by_case

#: Identifiers of the rules, in report order.
TITLES = {
    "CTRL-GR": "nothing is cleared before receipt evidence",
    "CTRL-TOLERANCE": "the invoiced value matches the received value",
    "CTRL-SOD": "nobody does both halves of a conflicting pair",
    "CTRL-BLOCK": "a block is set before it is removed",
    "CTRL-DELETED": "a deleted item has no more financial events",
}
#: Rules that look only at cases of flows that need a receipt.
_BY_FLOW = ("CTRL-GR", "CTRL-TOLERANCE")
NOT_APPLICABLE = "the log holds one value for each case, so received and invoiced values can't be told apart"


def case_facts(log: EventLog, policy: Policy) -> DataFrame:
    """What the rules need to know of each case, in one aggregate."""
    activity, value = F.col("activity"), F.col("value_cents")
    receipt, invoice = activity.isin(list(policy.receipts)), activity == policy.invoice
    first = lambda test: F.min(F.when(test, F.col("pos")))
    when = lambda test: F.min(F.when(test, F.struct("pos", "ts_s")))["ts_s"]
    total = lambda test: F.sum(F.when(test, value))
    nonzero = F.when(value != 0, value)
    facts = log.events.groupBy("case_id").agg(
        first(activity == policy.clear).alias("first_clear"),
        first(receipt).alias("first_receipt"),
        first(activity == policy.delete).alias("first_delete"),
        when(activity == policy.clear).alias("clear_ts"),
        when(receipt).alias("receipt_ts"),
        total(receipt).alias("receipt_cents"),
        total(invoice).alias("invoice_cents"),
        F.count_if(receipt).alias("receipt_events"),
        F.coalesce(F.min(nonzero) < F.max(nonzero), F.lit(False)).alias("distinct_values"),
        F.bool_or("tie_broken").alias("tied"),
    )
    flows = log.cases.select("case_id", flow_of(F.col("attrs"), FLOW).alias("flow"))
    return facts.join(flows, "case_id")


def _in_scope(policy: Policy) -> Column:
    flow = F.col("flow")
    return flow.isin(list(policy.gr_required_flows)) & ~flow.isin(list(policy.invoice_matching_not_applicable_flows))


def _violations(df: DataFrame, rule_id: str, at: Column, assumed: Column, said: Column, detail: dict[str, Column]) -> DataFrame:
    parts = [x for k, v in detail.items() for x in (F.lit(k), v.cast("string"))]
    detail_map = F.create_map(*parts) if parts else F.create_map().cast("map<string,string>")
    return df.select(
        F.lit(rule_id).alias("rule_id"), "case_id", at.cast("int").alias("at_seq"), assumed.alias("order_assumed"), said.alias("summary"),
        detail_map.cast("map<string,string>").alias("detail"),
    )


def precedence(log: EventLog, facts: DataFrame, policy: Policy) -> DataFrame:
    """CTRL-GR: in flows that need a receipt, a clearing without one, or before the first one."""
    late = facts.where(_in_scope(policy) & F.col("first_clear").isNotNull()).where("first_receipt is null or first_receipt > first_clear")
    said = F.when(F.col("first_receipt").isNull(), "cleared without any receipt").otherwise("cleared before the first receipt")
    detail = {
        "flow": F.col("flow"), "clearing_position": F.col("first_clear"), "receipt_position": F.col("first_receipt"),
        "same_minute": F.col("clear_ts") == F.col("receipt_ts"),
    }
    return _violations(late, "CTRL-GR", F.col("first_clear"), F.col("tied"), said, detail)


def _comparable(policy: Policy) -> Column:
    return _in_scope(policy) & F.col("receipt_cents").isNotNull() & F.col("invoice_cents").isNotNull()


def tolerance(log: EventLog, facts: DataFrame, policy: Policy) -> DataFrame:
    """CTRL-TOLERANCE: invoiced above received by more than the looser of two allowances, which isn't rounded."""
    over = F.col("invoice_cents") - F.col("receipt_cents")
    allowed = F.greatest(F.lit(float(policy.tolerance_abs_eur) * 100), F.col("receipt_cents") * F.lit(float(policy.tolerance_pct)) / 100)
    wrong = facts.where(_comparable(policy) & F.col("distinct_values")).where((over > 0) & (over > allowed))
    detail = {
        "receipt_value_eur": F.col("receipt_cents") / 100, "invoice_value_eur": F.col("invoice_cents") / 100, "variance_eur": over / 100,
        "allowance_eur": allowed / 100, "receipt_events": F.col("receipt_events"),
    }
    said = F.concat(F.lit("invoiced "), F.format_number(over / 100, 2), F.lit(" above the received value"))
    return _violations(wrong, "CTRL-TOLERANCE", F.col("first_clear"), F.col("tied"), said, detail)


def duties(log: EventLog, facts: DataFrame, policy: Policy) -> DataFrame:
    """CTRL-SOD: a named resource that did both activities of a pair in a case; one row for each pair and resource."""
    if not policy.duties_enforced or not policy.conflicting_pairs:
        return _violations(facts.where("false"), "CTRL-SOD", F.lit(0), F.lit(False), F.lit(""), {})
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(policy.conflicting_pairs)])
    names = sorted({x for p in policy.conflicting_pairs for x in p})
    did = log.events.where(F.col("activity").isin(names)).groupBy("case_id", "resource", "activity").agg(F.min("pos").alias("pos"))
    each = did.select("*", F.inline(pairs)).where("activity = a or activity = b")
    both = each.groupBy("case_id", "i", "a", "b", "resource").agg(
        F.bool_or(F.col("activity") == F.col("a")).alias("one"), F.bool_or(F.col("activity") == F.col("b")).alias("two")
    )
    # The place is where anybody first did the second activity.
    second = each.where("activity = b").groupBy("case_id", "i").agg(F.min("pos").alias("at"))
    found = both.where("one and two and resource <> ''").join(second, ["case_id", "i"])
    said = F.concat("resource", F.lit(" did both '"), "a", F.lit("' and '"), "b", F.lit("'"))
    return _violations(found, "CTRL-SOD", F.col("at"), F.lit(False), said, {"resource": F.col("resource"), "first": F.col("a"), "second": F.col("b")})


def blocks(log: EventLog, facts: DataFrame, policy: Policy) -> DataFrame:
    """CTRL-BLOCK: each removal of a block that no earlier event of the case has set."""
    earlier = by_case().rowsBetween(W.unboundedPreceding, -1)
    was_set = F.coalesce(F.max((F.col("activity") == policy.set_block).cast("int")).over(earlier), F.lit(0))
    tied = F.max(F.col("tie_broken").cast("int")).over(W.partitionBy("case_id")) == 1
    marked = log.events.select("case_id", "pos", "activity", was_set.alias("was_set"), tied.alias("tied"))
    bad = marked.where((F.col("activity") == policy.remove_block) & (F.col("was_set") == 0))
    return _violations(bad, "CTRL-BLOCK", F.col("pos"), F.col("tied"), F.lit("removed a block that was never set"), {})


def deleted(log: EventLog, facts: DataFrame, policy: Policy) -> DataFrame:
    """CTRL-DELETED: financial events after the first deletion; one row for each case, with five of them at most."""
    money = [policy.clear, policy.invoice, *policy.receipts]
    so_far = F.max((F.col("activity") == policy.delete).cast("int")).over(by_case().rowsBetween(W.unboundedPreceding, -1))
    tied = F.max(F.col("tie_broken").cast("int")).over(W.partitionBy("case_id")) == 1
    after = log.events.select("case_id", "pos", "activity", so_far.alias("gone"), tied.alias("tied")).where(
        (F.col("gone") == 1) & F.col("activity").isin(money)
    )
    nth = after.withColumn("k", F.row_number().over(by_case()))
    got = nth.groupBy("case_id").agg(
        F.min("pos").alias("at"), F.count("*").alias("n"), F.first("tied").alias("tied"),
        F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("pos", "activity"))))["activity"].alias("names"),
    )
    said = F.concat(F.col("n").cast("string"), F.lit(" financial events after the deletion"))
    return _violations(got, "CTRL-DELETED", F.col("at"), F.col("tied"), said, {"after_deletion": F.array_join("names", ", ")})


Rule = Callable[[EventLog, DataFrame, Policy], DataFrame]
#: The registry; more rules may be added, each with the columns of a violation.
RULES: dict[str, Rule] = {
    "CTRL-GR": precedence,
    "CTRL-TOLERANCE": tolerance,
    "CTRL-SOD": duties,
    "CTRL-BLOCK": blocks,
    "CTRL-DELETED": deleted,
}


@dataclass(frozen=True)
class Evaluation:
    """``violations``, ``not_applicable(rule_id, part, first_case, reason)``, and what they were found in."""

    violations: DataFrame
    not_applicable: DataFrame
    log: EventLog
    facts: DataFrame
    policy: Policy
    selected: tuple[str, ...]


def evaluate(log: EventLog, policy: Policy, rule_ids: Iterable[str] | None = None, part: Column | None = None) -> Evaluation:
    """Run rules; an unknown one is an error.

    A rule is off from the first case (in order of id) that it can't be answered for; what it found in earlier cases
    stays among the violations.  ``part``, an expression of ``case_id``, splits the log into parts that are judged one by
    one, so that a rule that is off in one part stays on in the others.
    """
    selected = tuple(RULES) if rule_ids is None else tuple(rule_ids)
    if unknown := [r for r in selected if r not in RULES]:
        raise KeyError(f"no rule {unknown[0]!r}; there are {', '.join(RULES)}")
    facts = case_facts(log, policy)
    own = (F.lit("") if part is None else part).alias("part")
    off = facts.where(_comparable(policy) & ~F.col("distinct_values")).groupBy(own).agg(F.min("case_id").alias("first_case"))
    off = off.select(F.lit("CTRL-TOLERANCE").alias("rule_id"), "part", "first_case", F.lit(NOT_APPLICABLE).alias("reason"))
    if "CTRL-TOLERANCE" not in selected:
        off = off.where("false")
    found = None
    for rule_id in selected:
        one = RULES[rule_id](log, facts, policy)
        if rule_id == "CTRL-TOLERANCE":
            # The other rules never stop.  One row at most where the log is one part; parts may be many.
            stops = off.select("part", "first_case")
            one = one.select("*", own).join(F.broadcast(stops) if part is None else stops, "part", "left")
            one = one.where("first_case is null or case_id < first_case").drop("first_case", "part")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = _violations(facts.where("false"), "", F.lit(0), F.lit(False), F.lit(""), {})
    return Evaluation(found, off, log, facts, policy, selected)


def scoped(log: EventLog, policy: Policy, part: Column) -> DataFrame:
    """``(part, rule_id, in_scope)``: how many cases of each part each rule looks at."""
    needs = flow_of(F.col("attrs"), FLOW).isin(list(policy.gr_required_flows))
    sums = log.cases.groupBy(part.alias("part")).agg(F.count("*").alias("all_cases"), F.count_if(needs).alias("gr_cases"))
    one = lambda r: F.struct(F.lit(r).alias("rule_id"), F.col("gr_cases" if r in _BY_FLOW else "all_cases").alias("in_scope"))
    return sums.select("part", F.inline(F.array(*[one(r) for r in RULES])))


def report(got: Evaluation) -> DataFrame:
    """A row for each rule of the registry: evaluated or why not, violations, cases, scope, rate, examples.

    Rules that weren't selected are marked as not evaluated, never as clean.
    """
    spark = got.log.events.sparkSession
    rules = spark.createDataFrame([(i, r, TITLES.get(r, r), r in got.selected) for i, r in enumerate(RULES)], "place int, rule_id string, title string, selected boolean")
    hits = got.violations.groupBy("rule_id", "case_id").agg(F.count("*").alias("n"), F.bool_or("order_assumed").alias("assumed"))
    sums = hits.groupBy("rule_id").agg(F.sum("n").alias("violations"), F.count("*").alias("cases"), F.count_if("assumed").alias("assumed"))
    # A branch of its own, so that each task passes on three cases of a rule at most.
    nth = hits.select("rule_id", "case_id", F.row_number().over(W.partitionBy("rule_id").orderBy("case_id")).alias("k")).where("k <= 3")
    sums = sums.join(nth.groupBy("rule_id").agg(F.array_sort(F.collect_list("case_id")).alias("examples")), "rule_id", "left")
    scope = got.log.cases.select(flow_of(F.col("attrs"), FLOW).isin(list(got.policy.gr_required_flows)).alias("gr")).agg(
        F.count("*").alias("all_cases"), F.count_if("gr").alias("gr_cases")
    )
    df = rules.join(sums, "rule_id", "left").join(got.not_applicable.select("rule_id", "reason").distinct(), "rule_id", "left").crossJoin(scope)
    ran = F.col("selected") & F.col("reason").isNull()
    in_scope = F.when(F.col("rule_id").isin(*_BY_FLOW), F.col("gr_cases")).otherwise(F.col("all_cases"))
    n = lambda c: F.when(ran, F.coalesce(c, F.lit(0)))
    return df.select(
        "rule_id", "title", ran.alias("evaluated"),
        F.when(~F.col("selected"), "not selected").otherwise(F.coalesce("reason", F.lit(""))).alias("not_evaluated_because"),
        n(F.col("violations")).alias("violations"), n(F.col("cases")).alias("cases"), F.when(ran, in_scope).alias("in_scope_cases"),
        F.when(ran, F.coalesce("cases", F.lit(0)) / F.greatest(in_scope, F.lit(1))).alias("case_rate"),
        n(F.col("assumed")).alias("cases_with_assumed_order"), F.when(ran, F.coalesce("examples", F.array())).alias("examples"),
    )


def flat(violations: DataFrame, keys: Iterable[str] | None = None) -> DataFrame:
    """Violations with details as columns, for files; without ``keys``, all that there are, in order of their names.

    Names of details, which the rules set, are few; they come to the session.
    """
    if keys is None:
        keys = [r.k for r in violations.select(F.explode(F.map_keys("detail")).alias("k")).distinct().orderBy("k").collect()]
    return violations.select("rule_id", "case_id", "at_seq", "order_assumed", "summary", *(F.element_at("detail", F.lit(k)).alias(f"detail_{k}") for k in keys))
