"""Purchase-to-pay controls as columns and joins: matching, tolerances, duties, scope, duplicates and approval ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..policy import Policy


def tolerance_cents(value_cents: Column, policy: Policy) -> Column:
    """The looser of the absolute and the relative allowance, to a whole cent, half to even."""
    relative = value_cents * F.lit(float(policy.tolerance_pct)) / 100
    return F.bround(F.greatest(F.lit(float(policy.tolerance_abs_eur) * 100), relative)).cast("bigint")


def needs_receipt(flow: Column, policy: Policy) -> Column:
    return F.coalesce(flow.isin(list(policy.gr_required_flows)), F.lit(False))


def three_way_match(items: DataFrame, policy: Policy) -> DataFrame:
    """Adds the match of each item: decision, within_tolerance, variance_cents, tolerance_cents, reasons.

    ``items`` has flow, po_value_cents, receipt_value_cents, invoice_value_cents (both null if there is none),
    item_deleted and payment_blocked.  Without a receipt value, or with 0, there is no variance and the allowance comes
    from the order's value.
    """
    needs = needs_receipt(F.col("flow"), policy)
    invoice = F.col("invoice_value_cents")
    baseline = F.when(needs, F.col("receipt_value_cents")).otherwise(F.col("po_value_cents"))
    base = F.when(baseline != 0, baseline)
    df = items.withColumn("tolerance_cents", tolerance_cents(F.coalesce(base, F.col("po_value_cents")), policy))
    df = df.withColumn("variance_cents", F.coalesce(invoice - base, F.lit(0)))
    missing = needs & F.col("receipt_value_cents").isNull()
    over = F.col("variance_cents") > F.col("tolerance_cents")
    decision = (
        F.when(F.col("item_deleted"), "item_deleted").when(invoice.isNull(), "no_invoice").when(missing, "missing_gr").when(over, "price_variance").otherwise("match")
    )
    df = df.withColumn("decision", decision)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("item_deleted"), "deleted"), F.when(invoice.isNull(), "no invoice"), F.when(missing, "no receipt"),
            F.when(F.col("payment_blocked"), "blocked"), F.when(F.col("decision") == "price_variance", "variance"),
        )
    )
    return df.withColumn("within_tolerance", F.col("decision") == "match").withColumn("reasons", reasons)


def match_result(matched: DataFrame) -> DataFrame:
    """Matches for display: euros, and the variance in percent of the receipt (0 where there is none)."""
    receipt = F.col("receipt_value_cents")
    pct = F.coalesce(F.try_divide(F.lit(100.0) * F.col("variance_cents"), F.nullif(receipt, F.lit(0))), F.lit(0.0))
    euros = [(F.col(f"{c}_cents") / 100).alias(f"{c}_eur") for c in ("po_value", "receipt_value", "invoice_value", "variance", "tolerance")]
    return matched.select("item_key", "decision", "within_tolerance", *euros, pct.alias("variance_pct"), "reasons")


def clearing_needs_approval(amount_cents: Column, policy: Policy) -> Column:
    """Strictly above the limit."""
    return amount_cents > round(policy.clearing_auto_approve_limit_eur * 100)


def quantity_within_tolerance(ordered: Column, received: Column, policy: Policy) -> Column:
    """At most so many percent more than ordered; an order of nothing never is."""
    over = F.try_divide(100.0 * (received - ordered), ordered)
    return F.coalesce((ordered > 0) & (over <= policy.gr_quantity_tolerance_pct), F.lit(False))


def due_date(invoiced: Column, policy: Policy) -> Column:
    return F.date_add(invoiced, policy.payment_terms_days)


def discount_deadline(invoiced: Column, policy: Policy) -> Column:
    return F.date_add(invoiced, policy.early_payment_discount_days)


def clearing_limit_cents(role: Column, policy: Policy) -> Column:
    """The automatic limit, or for a role with an approval limit above it, that one."""
    limit = F.lit(round(policy.clearing_auto_approve_limit_eur * 100))
    for name, eur in policy.approval_limits_eur.items():
        limit = F.when((role == name) & F.lit(eur > policy.clearing_auto_approve_limit_eur), round(eur * 100)).otherwise(limit)
    return limit


def can_view_item(role: Column, own_group: Column, group: Column, own_company: Column, company: Column) -> Column:
    """Controllers see everything, buyers their group, clerks and requisitioners their company."""
    seen = F.when(role == "controller", True).when(role == "buyer", own_group == group).when(role.isin("ap_clerk", "requisitioner"), own_company == company)
    return F.coalesce(seen, F.lit(False))


#: The roles that may do an action, within what they see; a decision on an approval needs no item.
ACTIONS = {"record_goods_receipt": ("buyer",), "record_invoice": ("ap_clerk",), "clear_invoice": ("ap_clerk",), "change_payment_block": ("ap_clerk",), "decide_approval": ("controller",)}


def can_act(action: str, role: Column, sees: Column) -> Column:
    """Whether a role may do an action on an item that it sees."""
    permitted = F.coalesce(role.isin(list(ACTIONS[action])), F.lit(False))
    return permitted if action == "decide_approval" else permitted & sees


def valid_receipts(receipts: DataFrame) -> DataFrame:
    """Total of each item's receipts that aren't cancelled; items without any have no row."""
    return receipts.where("cancelled_at is null").groupBy("item_key").agg(F.sum("value_cents").alias("receipt_value_cents"))


def first_invoice(invoices: DataFrame, open_only: bool = True) -> DataFrame:
    """Each item's first invoice that is open or queued, or else that isn't cancelled."""
    wanted = F.col("status").isin("open", "queued_for_approval") if open_only else F.col("status") != "cancelled"
    rest = [c for c in invoices.columns if c != "item_key"]
    got = invoices.where(wanted).groupBy("item_key").agg(F.min_by(F.struct(*rest), F.struct("recorded_at", "invoice_id")).alias("r"))
    return got.select("item_key", "r.*")


def public_items(items: DataFrame, columns: list[str]) -> DataFrame:
    """Only what may be shown: the named columns, amounts in euros (null where there is none), and flags for dates."""
    euros = [(F.col(f"{c}_cents") / 100).alias(f"{c}_eur") for c in ("po_value", "receipt_value", "invoice_value")]
    flags = [F.col(f"{c}_at").isNotNull().alias(c) for c in ("released", "deleted")]
    return items.select(*columns, *euros, F.coalesce("payment_blocked", F.lit(False)).alias("payment_blocked"), *flags)


def siblings(items: DataFrame, order: str, key: str) -> DataFrame:
    """How many other items an item's order has, and the first of them; no pairs are made."""
    own = items.select(order, key).distinct()
    nth = F.row_number().over(W.partitionBy(order).orderBy(key))
    two = own.withColumn("k", nth).where("k <= 2").groupBy(order).agg(*[F.max(F.when(F.col("k") == k, F.col(key))).alias(f"k{k}") for k in (1, 2)])
    per = own.groupBy(order).agg((F.count("*") - 1).alias("siblings")).join(two, order)
    first = F.when(F.col(key) == F.col("k1"), F.col("k2")).otherwise(F.col("k1"))
    return own.join(per, order).select(order, key, "siblings", first.alias("first_sibling"))


def is_allowed(tool: Column, level: Column, paused: dict[str, list[str]]) -> Column:
    """Whether a kill switch's level leaves a tool on."""
    levels = F.create_map(*[x for k, v in paused.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return ~F.coalesce(F.array_contains(F.element_at(levels, level), tool), F.lit(False))


def duplicate_invoices(invoices: DataFrame, policy: Policy) -> DataFrame:
    """Invoices with an earlier-numbered one of the same vendor, nearly the same value, within the window of days.

    A band join: values are binned by the tolerance and days by the window, and each invoice looks into its own bin and
    the neighbouring ones, so the join is an equality join whatever the size of a vendor.  ``invoices`` has invoice_id, vendor_id,
    value_cents and invoice_date.
    """
    slack, window = round(policy.duplicate_invoice_value_tolerance_eur * 100), policy.duplicate_invoice_window_days
    width = max(1, slack)
    df = invoices.select("invoice_id", "vendor_id", "value_cents", "invoice_date", F.unix_date("invoice_date").alias("day"))
    df = df.withColumn("vb", F.floor(F.col("value_cents") / width)).withColumn("db", F.floor(F.col("day") / max(1, window)))
    near = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    mine = df.select("*", F.explode(near).alias("dv")).select("*", F.explode(near).alias("dd"))
    mine = mine.select(
        "vendor_id", (F.col("vb") + F.col("dv")).alias("vb"), (F.col("db") + F.col("dd")).alias("db"),
        F.col("invoice_id").alias("a"), F.col("value_cents").alias("av"), F.col("day").alias("ad"),
    )
    close = (F.abs(F.col("av") - F.col("value_cents")) <= slack) & (F.abs(F.col("ad") - F.col("day")) <= window)
    found = mine.join(df, ["vendor_id", "vb", "db"]).where(close & (F.col("invoice_id") < F.col("a")))
    return found.select(F.col("a").alias("invoice_id"), F.col("invoice_id").alias("duplicate_of"), "vendor_id")


def first_duplicates(invoices: DataFrame, policy: Policy) -> DataFrame:
    """``(invoice_id, vendor_id, duplicate_of)``: each invoice that nearly equals an earlier-numbered one, once, with the least such number.

    Invoices of one vendor, value and day are one row first.  Values of a bin are all near each other, so a window over
    days gives the least number in a bin without a join; neighbouring bins are joined by bins of days with an exact
    check, and only the least number of each row goes on.
    """
    slack, days = round(policy.duplicate_invoice_value_tolerance_eur * 100), policy.duplicate_invoice_window_days
    width = slack + 1
    df = invoices.select("invoice_id", "vendor_id", "value_cents", F.unix_date("invoice_date").alias("day")).where("value_cents is not null and day is not null")
    groups = df.groupBy("vendor_id", "value_cents", "day").agg(F.min("invoice_id").alias("least"))
    groups = groups.withColumn("vb", F.floor(F.col("value_cents") / width)).withColumn("db", F.floor(F.col("day") / (days + 1)))
    swept = F.min("least").over(W.partitionBy("vendor_id", "vb").orderBy("day").rangeBetween(-days, days))
    inside = groups.select("vendor_id", "value_cents", "day", swept.alias("first"))

    side = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    asks = groups.select("vendor_id", "value_cents", "day", "vb", "db", side((-1, 1)).alias("dv")).select("*", side((-1, 0, 1)).alias("dd"))
    asks = asks.select("vendor_id", "value_cents", "day", (F.col("vb") + F.col("dv")).alias("vb"), (F.col("db") + F.col("dd")).alias("db"))
    others = groups.select("vendor_id", "vb", "db", F.col("value_cents").alias("v"), F.col("day").alias("d"), "least")
    near = (F.abs(F.col("v") - F.col("value_cents")) <= slack) & (F.abs(F.col("d") - F.col("day")) <= days)
    beside = asks.join(others, ["vendor_id", "vb", "db"]).where(near).select("vendor_id", "value_cents", "day", F.col("least").alias("first"))
    first = inside.unionByName(beside).groupBy("vendor_id", "value_cents", "day").agg(F.min("first").alias("duplicate_of"))
    return df.join(first, ["vendor_id", "value_cents", "day"]).where("duplicate_of < invoice_id").select("invoice_id", "vendor_id", "duplicate_of")


def duty_conflicts(attempts: DataFrame, history: DataFrame, policy: Policy) -> DataFrame:
    """Attempts (item_key, actor_id, activity) whose actor already did the other half of a pair on the item."""
    pairs = [(a, b) for p in policy.conflicting_pairs for a, b in (p, p[::-1])] if policy.duties_enforced else []
    spark = attempts.sparkSession
    table = spark.createDataFrame(sorted(set(pairs)), "activity string, other string")
    past = history.select("item_key", "actor_id", F.col("activity").alias("other")).distinct()
    return attempts.join(F.broadcast(table), "activity").join(past, ["item_key", "actor_id", "other"], "left_semi").select(*attempts.columns).distinct()


def clearing_ladder(df: DataFrame, policy: Policy) -> DataFrame:
    """What a clearing would come to, by nine checks in order; the first six refuse, the others queue.

    ``df`` has paused, permitted, item_deleted, invoice_value_cents (null: none open), already_queued,
    payment_blocked, the columns of ``three_way_match``, sod_conflict and limit_cents.
    """
    ladder = (
        F.when(F.col("paused"), "refused:paused")
        .when(~F.col("permitted"), "refused:permission_denied")
        .when(F.col("item_deleted"), "refused:deleted")
        .when(F.col("invoice_value_cents").isNull() | F.col("already_queued"), "refused:no_open_invoice")
        .when(F.col("payment_blocked"), "refused:blocked")
        .when(F.col("decision") == "missing_gr", "refused:missing_receipt")
        .when(~F.col("within_tolerance"), "queued:tolerance_override")
        .when(F.col("sod_conflict"), "queued:sod_conflict")
        .when(F.col("invoice_value_cents") > F.col("limit_cents"), "queued:above_limit")
        .otherwise("cleared")
    )
    return df.withColumn("outcome", ladder)


def receipt_ladder(df: DataFrame, policy: Policy) -> DataFrame:
    """What recording a receipt would come to.  ``df`` has paused, permitted, item_deleted, flow, sod_conflict, ordered and received."""
    ladder = (
        F.when(F.col("paused"), "refused:paused")
        .when(~F.col("permitted"), "refused:permission_denied")
        .when(F.col("item_deleted"), "refused:deleted")
        .when(F.col("sod_conflict"), "refused:sod_conflict")
        .when(~quantity_within_tolerance(F.col("ordered"), F.col("received"), policy), "refused:quantity")
        .otherwise("recorded")
    )
    return df.withColumn("outcome", ladder)


def with_context(items: DataFrame, orders: DataFrame, order_key: str, vendors: DataFrame, vendor_key: str) -> DataFrame:
    """Items with their order and vendor: an item without its order is left out, one without its vendor has nulls."""
    return items.join(orders, order_key).join(vendors, vendor_key, "left")
