"""Hand-built logs with known answers, traps of order and ties, round trips, empty logs and plan shapes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from procspark import cli
from procspark.operators import checks, controls, dfg, filters, rules, spans, variants
from procspark.operators.eventlog import EventLog, by_case, canonical, merge_case_attributes
from procspark.policy import Policy
from procspark.sources import csv, jsonl, otlp, store, viz, xes

PLAIN = ["Create", "Record Goods Receipt", "Record Invoice Receipt", "Clear Invoice"]
CASES = {
    "c1": PLAIN,
    "c2": ["Create", "Clear Invoice", "Record Goods Receipt", "Record Invoice Receipt"],
    "c3": PLAIN,
    "c4": ["Create", "Record Goods Receipt", "Remove Payment Block", "Record Invoice Receipt", "Clear Invoice"],
    "c5": ["Create", "Record Invoice Receipt", "Clear Invoice"],
}
POLICY = Policy(gr_required_flows=("3-way",), invoice_matching_not_applicable_flows=("Consignment",), conflicting_pairs=(("Record Goods Receipt", "Clear Invoice"),))
RANKS = {"Record Goods Receipt": 100, "Clear Invoice": 130}
RAW = "case_id string, activity string, ts timestamp, resource string, value_cents long, arrival long"


def raw_of(spark, cases, values=None, flow=None):
    rows = []
    for c, acts in cases.items():
        for i, a in enumerate(acts):
            who = "user_9" if c == "c3" else f"user_{i}"
            rows.append((c, a, dt.datetime(2024, 1, 1 + i, 3), who, values[c][i] if values else 100, i))
    return spark.createDataFrame(rows, RAW)


def attributes(spark, cases, flow=None):
    rows = [(c, {"Item Category": flow or ("2-way" if c == "c5" else "3-way"), "GR": "True", "Item": "00012"}) for c in cases]
    return spark.createDataFrame(rows, "case_id string, attrs map<string,string>")


@pytest.fixture(scope="module")
def log(spark):
    return EventLog.build(raw_of(spark, CASES), RANKS, attributes(spark, CASES), log_id="L", source="made by hand")


def one(df):
    return df.first().asDict()


def test_summary_counts_the_empty_resource(log):
    s = one(log.summary())
    assert (s["cases"], s["events"], s["activities"], s["variants"], s["tie_broken_events"]) == (5, 20, 5, 4, 0)
    assert s["resources"] == s["named_resources"] + 1


def test_edges_starts_ends(log):
    g = dfg.build(log)
    n = {(r.src, r.dst): r.n for r in g.edges.collect()}
    assert n["Create", "Record Goods Receipt"] == 3 and n["Record Invoice Receipt", "Clear Invoice"] == 4
    assert {r.activity: r.n for r in g.starts.collect()} == {"Create": 5}
    assert {r.activity: r.n for r in g.ends.collect()} == {"Clear Invoice": 4, "Record Invoice Receipt": 1}
    assert g.filter_edges(keep_fraction=0.0).edges.count() == 0 and g.filter_edges(keep_fraction=1.0).edges.count() == len(n)


def test_rules_find_what_each_case_was_built_for(log):
    got = rules.evaluate(log, POLICY)
    found = {(r.rule_id, r.case_id): r.at_seq for r in got.violations.collect()}
    assert found == {("CTRL-GR", "c2"): 1, ("CTRL-SOD", "c3"): 3, ("CTRL-BLOCK", "c4"): 2}
    table = {r.rule_id: r for r in rules.report(got).collect()}
    assert not table["CTRL-TOLERANCE"].evaluated and table["CTRL-TOLERANCE"].violations is None
    assert table["CTRL-GR"].in_scope_cases == 4 and table["CTRL-SOD"].in_scope_cases == 5


def test_unselected_rules_are_not_clean_and_unknown_ones_are_errors(log):
    table = {r.rule_id: r for r in rules.report(rules.evaluate(log, POLICY, ["CTRL-GR"])).collect()}
    assert table["CTRL-GR"].evaluated and table["CTRL-SOD"].not_evaluated_because == "not selected"
    with pytest.raises(KeyError):
        rules.evaluate(log, POLICY, ["CTRL-NONE"])


def test_tolerance_and_partial_receipts(spark):
    values = {"a": [0, 400_000, 412_000, 412_000], "b": [0, 200_000, 200_000, 400_000, 400_000]}
    cases = {"a": PLAIN, "b": ["Create", "Record Goods Receipt", "Record Goods Receipt", "Record Invoice Receipt", "Clear Invoice"]}
    log = EventLog.build(raw_of(spark, cases, values), RANKS, attributes(spark, cases, "3-way"))
    v = rules.evaluate(log, POLICY, ["CTRL-TOLERANCE"]).violations.collect()
    assert [(r.case_id, float(r.detail["variance_eur"]), float(r.detail["allowance_eur"])) for r in v] == [("a", 120.0, 80.0)]
    consigned = EventLog.build(raw_of(spark, cases, values), RANKS, attributes(spark, cases, "Consignment"))
    assert rules.evaluate(consigned, POLICY, ["CTRL-GR", "CTRL-TOLERANCE"]).violations.count() == 0


def test_not_applicable_turns_a_rule_off_from_that_case_on(spark):
    values = {c: [0, 400_000, 500_000, 500_000] for c in "ac"} | {"b": [7, 7, 7, 7]}
    cases = dict.fromkeys("abc", PLAIN)
    log = EventLog.build(raw_of(spark, cases, values), RANKS, attributes(spark, cases, "3-way"))
    got = rules.evaluate(log, POLICY, ["CTRL-TOLERANCE"])
    assert [r.case_id for r in got.violations.collect()] == ["a"] and got.not_applicable.first().first_case == "b"


def test_rank_decides_ties_hints_prevent_them(spark):
    when = dt.datetime(2024, 1, 1)
    rows = [("x", "Clear Invoice", when, "u", 1, 0), ("x", "Record Goods Receipt", when, "u", 1, 1), ("x", "Unranked", when, "u", 1, 2)]
    df = spark.createDataFrame(rows, RAW)
    got = canonical(df, RANKS).orderBy("pos").collect()
    assert [r.activity for r in got] == ["Unranked", "Record Goods Receipt", "Clear Invoice"]
    assert [r.tie_broken for r in got] == [False, True, True]
    hinted = canonical(df.withColumn("sort_hint", F.col("arrival")), RANKS).orderBy("pos").collect()
    assert [r.activity for r in hinted] == ["Clear Invoice", "Record Goods Receipt", "Unranked"] and not any(r.tie_broken for r in hinted)


def test_times_before_1970_are_cut_toward_zero(spark):
    df = spark.sql("select 'x' as case_id, 'a' as activity, timestamp_millis(-1500) as ts")
    assert canonical(df).first().ts_s == -1


def test_sensitivity_counts_only_ties_between_different_activities(spark):
    when = dt.datetime(2024, 1, 1)
    same = spark.createDataFrame([("x", "a", when, "u", 1, i) for i in range(3)], RAW)
    s = one(variants.order_sensitivity(same, {"a": 1}))
    assert (s["tie_broken_events"], s["consequential_ties"], s["cases_whose_sequence_changed"]) == (2, 0, 0)
    mixed = spark.createDataFrame([("x", "Clear Invoice", when, "u", 1, 0), ("x", "Record Goods Receipt", when, "u", 1, 1)], RAW)
    s = one(variants.order_sensitivity(mixed, RANKS))
    assert (s["consequential_ties"], s["cases_whose_sequence_changed"]) == (1, 1)


def test_last_attribute_wins(spark):
    rows = [("x", 1, {"k": "old", "j": "1"}), ("x", 2, {"k": "new"}), ("x", 3, {})]
    df = spark.createDataFrame(rows, "case_id string, arrival long, attrs map<string,string>")
    assert merge_case_attributes(df).first().attrs == {"k": "new", "j": "1"}


def test_upper_median_and_first_seen_ties(spark):
    rows = [(f"c{i}", a, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * j), "u", 1, j) for i in range(1, 5) for j, a in enumerate("ab")]
    table = variants.variant_table(EventLog.build(spark.createDataFrame(rows, RAW))).collect()
    assert table[0].median_s == 3 and table[0].examples == ["c1", "c2", "c3"]
    rows = [("b", "y", dt.datetime(2024, 1, 1), "u", 1, 0), ("a", "z", dt.datetime(2024, 1, 1), "u", 1, 0)]
    table = variants.variant_table(EventLog.build(spark.createDataFrame(rows, RAW))).orderBy("variant_rank").collect()
    assert [r.variant for r in table] == [["z"], ["y"]]


def test_filters(log):
    ids = lambda x: sorted(r.case_id for r in x.cases.collect())
    assert ids(filters.by_flow(log, "2-way")) == ["c5"] and ids(filters.by_case_attribute(log, "GR", True)) == sorted(CASES)
    assert ids(filters.by_case_attribute(log, "nothing", "")) == sorted(CASES)
    assert ids(filters.by_variant_coverage(log, 0.3)) == ["c1", "c3"] and ids(filters.by_variant_coverage(log, 0)) == []
    assert ids(filters.containing_activity(log, "Remove Payment Block", "none")) == ["c4"] and ids(filters.containing_activity(log, "none")) == []
    assert ids(filters.excluding_activity(log, "Remove Payment Block")) == ["c1", "c2", "c3", "c5"]
    assert ids(filters.by_case_length(log, 5)) == ["c4"] and ids(filters.where(log, "events[1].activity = 'Clear Invoice'")) == ["c2"]
    start = log.cases.agg(F.min("start_ts")).first()[0]
    assert ids(filters.by_timeframe(log, start, start + 2 * 86400)) == ["c5"] and len(ids(filters.by_timeframe(log, start, start, "started"))) == 5
    with pytest.raises(ValueError):
        filters.by_timeframe(log, 0, 1, "never")
    with pytest.raises(KeyError):
        log.select(["c1", "none"])
    assert log.select(["c2", "c2"]).events.count() == 4 and log.trace("c4").count() == 5


def test_empty_logs_answer_empty(spark):
    log = EventLog.empty(spark)
    g = dfg.build(log)
    assert g.edges.count() == 0 and g.quantiles([0.5]).count() == 0 and one(log.summary())["events"] == 0
    assert variants.variant_table(log).count() == 0 and one(variants.rework_ratio(log))["rework_ratio"] == 0
    assert one(variants.self_loop_ratio(log))["self_loop_ratio"] == 0 and one(variants.summary(log))["cases"] == 0
    assert [r.variants for r in variants.coverage_curve(log).collect()] == [0] * 5
    got = rules.evaluate(log, POLICY)
    assert got.violations.count() == 0 and got.not_applicable.count() == 0
    assert filters.by_variant_coverage(log, 0.9).cases.count() == 0 and checks.stratified_sample(log, 5).cases.count() == 0
    assert dfg.diff(g, g).count() == 0 and viz.dot(g).startswith("digraph")


def test_duty_names_the_first_second_activity_of_anybody(spark):
    rows = [("x", "Clear Invoice", 1, "other"), ("x", "Record Goods Receipt", 2, "me"), ("x", "Clear Invoice", 3, "me"), ("x", "Clear Invoice", 4, "")]
    df = spark.createDataFrame(rows, "case_id string, activity string, ts_s long, resource string")
    v = rules.evaluate(EventLog.build(df), POLICY, ["CTRL-SOD"]).violations.collect()
    assert [(r.at_seq, r.detail["resource"], r.order_assumed) for r in v] == [(0, "me", False)]


def test_deleted(spark):
    names = ["Create", "Delete Purchase Order Item", *["Clear Invoice"] * 7]
    df = spark.createDataFrame([("x", a, i) for i, a in enumerate(names)], "case_id string, activity string, ts_s long")
    v = rules.evaluate(EventLog.build(df), POLICY, ["CTRL-DELETED"]).violations.first()
    assert v.at_seq == 2 and len(v.detail["after_deletion"].split(", ")) == 5 and v.summary.startswith("7 ")


def test_round_trips(spark, log, tmp_path):
    what = ("case_id", "pos", "activity", "ts_s", "resource", "value_cents", "tie_broken")
    mine = sorted(log.events.select(*what).collect())
    attrs = {r.case_id: r.attrs for r in log.cases.collect()}
    same = lambda other: sorted(other.events.select(*what).collect()) == mine and {r.case_id: r.attrs for r in other.cases.collect()} == attrs
    facts = csv.write_tables(log, str(tmp_path / "csv"))
    assert facts["dtypes"] == {"GR": "bool", "Item": "str", "Item Category": "str"} and facts["events"] == 20
    back = EventLog.build(csv.read_events(spark, str(tmp_path / "csv/events")), None, csv.read_case_attributes(spark, str(tmp_path / "csv/cases")))
    assert same(back)
    otlp.write(log, str(tmp_path / "otlp"), batch_spans=3)
    assert same(otlp.read(spark, str(tmp_path / "otlp"))) and otlp.verify(spark, str(tmp_path / "otlp"), log).count() == 0
    store.save(log, str(tmp_path / "store"))
    loaded = store.load(spark, str(tmp_path / "store"), "L")
    assert same(loaded) and [r.seq for r in loaded.events.orderBy("seq").collect()] == list(range(20))
    with pytest.raises(KeyError, match="there are: L"):
        store.load(spark, str(tmp_path / "store"), "none")
    xes.write(log, str(tmp_path / "xes"), value=xes.VALUE)
    raw, cases = xes.read(spark, str(tmp_path / "xes"))
    assert sorted(EventLog.build(raw, RANKS).events.select(*what).collect()) == mine
    got = cases.first().attrs
    assert got["GR"] == "True" and got["Item"] == "00012"
    for name in ("a", "b"):
        otlp.write_single(log, str(tmp_path / name))
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()


def test_verify_names_a_planted_fault(spark, log, tmp_path):
    otlp.write(log, str(tmp_path / "o"))
    text = spark.read.text(str(tmp_path / "o"))
    text.select(F.regexp_replace("value", '"name":"Create"', '"name":"Crate"')).write.text(str(tmp_path / "bad"))
    assert "name is not the activity" in {r.problem for r in otlp.verify(spark, str(tmp_path / "bad"), log).collect()}
    text.select(F.regexp_replace("value", '"mb.value_cents","value":\\{"intValue":"100"\\}', '"mb.value_cents","value":{"intValue":"101"}')).write.text(str(tmp_path / "worse"))
    assert "values differ" in {r.problem for r in otlp.verify(spark, str(tmp_path / "worse"), log).collect()}
    otlp.write(filters.by_flow(log, "2-way"), str(tmp_path / "part"))
    assert any(r.problem.startswith("not evaluated") for r in otlp.verify(spark, str(tmp_path / "part"), log).collect())


def test_xes_reads_what_it_should(spark, tmp_path):
    text = """<log><global scope="event"><string key="concept:name" value="no"/></global>
<trace><string key="concept:name" value="one"/><boolean key="b" value="true"/><int key="i" value="x1"/>
<event><string key="concept:name" value="A &amp; B"/><date key="time:timestamp" value="2020-01-01T00:00:00Z"/><float key="Cumulative net worth (EUR)" value="0.125"/></event>
<event><string key="concept:name" value="no time"/></event></trace>
<trace><event><date key="time:timestamp" value="2020-01-01T10:30:00+02:00"/></event></trace></log>"""
    (tmp_path / "a.xes").write_text(text)
    raw, cases = xes.read(spark, str(tmp_path / "a.xes"))
    got = sorted(EventLog.build(raw).events.select("case_id", "activity", "ts_s", "value_cents", "precision").collect())
    assert [tuple(r) for r in got] == [("case-2", "UNKNOWN", 1577867400, 0, "second"), ("one", "A & B", 1577836800, 12, "day")]
    assert {r.case_id: r.attrs for r in cases.collect()}["one"] == {"concept:name": "one", "b": "True", "i": "x1"}


def test_csv_values_and_times(spark, tmp_path):
    rows = ["case_id,activity,timestamp,resource,value_cents,attributes", ' a , X ,2024-01-02T03:04:05Z, r ,12.9,"{""k"":""v""}"', "a,Y,2024-01-02,,bad,not json", "b,Z,03.02.2024 01:02:03,q,,"]
    (tmp_path / "e.csv").write_text("\n".join(rows) + "\n")
    got = sorted(EventLog.build(csv.read_events(spark, str(tmp_path / "e.csv"), layouts=("dd.MM.yyyy HH:mm:ss",))).events.select("case_id", "activity", "resource", "value_cents", "precision", "attrs").collect())
    assert [(r.activity, r.resource, r.value_cents, r.precision, r.attrs) for r in got] == [
        ("X", " r ", 12, "second", {"k": "v"}), ("Y", "", 0, "day", {"raw": "not json"}), ("Z", "q", 0, "second", {}),
    ]
    (tmp_path / "bad.csv").write_text("case_id,activity,timestamp\na,X,when\n")
    with pytest.raises(Exception, match="can't read the time when"):
        csv.read_events(spark, str(tmp_path / "bad.csv")).collect()


def test_xes_of_many_splits(spark, tmp_path):
    """Unnamed traces are numbered through all splits and files, and the first cases are the first ones."""
    folder = tmp_path / "x"
    folder.mkdir()
    for f in range(2):
        traces = [f'<trace><event><string key="concept:name" value="A{f}_{i}"/><date key="time:timestamp" value="2020-01-01T00:00:00Z"/></event></trace>' for i in range(60)]
        (folder / f"{f}.xes").write_text("<log>" + "".join(traces) + "</log>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        raw, cases = xes.read(spark, str(folder))
        assert spark.read.text(str(folder), lineSep="</trace>").rdd.getNumPartitions() > 4
        want = {f"case-{f * 60 + i + 1}": f"A{f}_{i}" for f in range(2) for i in range(60)}
        assert {r.case_id: r.activity for r in raw.collect()} == want
        assert {r.ordinal for r in cases.collect()} == set(range(120))
        few, _ = xes.read(spark, str(folder), max_cases=7)
        assert {r.case_id for r in few.collect()} == {f"case-{i + 1}" for i in range(7)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_xes_header_and_documents(spark, log, tmp_path):
    import xml.etree.ElementTree as ET
    from dataclasses import replace as with_

    quoted = with_(log, source='a "b" & c <d>')
    xes.write(quoted, str(tmp_path / "x"), value=xes.VALUE)
    xes.write(quoted, str(tmp_path / "one"), value=xes.VALUE, single=True)
    xes.write(EventLog.empty(spark), str(tmp_path / "none"))
    for name, files in (("x", None), ("one", 1), ("none", 1)):
        parts = sorted((tmp_path / name).glob("part-*"))
        docs = [ET.fromstring(p.read_text()) for p in parts if p.stat().st_size]
        assert docs and (files is None or len(docs) == files)
        if name != "none":
            assert {s.get("value") for d in docs for s in d.iter("{http://www.xes-standard.org/}string") if s.get("key") == "procspark:source"} == {'a "b" & c <d>'}
            assert sum(len(d.findall("{http://www.xes-standard.org/}trace")) for d in docs) == len(CASES)


def test_otlp_broken_line_is_an_error(spark, log, tmp_path):
    otlp.write(log, str(tmp_path / "o"))
    (tmp_path / "o" / "zz.txt").write_text('{"resourceSpans": [broken\n')
    with pytest.raises(Exception, match="not a request line"):
        otlp.read_spans(spark, str(tmp_path / "o")).collect()


def test_save_leaves_old_log_when_it_fails(spark, log, tmp_path):
    path = str(tmp_path / "st")
    store.save(log, path)
    broken = log.events.withColumn("activity", F.when(F.col("case_id") == "c5", F.raise_error("no").cast("string")).otherwise(F.col("activity")))
    from dataclasses import replace as with_

    with pytest.raises(Exception, match="no"):
        store.save(with_(log, events=broken), path)
    assert store.load(spark, path, log.log_id).events.count() == log.events.count()
    store.save(filters.by_flow(log, "2-way"), path)
    assert store.load(spark, path, log.log_id).events.select("case_id").distinct().count() == 1


def test_ranks_have_no_window_over_all_variants(spark, log):
    """Variants are ordered within a count and a range; only distinct counts are in one window."""
    import re

    for df in (variants.variant_table(log), variants.cases_covering(log, 0.5), variants.coverage_curve(log)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        whole = re.findall(r"windowspecdefinition\(([a-z_]+)#\d+L? (?:ASC|DESC)", plan)
        assert set(whole) <= {"n"}, whole


def test_streams(spark, tmp_path):
    """Files that arrive: cases that have been quiet are emitted in canonical order; counts by window add up."""
    from procspark.schema import RAW as COLUMNS
    from procspark.operators.eventlog import raw_events
    from procspark.streaming import incremental

    incremental.use_rocksdb(spark)
    raw = raw_events(raw_of(spark, CASES)).select([f.name for f in COLUMNS.fields])
    later = raw.limit(1).withColumns({"case_id": F.lit("late"), "ts_s": F.lit(2_000_000_000).cast("bigint")})
    for i, df in enumerate((raw, later, later.withColumn("ts_s", F.col("ts_s") + 10**6))):
        df.select([f.name for f in COLUMNS.fields]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = lambda: incremental.read_arriving(spark, str(tmp_path / "in"), 1)
    for name, df, mode in (("cases", incremental.canonical_stream(arriving(), RANKS), "append"), ("counts", incremental.windowed_activity(arriving(), "1 day"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = {(r.case_id, r.pos, r.activity, r.ts_s, r.tie_broken) for r in spark.table("cases").where("case_id <> 'late'").collect()}
    want = {(r.case_id, r.pos, r.activity, r.ts_s, r.tie_broken) for r in canonical(raw, RANKS).collect()}
    assert got == want
    counts = {r.activity: r.n for r in spark.table("counts").groupBy("activity").agg(F.sum("n").alias("n")).collect()}
    assert sum(counts.values()) == raw.count() + 2


def test_edges_follow_late_events(spark, data, tmp_path):
    """Shuffled and repeated files give the graph of a batch over all of them, at every step of the stream."""
    from procspark.operators.eventlog import raw_events
    from procspark.plans import views
    from procspark.schema import RAW as COLUMNS
    from procspark.streaming import incremental

    incremental.use_rocksdb(spark)
    raw = raw_events(views.events_raw(spark, data)).select([f.name for f in COLUMNS.fields]).where(F.xxhash64("case_id") % 4 == 0)
    parts = raw.withColumn("part", F.pmod(F.xxhash64("arrival"), F.lit(3))).cache()
    progress = incremental.Progress()
    spark.streams.addListener(progress)
    total = None
    try:
        for step in (2, 0, 1, 0):
            more = parts.where(F.col("part") == step).drop("part")
            more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            total = more if total is None else total.unionByName(more)
            changes = incremental.edge_changes(incremental.read_arriving(spark, str(tmp_path / "in")), views.RANKS, "1000 days")
            q = changes.writeStream.format("parquet").option("path", str(tmp_path / "out")).queryName("edges").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None
            got = {(r.src, r.dst): r.n for r in incremental.live_edges(spark.read.parquet(str(tmp_path / "out"))).collect()}
            batch = canonical(total, views.RANKS)
            nxt = batch.withColumn("dst", F.lead("activity").over(by_case())).where("dst is not null").groupBy("activity", "dst").count()
            assert got == {(r.activity, r.dst): r["count"] for r in nxt.collect()}
        taken = spark.read.parquet(str(tmp_path / "out")).where("delta < 0").count()
        assert taken > 0
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert sum(b["rows"] for b in progress.batches) == total.count() and not progress.failed
    finally:
        spark.streams.removeListener(progress)
        parts.unpersist()


def test_typed_helpers(spark):
    from procspark.functions import expr

    kinds = spark.createDataFrame([("agent:x",), ("tool:y",), ("user_1",), (None,)], "r string").select(expr.agent_resource_kind(F.col("r")).alias("k"))
    assert [r.k for r in kinds.collect()][:3] == ["agent", "tool", "human"]
    df = spark.createDataFrame([("A", True, ""), ("A", True, "queued_for_approval"), ("A", False, "")], "a string, ok boolean, s string")
    assert [r.x for r in df.select(spans.recorded_activity(F.col("a"), F.col("ok"), F.col("s")).alias("x")).collect()] == ["A", None, None]
    df = spark.createDataFrame([("permission_denied",), ("paused",), (None,)], "e string").select(spans.permission_denied(F.col("e")).alias("x"))
    assert [r.x for r in df.collect()] == [True, False, False]
    assert csv.case_column(["x", "CaseID"]) == "CaseID"
    with pytest.raises(KeyError):
        csv.case_column(["x"])


def test_jsonl_names_the_bad_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnonsense\n')
    with pytest.raises(Exception, match="nonsense"):
        jsonl.read(spark, str(tmp_path / "x.jsonl"), "a long").collect()


def test_three_way_match_limits(spark):
    rows = [("ok", "3-way", 100_000, 100_000, 105_000, False), ("over", "3-way", 100_000, 100_000, 105_001, False), ("none", "3-way", 1, None, 5, False),
            ("noinv", "3-way", 1, 1, None, False), ("gone", "3-way", 1, 1, 1, True), ("zero", "3-way", 500_000, 0, 900_000, False), ("po", "2-way", 100_000, None, 100_000, False)]
    df = spark.createDataFrame(rows, "item_key string, flow string, po_value_cents long, receipt_value_cents long, invoice_value_cents long, item_deleted boolean").withColumn("payment_blocked", F.lit(False))
    got = {r.item_key: r for r in controls.three_way_match(df, POLICY).collect()}
    assert {k: r.decision for k, r in got.items()} == {
        "ok": "match", "over": "price_variance", "none": "missing_gr", "noinv": "no_invoice", "gone": "item_deleted", "zero": "match", "po": "match",
    }
    assert got["zero"].variance_cents == 0 and got["zero"].tolerance_cents == 10_000


def test_duplicate_invoices_at_bin_edges(spark):
    rows = [(1, "v", 100, dt.date(2024, 1, 1)), (2, "v", 200, dt.date(2024, 3, 31)), (3, "v", 201, dt.date(2024, 1, 1)), (4, "w", 100, dt.date(2024, 1, 1)), (5, "v", 100, dt.date(2024, 3, 31))]
    df = spark.createDataFrame(rows, "invoice_id long, vendor_id string, value_cents long, invoice_date date")
    got = {(r.invoice_id, r.duplicate_of) for r in controls.duplicate_invoices(df, POLICY).collect()}
    assert got == {(2, 1), (3, 2), (5, 1), (5, 2)}


def test_cost_splits(spark):
    policy = Policy(prices={"m": (1.0, 2.0)})
    head = "run_id string, step long, kind string, activity string, item_key string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long"
    rows = [("r", 0, "model", None, None, 101, 0, 0, 0), ("r", 0, "tool", "A", "i", 0, 0, 0, 0), ("r", 0, "tool", "A", "i", 0, 0, 0, 0), ("r", 1, "model", None, None, 10, 0, 0, 0),
            ("r", 1, "tool", None, None, 0, 0, 0, 0), ("r", 2, "model", None, None, 7, 0, 0, 0), ("u", 0, "model", None, None, 5, 0, 0, 0)]
    sp, runs = spark.createDataFrame(rows, head), spark.createDataFrame([("r", "x/m"), ("u", "free")], "run_id string, model string")
    by = {r.activity: r for r in spans.cost_by_activity(sp, runs, policy).collect()}
    assert by["A"].input_tokens == 100 and by["A"].usd == pytest.approx(101e-6) and by["(lookup only)"].input_tokens == 10
    assert by["(final reply)"].input_tokens == 12
    by = {r.case_id: r for r in spans.cost_by_case(sp, runs, policy).collect()}
    assert by["i"].input_tokens == 118 and by["(unattributed)"].input_tokens == 5 and not by["(unattributed)"].priced


def test_case_windows_share_one_shuffle(spark, log):
    """Order, ties and neighbours of a case come from a single exchange by case."""
    raw = raw_of(spark, CASES)
    plan = dfg.pairs(canonical(raw, RANKS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(case_id") == 1 and "Cartesian" not in plan and "Python" not in plan


def test_bucketed_events_need_no_shuffle(spark, log):
    store.as_bucketed_table(log, "bucketed_events", 4)
    plan = dfg.pairs(spark.table("bucketed_events"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("drop table bucketed_events")


def test_commands(spark, log, tmp_path, capsys):
    path = str(tmp_path / "s")
    csv.write_events(log, str(tmp_path / "e"), files=1)
    run = lambda *a: cli.main(["--store", path, *a], spark)
    assert run("ingest", str(tmp_path / "e"), "--log-id", "L", "--sensitivity") == 0
    for args in (["logs"], ["summary", "L"], ["dfg", "L", "--keep-fraction", "0.9", "--svg", str(tmp_path / "g.svg")], ["variants", "L", "--coverage", "0.5"], ["rules", "L"], ["tie-breaks", "L"], ["compare", "L", "L"]):
        assert run(*args) == 0
    assert run("otlp", "L", "--out", str(tmp_path / "o")) == 0 and run("otlp-verify", "L", "--against", str(tmp_path / "o")) == 0
    assert run("sample", "L", "--cases", "2", "--as-log", "S") == 0 and sorted(r.log_id for r in store.logs(spark, path).collect()) == ["L", "S"]
    assert "<svg" in (tmp_path / "g.svg").read_text() and capsys.readouterr().out
