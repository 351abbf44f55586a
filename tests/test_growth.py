"""Work that must not be done twice, or once for each place where an expression stands."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from procspark.functions import typed
from procspark.operators import reports, scenarios
from procspark.operators.eventlog import EventLog
from procspark.plans import catalogue
from procspark.policy import Policy
from procspark.session import CLEANUP, TASK_BYTES, dealt
from procspark.sources import csv, otlp, store, xes


def _log(spark) -> EventLog:
    rows = [(f"c{i}", a, 1700000000 + i, i) for i in range(40) for a in ("a", "b")]
    return EventLog.build(spark.createDataFrame(rows, "case_id string, activity string, ts_s bigint, arrival bigint"))


def _counted(spark, made, name, column):
    """A function whose rows are counted each time that one of them is rendered."""
    seen = spark.sparkContext.accumulator(0)

    def tick(x):
        seen.add(1)
        return x

    return seen, lambda *a: made(*a).withColumn(column, F.udf(tick, name)(column))


def test_a_time_is_taken_from_its_row_once(spark):
    for part in csv.parse_time(F.col("some_text")):
        assert str(part).count("some_text") == 1
    assert str(typed.said(F.col("some_props"), "k")).count("some_props") <= 2


def test_times_with_offsets_are_as_before(spark):
    cases = {
        "2024-02-29T10:00:00+00:00": ("2024-02-29 10:00:00", "second"), "2024-02-29T00:00:00+05:30": ("2024-02-28 18:30:00", "day"),
        "2024-02-29 23:30-01:00": ("2024-03-01 00:30:00", "second"), "2024-02-29T10:00:00.250-00:30": ("2024-02-29 10:30:00.25", "second"),
        "2024-02-30T10:00:00+00:00": (None, "second"), "2024-W09-4T10:00:00+01:00": ("2024-02-29 09:00:00", "second"), "20240229T100000+0100": ("2024-02-29 09:00:00", "second"),
        "2024-02-29": ("2024-02-29 00:00:00", "day"), "2024-02-29T10:00:00Z": ("2024-02-29 10:00:00", "second"), "never": (None, "day"),
    }
    ts, precision = csv.parse_time(F.col("t"))
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", ts.cast("string").alias("ts"), precision.alias("p"))
    got = {r.t: (r.ts, r.p) for r in df.collect()}
    assert got == cases


def test_attributes_read_one_by_one_are_as_read_together(spark):
    values = ["true", "false", "null", '"true"', '"[x"', '"{"', '"12.50"', "12.5", "2.0", "1e20", "1E0", "-7", "12345678901234567890", '""', '"a"', "[1]", '{"a":1}', '"2024-01-01T10:00:00.5"', '"1. first"']
    rows = [(i, f'{{"it\'s (a) key": {v}, "a (key)": {v}}}') for i, v in enumerate(values)] + [(99, "{}")]
    df = spark.createDataFrame(rows, "i int, x string").select("i", F.parse_json("x").alias("v"))
    for key in ("a (key)", "it's (a) key"):
        got = df.select(typed.said(F.col("v"), key).alias("a"), F.element_at(typed.texts(F.col("v"), nested=False), F.lit(key)).alias("b"), "i").collect()
        assert [(r.i, r.a) for r in got] == [(r.i, r.b) for r in got]


def test_traces_are_rendered_once(spark, tmp_path, monkeypatch):
    seen, rendered = _counted(spark, xes.trace_rows, "string", "value")
    monkeypatch.setattr(xes, "trace_rows", rendered)
    xes.write(_log(spark), str(tmp_path / "x"))
    assert seen.value == 40


def test_spans_are_rendered_once(spark, tmp_path, monkeypatch):
    seen, rendered = _counted(spark, otlp.case_spans, "array<string>", "spans")
    monkeypatch.setattr(otlp, "case_spans", rendered)
    otlp.write(_log(spark), str(tmp_path / "x"))
    assert seen.value == 40


def test_spans_are_not_shuffled_as_text(spark, data):
    """Spans are many times larger than events; what a Python function rendered would be dealt again by a join or a group."""
    log = catalogue._typed_log(spark, data)
    plan = otlp.case_spans(log, otlp.Header.of(log))._jdf.queryExecution().executedPlan().toString()
    assert -1 < plan.rindex("ArrowEvalPython") < plan.index("Exchange")


def test_an_export_leaves_nothing_but_itself(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "scratch_dir", lambda _: str(tmp_path / "o"))
    folder, before = Path(spark.conf.get("spark.checkpoint.dir")), (spark.conf.get(CLEANUP, None), spark.conf.get(TASK_BYTES, None))
    there = set(folder.rglob("*"))
    assert catalogue.otlp_typed(spark, data).count() > 0
    assert set(folder.rglob("*")) == there and (spark.conf.get(CLEANUP, None), spark.conf.get(TASK_BYTES, None)) == before
    assert {p.suffix for p in (tmp_path / "o").glob("part-*")} == {".gz"}


def test_events_stand_in_order_in_a_trace(spark, tmp_path):
    rows = [("c", f"a{i}", i, {"x": str(i), "y": "True"}) for i in range(30, 0, -1)]
    log = EventLog.build(spark.createDataFrame(rows, "case_id string, activity string, ts_s bigint, attrs map<string,string>").repartition(5))
    back = EventLog.build(log.events.withColumn("props", F.parse_json(F.concat(F.lit('{"l":[1,{"a":'), "pos", F.lit("}]}")))))
    for one, key, value in ((log, "x", [{"stringValue": str(i)} for i in range(1, 31)]), (back, "l", [str(i) for i in range(30)])):
        otlp.write(one, str(tmp_path / key))
        spans = json.loads(spark.read.text(str(tmp_path / key)).first().value)["resourceSpans"][0]["scopeSpans"][0]["spans"]
        said = [next(a["value"] for a in s["attributes"] if a["key"] == f"mb.event.{key}") for s in spans[1:]]
        assert [s["name"] for s in spans[1:]] == [f"a{i}" for i in range(1, 31)] and "parentSpanId" not in spans[0]
        assert value == (said if key == "x" else [v["arrayValue"]["values"][1]["kvlistValue"]["values"][0]["value"]["intValue"] for v in said])


def test_a_store_numbers_events_once(spark, tmp_path, monkeypatch):
    seen, numbered = _counted(spark, EventLog.numbered, "string", "activity")
    monkeypatch.setattr(EventLog, "numbered", numbered)
    store.save(_log(spark), str(tmp_path / "x"))
    assert seen.value == 80


def test_scenarios_without_references_are_not_joined(spark, monkeypatch):
    """Null keys would all meet in one task."""
    kind, joined = type(spark.range(1)), []
    said = kind.join

    def join(self, other, on=None, how=None):
        joined.append((on, self.where(f"{on} is null").count(), len(self.columns)))
        return said(self, other, on, how)

    rows = [("1", "hello", "c1", "buyer", None, "none", 1, []), ("2", "hi", "c1", "clerk", 7, "open", 1, None), ("2", "Hi ", "c2", "buyer", 8, "open", 2, ["x"]), (None, "", None, "", None, "open", 1, ["x"]), ("5", "x", "", "buyer", None, "none", 1, [])]
    table = spark.createDataFrame(rows, "id string, opening_message string, actor_id string, role string, item_key bigint, item_state string, turn_count int, followups array<string>")
    monkeypatch.setattr(kind, "join", join)
    got = scenarios.problems(table, spark.createDataFrame([("c1", "buyer")], "actor_id string, role string"), spark.createDataFrame([(7,), (7,)], "item_key bigint"), {"role": ("buyer",)})
    assert sorted((r.id or "", r.problem) for r in got.collect()) == [
        ("", "missing actor_id"), ("", "missing id"), ("", "missing opening_message"), ("", "missing role"), ("", "state without an item"), ("", "turn count is not 1 and the followups"), ("", "unknown role"),
        ("2", "actor is not in the world"), ("2", "id is not unique"), ("2", "item does not exist"), ("2", "opening message is not unique"), ("2", "opening message is not unique"), ("2", "role is not the actor's"), ("2", "unknown role"),
        ("5", "missing actor_id"),
    ]
    assert {on for on, _, _ in joined} == {"actor_id", "item_key", "text"} and not any(nulls for _, nulls, _ in joined) and max(n for _, _, n in joined) == 3


def test_all_rules_look_at_events_put_in_order_once(spark, monkeypatch):
    def log_of_runs(*_):
        log = _log(spark)
        key = F.to_json(F.struct(F.lit("r").alias("run_id"), F.col("case_id").alias("item_key")))
        return EventLog(log.events.withColumn("case_id", key), log.cases.withColumn("case_id", key))

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def tick(x):
        seen.add(1)
        return x

    monkeypatch.setattr(reports, "log_of_runs", lambda *a: EventLog((log := log_of_runs()).events.withColumn("activity", tick("activity")), log.cases))
    policy = Policy(conflicting_pairs=(("a", "b"),), remove_block="b", set_block="x", clear="b", receipts=("x",))
    found = reports.findings_by_run(None, None, {}, policy)
    assert {(r.rule_id, r["count"]) for r in found.groupBy("rule_id").count().collect()} == {("CTRL-BLOCK", 40)} and seen.value == 80


def test_rows_of_a_task_stay_as_many_as_tables_grow(spark):
    for n, tasks in ((0, 1), (100, 1), (1000, 10), (4000, 40)):
        got = dealt(spark.range(n), "id", 100)
        assert got.rdd.getNumPartitions() == tasks and got.count() == n


def test_events_of_traces_are_parsed_once(spark):
    """A filter on times would be moved before the columns are made, and parse events for itself."""
    rows = spark.createDataFrame([(0, {}, ['{"concept:name":"a","time:timestamp":"2024-02-29T10:00:00+00:00"}', '{"concept:name":"b"}'])], "ordinal bigint, attrs map<string,string>, events array<string>")
    events, _ = xes.tables_of(rows.withColumn("props", F.parse_json(F.lit("{}"))))
    picked = events.select("activity", "ts", "value_cents")
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.activity, str(r.ts), r.value_cents) for r in picked.collect()] == [("a", "2024-02-29 10:00:00", 0)]
    assert plan.count("parse_json") + plan.count("parseJson") == 1
