"""Runs judged one by one, archives, references and time texts."""

import csv as text_csv
import io
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from procspark.operators import reports, rules, scenarios
from procspark.operators.eventlog import EventLog
from procspark.policy import Policy
from procspark.schema import FLOW
from procspark.sources import archives, csv

POLICY = Policy(
    clear="clear", invoice="invoice", receipts=("receipt",), remove_block="unblock", set_block="block", delete="delete",
    gr_required_flows=("needs",), conflicting_pairs=(("receipt", "clear"),), tolerance_abs_eur=1, tolerance_pct=0.0,
)
TOOLS = {x: x for x in ("clear", "invoice", "receipt", "unblock", "delete")}


def agent_spans(spark, rows):
    """Spans of ``(run, item, tool, cents)``, a second apart."""
    rows = [(f"s{i:03}", run, "tool", tool, i, 1_700_000_000 + i, True, None, item, cents, '{"result":{}}') for i, (run, item, tool, cents) in enumerate(rows)]
    df = spark.createDataFrame(rows, "span_id string, run_id string, kind string, name string, step long, t long, ok boolean, error string, item_key string, value_cents long, attributes string")
    return df.withColumn("started_at", F.timestamp_seconds("t"))


def of_runs(df):
    names = ("actor_id", "role", "model", "prompt_version", "scenario_id", "killswitch")
    return df.select("run_id").distinct().select("run_id", *[F.lit("x").alias(n) for n in names])


def test_a_rule_is_off_in_one_run_alone(spark):
    one_value = [("r1", "a", "receipt", 500), ("r1", "a", "invoice", 500)]  # can't be told apart
    too_much = [("r2", "z", "receipt", 100), ("r2", "z", "invoice", 900), ("r2", "z", "clear", 900)]
    no_receipt = [("r3", "z", "clear", 5)]
    df = agent_spans(spark, one_value + too_much + no_receipt + [("r4", "other", "unblock", 0), ("r4", "other", "delete", 0), ("r4", "other", "invoice", 1)])
    attrs = spark.createDataFrame([("a", {FLOW: "needs"}), ("z", {FLOW: "needs"})], "case_id string, attrs map<string,string>")
    found = {(r.run_id, r.case_id, r.rule_id) for r in reports.findings_by_run(df, of_runs(df), TOOLS, POLICY, attrs).collect()}
    assert found == {("r2", "z", "CTRL-TOLERANCE"), ("r2", "z", "CTRL-SOD"), ("r3", "z", "CTRL-GR"), ("r4", "other", "CTRL-BLOCK"), ("r4", "other", "CTRL-DELETED")}
    scope = {(r.run_id, r.rule_id): (r.in_scope, r.violations, r.status) for r in reports.findings_scope(df, of_runs(df), TOOLS, POLICY, attrs).collect()}
    assert len(scope) == 4 * len(rules.RULES)
    assert scope["r1", "CTRL-TOLERANCE"] == (1, 0, "not applicable") and scope["r2", "CTRL-TOLERANCE"] == (1, 1, "evaluated")
    assert scope["r4", "CTRL-GR"] == (0, 0, "nothing in scope") and scope["r1", "CTRL-SOD"] == (1, 0, "evaluated")
    without = {(r.rule_id, r.status) for r in reports.findings_scope(df, of_runs(df), TOOLS, POLICY).collect()}
    assert ("CTRL-GR", "nothing in scope") in without and ("CTRL-GR", "evaluated") not in without
    empty = df.where("false")
    assert reports.findings_by_run(empty, of_runs(df), TOOLS, POLICY, attrs).isEmpty() and reports.findings_scope(empty, of_runs(df), TOOLS, POLICY).isEmpty()


def test_a_report_has_a_row_for_each_rule(spark):
    raw = spark.createDataFrame([(c, a, i, 5) for i, (c, a) in enumerate([("p1", "receipt"), ("p1", "invoice"), ("q1", "receipt"), ("q1", "invoice")])], "case_id string, activity string, ts_s long, value_cents long")
    attrs = raw.select("case_id").distinct().select("case_id", F.create_map(F.lit(FLOW), F.lit("needs")).alias("attrs"))
    got = rules.evaluate(EventLog.build(raw, None, attrs), POLICY, part=F.substring("case_id", 1, 1))
    assert got.not_applicable.count() == 2 and rules.report(got).count() == len(rules.RULES)


def archive(path, **tables):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, rows in tables.items():
            out = io.StringIO()
            text_csv.writer(out).writerows(rows)
            z.writestr(f"{name.replace('_', '/')}.csv", out.getvalue())
        z.writestr("read me.txt", "case_id\nnot,a,table\n")
    return str(path)


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "BATCH_CHARS", 40)
    rows = [["case Spend area text", "case concept:name", "note"]] + [[f"area {i % 3}", f"c{i % 4}", 'a, "b"\nc é' if i % 2 else ""] for i in range(30)]
    path = archive(tmp_path / "one.zip", first=rows, sub_second=[["x"], ["1"], [], ["2", "beyond"]], zero=[["x"]])
    archive(tmp_path / "two.zip", third=[["a", "b"], ["only a"]])
    got = archives.read_tables(spark, str(tmp_path)).collect()
    first = sorted((r.record, r.fields) for r in got if r.member == "first.csv")
    assert first == [(i, dict(zip(rows[0], row, strict=True))) for i, row in enumerate(rows[1:])]
    assert [r.fields for r in got if r.member == "sub/second.csv"] == [{"x": "1"}, {"x": "2"}]
    assert [r.fields for r in got if r.member == "third.csv"] == [{"a": "only a", "b": None}]
    assert {r.member for r in archives.members(spark, path).collect()} == {"first.csv", "sub/second.csv", "zero.csv", "read me.txt"}
    ours = spark.createDataFrame([(f"c{i % 5}",) for i in range(35)], "case_id string")
    counts, cases = archives.compare(ours, path)
    c = counts.first()
    assert (c.our_rows, c.their_rows, c.our_cases, c.their_cases, c.shared_cases, c.differing_counts) == (35, 30, 5, 4, 4, 2)
    assert {tuple(r) for r in cases.collect()} == {("c4", "only ours", 7, 0), ("c0", "other number of rows", 7, 8), ("c1", "other number of rows", 7, 8)}
    only_text = archive(tmp_path / "none.zip")
    with pytest.raises(ValueError, match="no table"):
        archives.compare(ours, only_text)


def test_references(spark):
    rows = spark.createDataFrame([("1", "f", None, None, "g"), ("2", "x", "p", "d", "challenge"), ("2", "x", "", "e", None)], "id string, flow string, policy string, data_quality_case_id string, scenario_group string")
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "v string")
    got = scenarios.unknown_references(rows, {"flow": one("f", "f"), "policy": one("p", None), "data_quality_case_id": one("d")})
    assert sorted(map(tuple, got.collect())) == [("2", "data_quality_case_id is not known"), ("2", "flow is not known"), ("2", "flow is not known"), ("2", "policy is not known")]
    assert [r.id for r in scenarios.misplaced(rows).collect()] == ["2"] and scenarios.unknown_references(rows, {}).isEmpty()


TIMES = [
    "2020-03-01", "2020-03-01T10:11:12", "2020-03-01 10:11", "20200301", "20200301T101112", "20200301T1011", "2020-W09-3", "2020-W09", "2020W093", "2020W09", "2020W093T10",
    "2020-W53-7", "2021-W01-1", "2015-W53", "2020-03-01T10", "2020-03-01x10:11:12,5", "2020-03-01T00:00:00+02:00", "2020-03-01T02:00:00+02:00", "2020-03-01T10:11:12.1234567",
    "2020-03-01T10:11:12-0530", "2020-03-01T10:11:12+01", "20200301T101112+01:00:30", "2020-03-01T10:11:12Z", " 2020-03-01T00:00:00Z ", "1969-12-31T23:59:59",
]
BAD = ["2021-W53-1", "2020-W00-1", "2020-W09-8", "2020-13-01", "2020-02-30", "2020-0301", "202003", "2020-03-01T25:00", "2020-03-01T10:1112", "2020-03-01T10:11:12+", "today", "", "2020-03-01T"]


def test_times_as_in_python(spark):
    def want(text):
        text = text.strip()
        text = text[:-1] if text.endswith("Z") else text
        t = datetime.fromisoformat(text)
        t = t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t
        return int(t.timestamp() // 1), "day" if len(text) <= 10 or (t.hour, t.minute, t.second) == (0, 0, 0) else "second"

    df = spark.createDataFrame([(x,) for x in TIMES + BAD], "x string")
    ts, precision = csv.parse_time(F.col("x"))
    got = {r.x: (r.t, r.p) for r in df.select("x", F.unix_seconds(ts).alias("t"), precision.alias("p")).collect()}
    assert {x: got[x] for x in TIMES} == {x: want(x) for x in TIMES}
    for x in BAD:
        with pytest.raises(ValueError):
            datetime.fromisoformat(x)
        assert got[x][0] is None
