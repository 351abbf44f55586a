"""Records of runs, notes, patterns, names as numbers, and the commands for them."""

import json

import pytest
from pyspark.sql import functions as F

from procspark import cli
from procspark.operators import controls, names, reports, reviews
from procspark.schema import MESSAGES, RUNS, SPANS

WRITES = ["clear"]


def agents(spark):
    """Three runs: one is refused and tries again, one is queued, one says nothing."""
    of = lambda kind: spark.createDataFrame([], kind).schema
    runs = [(r, None, "a", "clerk", "m", "v1", "off", None) for r in ("r1", "r2", "r3")]
    call = lambda i, run, tool, item, ok, result="{}": (f"s{i}", run, "tool", tool, i, None, ok, None if ok else "refused", item, None, 5, json.dumps({"result": json.loads(result), "arguments": {"i": i}}))
    calls = [
        call(1, "r1", "clear", "x", False), call(2, "r1", "look", "y", True), call(3, "r1", "clear", "x", False), call(4, "r1", "clear", "x", True),
        call(5, "r2", "clear", "x", True, '{"status": "queued_for_approval"}'),
    ]
    said = [("r1", 2, "assistant", "Done."), ("r1", 1, "user", "Please clear x"), ("r2", 1, "user", None)]
    at = lambda df: df.withColumn("started_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    return at(spark.createDataFrame(runs, of(RUNS))), at(spark.createDataFrame(calls, of(SPANS))), spark.createDataFrame(said, of(MESSAGES))


def test_records(spark):
    runs, rows, said = agents(spark)
    broken = spark.createDataFrame([("r1", "B"), ("r1", "A"), ("r1", "A")], "run_id string, rule_id string")
    got = {r.run_id: r for r in reviews.records(runs, rows, said, WRITES, broken).withColumn("flags", reviews.flags()).collect()}
    one, two, three = got["r1"], got["r2"], got["r3"]
    assert one.text == "user: Please clear x\nassistant: Done." and one.final_reply == "Done." and one.rules == ["A", "B"] and one.violations == 3
    assert [c.tool for c in one.calls] == ["clear", "look", "clear", "clear"] and json.loads(one.calls[1].arguments) == {"i": 2}
    assert one.activities_performed == ["clear"] and one.flags == ["retried", "several items", "refused again", "rules broken"]
    assert two.activities_performed == [] and two.flags == ["queued"] and two.text == "user: " and two.violations == 0
    assert (three.messages, three.calls, three.text, three.rules, three.flags, three.tool_calls) == ([], [], "", [], [], 0)
    assert reviews.records(runs, rows, said, WRITES).where("violations <> 0 or size(rules) > 0").isEmpty()
    assert reviews.records(runs.where("false"), rows, said, WRITES, broken).isEmpty()


def test_notes_are_added_and_the_last_counts(spark, tmp_path):
    path = str(tmp_path / "notes")
    assert reviews.read_notes(spark, path).isEmpty()
    first = reviews.annotate(spark, path, "r1", "odd", "ann", "p")
    again = reviews.annotate(spark, path, "r1", "fine", "ann")
    other = reviews.annotate(spark, path, "r1", "odd", "bob", "p")
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "notes").rglob("*.parquet")}
    extra = spark.createDataFrame([(None, "r2", "none", None, None, "x"), ("n", None, "ann", "none", None, "x")], "note_id string, run_id string, clash string, author string, note string, pattern string")
    reviews.add_notes(extra.withColumn("noted_at", F.lit(None)), path)
    assert all(f.stat().st_mtime_ns == t for f, t in files.items())
    notes = reviews.read_notes(spark, path)
    assert notes.columns == reviews.NOTE.names and notes.count() == 5
    last = {(r.run_id, r.author): (r.note_id, r.pattern, r.notes) for r in reviews.latest_notes(notes).collect()}
    assert last == {("r1", "ann"): (again, None, 2), ("r1", "bob"): (other, "p", 1), ("r2", None): (None, "x", 1)} and first != again


def test_the_last_note_of_one_time_has_the_greatest_id(spark):
    rows = [(i, "r", "a", None, i, None) for i in ("b", "c", "a")]
    notes = spark.createDataFrame(rows, reviews.NOTE).withColumn("noted_at", F.timestamp_seconds(F.lit(5)))
    assert [(r.note, r.notes) for r in reviews.latest_notes(notes.union(notes)).collect()] == [("c", 6)]


def test_patterns(spark, tmp_path):
    runs, rows, said = agents(spark)
    records = reviews.records(runs, rows, said, WRITES)
    of = reviews.Pattern
    patterns = [of("tried again", "d", detect="retries > 0"), of("quiet", "d", "rejected", detect="size(messages) = 0"), of("null", "d", detect="started_at < null"), of("tone", "d")]
    assert {tuple(r) for r in reviews.detected(records, patterns).collect()} == {("r1", "tried again"), ("r3", "quiet")}
    notes = spark.createDataFrame([(str(i), run, "ann", None, None, p) for i, (run, p) in enumerate([("r1", "tried again"), ("r2", "tried again"), ("r3", "odd")])], reviews.NOTE)
    got = {r.pattern: (r.status, r.detected, r.noted, r.both, r.first_noted) for r in reviews.pattern_report(records, notes, patterns, 2).collect()}
    assert got == {
        "tried again": ("confirmed", 1, 2, 1, "r1"), "quiet": ("rejected", 1, 0, 0, None), "null": ("candidate", 0, 0, 0, None),
        "tone": ("candidate", 0, 0, 0, None), "odd": ("undeclared", 0, 1, 0, "r3"),
    }
    with pytest.raises(ValueError, match="pattern p"):
        reviews.detected(records, [of("p", "d", detect="no_such > 1")])
    with pytest.raises(ValueError, match="pattern p isn't a truth value but bigint"):
        reviews.detected(records, [of("p", "d", detect="retries")])
    assert reviews.detected(records, [of("p", "d")]).isEmpty()
    (tmp_path / "p.json").write_text(json.dumps({"tone": {"definition": "new", "examples": ["e"]}}))
    merged = reviews.merge_patterns(patterns, reviews.load_patterns(str(tmp_path / "p.json")))
    assert [p.name for p in merged] == ["tried again", "quiet", "null", "tone"] and merged[3].definition == "new" and merged[3].examples == ("e",)
    with pytest.raises(ValueError, match="again and again detects what tried again detects"):
        reviews.merge_patterns(patterns, [of("again and again", "d", detect="retries  >  0")])


def test_names_as_numbers(spark):
    rows = [("b", 3), ("a", 5), ("b", 9), (None, 1), ("", 4), ("a", 6)]
    events = spark.createDataFrame(rows, "activity string, arrival long")
    ids = names.dictionary(events, "activity")
    assert sorted((r.id, r.name, r.n) for r in ids.collect()) == [(0, "b", 2), (1, "", 1), (2, "a", 2)]
    coded = names.encode(events.union(spark.createDataFrame([("new", 10)], events.schema)), ids, "activity", "no")
    assert sorted((r.arrival, r.no) for r in coded.collect()) == [(1, None), (3, 0), (4, 1), (5, 2), (6, 2), (9, 0), (10, None)]
    assert sorted((r.arrival, r.activity) for r in names.decode(coded, ids, "no", "activity").where("arrival < 10").collect()) == sorted((a, n) for n, a in rows)
    assert names.dictionary(events.where("false"), "activity").isEmpty()
    same = spark.createDataFrame([(str(i), 7) for i in range(600)], events.schema)
    got = names.dictionary(same, "activity").orderBy("id").collect()
    assert [r.id for r in got] == list(range(600)) and [r.name for r in got] == sorted(str(i) for i in range(600))


def test_a_dictionary_needs_no_window_over_all_names(spark):
    plan = names.dictionary(spark.createDataFrame([("a", 1)], "activity string, arrival long"), "activity")._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in plan.splitlines() if "Window [" in line]
    assert over and all("_part" in line for line in over)


def test_most_common_and_context(spark):
    df = spark.createDataFrame([(x,) for x in ("b", "a", "c", "c", None, None, None)], "x string")
    assert [tuple(r) for r in reports.most_common(df, F.col("x"), 3).collect()] == [(None, 3), ("c", 2), ("a", 1)]
    items = spark.createDataFrame([(1, 1, 1), (2, 1, 9), (3, 9, 1), (4, None, None)], "i int, o int, v int")
    orders, vendors = spark.createDataFrame([(1, "x")], "o int, on string"), spark.createDataFrame([(1, "y"), (None, "z")], "v int, vn string")
    assert sorted((r.i, r.on, r.vn) for r in controls.with_context(items, orders, "o", vendors, "v").collect()) == [(1, "x", "y"), (2, "x", None)]


def test_commands(spark, tmp_path, capsys):
    runs, rows, said = agents(spark)
    for name, df in (("runs", runs), ("spans", rows), ("messages", said)):
        df.write.json(str(tmp_path / f"{name}.jsonl"))
    run = lambda name, *more: cli.main(["--store", str(tmp_path / "store"), name, *more], spark)
    given = ("--agents", str(tmp_path), "--write", "clear=Clear Invoice")
    assert run("trace-annotate", "r1", "worked around", "--author", "ann", "--pattern", "p") == 0
    capsys.readouterr()
    assert run("trace-list", *given, "--limit", "2") == 0
    listed = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [r["run_id"] for r in listed] == ["r1", "r2"] and listed[0]["flags"][0] == "retried"
    assert run("trace-show", *given, "r1") == 0
    assert "worked around" in capsys.readouterr().out
    assert run("trace-show", *given, "zz") == 1
    (tmp_path / "p.json").write_text(json.dumps({"p": {"definition": "d", "detect": "retries > 0"}}))
    capsys.readouterr()
    assert run("trace-patterns", *given, "--patterns", str(tmp_path / "p.json")) == 0
    assert json.loads(capsys.readouterr().out)["both"] == 1
    assert run("trace-export", *given, "--out", str(tmp_path / "out")) == 0
    assert sorted(r.run_id for r in spark.read.json(str(tmp_path / "out")).collect()) == ["r1", "r2", "r3"]
