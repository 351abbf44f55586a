"""XES that isn't our own over many splits, and attributes of all types."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from procspark.functions import typed
from procspark.operators.eventlog import EventLog
from procspark.sources import otlp, store, traces, xes

STYLES = {
    "plain": ("<trace>", "</trace>", ""),
    "prefixed": ("<x:trace>", "</x:trace>", "x:"),
    "spaced": ('<trace a="1>2"\n >', "</trace \n>", ""),
    "commented": ("<trace><!-- </trace> <trace> > -->", "<!-- <trace> --></trace><!-- <trace><event/></trace> -->", ""),
    "cdata": ("<trace>", "<![CDATA[</trace><trace>]]></trace><?pi <trace> ?>", ""),
}


def document(style: str, n: int) -> str:
    begin, end, p = STYLES[style]
    out = [f'<?xml version="1.0" encoding="UTF-8"?>\n<{p}log xmlns:x="http://x/"><!-- a <trace> that isn\'t one -->\n<{p}global scope="trace"><{p}string key="concept:name" value="no"/></{p}global>\n']
    for i in range(n):
        events = "".join(
            f'<{p}event>\n<{p}string key="concept:name" value="A{i}_{k} &lt;trace&gt; é"/><{p}date key="time:timestamp" value="2020-01-01T00:00:{k:02}Z"/><{p}int key="n" value="{k}"/></{p}event>'
            for k in range(i % 5)
        )
        out.append(f"{begin}<{p}string key='concept:name' value='c{i}'/>{events}{end}\n")
        if i % 7 == 3:
            out.append(f'<{p}trace/>\n<{p}trace note="a>b" />')
    return "".join(out) + f"</{p}log>\n"


def by_element_tree(text: str) -> list:
    local = lambda e: e.tag.rpartition("}")[2].rpartition(":")[2]
    out = []
    for t in ET.fromstring(text):
        if local(t) == "trace":
            name = [a.get("value") for a in t if local(a) == "string" and a.get("key") == "concept:name"]
            out.append((name[0] if name else None, [[(a.get("key"), a.get("value")) for a in e] for e in t if local(e) == "event"]))
    return out


@pytest.mark.parametrize("size", ["64m", "420"])
@pytest.mark.parametrize("style", STYLES)
def test_as_element_tree(spark, tmp_path, style, size):
    text = document(style, 25)
    (tmp_path / "a.xes").write_text(text)
    (tmp_path / "b.xes").write_text(document(style, 9))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted(traces.read(spark, str(tmp_path)).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = by_element_tree(text) + by_element_tree(document(style, 9))
    assert [r.ordinal for r in got] == list(range(len(want)))
    read = [(json.loads(r.attributes).get("concept:name"), [[(k, str(v)) for k, v in json.loads(e).items()] for e in r.events]) for r in got]
    assert read == want


def test_comment_over_splits(spark, tmp_path):
    """A comment that goes on over several splits holds no traces."""
    trace = '<trace><string key="concept:name" value="in"/></trace>'
    (tmp_path / "a.xes").write_text(f"<log><trace></trace><!-- {trace * 60} --><trace><event/></trace></log>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = sorted(traces.read(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.ordinal, r.attributes, r.events) for r in got] == [(0, "{}", []), (1, "{}", ["{}"])]


def test_compressed(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.xes.gz", "wt") as f:
        f.write(document("prefixed", 12))
    assert traces.read(spark, str(tmp_path)).count() == len(by_element_tree(document("prefixed", 12)))


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("<log><trace></log>", "ends within a trace"), ("<log></trace></log>", "didn't begin"), ("<log><trace><trace></trace></trace></log>", "inside another"),
        ("<log><trace", "doesn't end|ends within"), ("<?xml version='1.0' encoding='UTF-16'?><log></log>", "encoding"), ("<log><trace><event></trace></log>", "can't read a trace"),
    ],
)
def test_what_is_wrong_is_an_error(spark, tmp_path, text, said):
    (tmp_path / "a.xes").write_text(text)
    with pytest.raises(Exception, match=said):
        traces.read(spark, str(tmp_path / "a.xes")).collect()


PROPS = '{"i":12,"f":2.0E0,"t":true,"s":"12","z":"007","l":[1,"a",[true]],"o":{"k":1.5,"n":{"m":[{"x":1}]}},"q":"a\\"<&b"}'


@pytest.fixture(scope="module")
def log(spark):
    raw = spark.createDataFrame([("c1", "A", 10), ("c1", "B", 20)], "case_id string, activity string, ts_s long").withColumn("props", F.parse_json(F.lit(PROPS)))
    return EventLog.build(raw, attributes=raw.where("activity = 'A'").select("case_id", F.create_map().cast("map<string,string>").alias("attrs"), "props"), log_id="typed")


def plain(df):
    return [json.loads(r.x) for r in df.select(F.to_json("props").alias("x")).collect()]


def otlp_plain(value):
    return {x["key"]: int(x["value"]["intValue"]) for x in value["kvlistValue"]["values"]}


def test_types_survive_otlp(spark, log, tmp_path):
    otlp.write(log, str(tmp_path / "o"))
    back = otlp.read(spark, str(tmp_path / "o"))
    want = json.loads(PROPS)
    for got in plain(back.events) + plain(back.cases):
        # Deeper than is read: as it stands in the export.
        got["o"]["n"]["m"] = [otlp_plain(x) for x in json.loads(got["o"]["n"]["m"])["values"]]
        assert repr(got) == repr(dict(sorted(want.items())))
    assert {(r.key, r.type) for r in typed.types(back.events).collect()} == {("i", "int"), ("f", "float"), ("t", "bool"), ("s", "str"), ("z", "str"), ("l", "list"), ("o", "object"), ("q", "str")}
    assert otlp.verify(spark, str(tmp_path / "o"), log).count() == 0


def test_types_survive_xes_and_store(spark, log, tmp_path):
    xes.write(log, str(tmp_path / "x"))
    events, cases = xes.read(spark, str(tmp_path / "x"))
    want = json.loads(PROPS)
    for got in plain(events) + [{k: v for k, v in x.items() if k != xes.NAME} for x in plain(cases)]:
        # Beyond a list or an object values are texts in this format.
        assert got == want | {"l": [1, "a", "[true]"], "o": {"k": 1.5, "n": '{"m":[{"x":1}]}'}}
    store.save(log, str(tmp_path / "st"))
    assert plain(store.load(spark, str(tmp_path / "st"), "typed").events) == [want, want]
    wide = typed.columns(log.events.select("case_id", "pos", "props"), prefix="a_").orderBy("pos").first()
    assert (wide.a_i, wide.a_f, wide.a_t, wide.a_s, wide.a_l) == (12, 2.0, True, "12", '[1,"a",[true]]')


def test_repeated_attribute_and_mixed_types(spark, tmp_path):
    kv = lambda k, v: {"key": k, "value": v}
    span = {"traceId": "a" * 32, "spanId": "b" * 16, "name": "x", "kind": 1, "startTimeUnixNano": "0", "endTimeUnixNano": "0",
            "attributes": [kv("mb.case_id", {"stringValue": "c"}), kv("mb.case.a", {"intValue": "1"}), kv("mb.case.a", {"stringValue": "2"}), kv("mb.case.n", {"doubleValue": "NaN"}), kv("mb.case.l", {"arrayValue": {}})]}
    (tmp_path / "o.txt").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}))
    spans = otlp.read_spans(spark, str(tmp_path / "o.txt"))
    assert json.loads(spans.select(F.to_json(otlp.props_of(F.col("attributes"), "mb.case."))).first()[0]) == {"a": "2", "n": "NaN", "l": []}
    assert "attribute stands twice" in {r.problem for r in otlp.structural_problems(spans).collect()}


def test_tables_in_one_job(spark, tmp_path):
    """Both tables, counts and types come from one write; the source is scanned once beside the count of its splits."""
    from procspark.sources import tables

    (tmp_path / "a.xes").write_text(document("prefixed", 30).replace("<x:trace>", '<x:trace><x:int key="size" value="5"/>', 9))
    facts = tables.convert(spark, str(tmp_path / "a.xes"), str(tmp_path / "out"))
    want = by_element_tree(document("prefixed", 30))
    assert facts["cases"] == len(want) and facts["events"] == sum(len(e) for _, e in want)
    assert "size: BIGINT" in facts["case_schema"] and "n: BIGINT" in facts["event_schema"]
    raw, cases = xes.read(spark, str(tmp_path / "a.xes"))
    what = ["case_id", "pos", "activity", "ts_s", "attrs"]
    one, two = tables.load(spark, str(tmp_path / "out")), EventLog.build(raw, None, cases)
    assert sorted(map(repr, one.events.select(what).collect())) == sorted(map(repr, two.events.select(what).collect()))
    assert sorted(map(repr, one.cases.select("case_id", "attrs").collect())) == sorted(map(repr, two.cases.select("case_id", "attrs").collect()))
    table = tables.case_table(spark, str(tmp_path / "out"))
    assert dict(table.dtypes)["size"] == "bigint" and table.where("size = 5").count() == 9
    plan = tables.typed_rows(spark, str(tmp_path / "a.xes"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and plan.count("FileScan") == 1


def test_verify_names_lost_doubled_and_changed(spark, tmp_path):
    rows = [(f"c{i}", f"A{k}", 100 * i + k, k, f"u{k}", 100 + k) for i in range(8) for k in range(3)]
    raw = spark.createDataFrame(rows, "case_id string, activity string, ts_s long, arrival long, resource string, value_cents long")
    log = EventLog.build(raw, log_id="v")
    otlp.write(log, str(tmp_path / "o"))
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "o")).collect()]
    for r in lines:
        spans = r["resourceSpans"][0]["scopeSpans"][0]["spans"]
        of = lambda c, seq, spans=spans: next(s for s in spans if {"key": "mb.case_id", "value": {"stringValue": c}} in s["attributes"] and {"key": "mb.seq", "value": {"intValue": str(seq)}} in s["attributes"])
        spans.remove(of("c0", 1))
        spans.append(of("c1", 2))
        a, b = of("c2", 0), of("c2", 1)
        for s, name in ((a, "A1"), (b, "A0")):
            s["name"] = name
            next(x for x in s["attributes"] if x["key"] == "mb.activity")["value"] = {"stringValue": name}
        for s in (x for x in [of("c3", 1)]):
            s["startTimeUnixNano"] = s["endTimeUnixNano"] = "7000000000"
        spans[:] = [s for s in spans if {"key": "mb.case_id", "value": {"stringValue": "c4"}} not in s["attributes"]]
    (tmp_path / "bad.txt").write_text("\n".join(map(json.dumps, lines)))
    got = {r.problem: r.n for r in otlp.verify(spark, str(tmp_path / "bad.txt"), log).collect()}
    assert got == {"event missing": 1, "event stands twice": 1, "sequence differs": 1, "times differ": 1, "case missing": 1, "span id isn't its event's": 2}
    events, _ = otlp._of_spans(otlp.read_spans(spark, str(tmp_path / "o")))
    same = otlp.conserved_totals(log, events).first()
    assert (same.log_events, same.log_cents, same.log_ties) == (same.export_events, same.export_cents, same.export_ties) == (24, 2424, 0)


def test_first_duplicates(spark):
    import datetime as dt
    import random

    from procspark.operators import controls
    from procspark.policy import Policy

    rng = random.Random(2)
    policy = Policy(duplicate_invoice_window_days=10, duplicate_invoice_value_tolerance_eur=1)
    day = dt.date(2024, 1, 1)
    rows = [(i, f"v{i % 3}", rng.randrange(0, 6000), day + dt.timedelta(rng.randrange(0, 200))) for i in range(1500)]
    rows += [(5000 + i, "hot", 777, day) for i in range(3000)] + [(9000, "v0", None, day), (9001, "v0", 5, None)]
    df = spark.createDataFrame(rows, "invoice_id long, vendor_id string, value_cents long, invoice_date date").repartition(5)
    want = {}
    for i, v, c, d in rows[:1500]:
        near = [j for j, w, e, f in rows[:1500] if w == v and j < i and abs(c - e) <= 100 and abs((d - f).days) <= 10]
        if near:
            want[i] = min(near)
    want |= {5000 + i: 5000 for i in range(1, 3000)}
    got = controls.first_duplicates(df, policy).collect()
    assert {r.invoice_id: r.duplicate_of for r in got} == want and len(got) == len(want) > 3100


def test_records_are_numbered_without_a_shuffle_of_texts(spark, tmp_path):
    """Whatever the size of the files: the counts of splits are sent to the records, not the records to the counts."""
    from procspark.sources.places import numbered

    spark.range(300).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("value")).coalesce(1).write.text(str(tmp_path / "t"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        df = numbered(spark.read.text(str(tmp_path / "t")))
        got = {r.value: r.ordinal for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {f"line {i}": i for i in range(300)}
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
