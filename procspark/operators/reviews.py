"""Reviewing agents' runs: a record for each run, notes that are only ever added, and patterns that expressions detect."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spans import run_features, tool_steps

#: A note on a run; ``pattern`` names the pattern that the note supports, if any.
NOTE = T.StructType(
    [
        T.StructField("note_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("noted_at", T.TimestampType()),
        T.StructField("note", T.StringType()),
        T.StructField("pattern", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Pattern:
    """A way in which runs go wrong; ``detect`` is a truth expression over the columns of a run's record."""

    name: str
    definition: str
    status: str = "candidate"
    created_from: str = ""
    detect: str | None = None
    examples: tuple[str, ...] = ()


def load_patterns(path: str) -> list[Pattern]:
    """Patterns of a JSON file, ``{name: {definition, status, created_from, detect, examples}}``; written by hand, so few."""
    with open(path) as f:
        said = json.load(f)
    return [Pattern(name, **{k: tuple(v) if k == "examples" else v for k, v in p.items()}) for name, p in said.items()]


def merge_patterns(old: Iterable[Pattern], new: Iterable[Pattern]) -> list[Pattern]:
    """Patterns by name, new ones in place of old ones, in the order in which names first came.

    A pattern that only repeats the detection of one with another name is an error: each run would count for both.
    """
    merged = {p.name: p for p in (*old, *new)}
    by: dict[str, str] = {}
    for p in merged.values():
        if p.detect is not None and by.setdefault(" ".join(p.detect.split()), p.name) != p.name:
            raise ValueError(f"{p.name} detects what {by[' '.join(p.detect.split())]} detects")
    return list(merged.values())


def records(runs: DataFrame, spans: DataFrame, messages: DataFrame, writes: list[str], findings: DataFrame | None = None) -> DataFrame:
    """A row for each run: its features, its messages and tool calls in order, its text, and the rules that it broke.

    ``findings`` (run_id, rule_id, ...) comes from ``reports.findings_by_run``.  A run's transcript is one row, as long
    as the run was.  Runs without messages or calls have empty lists and an empty text.
    """
    said = messages.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("message_id", "role", F.coalesce("content", F.lit("")).alias("text")))).alias("_said"))
    steps = tool_steps(spans).withColumn("write", F.col("tool").isin(writes))
    kept = ["step", "tool", "item_key", "ok", "error", "status", "decision", "arguments", "write"]
    calls = steps.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("started_at", "step", "span_id", F.struct(*kept).alias("call")))).alias("_calls"))
    df = run_features(runs, spans, messages, writes).join(said, "run_id", "left").join(calls, "run_id", "left")
    if findings is None:
        df = df.withColumn("rules", F.array().cast("array<string>")).withColumn("violations", F.lit(0).cast("bigint"))
    else:
        broken = findings.groupBy("run_id", "rule_id").agg(F.count("*").alias("n"))
        broken = broken.groupBy("run_id").agg(F.array_sort(F.collect_list("rule_id")).alias("rules"), F.sum("n").alias("violations"))
        df = df.join(broken, "run_id", "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<string>"))).na.fill(0, ["violations"])
    call = F.transform("_calls", lambda x: x["call"])
    done = F.filter(call, lambda c: c["write"] & c["ok"] & (F.coalesce(c["status"], F.lit("")) != "queued_for_approval"))
    messages_of = F.transform("_said", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    df = df.withColumns({"messages": messages_of, "calls": call, "activities_performed": F.coalesce(F.transform(done, lambda c: c["tool"]), F.array().cast("array<string>"))})
    df = df.withColumns({c: F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c in ("messages", "calls")})
    text = F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["text"])), "\n")
    return df.withColumn("text", text).drop("_said", "_calls")


def flags() -> Column:
    """What is remarkable about a run, from its record."""
    of = {
        "retried": F.col("retried_after_refusal"), "several items": F.col("multi_item"), "refused again": F.col("repeated_refusals"),
        "queued": F.col("writes_queued") > 0, "rules broken": F.col("violations") > 0,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in of.items()]))


def add_notes(notes: DataFrame, path: str) -> None:
    """Add notes to a table of notes; each call writes files of its own, so writers don't meet and nothing is rewritten."""
    row = notes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in NOTE.fields])
    row.write.parquet(f"{path}/added={uuid.uuid4().hex}")


def annotate(spark: SparkSession, path: str, run_id: str, note: str, author: str, pattern: str | None = None) -> str:
    """Add one note, dated now; returns its id."""
    note_id = uuid.uuid4().hex
    row = spark.createDataFrame([(note_id, run_id, author, None, note, pattern)], NOTE).withColumn("noted_at", F.current_timestamp())
    add_notes(row, path)
    return note_id


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """All notes ever added; none where the table isn't there yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return spark.createDataFrame([], NOTE)
    return spark.read.schema(NOTE).option("basePath", path).parquet(path).select(*NOTE.names)


def latest_notes(notes: DataFrame) -> DataFrame:
    """The last note of each author on each run, and how many there are: an aggregate, so a busy run is combined early.

    Of notes of one time the one with the greatest id is the last.  Notes without a run are on none and don't count; a
    null author is an author.
    """
    last = F.max(F.struct("noted_at", "note_id", "note", "pattern")).alias("_last")
    got = notes.where("run_id is not null").groupBy("run_id", "author").agg(last, F.count("*").alias("notes"))
    return got.select("run_id", "author", "_last.*", "notes")


def detected(record_rows: DataFrame, patterns: Iterable[Pattern]) -> DataFrame:
    """``(run_id, pattern)`` for each pattern whose expression holds for a run's record: one pass for all patterns.

    An expression that names what a record hasn't got, or that isn't a truth value, is an error that names its pattern.
    """
    found = []
    for p in patterns:
        if p.detect is None:
            continue
        try:
            kind = record_rows.select(F.expr(p.detect)).schema[0].dataType
        except AnalysisException as wrong:
            raise ValueError(f"the expression of pattern {p.name} can't be used: {wrong.getMessage()}") from wrong
        if not isinstance(kind, T.BooleanType):
            raise ValueError(f"the expression of pattern {p.name} isn't a truth value but {kind.simpleString()}")
        found.append(F.when(F.expr(p.detect), F.lit(p.name)))
    names = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return record_rows.select("run_id", F.explode(names).alias("pattern"))


def pattern_report(record_rows: DataFrame, notes: DataFrame, patterns: list[Pattern], confirm_at: int = 3) -> DataFrame:
    """A row for each pattern: runs that its expression finds, runs on which someone's last note names it, and both.

    ``status`` becomes ``confirmed`` for a candidate with so many noted runs; other states stay as declared.  Notes that
    name an undeclared pattern come with a null definition and the status ``undeclared``.
    """
    machine = detected(record_rows, patterns).withColumn("_d", F.lit(1))
    people = latest_notes(notes).where("pattern is not null").select("run_id", "pattern").distinct().withColumn("_n", F.lit(1))
    each = machine.join(people, ["run_id", "pattern"], "full_outer")
    counts = each.groupBy("pattern").agg(
        F.count("_d").alias("detected"), F.count("_n").alias("noted"), F.count(F.col("_d") + F.col("_n")).alias("both"), F.min(F.when(F.col("_n") == 1, F.col("run_id"))).alias("first_noted")
    )
    spark = record_rows.sparkSession
    declared = spark.createDataFrame([(p.name, p.definition, p.status, p.detect, list(p.examples)) for p in patterns], "pattern string, definition string, status string, detect string, examples array<string>")
    df = declared.join(counts, "pattern", "full_outer").na.fill(0, ["detected", "noted", "both"])
    status = F.when(F.col("status").isNull(), "undeclared").when((F.col("status") == "candidate") & (F.col("noted") >= confirm_at), "confirmed").otherwise(F.col("status"))
    return df.withColumn("status", status).select("pattern", "status", "definition", "detect", "examples", "detected", "noted", "both", "first_noted")
