"""IEEE XES: a splittable reader, and a writer."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import cents
from ..functions.typed import kind as kind_of
from ..functions.typed import let, members, text, texts
from ..functions.typed import said as typed_text
from ..operators.eventlog import EventLog
from ..session import cut
from . import traces

#: The keys with a meaning of their own.
NAME, TIME, RESOURCE, VALUE = "concept:name", "time:timestamp", "org:resource", "Cumulative net worth (EUR)"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """One row for each trace: ``ordinal`` (its number among all traces, from 0), ``attrs``, ``props`` and ``events``.

    ``props`` are the attributes with their types; ``attrs`` are the scalar ones as texts, truth values as True or False.  ``events``
    is an array of JSON objects.
    """
    rows = traces.read(spark, path).withColumn("props", F.parse_json("attributes"))
    return rows.select("ordinal", texts(F.col("props"), nested=False).alias("attrs"), "props", "events")


def read(spark: SparkSession, path: str, value: str = VALUE, keep: Column | None = None, max_cases: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw events and case attributes.  ``keep`` filters traces by ``attrs`` or ``props`` before their events are unfolded.

    Events without a time are dropped; an event without an activity is UNKNOWN; a trace without a name is named by
    its number among all traces.  Values are cents, half to even; what isn't a number is 0.  Both tables have ``props``
    beside ``attrs``: whole numbers, fractions, truth values, lists and objects as what they were.
    """
    return tables_of(read_traces(spark, path), value, keep, max_cases)


def tables_of(found: DataFrame, value: str = VALUE, keep: Column | None = None, max_cases: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``read`` for traces that were read; where both tables are used, a ``cut`` of the traces saves parsing the files twice."""
    rows = with_case_ids(found)
    if keep is not None:
        rows = rows.where(keep)
    if max_cases is not None:
        rows = rows.orderBy("ordinal").limit(max_cases)
    each = rows.select("case_id", "ordinal", F.posexplode("events").alias("i", "x")).select("case_id", "ordinal", "i", F.parse_json("x").alias("v"))
    # Not a filter, which Spark would move before the columns are made, so that events were parsed and times read for both.
    timed = each.select("*", F.explode(F.array_compact(F.array(_time(F.col("v"))[0]))).alias("ts"))
    events = with_event_columns(timed, value).drop("ordinal", "i", "v")
    return events, rows.select("case_id", "ordinal", "attrs", "props")


def with_case_ids(rows: DataFrame) -> DataFrame:
    """Traces with the name that they have, or one by their number."""
    unnamed = F.concat(F.lit("case-"), (F.col("ordinal") + 1).cast("string"))
    return rows.withColumn("case_id", F.coalesce(F.nullif(F.element_at("attrs", F.lit(NAME)), F.lit("")), unnamed))


def _time(v: Column) -> tuple[Column, Column]:
    from .csv import parse_time

    return parse_time(typed_text(v, TIME))


def with_event_columns(each: DataFrame, value: str) -> DataFrame:
    """Rows ``(ordinal, i, v)``, ``v`` the attributes of an event as VARIANT, with the columns of a raw event; a ``ts`` that is there is kept."""
    own, said = (NAME, TIME, RESOURCE, value), lambda key: typed_text(F.col("v"), key)
    others = F.map_filter(members(F.col("v")), lambda k, _: ~k.isin(*own))
    ts, precision = _time(F.col("v"))
    return each.withColumns({
        "activity": F.coalesce(F.nullif(said(NAME), F.lit("")), F.lit("UNKNOWN")), "ts": F.col("ts") if "ts" in each.columns else ts, "arrival": F.shiftleft("ordinal", 26) + F.col("i"),
        "resource": F.coalesce(F.nullif(said(RESOURCE), F.lit("")), said("User"), F.lit("")),
        "value_cents": F.coalesce(cents(said(value).try_cast("double")), F.lit(0)), "precision": precision,
        "attrs": F.transform_values(F.map_filter(others, lambda _, v: ~kind_of(v).isin("list", "object")), lambda _, v: text(v)), "props": F.parse_json(F.to_json(others)),
    })


def escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _tag(kind: str, key: Column, value: Column) -> Column:
    return F.concat(F.lit(f'<{kind} key="'), escape(key), F.lit('" value="'), escape(value), F.lit('"/>'))


def _typed_tag(key: Column, value: Column, depth: int = 1) -> Column:
    """A VARIANT value as an element of its kind; what lies deeper than ``depth`` lists or objects is written as JSON text."""
    wrap = lambda name, inner: F.concat(F.lit(f'<{name} key="'), escape(key), F.lit('">'), inner, F.lit(f"</{name}>"))

    def tag(v: Column, of: Column) -> Column:
        said = F.when(of == "bool", F.lower(text(v))).otherwise(F.coalesce(text(v), F.lit("")))
        name = F.when(of == "int", "<int").when(of == "float", "<float").when(of == "bool", "<boolean").otherwise("<string")
        scalar = F.concat(name, F.lit(' key="'), escape(key), F.lit('" value="'), escape(said), F.lit('"/>'))
        if not depth:
            return scalar
        each = F.transform(v.try_cast("array<variant>"), lambda x: _typed_tag(F.lit("item"), x, depth - 1))
        own = let(v.try_cast("map<string,variant>"), lambda m: F.transform(F.array_sort(F.map_keys(m)), lambda k: _typed_tag(k, F.element_at(m, k), depth - 1)))
        values = F.concat(F.lit("<values>"), F.array_join(each, ""), F.lit("</values>"))
        return F.when(of == "list", wrap("list", values)).when(of == "object", wrap("container", F.array_join(own, ""))).otherwise(scalar)

    return let(value, lambda v: let(kind_of(v), lambda of: tag(v, of)))


def _entries(df: DataFrame, without: tuple[str, ...]) -> Column:
    """All attributes of a row as elements, in order of their names: typed where there are types, else by what the texts look like."""
    if "props" in df.columns:
        every = F.map_filter(members(F.col("props")), lambda k, _: ~k.isin(*without))
        tags = let(every, lambda m: F.transform(F.array_sort(F.map_keys(m)), lambda k: _typed_tag(k, F.element_at(m, k))))
    else:
        kind = lambda v: F.when(v.isin("True", "False"), "boolean").when(v.rlike(r"^-?(0|[1-9]\d*)$"), "int").otherwise("string")
        low = lambda v: F.when(v.isin("True", "False"), F.lower(v)).otherwise(v)
        tag = lambda e: F.concat(F.lit("<"), kind(e["value"]), F.lit(' key="'), escape(e["key"]), F.lit('" value="'), escape(low(e["value"])), F.lit('"/>'))
        tags = F.transform(F.filter(F.array_sort(F.map_entries("attrs")), lambda e: ~e["key"].isin(*without)), tag)
    return F.coalesce(F.array_join(tags, ""), F.lit(""))


def trace_rows(log: EventLog, value: str | None = None) -> DataFrame:
    """Each case as one line of XES, in order of case; attributes in order of their names, typed ones with their types."""
    time = F.date_format(F.timestamp_seconds("ts_s"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    parts = [_tag("string", F.lit(NAME), F.col("activity")), _tag("date", F.lit(TIME), time), F.when(F.col("resource") != "", _tag("string", F.lit(RESOURCE), F.col("resource"))).otherwise("")]
    if value:
        parts.append(F.when(F.col("value_cents") != 0, _tag("float", F.lit(value), (F.col("value_cents") / 100).cast("string"))).otherwise(""))
    more = [_entries(log.events, (NAME, TIME, RESOURCE, value or VALUE))] if "props" in log.events.columns else []
    lines = log.events.select("case_id", "pos", F.concat(F.lit("<event>"), *parts, *more, F.lit("</event>")).alias("x"))
    events = lines.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "x")))["x"], "").alias("events"))
    cases = log.cases.select("case_id", _entries(log.cases, (NAME,)).alias("head"))
    name = _tag("string", F.lit(NAME), F.col("case_id"))
    return cases.join(events, "case_id").select("case_id", F.concat(F.lit("<trace>"), name, "head", "events", F.lit("</trace>")).alias("value"))


def _head(log: EventLog) -> list[str]:
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<log xes.version="1.0" xmlns="http://www.xes-standard.org/">']
    head += [f'<extension name="{n}" prefix="{p}" uri="http://www.xes-standard.org/{p}.xesext"/>' for n, p in (("Concept", "concept"), ("Time", "time"), ("Organizational", "org"))]
    head += [f'<classifier name="Activity" keys="{NAME}"/>']
    about = [(k, getattr(log, k)) for k in ("source", "license", "attribution") if getattr(log, k)]
    return head + [f'<string key="procspark:{k}" value={quoteattr(v)}/>' for k, v in about]


def _documents(head: list[str]):
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = lambda x: pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["value"])
        begun = False
        for batch in batches:
            if batch.num_rows and not begun:
                begun = True
                yield lines(head)
            yield lines(batch.column(0).drop_null())
        if begun:
            yield lines(["</log>"])

    return documents


def write(log: EventLog, path: str, value: str | None = None, single: bool = False) -> None:
    """XES documents in the folder ``path``, one for each range of cases; ``single`` puts all traces into one.

    Traces are rendered in parallel before they are dealt to ranges.  Event attributes are written where
    they are typed (``props``); precisions aren't.
    """
    # A row without a trace, so that an empty log is a document too.
    rows = trace_rows(log, value).unionByName(log.events.sparkSession.range(1).select(F.lit("").alias("case_id"), F.lit(None).cast("string").alias("value")))
    # Ranges are set from a sample, for which all rows would be rendered once more.
    rows = rows.repartition(1) if single else cut(rows, "rendered").repartitionByRange("case_id")
    rows = rows.sortWithinPartitions("case_id").select("value")
    rows.mapInArrow(_documents(_head(log)), "value string").write.mode("overwrite").text(path)
