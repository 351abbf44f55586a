"""CSV: event tables and case-attribute tables, both ways."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import sorted_json
from ..functions.typed import let
from ..operators.eventlog import EventLog
from ..schema import DAY, SECOND
from .places import numbered

#: The canonical columns of an event file, and those of a three-column file.
COLUMNS = {k: k for k in ("case_id", "activity", "timestamp", "resource", "value_cents", "precision", "attributes")}
HELPDESK = {"case_id": "CaseID", "activity": "ActivityID", "timestamp": "CompleteTimestamp"}
#: ISO dates (of the calendar or of weeks, with hyphens or without), then any one character and a time with its offset.
_DATE = r"(?:(\d{4})-(\d\d)-(\d\d)|(\d{4})(\d\d)(\d\d)|(\d{4})-W(\d\d)(?:-(\d))?|(\d{4})W(\d\d)(\d)?)"
_CLOCK = r"(?:(\d\d)(?::(\d\d)(?::(\d\d)(?:[.,](\d+))?)?)?|(\d\d)(\d\d)(?:(\d\d)(?:[.,](\d+))?)?)"
_OFFSET = r"(?:([+-])(\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,]\d+)?)?)?)"
#: The common form without an offset, which needs no taking apart.
_PLAIN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"
_ISO = rf"^{_DATE}(?:.{_CLOCK}{_OFFSET}?)?$"
#: The common form with an offset of hours and minutes, its last six characters.
_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?[+-]\d{2}:\d{2}$"


def iso_time(text: Column) -> tuple[Column, Column]:
    """Seconds since 1970 of the local time that an ISO text names, as a timestamp, and its offset in seconds; null if it isn't one."""
    part = lambda *at: F.coalesce(*[F.nullif(F.regexp_extract(text, _ISO, i), F.lit("")) for i in at])
    number = lambda *at: part(*at).cast("int")
    zero = lambda *at: F.coalesce(part(*at), F.lit("00"))
    year, week, day = number(7, 10), number(8, 11), F.coalesce(number(9, 12), F.lit(1))
    first = F.date_trunc("week", F.concat(part(7, 10), F.lit("-01-04")).try_cast("date")).cast("date")
    shifted = F.date_add(first, (week - 1) * 7 + day - 1)
    # A week belongs to the year of its Thursday.
    there = (week >= 1) & day.between(1, 7) & (F.year(F.date_add(first, (week - 1) * 7 + 3)) == year)
    date = F.coalesce(F.concat_ws("-", part(1, 4), part(2, 5), part(3, 6)).try_cast("date"), F.when(there, shifted))
    clock = F.concat(zero(13, 17), F.lit(":"), zero(14, 18), F.lit(":"), zero(15, 19), F.lit("."), F.substring(zero(16, 20), 1, 6))
    local = F.when(text.rlike(_ISO), F.try_to_timestamp(F.concat(date.cast("string"), F.lit("T"), clock, F.lit("Z"))))
    seconds = zero(22).cast("int") * 3600 + zero(23).cast("int") * 60 + zero(24).cast("int")
    return local, F.when(part(21) == "-", -seconds).otherwise(seconds)


def parse_time(text: Column, layouts: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Time and precision of an ISO text: UTC unless it has an offset; a date, or midnight where it was written, has the precision of a day.

    Extended, basic and week forms are read.  ``layouts`` are further ones, tried in order; by default there are none.
    """
    def read(clean: Column) -> Column:
        plain, zoned, at, (local, offset) = clean.rlike(_PLAIN), clean.rlike(_ZONED), F.length(clean), iso_time(clean)
        ahead = F.substring(clean, at - 4, F.lit(2)).cast("int") * 3600 + F.substring(clean, at - 1, F.lit(2)).cast("int") * 60
        ahead = F.when(F.substring(clean, at - 5, F.lit(1)) == "-", -ahead).otherwise(ahead)
        local = F.when(plain, F.try_to_timestamp(clean)).when(zoned, F.try_to_timestamp(F.substring(clean, F.lit(1), at - 6))).otherwise(local)
        offset = F.when(plain, 0).when(zoned, ahead).otherwise(offset)
        return let(F.struct(local.alias("local"), offset.alias("offset")), lambda x: placed(clean, x["local"], x["offset"]))

    def placed(clean: Column, local: Column, offset: Column) -> Column:
        iso = F.timestamp_micros(F.unix_micros(local) - offset.cast("bigint") * 1_000_000)
        ts = F.coalesce(iso, *[F.try_to_timestamp(clean, F.lit(x)) for x in layouts])
        day_seconds = F.pmod(F.unix_seconds(F.coalesce(local, ts)), F.lit(86400))
        return F.struct(ts.alias("ts"), F.when((day_seconds == 0) | (F.length(clean) <= 10), DAY).otherwise(SECOND).alias("precision"))

    # Bound once: the text stands in the expression some fifty times, and would be taken from its row for each.
    both = let(F.regexp_replace(F.trim(text), "Z$", ""), read)
    return both["ts"], both["precision"]


def read_events(
    spark: SparkSession, path: str, mapping: dict[str, str] | None = None, keep: Column | None = None, layouts: tuple[str, ...] = (), line_breaks: bool = True
) -> DataFrame:
    """Raw events of a CSV file or folder, compressed or not.

    A value that isn't a number is 0, fractions are cut off; a time that can't be read is an error; attributes that
    aren't JSON objects are kept under ``raw``.  ``keep`` filters file rows and is pushed before the parsing.  The
    place in the files is the arrival, by file and then by record.  With ``line_breaks`` in fields a file is one task's;
    without, files are split.
    """
    mapping = mapping or COLUMNS
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=line_breaks, escape='"')
    if keep is not None:
        df = df.where(keep)
    df = numbered(df)
    col = lambda name: F.col(f"`{mapping[name]}`") if mapping.get(name) in df.columns else F.lit(None).cast("string")
    ts, precision = parse_time(col("timestamp"), layouts)
    bad = F.concat(F.lit("can't read the time "), F.coalesce(col("timestamp"), F.lit("(none)")))
    ts = F.when(ts.isNull(), F.raise_error(bad).cast("timestamp")).otherwise(ts)
    attrs = col("attributes")
    # A map of strings reads any object; whatever isn't one comes back as null.
    parsed = F.when(attrs.rlike(r"^\s*\{"), F.from_json(attrs, "map<string,string>"))
    kept = F.when(F.coalesce(attrs, F.lit("")) == "", F.create_map().cast("map<string,string>")).otherwise(F.coalesce(parsed, F.create_map(F.lit("raw"), attrs)))
    return df.select(
        F.trim(col("case_id")).alias("case_id"), F.trim(col("activity")).alias("activity"), ts.alias("ts"),
        F.col("ordinal").alias("arrival"), F.coalesce(col("resource"), F.lit("")).alias("resource"),
        F.coalesce(col("value_cents").try_cast("double").try_cast("bigint"), F.lit(0)).alias("value_cents"),
        F.coalesce(F.nullif(col("precision"), F.lit("")), precision).alias("precision"), kept.alias("attrs"),
    )


def event_rows(log: EventLog) -> DataFrame:
    """Events as text columns of an event file."""
    return log.events.select(
        "case_id", "activity", F.date_format(F.timestamp_seconds("ts_s"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "resource",
        F.col("value_cents").cast("string").alias("value_cents"), "precision",
        F.when(F.size("attrs") > 0, sorted_json(F.col("attrs"))).otherwise("").alias("attributes"), "pos",
    )


def write_events(log: EventLog, path: str, files: int | None = None) -> None:
    """Events in order of case and place, in ranges of cases; one file if ``files`` is 1."""
    rows = event_rows(log)
    ranged = rows.coalesce(1) if files == 1 else rows.repartitionByRange(files, "case_id") if files else rows.repartitionByRange("case_id")
    ranged.sortWithinPartitions("case_id", "pos").drop("pos").write.csv(path, header=True, escape='"', mode="overwrite", emptyValue="")


def attribute_rows(log: EventLog) -> DataFrame:
    """Case attributes as columns, in order of their names; missing ones are empty."""
    keys = [r.k for r in log.cases.select(F.explode(F.map_keys("attrs")).alias("k")).distinct().orderBy("k").collect()]
    return log.cases.select("case_id", *[F.coalesce(F.element_at("attrs", F.lit(k)), F.lit("")).alias(k) for k in keys])


def write_case_attributes(log: EventLog, path: str) -> None:
    attribute_rows(log).write.csv(path, header=True, escape='"', mode="overwrite", emptyValue="")


def read_case_attributes(spark: SparkSession, path: str) -> DataFrame:
    """One map for each case; empty values are left out."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")) for c in df.columns if c != "case_id"])
    there = F.filter(pairs, lambda x: F.coalesce(x["value"], F.lit("")) != "")
    return df.select("case_id", F.map_from_entries(there).alias("attrs"))


def inferred_types(log: EventLog) -> DataFrame:
    """A type for each case attribute: bool, int, float or str; ``mixed`` where values differ, which makes it str."""
    each = log.cases.select(F.explode("attrs").alias("key", "value"))
    kind = (
        F.when(F.col("value").isin("True", "False"), "bool").when(F.col("value").rlike(r"^-?(0|[1-9]\d*)$"), "int")
        .when(F.col("value").try_cast("double").isNotNull() & F.col("value").rlike(r"^-?\d"), "float").otherwise("str")
    )
    # Leading zeros are part of a name, not a number.
    kind = F.when(F.col("value").rlike(r"^-?0\d"), "str").otherwise(kind)
    got = each.groupBy("key").agg(F.min(kind).alias("least"), F.max(kind).alias("most"))
    mixed = F.col("least") != F.col("most")
    return got.select("key", F.when(mixed, "str").otherwise(F.col("least")).alias("type"), mixed.alias("mixed"))


def write_tables(log: EventLog, path: str) -> dict:
    """Events, case attributes, their types and a manifest of counts, as one folder; returns the manifest."""
    write_events(log, f"{path}/events")
    write_case_attributes(log, f"{path}/cases")
    types = inferred_types(log).orderBy("key").collect()
    sums = log.cases.agg(F.count("*").alias("cases"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("events")).first()
    manifest = {
        "cases": sums.cases, "events": sums.events, "dtypes": {r.key: r.type for r in types}, "mixed_type_columns": [r.key for r in types if r.mixed],
    }
    spark = log.events.sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def cross_check(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Two event tables by case: rows, cases, shared cases, and cases whose counts differ.  One row."""
    one = ours.groupBy("case_id").agg(F.count("*").alias("a"))
    two = theirs.groupBy("case_id").agg(F.count("*").alias("b"))
    both = one.join(two, "case_id", "full_outer")
    return both.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("our_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("their_rows"),
        F.count("a").alias("our_cases"), F.count("b").alias("their_cases"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared_cases"), F.count_if(F.col("a") != F.col("b")).alias("differing_counts"),
    )


def differing_cases(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """``(case_id, problem, our_rows, their_rows)`` of each case that only one table has, or that differs in its rows.

    Both tables are grouped before they meet, so a case is one row on each side.
    """
    one = ours.groupBy("case_id").agg(F.count("*").alias("a"))
    two = theirs.groupBy("case_id").agg(F.count("*").alias("b"))
    both = one.join(two, "case_id", "full_outer").where("not a <=> b")
    problem = F.when(F.col("b").isNull(), "only ours").when(F.col("a").isNull(), "only theirs").otherwise("other number of rows")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return both.select("case_id", problem.alias("problem"), zero("a", "our_rows"), zero("b", "their_rows"))


def case_column(columns: list[str]) -> str:
    """The column that holds the case, most specific name first."""
    low = {c.lower().strip(): c for c in columns}
    for name in ("case concept:name", "case:concept:name", "case_id", "caseid", "case id", "case"):
        if name in low:
            return low[name]
    raise KeyError(f"no case column among {', '.join(columns)}")
