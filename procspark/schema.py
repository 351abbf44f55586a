"""Canonical columns of events and cases."""

from pyspark.sql import types as T

#: A raw event, before it is ordered: what sources produce.
RAW = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("activity", T.StringType()),
        T.StructField("ts_s", T.LongType()),
        T.StructField("sort_hint", T.LongType()),
        T.StructField("arrival", T.LongType()),
        T.StructField("resource", T.StringType()),
        T.StructField("value_cents", T.LongType()),
        T.StructField("precision", T.StringType()),
        T.StructField("tie_broken", T.BooleanType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)
#: An ordered event: ``pos`` is its place in the case, from 0.
EVENTS = T.StructType([*RAW.fields, T.StructField("pos", T.IntegerType())])
#: One row for each case that has events.
CASES = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("start_ts", T.LongType()),
        T.StructField("end_ts", T.LongType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)
SECOND, DAY = "second", "day"
#: The case attribute that says which matching flow a case follows.
FLOW = "Item Category"

#: Agents' runs, their spans and their messages, as JSON lines have them.
RUNS = "run_id string, scenario_id string, actor_id string, role string, model string, prompt_version string, killswitch string, started_at timestamp"
SPANS = "span_id string, run_id string, kind string, name string, step long, started_at timestamp, ok boolean, error string, item_key string, activity string, value_cents long, attributes string"
MESSAGES = "run_id string, message_id long, role string, content string"
