"""Case filters: each gives a log of whole cases, with order and tie flags unchanged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import flow_of
from ..schema import FLOW
from .eventlog import EventLog
from .variants import cases_covering


def by_case_attribute(log: EventLog, key: str, *values: object) -> EventLog:
    """Cases whose attribute, as text, is one of the values; a missing attribute is the empty text."""
    return log.keep(log.cases.where(flow_of(F.col("attrs"), key).isin([str(v) for v in values])), **{key: "|".join(map(str, values))})


def by_flow(log: EventLog, *flows: str) -> EventLog:
    return by_case_attribute(log, FLOW, *flows)


def by_variant_coverage(log: EventLog, coverage: float) -> EventLog:
    return log.keep(cases_covering(log, coverage), coverage=str(coverage))


def containing_activity(log: EventLog, *activities: str) -> EventLog:
    """Cases with any of the activities; unknown names find nothing."""
    return log.keep(log.events.where(F.col("activity").isin(list(activities))))


def excluding_activity(log: EventLog, *activities: str) -> EventLog:
    """Cases with none of the activities; unknown names exclude nothing."""
    hit = log.events.where(F.col("activity").isin(list(activities))).select("case_id")
    return log.keep(log.cases.join(hit, "case_id", "left_anti"))


def by_timeframe(log: EventLog, start: int | None = None, end: int | None = None, mode: str = "contained") -> EventLog:
    """Cases ``contained`` in, ``intersecting`` or ``started`` in a span of seconds; bounds count in, either may be open."""
    first, last = F.col("start_ts"), F.col("end_ts")
    sides = {"contained": (first, last), "intersecting": (last, first), "started": (first, first)}
    if mode not in sides:
        raise ValueError(f"mode must be one of {', '.join(sides)}, not {mode!r}")
    low, high = sides[mode]
    inside = F.lit(True)
    if start is not None:
        inside &= low >= start
    if end is not None:
        inside &= high <= end
    return log.keep(log.cases.where(inside))


def by_case_length(log: EventLog, least: int = 0, most: int | None = None) -> EventLog:
    fits = F.col("event_count") >= least
    return log.keep(log.cases.where(fits if most is None else fits & (F.col("event_count") <= most)))


def where(log: EventLog, condition: Column | str) -> EventLog:
    """Cases for which a condition over ``case_id, events, start_ts, end_ts, event_count, attrs, duration_s`` holds."""
    return log.keep(log.traces().where(condition))
