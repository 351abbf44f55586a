"""Event logs that grow: Structured Streaming from arriving files to canonical events, edges of the graph, and counts by windows of time.

An extension beyond batch logs.  A case's events are a list in the state store, to which a batch only appends: what is
written follows the events that arrive, not the length of cases.  The state store must be RocksDB (``use_rocksdb``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.expr import activity_rank
from ..schema import RAW

_OUT = "case_id string, pos int, activity string, ts_s bigint, resource string, value_cents bigint, tie_broken boolean"
_CHANGES = "case_id string, src string, dst string, delta bigint"
#: An event in the state: what orders it, and what is told of it.
_EVENT = "ts_s bigint, sort_hint bigint, rank bigint, arrival bigint, activity string, resource string, value_cents bigint"
_COLUMNS = [c.split(" ")[0] for c in _EVENT.split(", ")]


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that lists and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _timed(raw: DataFrame, ranks: Mapping[str, int], late: str) -> DataFrame:
    whole = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    events = raw.select(
        "case_id", whole(F.col("ts_s")).alias("ts_s"), whole(F.col("sort_hint")).alias("sort_hint"), activity_rank(F.col("activity"), ranks).alias("rank"),
        whole(F.col("arrival")).alias("arrival"), "activity", F.coalesce("resource", F.lit("")).alias("resource"), whole(F.col("value_cents")).alias("value_cents"),
    )
    return events.withColumn("event_time", F.timestamp_seconds("ts_s")).withWatermark("event_time", late)


def _tuples(f: pd.DataFrame) -> list[tuple]:
    return list(zip(*[f[c].tolist() for c in _COLUMNS], strict=True))


class _Cases(StatefulProcessor):
    """Appends events; a timer, set anew by each batch, emits the case in order once it has been quiet."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.events = handle, handle.getListState("events", _EVENT)
        self.latest = handle.getValueState("latest", "ts_s bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = self.latest.get()[0] if self.latest.exists() else None
        for f in rows:
            self.events.appendList(_tuples(f))
            latest = int(f["ts_s"].max()) if latest is None else max(latest, int(f["ts_s"].max()))
        self.latest.update((latest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(latest * 1000 + self.quiet_ms, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = sorted(tuple(r) for r in self.events.get())
        self.events.clear()
        self.latest.clear()
        tied = [i > 0 and r[:2] == rows[i - 1][:2] for i, r in enumerate(rows)]
        yield pd.DataFrame(
            [(key[0], i, r[4], r[0], r[5], r[6], t) for i, (r, t) in enumerate(zip(rows, tied, strict=True))],
            columns=["case_id", "pos", "activity", "ts_s", "resource", "value_cents", "tie_broken"],
        )

    def close(self) -> None:
        pass


class _Edges(StatefulProcessor):
    """Appends events and tells which edges of the case came, and which went as an event came between."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", _EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = sorted(tuple(r) for r in self.events.get()) if self.events.exists() else []
        new = [t for f in rows for t in _tuples(f)]
        self.events.appendList(new)
        change = Counter(_steps(sorted(before + new)))
        change.subtract(_steps(before))
        told = [(key[0], a, b, n) for (a, b), n in sorted(change.items()) if n]
        yield pd.DataFrame(told, columns=["case_id", "src", "dst", "delta"])

    def close(self) -> None:
        pass


def _steps(rows: list[tuple]) -> list[tuple[str, str]]:
    return [(a[4], b[4]) for a, b in zip(rows, rows[1:], strict=False)]


def read_arriving(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Raw events from Parquet files that arrive in a folder."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def canonical_stream(raw: DataFrame, ranks: Mapping[str, int], quiet: str = "1 hour") -> DataFrame:
    """Canonical events of cases that have been quiet for the given event time; append mode.

    The state of a case is its events so far, so memory on disk follows the cases that are open.  An event later than the
    watermark is dropped by Spark and doesn't change a case that was emitted.
    """
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    return _timed(raw, ranks, quiet).groupBy("case_id").transformWithStateInPandas(_Cases(quiet_ms), _OUT, "Append", "EventTime")


def edge_changes(raw: DataFrame, ranks: Mapping[str, int], late: str = "1 hour") -> DataFrame:
    """Changes of directly-follows counts as events arrive, in any order: an event between two others takes their edge back.

    Sums of ``delta`` are the counts of the graph at any time.  Events later than the watermark are dropped.
    """
    return _timed(raw, ranks, late).groupBy("case_id").transformWithStateInPandas(_Edges(), _CHANGES, "Append", "EventTime")


def live_edges(changes: DataFrame) -> DataFrame:
    """``src, dst, n``: the counts that changes add up to; edges that all went are left out."""
    return changes.groupBy("src", "dst").agg(F.sum("delta").alias("n")).where("n <> 0")


class Progress(StreamingQueryListener):
    """What running queries report after each batch: name, batch, rows read, rows a second, rows in state."""

    def __init__(self):
        self.batches: list[dict] = []
        self.failed: list[str] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed.append(event.exception)


def windowed_activity(raw: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of activities by tumbling windows of event time; late events count until the watermark passes."""
    timed = raw.withColumn("event_time", F.timestamp_seconds("ts_s")).withWatermark("event_time", late)
    counts = timed.groupBy(F.window("event_time", width), "activity").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "activity", "n")
