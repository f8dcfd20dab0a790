"""Spans of runs as a stream: begins and ends are paired by a stateful operator, with timers for those that never meet.

Events: run_id, span_id, kind (began or ended), stage, ts, error (null if the stage went well). A span is known by run_id and
span_id. Its first begin and its first end count, in whatever order they arrive; when both are there the span is emitted and its
state goes. A half that has waited `patience` of event time is emitted as lost, and its state goes too. Events that
are later than the stated delay are left out, as they would be by any windowed aggregation. A table of all events
gives the same rows, but that every half without a partner is lost at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SPAN = "run_id string, span_id string, stage string, began timestamp, ended timestamp, seconds double, status string"
#: What the operator keeps of a span's half.
HALF = "kind string, stage string, ts timestamp, error string"


def _span(run_id: str, span_id: str, halves: dict[str, tuple]) -> tuple:
    """A row of SPAN from (stage, ts, error) by kind."""
    began, ended = halves.get("began"), halves.get("ended")
    status = "lost" if began is None or ended is None else "ok" if ended[2] is None else "failed"
    seconds = None if status == "lost" else (ended[1] - began[1]).total_seconds()
    return run_id, span_id, (began or ended)[0], began and began[1], ended and ended[1], seconds, status


class _Pairing(StatefulProcessor):
    def __init__(self, patience: timedelta):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.half = handle, handle.getValueState("half", HALF)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        halves = {}
        if self.half.exists():
            kind, *rest = self.half.get()
            halves[kind] = tuple(rest)
        for pdf in rows:
            for kind, stage, ts, error in pdf.sort_values("ts")[["kind", "stage", "ts", "error"]].itertuples(index=False):
                if kind not in halves or halves[kind][1] > ts:
                    halves[kind] = (stage, ts, None if pd.isna(error) else error)
        if len(halves) == 2:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.half.clear()
            yield pd.DataFrame([_span(*key, halves)], columns=[x.split()[0] for x in SPAN.split(", ")])
        elif halves:
            ((kind, (stage, ts, error)),) = halves.items()
            if not self.half.exists():
                self.handle.registerTimer(int((pd.Timestamp(ts) + self.patience).timestamp() * 1000))
            self.half.update((kind, stage, pd.Timestamp(ts).to_pydatetime(), error))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.half.exists():
            kind, *rest = self.half.get()
            self.half.clear()
            yield pd.DataFrame([_span(*key, {kind: tuple(rest)})], columns=[x.split()[0] for x in SPAN.split(", ")])

    def close(self) -> None:
        pass


def paired(events: DataFrame, delay: str = "10 minutes", patience: timedelta = timedelta(hours=1)) -> DataFrame:
    """(run_id, span_id, stage, began, ended, seconds, status: ok, failed or lost) of a stream or table of events.

    A stream needs a state store that knows column families (the RocksDB provider).
    """
    rows = events.select("run_id", "span_id", "kind", "stage", F.col("ts").cast("timestamp").alias("ts"), "error").where(F.col("kind").isin("began", "ended") & F.col("ts").isNotNull())
    if events.isStreaming:
        return rows.withWatermark("ts", delay).groupBy("run_id", "span_id").transformWithStateInPandas(_Pairing(patience), SPAN, "Append", "EventTime")
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("ts", "stage", "error")))
    g = rows.groupBy("run_id", "span_id").agg(first("began").alias("b"), first("ended").alias("e"))
    both = F.col("b").isNotNull() & F.col("e").isNotNull()
    status = F.when(~both, "lost").when(F.col("e.error").isNull(), "ok").otherwise("failed")
    seconds = F.when(both, _seconds(F.col("e.ts")) - _seconds(F.col("b.ts")))
    return g.select("run_id", "span_id", F.coalesce("b.stage", "e.stage").alias("stage"), F.col("b.ts").alias("began"), F.col("e.ts").alias("ended"), F.round(seconds, 6).alias("seconds"), status.alias("status"))


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def stage_summary(spans: DataFrame) -> DataFrame:
    """(stage, n, failed, lost, mean) of paired spans."""
    count = lambda status: F.count_if(F.col("status") == status)
    return spans.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), count("failed").alias("failed"), count("lost").alias("lost"), F.round(F.avg("seconds"), 6).alias("mean"))


def sessions(events: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(run_id, start, end, events): stretches of a run without a pause of `gap`."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    g = rows.groupBy(F.session_window("ts", gap).alias("w"), "run_id").agg(F.count(F.lit(1)).alias("events"))
    return g.select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
