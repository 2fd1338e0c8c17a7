"""Paragraph flow and crossing counts over streams of readings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.flow import ACTIONS, Course, Passage, State, advance

PASSAGE = "key string, lead string, start double, end double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FlowProcessor(StatefulProcessor):
    """One reader's flow as keyed state: where it is and what is prepared (a value), the passages played or dropped and
    when (a map, at most `most` of them), the passages of its document (a list, from the initial state). A step is read
    in order: one that isn't later than the last step handled is late and changes nothing. With idle_ms a timer takes the
    place and the handled passages away after so long without a reading; the document's passages stay."""

    def __init__(self, idle_ms: int | None = None, ordered: bool = False, most: int = State.most):
        self.idle_ms, self.ordered, self.most = idle_ms, ordered, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "context string, position double, prepared string, step long, n long")
        self.handled = handle.getMapState("handled", "key string", "n long")
        self.course = handle.getListState("course", PASSAGE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = [(r.key, r.lead, float(r.start), float(r.end)) for r in initialState.itertuples()]
        if rows:
            self.course.appendList(rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        context, position, prepared, last, n = self.place.get() if self.place.exists() else (None, None, None, None, 0)
        before = dict((k[0], v[0]) for k, v in self.handled.iterator()) if self.handled.exists() else {}
        state = State(context, position, prepared, sorted(before, key=before.get), self.most)
        course = Course(sorted((Passage(*p) for p in (self.course.get() if self.course.exists() else ())), key=lambda p: (p.start, p.end, p.key)))
        out = []
        batches = rows if self.ordered else [pd.concat(list(rows)).sort_values("step")]  # a trigger's rows come as they may
        for r in (r for b in batches for r in b.itertuples()):
            if last is not None and r.step <= last:
                continue
            last = r.step
            state, found = advance(state, r.context, None if pd.isna(r.position) else r.position, bool(r.playing), course, r.ready, bool(r.jumped))
            out += [(key[0], r.step, a["type"], a["key"], a["reason"]) for a in found]
        for k in before.keys() - set(state.handled):
            self.handled.removeKey((k,))
        for k in state.handled:
            if k not in before:
                n += 1
                self.handled.updateValue((k,), (n,))
        self.place.update((state.context, state.position, state.prepared, None if last is None else int(last), n))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["reader", "step", "type", "key", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.place.clear()
        self.handled.clear()
        yield pd.DataFrame([], columns=["reader", "step", "type", "key", "reason"])

    def close(self) -> None:
        pass


def actions(readings: DataFrame, passages: DataFrame | dict[str, list[tuple[str, str | None, float, float]]], idle_ms: int | None = None) -> DataFrame:
    """Actions of paragraph flow for a stream or a table of readings (reader, step, context, position, playing, ready,
    jumped). passages: a table (reader, key, lead, start, end) as it is when the query first starts, or a few of them as
    (key, lead, start, end) by reader. Each reader's passages are read into its state once, not joined to its readings.
    A query with idle_ms runs batches without data for its timers, so it needs a continuous trigger."""
    spark = readings.sparkSession
    if not isinstance(passages, DataFrame):
        rows = [(reader, *p) for reader, own in passages.items() for p in own]
        passages = spark.createDataFrame(rows, f"reader string, {PASSAGE}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the store that has timers and maps
    known = passages.select("reader", "key", "lead", "start", "end").groupBy("reader")
    ordered = not readings.isStreaming
    if ordered:  # a table is read in batches of a reader's steps, however many there are
        readings = readings.repartition("reader").sortWithinPartitions("reader", "step")
    return readings.groupBy("reader").transformWithStateInPandas(FlowProcessor(idle_ms, ordered), ACTIONS, "Append", "ProcessingTime" if idle_ms else "None", initialState=known)


def on_time(events: DataFrame, at: str, deadline: str, grace_ms: int = 120) -> DataFrame:
    """Events that arrive by their deadline and its grace; the rest is late and goes."""
    return events.where(F.col(at) <= F.col(deadline) + F.expr(f"INTERVAL {grace_ms} MILLISECONDS"))


def activity(events: DataFrame, at: str = "ts", every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Readings a window and kind, with a watermark: late rows beyond it are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
