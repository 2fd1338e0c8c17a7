"""Paragraph flow: which paragraph to prepare, play or drop as a reading position moves on.

advance() is the step function; batch folds it over each reader's rows in order, streaming.paragraph_flow keeps its
state. crossings() and contexts() are the parts that need no fold.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import runs

@dataclass
class State:
    context: str | None = None
    position: float | None = None
    prepared: str | None = None
    handled: list[str] = field(default_factory=list)
    most: int = 512


@dataclass(frozen=True)
class Passage:
    key: str
    lead: str | None
    start: float
    end: float


class Course:
    """A reader's passages in order, and their edges in the order in which they are passed: ends before starts."""

    def __init__(self, passages: list[Passage]):
        self.passages = passages
        self.edges = sorted([(p.start, 1, i) for i, p in enumerate(passages)] + [(p.end, 0, i) for i, p in enumerate(passages)])
        self.places = [e[0] for e in self.edges]

    def passed(self, before: float, at: float) -> list[tuple[float, int, int]]:
        return self.edges[bisect_right(self.places, before) : bisect_right(self.places, at)]


def _target(passages: list[Passage], i: int) -> Passage | None:
    return passages[i] if i < len(passages) and passages[i].lead else None


def _at_start(passages: list[Passage], position: float) -> Passage | None:
    """What to prepare when a context begins: the paragraph after the one under the position, or the next one (but not
    the first)."""
    inside = next((i for i, p in enumerate(passages) if p.start <= position < p.end), None)
    if inside is not None:
        return _target(passages, inside + 1)
    coming = next((i for i, p in enumerate(passages) if p.start > position), 0)
    return _target(passages, coming) if coming else None


def advance(state: State | None, context: str, position: float | None, playing: bool, course: Course | list[Passage], ready: str | None = None, jumped: bool = False) -> tuple[State, list[dict]]:
    """The next state and the actions (type, key, reason). Ends are handled before starts at the same place; a paragraph
    is played or dropped once; moving back repeats nothing."""
    course = course if isinstance(course, Course) else Course(course)
    passages = course.passages
    s = State(state.context, state.position, state.prepared, list(state.handled), state.most) if state else State()
    at = position if position is not None else (s.position or 0.0)
    out: list[dict] = []

    def drop(key, reason):
        out.append({"type": "discard-prepared", "key": key, "reason": reason})

    def prepare(p):
        out.append({"type": "prepare", "key": f"{p.key}:lead", "reason": None})
        s.prepared = f"{p.key}:lead"

    if s.context != context:
        if s.prepared:
            drop(s.prepared, "context-changed")
        s.context, s.position, s.prepared, s.handled = context, at, None, []
        if playing and not jumped and (p := _at_start(passages, at)):
            prepare(p)
        return s, out
    if not playing or jumped:
        if s.prepared:
            drop(s.prepared, "jumped" if jumped else "paused")
        s.prepared, s.position = None, at
        return s, out
    before, s.position = s.position, at
    if before is None or at <= before:
        return s, out
    for _, start, i in course.passed(before, at):
        p = _target(passages, i + 1)
        if not p or p.key in s.handled:
            continue
        key = f"{p.key}:lead"
        if start:
            if s.prepared and s.prepared != key:
                drop(s.prepared, "target-changed")
                s.prepared = None
            if s.prepared != key:
                prepare(p)
        else:
            if s.prepared == key and ready == key:
                out.append({"type": "play-prepared", "key": key, "reason": None})
            else:
                drop(key, "late-or-missing")
            s.prepared = None
            s.handled = list(dict.fromkeys([*s.handled, p.key]))[-s.most :]
    return s, out


ACTIONS = "reader string, step long, type string, key string, reason string"


def fold(readings: DataFrame, passages: DataFrame) -> DataFrame:
    """readings: reader, step, context, position, playing, ready, jumped; passages: reader, key, lead, start, end (those
    of the reader's document). One row for each action: the stream's processor over a table, which it reads in order."""
    from ..streaming.paragraph_flow import actions

    return actions(readings, passages)


def swept(places: DataFrame, at: DataFrame, order: list[str], counts: dict[str, Column]) -> DataFrame:
    """One ordered stream of each reader's places (reader, place, what is in `order`) and positions (reader, place):
    every row with the running counts up to it, places before positions that are equal. `position` tells them apart."""
    both = places.withColumn("position", F.lit(False)).unionByName(at.withColumn("position", F.lit(True)), allowMissingColumns=True)
    w = W.partitionBy("reader").orderBy("place", "position", *order).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumns({k: F.sum(F.when(~F.col("position") & c, 1).otherwise(0)).over(w) for k, c in counts.items()})


def crossings(readings: DataFrame, passages: DataFrame) -> DataFrame:
    """Starts and ends that each forward step of a reader passes, ends before starts at the same place.

    Edges and positions are swept once: an edge gets its number along the reader's axis, a position the number of edges
    up to it. A step passes the numbers between its two positions, and looks up just these, whatever else the reader has."""
    ends = F.array(F.struct(F.col("start").alias("place"), F.lit(1).alias("starts")), F.struct(F.col("end").alias("place"), F.lit(0).alias("starts")))
    edges = passages.select("reader", "key", F.explode(ends).alias("e")).select("reader", "key", "e.*").where("place IS NOT NULL")
    own = swept(edges, readings.where("position IS NOT NULL").select("reader", "step", F.col("position").alias("place")), ["starts", "key"], {"n": F.lit(True)})
    w = W.partitionBy("reader").orderBy("step")
    lost = readings.where("position IS NULL").select("reader", "step", F.lit(None).cast("double").alias("place"), F.lit(None).cast("long").alias("n"))
    steps = own.where("position").select("reader", "step", "place", "n").unionByName(lost)  # a step from or to nowhere passes nothing
    steps = steps.select("reader", "step", "place", "n", F.lag("place").over(w).alias("before"), F.lag("n").over(w).alias("passed"))
    steps = steps.where("place > before AND n > passed").select("reader", "step", "passed", F.explode(F.sequence(F.col("passed") + 1, F.col("n"))).alias("n"))
    found = own.where("NOT position").select("reader", "n", "key", F.when(F.col("starts") == 1, "start").otherwise("tail").alias("edge"), "place")
    return steps.join(found, ["reader", "n"]).select("reader", "step", "key", "edge", "place", (F.col("n") - F.col("passed") - 1).cast("int").alias("ordinal"))


def contexts(moves: DataFrame) -> DataFrame:
    """moves: reader, step, generation, pageNumber, source. Adds the content revision and context key: the revision grows
    with a turn to a page other than the same or the next, or with a changed source of the same page, and starts anew
    with a generation."""
    w = W.partitionBy("reader").orderBy("step")
    p = lambda c: F.lag(c).over(w)
    same = p("generation") == F.col("generation")
    moved = ((F.col("pageNumber") != p("pageNumber")) & (F.col("pageNumber") != p("pageNumber") + 1)) | ((F.col("pageNumber") == p("pageNumber")) & (F.col("source") != p("source")))
    d = moves.withColumn("_new", F.coalesce(~same, F.lit(True)).cast("int")).withColumn("_moved", F.coalesce(same & moved, F.lit(False)).cast("int"))
    d = d.withColumn("_session", F.sum("_new").over(w))
    d = d.withColumn("contentRevision", F.sum("_moved").over(W.partitionBy("reader", "_session").orderBy("step")))
    return d.withColumn("contextKey", F.concat_ws(":", F.col("generation").cast("string"), F.col("contentRevision").cast("string"))).drop("_new", "_moved", "_session")


def window_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after: reader, pageNumber, source, revision. Whether the pages that both windows hold differ; windows
    without a common page differ, two empty ones don't (and have no row)."""
    j = before.alias("a").join(after.alias("b"), ["reader", "pageNumber"], "full")
    both = F.col("a.source").isNotNull() & F.col("b.source").isNotNull()
    g = j.groupBy("reader").agg(F.count(F.when(both, 1)).alias("n"), F.bool_or(both & ((F.col("a.source") != F.col("b.source")) | (F.col("a.revision") != F.col("b.revision")))).alias("d"))
    return g.select("reader", ((F.col("n") == 0) | F.col("d")).alias("changed"))


def bootstrap(positions: DataFrame, passages: DataFrame) -> DataFrame:
    """positions: reader, positionId, position. The paragraph to prepare when a context begins there, or no row.

    Passages are numbered by start. Of those that begin up to a position the first that ends beyond it is the first whose
    running largest end does; so two counts along the reader's axis, of starts and of running largest ends, say which
    passage a position is in or before, and one lookup by number finds the target."""
    order = W.partitionBy("reader").orderBy("start", "end", "key")
    p = passages.withColumn("i", F.row_number().over(order)).withColumn("far", F.max("end").over(order.rowsBetween(W.unboundedPreceding, 0)))
    marks = p.select("reader", F.explode(F.array(F.struct(F.col("start").alias("place"), F.lit(True).alias("starts")), F.struct(F.col("far").alias("place"), F.lit(False).alias("starts")))).alias("e")).select("reader", "e.*")
    own = swept(marks, positions.where("position IS NOT NULL").select("reader", "positionId", F.col("position").alias("place")), [], {"begun": F.col("starts"), "over": ~F.col("starts")})
    target = F.when(F.col("over") < F.col("begun"), F.col("over") + 2).when(F.col("begun") > 0, F.col("begun") + 1)
    at = own.where("position").select("reader", "positionId", target.alias("i")).where("i IS NOT NULL")
    return at.join(p.where("lead <> ''").select("reader", "i", "key"), ["reader", "i"]).select("reader", "positionId", "key")


def debounced(requests: DataFrame, delay: int = 180, millis: int = runs.MILLIS) -> DataFrame:
    """requests: queue, atMs, key. Runs of a timer that the first request starts and later ones do not put off: the last
    key asked for within the delay. A repeated pending key changes nothing. A queue is dealt out in blocks of `millis`."""
    d = runs.timed(requests, delay, millis)
    return d.groupBy("queue", "firedMs").agg(F.max_by("key", F.struct("atMs", "key")).alias("key"))


def settled_changes(changes: DataFrame, delay: int = 260) -> DataFrame:
    """changes: queue, atMs, fromIndex, toIndex. One row for each run of changes with gaps under the delay: the first
    origin and the last goal, if they differ. (Here each change puts the timer off.)"""
    d = changes.where("fromIndex <> toIndex")
    w = W.partitionBy("queue").orderBy("atMs", "fromIndex", "toIndex")
    d = d.withColumn("_n", F.row_number().over(w)).withColumn("_new", F.coalesce((F.col("atMs") - F.lag("atMs").over(w) >= delay).cast("int"), F.lit(1)))
    d = d.withColumn("_run", F.sum("_new").over(w))
    g = d.groupBy("queue", "_run").agg(F.min_by("fromIndex", "_n").alias("fromIndex"), F.max_by("toIndex", "_n").alias("toIndex"), (F.max("atMs") + delay).alias("firedMs"))
    return g.where("fromIndex <> toIndex").drop("_run")


