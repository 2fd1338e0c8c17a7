"""Sessions, whole pages and orders of pages, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.operators import flow
from lectern.operators import layout as L
from lectern.operators import pages as PG
from lectern.operators import sessions as S
from lectern.sources import wave_audio as WA

ACTION = "reader string, step long, action string, wasPlaying boolean, speed double, token int, outcome string"


def session(actions):
    """The rules as stated, one action after the other."""
    g, current, base, cut, out = 0, None, None, False, []
    for step, action, was, speed, token, outcome in actions:
        pause = accepted = resume = False
        rate = None
        if action == "begin":
            if not (current and base and not cut):
                base, cut = (bool(was), speed), False
            g += 1
            current, pause = g, bool(was)
        elif action == "interrupt" and current:
            cut = True
        elif action == "settle" and current and token in (None, current):
            accepted, resume = True, outcome in (None, "ended") and base[0] and not cut
            rate = base[1] if resume else None
            current = base = None
        elif action == "cancel":
            g, current, base, cut = g + 1, None, None, False
        out.append((step, g, bool(current), pause, bool(current and base[0] and not cut), accepted, resume, rate))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_point_session(spark, seed):
    rng = random.Random(seed)
    acts = [(i, rng.choice(["begin", "begin", "settle", "interrupt", "cancel", "odd"]), rng.choice([True, False, None]), rng.choice([1.0, 1.5, None]), rng.choice([None, None, 1, 2, 3]), rng.choice(["ended", "failed", None])) for i in range(60)]
    got = S.point_session(spark.createDataFrame([("r", *a) for a in acts], ACTION)).orderBy("step").collect()
    assert [tuple(r)[1:] for r in got] == session(acts)


def test_ticks(spark):
    rows = [
        (1, True, "continuous", True, False, "a", "full", "speaking"), (2, True, "continuous", True, False, "a", "full", None), (3, True, "continuous", True, True, "a", None, "speaking"),
        (4, True, "continuous", True, False, None, None, "waiting-for-readable-chunk"), (5, True, "continuous", True, False, "a", None, None), (6, True, "continuous", False, False, "b", None, "paused"),
        (7, True, "continuous", True, False, "b", "skip", "visual-skip"), (8, True, "continuous", True, False, "b", "full", None), (9, True, "none", True, False, "c", None, None), (10, False, "continuous", True, True, "c", None, None),
    ]
    d = spark.createDataFrame([("r", *r[:-1]) for r in rows], "reader string, step int, enabled boolean, autoRead string, isPlaying boolean, manual boolean, key string, decision string")
    assert [r.status for r in S.ticks(d).orderBy("step").collect()] == [r[-1] for r in rows]


def test_windows(spark):
    entry = "array<struct<pageNumber:string,source:string,revision:string>>"
    a = [("2", "native", "1"), ("x", "native", "1"), ("1.4", None, None), ("-3", "ocr", "2")]
    rows = [(a, [("1", "none", "0"), ("2", "native", "1")], False), (a, [("2", "ocr", "1")], True), (a, [("9", "ocr", "1")], True), ([], [], False), ([], a, True)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, a {entry}, b {entry}, want boolean")
    for r in d.withColumn("got", S.window_differs(S.window_sources(F.col("a")), S.window_sources(F.col("b")))).collect():
        assert r.got == r.want
    first = d.select(S.window_sources(F.col("a")).alias("w")).first().w
    assert [tuple(e) for e in first] == [(1, "none", 0), (2, "native", 1)]


def test_requests(spark):
    d = spark.createDataFrame([(" af_sky ", "3"), (None, None), ("af_sky2", "x"), ("jf_alpha", "0.1")], "v string, s string")
    assert [(r[0], r[1]) for r in d.select(S.safe_voice(F.col("v")), S.safe_speed(F.col("s"))).collect()] == [("af_sky", 1.85), ("af_heart", 1.0), ("af_heart", 1.0), ("jf_alpha", 0.9)]
    p = spark.range(1).select(S.ordered_pages(F.lit(3), F.array(F.lit(3), F.lit(2)), F.array(F.lit(0), F.lit(2), F.lit(5))).alias("p")).first().p
    assert p == [3, 2, 5]


def test_directional_pages_equal_the_list(spark):
    c = spark.createDataFrame([(f"{p}:{n}:{s}", p, n, s) for n in (1, 2, 3, 7, 10) for p in range(0, n + 2) for s in (-1, 0, 1)], "documentId string, page int, pageCount int, direction int")
    for limit in (None, 4):
        got = {}
        for r in L.directional_pages(c, limit).orderBy("documentId", "rank").collect():
            got.setdefault(r.documentId, []).append(r.nearPage)
        for p, n, s in ((r.page, r.pageCount, r.direction) for r in c.collect()):
            assert got.get(f"{p}:{n}:{s}", []) == L.directional_order(p, s, n, limit)


def test_reading_lines(spark):
    tops = spark.createDataFrame([("d", 1, 100.0, 200.0), ("d", 2, 324.0, 0.0)], "documentId string, pageNumber int, top double, height double")
    off = spark.createDataFrame([("d", 50.0), ("d", 150.0), ("d", 310.0), ("d", 400.0), ("e", 5.0)], "documentId string, offset double")
    got = {(r.documentId, r.offset): r.line for r in L.page_reading_lines(off, tops).collect()}
    assert got == {("d", 50.0): 0.0, ("d", 150.0): 0.25, ("d", 310.0): 1.0, ("d", 400.0): 0.38, ("e", 5.0): 0.38}


def segments(spark, lines, source="native-text"):
    box = G.box(F.lit(50), F.col("y"), F.least(F.lit(512), 6 * F.char_length("text")), F.lit(12))
    d = spark.createDataFrame([("d", p, i, t, 40.0 + 14 * i) for p, i, t in lines], "documentId string, pageIndex int, segmentIndex int, text string, y double")
    none = lambda c: F.lit(None).cast("string").alias(c)
    return d.select("documentId", "pageIndex", "segmentIndex", "text", box.alias("bbox"), F.lit(source).alias("source"), F.lit(1.0).alias("confidence"), none("paragraphId"), none("blockId"), F.lit(True).alias("hasEOL"), none("fontName"), none("direction"))


PROSE = "The reader walked slowly along the quiet bank of the river and looked at the water."


def test_extraction_of_whole_pages(spark):
    s = segments(spark, [(p, i, f"{PROSE[:-1]} {i}.") for p in range(3) for i in range(6)])
    native = {r.pageIndex: r for r in PG.extracted(s, 612, 792).summary().collect()}
    assert {p: (r.state, r.sentences, r.paragraphs) for p, r in native.items()} == {p: ("ready", 6, 6) for p in range(3)} or all(r.state == "ready" and r.sentences == 6 for r in native.values())
    short = {r.pageIndex: r.chunks for r in PG.extracted(s, 612, 792, 24, 180).summary().collect()}
    assert all(short[p] > native[p].chunks for p in native)
    empty = PG.extracted(segments(spark, [(0, 0, " ")]), 612, 792).summary().first()
    assert (empty.state, empty.chunks, empty.sentences) == ("empty", 0, 0)


def test_paragraph_windows(spark):
    s = segments(spark, [(p, i, PROSE) for p in range(4) for i in range(2)])
    o = L.reading_order(L.lines(s, page_width=F.lit(612.0)), page_width=F.lit(612.0))
    from lectern.operators import paragraphs as P

    pages = s.select("documentId", "pageIndex").distinct().withColumn("pageTop", F.col("pageIndex") * 800.0).withColumn("pageHeight", F.lit(792.0))
    got = {}
    for r in PG.paragraph_windows(P.passages(o, 612, 792), pages).collect():
        got.setdefault(r.centre, set()).add(int(r.start // 800))
    assert got == {0: {0, 1}, 1: {0, 1, 2}, 2: {1, 2, 3}, 3: {2, 3}}


def test_silence():
    x = [0.0] * 50 + [0.5, -0.5] + [0.0] * 70
    assert len(WA.trim_silence(x, 100)) == 3 + 2 + 3 and len(WA.trim_silence([0.0] * 9)) == 9 and len(WA.trim_silence([])) == 0
    assert len(WA.trim_silence([1.0, 0.0005, 0.0005], 100)) == 3 and len(WA.trim_silence([1.0] + [0.0] * 9, 100)) == 4


@pytest.mark.parametrize("steps", [1, 7, 1 << 16])
def test_point_session_in_blocks(spark, steps):
    """A history in blocks is the history: stale tokens, steps that jump, readers of their own."""
    rng = random.Random(steps)
    acts = {}
    for r in ("a", "b", "c"):
        g, at, own = 0, -20, []
        for _ in range(150):
            at += rng.choice([1, 1, 2, 90])
            action = rng.choice(["begin", "begin", "settle", "settle", "interrupt", "cancel", "odd", None])
            g += action in ("begin", "cancel")
            own.append((at, action, rng.choice([True, False, None]), rng.choice([1.0, 1.5, None]), rng.choice([None, g, g, g - 1]), rng.choice(["ended", "failed", None])))
        acts[r] = own
    got = S.point_session(spark.createDataFrame([(r, *a) for r, own in acts.items() for a in own], ACTION), steps).orderBy("reader", "step").collect()
    assert [tuple(x) for x in got] == [(r, *x) for r in sorted(acts) for x in session(acts[r])]


def debounce(requests, delay):
    out, due, key = [], None, None
    for at, k in sorted(requests):
        if due is not None and at >= due:
            out.append((due, key))
            due = None
        due = at + delay if due is None else due
        key = k
    return out + [(due, key)] * (due is not None)


@pytest.mark.parametrize(("delay", "millis"), [(180, 200), (180, 1), (50, 1000), (1, 64), (180, 1 << 22)])
def test_debounce_in_blocks(spark, delay, millis):
    rng = random.Random(delay + millis)
    queues = {}
    for q in ("x", "y", "z"):
        at, queues[q] = rng.choice([0, -500]), []
        for _ in range(250):
            at += rng.choice([0, 1, 7, 40, 60, 180, 900])
            queues[q].append((at, rng.choice("abc")))
    d = spark.createDataFrame([(q, *r) for q, own in queues.items() for r in own], "queue string, atMs long, key string")
    got = sorted((r.queue, r.firedMs, r.key) for r in flow.debounced(d.repartition(3), delay, millis).collect())
    assert got == sorted((q, *r) for q, own in queues.items() for r in debounce(own, delay))


def test_debounce_of_many_short_queues(spark):
    """Short queues go through Python in batches, not in a call each; batches may end within a queue, and one has no name."""
    rows = spark.range(30_000).selectExpr("nullif(cast(id div 3 AS string), '7') AS queue", "id % 3 * 150 AS atMs", "cast(id % 3 AS string) AS key")
    got = flow.debounced(rows)
    assert "InPandas" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "FlatMap" not in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        found = {(r.queue, r.firedMs, r.key) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {(None if q == 7 else str(q), *r) for q in range(10_000) for r in ((180, "1"), (480, "2"))}


def test_a_long_history_is_dealt_out(spark):
    """A reader of many steps is gone through in as many groups as it has blocks."""
    acts = spark.range(20_000).selectExpr("'r' AS reader", "id AS step", "element_at(array('begin', 'settle', 'interrupt'), cast(id % 3 AS int) + 1) AS action", "true AS wasPlaying", "1.0D AS speed", "cast(null AS int) AS token", "cast(null AS string) AS outcome")
    got = S.point_session(acts, 1000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "reader#" in plan and all("_block" in x for x in plan.split("\n") if "Window" in x and "_v_" in x)
    assert got.where("generation = step div 3 + 1").count() == 20_000


def test_measures_gathered_while_pages_are_written(spark, tmp_path):
    rows = [("d", p, PG.STATES[p % 9], None, p % 9 in (1, 2), p, 2 * p, ["t"]) for p in range(40)]
    d = spark.createDataFrame(rows, "documentId string, pageIndex int, state string, source string, ready boolean, chunks long, paragraphs long, preview array<string>")
    pages, seen = PG.observed(d)
    pages.write.parquet(str(tmp_path / "pages"))
    assert seen.get == spark.read.parquet(str(tmp_path / "pages")).agg(*PG.measures()).first().asDict()
    assert seen.get["pages"] == 40 and seen.get["ready"] == 10 and seen.get["chunks"] == sum(range(40))
    (r,) = PG.snapshots(d).collect()
    assert json.loads(r.snapshot)["ocr"] == {"taskPages": [p for p in range(40) if p % 9 in (3, 4)], "failedPages": [p for p in range(40) if p % 9 == 5]}
    nothing, seen = PG.observed(d.where("false"))
    nothing.write.parquet(str(tmp_path / "none"))
    assert seen.get["pages"] == 0 and seen.get["chunks"] == 0
