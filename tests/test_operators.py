"""Golden cases of layout, chunks, paragraphs, sentences on the page, quality, picking, flow, history and sources."""

import json

import pytest

from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.operators import chunks as C
from lectern.operators import flow as FL
from lectern.operators import history as H
from lectern.operators import layout as L
from lectern.operators import paragraphs as P
from lectern.operators import picking as K
from lectern.operators import points as O
from lectern.operators import quality as Q
from lectern.sources import adapters as A
from lectern.sources import wave_audio as WA

ROW = "documentId string, pageIndex int, segmentIndex int, text string, bx double, by double, bw double, bh double, paragraphId string, source string"


def segs(spark, rows):
    """(page, text, x, y, width, height[, paragraph])"""
    data = [("book", r[0], i, r[1], *map(float, r[2:6]), r[6] if len(r) > 6 else None, "ocr" if len(r) > 6 else "native-text") for i, r in enumerate(rows)]
    d = spark.createDataFrame(data, ROW)
    return d.select(*A.segment(F.col("documentId"), F.col("pageIndex"), F.col("segmentIndex"), F.col("text"), G.box(F.col("bx"), F.col("by"), F.col("bw"), F.col("bh")), source=F.col("source"), paragraphId=F.col("paragraphId"), hasEOL=F.lit(True)))


def page(system="top-down"):
    return F.struct(F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.lit(system).alias("coordinateSystem"))


W600 = None


@pytest.fixture(autouse=True, scope="module")
def _width(spark):
    global W600
    W600 = F.lit(600.0)


def test_lines_join_and_gutters_split(spark):
    rows = [(0, "Collier", 50, 100, 60, 12), (0, "and", 115, 103, 30, 12), (0, "Bollen", 150, 98, 60, 12), (0, "second line", 50, 130, 200, 12), (0, "left", 50, 160, 230, 12), (0, "right", 320, 160, 230, 12)]
    got = L.lines(segs(spark, rows), page_width=W600).orderBy("lineIndex").collect()
    assert [(r.text, r.sourceSegmentIds) for r in got] == [("Collier and Bollen", [0, 1, 2]), ("second line", [3]), ("left", [4]), ("right", [5])]


def test_running_mean_drifts(spark):
    rows = [(0, f"t{i}", 10 + 45 * i, y, 40, 5) for i, y in enumerate([0, 8, 12, 13, 30])]
    assert [r.row for r in L.clustered(segs(spark, rows)).orderBy("segmentIndex").collect()] == [0, 0, 0, 0, 1]


def test_two_columns_read_left_first(spark):
    rows = [(0, f"{'LR'[s]}{i}", 50 + 280 * s, 100 + 20 * i, 200, 12) for i in range(4) for s in (0, 1)]
    d = L.reading_order(L.lines(segs(spark, rows), page_width=W600), page_width=W600).orderBy("readingIndex").collect()
    assert [r.text for r in d] == ["L0", "L1", "L2", "L3", "R0", "R1", "R2", "R3"] and {r.columnIndex for r in d} == {0, 1}


def test_chunks(spark):
    words = "This is a fairly long line of words that goes on for a while, up to here. " * 2
    rows = [(0, words.strip(), 50, 100, 400, 12), (0, "A para- ", 50, 120, 400, 12), (0, "graph follows this one. " * 6, 50, 140, 400, 12), (0, "- 12 -", 50, 700, 30, 12)]
    got = C.segments_to_chunks(segs(spark, rows), 120, 260, page()).orderBy("chunkIndex").collect()
    assert len(got) == 2 and got[0].sourceSegmentIds == [0] and got[1].sourceSegmentIds == [1, 2]
    assert got[1].text.startswith("A paragraph follows") and got[0].role == "body"
    assert C.segments_to_chunks(segs(spark, [(0, "x" * 500, 50, 10, 400, 12), (0, "y", 50, 30, 10, 12)]), 24, 180, page()).count() == 2


def test_repeated_headers_go(spark):
    rows = [(p, t, 50, 100 + 20 * i, 300, 12) for p in range(3) for i, t in enumerate(["CHAPTER ONE" if p < 2 else "Other", f"body line {'abc'[p]} of the page."])]
    s = segs(spark, rows)
    rep = C.repeated_lines(s, "pageIndex")
    assert [r.key for r in rep.collect()] == ["chapter one"]
    text = " ".join(r.text for r in C.segments_to_chunks(s, page=page(), repeated=rep).collect())
    assert "CHAPTER" not in text and "Other" in text


def test_paragraphs(spark):
    by_id = P.segments_to_paragraphs(segs(spark, [(0, "one", 50, 100, 500, 12, "p0"), (0, "two", 50, 114, 500, 12, "p0"), (0, "three", 50, 128, 500, 12, "p1")]), 600, 800).orderBy("paragraphIndex").collect()
    assert [r.text for r in by_id] == ["one two", "three"] and by_id[1].fragments[0].boundarySource == "ocr-paragraph"
    rows = [(0, "First line of the text", 50, 100, 500, 12), (0, "ends here.", 50, 114, 200, 12), (0, "Second paragraph starts", 50, 128, 500, 12), (0, "and goes on", 50, 142, 500, 12), (0, "to its end.", 50, 156, 500, 12)]
    short = P.segments_to_paragraphs(segs(spark, rows), 600, 800).orderBy("paragraphIndex").collect()
    assert len(short) == 2 and short[1].fragments[0].boundarySource == "short-terminal-line"
    cross = P.segments_to_paragraphs(segs(spark, [(0, "it goes on without an end", 50, 760, 500, 12), (1, "over the page. Then more.", 50, 30, 500, 12)]), 600, 800).collect()
    assert len(cross) == 1 and cross[0].crossPage and [(f.continuesFromPrevious, f.continuesOnNext) for f in cross[0].fragments] == [(False, True), (True, False)]
    assert cross[0].leadText == "it goes on without an end over the page."
    apart = P.segments_to_paragraphs(segs(spark, [(0, "it has an end.", 50, 760, 500, 12), (1, "next page.", 50, 30, 500, 12)]), 600, 800)
    assert apart.count() == 2
    pages = spark.createDataFrame([("book", 0, 1000.0, 400.0), ("book", 1, 1400.0, 400.0)], "documentId string, pageIndex int, pageTop double, pageHeight double")
    axis = P.on_scroll_axis(P.segments_to_paragraphs(segs(spark, [(0, "a line.", 50, 80, 500, 40)]), 600, 800), pages).first()
    assert (axis.start, axis.end) == (1040.0, 1060.0)


def test_sentences_on_the_page(spark):
    rows = [(0, "The first sentence runs over", 60, 100, 480, 16), (0, "two lines. A second one.", 60, 120, 480, 16)]
    t = O.sentence_targets(segs(spark, rows), 600, 800).orderBy("sentenceIndex").collect()
    assert [(r.text, len(r.fragments)) for r in t] == [("The first sentence runs over two lines.", 2), ("A second one.", 1)]
    assert all(r.speechKey.startswith("point:0:native-text:") for r in t)
    cjk = O.sentence_targets(segs(spark, [(0, "日本語の文", 60, 100, 200, 16), (0, "です。", 60, 120, 100, 16)]), 600, 800).first()
    assert cjk.text == "日本語の文です。" and cjk.role == "body"
    pts = spark.createDataFrame([("book", 0, 1, 0.2, 0.135), ("book", 0, 2, 0.9, 0.9), ("book", 0, 3, 0.7, 0.155)], "documentId string, pageIndex int, pointId int, x double, y double")
    got = {r.pointId: r.text for r in O.pick_at(pts, O.sentence_targets(segs(spark, rows), 600, 800)).collect()}
    assert got == {1: "The first sentence runs over two lines.", 3: "A second one."}


REC = "documentId string, pageIndex int, source string, ordinal int, text string, role string, confidence double"


def assess(spark, texts, source="native", confidence=1.0, box=True, lang=None):
    rows = [("d", 0, source, i, t, "body", confidence) for i, t in enumerate(texts)]
    b = G.box(F.lit(10), F.lit(20), F.lit(300), F.lit(18)) if box is True else F.when(F.col("ordinal") % 5 < box, G.box(F.lit(10), F.lit(20), F.lit(300), F.lit(18)))
    return Q.assess(spark.createDataFrame(rows, REC).withColumn("bbox", b), language_set=None if lang is None else F.lit(lang)).first()


PROSE = ["Plain prose that is long enough to count as a line.", "A second line with many ordinary words in it.", "And a third that ends the paragraph as well."]


def test_quality(spark):
    r = assess(spark, PROSE)
    assert r.state == "ready" and not r.reasonCodes and r.qualifiedProseLineCount == 3 and r.bboxCoverage == 1 and r.weightedConfidence is None
    assert assess(spark, ["  ", "\n"]).reasonCodes == ["no-text"]
    assert assess(spark, ["a" * 120 + "."]).state == "ready"
    assert assess(spark, ["a" * 27, "b" * 27, "c" * 26]).state == "ready" and "insufficient-prose" in assess(spark, ["a" * 27, "b" * 27, "c" * 25]).reasonCodes
    toc = ["Chapter ...... 12"] * 7
    assert "toc-heavy" in assess(spark, toc + PROSE * 4 + PROSE[:1]).reasonCodes and "toc-heavy" not in assess(spark, toc[:6] + PROSE * 4 + PROSE[:2]).reasonCodes
    assert "table-heavy" in assess(spark, ["12 34 56"] * 5 + PROSE + PROSE[:2]).reasonCodes
    assert "low-ocr-confidence" in assess(spark, PROSE, "ocr", 0.5).reasonCodes 
    mixed = [("d", 0, "ocr", i, t, "body", c) for i, (t, c) in enumerate([("a" * 30, 0.6)] * 3 + [("b" * 30, 0.4)])]
    assert Q.assess(spark.createDataFrame(mixed, REC).withColumn("bbox", G.box(F.lit(1), F.lit(1), F.lit(9), F.lit(9)))).first().state == "ready"
    assert "low-bbox-coverage" in assess(spark, ["x" * 30 + "."] * 5, box=3).reasonCodes and "low-bbox-coverage" not in assess(spark, ["x" * 30 + "."] * 5, box=4).reasonCodes
    assert "low-sentence-boundary-ratio" in assess(spark, ["日" * 60] * 3, "ocr", 0.9, lang="jpn+eng").reasonCodes


def test_pages_and_offsets(spark):
    lay = spark.createDataFrame([("d", i, 800.0) for i in (1, 2, 3)], "documentId string, pageNumber int, height double")
    lay = lay.withColumn("height", F.when(F.col("pageNumber") == 2, 1000.0).otherwise(F.col("height")))
    tops = L.page_tops(lay, 94, 24)
    assert [r.top for r in tops.orderBy("pageNumber").collect()] == [94.0, 918.0, 1942.0]
    off = spark.createDataFrame([("d", 0.0), ("d", 94.0), ("d", 918.0), ("d", 1e9), ("none", 5.0)], "documentId string, offset double")
    assert sorted((r.documentId, r.offset, r.pageNumber) for r in L.page_at(off, tops).collect()) == [("d", 0.0, 1), ("d", 94.0, 1), ("d", 918.0, 2), ("d", 1e9, 3), ("none", 5.0, 0)]
    assert L.directional_order(5, 1, 10, 7) == [5, 6, 4, 7, 3, 8, 9] and L.directional_order(0, 1, 5) == [] and sorted(L.directional_order(2, -1, 9)) == list(range(1, 10))


PS = [FL.Passage("p1", "One.", 100.0, 200.0), FL.Passage("p2", "Two.", 220.0, 320.0), FL.Passage("p3", "Three.", 340.0, 440.0)]


def run(*steps, passages=PS):
    s, out = FL.State(context="c", position=steps[0][0]), []
    for at, ready in steps[1:]:
        s, a = FL.advance(s, "c", at, True, passages, ready)
        out += [(x["type"].split("-")[0], x["key"].split(":")[0], x["reason"]) for x in a]
    return s, out


def test_flow():
    s, out = run((90, None), (110, None), (210, "p2:lead"))
    assert out == [("prepare", "p2", None), ("play", "p2", None)] and s.handled == ["p2"]
    assert run((90, None), (210, None))[1] == [("prepare", "p2", None), ("discard", "p2", "late-or-missing")]
    touching = [FL.Passage("a", "A.", 100, 200), FL.Passage("b", "B.", 200, 300), FL.Passage("c", "C.", 320, 420)]
    s = FL.State("c", 150, "b:lead")
    _, acts = FL.advance(s, "c", 210, True, touching, "b:lead")
    assert [(a["type"], a["key"]) for a in acts] == [("play-prepared", "b:lead"), ("prepare", "c:lead")]
    _, again = run((90, None), (430, None), (90, None), (430, None))
    assert [x[0] for x in again] == ["prepare", "discard", "prepare", "discard"]
    boot = lambda at: [a["key"] for a in FL.advance(None, "c", at, True, PS)[1]]
    assert boot(150) == ["p2:lead"] and boot(210) == ["p2:lead"] and boot(50) == [] and boot(999) == []
    s = FL.State("c", 150, "p2:lead")
    assert FL.advance(s, "c", 160, False, PS)[1][0]["reason"] == "paused" and FL.advance(s, "c", 160, True, PS, jumped=True)[1][0]["reason"] == "jumped"
    changed = FL.advance(s, "other", 150, True, PS)[1]
    assert [(a["type"], a["reason"]) for a in changed] == [("discard-prepared", "context-changed"), ("prepare", None)]


def test_debounce(spark):
    r = spark.createDataFrame([("q", 0, "a"), ("q", 100, "b"), ("q", 179, "c"), ("q", 300, "d")], "queue string, atMs long, key string")
    assert sorted((x.firedMs, x.key) for x in FL.debounced(r).collect()) == [(180, "c"), (480, "d")]
    c = spark.createDataFrame([("q", 0, 1, 2), ("q", 200, 2, 4), ("q", 900, 3, 2), ("q", 1000, 2, 3)], "queue string, atMs long, fromIndex int, toIndex int")
    assert [(x.fromIndex, x.toIndex, x.firedMs) for x in FL.settled_changes(c).collect()] == [(1, 4, 460)]


def test_streamed_flow_equals_batch(spark, tmp_path):
    rows = [("r", i, "c", float(p), True, None, False) for i, p in enumerate([90, 110, 210, 230, 330, 450])]
    schema = "reader string, step long, context string, position double, playing boolean, ready string, jumped boolean"
    ps = {"r": [(p.key, p.lead, p.start, p.end) for p in PS]}
    static = spark.createDataFrame([("r", *p) for p in ps["r"]], "reader string, key string, lead string, start double, end double")
    want = sorted(tuple(x) for x in FL.fold(spark.createDataFrame(rows, schema), static).collect())
    from lectern.streaming import paragraph_flow as S

    src = str(tmp_path / "in")
    for i in (0, 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(src)
    q = S.actions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), ps).writeStream.format("memory").queryName("acts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    got = sorted(tuple(x) for x in spark.sql("SELECT * FROM acts").collect())
    assert {g[2] for g in got} == {w[2] for w in want} and len(got) == len(want)


def test_history(spark):
    u = "fileName string, fileSize long, lastModified long, seq long, at string, lastPageIndex long, lastScrollTop double, progressRatio double, lastSpeedPxPerSecond double, lastBandKey string"
    r = H.document_updates(spark.createDataFrame([("a.pdf", 1, 0, 1, "t1", 3, -5.0, 2.0, 100.0, "long-day"), ("a.pdf", 1, 0, 2, "t2", None, None, 0.5, None, None)], u)).first()
    assert (r.openedAt, r.updatedAt, r.lastPageIndex, r.lastScrollTop, r.progressRatio, r.lastSpeedPxPerSecond) == ("t1", "t2", 3, 0.0, 0.5, 64)
    e = spark.createDataFrame([("d", 1, 20.0), ("d", 2, 30.0), ("d", 3, 25.0), ("d", 4, 30.0)], "documentId string, seq long, speed double")
    assert [(x.speed, x.seq) for x in H.rhythm_records(e).collect()] == [(30, 4)]


def test_policies(spark):
    asked = spark.createDataFrame([("winding-stream", True), ("snow-mist", True)], "tierKey string, enabled boolean")
    c = spark.createDataFrame([(0, "A HEADING", "heading"), (1, "body text (aside) here", "body"), (2, "note", "footnote")], "chunkIndex int, text string, role string")
    box = F.struct(F.lit(0.1).alias("x"), F.lit(0.4).alias("y"), F.lit(0.8).alias("width"), F.lit(0.1).alias("height"))
    c = c.withColumns({"documentId": F.lit("d"), "pageIndex": F.lit(0), "source": F.lit("native-text"), "priority": F.lit(1.0), "qualityFlags": F.array().cast("array<string>"), "normalizedBbox": box})
    got = sorted((r.tierKey, r.chunkIndex) for r in K.by_policy(c, K.resolve_policies(asked)).collect())
    assert got == [("snow-mist", 0), ("snow-mist", 1), ("snow-mist", 2), ("winding-stream", 1)]


def test_recognised_segments(spark):
    word = {"text": "|w|", "confidence": 90, "bbox": {"x0": 10, "y0": 5, "x1": 4, "y1": 9}}
    block = {"paragraphs": [{"lines": [{"text": "| line one |", "confidence": 80, "bbox": {"x0": 0, "y0": 0, "x1": 50, "y1": 10}, "words": [word]}]}]}
    flat = {"words": [{"symbols": [{"text": "a"}, {"text": "b"}], "left": 1, "top": 2, "width": 3, "height": 4}, {"text": "no box"}]}
    p = spark.createDataFrame([("d", 0, json.dumps({"data": {"blocks": [block]}})), ("d", 1, json.dumps(flat)), ("d", 2, "not json")], "documentId string, pageIndex int, result string")
    got = sorted((r.pageIndex, r.text, r.confidence, r.paragraphId, tuple(r.bbox)) for r in A.ocr_segments(p).collect())
    assert got == [(0, "line one", 0.8, "block:0:paragraph:0", (0.0, 0.0, 50.0, 10.0)), (1, "ab", 1.0, None, (1.0, 2.0, 3.0, 4.0))]
    w = A.ocr_segments(p, "words").where("pageIndex = 0").first()
    assert (w.text, tuple(w.bbox), w.blockId) == ("w", (4.0, 5.0, 6.0, 4.0), "block:0")


def test_page_items(spark):
    items = [{"str": " ", "transform": [1, 0, 0, 12, 5, 5]}, {"str": "Hi", "transform": [1.0, 0.0, 0.0, -12.0, 50.0, 700.0], "width": 20.0, "height": 0.0}]
    p = spark.createDataFrame([("d", 0, json.dumps(items))], "documentId string, pageIndex int, j string").select("documentId", "pageIndex", F.from_json("j", A.ITEMS).alias("items"))
    r = A.page_item_segments(p).collect()
    assert [(x.segmentIndex, x.text, tuple(x.bbox)) for x in r] == [(0, "Hi", (50.0, 700.0, 20.0, 12.0))]


def test_byte_ranges(spark):
    cases = {"bytes=0-99": (0, 99), "bytes=10-": (10, 999), "bytes=-100": (900, 999), "bytes=-5000": (0, 999), "bytes=990-2000": (990, 999), "bytes=1000-": None, "bytes=5-4": None, "bytes=-0": None, "bytes=-": None, "bytes=a-b": None, "items=0-1": None, "bytes=0-1,3-4": None}
    d = spark.createDataFrame([(k,) for k in cases] + [(None,)], "h string").select("h", A.byte_range(F.col("h"), F.lit(1000).cast("long")).alias("r")).collect()
    for r in d:
        if r.h is None:
            assert r.r is None
        else:
            assert (r.r.start, r.r.end) == cases[r.h] if cases[r.h] else not r.r.ok


def test_state(spark):
    raw = json.dumps({"createdAt": "t0", "preferences": {"ttsMode": "flow", "defaultSpeedPxPerSecond": 99, "recentDocumentLimit": 0, "rhythmPatternMode": "odd"}})
    d = spark.createDataFrame([(raw,), ("{broken",), (None,)], "raw string").select(A.read_state(F.col("raw"), F.lit("now")).alias("s")).collect()
    p = d[0].s.preferences
    assert (d[0].s.createdAt, p.ttsEnabled, p.defaultSpeedPxPerSecond, p.recentDocumentLimit, p.rhythmPatternMode) == ("t0", True, 64, 1, "soft")
    assert d[1].s.preferences.defaultSpeedPxPerSecond == 16 and d[1].s.createdAt == "now" and d[2].s.preferences.ttsEnabled is False


def test_waves(spark):
    a, b = WA.from_floats([0, 1, -1, 2, float("nan")]), WA.write(b"\x01\x00" * 4)
    assert WA.parse(a)["data"] == b"\x00\x00\xff\x7f\x00\x80\xff\x7f\x00\x00"
    j = WA.parse(WA.joined([a, b]))
    assert len(j["data"]) == 18 and j["error"] is None and WA.parse(a[:-2])["error"].startswith("truncated") and WA.parse(b"x")["error"]
    d = spark.createDataFrame([("k", 2, b), ("k", 1, a)], "k string, n int, audio binary")
    assert WA.join_waves(d, "k", "n", "audio").select(WA.parse_wave(F.col("audio")).alias("p")).select("p.audioSeconds").first()[0] == 9 / 24000
    quiet = [0.0] * 2000 + [0.5] * 10 + [0.0] * 2000
    assert len(WA.trim_silence(quiet)) == 720 + 10 + 720


def test_eviction_ties_go_by_the_columns_named(spark):
    from lectern.operators import history as H

    d = spark.createDataFrame([("d", 3, 20, 1.5, e) for e in (7, 2, 9, 4, 1, 8)], "documentId string, page int, currentPage int, usedAt double, event_id long").repartition(3)
    assert [r.event_id for r in H.eviction_order(d, "event_id").orderBy("evictRank").collect()] == [1, 2, 4, 7, 8, 9]


def test_one_assessment_for_all_that_is_known_of_pages(spark, tmp_path):
    from lectern.plans import page_queries as PQ

    spark.createDataFrame([(1, "A line of prose.\nAnother one.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = PQ._resolved(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 1 and "Join" not in plan


def test_lines_left(spark):
    rows = spark.createDataFrame([("a", "Same  line"), ("a", "same line"), ("b", "same line"), ("b", "own"), ("b", "own"), ("c", "12"), ("d", "12"), ("c", "w" * 81), ("d", "w" * 81), ("e", "same line")], "page string, text string")
    left = C.lines_left(rows, "page")
    assert sorted(map(tuple, left.collect())) == [("b", 2), ("c", 1), ("d", 1)]
    assert left._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
