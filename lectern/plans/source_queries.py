"""Queries over sources and small state: waves, recognised text, page items, reader state, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reading as R
from ..operators import history as H
from ..operators import picking as K
from ..sources import adapters as A
from ..sources import byte_source as B
from ..sources import wave_audio as WA
from .reading_queries import events
from .registry import SEGMENTS, WS, query, rep, trim


#: A sample as its two bytes, low one first, in hex.
PCM = "list_transform(x, lambda v: CAST(floor(CASE WHEN v < 0 THEN greatest(v, -1) * 32768 ELSE least(v, 1) * 32767 END + 0.5) AS BIGINT) & 65535)"
HEX = f"array_to_string(list_transform({PCM}, lambda s: printf('%02x%02x', s & 255, s >> 8)), '')"
SAMPLES = "list(CAST(CAST((value - 50) / 40 AS FLOAT) AS DOUBLE) ORDER BY event_id) AS x"


def _samples(spark, d, *keys):
    """Values as samples from -1.25 on, in the order of events."""
    x = F.array_sort(F.collect_list(F.struct("event_id", ((F.col("value") - 50) / 40).cast("float").alias("v"))))
    return events(spark, d).groupBy(F.col("user_id").cast("string").alias("reader"), *keys).agg(F.transform(x, lambda s: s["v"]).alias("x"))


@query("wave_round_trip", f"SELECT CAST(user_id AS VARCHAR) AS reader, round(len(x) / 24000.0::DOUBLE, 6) AS seconds, CAST(2 * len(x) AS BIGINT) AS bytes, sha256({HEX}) AS samples FROM (SELECT user_id, {SAMPLES} FROM events GROUP BY user_id)")
def wave_round_trip(spark, d):
    """One file a reader, written and read again."""
    p = _samples(spark, d).select("reader", WA.floats_to_wave(F.col("x")).alias("audio")).select("reader", WA.parse_wave(F.col("audio")).alias("p"))
    return p.select("reader", F.round("p.audioSeconds", 6).alias("seconds"), F.octet_length("p.data").cast("long").alias("bytes"), F.sha2(F.lower(F.hex("p.data")), 256).alias("samples"))


@query("wave_join", f"SELECT CAST(user_id AS VARCHAR) AS reader, CAST(2 * sum(len(x)) + 44 AS BIGINT) AS bytes, sha256(string_agg({HEX}, '' ORDER BY event_type)) AS samples FROM (SELECT user_id, event_type, {SAMPLES} FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def wave_join(spark, d):
    """One file for each kind of event of a reader, joined into one."""
    w = _samples(spark, d, "event_type").select("reader", "event_type", WA.floats_to_wave(F.col("x")).alias("audio"))
    j = WA.join_waves(w, "reader", "event_type", "audio")
    return j.select("reader", F.octet_length("audio").cast("long").alias("bytes"), F.sha2(F.lower(F.hex(F.expr("substring(audio, 45)"))), 256).alias("samples"))


@query("wave_trim", "WITH s AS (SELECT user_id, event_id, abs(CAST((value - 50) / 40 AS FLOAT)) * CASE WHEN event_id % 9 < 6 THEN 0 ELSE 1 END AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), t AS (SELECT *, max(v) OVER (PARTITION BY user_id) AS peak FROM s) SELECT CAST(user_id AS VARCHAR) AS reader, CAST(CASE WHEN min(i) FILTER (WHERE v >= greatest(0.0001, peak * 0.001)) IS NULL THEN max(n) ELSE least(max(n), max(i) FILTER (WHERE v >= greatest(0.0001, peak * 0.001)) + 3) - greatest(1, min(i) FILTER (WHERE v >= greatest(0.0001, peak * 0.001)) - 3) + 1 END AS BIGINT) AS samples FROM t GROUP BY user_id")
def wave_trim(spark, d):
    """Samples left without the quiet ends, at 100 samples a second: three of them stay on either side."""
    x = F.array_sort(F.collect_list(F.struct("event_id", F.when(F.col("event_id") % 9 < 6, 0).otherwise((F.col("value") - 50) / 40).cast("float").alias("v"))))
    w = events(spark, d).groupBy(F.col("user_id").cast("string").alias("reader")).agg(F.transform(x, lambda s: s["v"]).alias("x"))
    return w.select("reader", F.size(WA.trimmed(F.col("x"), 100)).cast("long").alias("samples"))


@query("ocr_segments", f"{SEGMENTS} SELECT documentId, pageIndex, CAST(row_number() OVER (PARTITION BY documentId, pageIndex ORDER BY y) - 1 AS INTEGER) AS segmentIndex, bare AS text, x, y, w, h, round(0.9::DOUBLE, 6) AS confidence, 'block:0:paragraph:0' AS paragraph FROM (SELECT *, {trim(rep(rep('text', f'^[|¦]+{WS}*', ''), f'{WS}*[|¦]+$', ''))} AS bare FROM seg) WHERE bare <> ''")
def ocr_segments(spark, d):
    """Pages as recognition results (JSON of blocks, paragraphs and lines), adapted back into segments."""
    s = A.document_segments(A.documents(spark, d))
    box = F.struct(F.col("bbox.x").alias("x0"), F.col("bbox.y").alias("y0"), (F.col("bbox.x") + F.col("bbox.width")).alias("x1"), (F.col("bbox.y") + F.col("bbox.height")).alias("y1"))
    line = F.array_sort(F.collect_list(F.struct("segmentIndex", "text", F.lit(90.0).alias("confidence"), box.alias("bbox"))))
    page = s.groupBy("documentId", "pageIndex").agg(F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct(line.alias("lines"))).alias("paragraphs"))).alias("blocks")).alias("data"))).alias("result"))
    b = F.col("bbox")
    return A.ocr_segments(page).select("documentId", "pageIndex", "segmentIndex", "text", F.round(b["x"], 6).alias("x"), F.round(b["y"], 6).alias("y"), F.round(b["width"], 6).alias("w"), F.round(b["height"], 6).alias("h"), F.round("confidence", 6).alias("confidence"), F.col("paragraphId").alias("paragraph"))


@query("page_items", f"{SEGMENTS} SELECT documentId, pageIndex, CAST(row_number() OVER (PARTITION BY documentId, pageIndex ORDER BY y) - 1 AS INTEGER) AS segmentIndex, text, 792 - (y + h) AS top FROM seg")
def page_items(spark, d):
    """Pages as text items with matrices, under a viewport that turns the page over."""
    s = A.document_segments(A.documents(spark, d))
    zero, one = F.lit(0.0), F.lit(1.0)
    item = F.struct("segmentIndex", F.col("text").alias("str"), F.array(one, zero, zero, one, F.col("bbox.x"), F.col("bbox.y")).alias("transform"), F.col("bbox.width").alias("width"), F.col("bbox.height").alias("height"), F.col("hasEOL").alias("hasEOL"), F.lit("f1").alias("fontName"), F.lit("ltr").alias("dir"))
    p = s.groupBy("documentId", "pageIndex").agg(F.array_sort(F.collect_list(item)).alias("i"))
    p = p.select("documentId", "pageIndex", F.transform("i", lambda x: x.dropFields("segmentIndex")).alias("items"), F.array(one, zero, zero, F.lit(-1.0), zero, F.lit(792.0)).alias("viewport"))
    return A.page_item_segments(p).select("documentId", "pageIndex", "segmentIndex", "text", F.col("bbox.y").alias("top"))


#: What each event's stored state says, by the form that it is stored in.
KNOWN = """event_id, CASE WHEN event_id % 5 < 2 THEN 'now' ELSE 't' || event_id END AS created, CASE event_id % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN event_id % 2 = 0 ELSE event_id % 3 = 0 END AS tts, CAST(CASE WHEN event_id % 5 = 2 THEN greatest(4, least(64, event_id % 90)) ELSE 16 END AS INTEGER) AS speed,
    CAST(CASE WHEN event_id % 5 > 2 THEN greatest(1, least(18, event_id % 25)) ELSE 6 END AS INTEGER) AS recent, CASE WHEN event_id % 5 > 2 THEN greatest(0, least(1, (event_id % 13 - 1) / 10.0::DOUBLE)) ELSE 0.28::DOUBLE END AS volume"""


def _stored(spark, d):
    n = F.col("event_id")
    text = lambda c: c.cast("string")
    old = F.concat(F.lit('{"createdAt":"t'), text(n), F.lit('","preferences":{"ttsMode":"'), F.when(n % 2 == 0, "flow").otherwise("off"), F.lit('","defaultSpeedPxPerSecond":'), text(n % 90), F.lit("}}"))
    odd = F.concat(F.lit('{"createdAt":"t'), text(n), F.lit('","preferences":{"ttsEnabled":'), F.when(n % 3 == 0, "true").otherwise("false"), F.lit(',"recentDocumentLimit":'), text(n % 25), F.lit(',"defaultSpeedPxPerSecond":"odd","soundCueVolume":'), text((n % 13 - 1) / 10.0), F.lit("}}"))
    return events(spark, d).select("event_id", F.when(n % 5 == 0, "{no json").when(n % 5 == 2, old).when(n % 5 > 2, odd).alias("raw"))


def _known(df, state):
    p = F.col(state)["preferences"]
    return df.select("event_id", F.col(state)["createdAt"].alias("created"), p["ttsEnabled"].alias("tts"), p["defaultSpeedPxPerSecond"].alias("speed"), p["recentDocumentLimit"].alias("recent"), p["soundCueVolume"].alias("volume"), *[c for c in df.columns if c not in ("event_id", "raw", state)])


@query("reader_state", f"SELECT {KNOWN} FROM events")
def reader_state(spark, d):
    return _known(_stored(spark, d).withColumn("s", A.read_state(F.col("raw"), F.lit("now"))), "s")


@query("reader_state_round_trip", f"SELECT {KNOWN}, 'later' AS updated FROM events")
def reader_state_round_trip(spark, d):
    """Each state written and read again: nothing of it changes but the time of its update."""
    s = _stored(spark, d).withColumn("j", A.write_state(A.read_state(F.col("raw"), F.lit("now")), F.lit("later")))
    s = s.withColumn("s", A.read_state(F.col("j"), F.lit("never"))).withColumn("updated", F.col("s.updatedAt")).drop("j")
    return _known(s, "s")


@query("cleared_states", "SELECT CAST(user_id AS VARCHAR) AS reader, last AS created, false AS tts, 16 AS speed, 6 AS recent, 0.28::DOUBLE AS volume FROM (SELECT user_id, CAST(max(event_id) AS VARCHAR) AS last FROM events GROUP BY user_id)")
def cleared_states(spark, d):
    """Every reader's state after clearing it at the reader's last event."""
    r = events(spark, d).groupBy(F.col("user_id").cast("string").alias("reader")).agg(F.max("event_id").cast("string").alias("last"))
    r = r.withColumn("s", A.cleared_state(F.col("last")))
    p = F.col("s.preferences")
    return r.select("reader", F.col("s.createdAt").alias("created"), p["ttsEnabled"].alias("tts"), p["defaultSpeedPxPerSecond"].alias("speed"), p["recentDocumentLimit"].alias("recent"), p["soundCueVolume"].alias("volume"))


@query("activated_documents", "SELECT 'f' || u AS fingerprint, CASE WHEN n <= 18 THEN 'd' || u END AS record FROM (SELECT user_id AS u, row_number() OVER (ORDER BY lpad(CAST(max(event_id) AS VARCHAR), 12, '0') DESC, 'd' || user_id) AS n FROM events GROUP BY user_id)")
def activated_documents(spark, d):
    r = events(spark, d).groupBy("user_id").agg(F.lpad(F.max("event_id").cast("string"), 12, "0").alias("updatedAt"))
    u = F.col("user_id").cast("string")
    r = r.select(F.concat(F.lit("d"), u).alias("id"), F.concat(F.lit("f"), u).alias("fingerprint"), "updatedAt", F.lit(16).alias("lastSpeedPxPerSecond"), F.lit("long-day").alias("lastBandKey"))
    opened = r.select("fingerprint", F.lit(None).cast("string").alias("id"))
    return H.activate(opened, r).select("fingerprint", F.col("recordId").alias("record"))


@query("manual_requests", "SELECT event_id, event_type IN ('click', 'view') AND value > 20 AS allowed, CASE WHEN event_type = 'click' THEN 'toggle-master' WHEN event_type = 'view' THEN 'read-line-sentence' END AS shortcut FROM events")
def manual_requests(spark, d):
    e = events(spark, d).withColumns({"readyToMove": F.lit(True), "hasActivePdf": F.lit(True), "controlAllowed": F.col("value") > 20, "enabled": F.lit(True), "hasReadableChunks": F.lit(True), "manualAction": F.lit("read-line-sentence"), "manualShortcut": F.lit("KeyR")})
    e = e.withColumn("action", F.when(F.col("event_type").isin("click", "view"), "read-line-sentence").otherwise("other")).withColumn("code", F.when(F.col("event_type") == "click", "KeyH").when(F.col("event_type") == "view", "KeyR").otherwise("KeyX"))
    return e.select("event_id", K.may_request().alias("allowed"), K.shortcut_action().alias("shortcut"))


@query("rate_labels", "SELECT event_id, CASE WHEN r = 0 THEN '—' WHEN lo = hi THEN '≈' || format('{:,}', lo) ELSE '≈' || format('{:,}', lo) || '–' || format('{:,}', hi) END AS label FROM (SELECT event_id, r, greatest(1, CAST(floor(r * 0.88::DOUBLE + 0.5) AS BIGINT)) AS lo, greatest(1, CAST(floor(r * 1.12::DOUBLE + 0.5) AS BIGINT)) AS hi FROM (SELECT event_id, greatest(0, CAST(floor(value + 0.5) AS BIGINT)) AS r FROM events))")
def rate_labels(spark, d):
    return events(spark, d).select("event_id", R.rate_label(R.rate_range(F.col("value"))).alias("label"))


@query("file_ranges")
def file_ranges(spark, d):
    """The files of the tables themselves as ranges of 64 KiB, with the digests of their bytes."""
    r = B.byte_ranges(spark, d, 1 << 16)
    return r.select(F.element_at(F.split("path", "/"), -1).alias("file"), "size", "start", F.length("data").alias("bytes"), F.crc32("data").alias("crc32"))
