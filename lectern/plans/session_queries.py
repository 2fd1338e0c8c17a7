"""Queries over sessions: controller ticks, point reading, revisions, windows, requests, and single predicates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import reading as R
from ..functions import text as T
from ..operators import flow as FL
from ..operators import picking as K
from ..operators import sessions as S
from .page_queries import segments
from .reading_queries import events
from .registry import SEGMENTS, TEXTS, q, query, squeeze, texts, trim

E = "e AS (SELECT user_id, event_id, value, CAST(floor(value) AS BIGINT) AS n FROM events)"


def steps(spark, d):
    return events(spark, d).select(F.col("user_id").cast("string").alias("reader"), F.col("event_id").alias("step"), F.col("value"), F.floor("value").alias("n"))


@query(
    "controller_ticks",
    f"""WITH {E}, p AS (SELECT *, n % 11 <> 0 AS playing, event_id % 13 = 0 AS manual, CASE WHEN n % 7 <> 0 THEN 'k' || (n // 15) END AS key, CASE WHEN n % 5 = 0 THEN 'skip' ELSE 'full' END AS decision FROM e),
        l AS (SELECT *, last_value(CASE WHEN playing OR manual THEN key END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM p)
        SELECT CAST(user_id AS VARCHAR) AS reader, event_id AS step, CASE WHEN NOT playing AND NOT manual THEN 'paused' WHEN key IS NULL THEN 'waiting-for-readable-chunk' WHEN NOT manual AND key = prev THEN NULL WHEN NOT manual AND decision = 'skip' THEN 'visual-skip' ELSE 'speaking' END AS status FROM l""",
)
def controller_ticks(spark, d):
    n = F.col("n")
    p = steps(spark, d).select("reader", "step", F.lit(True).alias("enabled"), F.lit("continuous").alias("autoRead"), (n % 11 != 0).alias("isPlaying"), (F.col("step") % 13 == 0).alias("manual"), F.when(n % 7 != 0, F.concat(F.lit("k"), F.floor(n / 15).cast("string"))).alias("key"), F.when(n % 5 == 0, "skip").otherwise("full").alias("decision"))
    return S.ticks(p).select("reader", "step", "status")


@query(
    "point_sessions",
    f"""WITH RECURSIVE {E}, a0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE n % 7 WHEN 0 THEN 'cancel' WHEN 1 THEN 'interrupt' WHEN 2 THEN 'settle' WHEN 3 THEN 'settle' ELSE 'begin' END AS act, n % 3 <> 0 AS was, CASE WHEN n % 14 = 2 THEN 'failed' ELSE 'ended' END AS outcome FROM e), a AS (SELECT *, CASE WHEN n % 3 = 1 THEN sum(CASE WHEN act IN ('begin', 'cancel') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) - n % 2 END AS token FROM a0),
        s AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, 0 AS g, false AS is_on, CAST(NULL AS BOOLEAN) AS base, CAST(NULL AS DOUBLE) AS speed, false AS cut, false AS pause, false AS hold, false AS accepted, false AS resume, CAST(NULL AS DOUBLE) AS resume_speed FROM (SELECT DISTINCT user_id FROM a)
            UNION ALL SELECT s.user_id, a.i, a.event_id, s.g + CASE WHEN act IN ('begin', 'cancel') THEN 1 ELSE 0 END, CASE act WHEN 'begin' THEN true WHEN 'settle' THEN is_on AND coalesce(token, s.g) <> s.g WHEN 'cancel' THEN false ELSE is_on END,
                CASE WHEN act = 'cancel' OR (act = 'settle' AND is_on AND coalesce(token, s.g) = s.g) THEN NULL WHEN act = 'begin' AND NOT (is_on AND base IS NOT NULL AND NOT cut) THEN a.was ELSE base END,
                CASE WHEN act = 'cancel' OR (act = 'settle' AND is_on AND coalesce(token, s.g) = s.g) THEN NULL WHEN act = 'begin' AND NOT (is_on AND base IS NOT NULL AND NOT cut) THEN a.value ELSE s.speed END,
                CASE WHEN act = 'begin' AND NOT (is_on AND base IS NOT NULL AND NOT cut) THEN false WHEN act = 'interrupt' AND is_on THEN true WHEN act = 'cancel' THEN false ELSE cut END,
                act = 'begin' AND a.was, CASE act WHEN 'begin' THEN CASE WHEN is_on AND base IS NOT NULL AND NOT cut THEN base ELSE a.was END WHEN 'settle' THEN is_on AND coalesce(token, s.g) <> s.g AND coalesce(base, false) AND NOT cut ELSE false END,
                (act = 'settle' AND is_on AND coalesce(token, s.g) = s.g), (act = 'settle' AND is_on AND coalesce(token, s.g) = s.g) AND outcome = 'ended' AND coalesce(base, false) AND NOT cut, CASE WHEN (act = 'settle' AND is_on AND coalesce(token, s.g) = s.g) AND outcome = 'ended' AND coalesce(base, false) AND NOT cut THEN s.speed END
            FROM s JOIN a ON a.user_id = s.user_id AND a.i = s.i + 1)
        SELECT CAST(user_id AS VARCHAR) AS reader, event_id AS step, g AS generation, is_on AS active, pause, hold, accepted, resume, resume_speed FROM s WHERE i > 0""",
)
def point_sessions(spark, d):
    n = F.col("n")
    act = F.when(n % 7 == 0, "cancel").when(n % 7 == 1, "interrupt").when((n % 7 == 2) | (n % 7 == 3), "settle").otherwise("begin")
    # now and then a token, of the present generation or of the one before
    began = F.sum(F.when(act.isin("begin", "cancel"), 1).otherwise(0)).over(W.partitionBy("reader").orderBy("step"))
    token = F.when(n % 3 == 1, began - n % 2).cast("int")
    a = steps(spark, d).select("reader", "step", act.alias("action"), (n % 3 != 0).alias("wasPlaying"), F.col("value").alias("speed"), token.alias("token"), F.when(n % 14 == 2, "failed").otherwise("ended").alias("outcome"))
    return S.point_session(a).select("reader", "step", "generation", "active", F.col("shouldPause").alias("pause"), F.col("holdActive").alias("hold"), "accepted", F.col("shouldResume").alias("resume"), F.col("resumeSpeed").alias("resume_speed"))


@query("passage_revisions", f"WITH {E} SELECT event_id AS step, row_number() OVER (PARTITION BY user_id, n // 25, n % 2 ORDER BY event_id) AS revision FROM e")
def passage_revisions(spark, d):
    c = steps(spark, d).select(F.col("reader").alias("documentId"), F.floor(F.col("n") / 25).alias("pageNumber"), F.when(F.col("n") % 2 == 0, "native").otherwise("ocr").alias("source"), "step")
    return S.revisions(c).select("step", "revision")


def _windows(spark, d):
    """The three pages around each reader's place, with sources and revisions that change now and then."""
    p = F.floor(F.col("n") / 20)
    entry = lambda k: F.struct((p + k).cast("string").alias("pageNumber"), F.when((p + k) % 3 != 0, "native").alias("source"), (F.floor(F.col("step") / 50) + F.lit(0.4)).alias("revision"))
    return steps(spark, d).select("reader", "step", S.window_sources(F.array(entry(1), entry(-1), entry(0))).alias("w"))


WINDOWS = f"{E}, w AS (SELECT user_id, event_id, list_sort(list_filter([n // 20 - 1, n // 20, n // 20 + 1], lambda x: x > 0)) AS pages, event_id // 50 AS rev FROM e)"


@query("window_sources", f"WITH {WINDOWS} SELECT event_id AS step, array_to_string(list_transform(pages, lambda x: x || ':' || CASE WHEN x % 3 <> 0 THEN 'native' ELSE 'none' END || ':' || rev), ',') AS win FROM w")
def window_sources(spark, d):
    text = F.transform("w", lambda e: F.concat_ws(":", e["pageNumber"].cast("string"), e["source"], e["revision"].cast("string")))
    return _windows(spark, d).select("step", F.array_join(text, ",").alias("win"))


@query("window_changes", f"WITH {WINDOWS}, l AS (SELECT *, lag(pages) OVER o AS bp, lag(rev) OVER o AS br FROM w WINDOW o AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id AS step, CASE WHEN len(pages) = 0 AND len(bp) = 0 THEN false WHEN len(list_intersect(pages, bp)) = 0 THEN true ELSE rev <> br END AS changed FROM l WHERE bp IS NOT NULL")
def window_changes(spark, d):
    w = _windows(spark, d).withColumn("before", F.lag("w").over(W.partitionBy("reader").orderBy("step")))
    return w.where("before IS NOT NULL").select("step", S.window_differs(F.col("before"), F.col("w")).alias("changed"))


@query("window_joins", f"WITH {E}, h AS (SELECT user_id, n // 5 AS pg, event_id % 2 AS side, max(event_id % 3) AS rev FROM e GROUP BY ALL), j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.rev AS ra, b.rev AS rb FROM (SELECT * FROM h WHERE side = 0) a FULL JOIN (SELECT * FROM h WHERE side = 1) b ON a.user_id = b.user_id AND a.pg = b.pg) SELECT CAST(user_id AS VARCHAR) AS reader, count(ra + rb) = 0 OR coalesce(bool_or(ra <> rb), false) AS changed FROM j GROUP BY user_id")
def window_joins(spark, d):
    h = steps(spark, d).groupBy("reader", F.floor(F.col("n") / 5).alias("pageNumber"), (F.col("step") % 2).alias("side")).agg(F.max(F.col("step") % 3).alias("revision")).withColumn("source", F.lit("native"))
    out = FL.window_changed(h.where("side = 0").drop("side"), h.where("side = 1").drop("side"))
    return out.select("reader", F.coalesce("changed", F.lit(False)).alias("changed"))


@query("ordered_pages", f"WITH {E} SELECT event_id AS step, array_to_string(list_filter([n // 10] || list_filter([n // 10 - 1, n // 10 + 1, n // 10 - 2, n // 10 + 2], lambda x: true), lambda x: x >= 1), ',') AS pages FROM e")
def ordered_pages(spark, d):
    p = F.floor(F.col("n") / 10).cast("int")
    pages = S.ordered_pages(p, F.array(p, p - 1, p + 1), F.array(p - 2, p - 1, p + 2))
    return steps(spark, d).select("step", F.array_join(F.transform(pages, lambda x: x.cast("string")), ",").alias("pages"))


@query("synthesis_totals", "SELECT CAST(user_id AS VARCHAR) AS request, count(*) AS parts, round(sum(value * 10), 4) AS duration, CAST(sum(event_id % 40) AS DOUBLE) AS phonemes, CAST(sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 3 END) AS DOUBLE) AS unknown FROM events GROUP BY user_id")
def synthesis_totals(spark, d):
    r = steps(spark, d).select(F.col("reader").alias("request"), (F.col("value") * 10).alias("durationMs"), (F.col("step") % 40).alias("phonemeCount"), F.when(F.col("step") % 4 == 0, "no number").otherwise((F.col("step") % 3).cast("string")).alias("unknownPhonemeCount"))
    t = S.synthesis_totals(r)
    return t.select("request", "parts", F.round("durationMs", 4).alias("duration"), F.col("phonemeCount").alias("phonemes"), F.col("unknownPhonemeCount").alias("unknown"))


@query("safe_requests", f"SELECT event_id AS step, round(greatest(0.9::DOUBLE, least(1.85::DOUBLE, CASE WHEN event_id % 6 = 0 THEN 1 ELSE value / 40 END)), 6) AS speed, CASE WHEN event_id % 4 = 0 THEN 'bm_george' WHEN event_id % 4 = 1 THEN 'zf_xiaobei' ELSE 'af_heart' END AS voice FROM events")
def safe_requests(spark, d):
    e = steps(spark, d)
    voice = F.when(F.col("step") % 4 == 0, " bm_george ").when(F.col("step") % 4 == 1, "zf_xiaobei").when(F.col("step") % 4 == 2, "nobody")
    speed = F.when(F.col("step") % 6 == 0, "fast").otherwise((F.col("value") / 40).cast("string"))
    return e.select("step", F.round(S.safe_speed(speed), 6).alias("speed"), S.safe_voice(voice).alias("voice"))


@query("late_plans", "SELECT event_id AS step, event_id % 3 <> 0 AND value * 10 > 500 + 120 AS late FROM events")
def late_plans(spark, d):
    return steps(spark, d).select("step", R.plan_late(F.when(F.col("step") % 3 != 0, 500), F.col("value") * 10).alias("late"))


@query("worker_languages", f"{TEXTS} SELECT tid, CASE WHEN regexp_matches(text, '[\\p{{Hiragana}}\\p{{Katakana}}]') THEN 'ja' ELSE 'zh' END AS language FROM texts")
def worker_languages(spark, d):
    asked = F.when(F.col("text").rlike(r"[\p{IsHiragana}\p{IsKatakana}]"), " JA_jp").otherwise("Zh_Hans ")
    return texts(spark, d).select("tid", T.worker_language(asked).alias("language"))


@query("speech_texts", f"{TEXTS} SELECT tid, {squeeze('text')} AS spoken FROM texts")
def speech_texts(spark, d):
    return texts(spark, d).select("tid", K.speech_text().alias("spoken"))


@query("short_leads", f"{TEXTS} SELECT tid, length({trim('text')}) <= 90 OR length(text) % 5 = 0 AS short FROM texts")
def short_leads(spark, d):
    t = texts(spark, d).withColumn("role", F.when(F.char_length("text") % 5 == 0, "heading").otherwise("body"))
    return t.select("tid", K.is_heading_or_short().alias("short"))


@query("long_previews", f"{TEXTS} SELECT tid, CASE WHEN length(text) > 180 THEN left(text, 177) || '…' ELSE text END AS preview FROM texts")
def long_previews(spark, d):
    return texts(spark, d).select("tid", T.truncated(F.col("text"), 180).alias("preview"))


@query("plan_signatures", "SELECT event_id AS step, CASE WHEN event_id % 2 = 0 THEN 'full' ELSE 'skip' END || '|' || printf('%.2f', (event_id % 200) / 4.0::DOUBLE) || '|a b' AS signature FROM events")
def plan_signatures(spark, d):
    plan = F.struct(F.when(F.col("step") % 2 == 0, "full").otherwise("skip").alias("decision"), ((F.col("step") % 200) / 4.0).alias("speed"), F.lit(" a   b ").alias("text"))
    return steps(spark, d).withColumn("plan", plan).select("step", R.plan_signature(F.col("plan")).alias("signature"))


@query("page_dimensions", "SELECT event_id AS step, CASE WHEN event_id % 5 > 1 AND value > 0 THEN round(value, 6) END AS width, CASE WHEN event_id % 5 > 1 AND value > 0 THEN CASE WHEN event_id % 2 = 0 THEN 'pdf' ELSE 'top-down' END END AS system FROM events")
def page_dimensions(spark, d):
    s = F.col("step")
    height = F.when(s % 5 == 0, "none").when(s % 5 == 1, "-3").otherwise("792")
    p = G.page_dimensions(F.col("value").cast("string"), height, F.when(s % 2 == 0, "pdf").otherwise("odd"))
    return steps(spark, d).withColumn("p", p).select("step", F.round("p.width", 6).alias("width"), F.col("p.coordinateSystem").alias("system"))


@query("finite_numbers", "SELECT event_id AS step, round(CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN 7 WHEN 2 THEN 7 ELSE -value END, 6) AS number FROM events")
def finite_numbers(spark, d):
    s, v = F.col("step") % 4, F.col("value")
    raw = F.when(s == 0, v.cast("string")).when(s == 1, "NaN").when(s == 2, "Infinity").otherwise((-v).cast("string"))
    return steps(spark, d).select("step", F.round(G.finite(raw, 7.0), 6).alias("number"))


@query("page_diagnostics", f"{SEGMENTS}, m AS (SELECT documentId, count(DISTINCT pageIndex) AS pages, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS characters FROM seg GROUP BY documentId) SELECT documentId, '{{\"pages\":' || pages || ',\"segments\":' || segments || ',\"characters\":' || characters || '}}' AS snapshot FROM m")
def page_diagnostics(spark, d):
    """A metrics document for each document, as JSON."""
    m = segments(spark, d).groupBy("documentId").agg(F.count_distinct("pageIndex").alias("pages"), F.count("*").alias("segments"), F.sum(F.char_length("text")).alias("characters"))
    return m.select("documentId", F.to_json(F.struct("pages", "segments", "characters")).alias("snapshot"))
