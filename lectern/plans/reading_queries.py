"""Queries over rates, positions, policies, flow and history. Events stand in for reading clocks: a user is a reader,
the order of event ids is time, the value a scroll position."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import reading as R
from ..operators import chunks as C
from ..operators import flow as FL
from ..operators import history as H
from ..operators import picking as K
from ..operators import rhythm as RH
from ..sources import adapters as A
from ..streaming import paragraph_flow as SF
from .page_queries import page, segments
from .registry import CJK, SEGMENTS, cnt, has, query, squeeze


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def numbers(name, make, sql, source="SELECT event_id, value AS v FROM events"):
    """A query of scalars on the values of events."""

    @query(name, f"SELECT event_id, {sql} FROM ({source})")
    def run(spark, d):
        return make(events(spark, d).select("event_id", F.col("value").alias("v")))


def value():
    return F.col("v")

TIER = "CASE WHEN {x} <= 8 THEN 'snow-mist' WHEN {x} <= 14 THEN 'aesthetic-walk' WHEN {x} <= 21 THEN 'long-day' WHEN {x} <= 31 THEN 'winding-stream' WHEN {x} <= 44 THEN 'strong-wind' ELSE 'all-things-flourish' END"
numbers("speed_tiers", lambda e: e.select("event_id", R.speed_tier(value() % 70).alias("tier"), R.tier_index(value() % 70).alias("tier_index")), f"{TIER.format(x='v % 70')} AS tier, CASE WHEN v % 70 <= 8 THEN 0 WHEN v % 70 <= 14 THEN 1 WHEN v % 70 <= 21 THEN 2 WHEN v % 70 <= 31 THEN 3 WHEN v % 70 <= 44 THEN 4 ELSE 5 END AS tier_index")
numbers("rate_ranges", lambda e: e.select("event_id", R.rate_range(value()).alias("r")).select("event_id", F.col("r.min").alias("low"), F.col("r.max").alias("high")), "CASE WHEN r = 0 THEN 0 ELSE greatest(1, CAST(floor(r * 0.88::DOUBLE + 0.5) AS BIGINT)) END AS low, CASE WHEN r = 0 THEN 0 ELSE greatest(1, CAST(floor(r * 1.12::DOUBLE + 0.5) AS BIGINT)) END AS high", "SELECT event_id, greatest(0, CAST(floor(value + 0.5) AS BIGINT)) AS r FROM events")
numbers("density_levels", lambda e: e.select("event_id", R.density_level(value() / 100).alias("level")), "CASE WHEN v IS NULL OR v <= 0 THEN 'unknown' WHEN v / 100 < 0.72::DOUBLE THEN 'sparse' WHEN v / 100 > 1.42::DOUBLE THEN 'dense' WHEN v / 100 > 1.16::DOUBLE THEN 'slightly-dense' WHEN v / 100 < 0.86::DOUBLE THEN 'slightly-sparse' ELSE 'balanced' END AS level")
numbers("flow_time", lambda e: e.select("event_id", R.flow_time(value() * 100, F.lit(16.0)).alias("t")).select("event_id", F.col("t.minMinutes").alias("low"), F.col("t.maxMinutes").alias("high")), "CASE WHEN v > 0 THEN greatest(1, CAST(floor(v * 100 / 16.0::DOUBLE / 60 * 0.9::DOUBLE + 0.5) AS BIGINT)) END AS low, CASE WHEN v > 0 THEN greatest(1, CAST(floor(v * 100 / 16.0::DOUBLE / 60 * 1.1::DOUBLE + 0.5) AS BIGINT)) END AS high")
numbers("units_per_minute", lambda e: e.select("event_id", R.units_per_minute(value(), F.lit(1000.0), F.lit(20.0)).alias("rate")), "CASE WHEN v <= 0 THEN 0 ELSE CAST(floor(v / 1000.0::DOUBLE * 20 * 60 + 0.5) AS BIGINT) END AS rate")
numbers("reading_clock", lambda e: e.select("event_id", R.clock_snapshot(F.lit(True), F.lit(16.0), value() * 10, F.lit(900.0), F.lit(5000.0), value() / 100).alias("c")).select("event_id", F.round("c.readingLineY", 6).alias("line"), F.round("c.progressRatio", 6).alias("progress"), F.col("c.currentPageIndex").alias("page")), "round(greatest(0, v * 10) + 900 * 0.38::DOUBLE, 6) AS line, round(greatest(0, least(1, greatest(0, v * 10) / 4100.0::DOUBLE)), 6) AS progress, greatest(0, CAST(floor(v / 100 + 0.5) AS BIGINT)) AS page")
numbers("reading_anchor", lambda e: e.withColumn("a", G.capture_anchor(F.lit(1942.0), F.lit(800.0), value() * 10, F.lit(900.0))).select("event_id", F.round("a", 6).alias("anchor"), F.round(G.restore_anchor(F.col("a"), F.lit(2000.0), F.lit(1000.0), F.lit(900.0)), 6).alias("top")), "round(a, 6) AS anchor, round(greatest(0, 2000 + 1000 * a - 342), 6) AS top", "SELECT event_id, greatest(0::DOUBLE, least(1::DOUBLE, (value * 10 + 342 - 1942) / 800)) AS a FROM events")
numbers("render_scale", lambda e: e.select("event_id", F.round(G.ocr_render_scale(value() * 3), 6).alias("scale")), "CASE WHEN v <= 0 THEN 1.5 ELSE round(least(3.2::DOUBLE, greatest(1.5::DOUBLE, 1600 / (v * 3))), 6) END AS scale")
numbers("confidence", lambda e: e.select("event_id", F.round(G.normalize_confidence(value()), 6).alias("confidence")), "round(greatest(0, least(1, CASE WHEN v > 1 THEN v / 100 ELSE v END)), 6) AS confidence")
numbers("cache_budget", lambda e: e.withColumn("b", G.cache_budget(value() % 33, F.col("event_id") % 2 == 0)).select("event_id", F.col("b.pages").alias("pages"), F.col("b.pixels").alias("pixels")), "p AS pages, CAST(floor(p * 4800000 * CASE WHEN event_id % 2 = 0 THEN 0.9::DOUBLE ELSE 1 END + 0.5) AS BIGINT) AS pixels", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN greatest(7, b - 1) ELSE b END AS p FROM (SELECT event_id, CASE WHEN value % 33 <= 0 THEN 10 WHEN value % 33 <= 8 THEN 7 WHEN value % 33 <= 16 THEN 10 ELSE 14 END AS b FROM events)")
numbers("large_jumps", lambda e: e.select("event_id", R.large_jump(value() * 4 - 500, F.lit(900.0)).alias("jump")), "abs(v * 4 - 500) >= greatest(180, 405) AS jump")
numbers("visual_window", lambda e: e.select("event_id", F.round(R.visual_window(F.struct(F.lit(0.1).alias("x"), (value() / 500).alias("y"), F.lit(0.8).alias("width"), F.lit(0.2).alias("height")), F.lit(0.38), F.lit(800.0), F.lit(12.0)), 6).alias("seconds")), "round(greatest(0, (greatest(0, least(1, v / 500 + 0.2::DOUBLE)) - 0.38::DOUBLE) * 800 / 12), 6) AS seconds")
numbers("speech_speed", lambda e: e.select("event_id", R.speech_speed(R.speed_tier(value() % 70)).alias("speed")), "CASE WHEN v % 70 <= 8 THEN 1.18::DOUBLE WHEN v % 70 <= 14 THEN 1.5 ELSE 1.25 END AS speed")
numbers("tier_steps", lambda e: e.select("event_id", F.explode(R.transition_steps((F.col("event_id") % 6).cast("int"), (F.floor(value()) % 6).cast("int"))).alias("s")).select("event_id", "s.direction", F.col("s.fromIndex").cast("long").alias("step_from"), F.col("s.boundaryIndex").cast("long").alias("boundary")), "CASE WHEN b > a THEN 'up' ELSE 'down' END AS direction, CASE WHEN b > a THEN a + i ELSE a - i END AS step_from, CASE WHEN b > a THEN a + i ELSE a - i - 1 END AS boundary", "SELECT event_id, a, b, unnest(range(0, abs(b - a))) AS i FROM (SELECT event_id, event_id % 6 AS a, CAST(floor(value) AS BIGINT) % 6 AS b FROM events)")
numbers("cue_notes", lambda e: e.select("event_id", F.array_join(F.transform(R.cue_notes((F.col("event_id") % 6).cast("int"), (F.floor(value()) % 6).cast("int")), lambda n: F.concat_ws(":", n["frequency"].cast("string"), n["offsetMs"].cast("string"), n["durationMs"].cast("string"))), ",").alias("notes")), "CASE WHEN a = b THEN '' ELSE array_to_string(list_transform(range(0, abs(a - b) + 1), lambda i: [196, 220, 262, 330, 392, 523][CASE WHEN b > a THEN a + i ELSE a - i END + 1] || ':' || (i * 92) || ':220'), ',') END AS notes", "SELECT event_id, event_id % 6 AS a, CAST(floor(value) AS BIGINT) % 6 AS b FROM events")
numbers("byte_ranges", lambda e: e.select("event_id", A.byte_range(F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 5 == 1, "bytes=x").when(F.col("event_id") % 5 == 2, F.concat(F.lit("bytes=-"), F.floor(value()).cast("string"))).otherwise(F.concat(F.lit("bytes="), F.floor(value()).cast("string"), F.lit("-"), F.when(F.col("event_id") % 5 == 3, "").otherwise((F.floor(value()) + 50).cast("string")))), F.lit(100).cast("long")).alias("r")).select("event_id", F.col("r.ok").alias("ok"), F.col("r.start").alias("first"), F.col("r.length").alias("length")),
    "CASE WHEN m = 0 THEN NULL ELSE good END AS ok, CASE WHEN good THEN s END AS first, CASE WHEN good THEN e - s + 1 END AS length", "SELECT *, m > 1 AND NOT (m = 2 AND n = 0) AND s < 100 AND s <= e AS good FROM (SELECT event_id, event_id % 5 AS m, n, CASE WHEN event_id % 5 = 2 THEN 100 - least(n, 100) ELSE n END AS s, CASE WHEN event_id % 5 IN (2, 3) THEN 99 ELSE least(n + 50, 99) END AS e FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS n FROM events))")


@query("clock_advances", "SELECT user_id, count(*) FILTER (WHERE adv) AS advanced FROM (SELECT user_id, coalesce(abs(p - lag(p) OVER w) > 0.001::DOUBLE OR g <> lag(g) OVER w, true) AS adv FROM (SELECT user_id, event_id, value / 1000 AS p, CAST(floor(value / 100) AS BIGINT) AS g FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id")
def clock_advances(spark, d):
    c = events(spark, d).select("user_id", "event_id", (F.col("value") / 1000).alias("progressRatio"), F.floor(F.col("value") / 100).alias("currentPageIndex"), F.lit(True).alias("isPlaying"), F.lit(16.0).alias("speedPxPerSecond"))
    return RH.clock_advances(c, "user_id", ["event_id"]).groupBy("user_id").agg(F.count(F.when(F.col("advanced"), 1)).alias("advanced"))


@query("throttled_clock", "SELECT user_id, min(event_id * 37) AS at FROM events GROUP BY user_id, (event_id * 37) // 160")
def throttled_clock(spark, d):
    return RH.throttled(events(spark, d).select("user_id", (F.col("event_id") * 37).alias("at")), "user_id", "at")


@query(
    "window_density",
    rf"""{SEGMENTS}, s AS (SELECT documentId, pageIndex, CAST(sum({cnt('text', r"\p{Latin}+(?:['’\-]\p{Latin}+)*")}) AS BIGINT) AS eng, CAST(sum({cnt('text', CJK)}) AS BIGINT) AS cjk, CAST(sum({cnt('text', r'\p{Nd}')}) AS BIGINT) AS num FROM seg GROUP BY ALL),
        w AS (SELECT documentId, pageIndex, eng + cjk + num AS own, sum(eng) OVER o AS we, sum(cjk) OVER o AS wc, sum(num) OVER o AS wn, count(*) OVER o * 792.0::DOUBLE AS h FROM s WINDOW o AS (PARTITION BY documentId ORDER BY pageIndex RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
        r AS (SELECT *, CASE WHEN own > 0 AND we + wc + wn > 0 THEN (own / 792.0::DOUBLE) / ((we + wc + wn) / h) END AS ratio FROM w)
        SELECT documentId, pageIndex, CASE WHEN we <= 0 THEN 0 ELSE CAST(floor(we / h * 16 * 60 + 0.5) AS BIGINT) END AS rate, round(ratio, 6) AS ratio,
        CASE WHEN ratio IS NULL OR ratio <= 0 THEN 'unknown' WHEN ratio < 0.72::DOUBLE THEN 'sparse' WHEN ratio > 1.42::DOUBLE THEN 'dense' WHEN ratio > 1.16::DOUBLE THEN 'slightly-dense' WHEN ratio < 0.86::DOUBLE THEN 'slightly-sparse' ELSE 'balanced' END AS density FROM r""",
)
def window_density(spark, d):
    s = segments(spark, d).select("documentId", "pageIndex", R.text_stats(F.col("text")).alias("s")).groupBy("documentId", "pageIndex").agg(*[F.sum(f"s.{k}").alias(k) for k in ("cjkCharacters", "numericUnits", "englishWords")])
    p = s.select("documentId", "pageIndex", F.lit(792.0).alias("height"), F.struct("cjkCharacters", "numericUnits", "englishWords").alias("stats"))
    return RH.window_estimates(p, 16).select("documentId", "pageIndex", F.col("englishRate").alias("rate"), F.round("densityRatio", 6).alias("ratio"), "density")


def positions(spark, d):
    s = segments(spark, d).select("documentId", "pageIndex").distinct()
    return s.select("documentId", "pageIndex", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("positionId")).withColumn("y", 0.1 + 0.2 * F.col("positionId"))


def line_chunks(spark, d):
    """Each line as a chunk of its own: the picks then have an SQL form."""
    s = segments(spark, d).withColumn("chunkIndex", F.col("segmentIndex")).select("documentId", "pageIndex", "chunkIndex", "text", "bbox", "source")
    return C.readable(s, page(), F.lit("top-down"))


LINE_CHUNKS = SEGMENTS + """, lc AS MATERIALIZED (SELECT documentId, pageIndex, segmentIndex AS k, c, role, CASE role WHEN 'body' THEN 1.0::DOUBLE WHEN 'heading' THEN 0.85 ELSE 0.2 END AS pr, y / 792 AS t, 12 / 792.0::DOUBLE AS hh FROM (SELECT *, {role} AS role FROM (SELECT *, {norm} AS c FROM seg)) WHERE role IN ('body', 'heading') AND c <> '')"""


def _line_chunks_sql():
    from .registry import norm
    from .text_queries import ROLE

    return LINE_CHUNKS.replace("{role}", ROLE).replace("{norm}", norm("text"))


def _all_chunks_sql():
    from .page_queries import LOW_ROLE
    from .registry import norm
    from .text_queries import BIBLIO

    return f"{SEGMENTS}, ac AS MATERIALIZED (SELECT documentId, c, {LOW_ROLE} AS role, y / 792 AS t_, {has('c', BIBLIO)} AS bib FROM (SELECT *, {norm('text')} AS c FROM seg))"


def _plain(x):
    from .text_queries import _without_brackets

    return _without_brackets(squeeze(x))


@query("readable_filter", f"{_line_chunks_sql()} SELECT documentId, count(*) AS chunks FROM lc GROUP BY documentId")
def readable_filter(spark, d):
    return line_chunks(spark, d).where(K.is_readable()).groupBy("documentId").agg(F.count("*").alias("chunks"))


@query(
    "pick_chunk",
    f"""{_line_chunks_sql()}, p AS (SELECT DISTINCT documentId, pageIndex FROM seg), q AS (SELECT p.*, v.i AS positionId, CAST(0.1 AS DOUBLE) + CAST(0.2 AS DOUBLE) * v.i AS yy FROM p, (VALUES (0), (1), (2), (3), (4)) AS v(i)),
        c AS (SELECT q.*, lc.k, lc.c, CASE WHEN yy BETWEEN t AND t + hh THEN 0::DOUBLE ELSE least(abs(yy - t), abs(yy - (t + hh))) END AS dist, t + hh / 2 AS mid, pr FROM q JOIN lc USING (documentId, pageIndex) WHERE t + hh >= yy - 0.045::DOUBLE AND t <= yy + 0.16::DOUBLE)
        SELECT documentId, pageIndex, positionId, k AS chunk, round(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY documentId, pageIndex, positionId ORDER BY dist + CASE WHEN mid < yy - 0.045::DOUBLE THEN 0.2::DOUBLE ELSE 0 END + (1 - pr) * 0.08::DOUBLE, mid, k) AS rn FROM c) WHERE rn = 1""",
)
def pick_chunk(spark, d):
    return K.pick_chunks(positions(spark, d), line_chunks(spark, d)).select("documentId", "pageIndex", "positionId", F.col("chunkIndex").alias("chunk"), F.round("distance", 6).alias("distance"))


@query("pick_sentence_below")
def pick_sentence_below(spark, d):
    return K.pick_sentences(positions(spark, d), line_chunks(spark, d)).withColumn("distance", F.round("distance", 6)).withColumn("y", F.round("y", 6))


@query("margin_noise", f"{_line_chunks_sql()} SELECT documentId, count(*) FILTER (WHERE length(c) <= 120 AND (t < 0.055::DOUBLE OR t + hh > 0.945::DOUBLE)) AS noise FROM lc GROUP BY documentId")
def margin_noise(spark, d):
    return line_chunks(spark, d).where(K.is_readable()).groupBy("documentId").agg(F.count(F.when(K.is_margin_noise(), 1)).alias("noise"))


POLICY_ROLES = "('snow-mist', ['reference', 'table', 'formula']), ('aesthetic-walk', ['reference', 'table', 'formula', 'footnote', 'annotation']), ('winding-stream', ['reference', 'table', 'formula', 'footnote', 'annotation', 'heading']), ('strong-wind', ['reference', 'table', 'formula'])"


@query("policy_filter", f"""{_all_chunks_sql()}, p AS (SELECT tier, unnest(roles) AS r FROM (VALUES {POLICY_ROLES}) AS v(tier, roles)), a AS (SELECT tier, documentId, CASE WHEN tier = 'aesthetic-walk' THEN {_plain('c')} ELSE {squeeze('c')} END AS text FROM ac, (SELECT DISTINCT tier FROM p) t
    WHERE c <> '' AND NOT (length(c) <= 120 AND (t_ < 0.055::DOUBLE OR t_ + 12 / 792.0::DOUBLE > 0.945::DOUBLE)) AND NOT bib AND NOT EXISTS (SELECT 1 FROM p WHERE p.tier = t.tier AND p.r = role)) SELECT tier AS "tierKey", documentId, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS characters FROM a WHERE text <> '' GROUP BY ALL""")
def policy_filter(spark, d):
    asked = spark.createDataFrame([(k, True) for k in ("snow-mist", "aesthetic-walk", "winding-stream", "strong-wind")], "tierKey string, enabled boolean")
    return K.by_policy(line_chunks(spark, d), K.resolve_policies(asked)).groupBy("tierKey", "documentId").agg(F.count("*").alias("chunks"), F.sum(F.char_length("text")).alias("characters"))


POLICY_ROWS = "(VALUES ('snow-mist', 'continuous', true, 3, NULL), ('aesthetic-walk', 'continuous', true, 5, NULL), ('long-day', 'none', false, 3, 'KeyR'), ('winding-stream', 'paragraph-lead', true, 6, NULL), ('strong-wind', 'none', false, 3, NULL), ('all-things-flourish', 'none', false, 3, NULL)) AS v(tier, auto_read, prefetch, excluded, shortcut)"


@query("policies", f"SELECT event_id, v.tier, auto_read, prefetch, excluded FROM events JOIN {POLICY_ROWS} ON v.tier = {TIER.format(x='value % 70')}")
def policies(spark, d):
    """The policy of the tier of each event's speed."""
    e = events(spark, d).select("event_id", R.speed_tier(F.col("value") % 70).alias("tier"))
    p = K.policies(spark).select(F.col("tierKey").alias("tier"), F.col("autoRead").alias("auto_read"), "prefetch", F.size("excludedRoles").alias("excluded"))
    return e.join(F.broadcast(p), "tier")  # six rows


@query("resolved_policies", f"SELECT event_id, v.tier, enabled, CASE WHEN enabled THEN auto_read ELSE 'none' END AS auto_read, CASE WHEN enabled THEN shortcut END AS shortcut FROM (SELECT event_id, event_id % 3 = 1 AS enabled, CASE WHEN event_id % 7 = 0 THEN 'long-day' ELSE {TIER.format(x='value % 70')} END AS tier FROM events) e JOIN {POLICY_ROWS} ON v.tier = e.tier")
def resolved_policies(spark, d):
    """Each event asks for the policy of its tier, now and then for one that isn't there, on, off or unsaid."""
    n = F.col("event_id")
    asked = events(spark, d).select("event_id", F.when(n % 7 == 0, "nowhere").otherwise(R.speed_tier(F.col("value") % 70)).alias("tierKey"), F.when(n % 3 == 1, True).when(n % 3 == 2, False).alias("enabled"))
    return K.resolve_policies(asked).select("event_id", F.col("tierKey").alias("tier"), "enabled", F.col("autoRead").alias("auto_read"), F.col("manualShortcut").alias("shortcut"))


@query("speakable_options", f"""{_all_chunks_sql()}, o AS (SELECT * FROM (VALUES (false, false), (false, true), (true, false), (true, true)) AS v(footnotes, leads))
    SELECT documentId, footnotes, leads, count(*) AS chunks, CAST(sum(length(c)) AS BIGINT) AS characters FROM ac, o WHERE c <> '' AND role NOT IN ('reference', 'table', 'formula') AND NOT bib AND NOT (length(c) <= 120 AND (t_ < 0.055::DOUBLE OR t_ + 12 / 792.0::DOUBLE > 0.945::DOUBLE))
    AND (footnotes OR role <> 'footnote') AND (NOT leads OR role = 'heading' OR length(c) <= 90) GROUP BY ALL""")
def speakable_options(spark, d):
    """What may be spoken of each document, with and without footnotes and for leads only."""
    one = lambda f, lead: F.when(K.is_speakable(f, lead), F.struct(F.lit(f).alias("footnotes"), F.lit(lead).alias("leads")))
    c = line_chunks(spark, d).withColumn("o", F.explode(F.array_compact(F.array(*[one(f, lead) for f in (False, True) for lead in (False, True)]))))
    return c.groupBy("documentId", "o.footnotes", "o.leads").agg(F.count("*").alias("chunks"), F.sum(F.char_length("text")).alias("characters"))


@query("ocr_task_keys", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 0 ELSE event_id // 400 END || ':' || CAST(floor(value / 25) AS BIGINT) || ':' || CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS key FROM events")
def ocr_task_keys(spark, d):
    n = F.col("event_id")
    page_, first = F.floor(F.col("value") / 25), F.when(n % 5 != 0, F.floor("value"))
    return events(spark, d).select("event_id", K.ocr_task_key(F.when(n % 6 != 0, F.floor(n / 400)), page_, first).alias("key"))


@query("speakable_next", f"""{_line_chunks_sql()}, a AS (SELECT documentId, pageIndex, segmentIndex AS k FROM seg), e AS (SELECT documentId, pageIndex, k FROM lc WHERE NOT (length(c) <= 120 AND (t < 0.055::DOUBLE OR t + hh > 0.945::DOUBLE)) AND NOT regexp_matches(c, '(?i)\\b(?:doi|isbn|issn|dataverse|replication sets?)\\b|https?://'))
    SELECT a.documentId, a.pageIndex, a.k AS chunk, (SELECT min('native-text:' || e.pageIndex || ':' || e.k) FROM e WHERE e.documentId = a.documentId AND e.pageIndex * 1000 + e.k = (SELECT min(f.pageIndex * 1000 + f.k) FROM e f WHERE f.documentId = a.documentId AND f.pageIndex * 1000 + f.k > a.pageIndex * 1000 + a.k)) AS next_key FROM a""")
def speakable_next(spark, d):
    return K.next_eligible(line_chunks(spark, d)).select("documentId", "pageIndex", F.col("chunkIndex").alias("chunk"), F.col("nextKey").alias("next_key"))


@query("walk_plans")
def walk_plans(spark, d):
    p = K.plan_utterances(positions(spark, d), line_chunks(spark, d), 12.0, 800.0)
    return p.select("documentId", "pageIndex", "positionId", "chunkIndex", "decision", F.round("speed", 6).alias("speed"), F.round("estimatedSpeechSeconds", 6).alias("seconds"), "latestStartAtMs")


@query("whole_utterances", rf"""{_line_chunks_sql()}, p AS (SELECT DISTINCT documentId, pageIndex FROM seg), q AS (SELECT p.*, v.i AS positionId, CAST(0.1 AS DOUBLE) + CAST(0.2 AS DOUBLE) * v.i AS yy FROM p, (VALUES (0), (1), (2), (3), (4)) AS v(i)),
    s AS (SELECT *, {squeeze('c')} AS s FROM lc), n AS (SELECT *, {cnt('s', CJK)} AS cj, {cnt('s', r"\p{Latin}+(?:[’'-]\p{Latin}+)*")} + {cnt('s', r'\p{N}+(?:[.,]\p{N}+)*')} AS w, {cnt('s', r'[\p{L}\p{N}]')} AS u FROM s),
    b AS (SELECT *, CASE WHEN cj + w > 0 THEN (cj / 300.0::DOUBLE + w / 165.0::DOUBLE) * 60 ELSE u / 5.0::DOUBLE END AS base FROM n), e AS (SELECT b.documentId, b.pageIndex, positionId, k, base, greatest(0, (least(1, t + hh) - yy) * 800 / 12) AS win FROM b JOIN q ON b.documentId = q.documentId AND b.pageIndex = q.pageIndex),
    f AS (SELECT *, greatest(0, win - 0.65::DOUBLE) AS free FROM e), r AS (SELECT *, greatest(1.5::DOUBLE, least(2.5::DOUBLE, ceil(greatest(1.5::DOUBLE, base / free) * 100) / 100)) AS speed FROM f WHERE base > 0 AND free > 0 AND base / free <= 2.5::DOUBLE)
    SELECT documentId, pageIndex, positionId, k AS chunk, round(speed, 6) AS speed, round(base / speed, 6) AS seconds, round(win, 6) AS visible FROM r""")
def whole_utterances(spark, d):
    """The plans that speak a chunk whole before it has passed the reading line."""
    p = K.plan_utterances(positions(spark, d), line_chunks(spark, d), 12.0, 800.0).where("decision = 'full'")
    return p.select("documentId", "pageIndex", "positionId", F.col("chunkIndex").alias("chunk"), F.round("speed", 6).alias("speed"), F.round("estimatedSpeechSeconds", 6).alias("seconds"), F.round("visualWindowSeconds", 6).alias("visible"))


@query("ahead_page", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND value >= 1 AND floor(value) < 60 THEN CAST(floor(value) AS BIGINT) + 1 END AS page FROM events")
def ahead_page(spark, d):
    e = events(spark, d).select("event_id", (F.col("event_id") % 2 == 0).alias("enabled"), F.lit("snow-mist").alias("tierKey"), F.lit(True).alias("isPlaying"), F.lit(False).alias("workloadActive"), F.floor("value").alias("currentPage"), F.lit(60).alias("pageCount"), F.lit(True).alias("nextPageNativeKnown"), *[F.lit(False).alias(c) for c in ("nextPageTtsReady", "nextPageOcrKnown", "nextPageFailed")])
    return e.select("event_id", K.ahead_page().alias("page"))


@query("page_turns", "SELECT event_id, coalesce(prev > 0 AND nxt = prev + 1, false) AS preserved FROM (SELECT event_id, CAST(floor(value / 25) AS BIGINT) AS nxt, lag(CAST(floor(value / 25) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)")
def page_turns(spark, d):
    w = W.partitionBy("user_id").orderBy("event_id")
    e = events(spark, d).withColumn("nextPage", F.floor(F.col("value") / 25)).withColumn("previousPage", F.lag("nextPage").over(w))
    e = e.withColumns({"enabled": F.lit(True), "tierKey": F.lit("snow-mist"), "direction": F.lit(1), "jumped": F.lit(False)})
    return e.select("event_id", K.preserves_speech("snow-mist").alias("preserved"))


@query("tier_changes", f"SELECT event_id, coalesce(tier <> prev, false) AS cancelled FROM (SELECT event_id, {TIER.format(x='value % 70')} AS tier, lag({TIER.format(x='value % 70')}) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)")
def tier_changes(spark, d):
    w = W.partitionBy("user_id").orderBy("event_id")
    e = events(spark, d).withColumn("nextTierKey", R.speed_tier(F.col("value") % 70)).withColumn("previousTierKey", F.lag("nextTierKey").over(w)).withColumn("enabled", F.lit(True))
    return e.select("event_id", K.cancels_transition().alias("cancelled"))


def readings(spark, d):
    """A reader's positions run forward and jump back now and then."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    e = events(spark, d).select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("reader"), F.col("event_id").alias("step"), (n * 30 + F.floor(F.col("value")) % 40).cast("double").alias("position"))
    return e


READINGS = "rd AS (SELECT 'r' || user_id AS reader, event_id AS step, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 30 + CAST(floor(value) AS BIGINT) % 40 AS DOUBLE) AS position FROM events), ps AS (SELECT reader, 'p' || k.i AS key, CAST(k.i * 100 + 50 AS DOUBLE) AS start, CAST(k.i * 100 + 130 AS DOUBLE) AS stop FROM (SELECT reader, CAST(max(position) AS BIGINT) AS last FROM rd GROUP BY reader), unnest(range(0, last // 100 + 1)) AS k(i))"


def passages_of(spark, d):
    """A passage every 100, up to each reader's last position."""
    p = readings(spark, d).groupBy("reader").agg(F.max("position").cast("long").alias("last"))
    p = p.select("reader", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("last div 100"))).alias("k"))
    return p.select("reader", F.concat(F.lit("p"), F.col("k").cast("string")).alias("key"), F.lit("Lead.").alias("lead"), (F.col("k") * 100 + 50).cast("double").alias("start"), (F.col("k") * 100 + 130).cast("double").alias("end"))


@query("flow_crossings", f"WITH {READINGS}, s AS (SELECT reader, step, position, lag(position) OVER (PARTITION BY reader ORDER BY step) AS bef FROM rd), e AS (SELECT reader, key, start AS place, 'start' AS edge FROM ps UNION ALL SELECT reader, key, stop, 'tail' FROM ps) SELECT s.reader, s.step, e.key, e.edge, e.place, CAST(row_number() OVER (PARTITION BY s.reader, s.step ORDER BY place, CASE WHEN edge = 'tail' THEN 0 ELSE 1 END, key) - 1 AS INTEGER) AS ordinal FROM s JOIN e ON s.reader = e.reader AND bef < place AND place <= position")
def flow_crossings(spark, d):
    return FL.crossings(readings(spark, d), passages_of(spark, d))


# Readings begin before the second passage and passages don't touch: a paragraph is prepared when the start of the one
# before it is first passed (or is passed already where a reader begins), and dropped when that one's end is first passed.
@query("flow_actions", f"""WITH {READINGS}, s AS (SELECT reader, step, position, lag(position) OVER (PARTITION BY reader ORDER BY step) AS bef FROM rd), k AS (SELECT reader, CAST(substr(key, 2) AS BIGINT) AS k, start, stop, max(CAST(substr(key, 2) AS BIGINT)) OVER (PARTITION BY reader) AS top FROM ps),
    a AS (SELECT s.reader, 'prepare' AS type, k, NULL AS reason, min(step) AS step FROM s JOIN k ON s.reader = k.reader AND start <= position AND (bef < start OR (bef IS NULL AND position < stop)) WHERE k < top GROUP BY ALL
        UNION ALL SELECT s.reader, 'discard-prepared', k, 'late-or-missing', min(step) FROM s JOIN k ON s.reader = k.reader AND stop <= position AND bef < stop WHERE k < top GROUP BY ALL)
    SELECT reader, step, type, 'p' || (k + 1) || ':lead' AS key, reason FROM a""")
def flow_actions(spark, d):
    r = readings(spark, d).withColumns({"context": F.lit("0:0"), "playing": F.lit(True), "ready": F.lit(None).cast("string"), "jumped": F.lit(False)})
    return FL.fold(r, passages_of(spark, d))


@query("flow_bootstrap", f"""WITH {READINGS}, p AS (SELECT reader, step, position FROM rd), i AS (SELECT p.reader, p.step, min(CASE WHEN start <= position AND position < stop THEN CAST(substr(key, 2) AS INTEGER) END) AS inside, min(CASE WHEN start > position THEN CAST(substr(key, 2) AS INTEGER) END) AS nxt FROM p JOIN ps USING (reader) GROUP BY ALL)
    SELECT reader, step, 'p' || CASE WHEN inside IS NOT NULL THEN inside + 1 ELSE nxt END AS key FROM i JOIN (SELECT reader, max(CAST(substr(key, 2) AS INTEGER)) AS top FROM ps GROUP BY reader) USING (reader) WHERE CASE WHEN inside IS NOT NULL THEN inside < top ELSE nxt > 0 END""")
def flow_bootstrap(spark, d):
    p = readings(spark, d).withColumnRenamed("step", "positionId")
    return FL.bootstrap(p, passages_of(spark, d)).withColumnRenamed("positionId", "step")


@query("flow_contexts", "WITH m AS (SELECT 'r' || user_id AS reader, event_id AS step, event_id // 400 AS g, CAST(floor(value / 25) AS BIGINT) AS pg, CASE WHEN value > 50 THEN 'native' ELSE 'ocr' END AS src FROM events), f AS (SELECT *, coalesce(g <> lag(g) OVER w, true) AS fresh, coalesce(g = lag(g) OVER w AND ((pg <> lag(pg) OVER w AND pg <> lag(pg) OVER w + 1) OR (pg = lag(pg) OVER w AND src <> lag(src) OVER w)), false) AS moved FROM m WINDOW w AS (PARTITION BY reader ORDER BY step)) SELECT reader, step, CAST(sum(moved::INT) OVER (PARTITION BY reader, g ORDER BY step) AS BIGINT) AS revision FROM f")
def flow_contexts(spark, d):
    e = events(spark, d).select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("reader"), F.col("event_id").alias("step"), F.floor(F.col("event_id") / 400).alias("generation"), F.floor(F.col("value") / 25).alias("pageNumber"), F.when(F.col("value") > 50, "native").otherwise("ocr").alias("source"))
    return FL.contexts(e).select("reader", "step", F.col("contentRevision").alias("revision"))


@query("debounced_requests", """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS queue, event_id * 13 AS tm, event_type AS key FROM events),
    r AS (SELECT queue, min(tm) AS began FROM e GROUP BY queue UNION ALL SELECT r.queue, (SELECT min(tm) FROM e WHERE e.queue = r.queue AND e.tm >= r.began + 180) FROM r WHERE r.began IS NOT NULL)
    SELECT r.queue, r.began + 180 AS "firedMs", arg_max(e.key, e.tm) AS key FROM r JOIN e ON e.queue = r.queue AND e.tm >= r.began AND e.tm < r.began + 180 GROUP BY r.queue, r.began""")
def debounced_requests(spark, d):
    e = events(spark, d).select(F.col("user_id").cast("string").alias("queue"), (F.col("event_id") * 13).alias("atMs"), F.col("event_type").alias("key"))
    return FL.debounced(e)


@query("settled_changes", f"""WITH c AS (SELECT user_id, event_id * 13 AS tm, event_id % 6 AS f, CAST(floor(value) AS BIGINT) % 6 AS t FROM events), d AS (SELECT *, coalesce(tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm) >= 2600, true) AS fresh FROM c WHERE f <> t), r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY tm) AS run FROM d)
    SELECT CAST(user_id AS VARCHAR) AS queue, arg_min(f, tm) AS fromIndex, arg_max(t, tm) AS toIndex, max(tm) + 2600 AS firedMs FROM r GROUP BY user_id, run HAVING arg_min(f, tm) <> arg_max(t, tm)""")
def settled_changes(spark, d):
    e = events(spark, d).select(F.col("user_id").cast("string").alias("queue"), (F.col("event_id") * 13).alias("atMs"), (F.col("event_id") % 6).alias("fromIndex"), (F.floor("value") % 6).alias("toIndex"))
    return FL.settled_changes(e, 2600)


@query("late_events", "SELECT event_type, count(*) AS kept FROM events WHERE ts <= date_trunc('minute', ts) + INTERVAL 30 SECOND + INTERVAL 120 MILLISECOND GROUP BY event_type")
def late_events(spark, d):
    e = events(spark, d).withColumn("deadline", F.date_trunc("minute", "ts") + F.expr("INTERVAL 30 SECONDS"))
    return SF.on_time(e, "ts", "deadline").groupBy("event_type").agg(F.count("*").alias("kept"))


def history_updates(spark, d):
    e = events(spark, d)
    return e.select(F.concat(F.lit("File "), F.col("user_id").cast("string"), F.lit(".pdf")).alias("fileName"), F.lit(1000).alias("fileSize"), F.lit(0).alias("lastModified"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("at"), F.floor(F.col("value") / 10).alias("lastPageIndex"), (F.col("value") * 3).alias("lastScrollTop"), (F.col("value") / 80).alias("progressRatio"), (F.col("value") % 90).alias("lastSpeedPxPerSecond"), F.when(F.col("event_type") == "click", R.speed_tier(F.col("value") % 90)).alias("lastBandKey"))


@query("history_records", f"""SELECT 'File ' || user_id || '.pdf' AS file, arg_max(CAST(floor(value / 10) AS BIGINT), event_id) AS page, round(greatest(0, least(1, arg_max(value / 80, event_id))), 6) AS progress, CAST(greatest(4, least(64, floor(arg_max(value % 90, event_id) + 0.5))) AS INTEGER) AS speed,
    coalesce(arg_max({TIER.format(x='value % 90')}, event_id) FILTER (WHERE event_type = 'click'), 'long-day') AS band, CAST(min(event_id) AS VARCHAR) AS opened, CAST(max(event_id) AS VARCHAR) AS updated FROM events GROUP BY user_id""")
def history_records(spark, d):
    r = H.document_updates(history_updates(spark, d))
    return r.select(F.col("fileName").alias("file"), F.col("lastPageIndex").alias("page"), F.round("progressRatio", 6).alias("progress"), F.col("lastSpeedPxPerSecond").alias("speed"), F.col("lastBandKey").alias("band"), F.col("openedAt").alias("opened"), F.col("updatedAt").alias("updated"))


@query("history_upsert", "SELECT 'File ' || user_id || '.pdf' AS file, CAST(min(event_id) AS VARCHAR) AS opened, CAST(max(event_id) AS VARCHAR) AS updated FROM events GROUP BY user_id")
def history_upsert(spark, d):
    u = history_updates(spark, d)
    mid = F.coalesce(u.agg(F.expr("percentile(seq, 0.5)")).scalar(), F.lit(0.0))
    old, new = H.document_updates(u.where(F.col("seq") < mid)), H.document_updates(u.where(F.col("seq") >= mid))
    return H.upsert(old, new).select(F.col("fileName").alias("file"), F.col("openedAt").alias("opened"), F.col("updatedAt").alias("updated"))


@query("rhythm_records", "SELECT CAST(user_id AS VARCHAR) AS document, s AS speed, event_id AS seq FROM (SELECT user_id, event_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id DESC) AS n FROM (SELECT user_id, event_id, greatest(0, CAST(floor(value + 0.5) AS BIGINT)) AS s FROM events)) WHERE n = 1")
def rhythm_records(spark, d):
    e = events(spark, d).select(F.col("user_id").cast("string").alias("documentId"), F.col("event_id").alias("seq"), F.col("value").alias("speed"))
    return H.rhythm_records(e).select(F.col("documentId").alias("document"), "speed", "seq")


@query("reading_rhythm", rf"""{SEGMENTS}, s AS (SELECT documentId, pageIndex, CAST(sum({cnt('text', r"\p{Latin}+(?:['’\-]\p{Latin}+)*")}) AS BIGINT) AS eng, CAST(sum({cnt('text', CJK)}) AS BIGINT) AS cjk, CAST(sum({cnt('text', r'\p{Nd}')}) AS BIGINT) AS num FROM seg GROUP BY ALL),
    w AS (SELECT documentId, pageIndex, sum(eng) OVER o AS we, sum(cjk) OVER o AS wc, sum(num) OVER o AS wn, count(*) OVER o * 792.0::DOUBLE AS h FROM s WINDOW o AS (PARTITION BY documentId ORDER BY pageIndex RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    e AS (SELECT CAST(user_id AS VARCHAR) AS documentId, event_id AS seq, CAST(floor(value / 25) AS BIGINT) AS pageIndex, greatest(0, CAST(floor(value % 90 + 0.5) AS BIGINT)) AS speed FROM events),
    j AS (SELECT e.*, CASE WHEN we >= 20 AND wc >= 20 AND wc / (wc + we)::DOUBLE >= 0.15::DOUBLE AND we / (wc + we)::DOUBLE >= 0.15::DOUBLE OR wc >= we THEN floor((wc + wn) / h * speed * 60 + 0.5) ELSE 0 END AS cr, floor(we / h * speed * 60 + 0.5) AS er FROM e JOIN w ON e.documentId = w.documentId AND e.pageIndex = w.pageIndex WHERE wc + we > 0)
    SELECT documentId AS document, seq, speed, pageIndex AS page, {TIER.format(x='speed')} AS band, CAST(floor(cr * 0.88::DOUBLE + 0.5) AS BIGINT) AS cjk_min, CAST(floor(cr * 1.12::DOUBLE + 0.5) AS BIGINT) AS cjk_max, CAST(floor(er * 0.88::DOUBLE + 0.5) AS BIGINT) AS english_min, CAST(floor(er * 1.12::DOUBLE + 0.5) AS BIGINT) AS english_max
    FROM j QUALIFY row_number() OVER (PARTITION BY documentId ORDER BY speed DESC, seq DESC) = 1""")
def reading_rhythm(spark, d):
    """The whole way of a reading into its document's record: words around its page, rates at its speed, the last of the
    fastest stays. A user reads the document of that number."""
    s = segments(spark, d).select("documentId", "pageIndex", R.text_stats(F.col("text")).alias("s")).groupBy("documentId", "pageIndex").agg(*[F.sum(f"s.{k}").alias(k) for k in ("cjkCharacters", "numericUnits", "englishWords")])
    p = s.select("documentId", "pageIndex", F.lit(792.0).alias("height"), F.struct("cjkCharacters", "numericUnits", "englishWords").alias("stats"))
    e = events(spark, d).select(F.col("user_id").cast("string").alias("documentId"), F.col("event_id").alias("seq"), R.js_round(F.col("value") % 90).cast("long").alias("speed"), F.floor(F.col("value") / 25).cast("int").alias("pageIndex"))
    r = H.rhythm_records(H.reading_rhythm(e, p))
    return r.select(F.col("documentId").alias("document"), "seq", F.col("speed").cast("long").alias("speed"), F.col("pageIndex").cast("long").alias("page"), F.col("bandKey").alias("band"), F.col("cjkMin").alias("cjk_min"), F.col("cjkMax").alias("cjk_max"), F.col("englishMin").alias("english_min"), F.col("englishMax").alias("english_max"))


@query("recent_documents", "SELECT file FROM (SELECT 'File ' || user_id || '.pdf' AS file, lpad(CAST(max(event_id) AS VARCHAR), 12, '0') AS updated FROM events GROUP BY user_id) ORDER BY updated DESC, file LIMIT 6")
def recent_documents(spark, d):
    r = H.document_updates(history_updates(spark, d)).withColumn("updatedAt", F.lpad("updatedAt", 12, "0"))
    return H.recent(r, 6).select(F.col("fileName").alias("file"))


@query("latest_echo", "SELECT arg_max(user_id, event_id) AS document FROM events")
def latest_echo(spark, d):
    r = events(spark, d).select(F.col("user_id").alias("documentId"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("recordedAt"))
    return H.latest_echo(r).select(F.col("documentId").alias("document"))


@query("removed_documents", "SELECT DISTINCT user_id FROM events WHERE user_id % 3 <> 0")
def removed_documents(spark, d):
    r = events(spark, d).select("user_id").distinct()
    return H.without(r, r.where("user_id % 3 = 0"), "user_id")


@query("handled_keys", "SELECT user_id, array_to_string(list_slice(k, greatest(1, len(k) - 2), len(k)), ',') AS keys FROM (SELECT user_id, list(event_type ORDER BY f) AS k FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id)")
def handled_keys(spark, d):
    k = events(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"]).alias("k"))
    return k.select("user_id", F.array_join(H.bounded(F.col("k"), 3), ",").alias("keys"))


@query("eviction_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY abs(event_id % 40 - 20) DESC, value, event_id % 40, event_id) AS n FROM events")
def eviction_order(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("documentId"), "event_id", (F.col("event_id") % 40).alias("page"), F.lit(20).alias("currentPage"), F.col("value").alias("usedAt"))
    return H.eviction_order(e, "event_id").select(F.col("documentId").alias("user_id"), "event_id", F.col("evictRank").cast("long").alias("n"))


@query("activity_windows", "SELECT to_timestamp(floor(epoch(ts) / 600) * 600)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def activity_windows(spark, d):
    return SF.activity(events(spark, d)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("progress_labels", "SELECT event_id, CASE WHEN pg > 0 AND pc > 0 THEN '第 ' || pg || ' 页 · ' || pc || '%' WHEN pg > 0 THEN '第 ' || pg || ' 页' ELSE '还在书页开头' END AS label FROM (SELECT event_id, CAST(floor(value / 10) AS BIGINT) AS pg, CAST(floor(value / 500 * 100 + 0.5) AS BIGINT) AS pc FROM events)")
def progress_labels(spark, d):
    return events(spark, d).select("event_id", R.progress_label(F.floor(F.col("value") / 10), F.col("value") / 500).alias("label"))
