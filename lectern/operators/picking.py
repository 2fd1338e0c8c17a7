"""Speech policies, eligibility, and what to read at a reading position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import reading as R
from ..functions import text as T
from ..functions.sentences import first_sentence, sentences, strip_balanced
from .layout import PAGE

COMMON = ["reference", "table", "formula"]
#: One row for each tier of the speech policy.
POLICIES = [
    ("snow-mist", "continuous", False, "reading-line-chunk", "current-utterance-started", "readable-chunk", "chunk", "skip", "comfortable", None, None, True, "next-readable-chunk", COMMON, False, "keep", None, None),
    ("aesthetic-walk", "continuous", False, "reading-line-chunk", "current-utterance-started", "visual-window-utterance", "utterance", "shorten-at-sentence-or-skip", "follow-scroll", 1.5, 2.5, True, "next-eligible-utterance", [*COMMON, "footnote", "annotation"], True, "strip-balanced", None, None),
    ("long-day", "none", True, "manual-line-action", None, "nearest-sentence-below-line", "request", "play-once", "comfortable", None, None, False, None, COMMON, False, "keep", "read-line-sentence", "KeyR"),
    ("winding-stream", "paragraph-lead", False, "paragraph-tail-crossed", "paragraph-start-crossed", "next-paragraph-lead-sentence", "paragraph", "skip", "comfortable", None, None, True, "next-paragraph-lead-sentence", [*COMMON, "footnote", "annotation", "heading"], True, "keep", None, None),
    ("strong-wind", "none", False, "point-click", None, "pointed-sentence", "request", "play-once", "comfortable", None, None, False, None, COMMON, False, "keep", "point-sentence", None),
    ("all-things-flourish", "none", False, "point-click", None, "pointed-sentence", "request", "play-once", "comfortable", None, None, False, None, COMMON, False, "keep", "point-sentence", None),
]
SCHEMA = "tierKey string, autoRead string, lineVisible boolean, playTrigger string, prefetchTrigger string, scope string, oncePer string, latePolicy string, speechRate string, minRate double, maxRate double, prefetch boolean, prefetchTarget string, excludedRoles array<string>, excludeAnnotations boolean, parentheticals string, manualAction string, manualShortcut string"


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, SCHEMA)


def resolve_policies(requests: DataFrame) -> DataFrame:
    """requests: tierKey, enabled. The policy of each, long-day for unknown tiers; what is off reads nothing by itself."""
    p = policies(requests.sparkSession)
    keys = [r[0] for r in POLICIES]
    d = requests.withColumn("_k", F.when(F.col("tierKey").isin(*keys), F.col("tierKey")).otherwise("long-day")).drop("tierKey")
    d = d.join(F.broadcast(p.withColumnRenamed("tierKey", "_k")), "_k").withColumnRenamed("_k", "tierKey")  # six rows
    on = F.coalesce("enabled", F.lit(False))
    off = {"autoRead": F.lit("none"), "lineVisible": F.lit(False), "prefetch": F.lit(False), "manualAction": F.lit(None).cast("string"), "manualShortcut": F.lit(None).cast("string")}
    return d.withColumns({k: F.when(on, F.col(k)).otherwise(v) for k, v in off.items()}).withColumn("enabled", on)


def chunk_key() -> Column:
    return F.concat_ws(":", F.coalesce("source", F.lit("unknown")), F.coalesce("pageIndex", F.lit(0)).cast("string"), F.coalesce("chunkIndex", F.lit(0)).cast("string"))


def ocr_task_key(generation: Column, center: Column, priority: Column) -> Column:
    """The key of a recognition task: its generation, the page at the centre and the page that goes first; 0 for what is
    unknown."""
    return F.concat_ws(":", *[G.finite(c).cast("long").cast("string") for c in (generation, center, priority)])


def is_readable(least: float = 0.5) -> Column:
    return F.coalesce(F.col("text").rlike(T.NOT_WS) & F.col("normalizedBbox").isNotNull() & (F.coalesce("priority", F.lit(0.0)) >= least) & ~F.coalesce(F.col("role").isin(*COMMON), F.lit(False)), F.lit(False))


def is_margin_noise() -> Column:
    b = F.col("normalizedBbox")
    return F.coalesce((F.char_length(T.trim(F.col("text"))) <= 120) & ((b["y"] < 0.055) | (b["y"] + b["height"] > 0.945)), F.lit(False))


def is_heading_or_short() -> Column:
    return (F.col("role") == "heading") | (F.char_length(T.trim(F.col("text"))) <= 90)


def is_speakable(allow_footnote: bool = False, lead: bool = False) -> Column:
    ok = F.col("text").rlike(T.NOT_WS) & ~F.coalesce(F.col("role").isin(*COMMON), F.lit(False)) & ~F.array_contains("qualityFlags", "bibliographic") & ~is_margin_noise()
    ok = ok if allow_footnote else ok & (F.coalesce("role", F.lit("")) != "footnote")
    return F.coalesce(ok & is_heading_or_short() if lead else ok, F.lit(False))


def may_be_allowed(explicit: bool = False) -> Column:
    """What every policy asks of a chunk."""
    ok = F.col("text").rlike(T.NOT_WS) & ~is_margin_noise() & ~F.array_contains("qualityFlags", "bibliographic")
    return F.coalesce(ok & F.col("normalizedBbox").isNotNull() if explicit else ok, F.lit(False))


def is_allowed(explicit: bool = False) -> Column:
    """By the columns of a joined policy, of chunks that may be allowed."""
    ok = F.col("enabled") & ~F.coalesce(F.array_contains("excludedRoles", F.col("role")), F.lit(False))
    ok = ok if explicit else ok & ~(F.col("excludeAnnotations") & F.coalesce(F.col("role") == "annotation", F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def without_brackets(plain: Column) -> Column:
    """Squeezed text without balanced brackets; a text that opens none is as it is, and isn't sent to Python."""
    opens = F.contains(plain, F.lit("(")) | F.contains(plain, F.lit("（"))
    return F.when(opens, strip_balanced(F.when(opens, plain))).otherwise(plain)


def by_policy(chunks: DataFrame, resolved: DataFrame, explicit: bool = False) -> DataFrame:
    """Chunks that each resolved policy allows, with the text as it would be spoken. A chunk meets one row for each
    policy asked for (six tiers at most)."""
    own = T.once(chunks.where(may_be_allowed(explicit)), "_plain", T.squeeze(F.col("text")))  # a chunk's own, whatever the policies
    own = own.withColumn("_bare", without_brackets(F.col("_plain")))
    d = own.join(F.broadcast(resolved.select("tierKey", "enabled", "excludedRoles", "excludeAnnotations", "parentheticals").distinct()))
    text = F.when(F.col("parentheticals") == "strip-balanced", F.col("_bare")).otherwise(F.col("_plain"))
    return d.where(is_allowed(explicit)).withColumn("text", text).where("text <> ''").drop("enabled", "excludedRoles", "excludeAnnotations", "parentheticals", "_plain", "_bare")


def speech_text(first_only: bool = False) -> Column:
    t = T.squeeze(F.col("text"))
    return first_sentence(t) if first_only else t


def pick_chunks(positions: DataFrame, chunks: DataFrame, behind: float = 0.045, ahead: float = 0.16, excluded: DataFrame | None = None) -> DataFrame:
    """positions: documentId, pageIndex, positionId, y. The best chunk at each: nearest to the line, later ones before
    those passed, weighted by priority. excluded: keys not to be picked."""
    c = chunks.where(is_readable()).withColumn("key", chunk_key())
    if excluded is not None:
        c = c.join(excluded.select("key").distinct(), "key", "left_anti")
    d = positions.withColumn("y", G.clamp(G.finite(F.col("y"), 0.38))).join(c, PAGE)
    b = F.col("normalizedBbox")
    centre = b["y"] + b["height"] / 2
    d = d.where((b["y"] + b["height"] >= F.col("y") - behind) & (b["y"] <= F.col("y") + ahead))
    d = d.withColumn("distance", G.distance_to_line(b, F.col("y")))
    score = F.col("distance") + F.when(centre < F.col("y") - behind, 0.2).otherwise(0.0) + (1 - F.coalesce("priority", F.lit(0.0))) * 0.08
    best = F.min_by(F.struct("key", "chunkIndex", "text", "distance"), F.struct(score.alias("s"), centre.alias("c"), F.col("chunkIndex").alias("i")))
    return d.groupBy(*PAGE, "positionId", "y").agg(best.alias("b")).select(*PAGE, "positionId", "y", "b.*")


def pick_sentences(positions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first sentence at or below each position; a sentence's place within its chunk goes by characters."""
    c = chunks.where(is_readable()).withColumn("key", chunk_key()).withColumn("_s", sentences(F.col("text")))
    c = c.withColumn("_n", F.aggregate("_s", F.lit(0), lambda a, s: a + F.char_length(s))).where("_n > 0")
    e = c.select(*PAGE, "key", "chunkIndex", "normalizedBbox", "_n", F.posexplode("_s").alias("sentenceIndex", "text"))
    before = W.partitionBy(*PAGE, "key").orderBy("sentenceIndex").rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("_at", F.coalesce(F.sum(F.char_length("text")).over(before), F.lit(0)))
    e = e.withColumn("sentenceY", F.col("normalizedBbox.y") + F.col("normalizedBbox.height") * (F.col("_at") / F.col("_n")))
    d = positions.withColumn("y", G.clamp(G.finite(F.col("y"), 0.38))).join(e, PAGE).where(F.col("sentenceY") >= F.col("y"))
    best = F.min_by(F.struct("key", "sentenceIndex", "text", (F.col("sentenceY") - F.col("y")).alias("distance")), F.struct("sentenceY", "chunkIndex", "sentenceIndex"))
    return d.groupBy(*PAGE, "positionId", "y").agg(best.alias("b")).select(*PAGE, "positionId", "y", F.concat("b.key", F.lit(":sentence:"), F.col("b.sentenceIndex").cast("string")).alias("key"), "b.sentenceIndex", "b.text", "b.distance")


def next_eligible(chunks: DataFrame) -> DataFrame:
    """For every chunk the key of the next speakable one of its document."""
    later = W.partitionBy("documentId").orderBy("pageIndex", "chunkIndex").rowsBetween(1, W.unboundedFollowing)
    key = F.when(is_speakable(), chunk_key())
    return chunks.select("documentId", "pageIndex", "chunkIndex", chunk_key().alias("key"), F.first(key, ignorenulls=True).over(later).alias("nextKey"))


def plan_utterances(positions: DataFrame, chunks: DataFrame, speed: float, page_height: float, now_ms: int = 0) -> DataFrame:
    """A plan for every readable chunk that a position has not passed: whole, shortened or skipped."""
    c = chunks.where(is_readable())
    for name, value in (("_t", T.squeeze(F.col("text"))), ("_base", R.speech_seconds(F.col("_t"))), ("_f", first_sentence(F.col("_t"))), ("_fbase", R.speech_seconds(F.col("_f")))):
        c = T.once(c, name, value)  # a chunk's own, whatever the positions before it
    window = R.visual_window(F.col("normalizedBbox"), F.col("y"), F.lit(float(page_height)), F.lit(float(speed)))
    d = T.once(positions.join(c, PAGE), "_w", window)
    d = T.once(d, "plan", R.walk_plan(F.col("_t"), F.col("_f"), F.col("_w"), F.lit(now_ms), F.col("_base"), F.col("_fbase")))
    return d.select(*PAGE, "positionId", "chunkIndex", "plan.*")


def ahead_page() -> Column:
    """The page to recognise ahead of continuous reading, or null."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    ok = F.coalesce("enabled", F.lit(False)) & (F.col("tierKey") == "snow-mist") & F.coalesce("isPlaying", F.lit(False)) & no("workloadActive") & (F.col("currentPage") >= 1) & (F.col("currentPage") < F.col("pageCount")) & F.coalesce("nextPageNativeKnown", F.lit(False)) & no("nextPageTtsReady") & no("nextPageOcrKnown") & no("nextPageFailed")
    return F.when(ok, F.col("currentPage") + 1)


def preserves_speech(tier: str) -> Column:
    """Columns enabled, tierKey, previousPage, nextPage, direction, jumped: speech goes on over a turn to the next page."""
    return F.coalesce(F.col("enabled") & (F.col("tierKey") == tier) & (F.col("previousPage") > 0) & (F.col("nextPage") == F.col("previousPage") + 1) & (F.coalesce("direction", F.lit(0)) >= 0) & ~F.coalesce("jumped", F.lit(False)), F.lit(False))


def cancels_transition() -> Column:
    return F.coalesce(F.col("enabled") & (F.col("previousTierKey") != "") & (F.col("nextTierKey") != "") & (F.col("previousTierKey") != F.col("nextTierKey")), F.lit(False))


def may_request() -> Column:
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("readyToMove", "hasActivePdf", "controlAllowed", "enabled", "hasReadableChunks")]
    out = F.coalesce(F.col("manualAction") == F.col("action"), F.lit(False))
    for f in flags:
        out = out & f
    return out


def master_enabled(tts_enabled: Column, tts_mode: Column) -> Column:
    return F.coalesce(tts_enabled, tts_mode.isin("whisper", "flow"), F.lit(False))


def shortcut_action() -> Column:
    return F.when(F.col("code") == "KeyH", "toggle-master").when(F.coalesce(F.col("enabled") & (F.col("code") == F.col("manualShortcut")), F.lit(False)), F.col("manualAction"))
