"""What a reader's session remembers: ticks of the speech controller, point reading, revisions, windows, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import finite
from . import runs

#: Policies whose speech starts by itself.
AUTOMATIC = ("continuous", "paragraph-lead")


def ticks(picked: DataFrame) -> DataFrame:
    """picked: reader, step, enabled, autoRead, isPlaying, manual, key (of the chunk picked, or null) and decision (of its
    plan, or null). Adds status: what the tick does. A key that was spoken or skipped last is not taken up again, unless
    asked for; what is asked for is always spoken. Null where nothing happens."""
    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    runs = b("enabled") & (b("manual") | F.col("autoRead").isin(*AUTOMATIC))
    takes = runs & (b("isPlaying") | b("manual"))
    before = W.partitionBy("reader").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    # the key of the last tick that had one is the last key taken up: a tick repeats it or replaces it
    last = F.last(F.when(takes, F.col("key")), ignorenulls=True).over(before)
    d = picked.withColumn("_last", last)
    status = (
        F.when(~runs, None).when(~takes, "paused").when(F.col("key").isNull(), "waiting-for-readable-chunk").when(~b("manual") & F.coalesce(F.col("key") == F.col("_last"), F.lit(False)), None)
        .when(~b("manual") & F.coalesce(F.col("decision") == "skip", F.lit(False)), "visual-skip").otherwise("speaking")
    )
    return d.withColumn("status", status).drop("_last")


def point_session(actions: DataFrame, steps: int = runs.STEPS) -> DataFrame:
    """actions: reader, step, action (begin, settle, interrupt, cancel), wasPlaying, speed, token (the generation that
    settles, null for the latest) and outcome. One row an action: generation, active, shouldPause, holdActive, accepted,
    shouldResume, resumeSpeed. The last click wins: a new begin replaces the current one but keeps what was playing
    before the first, unless the reader stepped in; only the current one settles, and only a natural end resumes.

    No fold: the generation is a running sum; whether a session is on, whether the reader stepped in, and what played
    before it are each the last of the rows that decide it, one after the other. A reader is dealt out in blocks of steps."""
    is_ = lambda *x: F.coalesce(F.col("action").isin(*x), F.lit(False))
    order = ["step", "action", "wasPlaying", "speed", "token", "outcome"]
    along = lambda d, **last: runs.carried(d, ["reader"], "_block", order, last)
    d = actions.select("reader", *order).withColumn("_block", F.expr(f"cast(step AS bigint) div {steps}"))
    d = runs.carried(d, ["reader"], "_block", order, {}, {"_g": is_("begin", "cancel").cast("int")})
    current = is_("settle") & (F.coalesce("token", "_g") == F.col("_g"))  # if a session is on, it is the one that settles
    d = along(d, _on=F.when(is_("begin"), True).when(is_("cancel") | current, False)).withColumn("_on", F.coalesce("_on", F.lit(False)))
    d = d.withColumn("_mine", current & F.col("_on"))
    d = along(d, _cut=F.when(is_("begin", "cancel"), False).when(is_("interrupt") & F.col("_on"), True)).withColumn("_cut", F.coalesce("_cut", F.lit(False)))
    fresh = is_("begin") & ~(F.col("_on") & ~F.col("_cut"))
    played = F.coalesce("wasPlaying", F.lit(False))
    d = along(d, _base=F.when(fresh, F.struct(played.alias("was"), F.when(~F.isnan("speed"), F.col("speed")).alias("speed"))))
    on = F.when(is_("begin"), True).when(F.col("_mine") | is_("cancel"), False).otherwise(F.col("_on"))
    was = F.when(fresh, played).otherwise(F.coalesce(F.col("_on") & F.col("_base.was"), F.lit(False)))
    cut = F.when(is_("begin", "cancel"), False).when(is_("interrupt") & F.col("_on"), True).otherwise(F.col("_cut"))
    resumes = F.col("_mine") & (F.coalesce("outcome", F.lit("ended")) == "ended") & F.coalesce("_base.was", F.lit(False)) & ~F.col("_cut")
    return d.select(
        "reader", F.col("step").cast("long").alias("step"), F.col("_g").cast("int").alias("generation"), on.alias("active"), (is_("begin") & played).alias("shouldPause"),
        (on & was & ~cut).alias("holdActive"), F.col("_mine").alias("accepted"), resumes.alias("shouldResume"), F.when(resumes, F.col("_base.speed")).alias("resumeSpeed"),
    )


def revisions(changes: DataFrame) -> DataFrame:
    """changes: documentId, pageNumber, source, step. The revision of a page's source after each of its changes."""
    w = W.partitionBy("documentId", "pageNumber", "source").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return changes.withColumn("revision", F.count("*").over(w))


def window_sources(entries: Column) -> Column:
    """Array of (pageNumber, source, revision), coerced, without pages below 1, by page."""
    whole = lambda c: F.greatest(F.lit(0), F.floor(finite(c) + 0.5)).cast("int")
    clean = F.transform(entries, lambda e: F.struct(whole(e["pageNumber"]).alias("pageNumber"), F.coalesce(e["source"], F.lit("none")).alias("source"), whole(e["revision"]).alias("revision")))
    return F.array_sort(F.filter(clean, lambda e: e["pageNumber"] > 0), lambda a, b: a["pageNumber"] - b["pageNumber"])


def window_differs(before: Column, after: Column) -> Column:
    """Whether pages that two windows (of window_sources) share differ. Windows without a common page differ, unless both
    are empty."""
    pages = lambda c: F.transform(c, lambda e: e["pageNumber"])
    shared = F.array_intersect(pages(before), pages(after))
    of = lambda c: F.filter(c, lambda e: F.array_contains(shared, e["pageNumber"]))
    return F.when((F.size(before) == 0) & (F.size(after) == 0), False).when(F.size(shared) == 0, True).otherwise(of(before) != of(after))


def ordered_pages(first: Column, *lists: Column) -> Column:
    """The first page, then those of the lists, each once and in order of first appearance; none below 1."""
    return F.filter(F.array_distinct(F.concat(F.array(first), *lists)), lambda p: p >= 1)


def synthesis_totals(results: DataFrame) -> DataFrame:
    """results: request and the figures of its parts. What the whole request reports; what is no number counts as 0."""
    total = lambda c: F.sum(finite(F.col(c))).alias(c)
    return results.groupBy("request").agg(F.count("*").alias("parts"), total("durationMs"), total("phonemeCount"), total("unknownPhonemeCount"))


#: The voices that a request may name.
VOICES = [
    "af_heart", "af_alloy", "af_aoede", "af_bella", "af_jessica", "af_kore", "af_nicole", "af_nova", "af_river", "af_sarah", "af_sky",
    "am_adam", "am_echo", "am_eric", "am_fenrir", "am_liam", "am_michael", "am_onyx", "am_puck", "am_santa",
    "bf_emma", "bf_isabella", "bm_george", "bm_lewis", "bf_alice", "bf_lily", "bm_daniel", "bm_fable",
    "zf_xiaobei", "jf_alpha",
]


def safe_voice(voice: Column) -> Column:
    v = F.trim(F.coalesce(voice, F.lit(VOICES[0])))
    return F.when(v.isin(*VOICES), v).otherwise(VOICES[0])


def safe_speed(speed: Column) -> Column:
    """A requested speed within what is spoken; 1 if it is no number."""
    return F.greatest(F.lit(0.9), F.least(F.lit(1.85), finite(speed, 1.0)))
