"""Reading pace: units, rates, density, flow time, speech time and plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .geometry import clamp, finite

#: Upper bounds in px/s and keys of the speed tiers.
TIERS = [(8, "snow-mist", "雪国朦胧"), (14, "aesthetic-walk", "美学散步"), (21, "long-day", "长日留痕"), (31, "winding-stream", "流觞曲水"), (44, "strong-wind", "强风吹拂"), (64, "all-things-flourish", "万物繁盛")]


def js_round(c: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(c + 0.5).cast("long")


def speed_tier(v: Column) -> Column:
    out = F.when(v <= TIERS[0][0], TIERS[0][1])
    for most, key, _ in TIERS[1:]:
        out = out.when(v <= most, key)
    return out.otherwise(TIERS[-1][1])


def tier_index(v: Column) -> Column:
    out = F.when(v <= TIERS[0][0], 0)
    for i, (most, _, _) in enumerate(TIERS[1:], 1):
        out = out.when(v <= most, i)
    return out.otherwise(len(TIERS) - 1)


def text_stats(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    return F.struct(T.count(t, T.CJK).alias("cjkCharacters"), T.count(t, r"\p{Nd}").alias("numericUnits"), T.count(t, rf"{T.LATIN}++(?:['’\-]{T.LATIN}++)*+").alias("englishWords"))


def metric_mode(cjk: Column, english: Column) -> Column:
    total = cjk + english
    both = (cjk >= 20) & (english >= 20) & (cjk / total >= 0.15) & (english / total >= 0.15)
    return F.when(total == 0, "empty").when(both, "both").when(cjk >= english, "cjk").otherwise("english")


def units_per_minute(units: Column, height: Column, speed: Column) -> Column:
    return F.when((units <= 0) | (height <= 0) | (speed <= 0), 0).otherwise(js_round(units / height * speed * 60))


def rate_range(v: Column, spread: float = 0.12) -> Column:
    r = F.greatest(F.lit(0), js_round(finite(v)))
    edge = lambda f: F.when(r == 0, 0).otherwise(F.greatest(F.lit(1), js_round(r * f)))
    return F.struct(edge(1 - spread).alias("min"), edge(1 + spread).alias("max"))


def density_level(ratio: Column) -> Column:
    return F.when(ratio.isNull() | F.isnan(ratio) | (ratio <= 0), "unknown").when(ratio < 0.72, "sparse").when(ratio > 1.42, "dense").when(ratio > 1.16, "slightly-dense").when(ratio < 0.86, "slightly-sparse").otherwise("balanced")


def flow_time(pixels: Column, speed: Column, spread: float = 0.1) -> Column:
    minutes = F.greatest(F.lit(0.0), finite(pixels)) / speed / 60
    edge = lambda f: F.greatest(F.lit(1), js_round(minutes * f))
    return F.when((finite(pixels) > 0) & (finite(speed) > 0), F.struct(edge(1 - spread).alias("minMinutes"), edge(1 + spread).alias("maxMinutes")))


def rhythm_snapshot(mode: Column, cjk_rate: Column, english_rate: Column, density: Column, pixels: Column, speed: Column) -> Column:
    return F.struct(mode.alias("mode"), speed_tier(speed).alias("tier"), rate_range(cjk_rate).alias("cjkRange"), rate_range(english_rate).alias("englishRange"), density_level(density).alias("density"), flow_time(pixels, speed).alias("remainingFlowTime"))


def reading_line(scroll_top: Column, viewport: Column, ratio: float = 0.38) -> Column:
    return F.greatest(F.lit(0.0), finite(scroll_top)) + F.greatest(F.lit(0.0), finite(viewport)) * ratio


def clock_snapshot(playing: Column, speed: Column, scroll_top: Column, viewport: Column, scroll_height: Column, page: Column) -> Column:
    top, view = F.greatest(F.lit(0.0), finite(scroll_top)), F.greatest(F.lit(0.0), finite(viewport))
    height = F.greatest(view, finite(scroll_height))
    return F.struct(
        F.coalesce(playing, F.lit(False)).alias("isPlaying"), F.greatest(F.lit(0.0), finite(speed)).alias("speedPxPerSecond"), top.alias("scrollTop"), view.alias("viewportHeight"), height.alias("scrollHeight"),
        F.greatest(F.lit(0), js_round(finite(page))).alias("currentPageIndex"), reading_line(scroll_top, viewport).alias("readingLineY"), clamp(top / F.greatest(F.lit(1.0), height - view)).alias("progressRatio"),
    )


def speech_seconds(c: Column) -> Column:
    """Seconds of speech at normal speed: 300 Chinese or Japanese characters, or 165 words and numbers a minute."""

    def spoken(t):
        words = T.count(t, rf"{T.LATIN}++(?:[’'-]{T.LATIN}++)*+") + T.count(t, r"\p{N}++(?:[.,]\p{N}++)*+")
        cjk = F.when(T.has_wide(t), T.count(t, T.CJK)).otherwise(0)
        return T.let((cjk / 300.0 + words / 165.0) * 60, lambda s: F.when(s > 0, s).otherwise(T.speakable(t) / 5.0))

    return T.let(T.squeeze(F.coalesce(c, F.lit(""))), spoken)


def visual_window(box: Column, reading_y: Column, page_height: Column, speed: Column) -> Column:
    """Seconds until a chunk has passed the reading line; null if that can't be known."""
    end = clamp(box["y"] + F.greatest(F.lit(0.0), box["height"]))
    return F.when(box.isNotNull() & (page_height > 0) & (speed > 0), F.greatest(F.lit(0.0), (end - clamp(reading_y)) * page_height / speed))


PLAN = "struct<decision:string,text:string,speed:double,estimatedSpeechSeconds:double,visualWindowSeconds:double,latestStartAtMs:bigint>"


def _plan(decision: str, text: Column, speed: Column, seconds: Column, window: Column, latest: Column) -> Column:
    return F.struct(F.lit(decision).alias("decision"), text.alias("text"), speed.cast("double").alias("speed"), seconds.cast("double").alias("estimatedSpeechSeconds"), window.cast("double").alias("visualWindowSeconds"), latest.cast("long").alias("latestStartAtMs"))


def candidate_plan(decision: str, text: Column, window: Column, now_ms: Column, low: float = 1.5, high: float = 2.5, reserve: float = 0.65, base: Column | None = None) -> Column:
    """The plan to speak a text within the window, or null. base: its speech_seconds(), if they are known."""
    base, free = speech_seconds(text) if base is None else base, F.greatest(F.lit(0.0), window - reserve)
    rate = base / free
    speed = clamp(F.ceil(F.greatest(F.lit(low), rate) * 100) / 100, low, high)
    fits = (text != "") & (base > 0) & (free > 0) & (rate <= high)
    return F.when(fits, _plan(decision, text, speed, base / speed, window, js_round(now_ms + F.greatest(F.lit(0.0), window - base / speed) * 1000)))


def walk_plan(text: Column, first_sentence: Column, window: Column, now_ms: Column, base: Column | None = None, first_base: Column | None = None) -> Column:
    """The utterance for a chunk: whole, its first sentence, or none; whole at the least speed without a window. base and
    first_base: the speech_seconds() of the squeezed text, given if base is, and of its first sentence."""
    t = T.squeeze(F.coalesce(text, F.lit(""))) if base is None else text
    none = F.lit(None)
    fallback = F.when(window.isNull(), _plan("fallback", t, F.lit(1.5), (speech_seconds(t) if base is None else base) / 1.5, none, none))
    short = F.when((first_sentence != "") & (first_sentence != t), candidate_plan("shortened", first_sentence, window, now_ms, base=first_base))
    skip = _plan("skip", F.lit(""), F.lit(2.5), F.lit(0.0), window, js_round(now_ms))
    return F.coalesce(fallback, candidate_plan("full", t, window, now_ms, base=base), short, skip)


def plan_signature(plan: Column) -> Column:
    return F.concat_ws("|", plan["decision"], F.format_string("%.2f", plan["speed"]), T.squeeze(plan["text"]))


def plan_late(latest_ms: Column, now_ms: Column, grace: int = 120) -> Column:
    return F.coalesce(now_ms > latest_ms + grace, F.lit(False))


def large_jump(delta: Column, viewport: Column) -> Column:
    return F.abs(finite(delta)) >= F.greatest(F.lit(180.0), F.greatest(F.lit(0.0), finite(viewport)) * 0.45)


def speech_speed(tier: Column) -> Column:
    return F.when(tier == "aesthetic-walk", 1.5).when(tier == "snow-mist", 1.18).otherwise(1.25)


#: Pitches of the tiers, in Hz.
PITCHES = [196, 220, 262, 330, 392, 523]


def cue_direction(a: Column, b: Column) -> Column:
    return F.when(b > a, "up").when(b < a, "down").otherwise("same")


def transition_steps(a: Column, b: Column) -> Column:
    """One struct for each boundary crossed between two tiers."""
    lo, hi = clamp(a, 0, 5), clamp(b, 0, 5)
    sign = F.when(hi > lo, 1).otherwise(-1)
    at = F.sequence(F.lit(0), F.abs(hi - lo) - 1)
    step = lambda i: F.struct(cue_direction(a, b).alias("direction"), (lo + sign * i).alias("fromIndex"), (lo + sign * (i + 1)).alias("toIndex"), (lo + sign * i - F.when(sign < 0, 1).otherwise(0)).alias("boundaryIndex"))
    return F.when(lo == hi, F.array().cast("array<struct<direction:string,fromIndex:int,toIndex:int,boundaryIndex:int>>")).otherwise(F.transform(at, step))


def cue_notes(a: Column, b: Column) -> Column:
    pitch = F.array(*[F.lit(p) for p in PITCHES])
    tiers = F.concat(F.array(clamp(a, 0, 5)), F.transform(transition_steps(a, b), lambda s: s["toIndex"]))
    notes = F.transform(tiers, lambda t, i: F.struct(F.get(pitch, t).alias("frequency"), (i * 92).alias("offsetMs"), F.lit(220).alias("durationMs")))
    return F.when(clamp(a, 0, 5) == clamp(b, 0, 5), F.array().cast("array<struct<frequency:int,offsetMs:int,durationMs:int>>")).otherwise(notes)


def progress_label(page: Column, ratio: Column) -> Column:
    percent = js_round(ratio * 100)
    head = F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页"))
    return F.when((page > 0) & (percent > 0), F.concat(head, F.lit(" · "), percent.cast("string"), F.lit("%"))).when(page > 0, head).otherwise("还在书页开头")


def rate_label(r: Column) -> Column:
    show = lambda c: F.format_number(c, 0)
    return F.when(r.isNull() | ((r["min"] == 0) & (r["max"] == 0)), "—").when(r["min"] == r["max"], F.concat(F.lit("≈"), show(r["min"]))).otherwise(F.concat(F.lit("≈"), show(r["min"]), F.lit("–"), show(r["max"])))
