"""Reading estimates over windows of pages, and the reading clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import reading as R


def page_stats(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    return texts.select(*key, R.text_stats(F.col(text)).alias("stats"))


def window_counts(pages: DataFrame, radius: int = 2) -> DataFrame:
    """pages: documentId, pageIndex, height, stats (null if unknown). Adds what the pages around each hold together (by
    number, not by row): cjk, digits, english, their measured height and the metric mode; pages without any are left out."""
    s = F.col("stats")
    w = W.partitionBy("documentId").orderBy("pageIndex").rangeBetween(-radius, radius)
    known = lambda c: F.sum(F.when(s.isNotNull(), c)).over(w)
    d = pages.withColumns({"cjk": known(s["cjkCharacters"]), "digits": known(s["numericUnits"]), "english": known(s["englishWords"]), "measured": known(F.col("height"))}).where("measured > 0")
    return d.withColumn("mode", R.metric_mode(F.col("cjk"), F.col("english")))


def rates(speed: Column) -> dict[str, Column]:
    """cjkRate and englishRate at a speed, from window_counts()."""
    cjk = F.when(F.col("mode").isin("cjk", "both"), R.units_per_minute(F.col("cjk") + F.col("digits"), F.col("measured"), speed)).otherwise(0)
    return {"cjkRate": cjk, "englishRate": R.units_per_minute(F.col("english"), F.col("measured"), speed)}


def window_estimates(pages: DataFrame, speed: float, radius: int = 2, remaining: float = 0.0) -> DataFrame:
    """Mode, rates and density of each page within the pages around it."""
    s, v = F.col("stats"), F.lit(float(speed))
    units = F.col("cjk") + F.col("digits") + F.col("english")
    own = s["cjkCharacters"] + s["numericUnits"] + s["englishWords"]
    ratio = F.when((own > 0) & (units > 0) & (F.col("height") > 0), (own / F.col("height")) / (units / F.col("measured")))
    d = window_counts(pages, radius).withColumns({**rates(v), "densityRatio": ratio})
    snap = R.rhythm_snapshot(F.col("mode"), F.col("cjkRate"), F.col("englishRate"), F.col("densityRatio"), F.lit(float(remaining)), v)
    return d.select("documentId", "pageIndex", "cjkRate", "englishRate", "densityRatio", snap.alias("s")).select("documentId", "pageIndex", "cjkRate", "englishRate", "densityRatio", "s.*")


def clock_advances(clock: DataFrame, key: str, order: list[str], epsilon: float = 0.001) -> DataFrame:
    """Clock rows (progressRatio, currentPageIndex, isPlaying, speedPxPerSecond) that differ from the one before."""
    w = W.partitionBy(key).orderBy(*order)
    p = lambda c: F.lag(c).over(w)
    moved = (F.abs(F.col("progressRatio") - p("progressRatio")) > epsilon) | (F.col("currentPageIndex") != p("currentPageIndex")) | (F.col("isPlaying") != p("isPlaying")) | (F.col("speedPxPerSecond") != p("speedPxPerSecond"))
    return clock.withColumn("advanced", F.coalesce(moved, F.lit(True)))


def large_jumps(positions: DataFrame, key: str, order: list[str], viewport: float) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    d = positions.withColumn("delta", F.col("position") - F.lag("position").over(w))
    return d.withColumn("jump", F.coalesce(R.large_jump(F.col("delta"), F.lit(float(viewport))), F.lit(False)))


def throttled(rows: DataFrame, key: str, at_ms: str, every: int = 160) -> DataFrame:
    """The first row of each key within every bucket of `every` milliseconds."""
    d = rows.withColumn("_b", F.expr(f"{at_ms} div {every}"))
    w = W.partitionBy(key, "_b").orderBy(at_ms)
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_b", "_n")
