"""Reading history: records upserted from events, as rewrites of plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions.reading import js_round, speed_tier
from . import rhythm as RH


def document_key() -> Column:
    """The id of the document that a row's fileName, fileSize and lastModified say."""
    return T.document_id(T.document_fingerprint(F.col("fileName"), F.col("fileSize"), F.col("lastModified")))


def document_updates(updates: DataFrame) -> DataFrame:
    """updates: fileName, fileSize, lastModified, seq, at and any of lastPageIndex, lastScrollTop, progressRatio,
    lastSpeedPxPerSecond, lastBandKey. One record a document: the last known value of each field, clamped, the first
    time as openedAt, the last as updatedAt."""
    f = T.document_fingerprint(F.col("fileName"), F.col("fileSize"), F.col("lastModified"))
    d = updates.withColumn("fingerprint", f).withColumn("id", T.document_id(F.col("fingerprint")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    g = d.groupBy("id").agg(
        last("fingerprint").alias("fingerprint"), last("fileName").alias("fileName"), last("fileSize").alias("fileSize"), last("lastModified").alias("lastModified"),
        F.greatest(F.lit(0), js_round(F.coalesce(last("lastPageIndex"), F.lit(0)).cast("double"))).alias("lastPageIndex"), F.greatest(F.lit(0.0), F.coalesce(last("lastScrollTop"), F.lit(0.0))).alias("lastScrollTop"),
        G.clamp(F.coalesce(last("progressRatio"), F.lit(0.0))).alias("progressRatio"), G.clamp(js_round(F.coalesce(last("lastSpeedPxPerSecond"), F.lit(16.0))), 4, 64).cast("int").alias("lastSpeedPxPerSecond"),
        F.coalesce(last("lastBandKey"), F.lit("long-day")).alias("lastBandKey"), F.min_by("at", "seq").alias("openedAt"), F.max_by("at", "seq").alias("updatedAt"),
    )
    return g


def upsert(records: DataFrame, updates: DataFrame) -> DataFrame:
    """records with those of updates in place; openedAt stays."""
    old = records.select("id", F.col("openedAt").alias("_o"))
    new = updates.join(old, "id", "left").withColumn("openedAt", F.coalesce("_o", "openedAt")).drop("_o")
    return records.join(updates.select("id"), "id", "left_anti").unionByName(new)


def rhythm_records(events: DataFrame) -> DataFrame:
    """events: documentId, seq, speed and more. A record is replaced unless its speed is above the new one: the last of
    the fastest remains."""
    d = events.withColumn("speed", F.greatest(F.lit(0), js_round(G.finite(F.col("speed")))))
    more = [c for c in d.columns if c != "documentId"]
    return d.groupBy("documentId").agg(F.max_by(F.struct(*more), F.struct("speed", "seq")).alias("r")).select("documentId", "r.*")


def reading_rhythm(readings: DataFrame, pages: DataFrame) -> DataFrame:
    """readings: documentId, seq, speed, pageIndex; pages as for rhythm.window_counts(). What each reading would record of
    its rhythm: tier, page and the ranges of its rates, by the words around its page; nothing where there are none."""
    d = readings.join(RH.window_counts(pages).where("mode <> 'empty'"), ["documentId", "pageIndex"])
    d = d.withColumns(RH.rates(F.col("speed").cast("double")))
    edge = lambda c, k: js_round(F.col(c) * k).cast("long")
    return d.select("documentId", "seq", "speed", "pageIndex", speed_tier(F.col("speed")).alias("bandKey"), edge("cjkRate", 0.88).alias("cjkMin"), edge("cjkRate", 1.12).alias("cjkMax"), edge("englishRate", 0.88).alias("englishMin"), edge("englishRate", 1.12).alias("englishMax"))


def recent(records: DataFrame, limit: int = 6) -> DataFrame:
    return records.orderBy(F.desc("updatedAt"), "id").limit(max(1, min(18, round(limit))))


def latest_echo(records: DataFrame) -> DataFrame:
    return records.agg(F.max_by(F.struct(*records.columns), F.struct("recordedAt", "documentId")).alias("r")).where("r IS NOT NULL").select("r.*")


def without(records: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    return records.join(removed.select(key).distinct(), key, "left_anti")


def activate(opened: DataFrame, records: DataFrame) -> DataFrame:
    """opened: fingerprint, id. The record of each among the 18 most recent, by fingerprint or id."""
    latest = records.orderBy(F.desc("updatedAt"), "id").limit(18)  # only these are numbered in one task
    r = latest.withColumn("_n", F.row_number().over(W.orderBy(F.desc("updatedAt"), "id"))).select(F.col("id").alias("recordId"), F.col("fingerprint").alias("_f"), "lastSpeedPxPerSecond", "lastBandKey", "_n")
    d = opened.join(F.broadcast(r), (F.col("_f") == F.col("fingerprint")) | (F.col("recordId") == F.col("id")), "left")  # 18 rows at most
    return d.groupBy("fingerprint", "id").agg(F.min_by(F.struct("recordId", "lastSpeedPxPerSecond", "lastBandKey"), "_n").alias("r")).select("fingerprint", "id", "r.*")


def bounded(keys, limit: int = 512):
    """The last `limit` distinct keys of an array column, by first appearance."""
    return F.reverse(F.slice(F.reverse(F.array_distinct(keys)), 1, limit))


def ordered_union(*lists):
    """Elements of several array columns, each once, in order of first appearance."""
    return F.array_distinct(F.concat(*lists))


def eviction_order(pages: DataFrame, *ties: str) -> DataFrame:
    """pages: documentId, page, currentPage, usedAt. Farthest first, then least recently used; entries of one page and
    time by the columns `ties`."""
    w = W.partitionBy("documentId").orderBy(F.abs(F.col("page") - F.col("currentPage")).desc(), "usedAt", "page", *ties)
    return pages.withColumn("evictRank", F.row_number().over(w))
