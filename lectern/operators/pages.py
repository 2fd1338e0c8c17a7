"""Whole pages: everything that is made of a page's segments, windows of pages around one, and what is known of each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunks as C
from . import paragraphs as P
from . import picking as K
from . import points as O
from . import quality as Q

ON = ["documentId", "pageIndex"]


@dataclass
class Extraction:
    """What a source gives for its pages: speech chunks, paragraphs of single pages, sentences with places, and the
    assessment that the choice of source goes by."""

    chunks: DataFrame
    paragraphs: DataFrame
    sentences: DataFrame
    assessment: DataFrame
    counted: dict[str, DataFrame]  # a row for each chunk, paragraph and sentence, with no more than its page

    def summary(self) -> DataFrame:
        """One row a page and source: counts, state and reasons."""
        n = lambda d, name: d.groupBy(*ON).agg(F.count("*").alias(name))
        out = self.assessment.select(*ON, "source", "state", "reasonCodes")
        for name, d in self.counted.items():
            out = out.join(n(d, name), ON, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
        return out


def extracted(segments: DataFrame, width: float, height: float, least: int = 120, most: int = 420, point_segments: DataFrame | None = None, language_set: Column | None = None) -> Extraction:
    """Native pages take chunks of 120 to 420 characters, recognised ones of 24 to 180 and their own segments for points
    (words or lines, as the language set prefers)."""
    page = F.struct(F.lit(float(width)).alias("width"), F.lit(float(height)).alias("height"), F.lit("top-down").alias("coordinateSystem"))
    records = segments.select(*ON, "source", F.col("segmentIndex").alias("ordinal"), "text", "bbox", F.lit(None).cast("string").alias("role"), "confidence")
    in_order = lambda s: C.reading_order(C.lines(s, page_width=F.lit(float(width))), page_width=F.lit(float(width)))
    ordered = in_order(segments)
    points = segments if point_segments is None else point_segments
    chunks, starts = C.packed(ordered, least, most), P.starts(ordered, width)
    spoken = O.spoken(ordered if point_segments is None else in_order(points), width, height)
    counted = {name: d.select(*ON) for name, d in (("chunks", chunks), ("paragraphs", starts), ("sentences", spoken))}
    return Extraction(C.readable(chunks, page, F.lit("top-down")), P.passages(ordered, width, height), O.sentence_targets(points, width, height), Q.assess(records, language_set=language_set), counted)


def paragraph_windows(passages: DataFrame, pages: DataFrame, radius: int = 1) -> DataFrame:
    """For each page as a centre, the paragraphs of the pages around it, linked within this window and placed on the
    scroll axis. passages: of single pages; pages: documentId, pageIndex, pageTop, pageHeight. Each passage meets
    2 * radius + 1 centres."""
    centre = F.explode(F.sequence(F.col("pageIndex") - radius, F.col("pageIndex") + radius)).alias("centre")
    near = passages.select("*", centre).join(pages.select("documentId", F.col("pageIndex").alias("centre")), ["documentId", "centre"], "left_semi")
    # a window is a document of its own while its paragraphs are linked
    window = F.concat_ws("\x01", F.col("documentId"), F.col("centre").cast("string"))
    linked = P.link_pages(near.withColumn("documentId", window).drop("centre"))
    part = F.split("documentId", "\x01")
    linked = linked.withColumn("centre", F.get(part, F.lit(1)).cast("int")).withColumn("documentId", F.get(part, F.lit(0)))
    return P.on_scroll_axis(linked, pages)


def eligible_leads(paragraphs: DataFrame, resolved: DataFrame) -> DataFrame:
    """The lead sentences of paragraphs that each resolved policy allows."""
    return K.by_policy(P.lead_chunks(paragraphs), resolved)


def next_page_chunks(chunks: DataFrame, positions: DataFrame) -> DataFrame:
    """positions: documentId, pageIndex, positionId. The chunks of the page after each, which reading ahead prepares."""
    p = positions.select("documentId", (F.col("pageIndex") + 1).alias("pageIndex"), "positionId")
    return chunks.join(p, ON)


def diagnostics(resolved: DataFrame, chunks: DataFrame, paragraphs: DataFrame, previews: int = 5) -> DataFrame:
    """resolved: pages with state, selectedSource and ttsReady. Adds the number of chunks and paragraphs of the selected
    source and the beginnings of its first chunks."""
    heads = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("chunkIndex", T.truncated(F.col("text"), 160).alias("t")))), 1, previews), lambda c: c["t"])
    # each source's chunks are counted, then the selected one's taken: resolved is made once, not once more to choose by
    c = chunks.withColumn("selectedSource", Q.source_kind(F.col("source"))).groupBy(*ON, "selectedSource").agg(F.count("*").alias("chunks"), heads.alias("preview"))
    p = paragraphs.groupBy(*ON).agg(F.count("*").alias("paragraphs"))
    d = resolved.join(c, [*ON, "selectedSource"], "left").join(p, ON, "left")
    zero = lambda k: F.coalesce(k, F.lit(0).cast("long")).alias(k)
    return d.select(*ON, "state", F.col("selectedSource").alias("source"), F.col("ttsReady").alias("ready"), zero("chunks"), zero("paragraphs"), F.coalesce("preview", F.array().cast("array<string>")).alias("preview"))


#: The states of a page's text source.
STATES = ("checking-native", "native-ready", "ocr-ready", "ocr-scheduled", "ocr-running", "ocr-failed", "ocr-suppressed", "ocr-poor", "ocr-needed")


def measures() -> list[Column]:
    """Aggregates over rows of diagnostics(): pages, those that are ready, of each state, and what they hold."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return [F.count(F.lit(1)).alias("pages"), F.count_if(F.col("ready")).alias("ready"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES], whole("chunks"), whole("paragraphs")]


def observed(states: DataFrame) -> tuple[DataFrame, Observation]:
    """Rows of diagnostics() that gather their measures() while they are written: the observation has them once the first
    action has ended, without another pass."""
    o = Observation()
    return states.observe(o, *measures()), o


def snapshots(states: DataFrame) -> DataFrame:
    """One row for each document: its measures, and the pages at work and failed, as a nested JSON text."""
    pages = lambda *of: F.array_sort(F.collect_list(F.when(F.col("state").isin(*of), F.col("pageIndex"))))
    g = states.groupBy("documentId").agg(*measures(), pages("ocr-scheduled", "ocr-running").alias("taskPages"), pages("ocr-failed").alias("failedPages"))
    whole = F.struct("pages", "ready", F.struct(*STATES).alias("states"), F.struct("taskPages", "failedPages").alias("ocr"), F.struct("chunks", "paragraphs").alias("readable"))
    return g.select("documentId", F.to_json(whole).alias("snapshot"))
