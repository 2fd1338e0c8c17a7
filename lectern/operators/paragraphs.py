"""Lines -> paragraphs: boundaries from the line before, islands, links across pages, places on the scroll axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions.sentences import first_sentence
from .chunks import readable
from .layout import PAGE, lines, reading_order


def metrics(ordered: DataFrame, page_width: float) -> DataFrame:
    """Adds what boundaries are measured by: median line height, the line's column, the column's left edge and width."""
    b, page = F.col("bbox"), W.partitionBy(*PAGE)
    raw = F.when(b["width"] >= page_width * 0.72, -1).when(b["x"] < page_width * 0.46, 0).otherwise(1)
    d = ordered.withColumn("_raw", raw).withColumn("_h", F.greatest(F.lit(1.0), F.coalesce(F.median(b["height"]).over(page), F.lit(12.0))))
    two = (F.sum(F.when(F.col("_raw") == 0, 1).otherwise(0)).over(page) >= 4) & (F.sum(F.when(F.col("_raw") == 1, 1).otherwise(0)).over(page) >= 4)
    d = d.withColumn("_two", two).withColumn("_col", F.when(F.col("_two"), F.col("_raw")).otherwise(0))
    col = W.partitionBy(*PAGE, "_col")
    return d.withColumn("_left", F.min(b["x"]).over(col)).withColumn("_width", F.greatest(F.lit(1.0), F.median(b["width"]).over(col)))


def boundaries(ordered: DataFrame, page_width: float) -> DataFrame:
    """Adds split, boundaryConfidence and boundarySource: the first rule that holds between a line and the one before."""
    d = metrics(ordered, page_width)
    order = W.partitionBy(*PAGE).orderBy("readingIndex")
    d = d.withColumn("_p", F.lag(F.struct("text", "bbox", "paragraphId", "_col")).over(order))
    p, b = F.col("_p"), F.col("bbox")
    pb, h = p["bbox"], F.col("_h")
    indent, step = b["x"] - F.col("_left"), max(10.0, page_width * 0.025)
    ended = T.ends_sentence(p["text"])
    rule = lambda split, sure, name: F.struct(F.lit(split).alias("split"), F.lit(sure).alias("confidence"), F.lit(name).alias("source"))
    both = (F.coalesce(p["paragraphId"], F.lit("")) != "") & (F.coalesce("paragraphId", F.lit("")) != "")
    found = (
        F.when(p.isNull(), rule(True, 0.55, "page-start"))
        .when(both & (p["paragraphId"] == F.col("paragraphId")), rule(False, 1.0, "ocr-paragraph"))
        .when(both, rule(True, 1.0, "ocr-paragraph"))
        .when(p["_col"] != F.col("_col"), rule(True, 0.98, "column-change"))
        .when(b["y"] < pb["y"] - h * 0.5, rule(True, 0.98, "column-reset"))
        .when(T.looks_like_heading(p["text"]) | T.looks_like_heading(F.col("text")), rule(True, 0.9, "heading"))
        .when(b["y"] - (pb["y"] + pb["height"]) > h * 0.8, rule(True, 0.88, "line-gap"))
        .when((indent >= step) & ended, rule(True, 0.82, "first-line-indent"))
        .when(ended & (pb["width"] < F.col("_width") * 0.74) & (F.abs(indent) <= step), rule(True, 0.74, "short-terminal-line"))
        .otherwise(rule(False, 0.5, "line-continuation"))
    )
    d = d.withColumn("_b", found)
    return d.select(*ordered.columns, F.col("_b.split").alias("split"), F.col("_b.confidence").alias("boundaryConfidence"), F.col("_b.source").alias("boundarySource"))


def starts(ordered: DataFrame, page_width: float) -> DataFrame:
    """The first line of each paragraph of a page."""
    return boundaries(ordered.where((F.col("text") != "") & F.col("bbox").isNotNull()), page_width).where("split")


def passages(ordered: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """One row for each paragraph of a page, with its lead sentence."""
    d = boundaries(ordered.where((F.col("text") != "") & F.col("bbox").isNotNull()), page_width)
    d = d.withColumn("paragraphIndex", (F.sum(F.col("split").cast("int")).over(W.partitionBy(*PAGE).orderBy("readingIndex")) - 1).cast("int"))
    b = F.col("bbox")
    rows = F.array_sort(F.collect_list(F.struct("readingIndex", "text", "source", "bbox", "sourceSegmentIds", "boundaryConfidence", "boundarySource")))
    g = d.groupBy(*PAGE, "paragraphIndex").agg(rows.alias("_l"), G.union_box(b["x"], b["y"], b["width"], b["height"]).alias("bbox"))
    head = F.get("_l", F.lit(0))
    g = g.select(*PAGE, "paragraphIndex", F.array_join(F.filter(F.transform("_l", lambda x: T.trim(x["text"])), lambda t: t != ""), " ").alias("text"), "bbox", head["source"].alias("source"), head["bbox"].alias("leadBbox"), F.flatten(F.transform("_l", lambda x: x["sourceSegmentIds"])).alias("sourceSegmentIds"), head["boundaryConfidence"].alias("boundaryConfidence"), head["boundarySource"].alias("boundarySource"), F.size("_l").alias("lineCount"))
    page = F.struct(F.lit(float(page_width)).alias("width"), F.lit(float(page_height)).alias("height"), F.lit("top-down").alias("coordinateSystem"))
    g = readable(g, page, F.lit("top-down"))
    key = F.concat_ws(":", "source", F.col("pageIndex").cast("string"), F.lit("paragraph"), F.col("paragraphIndex").cast("string"))
    return g.withColumn("paragraphKey", key).withColumn("leadText", T.normalize_artifacts(first_sentence(F.col("text"))))


FRAGMENT = ["pageIndex", "text", "bbox", "normalizedBbox", "boundaryConfidence", "boundarySource"]


def link_pages(found: DataFrame) -> DataFrame:
    """Joins a paragraph that ends at the foot of a page without a sentence's end to one at the head of the next."""
    order = W.partitionBy("documentId").orderBy("pageIndex", "paragraphIndex")
    d = found.withColumn("_p", F.lag(F.struct("pageIndex", "source", "role", "text", "normalizedBbox")).over(order))
    p, box = F.col("_p"), F.col("normalizedBbox")
    pb = p["normalizedBbox"]
    near = (F.abs(pb["x"] - box["x"]) <= 0.06) & (pb["y"] + pb["height"] >= 0.82) & (box["y"] <= 0.18)
    joins = (F.col("pageIndex") == p["pageIndex"] + 1) & (p["source"] == F.col("source")) & (p["role"] == "body") & (F.col("role") == "body") & ~T.ends_sentence(p["text"]) & near
    d = d.withColumn("_join", F.coalesce(joins, F.lit(False))).withColumn("_isle", F.sum(F.when(F.col("_join"), 0).otherwise(1)).over(order))
    rows = F.array_sort(F.collect_list(F.struct("pageIndex", "paragraphIndex", *[c for c in FRAGMENT if c != "pageIndex"], F.col("_join").alias("continuesFromPrevious"), "paragraphKey", "source", "role", "priority", "qualityFlags", "languageHint", "leadText", "leadBbox")))
    g = d.groupBy("documentId", "_isle").agg(rows.alias("_f"))
    first = F.get("_f", F.lit(0))
    n = F.size("_f")
    fragments = F.transform("_f", lambda f, i: F.struct(*[f[c].alias(c) for c in FRAGMENT], f["continuesFromPrevious"].alias("continuesFromPrevious"), (i < n - 1).alias("continuesOnNext")))
    text = T.squeeze(F.array_join(F.transform("_f", lambda f: f["text"]), " "))
    g = g.select("documentId", "_isle", first["paragraphKey"].alias("paragraphKey"), first["source"].alias("source"), F.when(n > 1, text).otherwise(first["text"]).alias("text"), first["role"].alias("role"), first["priority"].alias("priority"), first["qualityFlags"].alias("qualityFlags"), first["languageHint"].alias("languageHint"), fragments.alias("fragments"), first["leadText"].alias("_lead"), first["leadBbox"].alias("leadBbox"), (n > 1).alias("crossPage"))
    g = g.withColumn("leadText", F.when(F.col("crossPage"), first_sentence(F.col("text"))).otherwise(F.col("_lead")))
    return g.withColumn("paragraphIndex", F.row_number().over(W.partitionBy("documentId").orderBy("_isle")) - 1).drop("_isle", "_lead")


def segments_to_paragraphs(segments: DataFrame, page_width: float = 612, page_height: float = 792, system: str = "top-down") -> DataFrame:
    width = F.lit(float(page_width))
    raw = lines(segments, system=system, page_width=width)
    page = F.struct(width.alias("width"), F.lit(float(page_height)).alias("height"), F.lit(system).alias("coordinateSystem"))
    raw = raw.withColumn("bbox", G.to_top_left(F.col("bbox"), page))
    return link_pages(passages(reading_order(raw, "top-down", width), page_width, page_height))


def on_scroll_axis(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Linked paragraphs with start and end in pixels; pages: documentId, pageIndex, pageTop, pageHeight."""
    first, last = F.get("fragments", F.lit(0)), F.element_at("fragments", -1)
    d = found.withColumns({"_a": first["pageIndex"], "_z": last["pageIndex"]})
    side = lambda k: pages.select("documentId", F.col("pageIndex").alias(k), F.col("pageTop").alias(f"{k}_top"), F.col("pageHeight").alias(f"{k}_height"))
    d = d.join(side("_a"), ["documentId", "_a"]).join(side("_z"), ["documentId", "_z"])
    a, z = first["normalizedBbox"], last["normalizedBbox"]
    d = d.withColumn("start", F.col("_a_top") + a["y"] * F.col("_a_height")).withColumn("end", F.col("_z_top") + (z["y"] + z["height"]) * F.col("_z_height"))
    return d.where("end >= start").drop("_a", "_z", "_a_top", "_a_height", "_z_top", "_z_height")


def lead_chunks(found: DataFrame) -> DataFrame:
    """The lead sentence of each paragraph as a chunk of its own."""
    f = F.get("fragments", F.lit(0))
    return found.where("leadText <> ''").select("documentId", "source", f["pageIndex"].alias("pageIndex"), F.col("paragraphIndex").alias("chunkIndex"), F.col("leadText").alias("text"), "languageHint", "role", "priority", "qualityFlags", F.col("leadBbox").alias("bbox"), f["normalizedBbox"].alias("normalizedBbox"), "paragraphKey", F.concat("paragraphKey", F.lit(":lead")).alias("speechKey"))
