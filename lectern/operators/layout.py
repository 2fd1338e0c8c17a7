"""Segments -> lines -> reading order. One page is the unit: all shuffles are by (documentId, pageIndex)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geometry import union_box

PAGE = ["documentId", "pageIndex"]


def _down(y: Column, system: str) -> Column:
    return -y if system == "pdf" else y


def clustered(segments: DataFrame, tolerance: float = 8, system: str = "top-down") -> DataFrame:
    """Segments with `row`: along y, one joins the row before it if it lies within the tolerance of its running mean."""
    s = segments.where((F.col("text") != "") & F.col("bbox").isNotNull())
    item = F.struct(_down(F.col("bbox.y"), system).alias("o"), F.col("segmentIndex").alias("at"), F.struct(*[c for c in s.columns if c not in PAGE]).alias("s"))
    pages = s.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("mean"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("rows"))

    def step(a, i):
        y = i["s"]["bbox"]["y"]
        fits = (a["n"] > 0) & (F.abs(a["mean"] - y) <= tolerance)
        row = F.when(fits, a["row"]).otherwise(a["row"] + 1)
        return F.struct(row.alias("row"), F.when(fits, (a["mean"] * a["n"] + y) / (a["n"] + 1)).otherwise(y).alias("mean"), F.when(fits, a["n"] + 1).otherwise(1).alias("n"), F.array_append(a["rows"], row).alias("rows"))

    pages = pages.withColumn("rows", F.aggregate("items", start, step, lambda a: a["rows"]))
    flat = pages.select(*PAGE, F.inline(F.arrays_zip("items", "rows")))
    return flat.select(*PAGE, F.col("rows").alias("row"), F.col("items.o").alias("_o"), "items.s.*")


def split_rows(rows: DataFrame, page_width: Column | None = None) -> DataFrame:
    """Adds `part`: a row breaks at wide gaps and at the middle of the page."""
    end = F.col("bbox.x") + F.col("bbox.width")
    row = W.partitionBy(*PAGE, "row")
    ordered = row.orderBy(F.col("bbox.x"), "_o", "segmentIndex")
    width = F.greatest(F.lit(1.0), F.max(end).over(row))
    if page_width is not None:
        width = F.coalesce(F.nullif(page_width, F.lit(0.0)), width)
    d = rows.withColumn("_w", width).withColumn("_end", F.lag(end).over(ordered))
    gap = F.col("bbox.x") - F.col("_end")
    across = (F.col("_end") < F.col("_w") / 2) & (F.col("bbox.x") > F.col("_w") / 2) & (gap > F.greatest(F.lit(12.0), F.col("_w") * 0.025))
    new = F.coalesce(((gap > F.greatest(F.lit(36.0), F.col("_w") * 0.08)) | across).cast("int"), F.lit(0))
    return d.withColumn("_new", new).withColumn("part", F.sum("_new").over(ordered)).drop("_w", "_end", "_new")


def lines(segments: DataFrame, tolerance: float = 8, system: str = "top-down", page_width: Column | None = None) -> DataFrame:
    """One row for each line: text, box, segment ids, least confidence, ids of paragraph and block if the line has one."""
    parts = split_rows(clustered(segments, tolerance, system), page_width)
    along = F.array_sort(F.collect_list(F.struct(F.col("bbox.x").alias("x"), F.col("_o").alias("o"), "segmentIndex", "text", "source", "fontName", "direction")))
    b = F.col("bbox")
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c))  # noqa: E731  no distinct count: it would copy and shuffle each row for each
    g = parts.groupBy(*PAGE, "row", "part").agg(along.alias("s"), union_box(b["x"], b["y"], b["width"], b["height"]).alias("bbox"), F.min("confidence").alias("confidence"), one("paragraphId").alias("paragraphId"), one("blockId").alias("blockId"), F.bool_or("hasEOL").alias("hasEOL"))
    of = lambda k: F.transform("s", lambda i: i[k])
    g = T.once(g, "text", T.normalize_artifacts(F.array_join(of("text"), " "))).where("text <> ''")
    g = g.select(*PAGE, "row", "part", "text", "bbox", of("segmentIndex").alias("sourceSegmentIds"), F.get(of("source"), F.lit(0)).alias("source"), "confidence", "paragraphId", "blockId", "hasEOL", F.array_distinct(F.array_compact(of("fontName"))).alias("fontNames"), F.get(F.array_compact(of("direction")), F.lit(0)).alias("direction"))
    return g.withColumn("lineIndex", F.row_number().over(W.partitionBy(*PAGE).orderBy("row", "part")) - 1).drop("row", "part")


def reading_order(lines: DataFrame, system: str = "top-down", page_width: Column | None = None, least: int = 4) -> DataFrame:
    """Adds columnIndex (null on a page of one column) and readingIndex. Two columns are seen by lines left and right of
    .92 of the middle, and then cut at the middle itself."""
    page = W.partitionBy(*PAGE)
    x = F.coalesce(F.col("bbox.x"), F.lit(0.0))
    width = F.greatest(F.lit(1.0), F.max(x + F.col("bbox.width")).over(page))
    if page_width is not None:
        width = F.coalesce(F.nullif(page_width, F.lit(0.0)), width)
    d = lines.withColumn("_m", width / 2)
    body = F.col("bbox").isNotNull() & F.col("text").rlike(T.NOT_WS)
    n = lambda test: F.sum(F.when(body & test, 1).otherwise(0)).over(page)
    two = (n(x < F.col("_m") * 0.92) >= least) & (n(x >= F.col("_m") * 0.92) >= least)
    d = d.withColumn("_two", two).withColumn("columnIndex", F.when(F.col("_two"), F.when(x < F.col("_m"), 0).otherwise(1)))
    order = page.orderBy(F.coalesce("columnIndex", F.lit(0)), _down(F.coalesce("bbox.y", F.lit(0.0)), system), "lineIndex")
    return d.withColumn("readingIndex", F.row_number().over(order) - 1).drop("_m", "_two")


def page_tops(layout: DataFrame, start: float = 0, gap: float = 0) -> DataFrame:
    """layout: documentId, pageNumber, height. Adds top: the heights and gaps before it."""
    before = W.partitionBy("documentId").orderBy("pageNumber").rowsBetween(W.unboundedPreceding, -1)
    return layout.withColumn("top", F.lit(float(start)) + F.coalesce(F.sum(F.col("height") + gap).over(before), F.lit(0.0)))


#: Levels of blocks of pages: documents of 2^24 pages at most.
LEVELS = 24


def tops_at(layout: DataFrame, changes: DataFrame, asked: DataFrame, start: float = 0, gap: float = 0) -> DataFrame:
    """layout: documentId, pageNumber, height; changes: documentId, version, pageNumber, height (from that version on);
    asked: documentId, version, pageNumber. Adds top and height as they are at that version.

    A change moves all pages behind it, but is noted only in the blocks of 1, 2, 4, .. pages around its page; the pages
    before one that is asked for are a few such blocks, one for each bit of their number. So a version costs what its
    changes and questions do, and no document is summed up anew."""
    key = ["documentId", "pageNumber"]
    own = W.partitionBy(*key).orderBy("version")
    first = layout.select(*key, F.lit(None).cast("long").alias("version"), "height")
    seen = first.unionByName(changes.select(*key, F.col("version").cast("long").alias("version"), "height"))
    moved = seen.withColumn("by", F.col("height") - F.lag("height").over(own)).where("by IS NOT NULL AND by <> 0")
    level = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    at = lambda n, k: F.call_function("shiftright", n, k)
    # a block that is asked for ends at an odd multiple of its size, so only these are kept
    around = F.filter(F.transform(level, lambda k: F.struct(k.alias("k"), at(F.col("pageNumber") - 1, k).alias("j"))), lambda b: b["j"] % 2 == 0)
    before = F.transform(F.filter(level, lambda k: at(F.col("pageNumber") - 1, k) % 2 == 1), lambda k: F.struct(k.alias("k"), (at(F.col("pageNumber") - 1, k) - 1).alias("j")))
    q = asked.select(*key, F.col("version").cast("long").alias("version")).distinct()
    notes = moved.select("documentId", "version", F.explode(around).alias("block"), "by", F.lit(None).cast("int").alias("pageNumber"))
    notes = notes.unionByName(q.select("documentId", "version", F.explode(before).alias("block"), F.lit(0.0).alias("by"), "pageNumber"))
    w = W.partitionBy("documentId", "block").orderBy("version", F.col("pageNumber").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    shift = notes.withColumn("shift", F.sum("by").over(w)).where("pageNumber IS NOT NULL").groupBy(*key, "version").agg(F.sum("shift").alias("shift"))
    # the height of the page itself: the last that is known of it by then
    both = seen.withColumn("asked", F.lit(False)).unionByName(q.withColumns({"height": F.lit(None).cast("double"), "asked": F.lit(True)}))
    upto = W.partitionBy(*key).orderBy("version", "asked").rowsBetween(W.unboundedPreceding, 0)
    tall = both.withColumn("height", F.last("height", ignorenulls=True).over(upto)).where("asked").select(*key, "version", "height")
    base = page_tops(layout, start, gap).select(*key, F.col("top").alias("base"))
    out = tall.join(base, key).join(shift, [*key, "version"], "left")
    return out.select(*key, "version", (F.col("base") + F.coalesce("shift", F.lit(0.0))).alias("top"), "height")


def estimated_layout(docs: DataFrame) -> DataFrame:
    """docs: documentId, pageCount, width, height. Equal pages, the first of them measured."""
    return docs.select("documentId", F.explode(F.sequence(F.lit(1), "pageCount")).alias("pageNumber"), "width", "height").withColumn("measured", F.col("pageNumber") == 1)


def updated_layout(layout: DataFrame, measured: DataFrame) -> DataFrame:
    """layout with the sizes of measured pages (documentId, pageNumber, width, height) in place."""
    m = measured.withColumnsRenamed({"width": "_w", "height": "_h"})
    return layout.join(m, ["documentId", "pageNumber"], "left").select("documentId", "pageNumber", F.coalesce("_w", "width").alias("width"), F.coalesce("_h", "height").alias("height"), (F.col("measured") | F.col("_w").isNotNull()).alias("measured"))


def page_at(offsets: DataFrame, tops: DataFrame) -> DataFrame:
    """As-of lookup: the last page whose top is at or before an offset, the first page before all tops, 0 without pages.
    Offsets and tops are merged into one ordered stream for each document: no range join."""
    a = tops.select("documentId", F.col("top").alias("_at"), F.lit(0).alias("_kind"), "pageNumber", *[F.lit(None).cast(offsets.schema[c].dataType).alias(c) for c in offsets.columns if c != "documentId"])
    b = offsets.select("documentId", F.col("offset").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("pageNumber"), *[c for c in offsets.columns if c != "documentId"])
    before = W.partitionBy("documentId").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    any_ = F.count("pageNumber").over(W.partitionBy("documentId"))
    d = a.unionByName(b).withColumn("pageAt", F.last("pageNumber", ignorenulls=True).over(before)).withColumn("_any", any_)
    return d.where("_kind = 1").select(*offsets.columns, F.when(F.col("_any") == 0, 0).otherwise(F.coalesce("pageAt", F.lit(1))).alias("pageNumber"))


def page_reading_lines(offsets: DataFrame, tops: DataFrame) -> DataFrame:
    """Offsets with `line`: where they lie within their page, 0 to 1; .38 without a page or a height."""
    t = tops.select("documentId", "pageNumber", F.col("top").alias("_top"), F.col("height").alias("_height"))
    d = page_at(offsets, tops).join(t, ["documentId", "pageNumber"], "left")
    known = F.coalesce(F.col("_height") > 0, F.lit(False)) & F.col("_top").isNotNull()
    line = F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("offset") - F.col("_top")) / F.col("_height")))).otherwise(0.38)
    return d.withColumn("line", line).drop("_top", "_height")


def directional_pages(centers: DataFrame, limit: int | None = None) -> DataFrame:
    """centers: documentId, page, pageCount, direction. All pages in the order in which they should be made ready, as
    directional_order() gives it: rank and nearPage."""
    n, sign = F.col("pageCount"), F.when(F.col("direction") < 0, -1).otherwise(1)
    upto = lambda a, step, f: F.flatten(F.transform(F.when(n >= a, F.sequence(F.lit(a), n, F.lit(step))).otherwise(F.array().cast("array<int>")), f))
    wish = F.concat(F.array(*[F.lit(i) for i in (0, 1, -1, 2, -2)]), upto(3, 2, lambda d: F.array(d, d + 1, -d)), upto(1, 1, lambda d: F.array(d, -d)))
    near = F.array_distinct(F.filter(F.transform(wish, lambda d: F.col("page") + sign * d), lambda p: (p >= 1) & (p <= n)))
    near = near if limit is None else F.slice(near, 1, limit)
    return centers.where("page BETWEEN 1 AND pageCount").select("*", F.posexplode(near).alias("rank", "nearPage"))


def nearby_pages(centers: DataFrame, radius: int = 2) -> DataFrame:
    """centers: documentId, page, pageCount. The pages around each, nearest first, the one before ahead of the one after."""
    steps = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(radius)), lambda d: F.array(-d, d)))
    near = centers.where("page BETWEEN 1 AND pageCount").select("*", F.posexplode(F.concat(F.array(F.lit(0)), steps)).alias("rank", "step"))
    return near.withColumn("nearPage", F.col("page") + F.col("step")).where("nearPage BETWEEN 1 AND pageCount").drop("step")


def directional_order(page: int, direction: int, count: int, limit: int | None = None) -> list[int]:
    """Pages in the order in which they should be made ready: two on each side, then two ahead for one behind, then by
    nearness."""
    if not 1 <= page <= count:
        return []
    sign = -1 if direction < 0 else 1
    wish = [0, 1, -1, 2, -2]
    for d in range(3, count + 1, 2):
        wish += [d, d + 1, -d]
    for d in range(1, count + 1):
        wish += [d, -d]
    seen = dict.fromkeys(page + sign * d for d in wish)
    return [p for p in seen if 1 <= p <= count][: count if limit is None else min(limit, count)]
