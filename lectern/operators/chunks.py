"""Lines -> speech-sized chunks, by a greedy fold over each page in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from .layout import PAGE, lines, reading_order


def packed(ordered: DataFrame, least: int = 120, most: int = 420, repeated: DataFrame | None = None) -> DataFrame:
    """ordered: lines with readingIndex. One row for each chunk: chunkIndex, text, lines (reading indexes), and the box,
    source and segment ids of its lines if ordered has them.

    A line that would make a chunk longer than `most` starts a new one; a chunk ends at `least` characters with a
    sentence, or at `most`. Text is normalized as it grows, so hyphens are mended across lines; a line is never split.
    Running headers, and lines whose key is in `repeated` (column key), are left out.

    One look at a page's whole text says whether anything is rewritten where its lines meet. If not, a chunk's length is
    the sum of its lines', and only numbers are folded; texts are joined once the cuts are known."""
    d = T.once(ordered, "_t", T.normalize_artifacts(F.coalesce("text", F.lit(""))))
    if repeated is not None:
        d = d.withColumn("_key", T.line_key(F.col("_t"))).join(repeated.select(F.col("key").alias("_key"), F.lit(True).alias("_rep")).distinct(), "_key", "left")
    d = d.where((F.col("_t") != "") & ~T.is_running_header(F.col("_t"), F.col("_rep") if repeated is not None else None, True))
    more = [c for c in ("bbox", "source", "sourceSegmentIds") if c in ordered.columns]
    ls = F.array_sort(F.collect_list(F.struct("readingIndex", F.col("_t").alias("t"), *more)))
    pages = d.groupBy(*PAGE).agg(ls.alias("_ls"))
    chunk = "array<struct<text:string,lines:array<int>>>"
    none = F.array().cast("array<int>")
    start = F.struct(F.lit("").alias("text"), none.alias("lines"), F.array().cast(chunk).alias("out"))

    def flushed(s):
        return F.array_append(s["out"], F.struct(s["text"].alias("text"), s["lines"].alias("lines")))

    def step(s, line):
        def grow(wider):
            over = (s["text"] != "") & (F.char_length(wider) > most)
            return F.struct(F.when(over, line["t"]).otherwise(wider).alias("text"), F.when(over, F.array(line["at"])).otherwise(F.array_append(s["lines"], line["at"])).alias("lines"), F.when(over, flushed(s)).otherwise(s["out"]).alias("out"))

        def close(n):
            full = (F.char_length(n["text"]) >= most) | ((F.char_length(n["text"]) >= least) & T.ends_chunk(n["text"]))
            return F.struct(F.when(full, "").otherwise(n["text"]).alias("text"), F.when(full, none).otherwise(n["lines"]).alias("lines"), F.when(full, flushed(n)).otherwise(n["out"]).alias("out"))

        return T.let(T.let(T.normalize_artifacts(F.concat(s["text"], F.lit(" "), line["t"])), grow), close)

    numbered = F.transform("_ls", lambda x, i: F.struct(i.alias("at"), x["t"].alias("t")))
    rewritten = F.aggregate(numbered, start, step, lambda s: F.when(s["text"] != "", flushed(s)).otherwise(s["out"]))

    # (length so far, first line, cuts): a line that doesn't fit starts a chunk, one that fills it ends it
    sizes = F.transform("_ls", lambda x, i: F.struct(i.alias("at"), F.char_length(x["t"]).alias("n"), T.ends_chunk(x["t"]).alias("ends")))
    cut = lambda first, upto: F.struct(first.alias("first"), upto.alias("upto"))
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("first"), F.array().cast("array<struct<first:int,upto:int>>").alias("cuts"))

    def count(s, x):
        over = (s["n"] > 0) & (s["n"] + 1 + x["n"] > most)
        n = F.when(over | (s["n"] == 0), x["n"]).otherwise(s["n"] + 1 + x["n"])
        first = F.when(over, x["at"]).otherwise(s["first"])
        cuts = F.when(over, F.array_append(s["cuts"], cut(s["first"], x["at"] - 1))).otherwise(s["cuts"])

        def close(m):
            full = (m >= most) | ((m >= least) & x["ends"])
            return F.struct(F.when(full, 0).otherwise(m).alias("n"), F.when(full, x["at"] + 1).otherwise(first).alias("first"), F.when(full, F.array_append(cuts, cut(first, x["at"]))).otherwise(cuts).alias("cuts"))

        return T.let(n, close)

    cuts = F.aggregate(sizes, begin, count, lambda s: F.when(s["n"] > 0, F.array_append(s["cuts"], cut(s["first"], F.size("_ls") - 1))).otherwise(s["cuts"]))
    joined = F.transform(cuts, lambda c: F.struct(F.array_join(F.transform(F.slice("_ls", c["first"] + 1, c["upto"] - c["first"] + 1), lambda x: x["t"]), " ").alias("text"), F.sequence(c["first"], c["upto"]).alias("lines")))
    pages = pages.withColumn("_whole", F.array_join(F.transform("_ls", lambda x: x["t"]), " "))
    done = F.when(T.has_artifacts(F.col("_whole")), rewritten).otherwise(joined)
    pages = pages.select(*PAGE, "_ls", done.alias("_done"))
    of = lambda c, k: F.transform(c["lines"], lambda i: F.get("_ls", i)[k])

    def whole(c):
        own = [of(c, "readingIndex").alias("lines")]
        if more:
            own += [G.box_around(of(c, "bbox")).alias("bbox"), F.get(of(c, "source"), F.lit(0)).alias("source"), F.flatten(of(c, "sourceSegmentIds")).alias("sourceSegmentIds")]
        return F.struct(c["text"].alias("text"), *own)

    return pages.select(*PAGE, F.posexplode(F.transform("_done", whole)).alias("chunkIndex", "c")).select(*PAGE, "chunkIndex", "c.*").where("text <> ''")


def readable(chunks: DataFrame, page: Column | None = None, system: Column | None = None) -> DataFrame:
    """Adds to (documentId, pageIndex, chunkIndex, text, bbox, source, ..) the hint, role, priority, flags and boxes."""
    page = F.lit(None).cast("struct<width:double,height:double,coordinateSystem:string>") if page is None else page
    d = T.once(chunks, "_clean", T.normalize_artifacts(F.col("text"))).drop("text", "role").withColumnRenamed("_clean", "text").withColumn("pageDimensions", page)
    d = d.withColumn("readingBbox", G.to_top_left(F.col("bbox"), F.col("pageDimensions"), system)).withColumn("normalizedBbox", G.relative(F.col("readingBbox"), F.col("pageDimensions")))
    d = T.once(d, "role", T.classify_role(F.col("text"), F.col("readingBbox.y"), F.col("pageDimensions.height")))
    return d.withColumns({"languageHint": T.language_hint(F.col("text")), "priority": T.role_priority(F.col("role")), "qualityFlags": T.quality_flags(F.col("text"), F.col("role")), "yStart": F.col("readingBbox.y"), "yEnd": F.col("readingBbox.y") + F.col("readingBbox.height")})


def segments_to_chunks(segments: DataFrame, least: int = 120, most: int = 420, page: Column | None = None, system: str = "top-down", repeated: DataFrame | None = None) -> DataFrame:
    """The whole way from segments; chunks are numbered within their page."""
    width = None if page is None else page["width"]
    ordered = reading_order(lines(segments, system=system, page_width=width), system, width)
    return readable(packed(ordered, least, most, repeated), page, F.lit(system))


def _countable() -> Column:
    return (F.col("key") != "") & (F.char_length("key") <= 80) & ~F.col("key").rlike(T.PAGE_NUMBER)


def repeated_lines(rows: DataFrame, page: str, text: str = "text", least: int = 2) -> DataFrame:
    """Keys of lines on `least` or more distinct pages; long keys and page numbers are none."""
    k = T.once(rows.select(F.col(page), F.col(text)), "key", T.line_key(F.col(text))).where(_countable())
    return k.groupBy("key").agg(F.count_distinct(page).alias("pages")).where(F.col("pages") >= least)


def lines_left(rows: DataFrame, page: str, text: str = "text") -> DataFrame:
    """How many lines of each page have a key that no other page has, or one that never counts as repeated; pages without
    such lines have no row. A key is made once and grouped once: its least and greatest page say whether it has two."""
    k = T.once(rows.select(F.col(page), F.col(text)), "key", T.line_key(F.col(text)))
    own = F.concat(F.lit("\n"), F.coalesce(F.col(page).cast("string"), F.lit("\n")))  # no key holds a line break
    k = k.groupBy(F.when(_countable(), F.col("key")).otherwise(own).alias("key")).agg(F.min(page).alias(page), F.max(page).alias("_last"), F.count("*").alias("lines"))
    return k.where(F.col(page).eqNullSafe(F.col("_last"))).groupBy(page).agg(F.sum("lines").alias("lines"))
