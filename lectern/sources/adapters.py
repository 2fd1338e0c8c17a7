"""Sources: positioned text segments from page items, recognised text and plain documents; byte ranges; reader state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

BOX = "struct<x:double,y:double,width:double,height:double>"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it has fewer splits than there are: files of one row group are read by one task. Tables
    of more splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as bytes with their size and time."""
    return spark.read.format("binaryFile").load(path)


def segment(document: Column, page: Column, ordinal: Column, text: Column, box: Column, trimmed: bool = False, **more: Column) -> list[Column]:
    """The columns of a text segment, coerced: trimmed text, language hint, confidence within 0 and 1."""
    t = text if trimmed else T.trim(F.coalesce(text, F.lit("")))
    whole = lambda c: F.greatest(F.lit(0), F.floor(G.finite(c) + 0.5)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    return [
        document.cast("string").alias("documentId"), whole(page).alias("pageIndex"), whole(ordinal).alias("segmentIndex"), t.alias("text"), T.language_hint(t).alias("languageHint"), box.alias("bbox"),
        box["y"].alias("yStart"), (box["y"] + box["height"]).alias("yEnd"), more.get("source", F.lit("native-text")).alias("source"), G.clamp(G.finite(more.get("confidence", F.lit(1.0)))).alias("confidence"),
        more.get("paragraphId", none("string")).cast("string").alias("paragraphId"), more.get("blockId", none("string")).cast("string").alias("blockId"), F.coalesce(more.get("hasEOL", F.lit(False)), F.lit(False)).alias("hasEOL"),
        F.nullif(more.get("fontName", none("string")), F.lit("")).alias("fontName"), F.nullif(more.get("direction", none("string")), F.lit("")).alias("direction"),
    ]


def document_segments(docs: DataFrame) -> DataFrame:
    """One segment for each line of text: 40 lines a page of 612 x 792, boxes 14 apart and 6 wide a character."""
    rows = docs.select(F.col("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    rows = T.once(rows, "line", T.trim(F.col("raw"))).where("line <> ''")
    n = F.col("line_no")
    box = F.struct(F.lit(50.0).alias("x"), (40 + 14 * (n % 40)).cast("double").alias("y"), F.least(F.lit(512.0), 6.0 * F.char_length("raw")).alias("width"), F.lit(12.0).alias("height"))
    return rows.select(*segment(F.col("doc_id"), F.floor(n / 40), n % 40, F.col("line"), box, trimmed=True, hasEOL=F.lit(True)))


ITEMS = "array<struct<str:string,transform:array<double>,width:double,height:double,hasEOL:boolean,fontName:string,dir:string>>"


def page_item_segments(pages: DataFrame) -> DataFrame:
    """pages: documentId, pageIndex, items (text items with transform matrices), optional viewport matrix of six
    numbers. Blank items are left out and the rest numbered densely."""
    rows = pages.select("*", F.posexplode("items").alias("at", "item")).where(F.col("item.str").rlike(T.NOT_WS))
    x, y = (F.coalesce(F.get("item.transform", F.lit(i)), F.lit(0.0)) for i in (4, 5))
    w = F.coalesce("item.width", F.lit(0.0))
    h = F.coalesce(F.nullif("item.height", F.lit(0.0)), F.abs(F.get("item.transform", F.lit(3))), F.lit(0.0))
    plain = F.struct(x.alias("x"), y.alias("y"), F.greatest(F.lit(0.0), w).alias("width"), F.greatest(F.lit(0.0), h).alias("height"))
    box = plain
    if "viewport" in pages.columns:
        m = [F.get("viewport", F.lit(i)) for i in range(6)]
        at = lambda a, b: (m[0] * a + m[2] * b + m[4], m[1] * a + m[3] * b + m[5])
        (x0, y0), (x1, y1) = at(x, y), at(x + w, y + h)
        box = F.when(F.col("viewport").isNull(), plain).otherwise(F.struct(F.least(x0, x1).alias("x"), F.least(y0, y1).alias("y"), F.abs(x1 - x0).alias("width"), F.abs(y1 - y0).alias("height")))
    order = F.row_number().over(W.partitionBy("documentId", "pageIndex").orderBy("at")) - 1
    rows = rows.withColumn("ordinal", order)
    return rows.select(*segment(F.col("documentId"), F.col("pageIndex"), F.col("ordinal"), F.col("item.str"), box, hasEOL=F.col("item.hasEOL"), fontName=F.col("item.fontName"), direction=F.col("item.dir")))


def plain_text(segments: DataFrame) -> DataFrame:
    """Text of each page, its segments joined by blanks."""
    ordered = F.array_sort(F.collect_list(F.struct("segmentIndex", "text")))
    return segments.groupBy("documentId", "pageIndex").agg(F.array_join(F.filter(F.transform(ordered, lambda s: s["text"]), lambda t: t != ""), " ").alias("text"))


_NUMS = "x0:double,y0:double,x1:double,y1:double,left:double,top:double,right:double,bottom:double,x:double,y:double,width:double,height:double"
_ITEM = f"text:string,confidence:double,conf:double,blockId:string,paragraphId:string,bbox:struct<{_NUMS}>,{_NUMS},symbols:array<struct<text:string>>"
_WORDS = f"blockId:string,paragraphId:string,words:array<struct<{_ITEM}>>"


def _result(line: str) -> str:
    body = f"text:string,blocks:array<struct<lines:array<struct<{line}>>,paragraphs:array<struct<lines:array<struct<{line}>>>>>>,lines:array<struct<{line}>>,words:array<struct<{_ITEM}>>"
    return f"struct<{body},data:struct<{body}>>"


#: What is read of a recognition result: of its lines either themselves or their words, as only one of them is wanted.
OCR = {"lines": _result(_ITEM), "words": _result(_WORDS)}


def ocr_box(item: Column) -> Column:
    """Box of a recognised item, from corners or from a corner and a size."""

    def corners(b):
        x0, y0 = F.coalesce(b["x0"], b["left"], b["x"], F.lit(0.0)), F.coalesce(b["y0"], b["top"], b["y"], F.lit(0.0))
        x1, y1 = F.coalesce(b["x1"], b["right"], x0 + b["width"], x0), F.coalesce(b["y1"], b["bottom"], y0 + b["height"], y0)
        return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    def box(c):
        return F.struct(F.least(c["x0"], c["x1"]).alias("x"), F.least(c["y0"], c["y1"]).alias("y"), F.abs(c["x1"] - c["x0"]).alias("width"), F.abs(c["y1"] - c["y0"]).alias("height"))

    return T.let(F.when(item["bbox"].isNotNull(), corners(item["bbox"])).otherwise(corners(item)), box)


def ocr_text(item: Column) -> Column:
    """Text of a recognised item or its symbols, without bars at its ends."""

    def bare(t):
        barred = F.contains(t, F.lit("|")) | F.contains(t, F.lit("¦"))
        return F.when(barred, T.trim(F.regexp_replace(F.regexp_replace(t, rf"^[|¦]+{T.WS}*", ""), rf"{T.WS}*[|¦]+$", ""))).otherwise(t)

    return T.let(T.trim(F.coalesce(item["text"], F.array_join(F.transform(item["symbols"], lambda s: F.coalesce(s["text"], F.lit(""))), ""), F.lit(""))), bare)


def _filled(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def _any(c: Column, test) -> Column:
    return F.coalesce(F.exists(c, test), F.lit(False))


def _each(c: Column, f) -> Column:
    return F.transform(F.coalesce(c, F.array()), f)


def normalize_ocr(result: Column, prefer: str = "lines") -> Column:
    """The items of a result parsed as OCR[prefer], each made once. Lines of paragraphs win over a block's own, those of
    blocks over the result's, and its words over none at all; words come from block lines, else from the result, else
    from its lines."""

    def item(i, block=None, paragraph=None):
        first = lambda k, other: i[k] if other is None else F.coalesce(i[k], other)
        return F.struct(ocr_text(i).alias("text"), ocr_box(i).alias("box"), F.coalesce(i["confidence"], i["conf"], F.lit(1.0)).alias("confidence"), first("paragraphId", paragraph).alias("paragraphId"), first("blockId", block).alias("blockId"))

    def of_line(block=None, paragraph=None):
        """What a line gives: itself, or its words; without a name of its own it has that of its block and paragraph."""

        def of(line):
            if prefer == "lines":
                return F.array(item(line, block, paragraph))
            own = lambda k, other: line[k] if other is None else F.coalesce(line[k], other)
            return _each(line["words"], lambda w: item(w, own("blockId", block), own("paragraphId", paragraph)))

        return of

    in_paragraphs = lambda b: _any(b["paragraphs"], lambda p: _filled(p["lines"]))

    def of_block(b, i):
        name = F.concat(F.lit("block:"), i.cast("string"))
        inner = lambda p, j: F.flatten(_each(p["lines"], of_line(name, F.concat(name, F.lit(":paragraph:"), j.cast("string")))))
        return F.when(in_paragraphs(b), F.flatten(_each(b["paragraphs"], inner))).otherwise(F.flatten(_each(b["lines"], of_line(name))))

    pick = lambda k: F.when(_filled(result[k]), result[k]).otherwise(result["data"][k])
    blocks = F.coalesce(result["blocks"], result["data"]["blocks"])
    in_blocks = _any(blocks, lambda b: in_paragraphs(b) | _filled(b["lines"]))
    from_blocks, from_lines = F.flatten(_each(blocks, of_block)), F.flatten(_each(pick("lines"), of_line()))
    own_words = _each(pick("words"), lambda w: item(w))
    if prefer == "lines":
        return F.when(in_blocks, from_blocks).when(_filled(pick("lines")), from_lines).otherwise(own_words)
    return T.let(from_blocks, lambda ws: F.when(_filled(ws), ws).when(_filled(pick("words")), own_words).when(in_blocks, ws).otherwise(from_lines))


def ocr_items(pages: DataFrame, prefer: str = "lines") -> DataFrame:
    """pages: documentId, pageIndex, result (JSON text of a recognition result), one row a page. The page's lines or words
    in their order, but for those without text or place."""
    prefer = "words" if prefer == "words" else "lines"
    seen = lambda i: (i["text"] != "") & ~((i["box"]["width"] <= 0) & (i["box"]["height"] <= 0))
    items = T.let(F.from_json("result", OCR[prefer]), lambda r: F.filter(normalize_ocr(r, prefer), seen))  # what is parsed is no column: it is many times as large
    return T.once(pages.select("documentId", "pageIndex", "result"), "items", items).drop("result")


def ocr_segments(pages: DataFrame, prefer: str = "lines") -> DataFrame:
    """The items of ocr_items() as segments, numbered along their page."""
    rows = ocr_items(pages, prefer).select("documentId", "pageIndex", F.posexplode("items").alias("ordinal", "i"))
    c = F.col("i.confidence")
    return rows.select(*segment(F.col("documentId"), F.col("pageIndex"), F.col("ordinal"), F.col("i.text"), F.col("i.box"), trimmed=True, source=F.lit("ocr"), confidence=F.when(c > 1, c / 100).otherwise(c), paragraphId=F.col("i.paragraphId"), blockId=F.col("i.blockId"), hasEOL=F.lit(True)))


def byte_range(header: Column, size: Column) -> Column:
    """Struct (ok, start, end, length) of a single-range header; null without a header."""
    h = T.trim(header)
    a, b = (F.nullif(F.regexp_extract(h, r"(?i)^bytes=([0-9]*)-([0-9]*)$", i), F.lit("")) for i in (1, 2))
    first, second = a.try_cast("long"), b.try_cast("long")
    safe = lambda raw, n: raw.isNull() | (n <= 9007199254740991)
    start = F.when(a.isNull(), size - F.least(second, size)).otherwise(first)
    end = F.when(a.isNull() | b.isNull(), size - 1).otherwise(F.least(second, size - 1))
    good = h.rlike(r"(?i)^bytes=[0-9]*-[0-9]*$") & (size > 0) & (a.isNotNull() | b.isNotNull()) & F.coalesce(safe(a, first) & safe(b, second), F.lit(False)) & ~(a.isNull() & F.coalesce(second == 0, F.lit(False)))
    good = F.coalesce(good & (start < size) & (start <= end), F.lit(False))
    yes = F.struct(F.lit(True).alias("ok"), start.alias("start"), end.alias("end"), (end - start + 1).alias("length"))
    no = F.struct(F.lit(False).alias("ok"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("long").alias("length"))
    return F.when(header.isNull(), None).when(good, yes).otherwise(no)


STATE = "struct<schemaVersion:int,createdAt:string,updatedAt:string,documents:map<string,string>,rhythmRecords:map<string,string>,preferences:map<string,string>>"


def read_state(raw: Column, now: Column) -> Column:
    """Reader state from JSON text: defaults for what is missing, old fields moved, numbers clamped; corrupt text is an
    empty state."""
    s = F.from_json(raw, STATE)
    p = lambda k: s["preferences"][k]
    num = lambda k, d: G.finite(F.coalesce(p(k), F.lit(str(d))), d)
    flag = lambda k, d: F.coalesce(p(k).try_cast("boolean"), F.lit(d))
    prefs = F.struct(
        G.clamp(F.floor(num("defaultSpeedPxPerSecond", 16) + 0.5), 4, 64).cast("int").alias("defaultSpeedPxPerSecond"), G.clamp(num("soundCueVolume", 0.28)).alias("soundCueVolume"),
        G.clamp(F.floor(num("recentDocumentLimit", 6) + 0.5), 1, 18).cast("int").alias("recentDocumentLimit"), F.lit(True).alias("soundCueEnabled"), flag("showDetailedRhythmStats", False).alias("showDetailedRhythmStats"),
        (~(F.coalesce(p("restoreLastPositionEnabled"), F.lit("true")) == "false")).alias("restoreLastPositionEnabled"), F.when(p("rhythmPatternMode").isin("soft", "clear"), p("rhythmPatternMode")).otherwise("soft").alias("rhythmPatternMode"),
        F.coalesce(p("ttsEnabled").try_cast("boolean"), p("ttsMode").isin("whisper", "flow"), F.lit(False)).alias("ttsEnabled"), G.clamp(num("ttsVolume", 0.42)).alias("ttsVolume"), flag("ttsMuted", True).alias("ttsMuted"),
    )
    none = F.create_map().cast("map<string,string>")
    return F.struct(F.lit(1).alias("schemaVersion"), F.coalesce(s["createdAt"], now).alias("createdAt"), F.coalesce(s["updatedAt"], now).alias("updatedAt"), F.coalesce(s["documents"], none).alias("documents"), F.coalesce(s["rhythmRecords"], none).alias("rhythmRecords"), prefs.alias("preferences"))


def write_state(state: Column, now: Column) -> Column:
    """JSON text of a state, stamped."""
    return F.to_json(state.withField("updatedAt", now))


def cleared_state(now: Column) -> Column:
    """The state of a reader that has been cleared: all defaults."""
    return read_state(F.lit(None).cast("string"), now)
