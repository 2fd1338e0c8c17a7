"""Counts of pages are made without what they don't need."""

from pyspark.sql import functions as F

from lectern.operators import layout as L
from lectern.operators import pages as PG


def optimized(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


SEGMENT = "documentId string, pageIndex int, segmentIndex int, text string, bbox struct<x:double,y:double,width:double,height:double>, source string, confidence double, paragraphId string, blockId string, hasEOL boolean, fontName string, direction string"


def page_of(spark, texts):
    row = lambda i, t: ("d", i // 9, i % 9, t, (50.0, 40.0 + 14 * (i % 9), min(500.0, 6.0 * len(t)), 12.0), "native-text", 1.0, f"p{i // 2}" if i < 4 else None, None, True, None, None)
    return spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SEGMENT)


def test_lines_have_their_one_paragraph_without_copies_of_rows(spark):
    s = page_of(spark, ["one", "two"]).unionByName(page_of(spark, ["three", "x", "y", "z"]).withColumn("documentId", F.lit("e")).withColumn("bbox", F.struct((F.col("segmentIndex") * 30.0).alias("x"), F.lit(5.0).alias("y"), F.lit(20.0).alias("width"), F.lit(9.0).alias("height"))))
    d = L.lines(s).select("documentId", "text", "paragraphId")
    assert sorted(map(tuple, d.collect())) == [("d", "one", "p0"), ("d", "two", "p0"), ("e", "three x y z", None)]
    assert "Expand" not in optimized(d)


def test_counts_of_pages_are_those_of_their_rows(spark):
    texts = ["CHAPTER ONE", "The river runs slowly. It", "never stops, and so", "we walked on.", "12", "He left. She stayed!", "A long", "way", "home."] * 3
    x = PG.extracted(page_of(spark, texts), 612, 792, 24, 180)
    rows = {r.pageIndex: r for r in x.summary().collect()}
    for name, d in (("chunks", x.chunks), ("paragraphs", x.paragraphs), ("sentences", x.sentences)):
        assert {r.pageIndex: r["count"] for r in d.groupBy("pageIndex").count().collect()} == {i: r[name] for i, r in rows.items()}
    plan = optimized(x.summary())
    assert "appendix" not in plan  # roles are not looked for
