"""Diagnostics of pages."""

from pyspark.sql import functions as F

from lectern.operators import pages as PG


def optimized(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_diagnostics_make_what_is_known_of_pages_once(spark):
    known = spark.range(3).select(F.lit("d").alias("documentId"), F.col("id").cast("int").alias("pageIndex"), F.element_at(F.array(F.lit("native-ready"), F.lit("ocr-ready"), F.lit("ocr-needed")), F.col("id").cast("int") + 1).alias("state"), F.element_at(F.array(F.lit("native"), F.lit("ocr"), F.lit(None)), F.col("id").cast("int") + 1).alias("selectedSource"), (F.col("id") < 2).alias("ttsReady"))
    rows = [("d", p, i, t, s) for p in range(3) for s, ts in (("native-text", ["n0", "n1"]), ("ocr", ["o0"])) for i, t in enumerate(ts)]
    chunks = spark.createDataFrame(rows, "documentId string, pageIndex int, chunkIndex int, text string, source string")
    d = PG.diagnostics(known, chunks, chunks.where("source = 'ocr'"))
    assert sorted((r.pageIndex, r.chunks, r.paragraphs, r.preview) for r in d.collect()) == [(0, 2, 1, ["n0", "n1"]), (1, 1, 1, ["o0"]), (2, 0, 1, [])]
    assert optimized(d).count("Range (") == 1
