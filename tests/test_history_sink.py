"""Reading history kept by a stream: equal to one upsert of all rows, whatever is run twice or killed."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import reading as R
from lectern.operators import history as H
from lectern.streaming import history_sink as S

READING = "documentId string, fileName string, fileSize long, lastModified long, seq long, at string, lastPageIndex int, lastScrollTop double, progressRatio double, speed long"


def some(n, seed=4):
    rng = random.Random(seed)
    return [(f"{d}", f"File {d}.pdf", 1000, 0, i, f"{i:06}", rng.randrange(4), rng.random() * 900, rng.random() * 1.2, rng.randrange(2, 90)) for i in range(n) for d in [rng.randrange(9)]]


def pages(spark):
    rows = [(f"{d}", p, 700.0, (30 * d, d, 40 * p + d)) for d in range(8) for p in range(3)]
    return spark.createDataFrame(rows, "documentId string, pageIndex int, height double, stats struct<cjkCharacters:long,numericUnits:long,englishWords:long>")


def as_one(spark, rows):
    d = spark.createDataFrame(rows, READING)
    docs = H.document_updates(d.withColumns({"lastSpeedPxPerSecond": F.col("speed"), "lastBandKey": R.speed_tier(F.col("speed"))}))
    rhythm = H.rhythm_records(H.reading_rhythm(d.select("documentId", "seq", "speed", F.col("lastPageIndex").alias("pageIndex")), pages(spark)))
    return state(docs), state(rhythm)


def state(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_stream_equals_one_upsert(spark, tmp_path):
    rows, src = some(120), str(tmp_path / "in")
    out = str(tmp_path / "out")
    for a in range(0, 120, 40):
        spark.createDataFrame(rows[a : a + 40], READING).coalesce(1).write.mode("append").parquet(src)
        q = S.keep_history(spark.readStream.schema(READING).parquet(src), pages(spark), out, str(tmp_path / "cp"), 4).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    documents, rhythm = S.tables(spark, out, 4)
    assert (state(documents.records()), state(rhythm.records())) == as_one(spark, rows)


def batch(spark, rows):
    d = spark.createDataFrame(rows, READING).withColumn("id", H.document_key())
    return d.withColumns({"lastSpeedPxPerSecond": F.col("speed"), "lastBandKey": R.speed_tier(F.col("speed"))})


def test_batches_run_again_change_nothing(spark, tmp_path, monkeypatch):
    rows = some(90, 7)
    parts = [rows[:30], rows[30:60], rows[60:]]
    table, _ = S.tables(spark, str(tmp_path), 4)
    table.apply(batch(spark, parts[0]), 0)
    table.apply(batch(spark, parts[1]), 1)
    before = state(table.records())
    # killed between the data and the note that it is written: the table stays as it was
    write = S.Table._write
    monkeypatch.setattr(S.Table, "_write", lambda self, df, name, *by: write(self, df, name, *by) if name == "data" else (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        table.apply(batch(spark, parts[2]), 2)
    assert state(table.records()) == before
    monkeypatch.setattr(S.Table, "_write", write)
    table.apply(batch(spark, parts[2]), 2)
    once = state(table.records())
    table.apply(batch(spark, parts[2]), 2)  # and a batch that had ended
    table.apply(batch(spark, parts[1]), 1)
    table.apply(batch(spark, parts[2]), 2)
    assert state(table.records()) == once == as_one(spark, rows)[0]


def test_only_touched_buckets_are_written(spark, tmp_path):
    table, _ = S.tables(spark, str(tmp_path), 64)
    table.apply(batch(spark, some(90, 9)), 0)
    table.apply(batch(spark, [("x", "one.pdf", 1, 0, 999, "999", 0, 0.0, 0.0, 10)]), 1)
    data = spark.read.parquet(f"{tmp_path}/documents/data").where("version = 1")
    assert data.select("bucket").distinct().count() == 1 and table.records().count() == 10
