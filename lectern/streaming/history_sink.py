"""Reading history kept by a stream: records upserted batch by batch into a table of files.

A table is dealt into buckets by id. A batch reads the buckets that its ids fall into, as they were before it, and writes
them anew under its own number; a second table says which batch wrote a bucket last. Nothing else is read or written. A
batch that is run again finds the same table before it and writes the same files over its own, whether it had ended or
was killed at any point: what an unfinished batch wrote is not in the second table and never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H

BUCKETS = 64


class Table:
    """Records by id in a folder: `merge` makes the new records from the old ones of the touched buckets (None at first)
    and the rows of a batch."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], key: str = "id", buckets: int = BUCKETS):
        self.spark, self.path, self.merge, self.key, self.buckets = spark, path.rstrip("/"), merge, key, buckets

    def _there(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def _latest(self, before: int | None) -> DataFrame | None:
        """bucket and version of the last batch that wrote it: BUCKETS rows at most."""
        if not self._there("written"):
            return None
        done = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/written")
        done = done if before is None else done.where(F.col("version") < before)
        return done.groupBy("bucket").agg(F.max("version").alias("version"))

    def records(self, before: int | None = None, buckets: DataFrame | None = None) -> DataFrame | None:
        """The table as it is, or as it was before a batch, in some buckets."""
        latest = self._latest(before)
        if latest is None or not self._there("data"):
            return None
        if buckets is not None:
            latest = latest.join(buckets, "bucket", "left_semi")
        return self.spark.read.parquet(f"{self.path}/data").join(F.broadcast(latest), ["bucket", "version"]).drop("bucket", "version")

    def _write(self, df: DataFrame, name: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{name}")

    def apply(self, batch: DataFrame, number: int, of: str | None = None) -> None:
        """Upsert a batch of rows, whose column `of` (the key, if not given) decides the bucket."""
        touched = batch.select(self._bucket(of or self.key).alias("bucket")).distinct()
        old = self.records(number, F.broadcast(touched))
        new = self.merge(old, batch).withColumns({"bucket": self._bucket(self.key), "version": F.lit(number).cast("long")})
        self._write(new.repartition("bucket"), "data", "bucket", "version")
        self._write(touched.withColumn("version", F.lit(number).cast("long")).coalesce(1), "written", "version")


def _documents(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    new = H.document_updates(batch)
    return new if old is None else H.upsert(old, new)


def _rhythm(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    return H.rhythm_records(batch if old is None else old.unionByName(batch))


def keep_history(readings: DataFrame, pages: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """A stream of readings (documentId, fileName, fileSize, lastModified, seq, at, lastPageIndex, lastScrollTop,
    progressRatio, speed) kept as two tables under `path`: documents and rhythm. pages as for rhythm.window_counts().
    Returns the writer, to be given a trigger and started."""
    spark = readings.sparkSession
    documents, rhythm = tables(spark, path, buckets)

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("id", H.document_key())
        documents.apply(rows.withColumns({"lastSpeedPxPerSecond": F.col("speed"), "lastBandKey": H.speed_tier(F.col("speed"))}), number)
        rhythm.apply(H.reading_rhythm(batch.select("documentId", "seq", "speed", F.col("lastPageIndex").cast("int").alias("pageIndex")), pages), number)

    return readings.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def tables(spark: SparkSession, path: str, buckets: int = BUCKETS) -> tuple[Table, Table]:
    """The tables of documents and of rhythm."""
    return Table(spark, f"{path}/documents", _documents, "id", buckets), Table(spark, f"{path}/rhythm", _rhythm, "documentId", buckets)
