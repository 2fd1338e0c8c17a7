"""Helpers shared by the operators: lineage cuts, size-checked broadcasts, null-safe table reads."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most this many rows (some 100 bytes each), or so many of one or two
#: numbers; beyond it the join shuffles.
BROADCAST_ROWS, NARROW_ROWS = 300_000, 500_000
#: Bytes of an Arrow batch sent to a Python worker, unless the session says otherwise.
BATCH_BYTES = 2 << 20


_OWN: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(df: DataFrame) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only in local mode."""
    sc = df.sparkSession.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
        held = sc._jsc.sc().getCheckpointDir()
    path = held.get()
    if path not in _OWN:  # a folder of this application alone: what is left of it goes with the application
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
        _OWN.add(path)
    return path


@contextmanager
def _tidy(spark: SparkSession):
    """Within it, an execution's shuffle files are removed when it ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and drop its lineage. For narrow and short tables."""
    _folder(df)
    with _tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """The same as a Parquet table in that folder: compressed, pruned by column; removed by drop() or at the end."""
    spark = df.sparkSession
    path = f"{_folder(df)}/kept-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a kept table that nothing reads any more."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._kept)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as rows may be of any length. A bound that the session sets stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):  # Spark's own bound
        spark.conf.set(key, BATCH_BYTES)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def free(name: str, *frames: DataFrame) -> str:
    """name, with as many underscores behind it as keep it apart from all columns of the frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a cut table has at most `rows` rows: counted in its partitions, without a shuffle."""
    return df.select(F.lit(1))._jdf.queryExecution().toRdd().count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count shows that it has at most `rows` rows. df should be cut: it is counted."""
    return F.broadcast(df) if is_small(df, rows) else df


def words_col(text, pattern: str = r"[^\x20\x09-\x0D]+"):
    """Number of words of a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges (long ids): one row (node, comp) per node, comp the smallest node.

    Min-label propagation with pointer jumping; every round's labels are checkpointed, and only joins and partially
    aggregated minima move data, so hubs split like any skewed join key.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v").distinct()
    both = cut(both)
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("comp")))
    side = F.broadcast if is_small(labels) else lambda df: df  # no table of a round has more rows
    while True:
        near = both.join(side(labels.withColumnRenamed("node", "v").withColumnRenamed("comp", "lv")), "v").groupBy(F.col("u").alias("node")).agg(F.min("lv").alias("lv"))
        step = labels.join(side(near), "node").select("node", F.least("comp", "lv").alias("to"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("tc"))
        new = cut(step.join(side(jump), "to", "left").select("node", F.least(F.col("to"), F.coalesce("tc", "to")).alias("comp"), "old"))
        done = new.where("comp <> old").isEmpty()
        labels = new.drop("old")
        if done:
            return labels
