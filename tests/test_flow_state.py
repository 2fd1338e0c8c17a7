"""Paragraph flow as keyed state: table and stream against plain Python, late rows, expiry."""

import random
import time

import pytest

from lectern.operators import flow as FL
from lectern.streaming import paragraph_flow as S

READING = "reader string, step long, context string, position double, playing boolean, ready string, jumped boolean"
PASSAGE = "reader string, key string, lead string, start double, end double"


def some(seed, readers=6, steps=80):
    rng = random.Random(seed)
    passages, readings = [], []
    for r in range(readers):
        at = 0.0
        for k in range(rng.randrange(0, 12)):
            passages.append((f"r{r}", f"p{k}", rng.choice(["Lead.", "Lead.", None]), k * 100.0, k * 100.0 + rng.choice([60.0, 100.0])))
        for s in range(steps):
            at = rng.choice([at + 35, at + 35, at + 35, at - 80, None])
            readings.append((f"r{r}", s, rng.choice(["a"] * 12 + ["b"]), at, rng.random() > 0.05, rng.choice([None, f"p{int((at or 0) // 100)}:lead", f"p{int((at or 0) // 100) + 1}:lead"]), rng.random() > 0.96))
            at = at or 0.0
    return readings, passages


def plain(readings, passages):
    out = []
    for reader in sorted({r[0] for r in readings}):
        own = [FL.Passage(*p[1:]) for p in sorted(passages, key=lambda p: (p[3], p[4], p[1])) if p[0] == reader]
        state = None
        for r in sorted((r for r in readings if r[0] == reader), key=lambda r: r[1]):
            state, acts = FL.advance(state, *r[2:5], own, *r[5:])
            out += [(reader, r[1], a["type"], a["key"], a["reason"]) for a in acts]
    return sorted(out, key=str)


def stream(spark, tmp_path, batches, passages, name, idle_ms=None):
    """The actions of a stream of batches. With idle_ms, which keeps batches running, each batch is waited for until it
    has made an action, and then for much longer than a reader is remembered."""
    src = str(tmp_path / "in")
    spark.createDataFrame(batches[0], READING).coalesce(1).write.parquet(src)
    df = S.actions(spark.readStream.schema(READING).parquet(src), spark.createDataFrame(passages, PASSAGE), idle_ms)
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    try:
        for i, b in enumerate(batches):
            if i:
                spark.createDataFrame(b, READING).coalesce(1).write.mode("append").parquet(src)
            if idle_ms:
                until = time.time() + 40
                while spark.table(name).count() <= i and time.time() < until:
                    time.sleep(0.3)
                time.sleep(4 * idle_ms / 1000)
            else:
                q.processAllAvailable()
    finally:
        q.stop()
    return sorted((tuple(x) for x in spark.table(name).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_table_equals_plain_python(spark, seed):
    readings, passages = some(seed)
    got = FL.fold(spark.createDataFrame(random.Random(seed).sample(readings, len(readings)), READING), spark.createDataFrame(passages, PASSAGE))
    want = plain(readings, passages)
    assert sorted(map(tuple, got.collect()), key=str) == want and {w[2] for w in want} == {"prepare", "discard-prepared", "play-prepared"}


def test_a_long_reading_is_read_in_order(spark):
    """One reader's many steps come in several batches."""
    spark.conf.set("spark.sql.execution.arrow.transformWithStateInPySpark.maxRecordsPerBatch", 50)
    readings, passages = some(5, 1, 400)
    try:
        got = FL.fold(spark.createDataFrame(readings[::-1], READING).repartition(4), spark.createDataFrame(passages, PASSAGE))
        assert sorted(map(tuple, got.collect()), key=str) == plain(readings, passages)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.transformWithStateInPySpark.maxRecordsPerBatch")


def test_stream_equals_plain_python_and_drops_late_rows(spark, tmp_path):
    readings, passages = some(3)
    batches = [[r for r in readings if k * 30 <= r[1] < (k + 1) * 30] for k in range(3)]
    late = [(r[0], r[1], "late", 5.0, True, None, False) for r in batches[0]]  # steps handled before, now different
    got = stream(spark, tmp_path, [batches[0], batches[1] + late, batches[2]], passages, "flow_late")
    assert got == plain(readings, passages)


def test_idle_readers_are_forgotten(spark, tmp_path):
    passages = [("r", "p1", "A.", 0.0, 100.0), ("r", "p2", "B.", 100.0, 200.0), ("r", "p3", "C.", 200.0, 300.0)]
    step = lambda n, at: [("r", n, "c", at, True, None, False)]
    got = stream(spark, tmp_path, [step(1, 50.0) + step(2, 60.0), step(3, 70.0)], passages, "flow_idle", idle_ms=1500)
    # the third step begins its context anew, as nothing is known of the first
    assert got == [("r", 1, "prepare", "p2:lead", None), ("r", 3, "prepare", "p2:lead", None)]
