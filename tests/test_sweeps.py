"""Points on a grid, sweeps along a reader's axis: against plain Python over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import flow as FL
from lectern.operators import layout as L
from lectern.operators import points as O

TARGET = "documentId string, pageIndex int, columnIndex int, chunkIndex int, speechKey string, text string, fragments array<struct<normalizedBbox:struct<x:double,y:double,width:double,height:double>>>"


def nearest(x, y, targets, most):
    columns = {t[2] for t in targets}
    best = None
    for _, _, column, chunk, key, _, frags in targets:
        if {0, 1} <= columns and column != (0 if x < 0.5 else 1):
            continue
        for (b,) in frags:
            if b is None or b[0] is None:
                continue
            d = math.hypot(max(b[0] - x, x - (b[0] + b[2]), 0), max(b[1] - y, y - (b[1] + b[3]), 0))
            if d <= most:
                best = min(best or (9, 0, 0, ""), (d, b[2] * b[3] if d == 0 else math.inf, chunk, key))
    return best


def test_few_copies_of_a_line_in_the_grid(spark):
    """A line across the page is entered in a few wide cells, not in one for each step along it."""
    lit = F.lit
    assert len(spark.range(1).select(O.cells(lit(0.04), lit(0.96), lit(0.1), lit(0.12), 0.07).alias("c")).first().c) == 2


def test_sentences_are_dealt_once(spark):
    """Of all that follows the sentences, only one exchange: by document, for the order on pages and along documents."""
    box = "struct<x:double,y:double,width:double,height:double>"
    s = spark.createDataFrame([], f"documentId string, pageIndex int, segmentIndex int, text string, bbox {box}, source string, confidence double, paragraphId string, blockId string, hasEOL boolean, fontName string, direction string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = O.sentence_targets(s.repartition("documentId"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_points_on_a_grid(spark, seed):
    rng = random.Random(seed)
    targets, points = [], []
    for page in range(6):
        for k in range(40):
            frags = [((rng.choice([0.0, 0.1, 0.5, rng.random()]), rng.random(), rng.choice([0.0, 0.4, rng.random()]), rng.choice([0.0, 0.02, 0.3])),) for _ in range(rng.randrange(1, 4))]
            targets.append(("d", page, rng.choice([0, 1]) if page % 2 else None, k, f"k{k}", "t", frags + [(None,)] * (k % 3 == 0)))
        points += [("d", page, i, rng.choice([0.07 * rng.randrange(15), rng.uniform(-0.1, 1.1)]), rng.uniform(-0.1, 1.1)) for i in range(150)]
    points.append(("d", 0, 999, None, 0.5))
    got = {(r.pageIndex, r.pointId): (round(r.distance, 12), r.speechKey) for r in O.pick_at(spark.createDataFrame(points, "documentId string, pageIndex int, pointId int, x double, y double"), spark.createDataFrame(targets, TARGET)).collect()}
    want = {}
    for _, page, i, x, y in points[:-1]:
        if b := nearest(x, y, [t for t in targets if t[1] == page], 0.035):
            want[page, i] = (round(b[0], 12), b[3])
    assert got == want and len(want) > 100


def test_points_meet_by_cell(spark):
    p = spark.createDataFrame([("d", 0, 1, 0.5, 0.5)], "documentId string, pageIndex int, pointId int, x double, y double")
    plan = O.pick_at(p.hint("merge"), spark.createDataFrame([], TARGET))._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell" in next(x for x in plan.split("\n") if "Join Inner" in x)


def some_flow(seed):
    rng = random.Random(seed)
    passages, readings = [], []
    for r in range(8):
        for k in range(rng.randrange(0, 25)):
            a = rng.choice([float(rng.randrange(0, 300)), 10.0 * rng.randrange(30)])
            passages.append((f"r{r}", f"p{k}", rng.choice(["Lead.", "Lead.", "", None]), a, a + rng.choice([0.0, 10.0, 40.0, 150.0])))
        readings += [(f"r{r}", s, rng.choice([None, *[float(rng.randrange(-10, 420))] * 9, 10.0 * rng.randrange(30)])) for s in range(60)]
    return passages, readings


PASSAGE = "reader string, key string, lead string, start double, end double"


@pytest.mark.parametrize("seed", [1, 2])
def test_crossings(spark, seed):
    passages, readings = some_flow(seed)
    got = FL.crossings(spark.createDataFrame(readings, "reader string, step long, position double"), spark.createDataFrame(passages, PASSAGE))
    want = []
    for i, (r, s, at) in enumerate(readings):
        before = readings[i - 1][2] if s else None
        if before is None or at is None:
            continue
        edges = sorted([(p[3], 1, p[1]) for p in passages if p[0] == r and before < p[3] <= at] + [(p[4], 0, p[1]) for p in passages if p[0] == r and before < p[4] <= at])
        want += [(r, s, k, "start" if e else "tail", place, n) for n, (place, e, k) in enumerate(edges)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


@pytest.mark.parametrize("seed", [3, 4])
def test_bootstrap(spark, seed):
    passages, readings = some_flow(seed)
    got = FL.bootstrap(spark.createDataFrame(readings, "reader string, positionId long, position double"), spark.createDataFrame(passages, PASSAGE))
    want = []
    for r, s, at in readings:
        own = [FL.Passage(k, lead, a, b) for q, k, lead, a, b in sorted(passages, key=lambda p: (p[3], p[4], p[1])) if q == r]
        if at is not None and (p := FL.advance(None, "c", at, True, own)[0].prepared):
            want.append((r, s, p.removesuffix(":lead")))
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_crossings_cost_what_they_find(spark):
    """One step across one of 20,000 passages makes one row, not 20,000 pairs."""
    p = spark.range(20_000).select(F.lit("r").alias("reader"), F.col("id").cast("string").alias("key"), F.lit("L").alias("lead"), (F.col("id") * 10.0).alias("start"), (F.col("id") * 10.0 + 5).alias("end"))
    r = spark.createDataFrame([("r", 1, 4.0), ("r", 2, 11.0), ("r", 3, 12.0)], "reader string, step long, position double")
    assert [(x.step, x.key, x.edge, x.ordinal) for x in FL.crossings(r, p).orderBy("step", "ordinal").collect()] == [(2, "0", "tail", 0), (2, "1", "start", 1)]


def test_tops_at_versions(spark):
    """Equal to a recomputation of the whole document at each version."""
    rng = random.Random(11)
    layout, changes, asked, want = [], [], [], {}
    for d, n in (("a", 1), ("b", 2), ("c", 37), ("d", 64), ("e", 65)):
        now = {p: float(rng.randrange(100, 900)) for p in range(1, n + 1)}
        layout += [(d, p, h) for p, h in now.items()]
        for v in range(1, 40):
            if v % 3:
                for p in rng.sample(range(1, n + 1), min(n, rng.choice([1, 1, 2]))):
                    now[p] = rng.choice([now[p], float(rng.randrange(100, 900))])
                    changes.append((d, v, p, now[p]))
            for p in rng.sample(range(1, n + 1), min(n, 4)):
                asked.append((d, v, p))
                want[d, v, p] = (94 + sum(now[q] + 24 for q in range(1, p)), now[p])
    got = L.tops_at(spark.createDataFrame(layout, "documentId string, pageNumber int, height double"), spark.createDataFrame(changes, "documentId string, version int, pageNumber int, height double"), spark.createDataFrame(asked + asked[:3], "documentId string, version int, pageNumber int"), 94, 24)
    assert {(r.documentId, r.version, r.pageNumber): (r.top, r.height) for r in got.collect()} == want and got.count() == len(want)
