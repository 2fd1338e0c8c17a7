import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm.mixing import mix, permuted

SCHEMA = "doc_id long, source string, text string, size string, rid int"


def plan(sizes):
    """The rule as stated, step by step."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(3 * sizes[s] for s in full)
        t = {s: 3 * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            return t
        full |= over


def rows(rng, n=300):
    out = [(i, rng.choice(["a", "b", "é", "Z", None, "a"]), " ".join(rng.choice("xyz") for _ in range(rng.choice([1, 7, 60, 400]))), "s", 1) for i in range(n)]
    out += [(1000, "tiny", "one two\tthree", "s", 1), (1001, "none", None, "s", 1), (1002, "none", " \n", "s", 1), (None, "b", "a b", "s", 1)]
    return out + [(2000, "a", "same words", "s", 1)] * 5


@pytest.mark.parametrize("block", [1, 7, 64, 100000])
def test_targets_and_words(spark, block):
    data = rows(random.Random(block))
    m = mix(spark.createDataFrame(data, SCHEMA), block=block, slots=16)
    got = m.taken().collect()
    assert len(got) == len(data)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in data:
        sizes[r[1]] += size(r[2])
    want, taken = plan(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5
    assert sum(r["count"] for r in m.counts().collect()) == m.slots.count()
    places = [(r.shard, r.slot) for r in m.slots.collect()]
    assert len(set(places)) == len(places) and len({s for s, _ in places}) == -(-len(places) // 16)


def test_content_is_the_documents_words(spark):
    data = rows(random.Random(4), 60)
    df = spark.createDataFrame(data, SCHEMA)
    m = mix(df, block=16, slots=8)
    text = {r[0]: (r[2] or "").split() for r in data}
    slots = defaultdict(list)
    for r in m.texts(df).collect():
        assert r.words.split() == text[r.doc_id][r.word : r.word + r.n]
        slots[r.shard, r.slot].append((r.at, r.n))
    for parts in slots.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n


def test_reruns_agree(spark):
    df = spark.createDataFrame(rows(random.Random(9)), SCHEMA)
    one = sorted(map(str, mix(df, block=32).taken().drop("rid").collect()))
    two = sorted(map(str, mix(df.repartition(7), block=32).taken().drop("rid").collect()))
    assert one == two


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).taken().count() == 0
    assert mix(spark.createDataFrame([(1, "a", None, "", 1)], SCHEMA)).taken().first().taken == 0


def test_permutation(spark):
    for n in (1, 2, 3, 10, 97):
        d = spark.range(n).select(F.col("id"), permuted(F.col("id"), F.lit(n), F.lit("k")).alias("p")).withColumn("q", permuted(F.col("p"), F.lit(n), F.lit("k"), True))
        r = d.collect()
        assert sorted(x.p for x in r) == list(range(n)) and all(x.q == x.id for x in r)


def test_the_draw_makes_the_result(spark):
    data = rows(random.Random(5), 200)
    df = spark.createDataFrame(data, SCHEMA)
    m = mix(df, block=16, slots=32)
    drawn = {(r.shard, r.sid): r["count"] for r in m.counts().collect()}
    slots = m.slots.collect()
    assert drawn == Counter((r.shard, r.sid) for r in slots)
    assert "shard" in m.taken()._jdf.queryExecution().optimizedPlan().toString()
    # shards vary like draws: not all alike, near their share
    totals, n = Counter(), len(slots)
    for (_, sid), c in drawn.items():
        totals[sid] += c
    big = max(totals, key=totals.get)
    full = [drawn.get((s, big), 0) for s in range(n // 32)]
    assert len(set(full)) > 1 and abs(sum(full) / len(full) - 32 * totals[big] / n) < 1
    # a source's slots take its blocks in whole passes
    for sid in totals:
        blocks = Counter(r.block for r in slots if r.sid == sid)
        assert max(blocks.values()) - min(blocks.values()) <= 1 or len(blocks) == 1


def test_taken_equals_the_slots_by_brute_force(spark):
    data = rows(random.Random(6), 80)
    m = mix(spark.createDataFrame(data, SCHEMA), block=8, slots=16)
    pieces = defaultdict(list)
    for r in m.pieces.collect():
        pieces[r.sid, r.block].append(r)
    want = Counter()
    for s in m.slots.collect():
        for r in pieces[s.sid, s.block]:
            want[r.rid] += max(0, min(r["at"] + r.n, s.take) - r["at"])
    assert {r.rid: r.taken for r in m.taken().collect() if r.taken} == {k: v for k, v in want.items() if v}


def test_query_and_clashing_names(spark, tmp_path):
    from lectern.llm.mixing import mixed, op1_mixing

    df = spark.createDataFrame([(1, "a", "x y", 9, 7, "t"), (2, "a", "z", 9, 7, "t")], "doc_id long, source string, text string, size long, id long, src string")
    out = mixed(df)
    assert out.columns == ["doc_id", "source", "text", "id", "src", "size", "source_size", "target", "taken"]
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken, r.id) for r in out.collect()) == [(1, 2, 3, 3.0, 2, 7), (2, 1, 3, 3.0, 1, 7)]
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_mixing(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, got.collect())) == [(1, 2, 3, 3.0, 2), (2, 1, 3, 3.0, 1)]
