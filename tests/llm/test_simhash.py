import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lectern.llm import simhash, tokens


def brute_print(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, far):
    """The smallest of each fingerprint's component."""
    left, out = set(prints), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            group.add(x := todo.pop())
            near = {y for y in left if (x ^ y).bit_count() <= far}
            left -= near
            todo += near
        out |= dict.fromkeys(group, min(group))
    return out


def documents():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(200)] + ["Ä", "É", "ẞx", "AbC", "日本"]
    seps = [" ", "\t", "\n", "\x0b", "  ", " \r\n"]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(0, 90))] for _ in range(120)]
    out = []
    for words in base:
        out.append(words)
        for _ in range(rng.randrange(0, 4)):
            near = list(words)
            for _ in range(rng.randrange(0, 2)):
                if near:
                    near[rng.randrange(len(near))] = rng.choice(vocab)
            out.append(near)
    texts = ["".join(w + rng.choice(seps) for w in words) for words in out]
    return texts + [None, "", " \n", "one", "ONE", "one two", "x " * 9000, "\x85a\xa0b c"] + [texts[3]] * 50


def test_equals_brute_force(spark):
    texts = documents()
    rows = [(i if i % 61 else None, t, "x", 1) for i, t in enumerate(texts)] + [(7, texts[7], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long").repartition(3)
    got = simhash.near_duplicates(df)[0].collect()
    prints = [brute_print(t) for _, t, _, _ in rows]
    comp = brute_components(prints, 2)
    ids = {}
    for (i, *_), p in zip(rows, prints, strict=True):
        if i is not None:
            ids[comp[p]] = min(i, ids.get(comp[p], i))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    # a component of rows without ids has none
    want = sorted(((i, p, ids.get(comp[p])) for (i, *_), p in zip(rows, prints, strict=True)), key=key)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=key) == want
    assert len(set(comp.values())) < len(set(prints))


def some_prints(seed, n, dense):
    rng = random.Random(seed)
    heart = rng.getrandbits(64)
    out = {rng.getrandbits(64) for _ in range(n)}
    for x in list(out)[: n // 4]:
        out.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    for _ in range(dense):  # a crowd of near fingerprints, and one that shares two thirds of its bits
        x = heart
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
        out.add(heart ^ (rng.getrandbits(14) << 50))
    return sorted(out)


@pytest.mark.parametrize(("far", "parts"), [(2, 3), (2, 2), (3, 4), (1, 2), (4, 4), (0, 1)])
def test_links_span_the_components(spark, far, parts):
    prints = some_prints(far, 300, 60 if far > 2 else 400)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, far, parts).collect()]
    assert all(a != b and (a ^ b).bit_count() <= far for a, b in found)
    head = {p: p for p in prints}

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in found:
        a, b = sorted((top(a), top(b)))
        head[b] = a
    assert {p: top(p) for p in prints} == brute_components(prints, far)


def test_crowded_keys_make_few_links(spark):
    """A crowd under one key gives links in proportion to its size."""
    heart = 0x123456789ABCDEF0
    prints = {heart ^ (1 << i) ^ (1 << j) ^ (1 << k) for i in range(0, 64, 2) for j in range(1, 64, 3) for k in range(0, 64, 5)}
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in sorted(prints)], "fp long")
    assert simhash.links(df).count() <= 65 * len(prints)


def test_thresholds_are_unequal_and_least():
    rng = np.random.default_rng(1)
    groups = [list(range(0, 22)), list(range(22, 43)), list(range(43, 64))]
    counts = rng.integers(0, 3, (3, 1 << 16))
    values = rng.integers(0, 1 << 21, (3, 500))
    counts[0][values[0, :250] & 0xFFFF] = 5000
    t = simhash.thresholds(values, groups, counts, 2)
    assert (t.sum(0) == 0).all() and (t[0, :250] == -1).all() and (t >= -1).all() and (t <= 1).all()
    cost = lambda i, v, x: 0 if x < 0 else counts[i][v & 0xFFFF] + 1 if x == 0 else counts[i][v & 0xFFFF] * (1 + len(groups[i]) - 16) + sum(counts[i][(v ^ (1 << b)) & 0xFFFF] for b in range(16)) + len(groups[i]) + 1
    for r in range(0, 500, 50):
        least = min(sum(cost(i, values[i, r], x) for i, x in enumerate(c)) for c in [(a, b, -a - b) for a in (-1, 0, 1) for b in (-1, 0, 1) if abs(a + b) < 2])
        assert sum(cost(i, values[i, r], x) for i, x in enumerate(t[:, r])) == least


def test_correlated_bits_share_a_partition(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(2000):
        x = rng.getrandbits(64)
        for i in range(0, 20, 2):  # each even bit below 20 is equal to the odd one at the other end
            x = x & ~(1 << (63 - i)) | ((x >> i & 1) << (63 - i))
        rows.append((int(np.uint64(x).astype(np.int64)),))
    groups = simhash.correlated(spark.createDataFrame(rows, "fp long"), 3)
    where = {b: k for k, g in enumerate(groups) for b in g}
    assert sorted(where) == list(range(64)) and [len(g) for g in groups] == [22, 21, 21]
    assert sum(where[i] == where[63 - i] for i in range(0, 20, 2)) >= 9


def test_empty_table_and_pieces(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df)[0].collect() == []
    data = b"ab cd\nef " * 500 + b"z" * 300 + b" y"
    assert b"".join(tokens.pieces(data, 64)) == data
    assert [w for p in tokens.pieces(data, 64) for w in p.split()] == data.split()
    assert list(simhash.shingles(data, 3)) == [b" ".join(data.split()[i : i + 3]) for i in range(len(data.split()) - 2)]
    assert simhash._values(pa.array([0b101], pa.int64()), [[0, 2], [1, 3]]).tolist() == [[3], [0]]
