import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import toxicity as tx


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    bad = ["zxidiot", "zxmoron", "qvscum"]
    docs, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.2
        w = [word() for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(2, 5) * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "ab", "cd"]))
        docs.append((i, " ".join(w), f"s{i % 3}", 1.0))
        if i % 10:
            labels.append((i, rng.randrange(2), int(toxic)))
    docs += [(1000, None, "s", 1.0), (1001, "", "s", 1.0), (None, "a b", "s", 1.0), (1002, docs[3][1], "s", 1.0), (1003, "word " * 30000, "s", 1.0)]
    labels += [(5, 1, None), (None, 1, 1), (9999, 1, 1), (1001, 1, 7)]
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels, d, y = corpus
    got = {r.doc_id: r for r in tx.score(d, y).collect()}
    assert len(got) == len(docs)
    right = []
    for k, _, t in labels:
        r = got.get(k)
        if k is None or r is None or t not in (0, 1):
            continue
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
        if r.held_out:
            right.append(r.predicted == t)
    assert len(right) > 100 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[1000].score == got[1001].score == got[None].score and not got[1000].predicted
    assert got[1002].score == got[3].score
    toxic = {k for k, _, t in labels if t == 1}
    for r in got.values():
        for e in r.evidence:
            assert 0 < e.cosine <= 1 and (e.toxic == 1) == (e.doc_id in toxic)


def test_held_out_labels_are_not_read(spark, corpus):
    docs, labels, d, y = corpus
    turned = [(k, q, 1 - t if k is not None and t in (0, 1) and zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    other = spark.createDataFrame(turned, "doc_id long, quality int, toxic int")
    assert sorted(map(str, tx.score(d, y).collect())) == sorted(map(str, tx.score(d, other).collect()))


def test_nearest_is_exact():
    rng = np.random.default_rng(4)
    n_terms = 60
    examples = []
    for i in range(500):
        t = sorted(rng.choice(n_terms, rng.integers(0, 9), replace=False).tolist())
        examples.append((i, t, rng.integers(1, 4, len(t)).tolist(), int(rng.integers(0, 2))))
    m = tx.Model(np.arange(n_terms, dtype=np.uint64), rng.random(n_terms) + 0.5, examples, k=7, block=16)
    some = [e for e in examples if e[1]]
    dense = np.zeros((len(some), n_terms))
    for r, e in enumerate(some):
        t, w = m.weights(e[1], e[2])
        dense[r, t] = w
    for e in examples[:200]:
        if e[1]:
            v = m.weights(e[1], e[2])
            q = np.zeros(n_terms)
            q[v[0]] = v[1]
            s = dense @ q
            best = np.sort(s[s > 0])[::-1][:7]
            i, got = m.nearest(v)
            assert np.allclose(got, best) and np.allclose(s[i], got)


def test_no_labels_and_empty(spark, corpus):
    _, _, d, y = corpus
    assert {r.score for r in tx.score(d, y.limit(0)).collect()} == {0.0}
    assert tx.score(d.limit(0), y).count() == 0
    assert tx.without_toxic(d, y.limit(0)).count() == d.count()


def test_terms_of_both_labels_are_in_the_vocabulary(spark):
    rows = [(f"plain{i % 3} common", 0) for i in range(60)] + [("common vile", 1) for _ in range(20)]
    words = ["common", "plain0", "plain1", "plain2", "vile"]
    held = tx._vocabulary(spark.createDataFrame(rows, "text string, toxic int"))
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    _, _, h, _ = tx.tokens.words(data, np.array([0, len(data)]), tx.tokens.ALNUM)
    assert set(h.tolist()) <= set(held.tolist())


def test_many_ties():
    rng = np.random.default_rng(5)
    terms, tf = list(range(40)), [1] * 40
    examples = [(i, terms, tf, int(i % 2)) for i in range(3000)] + [(9000 + i, sorted(rng.choice(60, 5, replace=False).tolist()), [1] * 5, 0) for i in range(200)]
    m = tx.Model(np.arange(60, dtype=np.uint64), np.ones(60), examples, k=7, block=16)
    v = m.weights(terms, tf)
    for i, s in m.nearest_of([v] * 40):
        assert i.tolist() == list(range(7)) and np.allclose(s, 1)
    assert m.nearest(v, 0)[0].tolist() == list(range(1, 8))


def test_samples_are_bounded_and_the_same_again(corpus):
    docs, labels, d, y = corpus
    m = tx.fit(d, y, max_train=200, max_examples=60)
    assert len(m.ids) + len(m.none) == 60
    one, two = (sorted((str(r.doc_id), r.score) for r in tx.score(x, y, 200, 60).collect()) for x in (d, d.repartition(5)))
    assert one == two and len(one) == len(docs)


def test_clashing_names(spark, corpus):
    _, _, _, y = corpus
    d = spark.createDataFrame([(1, "a plain text", 3, "k", 0.5, 1, "e")], "doc_id long, text string, id long, tkey string, score double, toxic int, bad_key string")
    assert tx.without_toxic(d, y).columns == d.columns and tx.without_toxic(d, y.withColumnRenamed("quality", "id")).count() == 1


def terms_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode()
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", low):
        yield 0, w
        yield from ((n, w[:n]) for n in tx.STEMS if len(w) > n)


def steps_of(votes, labels):
    """Isotonic regression by its definition: the largest of the least means around each point."""
    points = sorted({v: [y for u, y in zip(votes, labels, strict=True) if u == v] for v in votes}.items())
    sums, sizes = np.cumsum([0] + [sum(y) for _, y in points]), np.cumsum([0] + [len(y) for _, y in points])
    fit = []
    for i in range(len(points)):
        fit.append(max(min((sums[b] - sums[a]) / (sizes[b] - sizes[a]) for b in range(i + 1, len(points) + 1)) for a in range(i + 1)))
    xs, ys, i = [], [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and abs(fit[j + 1] - fit[i]) < 1e-12:
            j += 1
        value = (sums[j + 1] - sums[i] + 0.02) / (sizes[j + 1] - sizes[i] + 0.2)
        xs += [points[i][0], points[j][0]] if j > i else [points[i][0]]
        ys += [value, value] if j > i else [value]
        i = j + 1
    return xs, np.maximum.accumulate(ys)


def test_scores_equal_brute_force(spark):
    """The query's scores from their definition: every cosine with every example, votes, calibration."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(90)]
    docs, labels = [], []
    for i in range(260):
        toxic = rng.random() < 0.3
        w = rng.choices(words[:70] if toxic else words[20:], k=rng.randrange(12, 40))
        docs.append((i, " ".join(w).upper() if i % 5 == 0 else "-".join(w)))
        if i % 6:
            labels.append((i, int(toxic)))
    docs += [(300, None), (301, ""), (302, "zz"), (303, "zz yy"), (5, docs[5][1])]
    labels += [(301, 0), (302, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    scored = tx.score(d, spark.createDataFrame(labels, "doc_id long, toxic int")).select("doc_id", "score").distinct()
    got = {(r.doc_id, r.text): r.score for r in d.join(scored, "doc_id").collect()}

    label = {k: y for k, y in labels if zlib.crc32(str(k).encode()) % 5}
    train = sorted({(k, t or "", label[k]) for k, t in docs if k in label})
    seen, held = Counter(), Counter()
    for _, t, _ in train:
        held.update(set(terms_of(t)))
    for _, t in docs:
        seen.update(set(terms_of(t)))
    least = max(tx.LEAST_DOCS, -(-len(train) // tx.LEAST_SHARE))
    idf = {t: math.log((1 + len(docs)) / (1 + seen[t])) ** tx.IDF_POWER + 1e-3 for t, n in held.items() if n >= least}

    def vector(text):
        w = {t: n * idf[t] for t, n in Counter(terms_of(text)).items() if t in idf}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    known = [(v, y) for _, t, y in train if (v := vector(t))]
    none = [y for _, t, y in train if not vector(t)]
    prior = (sum(none) + 0.1) / (len(none) + 1)

    def vote(v, skip=None):
        near = [(sum(x * float(np.float32(u[t])) for t, x in v.items() if t in u), y) for i, (u, y) in enumerate(known) if i != skip]
        near = sorted(((s, y) for s, y in near if s > 0), reverse=True)[: tx.K]
        w = [1 / (1.05 - min(s, 1)) for s, _ in near]
        return (sum(a * y for a, (_, y) in zip(w, near, strict=True)) + prior) / (sum(w) + 1)

    xs, ys = steps_of([vote({t: float(np.float32(x)) for t, x in v.items()}, i) for i, (v, _) in enumerate(known)] + [prior] * len(none), [y for _, y in known] + none)
    assert len(known) > 120 and len(none) > 0
    for (k, t), score in got.items():
        v = vector(t)
        assert abs(score - np.interp(vote(v) if v else prior, xs, ys)) < 1e-6, k
