"""The pipeline against brute force on a small corpus, with the toxicity stage's decisions taken from its own query
(which test_toxicity holds to held-out accuracy)."""

import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from lectern.llm import toxicity  # noqa: E402
from tests.llm import test_decontaminate, test_jaccard, test_lines, test_mixing  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    license_, passage, item = line(14), line(60), line(20)
    docs = []
    for i in range(150):
        parts = [line(rng.choice([3, 12, 30])) for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.2:
            parts.append(license_ if rng.random() < 0.7 else license_[:20] + "x" + license_[21:])
        if rng.random() < 0.1:
            parts.append(passage)
        if rng.random() < 0.1:
            parts.append(line(4) + " " + item)
        docs.append([i, "\n".join(parts), "en", rng.choice(["s1", "s2", "s3", None])])
    labels = []
    for r in docs:
        toxic = rng.random() < 0.3
        if toxic:
            r[1] += "\nidiotic moronity scumbag " + line(3)
        labels.append((r[0], 1, int(toxic)))
    for i in range(30):
        w = docs[i][1].split(" ")
        if i % 2 and len(w) > 30:
            w[rng.randrange(len(w))] = "edited"
        docs.append([200 + i, " ".join(w), "en", "s1"])
    docs += [[300, None, "en", "s2"], [301, "", "en", None], [302, "tiny", None, "s2"], docs[5], docs[5]]
    rows = [(*r, len(r[1] or "")) for r in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, line(30))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, [(1, item)]


def test_run_equals_brute_force(spark, corpus):
    d, rows, items = corpus
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    bad = {(r.doc_id) for r in toxicity.score(read("documents"), read("labels")).collect() if r.predicted}
    assert 15 < len(bad) < 90
    left = [r for r in rows if r[0] not in bad]
    kept = test_lines.brute(spark, [(r[0], r[1], r[2], r[3], 1) for r in left], 40, 2, 1)
    source = {r[0]: r[3] for r in rows}
    left = [(int(k), t, "en", 1, "x") for k, t in kept]
    comp = test_jaccard.brute(left)
    n = {k: s for k, s, _ in comp}
    group = {k: c for k, _, c in comp}
    left = [(k, t) for k, t in dict.fromkeys((r[0], r[1]) for r in left) if not n[str(k)] or group[str(k)] == str(k)]
    clean = {k for k, _, hit, _ in test_decontaminate.brute(left, items) if not hit}
    left = [(k, t) for k, t in left if str(k) in clean]
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((k, t or "") for k, t in left)
    sizes, taken = defaultdict(int), Counter()
    for k, t in left:
        sizes[source[k]] += len((t or "").split())
    want = test_mixing.plan(sizes)
    for r in got:
        assert r.size == len((r.text or "").split()) and abs(r.target - want[r.source]) < 1e-6 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 0.5 for s, t in want.items())


def test_stages_keep_the_columns(spark, corpus):
    d, rows, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), d).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), d).count() == 0
