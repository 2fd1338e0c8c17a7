import random
import re
from collections import Counter, defaultdict

import pytest

from lectern.llm import divergence


def brute(rows, least=10, ranks=10):
    counts, lang_counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang, source].update(words)
        lang_counts[lang].update(words)
        docs[lang].update(set(words))
    out = []
    prob = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    diff = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, total = len(kept), lambda c: sum(c[t] for t in kept)  # noqa: B023
        of = lambda c: {t: prob(c[t], total(c), v) for t in kept}  # noqa: B023
        p, q = of(counts[lang, source]), of(lang_counts[lang])
        parts = {"pair": [], "term": [(diff(p[t], q[t]), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]}
        for lang2, other in groups:
            if lang2 == lang and other != source:
                r = of(counts[lang, other])
                parts["pair"].append((sum(diff(p[t], r[t]) for t in kept), other))
        for part, found in parts.items():
            found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= ranks]
    return sorted(out)


def some(seed, docs, sources, vocab=120):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(vocab)] + ["Ärger", "ärger", "日本", "don't", "ABC", "é😀", "ſs", "İx"]
    own = {s: [rng.random() ** 3 for _ in words] for s in sources}
    rows = []
    for _ in range(docs):
        s = rng.choice(sources) if rng.random() < 0.6 else sources[0]  # a hot source
        text = rng.choice([" ", ", ", "\n", "1"]).join(rng.choices(words, own[s], k=rng.randrange(0, 60)))
        rows.append((rng.choice([text, text.upper(), text]), rng.choice(["en", "en", "de", None, "", "xx"]), s))
    return rows


CASES = [
    some(1, 900, ["a", "b", None, "", "é", "z"]),
    some(2, 300, [f"s{i}" for i in range(70)]),  # more sources than a block of postings has
    [("a b c " * 3, "en", "one")] * 12 + [(None, "en", "two"), ("", "en", "three"), ("d e", "fr", "one"), ("1 2 [", "fr", "two")],
    [("word " * 40 + f"rare{'x' * i}", "en", f"s{i % 3}") for i in range(40)] + [("tie tied ties", "en", "s0")] * 20,
]


@pytest.mark.parametrize("rows", CASES)
def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "text string, lang string, source string, no int, term string").repartition(3)
    assert sorted(map(tuple, divergence.audit(df).collect())) == brute(rows)


def test_bounds_leave_most_terms_closed(spark, monkeypatch):
    """The search evaluates few of a group's terms, and finds the same; ranks and least are parameters."""
    rows = some(3, 2000, ["a", "b"], 600)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(df, 4, 3).collect())) == brute(rows, 4, 3)
    _, postings = divergence.tables(df, 4)
    opened, small = [], divergence.common.small

    def counting(side, *more):
        if "bucket" in side.columns:
            opened.append(postings.withColumn("bucket", BUCKET).join(side, [*divergence.GROUP, "bucket"]).count())
        return small(side, *more)

    from pyspark.sql import functions as F

    BUCKET = F.expr(f"CASE WHEN c < {divergence.PLAIN} THEN c ELSE {divergence.PLAIN} + cast(floor(log2(c) * {divergence.STEPS}) AS bigint) END")
    monkeypatch.setattr(divergence.common, "small", counting)
    divergence.first_terms(postings, 3)
    assert 0 < sum(opened) < postings.count() / 2


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "c long, n long, v long")
    assert df.select(divergence.probability("c", "n", "v")).first()[0] == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 14)
