import random
import re

import pytest

from lectern.llm.jaccard import jaccard_join

SCHEMA = "doc_id long, text string, lang string, n int, row string"


def brute(rows, n=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(low))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((str(r[0]), len(sets[i]), str(least.get(root(i)))) for i, r in enumerate(rows)))


def check(spark, rows, **kw):
    got, links = jaccard_join(spark.createDataFrame(rows, SCHEMA), **kw)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute(rows)
    return links


def test_random_families(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeF") for _ in range(3))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 12, 60, 90]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(w), "en", 1, "x"))
    rng.shuffle(rows)
    check(spark, rows)
    check(spark, rows, common_tokens=5)
    check(spark, rows, common_tokens=0)


def test_odd_rows(spark):
    same = "a b c d e f g h"
    rows = [(1, None, None, None, None), (2, "", "en", 1, "x"), (3, " \n\t", "en", 1, "x"), (4, same, "en", 1, "x"), (4, same, "en", 1, "x"), (None, same.upper(), "de", 2, None), (None, "lonely", "de", 2, None), (7, "x " * 30000, "en", 1, "x"), (8, "x y é", "en", 1, "x"), (9, "X y É", "en", 1, "x")]
    check(spark, rows)


def test_empty_table(spark):
    got, links = jaccard_join(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and links.count() == 0


@pytest.mark.parametrize("edge", [(9, True), (8, False)])
def test_threshold_is_inclusive(spark, edge):
    # sets of 9 and 9 shingles with 8 in common: 8 / 10; with 8 and 7 in common less
    shared, linked = edge
    a = [f"w{i}" for i in range(13)]
    b = a[: shared + 3] + [f"z{i}" for i in range(13 - shared - 3)]
    check(spark, [(1, " ".join(a), "", 1, ""), (2, " ".join(b), "", 1, "")])


def test_one_of_each_with_clashing_names(spark):
    from lectern.llm.jaccard import one_of_each

    d = spark.createDataFrame([(2, "a b c d e f", 7, "k", 1), (1, "a b c d e f", 8, "l", 2), (3, "other words", 9, "m", 3), (1, "a b c d e f", 8, "l", 2)], "doc_id long, text string, id long, tkey string, _id int")
    out = one_of_each(d)
    assert out.columns == d.columns and sorted(map(tuple, out.collect())) == [(1, "a b c d e f", 8, "l", 2), (3, "other words", 9, "m", 3)]


def test_a_token_in_every_document(spark, monkeypatch):
    """One passage in all documents, more of them than HOT: it moves to the end of the order and nothing is lost."""
    from lectern.llm import jaccard

    monkeypatch.setattr(jaccard, "HOT", 6)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(9)]
    rows = []
    for i in range(30):
        w = passage + [word() for _ in range(rng.choice([2, 8, 30]))]
        rows.append((2 * i, " ".join(w), "", 1, ""))
        w[-1] = rng.choice([w[-1], "x"])
        rows.append((2 * i + 1, " ".join(w), "", 1, ""))
    check(spark, rows)


def test_query(spark, tmp_path):
    from lectern.llm.jaccard import op4_ngram_jaccard_join

    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(6)]
    rows = [(i, base[i % 6] + (" z" if i % 4 == 0 else ""), "", 1, "") for i in range(24)] + [(50, None, "", 1, "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in op4_ngram_jaccard_join(spark, str(tmp_path)).collect())
    assert got == brute(rows)
