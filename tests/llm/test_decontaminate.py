import random
import re

from pyspark.sql import functions as F

from lectern.llm.decontaminate import decontaminate, scan

SCHEMA = "doc_id long, text string, item_id string, lang string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items, n=10):
    out = []
    for d in docs:
        w, hit, found = words(d[1]), set(), set()
        for i, t in items:
            x = words(t)
            k = min(n, len(x))
            for a in range(len(x) - k + 1) if k else ():
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == x[a : a + k]:
                        hit |= set(range(b, b + k))
                        found |= {str(i)} - {"None"}
        out.append((str(d[0]), len(w), len(hit), sorted(found)))
    return sorted(out)


def got(df):
    df = df.withColumn("hit", F.expr("aggregate(hits, 0L, (n, s) -> n + s.to - s.from)"))
    return sorted((str(r.doc_id), r.n_words, r.hit, sorted(r["items"])) for r in df.collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "Cc", "é1"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 4, 10, 11, 25])))) for i in range(20)] + [(99, None), (None, "q w e r t y u i o p"), (50, "same " * 14)]
    docs = [(i, rng.choice([", ", " "]).join([word() for _ in range(rng.choice([0, 9, 40]))] + words(rng.choice(items)[1])), "other", "en") for i in range(60)]
    docs += [(100, None, None, None), (101, "", "", ""), (None, "Q w e-r t y u/i o p!", "", ""), (102, "same " * 40, "", ""), (102, "same " * 40, "", "")]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert got(scan(d, b)) == want
    assert got(scan(d, b, block=30)) == want
    kept = sorted(str(r.doc_id) for r in decontaminate(d, b).collect())
    assert kept == sorted(x[0] for x in want if not x[2])
    assert decontaminate(d, b).columns == ["doc_id", "text", "item_id", "lang"]


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b", "", "")], SCHEMA), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert got(scan(d, b.limit(0))) == [("1", 2, 0, [])]
    assert got(scan(d.limit(0), b)) == []


def test_longest_match(spark):
    text = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, f"x {text} y", "", "")], SCHEMA)
    b = spark.createDataFrame([(1, f"{text} z")], "item_id long, text string")
    r = scan(d, b).first()
    assert r.longest == 30 and [(h["from"], h["to"]) for h in r.hits] == [(1, 31)]


def longest(text, items, n=10):
    """(words, place in the text) of the longest match that begins a window, first place on ties."""
    w, best = words(text), (0, None)
    for _, t in items:
        x = words(t)
        k = min(n, len(x))
        for a in range(len(x) - k + 1) if k else ():
            for b in range(len(w) - k + 1):
                m = 0
                while a + m < len(x) and b + m < len(w) and x[a + m] == w[b + m]:
                    m += 1
                if m >= k and (m > best[0] or m == best[0] and b < best[1]):
                    best = m, b
    return best


def test_longest_matches_and_places(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["a", "b", "c"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 9, 12, 30])))) for i in range(12)]
    docs = []
    for i in range(80):
        x = words(rng.choice(items)[1])
        a = rng.randrange(len(x))
        docs.append((i, " ".join([rng.choice(["a", "b", "zz"]) for _ in range(rng.randrange(15))] + x[a:] + ["zz"] * rng.randrange(2) + x), "", ""))
    text = dict(items)
    for k in (3, 10):
        for block in (10, 10**6):
            for r in scan(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), window=k, block=block).collect():
                n, at = longest(docs[r.doc_id][1], items, k)
                assert r.longest == n and (r.longest_item is None) == (n == 0)
                if n:
                    own = words(docs[r.doc_id][1])
                    assert own[r.longest_at : r.longest_at + n] == words(text[int(r.longest_item)])[r.longest_word : r.longest_word + n]
                    assert r.longest_at == at or block == 10


def test_one_repeated_word_takes_linear_time(spark):
    d = spark.createDataFrame([(1, "same " * 60_000, "", ""), (2, "other " * 10, "", "")], SCHEMA)
    b = spark.createDataFrame([(1, "same " * 2_000), (2, "same " * 50)], "item_id long, text string")
    one, two = sorted(scan(d, b).collect())
    assert (one.longest, one.longest_at, one.longest_word, one["items"]) == (2000, 0, 0, ["1", "2"]) and [tuple(h) for h in one.hits] == [(0, 60_000)]
    assert two.longest == 0


def test_blocks_are_bounded_by_words_of_any_separator(spark):
    from lectern.llm.decontaminate import _blocks

    b = spark.createDataFrame([(i, "\n".join(f"w{i}x{j}" for j in range(50))) for i in range(20)], "item_id long, text string")
    assert [len(x) for x in _blocks(b, 100)] == [2] * 10
    assert [len(x) for x in _blocks(b, 10)] == [1] * 20


def test_query(spark, tmp_path):
    from hashlib import sha256

    from lectern.llm.decontaminate import op6_benchmark_decontamination

    item = " ".join(f"w{i}" for i in range(12))
    spark.createDataFrame([(1, f"x {item} y", "", ""), (2, None, "", ""), (3, "short one", "", "")], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, item), (9, "short one"), (None, "w0 w1")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op6_benchmark_decontamination(spark, str(tmp_path)).collect()}
    sha = lambda t: sha256(t.encode()).hexdigest()
    assert got == {1: (14, 12, 1, sha("10"), True), 2: (0, 0, 0, sha(""), False), 3: (2, 2, 1, sha("9"), True)}


def test_clashing_names(spark):
    schema = "bad_id long, text string, doc_id long, bad_key string, hits string"
    d = spark.createDataFrame([(1, "a b c", 5, "k", "h"), (2, "z", 6, None, None)], schema)
    out = decontaminate(d, spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert out.columns == d.columns and [r.doc_id for r in out.collect()] == [6]
