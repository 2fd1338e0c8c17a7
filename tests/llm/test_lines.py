import random
from hashlib import sha256

from pyspark.sql import functions as F

from lectern.llm import lines
from lectern.llm.lines import dedup, edit_distance, op8_line_dedup

SCHEMA = "doc_id long, text string, lang string, line string, h long"


def dp(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1]


def edited(rng, line, n):
    c = list(line)
    for _ in range(n):
        i = rng.randrange(len(c) + 1)
        match rng.randrange(3):
            case 0:
                c.insert(i, rng.choice("ab é"))
            case 1 if len(c) > 1:
                c.pop(min(i, len(c) - 1))
            case _:
                c[min(i, len(c) - 1)] = rng.choice("ab 😀")
    return "".join(c)


def test_edit_distance(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(800):
        a = "".join(rng.choice("ab é") for _ in range(rng.randrange(1, 60)))
        pairs.append((a, edited(rng, a, rng.randrange(0, 5))))
    pairs += [("", ""), ("", "ab"), ("a", ""), ("a" * 300, "a" * 299 + "b")]
    for k in (1, 2, 3):
        for r in spark.createDataFrame(pairs, "a string, b string").withColumn("d", edit_distance(F.col("a"), F.col("b"), k)).collect():
            assert min(r.d, k + 1) == min(dp(r.a, r.b), k + 1), r


def brute(spark, rows, least, k, exact=None):
    """exact: equal lines of so many characters that aren't blank take part too."""
    key = {(r.doc_id, r.text): r.t for r in spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", F.xxhash64("text").alias("t")).distinct().collect()}
    hashed = {r.line: r.x for r in spark.createDataFrame([(x,) for r in rows for x in (r[1] or "").split("\n")], "line string").select("line", F.xxhash64("line").alias("x")).distinct().collect()}
    low = lambda i: (i is not None, i or 0)
    part = lambda line: len(line) >= least or (exact is not None and len(line) >= exact and line.strip())
    first, gone = {}, set()
    for d, t, *_ in rows:
        for p, line in enumerate((t or "").split("\n")):
            at = (low(d), key[d, t], p)
            if t is not None and part(line):
                first[line] = min(first.get(line, at), at)
    order = sorted((x for x in first if len(x) >= least), key=lambda x: (first[x][0], hashed[x]))
    for i, x in enumerate(order):
        if any(abs(len(x) - len(y)) <= k and dp(x, y) <= k for y in order[:i]):
            gone.add(x)
    out = []
    for d, t, *_ in rows:
        if t is None:
            out.append((str(d), None))
            continue
        keep = [line for p, line in enumerate(t.split("\n")) if not part(line) or (first[line] == (low(d), key[d, t], p) and line not in gone)]
        if len(keep) == len(t.split("\n")) or "".join(keep).strip():
            out.append((str(d), "\n".join(keep)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abc ") for _ in range(rng.choice([3, 11, 12, 20, 30]))) for _ in range(25)]
    rows = []
    for i in range(120):
        lines = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 6])) for _ in range(rng.randrange(1, 6))]
        rows.append((i, "\n".join(lines), "en", "x", 1))
    rows += [(500, None, None, None, None), (501, "", "en", "", 1), (502, "\n\n", "en", "", 1), (None, base[3] + base[4] + "\n" + base[5], "", "", 2)]
    rows += [rows[0], rows[0], (503, "z" * 40000 + "\nshort", "", "", 1), (504, "z" * 39999 + "\nshort", "", "", 1)]
    rows = [r for r in rows if r[0] not in (503, 504)]
    for k in (1, 2):
        got = dedup(spark.createDataFrame(rows, SCHEMA), min_chars=11, edits=k)
        assert got.columns == ["doc_id", "text", "lang", "line", "h"]
        assert sorted(((str(r.doc_id), r.text) for r in got.collect()), key=str) == brute(spark, rows, 11, k)
    got = dedup(spark.createDataFrame(rows, SCHEMA), min_chars=11, edits=2, exact_chars=1)
    assert sorted(((str(r.doc_id), r.text) for r in got.collect()), key=str) == brute(spark, rows, 11, 2, 1)


def test_long_lines_and_empty_table(spark):
    rows = [(1, "z" * 20000 + "\nshort", "", "", 1), (2, "z" * 19999 + "\nshort", "", "", 1), (3, "y" * 20000, "", "", 1)]
    assert sorted((r.doc_id, len(r.text)) for r in dedup(spark.createDataFrame(rows, SCHEMA)).collect()) == [(1, 20006), (2, 5), (3, 20000)]
    assert dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_drops_equal_short_lines(spark, tmp_path):
    rows = [(1, "MIT\n  \n\nfirst"), (2, "MIT\n  \n\nsecond\nMIT"), (3, "MIT"), (4, "MIT."), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_exact, r.n_near, r.kept_sha256) for r in op8_line_dedup(spark, str(tmp_path)).collect()}
    sha = lambda t: sha256(t.encode()).hexdigest()
    assert got == {1: (0, 0, sha(rows[0][1])), 2: (2, 0, sha("  \n\nsecond")), 3: (1, 0, sha("")), 4: (0, 0, sha("MIT.")), 5: (0, 0, None)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in dedup(df, exact_chars=1).collect()) == [1, 2, 4, 5] and dedup(df).count() == 5


def test_large_tables_meet_by_shuffle(spark, monkeypatch):
    rng = random.Random(21)
    base = ["".join(rng.choice("abc ") for _ in range(rng.choice([11, 20, 30]))) for _ in range(12)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 1, 2, 4])) for _ in range(rng.randrange(1, 5))), "en", "x", 1) for i in range(60)]
    from lectern.llm import common

    monkeypatch.setattr(common, "is_small", lambda df, rows=0: False)
    got = dedup(spark.createDataFrame(rows, SCHEMA), min_chars=11, edits=2)
    assert sorted(((str(r.doc_id), r.text) for r in got.collect()), key=str) == brute(spark, rows, 11, 2)


def test_clashing_names(spark):
    schema = "doc_id long, text string, id long, key string, exact int, near string, left string, _text string, h long"
    line = "x" * 45
    rows = [(1, f"{line}\nend", 5, "k", 6, "n", "l", "t", 7), (2, f"{line}\nend two", 5, "k", 6, "n", "l", "t", 7)]
    out = dedup(spark.createDataFrame(rows, schema))
    assert out.columns == [c.split()[0] for c in schema.split(", ")]
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [rows[0], (2, "end two", 5, "k", 6, "n", "l", "t", 7)]


def test_query_counts(spark, tmp_path):
    a, b = "a" * 50, "a" * 49 + "b"
    rows = [(1, f"{a}\nshort"), (2, f"{b}\n{a}\nshort"), (3, "own")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.kept_sha256) for r in op8_line_dedup(spark, str(tmp_path)).collect()}
    sha = lambda t: sha256(t.encode()).hexdigest()
    assert got == {1: (2, 0, 0, sha(rows[0][1])), 2: (3, 2, 1, sha("")), 3: (1, 0, 0, sha("own"))}


def test_exact_lines_without_similar_ones(spark, tmp_path, monkeypatch):
    """Counts of equal lines need none of the search for similar ones."""
    docs = [(1, "same\nown\n\nsame"), (2, "same\r\nother"), (3, None), (4, " \nsame"), (4, " \nsame"), (None, "own")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    whole = sorted(map(str, lines.op8_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_exact").collect()))
    monkeypatch.setattr(lines, "signed", None)
    assert sorted(map(str, lines.exact_lines(spark, str(tmp_path)).collect())) == whole
