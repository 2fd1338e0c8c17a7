import random
from hashlib import sha256

import numpy as np
import pytest

from lectern.llm import infill

PARTS = ["a", "é", "日本", "😀", "<", "<P", "<P>", "<<S>", "P>", "<M", ">", " ", "\n", "́", "x" * 300, "ß" * 200, "<S", "\x00"]


def brute(doc_id, text):
    text = text or ""
    n, h = len(text), sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    c, e = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in infill.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:c], text[c:e], text[e:]
    if h4 % 100 < 20:
        return n, "spm", c, e - c, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", c, e - c, f"<P>{pre}<S>{suf}<M>{mid}"


def some(seed, k, marks=True):
    rng = random.Random(seed)
    parts = PARTS if marks else [p for p in PARTS if p not in ("<P>", "<<S>", "<M", "P>", ">")]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(k)]


def test_equals_brute_force(spark):
    texts = some(1, 300) + some(2, 900, False) + [None, "", "é" * 400_000, "a" * 255 + "é", "a" * 256, "<" * 1000]
    rows = [(i if i % 97 else None, t, "x", "own") for i, t in enumerate(texts)] + [(5, texts[5], "x", "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, draw0 string, form string").repartition(3)
    got = infill.fill_in_middle(df)
    assert got.columns == ["doc_id", "text", "draw0", *infill.RESULTS]
    got = got.withColumn("back", infill.restored(got.output, got.form)).collect()
    assert len(got) == len(rows)
    seen = set()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.draw0 == "x"
        seen.add(r.form)
    assert seen == {"plain", "psm", "spm"}


def test_empty_table_and_other_sentinels(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert infill.fill_in_middle(df).collect() == []
    marks = ("<|pre|>", "<|suf|>", "«mid»")
    texts = ["x<|pre|>", "<<|suf|>", "«mid", "«mid»", "<|pre|<|pre|", "«mi«mid»" * 80, "<|suf|", "<" * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = infill.fill_in_middle(df, marks, plain=0)
    for r in out.withColumn("back", infill.restored(out.output, out.form, marks)).collect():
        assert (r.form == "plain") == any(s in r.text for s in marks) and r.back == r.text
    with pytest.raises(ValueError):
        infill.fill_in_middle(df, ("aab", "aac", "b.a"))


def test_scan_across_lanes():
    texts = [t.encode() for t in some(3, 200)] + [b"", b"ab" * 5000, ("é<" * 4000).encode(), b"x" * 254 + b"<P>", b"x" * 255 + b"<P>", b"\x80\x80\xff<P>\xe9a"]
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    scan = infill.Scan(infill.Automaton((b"<P>", b"<S>", b"<M>")), np.frombuffer(b"".join(texts), np.uint8), off)
    for i, t in enumerate(texts[:-1]):
        chars = t.decode()
        assert scan.n[i] == len(chars) and scan.marked[i] == any(s in chars for s in infill.SENTINELS)
        cuts = np.arange(0, len(chars) + 1, max(1, len(chars) // 50))
        want = [len(chars[:c].encode()) for c in cuts.tolist()]
        assert (scan.locate(np.full(len(cuts), i), cuts) - off[i]).tolist() == want
    assert scan.n[-1] == 8 and scan.marked[-1]
