"""Golden cases of the text, number and sentence functions."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import reading as R
from lectern.functions import sentences as S
from lectern.functions import text as T


def ask(spark, expr, *rows, schema="x string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(expr).collect()]


x = None


@pytest.fixture(autouse=True, scope="module")
def _column(spark):
    global x
    x = F.col("x")


def test_artifacts(spark):
    cases = {
        "deﬁne and ﬂow": "define and flow",
        "March 3, 2021 10:15 AM Sheet number 1 Page number 2 democ- racy and Goertz’ s concept.": "democracy and Goertz’s concept.",
        "march 3, 2021 10:15 x Sheet number 1 Page number 2 democ- racy": "democracy",
        "  This is a sentence , with spacing .  ": "This is a sentence, with spacing.",
        "( a [ b ] )": "(a [b])",
        "ab- éé": "ab- éé",
        "ab- cd- ef": "abcdef",
        "a- bc": "a- bc",
        "rock ’ n": "rock’n",
        "x  y 　z": "x y z",
    }
    assert ask(spark, T.normalize_artifacts(x), *cases) == list(cases.values())


def test_lines(spark):
    assert ask(spark, T.line_key(x), "Chapter 12  of 345") == ["chapter # of #"]
    assert ask(spark, T.is_page_number(x), "- 12 -", "12345", "— 7") == [True, False, True]
    assert ask(spark, T.is_running_header(x), "", "***", "C H A P T E R", "plain text") == [True, True, True, False]
    assert ask(spark, T.language_hint(x), "中文 text", "中文", "text", "123") == ["mixed", "cjk", "latin", "unknown"]
    assert ask(spark, T.is_toc_line(x), "Contents", "One ...... 12", "Chapter one in the   xii", "Contents of it", "第三章 开始的地方  12") == [True, True, True, False, True]
    assert ask(spark, T.is_table_line(x), "12 34 56", "1 | 2 | 3 | 4 | 5", "words only", "a\t12\t34", "") == [True, True, False, True, False]


def test_roles(spark):
    bottom = lambda text, y: ask(spark, T.classify_role(x, F.lit(float(y)), F.lit(800.0)), text)[0]
    assert bottom("References and more", 0) == "reference"
    assert bottom("see doi 10.1", 0) == "footnote" and bottom("appendix " + "word " * 80, 0) == "reference" and bottom("appendix " + "word " * 80, 700) == "footnote"
    assert bottom("12 Notes here", 700) == "footnote" and bottom("12 Notes here", 100) == "body"
    assert bottom("a = b + c * d / e", 0) == "formula" and bottom("12 34", 0) == "table" and bottom("CHAPTER ONE", 0) == "heading" and bottom("这是中文", 0) == "heading"
    assert ask(spark, F.array_join(T.quality_flags(x, F.lit("footnote")), ","), "isbn 1234 = xyz") == ["role:footnote,symbol-heavy,bibliographic"]


def test_shares_of_roles_are_exact(spark):
    # 63 symbols are 0.35 of 180 letters, which doubles put below: 180 * 0.35 = 62.99999999999999
    assert ask(spark, T.classify_role(x), "a" * 180 + "=" * 63, "a" * 180 + "=" * 64, "a" * 5 + "1" * 6, "a" * 5 + "1" * 7) == ["body", "formula", "body", "table"]
    assert ask(spark, T.ocr_language_set(x), "漢" * 175 + "か" * 7, "漢" * 176 + "か" * 7) == ["jpn+chi_sim+eng", "chi_sim+eng"]


def test_languages(spark):
    assert ask(spark, T.ocr_language_set(x), "これはとても長い日本語", "這是專業", "这是一个简单的中文句子", "plain English text of some length", "short") == ["jpn+chi_sim+eng", "chi_tra+eng", "chi_sim+eng", "eng", "chi_sim+eng+jpn"]
    assert ask(spark, T.ocr_language_set_for_label(x), "日语教材", "書", "English Grammar", "x") == ["jpn+chi_sim+eng", "chi_tra+eng", "eng", None]
    m = ask(spark, T.mixed_segments(x, F.lit("zh")), "你好 PDF reader，再见", "", "你好")
    assert [[(s["text"], s["language"]) for s in r] for r in m] == [[("你好 ", "zh"), ("PDF reader", "en"), ("，再见", "zh")], [], [("你好", "zh")]]
    assert ask(spark, T.normalize_point_line(x), "日本語 の テスト 、 です") == ["日本語のテスト、です"]
    with pytest.raises(Exception, match="unsupported"):
        ask(spark, T.worker_language(x), "klingon")


def test_hashes_and_ids(spark):
    assert ask(spark, T.fnv1a(x), "foobar", "", "a") == [_36(0xBF9CF968), _36(0x811C9DC5), _36(0xE40C292C)]
    f = T.document_fingerprint(x, F.lit(12.6), F.lit(3))
    assert ask(spark, f, " My Büch (1)!.PDF ", "") == ["v1:my%20b%C3%BCch%20(1)!.pdf:13:3", "v1:%E6%9C%AA%E5%91%BD%E5%90%8D%20pdf:13:3"]


def _36(n):
    d = "0123456789abcdefghijklmnopqrstuvwxyz"
    out = ""
    while n:
        n, r = divmod(n, 36)
        out = d[r] + out
    return out


def test_phonemes(spark):
    assert ask(spark, T.phoneme_batches(x, ["a", "b"], 2), "aa?bb", "??", "") == [["aa?", "bb"], [], []]


def test_sentences():
    texts = lambda t: [r[0] for r in S.ranges(t)]
    cases = {
        "Dr. Smith arrived. He left.": ["Dr. Smith arrived.", "He left."],
        "Pi is 3.14 today. Next": ["Pi is 3.14 today.", "Next"],
        "The U.S. economy grew. End.": ["The U.S. economy grew.", "End."],
        "See e.g. this one. Then": ["See e.g. this one.", "Then"],
        "J. K. Rowling wrote. Yes.": ["J. K. Rowling wrote.", "Yes."],
        "Plan A. Next sentence.": ["Plan A.", "Next sentence."],
        "Plan A. Then B.": ["Plan A.", "Then B."],
        "John F. Kennedy spoke. Ok.": ["John F. Kennedy spoke.", "Ok."],
        "你好。再见！": ["你好。", "再见！"],
        'He said "Go." Then he went.': ['He said "Go."', "Then he went."],
        "no end here": ["no end here"],
        "": [],
        " \n ": [],
    }
    for t, want in cases.items():
        assert texts(t) == want, t
    assert S.ranges("  Dr. Smith arrived.   下一句。 unfinished") == [("Dr. Smith arrived.", 2, 20, True), ("下一句。", 23, 27, True), ("unfinished", 28, 38, False)]
    assert [S.strip_parentheses(t) for t in ("a (b (c) d) e", "a (b", "x（y）z", "(a] b)", "a) b")] == ["a e", "a (b", "xz", "", "a) b"]


def test_rates(spark):
    n = "x double"
    assert ask(spark, R.units_per_minute(x, F.lit(1000.0), F.lit(20.0)), 300.0, 0.0, schema=n) == [360, 0]
    assert [tuple(r) for r in ask(spark, R.rate_range(x), 250.0, 0.0, schema=n)] == [(220, 280), (0, 0)]
    assert ask(spark, R.density_level(x), 0.6, 1.0, 1.5, None, 0.8, 1.2, schema=n) == ["sparse", "balanced", "dense", "unknown", "slightly-sparse", "slightly-dense"]
    assert [r and tuple(r) for r in ask(spark, R.flow_time(x, F.lit(10.0)), 3600.0, 0.0, schema=n)] == [(5, 7), None]
    modes = [(20, 80), (19, 81), (81, 19), (20, 120), (120, 20), (0, 0)]
    assert ask(spark, R.metric_mode(F.col("a"), F.col("b")), *modes, schema="a long, b long") == ["both", "english", "cjk", "english", "cjk", "empty"]
    s = ask(spark, R.text_stats(x), "你好，世界！ 123", "A user's well-made guide, 1981–1992.", "日本語とカタカナ 2026")
    assert [tuple(r) for r in s] == [(4, 3, 0), (0, 8, 4), (8, 4, 0)]
    assert ask(spark, R.speech_seconds(x), "字" * 30, " ".join(["word"] * 11)) == [6.0, 4.0]
    assert ask(spark, R.js_round(x), -2.5, 2.5, schema=n) == [-2, 3]
    steps = ask(spark, R.transition_steps(F.col("a"), F.col("b")), (1, 3), (3, 1), (2, 2), schema="a int, b int")
    assert [[(s.direction, s.fromIndex, s.toIndex, s.boundaryIndex) for s in r] for r in steps] == [[("up", 1, 2, 1), ("up", 2, 3, 2)], [("down", 3, 2, 2), ("down", 2, 1, 1)], []]


def test_plans(spark):
    text = "word " * 10 + "ends. " + "word " * 30
    for seconds, want in ((60.0, "full"), (6.0, "shortened"), (0.7, "skip"), (None, "fallback")):
        p = ask(spark, R.walk_plan(F.lit(text), S.first_sentence(F.lit(text.strip())), x, F.lit(1000)), (seconds,), schema="x double")[0]
        assert p.decision == want and 1.5 <= p.speed <= 2.5


def test_boxes(spark):
    b = F.struct(F.lit(60.0).alias("x"), F.lit(700.0).alias("y"), F.lit(300.0).alias("width"), F.lit(20.0).alias("height"))
    page = G.page_dimensions(F.lit(600), F.lit(800), F.lit("pdf"))
    top = G.to_top_left(b, page)
    r = ask(spark, F.struct(top["y"].alias("y"), G.relative(top, page)["y"].alias("r")), "x")[0]
    assert (r.y, r.r) == (80.0, 0.1)
    assert ask(spark, G.page_dimensions(F.lit(0), F.lit(5), F.lit("pdf")), "x") == [None]
    assert ask(spark, G.distance_to_box(F.lit(0.0), F.lit(0.0), F.struct(F.lit(3.0).alias("x"), F.lit(4.0).alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"))), "x") == [5.0]
    assert ask(spark, G.normalize_confidence(x), 55.0, 0.3, None, schema="x double") == [0.55, 0.3, 0.0]


def test_long_texts_need_no_recursion(spark):
    long = ["word " * 50_000, "A " * 50_000 + "B", "a-" * 50_000 + "b", "1." * 50_000 + "1"]
    for expr in (F.size(T.mixed_segments(x, F.lit("zh"))), T.is_running_header(x), R.text_stats(x)["englishWords"], R.speech_seconds(x)):
        assert len(ask(spark, expr, *long)) == 4


def test_artifacts_are_seen_by_their_bytes(spark):
    from lectern.functions import text as T

    plain, marked = ["plain text, well-made", "a\u0085b", ""], ["a ,b", "a- b", " a", "a ", "﻿a", "a　b", "ﬁne", "May 3, 2021 10:15 AM Sheet number 1 Page number 7"]
    assert ask(spark, T.has_artifacts(x), *plain, *marked) == [False] * len(plain) + [True] * len(marked)
    assert ask(spark, T.trim(x), "﻿　 a b \t ", "a \u0085") == ["a b", "a \u0085"]


def test_hash_of_texts_side_by_side(spark):
    def fnv(t):
        h, b = 0x811C9DC5, t.encode("utf-16-le")
        for i in range(0, len(b), 2):
            h = (h ^ int.from_bytes(b[i : i + 2], "little")) * 16777619 & 0xFFFFFFFF
        return _36(h)

    texts = ["foobar" * 99, None, "𠀀é", "b", "", "𠀀é" * 40]
    assert ask(spark, T.fnv1a(x), *[(t,) for t in texts]) == [None if t is None else fnv(t) for t in texts]


def test_ends_of_texts(spark):
    # U+0085 is no white space here, and no end of a text; a no-break space is white space
    assert ask(spark, T.is_running_header(x), "12\x85", "•\xa0•", "A B C\x85", "12") == [False, True, False, True]
    assert ask(spark, T.ends_chunk(x), "Done.\x85", "Done.") == [False, True] and ask(spark, T.has_terminal_punctuation(x), "Done.\x85") == [False]


def test_scripts_are_counted_once(spark):
    cases = {"a1" * 23: "chi_sim+eng+jpn", "é1" * 24: "eng", "a" * 24 + "か" * 6: "jpn+chi_sim+eng", "é" * 24 + "漢" * 8: "chi_sim+eng", "漢" * 7: "chi_sim+eng+jpn", "ü 與": "chi_tra+eng"}
    assert ask(spark, T.ocr_language_set(x), *cases) == list(cases.values())
    assert ask(spark, T.visible(x), " a\tb c　d ", "", "   ") == [4, 0, 0]


def test_mixed_segments_in_one_pass(spark):
    m = ask(spark, T.mixed_segments(x, F.lit("zh")), "1 été a-b's  c\td？ 2")[0]
    assert [(s["text"], s["language"]) for s in m] == [("1 é", "zh"), ("t", "en"), ("é ", "zh"), ("a-b's  c\td", "en"), ("？ 2", "zh")]
    r = T.mixed_segments(F.col("x"), F.lit("zh"))._jc.toString()
    assert r.count("regexp_extract_all") == 1 and "split" not in r  # nothing is cut anew for each part


def test_first_sentences_end_the_look(spark, monkeypatch):
    looks = []
    monkeypatch.setattr(S, "_abbreviates", lambda text, dot: looks.append(dot))
    assert S.first_of("One here. " * 1000) == "One here." and len(looks) == 1
    assert S.first_of(" \n") == S.first_of(None) == "" and S.first_of("no end") == "no end"
    assert ask(spark, S.first_sentence(x), "Dr. A came. He left.", "  ", None) == ["Dr. A came.", "", ""]


def test_counts_are_made_once(spark):
    assert str(R.speech_seconds(x)).count("regexp_replace") == 2  # blanks, and what can't be spoken where nothing else counts
    assert str(T.classify_role(x)).count(r"\P{L}") == str(T.classify_role(x)).count(r"\p{N}") == 1


def test_squeezed(spark):
    rows = {"a b": "a b", " a  b ": "a b", "a\tb": "a b", "a \n b": "a b", "a　b ": "a b", " ": "", "": "", "a\u0085b": "a\u0085b"}
    assert ask(spark, T.squeeze(x), *rows) == list(rows.values())
