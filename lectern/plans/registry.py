"""Queries by name, each with its DuckDB SQL where SQL can express it, and the relations that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Texts that the driver's tables lack (CJK, ligatures, hyphen breaks, headers, tables of contents).
GOLD = [
    "deﬁne and ﬂow", "  This is a sentence , with spacing .  ", "democ- racy and Goertz’ s concept.", "( a [ b { c } d ] e )", "March 3, 2021 10:15 AM Sheet number 12 Page number 7",
    "intro March 3, 2021 10:15 AM Sheet number 12 Page number 7 rest", "- 12 -", "—7—", "12345", "***", "C H A P T E R", "你好，世界！ 123", "日本語とカタカナ 2026", "A user's well-made guide, 1981–1992.",
    "References and notes", "see doi 10.1 and https://x.example/a", "12 Notes on this", "a = b + c * d / e ^ 2", "12 34 56", "1 | 2 | 3 | 4 | 5", "CHAPTER ONE", "Contents", "Chapter one  in the middle   17",
    "The end ........ 12", "目录", "第三章 开始的地方  12", "日本語 の テスト 、 です", "これはとても長い日本語の文章です", "這是專業的東西與書籍", "這裡有八個漢字以上的文章", "这是一个简单的中文句子。", "Plan A. Next sentence.",
    "Dr. Smith arrived. He left.", "未完の文", "noise ^^^ ~~~ ||| ÃÂ text", "a\tb\t12\t34", "x  12  13  y", "ab- cd- ef gh", "isbn 12345 and issn", "Part II", "ＡＢＣ fullwidth", "Straße und MASSE", "中文 mixed English 文本",
]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, text: every line of every document, and the texts above."""
    lines = A.documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    gold = spark.createDataFrame([(f"g:{i}", t) for i, t in enumerate(GOLD)], "tid string, text string")
    return lines.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("tid"), "text").unionByName(gold)


LINES = "lines AS (SELECT doc_id, u.i - 1 AS n, ls[u.i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL) d, unnest(range(1, len(ls) + 1)) AS u(i))"
TEXTS = f"WITH {LINES}, texts AS (SELECT doc_id || ':' || n AS tid, text FROM lines UNION ALL SELECT * FROM (VALUES {', '.join(f'({q(f'g:{i}')}, {q(t)})' for i, t in enumerate(GOLD))}) AS v(tid, text))"

WS = r"[\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NWS = WS.replace("[", "[^", 1)
CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}]"
SYM = r"[=+*/<>|_{}\[\]$%#@~^]"


def rep(x: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}{f', {q(flags)}' if flags else ''})"


def cnt(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def trim(x: str) -> str:
    return rep(x, f"^{WS}+|{WS}+$", "")


def squeeze(x: str) -> str:
    return f"trim({rep(x, f'{WS}+', ' ')})"


MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
HEADER = rf"(?i)\b(?:{MONTHS}){WS}+[0-9]{{1,2}},{WS}+[0-9]{{4}}{WS}+[0-9]{{1,2}}:[0-9]{{2}}{WS}+{NWS}+{WS}+Sheet{WS}+number{WS}+[0-9]+{WS}+Page{WS}+number{WS}+[0-9]+\b"
PAGE_NUMBER = rf"^[-–—]?{WS}*[0-9]{{1,4}}{WS}*[-–—]?$"


def ligatures(x: str) -> str:
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def norm(x: str) -> str:
    x = rep(ligatures(x), HEADER, " ", "")
    for _ in range(3):
        x = rep(x, rf"(\p{{Latin}}{{2,}})-{WS}+(\p{{Latin}}{{2,}})", r"\1\2")
    x = rep(x, rf"(\p{{Latin}}){WS}+([’']){WS}+(\p{{Latin}})", r"\1\2\3")
    x = rep(x, rf"(\p{{Latin}})([’']){WS}+(\p{{Latin}})", r"\1\2\3")
    x = rep(x, rf"{WS}+([,.;:!?])", r"\1")
    x = rep(x, rf"([(\[{{]){WS}+", r"\1")
    x = rep(x, rf"{WS}+([)\]}}])", r"\1")
    return trim(rep(x, rf"{WS}{{2,}}", " "))


def key(x: str) -> str:
    return f"lower({squeeze(rep(norm(x), '[0-9]+', '#'))})"


#: Lines with their normalized form as column c.
NORMED = TEXTS + f", normed AS MATERIALIZED (SELECT tid, text, {norm('text')} AS c FROM texts)"

#: Segments of the adapter: documentId, pageIndex, segmentIndex, text and box.
SEGMENTS = f"""WITH {LINES}, seg AS (SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS documentId, CAST(n // 40 AS INTEGER) AS pageIndex, CAST(n % 40 AS INTEGER) AS segmentIndex,
    {trim('text')} AS text, CAST(50 AS DOUBLE) AS x, CAST(40 + 14 * (n % 40) AS DOUBLE) AS y, CAST(least(512, 6 * length(text)) AS DOUBLE) AS w, CAST(12 AS DOUBLE) AS h FROM lines) WHERE text <> '')"""
