"""Text scalars: Column -> Column. Lengths and positions count code points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of ECMAScript, spelled out because the regex engines differ. A class is asked part by
#: part for every character, so what most characters are (none, by these two ranges) is asked first.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_WS = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_INK = r"!-\x{009F}\x{00A1}-\x{167F}"
#: Texts end with \z in patterns, as $ matches before a last U+0085 too.
WS = f"[[^{_INK}]&&[{_WS}]]"
NOT_WS = f"[[{_INK}][^{_WS}]]"
WORD, NO_WORD_BEFORE, NO_WORD_AFTER = "[A-Za-z0-9_]", "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: A character's script is searched for, so it is asked only where it can be one of these.
CJK = r"[[^\x00-\x{2E7F}]&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]"
HAN, KANA = r"[[^\x00-\x{2E7F}]&&\p{IsHan}]", r"[[^\x00-\x{2E7F}]&&[\p{IsHiragana}\p{IsKatakana}]]"
LATIN = r"[A-Za-z[[^\x00-\x7F]&&\p{IsLatin}]]"
#: What the classifiers look for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
HEADER = rf"(?i){NO_WORD_BEFORE}(?:{MONTHS}){WS}+[0-9]{{1,2}},{WS}+[0-9]{{4}}{WS}+[0-9]{{1,2}}:[0-9]{{2}}{WS}+{NOT_WS}+{WS}+Sheet{WS}+number{WS}+[0-9]+{WS}+Page{WS}+number{WS}+[0-9]+{NO_WORD_AFTER}"
PAGE_NUMBER = rf"^[-–—]?{WS}*[0-9]{{1,4}}{WS}*[-–—]?\z"
SYMBOLS = r"[=+*/<>|_{}\[\]$%#@~^]"
TRADITIONAL = "[萬與專業東絲兩嚴個豐臨為麗舉麼義烏樂喬習鄉書買亂爭於雲亞產親億僅從儀們價眾優會傳傷倫體國語閱讀跡]"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends. Single blanks are no match, so most texts have none."""
    return F.trim(F.regexp_replace(c, rf"{WS}{{2,}}|[[^{_INK}]&&[{_WS}]&&[^ ]]", " "))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def chars(c: Column, kind: str) -> Column:
    """Characters of one class: what is missing without them, so none is gathered."""
    return F.char_length(c) - left_of(c, kind)


def replace_ligatures(c: Column) -> Column:
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: Without any of these nothing is rewritten, but a header. Bytes are looked for, as a pattern that is tried at every
#: character takes many times longer; one look spares most texts the whole chain.
MARKS = ["  ", *[f" {p}" for p in ",.;:!?)]}"], *[f"{p} " for p in "-’'([{"], *LIGATURES, *SPACES.replace(" ", "")]
WIDE = [m for m in MARKS if not m.isascii()]


def let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def has_artifacts(c: Column) -> Column:
    """Whether normalize_artifacts() may change c; true for some texts that it doesn't change."""
    any_of = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(c, m))
    marked = any_of([m for m in MARKS if m.isascii()]) | ((F.octet_length(c) > F.char_length(c)) & any_of(WIDE))
    return marked | F.startswith(c, F.lit(" ")) | F.endswith(c, F.lit(" ")) | is_production_header(c)


def normalize_artifacts(c: Column) -> Column:
    """Ligatures, the first production header, hyphen breaks, apostrophes, blanks at punctuation and brackets."""
    edge = rf"(?:(?<={WORD}){NO_WORD_AFTER}|{NO_WORD_BEFORE}(?={WORD}))"
    steps = [
        (rf"(?s)^(.*?){HEADER}".replace("(?i)", "(?i:", 1) + ")", "$1 "),
        (rf"({LATIN}{{2,}})-{WS}+(?={LATIN}{{2,}}{edge})", "$1"),
        (rf"({LATIN}){WS}+([’']){WS}+({LATIN})", "$1$2$3"),
        (rf"({LATIN})([’']){WS}+({LATIN})", "$1$2$3"),
        (rf"{WS}+([,.;:!?])", "$1"),
        (rf"([(\[{{]){WS}+", "$1"),
        (rf"{WS}+([)\]}}])", "$1"),
        (rf"{WS}{{2,}}", " "),
    ]

    def rewritten(t):
        clean = replace_ligatures(t)
        for pattern, to in steps:
            clean = F.regexp_replace(clean, pattern, to)
        return F.when(has_artifacts(t), trim(clean)).otherwise(t)

    return let(c, rewritten)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column, computed once a row: filters and later columns use the value, not its expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def line_key(c: Column) -> Column:
    return F.lower(squeeze(F.regexp_replace(normalize_artifacts(c), "[0-9]+", "#")))


def is_page_number(c: Column) -> Column:
    return normalize_artifacts(c).rlike(PAGE_NUMBER)


def is_production_header(c: Column) -> Column:
    return F.contains(c, F.lit(":")) & c.rlike("(?i:sheet)") & c.rlike(HEADER)


def is_running_header(c: Column, repeated: Column | None = None, normalized: bool = False) -> Column:
    """repeated: whether the line's key is one of those that repeat, from a join. normalized: c is so already."""
    t = c if normalized else normalize_artifacts(c)
    caps = t.rlike(rf"^(?:[A-Z]{WS}++){{2,}}+[A-Z]\z") & (F.char_length(t) <= 42)
    return (t == "") | t.rlike(rf"^[!•·*{_WS}]+\z") | is_production_header(t) | t.rlike(PAGE_NUMBER) | caps | F.coalesce(repeated if repeated is not None else F.lit(False), F.lit(False))


def language_hint(c: Column) -> Column:
    cjk, latin = c.rlike(CJK), c.rlike(LATIN)
    return F.when(cjk & latin, "mixed").when(cjk, "cjk").when(latin, "latin").otherwise("unknown")


def classify_role(clean: Column, y: Column | None = None, page_height: Column | None = None) -> Column:
    """Role of text that is already normalized; y is the top of its box, from the top of the page."""
    n = F.char_length(clean)
    bottom = F.lit(False) if y is None or page_height is None else F.coalesce((page_height > 0) & (F.coalesce(y, F.lit(0.0)) / page_height > 0.78), F.lit(False))
    cites = rf"(?i){NO_WORD_BEFORE}(?:(?:doi|dataverse|replication sets?|appendix){NO_WORD_AFTER}|(?:https?://|www\.)(?={WORD}))"

    def by_share(c):
        letters, digits, symbols = c["letters"], c["digits"], c["symbols"]
        return (
            F.when((symbols >= 4) & (symbols * 20 > letters * 7), "formula")  # shares of 7 in 20 and 6 in 5, exact
            .when((letters == 0) & ((digits > 0) | (symbols > 0)), "table")
            .when(((digits + symbols) * 5 > letters * 6) & (n < 120), "table")
            .when((n <= 90) & (letters > 0) & (clean == F.upper(clean)), "heading")
            .otherwise("body")
        )

    # counted once a row: what stands in a generator is computed anew wherever it is named
    counts = F.struct(left_of(clean, r"\P{L}").alias("letters"), chars(clean, r"\p{N}").alias("digits"), chars(clean, SYMBOLS).alias("symbols"))
    return (
        F.when(clean == "", "unknown")
        .when(clean.rlike(rf"(?i)^(?:references|bibliography|works cited){NO_WORD_AFTER}"), "reference")
        .when(clean.rlike(cites), F.when(bottom | (n < 260), "footnote").otherwise("reference"))
        .when(clean.rlike(rf"^(?:[0-9]+|[*†‡§]){WS}+[A-Z]") & bottom & (n < 420), "footnote")
        .otherwise(let(counts, by_share))
    )


#: Reading priority by role.
PRIORITY = {"body": 1.0, "heading": 0.85, "footnote": 0.38, "reference": 0.3, "formula": 0.22, "table": 0.2}


def role_priority(role: Column) -> Column:
    out = F.when(role.isNull(), 0.45)
    for k, v in PRIORITY.items():
        out = out.when(role == k, v)
    return out.otherwise(0.45)


def quality_flags(clean: Column, role: Column) -> Column:
    marked = F.when(role.isin("table", "formula", "footnote", "reference"), F.concat(F.lit("role:"), role))
    biblio = clean.rlike(rf"(?i){NO_WORD_BEFORE}(?:doi|isbn|issn|dataverse|replication sets?){NO_WORD_AFTER}|https?://")
    flags = F.array(marked, F.when(clean.rlike(SYMBOLS), "symbol-heavy"), F.when(biblio, "bibliographic"), F.when(chars(clean, "[0-9]") > letters(clean), "number-heavy"))
    return F.array_compact(flags)


def has_wide(c: Column) -> Column:
    """Whether a text has any character from U+2E80 on, where CJK begins: others need no search for scripts."""
    return (F.octet_length(c) > F.char_length(c)) & c.rlike(r"[^\x00-\x{2E7F}]")


def ocr_language_set(c: Column, fallback: str = "chi_sim+eng+jpn") -> Column:
    def by_script(t):
        kana, han = chars(t, KANA), chars(t, HAN)
        by_count = lambda n: F.when((n["kana"] >= 6) & (n["kana"] * 25 >= n["han"]), "jpn+chi_sim+eng").when(t.rlike(TRADITIONAL), "chi_tra+eng").when(n["han"] >= 8, "chi_sim+eng")
        return let(F.struct(kana.alias("kana"), han.alias("han")), by_count)

    latin = c.rlike(rf"^(?:[^{LATIN}]*+{LATIN}){{24}}")  # stops at the 24th
    return F.coalesce(F.when(has_wide(c), let(c, by_script)), F.when(latin, "eng"), F.lit(fallback))


def ocr_language_set_for_label(c: Column) -> Column:
    return F.when(c.rlike(rf"{KANA}|(?iu:日本語|日语|日語|japanese)"), "jpn+chi_sim+eng").when(c.rlike(TRADITIONAL), "chi_tra+eng").when((chars(c, HAN) == 0) & (chars(c, LATIN) >= 12), "eng")


def point_preference(language_set: Column) -> Column:
    return F.when(language_set.rlike(r"(?:^|\+)(?:chi_sim|chi_tra|jpn)(?:\+|$)"), "lines").otherwise("words")


def tts_language(hint: Column, text: Column) -> Column:
    h, t = F.replace(F.lower(trim(F.coalesce(hint, F.lit("")))), F.lit("_"), F.lit("-")), F.coalesce(text, F.lit(""))
    return F.when(h.isin("ja", "ja-jp", "jpn", "japanese"), "ja").when(h.isin("zh", "zh-cn", "zh-hans", "cmn", "chinese"), "zh").when(t.rlike(KANA), "ja").when(t.rlike(HAN), "zh").otherwise("en")


def tts_voice(language: Column, requested: Column) -> Column:
    v = trim(F.coalesce(requested, F.lit("")))
    return F.when(language == "zh", "zf_xiaobei").when(language == "ja", "jf_alpha").when(v.rlike("^[ab][fm]_"), v).otherwise("af_heart")


#: A run of Latin words, as mixed speech is cut. Loops over groups are possessive throughout: the same matches, and no
#: recursion over long texts.
LATIN_RUN = r"[A-Za-z][A-Za-z0-9'’._/+:-]*+(?:[ \t]++[A-Za-z][A-Za-z0-9'’._/+:-]*+)*+"


def mixed_segments(text: Column, language: Column) -> Column:
    """Array of (text, language): Latin runs are English, what lies between keeps its language; blank parts are dropped."""
    t = F.coalesce(text, F.lit(""))
    parts = F.regexp_extract_all(t, F.lit(rf"{LATIN_RUN}|[^A-Za-z]++"), F.lit(0))  # both kinds in one pass; a run begins with a letter
    whole = F.array(F.struct(t.alias("text"), F.lit("en").alias("language")))
    kind = lambda p: F.when(p.rlike("^[A-Za-z]"), "en").otherwise(language)
    cut = F.transform(parts, lambda p: F.struct(p.alias("text"), kind(p).alias("language")))
    return F.filter(F.when(language == "en", whole).otherwise(cut), lambda s: s["text"].rlike(NOT_WS))


def worker_language(c: Column) -> Column:
    """Language of a multilingual worker; other names are errors."""
    h = F.replace(F.lower(trim(F.coalesce(c.cast("string"), F.lit("")))), F.lit("_"), F.lit("-"))
    return F.when(h.isin("zh", "zh-cn", "zh-hans", "cmn", "chinese"), "zh").when(h.isin("ja", "ja-jp", "jpn", "japanese"), "ja").otherwise(F.raise_error(F.concat(F.lit("unsupported language: "), h)).cast("string"))


def boundary_separator(previous: Column, current: Column) -> Column:
    """What joins two lines: nothing between Chinese or Japanese text (or its punctuation) and such text, else a blank."""
    return F.when(F.right(previous, F.lit(1)).rlike(rf"[{CJK}、。，！？；：」』》〉）】]") & F.left(current, F.lit(1)).rlike(CJK), "").otherwise(" ")


def normalize_point_line(c: Column) -> Column:
    def closed(t):
        joined = F.regexp_replace(t, rf"({CJK}){WS}+(?=[{CJK}、。，！？；：])", "$1")
        joined = F.regexp_replace(joined, rf"([、。，！？；：]){WS}+(?={CJK})", "$1")
        return F.when((F.octet_length(t) > F.char_length(t)) & t.rlike(CJK), joined).otherwise(t)

    return let(normalize_artifacts(c), closed)


def _fnv1a(texts: pd.Series) -> pd.Series:
    """The texts of a batch side by side, longest first, so that those that have an nth unit are the first ones."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2") for t in texts.fillna("")]
    size = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-size, kind="stable")
    at, flat = (np.cumsum(size) - size)[order], np.concatenate([*units, np.zeros(0, "<u2")]).astype(np.uint32)
    have = len(size) - np.searchsorted(np.sort(size), np.arange(size.max(initial=0)), "right")
    h = np.full(len(size), 0x811C9DC5, np.uint32)
    for i, n in enumerate(have.tolist()):
        h[:n] = (h[:n] ^ flat[at[:n] + i]) * np.uint32(16777619)
    out = np.empty(len(size), np.int64)
    out[order] = h
    return pd.Series(out, dtype="Int64", index=texts.index).mask(texts.isna())


def fnv1a(c: Column) -> Column:
    """FNV-1a of 32 bits over UTF-16 units, in base 36. Beyond the BMP a character is its two surrogates."""
    return F.lower(F.conv(F.pandas_udf(_fnv1a, "long")(c).cast("string"), 10, 36))


def document_fingerprint(name: Column, size: Column, modified: Column) -> Column:
    n = F.lower(trim(F.when(F.coalesce(name, F.lit("")) == "", "未命名 PDF").otherwise(name)))
    e = F.url_encode(n)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    whole = lambda c: F.greatest(F.lit(0), F.floor(F.coalesce(c.cast("double"), F.lit(0.0)) + 0.5)).cast("long")
    return F.concat_ws(":", F.lit("v1"), e, whole(size).cast("string"), whole(modified).cast("string"))


def document_id(fingerprint: Column) -> Column:
    return F.concat(F.lit("doc_"), fnv1a(F.coalesce(fingerprint, F.lit(""))))


def is_toc_line(c: Column) -> Column:
    t = trim(c)
    dotted = t.rlike(r"\.\.\.|……|···") & t.rlike(rf"(?iu)(?:\.{{3,}}|…{{2,}}|·{{3,}}){WS}*(?:[ivxlcdm]+|[0-9]{{1,4}}){WS}*\z")
    return t.rlike(r"(?iu)^(?:table of contents|contents|目录|目次)\z") | dotted | t.rlike(rf"(?iu)^(?:(?:chapter|part|section){NO_WORD_AFTER}|第[一二三四五六七八九十百0-9]+[章节部篇]).{{2,80}}{WS}{{2,}}(?:[ivxlcdm]+|[0-9]{{1,4}})\z")


def left_of(c: Column, others: str) -> Column:
    """Characters that are none of the others, which are rarer and so are the ones looked for."""
    return F.char_length(F.regexp_replace(c, rf"{others}+", ""))


def letters(c: Column) -> Column:
    return left_of(c, r"\P{L}")


def speakable(c: Column) -> Column:
    return left_of(c, r"[^\p{L}\p{N}]")


def visible(c: Column) -> Column:
    """Blanks, which most white space is, go without a pattern."""
    return let(F.replace(c, F.lit(" "), F.lit("")), lambda t: F.char_length(t) - count(t, WS))


def noise(c: Column) -> Column:
    return count(c, rf"[[\p{{C}}\x{{FFFD}}|¦¬^~`_=+*<>\\ÃÂ]&&[^{_WS}]]")


def is_table_line(c: Column, role: Column | None = None) -> Column:
    t = trim(c)
    n, digits = visible(t), chars(t, r"\p{N}")
    cells = F.filter(F.split(t, rf"\t+|{WS}{{2,}}|\|+"), lambda x: x != "")
    numeric = F.filter(cells, lambda x: (visible(x) > 0) & (chars(x, r"\p{N}") / visible(x) >= 0.5))
    pipes = F.filter(F.split(t, rf"{WS}*[|¦]{WS}*"), lambda x: visible(x) > 0)
    shape = ((n > 0) & (digits / n >= 0.5)) | ((F.size(cells) >= 3) & (F.size(numeric) >= 2)) | (F.size(pipes) >= 5) | ((letters(t) == 0) & (digits > 0))
    by_role = F.lit(False) if role is None else F.coalesce(role.isin("table", "formula"), F.lit(False))
    return by_role | F.when(t.rlike(r"[\p{N}|¦]"), F.coalesce(shape, F.lit(False))).otherwise(False)  # no table without any of these


def has_terminal_punctuation(c: Column) -> Column:
    return trim(c).rlike(r"""[.!?。！？]["'”’」』）)\]]*\z""")


def ends_sentence(c: Column) -> Column:
    return trim(c).rlike(r"""[.!?。！？；;]["”’』」）》)\]]?\z""")


def ends_chunk(c: Column) -> Column:
    """The flush rule's sentence end."""
    return c.rlike(r"""[.!?。！？；;]["”')\]]?\z""")


def looks_like_heading(c: Column) -> Column:
    t = trim(c)
    return (t != "") & (F.char_length(t) <= 100) & (letters(t) > 0) & ((t == F.upper(t)) | t.rlike(rf"(?iu)^(?:chapter|part|section){NO_WORD_AFTER}"))


def truncated(c: Column, limit: int) -> Column:
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("…"))).otherwise(c)


def phoneme_batches(phonemes: Column, vocabulary: list[str], most: int = 509) -> Column:
    """Runs of characters with at most `most` of the vocabulary each, others riding along; runs without any are dropped."""
    known = "".join(f"\\x{{{ord(v):x}}}" for v in vocabulary)
    runs = F.regexp_extract_all(phonemes, F.lit(f"(?:[^{known}]*+[{known}]){{1,{most}}}+[^{known}]*+"), F.lit(0))
    return F.transform(runs, trim)
