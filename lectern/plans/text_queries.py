"""Queries over lines of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reading as R
from ..functions import sentences as S
from ..functions import text as T
from ..operators import chunks as C
from ..sources import adapters as A
from .registry import CJK, GOLD, HEADER, NORMED, NWS, PAGE_NUMBER, SYM, TEXTS, WS, cnt, has, key, ligatures, norm, q, query, rep, squeeze, texts, trim

def line():
    return F.col("text")

BIBLIO = r"(?i)\b(?:doi|isbn|issn|dataverse|replication sets?)\b|https?://"
FREQ = {"letters": r"\p{L}", "speakable": r"[\p{L}\p{N}]", "visible": NWS}


def scalar(name, column, make, sql):
    """A query of one value for each line."""

    @query(name, f"{TEXTS} SELECT tid, {sql} AS {column} FROM texts")
    def run(spark, d):
        return texts(spark, d).select("tid", make().alias(column))


def normed(name, column, make, sql):
    """The same on normalized text."""

    @query(name, f"{NORMED} SELECT tid, {sql} AS {column} FROM normed")
    def run(spark, d):
        return texts(spark, d).select("tid", T.normalize_artifacts(line()).alias("c")).select("tid", make(F.col("c")).alias(column))


@query(
    "text_stats",
    f"""SELECT lang, CAST(sum(cjk) AS BIGINT) AS cjk_characters, CAST(sum(num) AS BIGINT) AS numeric_units, CAST(sum(eng) AS BIGINT) AS english_words, count(*) AS documents,
        sum(CASE WHEN cjk + eng = 0 THEN 0 WHEN cjk >= 20 AND eng >= 20 AND cjk / CAST(cjk + eng AS DOUBLE) >= 0.15 AND eng / CAST(cjk + eng AS DOUBLE) >= 0.15 THEN 0 WHEN cjk >= eng THEN 0 ELSE 1 END)::BIGINT AS english_mode
        FROM (SELECT lang, {cnt("coalesce(text, '')", CJK)} AS cjk, {cnt("coalesce(text, '')", r'\p{Nd}')} AS num, {cnt("coalesce(text, '')", r"\p{Latin}+(?:['’\-]\p{Latin}+)*")} AS eng FROM documents) GROUP BY lang""",
)
def text_stats(spark, d):
    s = A.documents(spark, d).select("lang", R.text_stats(line()).alias("s")).select("lang", "s.*")
    mode = R.metric_mode(F.col("cjkCharacters"), F.col("englishWords"))
    return s.groupBy("lang").agg(F.sum("cjkCharacters").alias("cjk_characters"), F.sum("numericUnits").alias("numeric_units"), F.sum("englishWords").alias("english_words"), F.count("*").alias("documents"), F.sum((mode == "english").cast("long")).alias("english_mode"))


@query(
    "metric_mode",
    f"""{TEXTS} SELECT tid, CASE WHEN cjk + eng = 0 THEN 'empty' WHEN cjk >= 20 AND eng >= 20 AND cjk / CAST(cjk + eng AS DOUBLE) >= 0.15 AND eng / CAST(cjk + eng AS DOUBLE) >= 0.15 THEN 'both' WHEN cjk >= eng THEN 'cjk' ELSE 'english' END AS mode
        FROM (SELECT tid, {cnt('text', CJK)} AS cjk, {cnt('text', r"\p{Latin}+(?:['’\-]\p{Latin}+)*")} AS eng FROM texts)""",
)
def metric_mode(spark, d):
    return texts(spark, d).select("tid", R.text_stats(line()).alias("s")).select("tid", R.metric_mode(F.col("s.cjkCharacters"), F.col("s.englishWords")).alias("mode"))


scalar("replace_ligatures", "clean", lambda: T.replace_ligatures(line()), ligatures("text"))
scalar("normalize_artifacts", "clean", lambda: T.normalize_artifacts(line()), norm("text"))
scalar("line_key", "key", lambda: T.line_key(line()), key("text"))
normed("page_number_flag", "flag", lambda c: c.rlike(T.PAGE_NUMBER), has("c", PAGE_NUMBER))
scalar("production_header_flag", "flag", lambda: T.is_production_header(line()), has("text", HEADER))
scalar("language_hint", "hint", lambda: T.language_hint(line()), f"CASE WHEN {has('text', CJK)} AND {has('text', r'\p{Latin}')} THEN 'mixed' WHEN {has('text', CJK)} THEN 'cjk' WHEN {has('text', r'\p{Latin}')} THEN 'latin' ELSE 'unknown' END")
RUNNING = f"(c = '' OR {has('c', '^[!•·*' + WS[1:-1] + ']+$')} OR {has('c', HEADER)} OR {has('c', PAGE_NUMBER)} OR ({has('c', f'^(?:[A-Z]{WS}+){{2,}}[A-Z]$')} AND length(c) <= 42))"
scalar("running_header_flag", "flag", lambda: T.is_running_header(line()), RUNNING.replace("(c ", "(" + norm("text") + " ").replace("(c,", "(" + norm("text") + ",").replace("length(c)", f"length({norm('text')})"))

L, D, Y = cnt("c", r"\p{L}"), cnt("c", r"\p{N}"), cnt("c", SYM)
ROLE = f"""CASE WHEN c = '' THEN 'unknown' WHEN {has('c', r'(?i)^(references|bibliography|works cited)\b')} THEN 'reference'
    WHEN {has('c', r'(?i)\b(?:doi|https?://|www\.|dataverse|replication sets?|appendix)\b')} THEN CASE WHEN length(c) < 260 THEN 'footnote' ELSE 'reference' END
    WHEN {Y} >= 4 AND {Y} > {L} * 0.35 THEN 'formula' WHEN {L} = 0 AND ({D} > 0 OR {Y} > 0) THEN 'table' WHEN {D} + {Y} > {L} * 1.2 AND length(c) < 120 THEN 'table'
    WHEN length(c) <= 90 AND {L} > 0 AND c = upper(c) AND NOT contains(c, 'ß') THEN 'heading' ELSE 'body' END"""
PRIORITY = "CASE role WHEN 'body' THEN 1.0::DOUBLE WHEN 'heading' THEN 0.85 WHEN 'footnote' THEN 0.38 WHEN 'reference' THEN 0.3 WHEN 'formula' THEN 0.22 WHEN 'table' THEN 0.2 ELSE 0.45 END"
normed("classify_role", "role", T.classify_role, ROLE)
FLAGS = f"concat_ws(',', CASE WHEN role IN ('table', 'formula', 'footnote', 'reference') THEN 'role:' || role END, CASE WHEN {has('c', SYM)} THEN 'symbol-heavy' END, CASE WHEN {has('c', BIBLIO)} THEN 'bibliographic' END, CASE WHEN {cnt('c', '[0-9]')} > {L} THEN 'number-heavy' END)"


@query("role_priority", f"{NORMED} SELECT role, {PRIORITY} AS priority, count(*) AS lines FROM (SELECT {ROLE} AS role FROM normed) GROUP BY role")
def role_priority(spark, d):
    r = texts(spark, d).select(T.classify_role(T.normalize_artifacts(line())).alias("role"))
    return r.groupBy("role").agg(F.count("*").alias("lines")).select("role", T.role_priority(F.col("role")).alias("priority"), "lines")


@query("quality_flags", f"{NORMED} SELECT tid, {FLAGS} AS flags FROM (SELECT tid, c, {ROLE} AS role FROM normed)")
def quality_flags(spark, d):
    n = texts(spark, d).select("tid", T.normalize_artifacts(line()).alias("c")).withColumn("role", T.classify_role(F.col("c")))
    return n.select("tid", F.array_join(T.quality_flags(F.col("c"), F.col("role")), ",").alias("flags"))


HAN, LAT, KANA = cnt("text", r"\p{Han}"), cnt("text", r"\p{Latin}"), cnt("text", r"[\p{Hiragana}\p{Katakana}]")
scalar("ocr_language_set", "language_set", lambda: T.ocr_language_set(line()), f"CASE WHEN {KANA} >= 6 AND {KANA} >= {HAN} * 0.04 THEN 'jpn+chi_sim+eng' WHEN {has('text', T.TRADITIONAL)} THEN 'chi_tra+eng' WHEN {HAN} >= 8 THEN 'chi_sim+eng' WHEN {LAT} >= 24 THEN 'eng' ELSE 'chi_sim+eng+jpn' END")
scalar("ocr_label_language_set", "language_set", lambda: T.ocr_language_set_for_label(line()), f"CASE WHEN {has('text', r'[\p{Hiragana}\p{Katakana}]')} OR {has('text', '(?i)(?:日本語|日语|日語|japanese)')} THEN 'jpn+chi_sim+eng' WHEN {has('text', T.TRADITIONAL)} THEN 'chi_tra+eng' WHEN {HAN} = 0 AND {LAT} >= 12 THEN 'eng' END")
scalar("point_preference", "preference", lambda: T.point_preference(T.ocr_language_set(line())), f"CASE WHEN {KANA} >= 6 AND {KANA} >= {HAN} * 0.04 OR {has('text', T.TRADITIONAL)} OR {HAN} >= 8 OR {LAT} < 24 THEN 'lines' ELSE 'words' END")
scalar("tts_language", "language", lambda: T.tts_language(F.lit(None).cast("string"), line()), f"CASE WHEN {has('text', r'[\p{Hiragana}\p{Katakana}]')} THEN 'ja' WHEN {has('text', r'\p{Han}')} THEN 'zh' ELSE 'en' END")
scalar("tts_voice", "voice", lambda: T.tts_voice(T.tts_language(F.lit(None).cast("string"), line()), F.lit(" bf_emma ")), f"CASE WHEN {has('text', r'[\p{Hiragana}\p{Katakana}]')} THEN 'jf_alpha' WHEN {has('text', r'\p{Han}')} THEN 'zf_xiaobei' ELSE 'bf_emma' END")
scalar("normalize_speech", "clean", lambda: T.squeeze(line()), squeeze("text"))
TERMINAL, ENDS = r"""[.!?。！？]["'”’」』）)\]]*$""", r"""[.!?。！？；;]["”’』」）》)\]]?$"""
scalar("terminal_punctuation", "flag", lambda: T.has_terminal_punctuation(line()), has(trim("text"), TERMINAL))
scalar("ends_sentence", "flag", lambda: T.ends_sentence(line()), has(trim("text"), ENDS))
HEADING = f"""(length({trim('text')}) BETWEEN 1 AND 100 AND {cnt('text', r'\p{L}')} > 0 AND (({trim('text')} = upper({trim('text')}) AND NOT contains(text, 'ß')) OR {has(trim('text'), r'(?i)^(?:chapter|part|section)\b')}))"""
scalar("looks_like_heading", "flag", lambda: T.looks_like_heading(line()), HEADING)
TOC = f"""({has(trim('text'), r'(?i)^(?:table of contents|contents|目录|目次)$')} OR {has(trim('text'), rf'(?i)(?:\.{{3,}}|…{{2,}}|·{{3,}}){WS}*(?:[ivxlcdm]+|[0-9]{{1,4}}){WS}*$')} OR {has(trim('text'), rf'(?i)^(?:(?:chapter|part|section)\b|第[一二三四五六七八九十百0-9]+[章节部篇]).{{2,80}}{WS}{{2,}}(?:[ivxlcdm]+|[0-9]{{1,4}})$')})"""
scalar("toc_lines", "flag", lambda: T.is_toc_line(line()), TOC)
CELLS = f"list_filter(regexp_split_to_array({trim('text')}, {q(rf'\t+|{WS}{{2,}}|\|+')}), lambda x: x <> '')"
PIPES = f"list_filter(regexp_split_to_array({trim('text')}, {q(rf'{WS}*[|¦]{WS}*')}), lambda x: {cnt('x', NWS)} > 0)"
TABLE = f"""({trim('text')} <> '' AND ({cnt('text', r'\p{N}')} / CAST({cnt('text', NWS)} AS DOUBLE) >= 0.5 OR (len({CELLS}) >= 3 AND len(list_filter({CELLS}, lambda x: {cnt('x', r'\p{N}')} / CAST(greatest(1, {cnt('x', NWS)}) AS DOUBLE) >= 0.5)) >= 2)
    OR len({PIPES}) >= 5 OR ({cnt('text', r'\p{L}')} = 0 AND {cnt('text', r'\p{N}')} > 0)))"""
scalar("table_lines", "flag", lambda: T.is_table_line(line()), TABLE)
NOISE = r"[\p{C}\x{FFFD}|¦¬^~`_=+*<>\\ÃÂ]"


@query("char_class_counts", f"{TEXTS} SELECT tid, {', '.join(f'{cnt('text', p)} AS {k}' for k, p in FREQ.items())}, {cnt(rep('text', WS, ''), NOISE)} AS noise FROM texts")
def char_class_counts(spark, d):
    return texts(spark, d).select("tid", T.letters(line()).cast("long").alias("letters"), T.speakable(line()).cast("long").alias("speakable"), T.visible(line()).cast("long").alias("visible"), T.noise(line()).cast("long").alias("noise"))


@query("repeated_lines", f"{NORMED}, k AS (SELECT split_part(tid, ':', 1) AS doc, {key('text')} AS key FROM texts WHERE tid NOT LIKE 'g:%') SELECT key, count(DISTINCT doc) AS pages FROM k WHERE key <> '' AND length(key) <= 80 AND NOT {has('key', PAGE_NUMBER)} GROUP BY key HAVING count(DISTINCT doc) >= 2")
def repeated_lines(spark, d):
    return C.repeated_lines(A.document_segments(A.documents(spark, d)), "documentId")


@query("lines_without_repeats", f"{TEXTS}, k AS (SELECT tid, split_part(tid, ':', 1) AS doc, {key('text')} AS key FROM texts WHERE tid NOT LIKE 'g:%' AND {trim('text')} <> ''), r AS (SELECT key FROM k WHERE key <> '' AND length(key) <= 80 AND NOT {has('key', PAGE_NUMBER)} GROUP BY key HAVING count(DISTINCT doc) >= 2) SELECT doc, count(*) AS lines FROM k WHERE key NOT IN (SELECT key FROM r) GROUP BY doc")
def lines_without_repeats(spark, d):
    return C.lines_left(A.document_segments(A.documents(spark, d)), "documentId").select(F.col("documentId").alias("doc"), "lines")


LATIN_RUN = r"[A-Za-z][A-Za-z0-9'’._/+:-]*(?:[ \t]+[A-Za-z][A-Za-z0-9'’._/+:-]*)*"


@query("mixed_segments", f"{TEXTS}, p AS (SELECT tid, regexp_extract_all(text, {q(LATIN_RUN)}) AS m, regexp_split_to_array(text, {q(LATIN_RUN)}) AS g FROM texts) SELECT tid, array_to_string(list_filter(flatten(list_transform(range(1, len(g) + 1), lambda i: ['zh:' || g[i], 'en:' || coalesce(m[i], '')])), lambda x: {has('substr(x, 4)', NWS)}), chr(1)) AS parts FROM p")
def mixed_segments(spark, d):
    m = texts(spark, d).select("tid", T.mixed_segments(line(), F.lit("zh")).alias("m"))
    return m.select("tid", F.array_join(F.transform("m", lambda s: F.concat_ws(":", s["language"], s["text"])), "\x01").alias("parts"))


@query("point_lines", f"{NORMED} SELECT tid, {rep(rep(rep('c', rf'({CJK}){WS}+({CJK}|[、。，！？；：])', r'\1\2'), rf'({CJK}){WS}+({CJK}|[、。，！？；：])', r'\1\2'), rf'([、。，！？；：]){WS}+({CJK})', r'\1\2')} AS clean FROM normed")
def point_lines(spark, d):
    return texts(spark, d).select("tid", T.normalize_point_line(line()).alias("clean"))


SEPARATOR = f"CASE WHEN {has('right(x, 1)', r'[\p{Han}\p{Hiragana}\p{Katakana}、。，！？；：」』》〉）】]')} AND {has('left(y, 1)', CJK)} THEN '' ELSE ' ' END"


@query("boundary_separator", f"{TEXTS}, p AS (SELECT doc_id || ':' || (n - 1) AS a, doc_id || ':' || n AS b, lag(text) OVER (PARTITION BY doc_id ORDER BY n) AS x, text AS y FROM lines UNION ALL SELECT a.tid, b.tid, a.text, b.text FROM texts a JOIN texts b ON a.tid LIKE 'g:%' AND b.tid LIKE 'g:%') SELECT a, b, {SEPARATOR} AS sep FROM p WHERE x IS NOT NULL")
def boundary_separator(spark, d):
    """Between every line of a document and the next, and between any two of the golden texts (a few dozen)."""
    rows = A.documents(spark, d).select("doc_id", F.split("text", "\n", -1).alias("t")).select("doc_id", F.posexplode(F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("x"), F.slice("t", 2, F.size("t")).alias("y"))).alias("n", "p"))
    tid = lambda n: F.concat_ws(":", F.col("doc_id").cast("string"), n.cast("string"))
    p = rows.select(tid(F.col("n")).alias("a"), tid(F.col("n") + 1).alias("b"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    gold = spark.createDataFrame([(f"g:{i}", f"g:{j}", x, y) for i, x in enumerate(GOLD) for j, y in enumerate(GOLD)], "a string, b string, x string, y string")
    return p.unionByName(gold).select("a", "b", T.boundary_separator(F.col("x"), F.col("y")).alias("sep"))


@query("toc_and_table_share", f"{TEXTS} SELECT split_part(tid, ':', 1) AS doc, round(avg(CASE WHEN {TOC} THEN 1.0 ELSE 0.0 END), 6) AS toc, round(avg(CASE WHEN {TABLE} THEN 1.0 ELSE 0.0 END), 6) AS tab FROM texts GROUP BY 1")
def toc_and_table_share(spark, d):
    x = texts(spark, d).select(F.split("tid", ":")[0].alias("doc"), T.is_toc_line(line()).cast("double").alias("a"), T.is_table_line(line()).cast("double").alias("b"))
    return x.groupBy("doc").agg(F.round(F.avg("a"), 6).alias("toc"), F.round(F.avg("b"), 6).alias("tab"))


@query("speech_seconds", f"""{TEXTS}, n AS (SELECT tid, {squeeze('text')} AS s FROM texts) SELECT tid, round(CASE WHEN c + w > 0 THEN (c / 300.0::DOUBLE + w / 165.0::DOUBLE) * 60 ELSE u / 5.0::DOUBLE END, 6) AS seconds FROM (SELECT tid, {cnt('s', CJK)} AS c, {cnt('s', r"\p{Latin}+(?:[’'-]\p{Latin}+)*")} + {cnt('s', r'\p{N}+(?:[.,]\p{N}+)*')} AS w, {cnt('s', r'[\p{L}\p{N}]')} AS u FROM n)""")
def speech_seconds(spark, d):
    return texts(spark, d).select("tid", F.round(R.speech_seconds(line()), 6).alias("seconds"))


@query("preview", f"{TEXTS} SELECT tid, CASE WHEN length(text) > 160 THEN left(text, 157) || '…' ELSE text END AS preview FROM texts")
def preview(spark, d):
    return texts(spark, d).select("tid", T.truncated(line(), 160).alias("preview"))


@query("plain_text", f"WITH l AS (SELECT doc_id, i, {trim('ls[i]')} AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL) d, unnest(range(1, len(ls) + 1)) AS u(i)) SELECT CAST(doc_id AS VARCHAR) AS document, CAST((i - 1) // 40 AS INTEGER) AS page, string_agg(x, ' ' ORDER BY i) AS text FROM l WHERE x <> '' GROUP BY 1, 2")
def plain_text(spark, d):
    return A.plain_text(A.document_segments(A.documents(spark, d))).select(F.col("documentId").alias("document"), F.col("pageIndex").alias("page"), "text")


# Sentences are a character-level machine: rows only, tested against golden cases.
@query("sentence_ranges")
def sentence_ranges(spark, d):
    return texts(spark, d).select("tid", F.posexplode(S.sentence_ranges(line())).alias("ordinal", "r")).select("tid", "ordinal", "r.*")


@query("first_sentence")
def first_sentence(spark, d):
    return texts(spark, d).select("tid", S.first_sentence(line()).alias("sentence"))


@query("split_sentences", f"{TEXTS} SELECT tid, {rep('text', WS, '')} AS joined FROM texts WHERE {trim('text')} <> ''")
def split_sentences(spark, d):
    """The sentences of a line, put together again without blanks: the line, or text was lost."""
    j = texts(spark, d).where(T.trim(line()) != "").select("tid", F.array_join(S.sentences(line()), "").alias("s"))
    return j.select("tid", F.regexp_replace("s", T.WS, "").alias("joined"))


def _without_brackets(x):
    """Innermost pairs go first; texts here nest no deeper than this."""
    for _ in range(4):
        x = rep(rep(x, r"\([^()（）]*\)", ""), r"（[^()（）]*）", "")
    return squeeze(x)


@query("strip_parentheses", f"{TEXTS} SELECT tid, {_without_brackets(squeeze('text'))} AS plain FROM texts")
def strip_parentheses(spark, d):
    return texts(spark, d).select("tid", S.strip_balanced(line()).alias("plain"))


@query("phoneme_batches", f"{TEXTS} SELECT tid, CAST(unnest(range(0, len(b))) AS INTEGER) AS batch, unnest(b) AS phonemes FROM (SELECT tid, list_transform(regexp_extract_all(text, '(?:[^a-z]*[a-z]){{1,60}}[^a-z]*'), lambda x: {trim('x')}) AS b FROM texts)")
def phoneme_batches(spark, d):
    return texts(spark, d).select("tid", F.posexplode(T.phoneme_batches(line(), list("abcdefghijklmnopqrstuvwxyz"), 60)).alias("batch", "phonemes"))


FINGERPRINT = "'v1:b%C3%BCch%20' || doc_id || '!.pdf:' || n_chars || ':' || (doc_id * 1000)"
FNV = "list_reduce([CAST(2166136261 AS BIGINT)] || list_transform(range(1, length(f) + 1), lambda i: CAST(unicode(f[i]) AS BIGINT)), lambda h, u: (xor(h, u) * 16777619) % 4294967296)"


@query("document_ids", f"SELECT doc_id, f AS fingerprint, 'doc_' || ltrim(array_to_string(list_transform(range(6, -1, -1), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // CAST(pow(36, i) AS BIGINT)) % 36 AS BIGINT) + 1, 1)), ''), '0') AS id FROM (SELECT doc_id, f, {FNV} AS h FROM (SELECT doc_id, {FINGERPRINT} AS f FROM documents))")
def document_ids(spark, d):
    x = A.documents(spark, d).select("doc_id", T.document_fingerprint(F.concat(F.lit("Büch "), F.col("doc_id").cast("string"), F.lit("!.pdf")), F.col("n_chars"), F.col("doc_id") * 1000).alias("fingerprint"))
    return x.withColumn("id", T.document_id(F.col("fingerprint")))
