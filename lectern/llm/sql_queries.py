"""What SQL can say of the operators: for each, the columns of its query that DuckDB can make on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, lines, matroska, mixing, pii, secrets, token_counts

#: A-Z as a-z, other letters as they are.
LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(kind: str, pattern: str, valid: str, rank: int) -> str:
    """List of (start, rank, span) of the valid matches of a pattern in `body`; `valid` is a condition on v."""
    m, g = f"regexp_extract_all(body, {_q(pattern)})", f"regexp_split_to_array(body, {_q(pattern)})"
    size = lambda x, n: f"coalesce(list_sum(list_transform({x}[1 : {n}], lambda y: length(y))), 0)"
    found = f"list_transform(range(1, len(m) + 1), lambda i: {{'start': CAST({size('g', 'i')} + {size('m', 'i - 1')} AS BIGINT), 'v': m[i]}})"
    return f"(SELECT list_transform(list_filter({found}, lambda s: {valid.replace('v.', 's.v')}), lambda s: {{'start': s.start, 'rank': {rank}, 'span': '{kind}:' || s.start || ':' || (s.start + length(s.v))}}) FROM (SELECT {m} AS m, {g} AS g)) AS {kind}"


DIGITS = "regexp_replace(v., '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN (length({DIGITS}) - i) % 2 = 0 THEN CAST({DIGITS}[i] AS INTEGER) WHEN CAST({DIGITS}[i] AS INTEGER) > 4 THEN 2 * CAST({DIGITS}[i] AS INTEGER) - 9 ELSE 2 * CAST({DIGITS}[i] AS INTEGER) END)) % 10 = 0"
#: The patterns as stated: (kind, pattern, condition on the match v).
PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(v., '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS BIGINT), 0) <= 255))"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 8 AND 15"),
]
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
SECRETS = [
    ("assign", ASSIGN + r"[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(v., {_q('^' + ASSIGN + r'([A-Za-z0-9+/_.=-]+)$')}, 1)) >= 6"),
    ("access", r"AKIA[A-Z0-9]+", "length(v.) >= 20"),
    ("hex", r"[0-9a-f]+", "length(v.) >= 24"),
]


def _base(kinds: list[tuple[str, str, str]], order: str) -> str:
    """doc_id, the number of spans of each kind and the digest of all, in the order of the key."""
    cols = ", ".join(_spans(k, p, v, i) for i, (k, p, v) in enumerate(kinds))
    both = " || ".join(k for k, _, _ in kinds)
    joined = f"array_to_string(list_transform(list_sort(list_transform({both}, lambda s: {{'key': {order}, 'span': s.span}})), lambda s: s.span), ',')"
    return f"SELECT doc_id, {', '.join(f'CAST(len({k}) AS BIGINT) AS n_{k}' for k, _, _ in kinds)}, sha256({joined}) AS base_sha256 FROM (SELECT doc_id, {cols} FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents))"


QUERIES = {
    "pii_base_spans": lambda s, d: pii.op3_pii(s, d).drop("spans"),
    "secret_base_spans": lambda s, d: secrets.op5_secrets(s, d).drop("spans", "n_live"),
    "mix_targets": lambda s, d: mixing.op1_mixing(s, d).select("doc_id", "size", "source_size", F.round("target", 4).alias("target")),
    "chat_digests": lambda s, d: chat.op2_chat_formatting(s, d).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"),
    "shingle_counts": jaccard.shingle_counts,
    "benchmark_hits": lambda s, d: decontaminate.op6_benchmark_decontamination(s, d).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"),
    "exact_lines": lines.exact_lines,
    "media_payloads": lambda s, d: matroska.op9_matroska(s, d).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256"),
    "pretoken_counts": lambda s, d: token_counts.op10_token_counts(s, d).select("doc_id", "n_chars", "n_pretokens"),
}

SQL = {
    "pii_base_spans": _base(PII, "s.rank * 1000000000000 + s.start"),
    "secret_base_spans": _base(SECRETS, "s.start * 10 + s.rank"),
    # sources in code point order weigh 5, 2, 1; those that reach 3 times their size first (by size and weight) are full
    "mix_targets": f"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS size FROM documents), p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s GROUP BY source),
        w AS (SELECT *, [5, 2, 1][CAST(i % 3 AS INTEGER) + 1] AS weight, sum(source_size) OVER () AS total FROM p), t AS (SELECT *, total - 3 * coalesce(sum(source_size) OVER o, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS share FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, 3 * source_size * share <= rest * weight AS full_ FROM t), g AS (SELECT sum(CASE WHEN full_ THEN 0 ELSE weight END) AS free, max(total) - 3 * sum(CASE WHEN full_ THEN source_size ELSE 0 END) AS over_ FROM f)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(CASE WHEN full_ THEN 3.0::DOUBLE * source_size ELSE CAST(over_ AS DOUBLE) * weight / free END, 4) AS target FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source, g""",
    "chat_digests": """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256 FROM c GROUP BY conv_id""",
    "shingle_counts": f"""WITH w AS (SELECT doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '{SPACED}') AS w FROM documents)
        SELECT doc_id, CAST(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS BIGINT) AS n_shingles FROM w""",
    "benchmark_hits": f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
        ks AS (SELECT DISTINCT k FROM bw), dw AS (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS win, unnest(range(1, len(w) - k + 2)) AS at_ FROM d, ks WHERE len(w) >= k),
        m AS (SELECT dw.doc_id, dw.k, dw.at_, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win), h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(at_, at_ + k)) AS p FROM (SELECT DISTINCT doc_id, k, at_ FROM m)) GROUP BY doc_id),
        i AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "exact_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
        r AS (SELECT doc_id, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS n FROM l WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')), e AS (SELECT doc_id, count(*) FILTER (WHERE n > 1) AS n FROM r GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(e.n, 0) AS n_exact FROM documents d LEFT JOIN e USING (doc_id)""",
    "media_payloads": """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents), p AS (SELECT doc_id, octet_length(raw) AS n, raw, greatest(64, (octet_length(raw) + 63) // 64 * 64) AS size FROM b)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(size AS BIGINT) AS payload_bytes, sha256(raw || unhex(repeat('00', CAST(size - n AS INTEGER)))) AS payload_sha256 FROM p""",
    "pretoken_counts": f"SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS BIGINT) AS n_pretokens FROM documents",
}
