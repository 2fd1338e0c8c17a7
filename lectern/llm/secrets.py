"""Operator 5: secret scan with corpus-wide ownership frequency, with DataFrame functions only.

Candidates are the base patterns and long mixed tokens (upper case, lower case and digits, TOKEN or more characters).
Their hashes are aggregated by distinct owners (source): a value seen with COPIED_OWNERS owners is a widely copied
example, any other is live-looking, in however many repositories (doc_id) its owners hold it. The method's own spans are
the live-looking tokens that touch no base span; base spans stay, and are counted as live or example. Copies of one
document by one owner still count as live.

Hashes are aggregated with partial sums. Live ones held by HOT_REPOS repositories or more may be hot keys: their
verdicts are broadcast, as there is at most one for so many documents; all others have few occurrences, so the join
that shuffles them has no hot key.

Null is an empty text: no spans. A null source is one owner, a null doc_id one repository. Repeated rows are one
repository and get the same spans. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, spans

COPIED_OWNERS, TOKEN = 3, 20
#: From so many repositories on, the verdict of a value is broadcast in any case.
HOT_REPOS = 1000
#: Fixed patterns, as stated; hex and access keys with their least lengths, which leave the same matches.
KINDS = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+""", "body rlike '[:=]'"),
    ("access", r"AKIA[A-Z0-9]{16,}", "contains(body, 'AKIA')"),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", "true"),
    ("token", rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{TOKEN},}}", "true"),
]
#: The value of an assignment: what follows the keyword, separators and quotes.
VALUE = r"""^[A-Za-z_]+["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)$"""
VALID = {
    "assign": f"length(regexp_extract(s.value, {spans.lit(VALUE)}, 1)) >= 6",
    "access": "true",
    "hex": "true",
    "token": "s.value rlike '[A-Z]' AND s.value rlike '[a-z]' AND s.value rlike '[0-9]'",
}
HASHED = {"assign": f"regexp_extract(s.value, {spans.lit(VALUE)}, 1)"}
SPAN = "struct<start:int,k:int,end:int,kind:string,h:bigint>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, base (array of start, end, kind, live, owners by start, then kind) and extra (live tokens)."""
    df = docs.select("doc_id", "source", F.xxhash64("text").alias("tkey"), F.coalesce("text", F.lit("")).alias("body"))
    df = spans.find(df, "body", KINDS)
    own = [F.expr(f"transform(filter({k}, s -> {VALID[k]}), s -> named_struct('start', s.start, 'k', {i}, 'end', s.end, 'kind', '{k}', 'h', xxhash64({HASHED.get(k, 's.value')})))") for i, (k, _, _) in enumerate(KINDS)]
    found = df.select("doc_id", "source", "tkey", F.array_sort(F.concat(*own[:3])).alias("base"), own[3].alias("tokens"))
    found = common.cut(found.withColumn("tokens", F.expr("filter(tokens, t -> NOT exists(base, b -> b.start < t.end AND t.start < b.end))")))

    one = found.where("size(base) + size(tokens) > 0").select("doc_id", "source", "tkey", F.explode(F.concat("base", "tokens")).alias("s")).select("doc_id", "source", "tkey", "s.*")
    seen = one.select("h", "source", "doc_id").distinct()
    live = seen.groupBy("h").agg(F.count_distinct(F.struct("source")).alias("owners"), F.count_distinct(F.struct("doc_id")).alias("repos")).where(f"owners < {COPIED_OWNERS}")
    live = common.cut(live.select("h", "repos"))
    if common.is_small(live):
        held = one.join(F.broadcast(live.select("h")), "h")
    else:
        hot = F.broadcast(live.where(f"repos >= {HOT_REPOS}").select("h"))
        held = one.join(hot, "h").unionByName(one.join(hot, "h", "left_anti").join(live.where(f"repos < {HOT_REPOS}").select("h"), "h"))
    hits = held.groupBy(F.col("doc_id").alias("id"), F.col("tkey").alias("k_")).agg(F.collect_set("h").alias("hs"))
    hits = common.cut(hits)
    out = found.join(common.small(hits), found.doc_id.eqNullSafe(hits.id) & (found.tkey == hits.k_), "left").withColumn("hs", F.coalesce("hs", F.expr("cast(array() AS array<bigint>)")))
    return out.select("doc_id", "tkey", F.expr("transform(base, s -> named_struct('start', s.start, 'k', s.k, 'end', s.end, 'kind', s.kind, 'live', array_contains(hs, s.h)))").alias("base"), F.expr("transform(filter(tokens, s -> array_contains(hs, s.h)), s -> named_struct('start', s.start, 'k', s.k, 'end', s.end, 'kind', s.kind, 'live', true))").alias("extra"))


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    f = scan(common.table(spark, sf_dir, "documents"))
    n = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k, _, _ in KINDS[:3]]
    live = F.size(F.filter("base", lambda s: s["live"])).cast("long") + F.size("extra")
    return f.select("doc_id", *n, F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.array_sort(F.concat("base", "extra"))).alias("spans"), live.cast("long").alias("n_live"))
