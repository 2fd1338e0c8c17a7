"""Operator 3: personal data and what discloses it, with DataFrame functions only.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers. Around each of them the nearest WORDS
terms on either side, in the whole text and however far away, are its context. Over the corpus, a term t reveals log2(n(t,e) * N / (n(t) * n(e))) bits of an
entity e, of the log2(N / n(e)) bits that e holds: n(t,e) and n(e) count different contexts, n(t) documents with t
anywhere, N documents. Terms that two or more contexts of e share and that reveal GENERALISE or more of e's bits are
marked in every document in which they stand by e (all their occurrences there), and generalised; from REMOVE on they are
removed. Copies of one context count once, so copied documents don't make their words look revealing; how common a term
is (n(t) of N) is counted over the documents as they are, since that is what a reader of the corpus meets.

Null is an empty text: no spans. Repeated rows get the same spans. Extra columns are ignored, sanitise() passes them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, spans

#: Fixed patterns. Possessive forms and look-behinds of the stated ones: the same matches, in linear time.
KINDS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(body, '@')"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "contains(body, '.')"),
    ("card", r"[0-9](?:[ -]?[0-9])++", "true"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "contains(body, '+')"),
]
VALID = {
    "email": "true",
    "ip": r"s.value rlike r'^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$'",
    "card": f"length({spans.digits('s.value')}) BETWEEN 16 AND 19 AND {spans.luhn(spans.digits('s.value'))}",
    "phone": f"length({spans.digits('s.value')}) BETWEEN 8 AND 15",
}
WORDS, GENERALISE, REMOVE, LEAST = 5, 0.5, 0.8, 2
TERM = r"\p{L}{4,}"


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tkey and an array of valid spans for each kind."""
    df = docs.select("doc_id", F.xxhash64("text").alias("tkey"), F.coalesce("text", F.lit("")).alias("body"))
    df = spans.find(df, "body", KINDS, (TERM, WORDS))
    return df.select("doc_id", "tkey", *[F.expr(f"filter({k}, s -> {VALID[k]})").alias(k) for k, _, _ in KINDS])


def contexts(base: DataFrame) -> DataFrame:
    """One row for each term near each entity: doc_id, tkey, entity, term, ctx (hash of the context)."""
    all_ = F.concat(*[F.expr(f"transform({k}, s -> named_struct('entity', concat('{k}:', lower(s.value)), 'near', concat(s.before, s.after)))") for k, _, _ in KINDS])
    e = base.select("doc_id", "tkey", F.explode(all_).alias("s")).select("doc_id", "tkey", "s.entity", "s.near")
    return e.select("doc_id", "tkey", "entity", F.explode(F.array_distinct("near")).alias("term"), F.xxhash64("near").alias("ctx"))


def disclosures(docs: DataFrame, near: DataFrame) -> DataFrame:
    """entity, term, share of the entity's information that the term reveals; pairs of LEAST contexts or more."""
    pairs = common.cut(near.select("entity", "term", "ctx").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(f"n_te >= {LEAST}"))
    n_e = near.select("entity", "ctx").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    # documents with t near some entity are fewer than all with t: pairs that reveal too little by them are out
    n_c = near.select("term", "doc_id", "tkey").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    pairs = pairs.join(n_e, "entity").withColumn("n", F.lit(docs.count()))
    pairs = common.cut(pairs.join(n_c, "term").where(share() >= GENERALISE).drop("n_t"))
    said = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    n_t = said.groupBy("term").agg(F.count("*").alias("n_t"))  # summed before the join, whatever the terms
    return n_t.join(common.small(pairs), "term").select("entity", "term", share().alias("share"))


def share() -> Column:
    """How much of an entity's information a term reveals, from n_te, n_t, n_e and n."""
    bits, held = F.log2(F.col("n_te") * F.col("n") / (F.col("n_t") * F.col("n_e"))), F.log2(F.col("n") / F.col("n_e"))
    return F.when(held > 0, F.least(bits / held, F.lit(1.0))).otherwise(0.0)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, base (array of kind, start, end by kind, then start) and terms (kind 'term', with the action)."""
    docs = docs.select("doc_id", "text")
    base = common.cut(base_spans(docs))
    near = common.cut(contexts(base))
    bad = common.cut(disclosures(docs, near).where(f"share >= {GENERALISE}"))
    marked = near.join(common.small(bad), ["entity", "term"]).groupBy("doc_id", "tkey").agg(F.collect_set("term").alias("words"), F.collect_set(F.when(F.col("share") >= REMOVE, F.col("term"))).alias("gone"))
    marked = common.cut(marked.select(F.col("doc_id").alias("id"), F.col("tkey").alias("k"), "words", "gone"))
    body = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    body = body.join(common.small(marked), body.doc_id.eqNullSafe(marked.id) & (body.tkey == marked.k)).dropDuplicates(["id", "k"])
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort("words"), "|"), F.lit(r")(?!\p{L})"))
    body = body.select("id", "k", "gone", "text", pattern.alias("p")).select("id", "k", "gone", F.expr("regexp_extract_all(text, p, 0)").alias("m"), F.expr("split(text, p, -1)").alias("g"))
    body = spans.places(body.where("size(m) > 0"), "m", "g", "at")
    found = F.expr("transform(m, (x, i) -> named_struct('kind', 'term', 'start', at[i], 'end', at[i] + length(x), 'action', CASE WHEN array_contains(gone, lower(x)) THEN 'remove' ELSE 'generalise' END))")
    extra = common.cut(body.select("id", "k", found.alias("terms")))
    kinds = F.concat(*[F.expr(f"transform({k}, s -> named_struct('kind', '{k}', 'start', s.start, 'end', s.end))") for k, _, _ in KINDS])
    out = base.select("doc_id", "tkey", kinds.alias("base")).join(common.small(extra), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tkey") == F.col("k")), "left")
    return out.select("doc_id", "tkey", "base", F.coalesce("terms", F.expr("cast(array() AS array<struct<kind:string,start:int,end:int,action:string>>)")).alias("terms"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with text sanitised: base spans and generalised terms become <KIND>, removed terms nothing. Where spans
    overlap, the first one counts."""
    f = find_pii(docs).dropDuplicates(["doc_id", "tkey"]).where("size(base) + size(terms) > 0")
    all_ = F.expr("array_sort(concat(transform(base, s -> named_struct('start', s.start, 'end', s.end, 'to', concat('<', upper(s.kind), '>'))), transform(terms, s -> named_struct('start', s.start, 'end', s.end, 'to', CASE s.action WHEN 'remove' THEN '' ELSE '<TERM>' END))))")
    i, k, spans_, new = (common.free(x, docs) for x in ("id", "tkey", "spans", "clean"))
    f = common.cut(f.select(F.col("doc_id").alias(i), F.col("tkey").alias(k), all_.alias(spans_)))
    clean = F.expr(f"""aggregate({spans_}, named_struct('at', 0, 'out', cast(array() AS array<string>)), (a, s) -> CASE WHEN s.start < a.at THEN a
        ELSE named_struct('at', s.end, 'out', concat(a.out, array(substr(text, a.at + 1, s.start - a.at), s.to))) END,
        a -> concat(array_join(a.out, ''), substr(text, a.at + 1)))""")
    out = docs.join(common.small(f), docs["doc_id"].eqNullSafe(f[i]) & (F.xxhash64(docs["text"]) == f[k]), "left")
    out = out.withColumn(new, F.when(F.col(spans_).isNull(), F.col("text")).otherwise(clean))
    return out.select(*[F.col(new).alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op3_pii(spark, sf_dir: str) -> DataFrame:
    f = find_pii(common.table(spark, sf_dir, "documents"))
    n = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k, _, _ in KINDS]
    plain = F.transform("terms", lambda s: F.struct(s["kind"], s["start"], s["end"]))
    return f.select("doc_id", *n, F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.concat("base", plain)).alias("spans"))
