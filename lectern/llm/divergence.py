"""Operator 11: source divergence audit: which sources of a language use its words differently, and which words.

A language keeps the V terms that LEAST or more of its documents hold. A group (language, source), and the language as a
whole, gives each kept term p = 1 + floor(SCALE * (count + 2) / (N + 2 V)); two such p, q differ by floor((p - q)^2 / (p + q)).
All arithmetic is on integers.

* Counts: each task sums what it reads and sends (language, source, term, count, documents) rows, summed on.
* Terms (upper-bound search): a group's terms are in buckets by their count there. The largest count of a bucket and the
  least probability that the language gives any of its terms bound the difference of all its terms. Buckets are opened
  in the order of their bounds, some more of them each round, until no closed bucket of the group has a bound that is as
  large as the k-th largest difference found: only then could one of its terms be among the first k. What the bounds rule
  out is never evaluated, and nothing of a group is gathered but its first k terms.
* Pairs (postings): terms that neither group has differ alike, those that one has by its count alone; a group's
  histogram of counts and the probability that the other group gives an absent term say how much, in closed form. Only
  terms that both have are met, in their postings, in blocks of BLOCK sources, to replace these values by the true one.

Nulls count as ''. Empty texts give a group without terms: it takes part in pairs with its absent terms. A language
without kept terms has pairs of value 0 and no terms. Equal values are ordered by item in UTF-8. Repeated rows are
documents of their own. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Documents that hold a kept term, at least; ranks of terms; the sum of all probabilities.
LEAST, RANKS, SCALE = 10, 10, 1_000_000_000
#: Counts below it have buckets of their own, larger ones STEPS buckets for each doubling.
PLAIN, STEPS = 32, 4
#: Sources of a block of postings.
BLOCK = 64
#: Distinct (group, term) that a task holds before it sends them on.
HELD = 200_000

_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
GROUP = ["lang", "source"]


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences), d (documents that hold it); term '' counts the documents of a group."""

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush():
            for (lang, source), (c, d) in held.items():
                n = len(d)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(d), pa.binary()), pa.array([c[t] for t in d], pa.int64()), pa.array(list(d.values()), pa.int64())], [*GROUP, "term", "c", "d"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c, d = held.setdefault((lang, source), (Counter(), Counter()))
                own = Counter()
                for piece in tokens.pieces((text or b"").translate(_LETTERS)):
                    own.update(piece.split())
                c.update(own)
                d.update(own.keys())
                d[b""] += 1
            if sum(len(d) for _, d in held.values()) > HELD:
                yield from flush()
        yield from flush()

    df = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP], F.col("text").cast("binary").alias("text"))
    rows = common.mapped(df, run, "lang string, source string, term binary, c long, d long")
    return rows.groupBy(*GROUP, F.col("term").cast("string").alias("term")).agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def probability(c: str, n: str, v: str) -> Column:
    """1 + floor(SCALE * (c + 2) / (n + 2 v)), exact beyond 64 bits."""
    return F.expr(f"1 + (cast({SCALE} AS decimal(10, 0)) * cast({c} + 2 AS decimal(20, 0))) div cast({n} + 2 * {v} AS decimal(20, 0))")


def difference(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def tables(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(groups, postings): groups has lang, source, no (its number in the language), n, v, absent (its probability of a term
    that it lacks), has (kept terms that it has); postings lang, source, term, c, p and q (the language's) of kept terms."""
    seen = common.keep(counted(docs))
    kept = seen.where("term <> ''").groupBy("lang", "term").agg(F.sum("c").alias("lc"), F.sum("d").alias("ld")).where(f"ld >= {least}").drop("ld")
    kept = common.keep(kept)
    langs = kept.groupBy("lang").agg(F.sum("lc").alias("ln"), F.count("*").alias("v"))
    held = common.keep(seen.where("term <> ''").drop("d").join(common.small(kept), ["lang", "term"]))
    sizes = held.groupBy(*GROUP).agg(F.sum("c").alias("n"), F.count("*").alias("has"))
    groups = seen.where("term = ''").select(*GROUP).join(sizes, GROUP, "left").join(langs, "lang", "left")
    groups = groups.select(*GROUP, *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in ("n", "has", "v", "ln")])
    groups = groups.withColumn("absent", F.when(F.col("v") > 0, probability("0", "n", "v")))
    groups = common.cut(groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    postings = held.join(common.small(groups.select(*GROUP, "n", "v", "ln")), GROUP)
    postings = common.keep(postings.select(*GROUP, "term", "c", probability("c", "n", "v").alias("p"), probability("lc", "ln", "v").alias("q")))
    for df in (seen, kept, held):
        common.drop(df)
    return groups, postings


def first_terms(postings: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, source, item, value, rank: the terms with p > q of largest difference in each group."""
    bucket = F.expr(f"CASE WHEN c < {PLAIN} THEN c ELSE {PLAIN} + cast(floor(log2(c) * {STEPS}) AS bigint) END")
    held = postings.withColumn("bucket", bucket)
    buckets = held.groupBy(*GROUP, "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count("*").alias("m")).where("p > q")
    buckets = common.cut(buckets.select(*GROUP, "bucket", "m", F.expr(difference("p", "q")).alias("bound")))
    order = Window.partitionBy(*GROUP)
    top = order.orderBy(F.desc("value"), "item")
    found, closed, some = None, buckets, ranks
    while True:
        if found is not None:  # what is as large as the k-th value can still come first by its item
            kth = found.groupBy(*GROUP).agg(F.min("value").alias("kth"), F.count("*").alias("had"))
            closed = closed.join(common.small(kth), GROUP, "left").where(f"had IS NULL OR had < {ranks} OR bound >= kth").drop("kth", "had")
        ahead = F.sum("m").over(order.orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1))
        closed = common.cut(closed.withColumn("open", F.coalesce(ahead, F.lit(0)) < some))
        opened = closed.where("open").select(*GROUP, "bucket")
        if opened.isEmpty():
            break
        new = held.join(common.small(opened), [*GROUP, "bucket"]).where("p > q").select(*GROUP, F.col("term").alias("item"), F.expr(difference("p", "q")).alias("value"))
        new = new if found is None else new.unionByName(found.drop("rank"))
        found = common.cut(new.withColumn("rank", F.row_number().over(top)).where(f"rank <= {ranks}"))
        closed, some = closed.where("NOT open").drop("open"), some * 8
    empty = postings.select(*GROUP, F.col("term").alias("item"), F.col("c").alias("value"), F.lit(1).alias("rank")).where("false")
    return empty if found is None else found


def pair_values(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: each other source of the language, by the sum of the differences of all terms."""
    own = postings.join(common.small(groups.select(*GROUP, "no", "absent")), GROUP)
    blocks = own.groupBy("lang", "term", F.expr(f"no div {BLOCK}").alias("blk")).agg(F.collect_list(F.struct("no", "p", "absent")).alias("held"))
    blocks = common.keep(blocks)
    x, y = blocks.select("lang", "term", F.col("blk").alias("i"), F.col("held").alias("xs")), blocks.select("lang", "term", F.col("blk").alias("j"), F.col("held").alias("ys"))
    # the second source of a pair has the larger number; pairs are made and summed in one stage
    met = x.join(y, ["lang", "term"]).where("i <= j").select("lang", F.explode("xs").alias("x"), "ys").select("lang", "x", F.explode("ys").alias("y")).where("x.no < y.no")
    both = f"{difference('x.p', 'y.p')} - {difference('x.p', 'y.absent')} - {difference('x.absent', 'y.p')} + {difference('x.absent', 'y.absent')}"
    met = met.groupBy("lang", F.col("x.no").alias("a"), F.col("y.no").alias("b")).agg(F.sum(F.expr(both)).alias("both"))
    # as if no term were shared: by the counts of the one and the absent terms of the other
    counts = own.groupBy("lang", "no", "p").agg(F.count("*").alias("m"))
    others = groups.where("v > 0").select("lang", F.col("no").alias("other"), F.col("absent").alias("z"))
    side = common.small(common.cut(others))
    alone = counts.join(side, "lang").where("no <> other").groupBy("lang", F.least("no", "other").alias("a"), F.greatest("no", "other").alias("b")).agg(F.sum(F.expr(f"m * ({difference('p', 'z')})")).alias("alone"))
    g = groups.select("lang", "source", "no", "has", "v", "absent")
    one, two = (g.select("lang", *[F.col(c).alias(f"{c}_{k}") for c in ("source", "no", "has", "v", "absent")]) for k in "ab")
    pairs = one.join(two, "lang").where("no_a < no_b").withColumnsRenamed({"no_a": "a", "no_b": "b"})
    pairs = pairs.join(met, ["lang", "a", "b"], "left").join(alone, ["lang", "a", "b"], "left")
    neither = f"(v_a - has_a - has_b) * ({difference('absent_a', 'absent_b')})"
    pairs = common.cut(pairs.select("lang", "source_a", "source_b", F.expr(f"CASE WHEN v_a = 0 THEN 0 ELSE coalesce(both, 0) + coalesce(alone, 0) + {neither} END").cast("long").alias("value")))
    common.drop(blocks)
    ends = [pairs.select("lang", F.col(f"source_{s}").alias("source"), F.col(f"source_{t}").alias("item"), "value") for s, t in ("ab", "ba")]
    rank = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return ends[0].unionByName(ends[1]).withColumn("rank", F.row_number().over(rank))


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    groups, postings = tables(docs.select(*GROUP, "text"), least)
    parts = [("pair", pair_values(groups, postings)), ("term", first_terms(postings, ranks))]
    one, two = (df.select(*GROUP, F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")) for part, df in parts)
    return one.unionByName(two)


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
    w AS (SELECT i, lang, source, unnest(ws) AS term FROM d), kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
    l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang), c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
    g AS (SELECT DISTINCT lang, source FROM d), n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * l.v) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (k.c + 2)) // (l.n + 2 * l.v) AS BIGINT) AS q
        FROM g JOIN l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
    s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
    r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE c > 0 AND p > q)
    SELECT lang, source, part, item, value, CAST(row_number() OVER o AS INTEGER) AS rank FROM r WINDOW o AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER o <= 10"""
