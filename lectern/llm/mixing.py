"""Operator 1: mixing sources to target weights, with DataFrame functions only.

1. Packing: each source's documents, in pseudorandom order, are one stream of words cut into blocks of `block` words.
   Places come from two-level prefix sums (within hash buckets, whose number follows the source's documents, then over
   buckets), so a hot source has no single task.
2. Targets: weights share the corpus's words; a source gets at most `cap` times its size, and what is over goes to the
   others by weight (solved in closed form over sources sorted by size per weight).
3. Draws: a source's target fixes how many slots it fills in all. Each output shard draws its source counts: a
   multinomial draw given these totals, made by one pseudorandom permutation that deals all slots to shards. So shards
   vary like draws while the totals keep to the targets. The counts are a table, one row for each shard and source.
4. Indexes: prefix sums of the counts number the slots of a source through all shards. The k-th slot of a source takes
   block perm(k mod blocks) of its (k div blocks)-th pass over the source; the permutations are keyed by seed, source
   and pass (swap-or-not shuffles, exact on every domain size). The last slot of a source is trimmed to its target.
   Within a shard the slots stand in an order of their own permutation.
5. Blocks and slots meet in an equi-join by (source, block); every block has at most cap (rounded up) slots.

The table of sources (one row each) is sorted in one task; documents, slots and counts never are.

Same input, same mix, whatever the partitions. A null text has no words; documents without words are never taken. A
null source is a source of its own, last in order; a null doc_id is a document. Rows that agree in doc_id and text are
told apart, each has its own words in the stream. Extra columns are ignored; of mixed() they are passed on, but for
columns named size, source_size, target and taken, which it replaces. An empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, slots of an output shard, documents of a hash bucket (on average), rounds of a permutation.
BLOCK, SLOTS, BUCKET, ROUNDS = 512, 1024, 4096, 24
#: Slots made from one row; shards in a run of prefix sums.
STEP, RUN = 1 << 12, 1 << 12


def permuted(x: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """The place of x under a keyed pseudorandom permutation of 0 .. n - 1 (swap-or-not)."""

    def turn(x, i):
        other = F.pmod(F.pmod(F.xxhash64(key, i), n) + n - x, n)
        return F.when(F.xxhash64(key, i, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    rounds = range(ROUNDS)[::-1] if inverse else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(i) for i in rounds]), x.cast("long"), turn)


def targets(per: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """per: source, source_size. Adds sid (0, 1, .. in code point order, null last), weight, total and target."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    per = per.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", w)
    tight = W.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before = tight.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(whole)).withColumn("limit", F.col("source_size") * float(cap))
    left, share = F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)), F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("full", F.col("limit") * share <= left * F.col("weight"))
    free = F.when(F.col("full"), 0.0).otherwise(F.col("weight"))
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(whole)
    return per.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(rest * F.col("weight") / F.sum(free).over(whole))).drop("limit", "full")


@dataclass
class Mix:
    """sources: the plan. drawn: (shard, sid, n), the source counts of each output shard. sized: documents with rid,
    size and place. pieces: documents' parts by (sid, block). slots: (shard, slot, sid, block, take), made from the drawn
    counts. All are materialised or narrow."""

    sources: DataFrame
    drawn: DataFrame
    sized: DataFrame
    pieces: DataFrame
    slots: DataFrame

    def counts(self) -> DataFrame:
        """Slots by output shard and source."""
        return self.drawn.withColumnRenamed("n", "count")

    def content(self) -> DataFrame:
        """The mix: which words of which document (rid, doc_id, tkey) stand where in each slot."""
        cut = F.least(F.col("at") + F.col("n"), F.col("take")) - F.col("at")
        return self.slots.join(self.pieces.hint("merge"), ["sid", "block"]).where(F.col("at") < F.col("take")).select("shard", "slot", "at", "sid", "block", "rid", "doc_id", "tkey", "word", cut.alias("n"))

    def taken(self) -> DataFrame:
        """sized with source_size, target and taken: the words that the mix takes of each document, repeats counted."""
        got = self.content().groupBy("rid").agg(F.sum("n").alias("taken"))
        return self.sized.join(got, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))

    def texts(self, docs: DataFrame) -> DataFrame:
        """content() with the words themselves, joined by blanks."""
        own = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("k"), "text").dropDuplicates(["id", "k"])
        c = self.content()
        words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("word") + 1).cast("int"), F.col("n").cast("int"))
        return c.join(own, c.doc_id.eqNullSafe(own.id) & (c.tkey == own.k)).withColumn("words", F.array_join(words, " ")).drop("id", "k", "text")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, block: int = BLOCK, slots: int = SLOTS, seed: int = 11) -> Mix:
    sized = common.cut(docs.select("doc_id", "source", F.xxhash64("text").alias("tkey"), common.words_col(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("rid")))
    per = common.cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, cap))
    # slots of each source: whole passes, then the part of a pass that reaches the target
    b = F.lit(block)
    p = per.where("source_size > 0").withColumn("want", F.floor(F.col("target") + 0.5)).withColumn("blocks", F.ceil(F.col("source_size") / b))
    p = p.withColumn("tail", F.col("source_size") - (F.col("blocks") - 1) * b).withColumn("passes", F.expr("want div source_size"))
    p = p.withColumn("rest", F.col("want") - F.col("passes") * F.col("source_size"))
    p = p.withColumn("tail_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.concat_ws(":", F.lit(seed), "sid", "passes"), inverse=True))
    plain = F.ceil(F.col("rest") / b)
    p = p.withColumn("short", (F.col("rest") > 0) & (F.col("tail_at") < plain)).withColumn("part", F.when(F.col("rest") == 0, 0).when(F.col("short"), F.ceil((F.col("rest") + b - F.col("tail")) / b)).otherwise(plain))
    p = p.withColumn("n_slots", F.col("passes") * F.col("blocks") + F.col("part"))
    # the trimmed last slot: what is left of the target after the slots before it
    done = (F.col("part") - 1) * b - F.when(F.col("tail_at") < F.col("part") - 1, b - F.col("tail")).otherwise(0)
    p = p.withColumn("last_take", F.when(F.col("part") > 0, F.col("rest") - done))
    every = W.partitionBy(F.lit(0)).orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
    p = p.withColumn("first", F.coalesce(F.sum("n_slots").over(every), F.lit(0))).withColumn("all", F.sum("n_slots").over(W.partitionBy(F.lit(0))))
    p = common.cut(p.select("sid", "blocks", "tail", "n_slots", "last_take", "first", "all"))

    runs = p.where("n_slots > 0").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_slots - 1) div {STEP}"))))
    runs = runs.repartition(max(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "sid", "run")
    dealt = runs.withColumn("k", F.explode(F.sequence(F.col("run") * STEP, F.least((F.col("run") + 1) * STEP, F.col("n_slots")) - 1)))
    j = permuted(F.col("first") + F.col("k"), F.col("all"), F.lit(str(seed)))
    drawn = common.cut(dealt.select(F.floor(j / slots).alias("shard"), "sid").groupBy("shard", "sid").agg(F.count("*").alias("n")))

    # the first of a shard's slots among its source's: within runs of shards, then over runs
    c = drawn.withColumn("run", F.expr(f"shard div {RUN}"))
    sums = lambda over: F.coalesce(F.sum("n").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = c.groupBy("sid", "run").agg(F.sum("n").alias("n")).withColumn("head", sums(W.partitionBy("sid").orderBy("run"))).drop("n")
    c = c.withColumn("k", sums(W.partitionBy("sid", "run").orderBy("shard"))).join(heads, ["sid", "run"]).withColumn("k", F.col("k") + F.col("head"))
    c = c.withColumn("slot", sums(W.partitionBy("shard").orderBy("sid"))).withColumn("held", F.sum("n").over(W.partitionBy("shard")))
    c = c.join(common.small(p.drop("first", "all")), "sid")
    c = c.repartition(max(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard", "sid")  # few rows of many slots
    s = c.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("k", F.col("k") + F.col("i"))
    s = s.withColumn("block", permuted(F.expr("k % blocks"), F.col("blocks"), F.concat_ws(":", F.lit(seed), "sid", F.expr("k div blocks"))))
    s = s.withColumn("slot", permuted(F.col("slot") + F.col("i"), F.col("held"), F.concat_ws("/", F.lit(seed), "shard")))
    full = F.when(F.col("block") == F.col("blocks") - 1, F.col("tail")).otherwise(b)
    take = F.when((F.col("k") == F.col("n_slots") - 1) & F.col("last_take").isNotNull(), F.col("last_take")).otherwise(full)
    s = s.select("shard", "slot", "sid", "block", take.cast("long").alias("take"))

    named = per.select(F.col("source").alias("name"), "sid", "source_size", "target", "docs")
    sized = sized.join(common.small(named), sized.source.eqNullSafe(named.name)).drop("name")
    placed = sized.where("size > 0").withColumn("h", F.xxhash64("doc_id", "tkey", F.lit(seed))).withColumn("bucket", F.pmod(F.col("h"), F.expr(f"docs div {BUCKET} + 16")))
    sized = sized.drop("docs")
    within = W.partitionBy("sid", "bucket").orderBy("h", "doc_id", "tkey", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    heads = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).withColumn("head", F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = placed.join(heads, ["sid", "bucket"]).withColumn("start", F.col("start") + F.col("head"))
    pieces = placed.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    lo, hi = F.greatest(F.col("start"), F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    pieces = pieces.select("sid", "block", "rid", "doc_id", "tkey", (lo - F.col("block") * b).alias("at"), (lo - F.col("start")).alias("word"), (hi - lo).alias("n"))
    return Mix(per, drawn, sized, pieces, s)


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """docs with size, source_size, target and taken: how much of each document the mix takes. Rows that agree in
    doc_id and text show the largest of their numbers of words taken."""
    new = ["size", "source_size", "target", "taken"]
    own = [common.free(x, docs) for x in ("id", "tkey", "src")]
    t = mix(docs, **settings).taken().groupBy(*[F.col(c).alias(x) for c, x in zip(("doc_id", "tkey", "source"), own, strict=True)])
    t = common.cut(t.agg(*[F.max(c).alias(common.free(f"new_{c}", docs)) for c in new]))
    i, k, s = (t[x] for x in own)
    hit = docs["doc_id"].eqNullSafe(i) & (F.xxhash64(docs["text"]) == k) & docs["source"].eqNullSafe(s)
    return docs.join(common.small(t), hit).select(*[docs[c] for c in docs.columns if c not in new], *[t[common.free(f"new_{c}", docs)].alias(c) for c in new])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")
