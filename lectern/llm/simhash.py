"""Operator 12: SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has 64 bits, each set if more than half of the hashes of its shingles have it. Documents link if
their fingerprints differ in at most `far` bits.

* Bits that correlate over the corpus (all distinct fingerprints; 64 x 64 counts) are grouped into the same one of `parts`
  partitions, so that the others stay as independent as they can.
* Two fingerprints within `far` bits agree up to t_i bits in one partition i at least, whatever thresholds t_i add up to
  far - parts + 1 (-1: the partition isn't probed). Each fingerprint gets its own thresholds by dynamic programming on the
  candidates that a histogram of each partition's values (its first LOW bits) lets it expect, and on its probes.
* A fingerprint is indexed by its value in every partition and probes all values within its thresholds; what meets under
  a key is verified on all 64 bits inside the join.
* A key under which more than MEET pairs would meet is not paired. Its fingerprints send themselves and each of their
  neighbours at one flip (at `far` 3 or 4, at two) instead: two of them are within `far` bits just if they meet in such a
  middle (at odd `far`, in one that the one sends at a flip less); each is linked to the smallest one it meets there.
  Linear, and it finds every component.

Components are the same for any partitions and thresholds: these decide only how much is compared. Links span components.

Null and empty texts have fingerprint zero and link like any other. Repeated rows are copies of each other. Extra
columns are ignored. A null doc_id takes part; component_id is the smallest id that is not null, else null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, tokens

WORDS, FAR, PARTS, BITS, SEED = 3, 2, 3, 64, 42
#: Bits of a partition's value that the histogram tells apart: parts x 65,536 counts at most.
LOW = 16
#: Pairs that may meet under one key.
MEET = 256
#: Shingles whose bits are counted at once, a multiple of 255.
RUN = 255 * 16


def shingles(text: bytes, n: int) -> Iterator[bytes]:
    """The n-word shingles of a text, repeats included; the whole sequence if it has fewer words."""
    held: list[bytes] = []
    many = False
    for piece in tokens.pieces(text.lower()):
        held += piece.split()
        if len(held) >= n:
            yield from map(b" ".join, zip(*(held[k:] for k in range(n)), strict=False))
            held, many = held[len(held) - n + 1 :], True
    if held and not many:
        yield b" ".join(held)


def fingerprint(text: bytes, n: int = WORDS) -> int:
    """The 64 bits as a signed integer."""
    total, size = np.zeros(BITS, np.int64), 0
    hashes: list[int] = []

    def count():
        h = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
        h[: len(hashes)] = hashes
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return bits.reshape(-1, 255, BITS).sum(1, np.uint8).sum(0, np.int64)

    for s in shingles(text, n):
        hashes.append(xxhash.xxh64_intdigest(s, SEED))
        if len(hashes) == RUN:
            total, size, hashes = total + count(), size + RUN, []
    if hashes:
        total, size = total + count(), size + len(hashes)
    return int(np.packbits(2 * total > size, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id and fp of each row."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t or b"", n) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    df = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return common.mapped(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fp long")


def _bits(fps: pa.Array) -> np.ndarray:
    return np.unpackbits(fps.to_numpy().astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated(fps: DataFrame, parts: int) -> list[list[int]]:
    """The bits in `parts` groups of nearly equal size, those that correlate together; counted over all fingerprints."""

    def run(batches):
        sums, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = _bits(batch.column(0)).astype(np.float32)
            for b in range(0, len(x), 1 << 16):  # sums of so many are exact in 32 bits
                sums += x[b : b + (1 << 16)].T @ x[b : b + (1 << 16)]
            n += len(x)
        i, j = np.indices((BITS, BITS))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i.ravel(), -1)), pa.array(np.append(j.ravel(), -1)), pa.array(np.append(sums.ravel(), n).astype(np.int64))], ["i", "j", "c"])

    # one short row for each pair of bits: 4,097
    got = common.mapped(fps.select("fp"), run, "i long, j long, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).toArrow()
    c, n = np.zeros((BITS + 1, BITS + 1)), 0
    if len(got):
        c[got["i"].to_numpy(), got["j"].to_numpy()] = got["c"].to_numpy()
        n = c[-1, -1]
    c = c[:BITS, :BITS] / max(n, 1)
    one = np.diag(c)
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    near = np.abs(c - np.outer(one, one)) / np.outer(spread, spread)
    np.fill_diagonal(near, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (near[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (near[b, group].sum(), -b)))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def _values(fps: pa.Array, groups: list[list[int]]) -> np.ndarray:
    """The value of each fingerprint in each partition: (parts, rows)."""
    bits = _bits(fps)
    return np.stack([bits[:, g].astype(np.int64) @ (np.int64(1) << np.arange(len(g), dtype=np.int64)) for g in groups])


def _histogram(fps: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """How many fingerprints have each value of the first bits of each partition."""

    def run(batches):
        sums = np.zeros((len(groups), 1 << LOW), np.int64)
        for batch in batches:
            for i, v in enumerate(_values(batch.column(0), groups)):
                sums[i] += np.bincount(v & ((1 << LOW) - 1), minlength=1 << LOW)
        i, v = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(v), pa.array(sums[i, v])], ["i", "v", "c"])

    got = common.mapped(fps.select("fp"), run, "i long, v long, c long").groupBy("i", "v").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros((len(groups), 1 << LOW), np.int64)
    if len(got):
        out[got["i"].to_numpy(), got["v"].to_numpy()] = got["c"].to_numpy()
    return out


def thresholds(values: np.ndarray, groups: list[list[int]], counts: np.ndarray, far: int) -> np.ndarray:
    """(parts, rows): each fingerprint's thresholds, -1 to 1, of least expected cost: candidates and probes."""
    parts, rows = values.shape
    cost = np.zeros((parts, 3, rows), np.int64)  # of the thresholds -1, 0 and 1
    for i, g in enumerate(groups):
        low = values[i] & ((1 << LOW) - 1)
        own = counts[i][low]
        told = min(LOW, len(g))
        cost[i, 1] = own + 1
        cost[i, 2] = own * (1 + len(g) - told) + sum(counts[i][low ^ (1 << b)] for b in range(told)) + len(g) + 1
    total = far - parts + 1
    if total > parts:
        raise ValueError("more partitions are needed for this distance")
    never = np.int64(1) << 60
    best = np.full((2 * parts + 1, rows), never)  # of the partitions so far, by the sum of their thresholds + parts
    best[parts] = 0
    steps = []
    for i in range(parts):
        new, step = np.full_like(best, never), np.zeros(best.shape, np.int8)
        for t in (0, -1, 1):
            for s in range(max(0, t), min(len(best), len(best) + t)):
                c = best[s - t] + cost[i, t + 1]
                less = c < new[s]
                new[s][less], step[s][less] = c[less], t
        best = new
        steps.append(step)
    out, s = np.zeros((parts, rows), np.int8), np.full(rows, total + parts)
    for i in range(parts - 1, -1, -1):
        out[i] = steps[i][s, np.arange(rows)]
        s = s - out[i]
    return out


def keyed(fps: DataFrame, groups: list[list[int]], counts: np.ndarray, far: int) -> DataFrame:
    """key (partition and value), fp, own (its index entry) and probe: a row for each entry and probe."""
    sent = fps.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            for b in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(b, 4096)
                x, v = fp.to_numpy(), _values(fp, groups)
                t = thresholds(v, groups, sent.value, far)
                keys, ids, own, probe = [], [], [], []
                for i, g in enumerate(groups):
                    key = v[i] | (i << 56)
                    keys.append(key), ids.append(x), own.append(np.ones(len(x), bool)), probe.append(t[i] >= 0)
                    wide = np.flatnonzero(t[i] == 1)
                    for k in range(len(g) if len(wide) else 0):
                        keys.append(key[wide] ^ (1 << k)), ids.append(x[wide]), own.append(np.zeros(len(wide), bool)), probe.append(np.ones(len(wide), bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, ids, own, probe)], ["key", "fp", "own", "probe"])

    return common.mapped(fps.select("fp"), run, "key long, fp long, own boolean, probe boolean")


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _through_middles(fps: DataFrame, far: int) -> DataFrame:
    """Links (a, b) that connect all of the fingerprints that are linked: through what lies half way between them."""
    flips = far // 2  # of both ends, if far is even; the one end of an odd distance goes one further
    one = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k))

    def around(df: DataFrame, steps: int) -> DataFrame:
        df = df.withColumn("mid", F.col("fp"))
        for _ in range(steps):
            df = df.withColumn("mid", F.explode(F.concat(F.array("mid"), F.transform(one, lambda bit: F.col("mid").bitwiseXOR(bit))))).distinct()
        return df

    near = common.cut(around(fps.select("fp"), flips))
    if far % 2 == 0:
        low = near.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").drop("z")
        return near.join(low, "mid").where("a < fp").select("a", F.col("fp").alias("b")).distinct()
    # an end at a flip more meets one at `flips`: of the latter, the smallest and largest stand for all, which are linked
    low = near.groupBy("mid").agg(F.min("fp").alias("a"))
    wide = around(fps.select("fp"), flips + 1).join(low, "mid").where("a <> fp")
    inner = near.join(low, "mid").where("a < fp")
    return wide.select("a", F.col("fp").alias("b")).unionByName(inner.select("a", F.col("fp").alias("b"))).where(differing(F.col("a"), F.col("b")) <= far).distinct()


def links(fps: DataFrame, far: int = FAR, parts: int = PARTS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, cut) that span their components."""
    groups = correlated(fps, parts)
    rows = common.keep(keyed(fps, groups, _histogram(fps, groups), far))
    met = rows.groupBy("key").agg(F.sum(F.col("own").cast("long")).alias("o"), F.sum(F.col("probe").cast("long")).alias("p"), F.count("*").alias("c"))
    met = common.cut(met.where("c > 1 AND o > 0 AND p > 0").select("key", (F.col("o") * F.col("p") > MEET).alias("hot")))
    few, hot = met.where("NOT hot").select("key"), met.where("hot").select("key")
    side = F.broadcast if common.is_small(met, common.NARROW_ROWS) else lambda df: df
    x = rows.where("own").join(side(few), "key").select("key", F.col("fp").alias("a"))
    y = rows.where("probe").select("key", F.col("fp").alias("b"))
    near = x.join(y.join(side(few), "key"), "key").where((F.col("a") != F.col("b")) & (differing(F.col("a"), F.col("b")) <= far))
    out = common.cut(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not hot.isEmpty():
        dense = common.cut(rows.join(side(hot), "key").select("fp").distinct())
        out = common.cut(out.unionByName(_through_middles(dense, far)))
    common.drop(rows)
    return out


def near_duplicates(docs: DataFrame, n: int = WORDS, far: int = FAR, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """(rows, links): doc_id, fp, component_id of every document; links (a, b) of fingerprints that span components."""
    rows = common.keep(fingerprints(docs.select("doc_id", "text"), n))
    fps = common.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("c")))
    found = links(fps, far, parts)
    comp = fps.join(common.components(found).withColumnRenamed("node", "fp"), "fp", "left")
    comp = common.cut(comp.where("comp IS NOT NULL OR c > 1").select("fp", F.coalesce("comp", "fp").alias("comp"), "lowest"))
    ids = comp.groupBy("comp").agg(F.min("lowest").alias("component_id"))
    of = common.cut(comp.join(common.small(common.cut(ids)), "comp").select(F.col("fp").alias("of_fp"), "component_id", F.lit(True).alias("many")))
    out = rows.join(common.small(of), F.col("fp") == F.col("of_fp"), "left")
    return out.select("doc_id", "fp", F.when(F.col("many"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), found


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    rows, _ = near_duplicates(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
