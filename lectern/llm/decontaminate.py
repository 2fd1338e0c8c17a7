"""Operator 6: benchmark decontamination with training suffix arrays.

Every run of documents (a shard) gets a suffix array: its words as numbers in the order of the benchmark's vocabulary,
and all their suffixes sorted by prefix doubling. Only stretches of words that the benchmark also uses, long enough to
hold a window, are part of it; a suffix ends with its stretch, as no match goes beyond. Every suffix of every benchmark
text is binary-searched in it, word by word: the interval of suffixes that begin with its first 1, 2, .. words. The
interval at the depth of a window gives the documents and words hit; it is narrowed further until it is empty, and where
a document's suffix falls out, the longest verbatim match from there is known, with its place in both texts. Each narrowing
looks at distinct intervals only and each suffix falls out once, so repetitive texts cost no more than others.

The benchmark is a stated query set: it is searched in blocks of at most BLOCK words and BLOCK_BYTES bytes (one text at
least), each block sent to every task, so its size does not limit it; a document's hits are merged over the blocks.

Nulls and texts without words have no words, no suffixes and no hits. An item with a null item_id hits words like any
other, but has no name to list: it is not among a document's items. Repeated rows are reported alike. Extra columns
of documents are kept out of the results, of decontaminate() they are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: Words and bytes of the benchmark that are searched at once.
BLOCK, BLOCK_BYTES = 200_000, 16 << 20
#: Bytes of text in a shard.
SHARD = 1 << 20


class Suffixes:
    """A block of benchmark texts: vocabulary (sorted hashes), words as numbers from 1 on, and the suffixes (item, word)
    that begin a window."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        h, first = _hashes(pa.array([t for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        self.vocabulary, number = np.unique(h, return_inverse=True)
        size = np.diff(first)
        depth = np.minimum(size, window)
        self.words = np.append(number + 1, 0)  # 0 is no word
        n = np.where(size > 0, size - depth + 1, 0)
        self.item = np.repeat(np.arange(len(items)), n)
        self.word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.at = first[self.item] + self.word
        self.end = first[self.item + 1]
        self.depth = depth[self.item]
        self.least = int(self.depth.min()) if len(self.depth) else 0


def _hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each row and the total) of a whole column."""
    h, n = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, _, data, off in tokens.chunks(col):
        _, _, x, first = tokens.words(data, off, tokens.ALNUM)
        h.append(x)
        n.append(np.diff(first))
    return np.concatenate(h), np.cumsum(np.concatenate(n))


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """The places of all words of seq, sorted by what follows up to the next 0. seq ends with 0."""
    zero = np.flatnonzero(seq == 0)
    left = zero[np.searchsorted(zero, np.arange(len(seq)))] - np.arange(len(seq))  # words up to the next 0
    rank, k, longest = seq.astype(np.int64), 1, int(left.max())
    while k < longest:
        top = int(rank.max()) + 1
        ahead = np.zeros(len(seq), np.int64)
        on = np.flatnonzero(left > k)
        ahead[on] = rank[on + k]
        distinct, rank = np.unique(rank * top + ahead, return_inverse=True)  # 0 stays the first
        k *= 2
        if len(distinct) == len(seq) - len(zero) + 1:
            break
    order = np.argsort(rank, kind="stable")
    return order[len(zero) :]


def _bounds(col, lo: np.ndarray, hi: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within each [lo, hi), where col(places) rises: first place with at least the word, first with more."""
    out = []
    for above in (False, True):
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            v = col(np.minimum(mid, hi - 1))
            right = open_ & (v <= word if above else v < word)
            a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
        out.append(a)
    return out[0], out[1]


def _segments(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. end[0] - 1, start[1], .."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Found:
    """What a shard of documents shares with a block: first (word of each row), hit (by word), pairs (row, item), and by
    row the longest match: length, its word in the row, suffix of the block."""

    def __init__(self, data: np.ndarray, off: np.ndarray, block: Suffixes):
        _, _, h, self.first = tokens.words(data, off, tokens.ALNUM)
        rows = len(off) - 1
        self.hit = np.zeros(len(h) + 1, np.int64)
        self.pairs = np.zeros((0, 2), np.int64)
        self.length, self.word, self.suffix = (np.zeros(rows, np.int64) for _ in range(3))
        if not len(block.at) or not len(h):
            return
        number = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
        known = block.vocabulary[number] == h
        # stretches of known words within a row
        edge = np.flatnonzero(np.concatenate(([True], (known[1:] != known[:-1]), [True])))
        edge = np.unique(np.concatenate((edge, self.first)))
        a, b = edge[:-1], edge[1:]
        held = known[a] & (b - a >= block.least)
        a, b = a[held], b[held]
        if not len(a):
            return
        size = b - a + 1  # a 0 behind each
        place = np.repeat(a - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        stop = np.cumsum(size) - 1
        seq = number[np.minimum(place, len(h) - 1)] + 1
        seq[stop] = 0
        self._search(seq, suffix_array(seq), place, block)

    def _search(self, seq: np.ndarray, array: np.ndarray, place: np.ndarray, block: Suffixes) -> None:
        row = np.searchsorted(self.first, place, "right") - 1
        own = np.arange(len(block.at))
        lo, hi = np.zeros(len(own), np.int64), np.full(len(own), len(array))
        best, who = np.zeros(len(seq), np.int64), np.zeros(len(seq), np.int64)
        pairs = []

        def fell(start, end, held, depth):
            """The suffixes of these segments, each in an interval of held, match in `depth` words and no more."""
            some = start < end
            start, end = start[some], end[some]
            p = array[_segments(start, end)]
            best[p], who[p] = depth, np.repeat(held[2][np.searchsorted(held[0], start, "right") - 1], end - start)

        depth, held = 0, (lo[:0], lo[:0], own[:0])  # held: distinct intervals in which windows have been found
        while len(own):
            on = block.at[own] + depth < block.end[own]
            word = np.where(on, block.words[np.where(on, block.at[own] + depth, 0)], 0)
            top = len(block.vocabulary) + 1
            key, once, back = np.unique(lo * top + word, return_index=True, return_inverse=True)
            x, y = _bounds(lambda i, d=depth: seq[array[i] + d], lo[once], hi[once], word[once])  # noqa: B023
            x, y = np.where(word[once] > 0, x, 0)[back], np.where(word[once] > 0, y, 0)[back]
            depth += 1
            own, lo, hi = own[x < y], x[x < y], y[x < y]
            deep = block.depth[own] < depth
            _, at = np.unique(lo[deep], return_index=True)
            # disjoint intervals in disjoint ones: what is in none of the inner ones
            start, end = np.sort(np.concatenate((held[0], hi[deep][at]))), np.sort(np.concatenate((lo[deep][at], held[1])))
            fell(start, end, held, depth - 1)
            new = np.flatnonzero(block.depth[own] == depth)
            if len(new):
                _, once = np.unique(block.item[own[new]] * (len(seq) + 1) + lo[new], return_index=True)
                new = new[once]
                p = array[_segments(lo[new], hi[new])]
                pairs.append(np.unique(row[p] * len(block.ids) + np.repeat(block.item[own[new]], hi[new] - lo[new])))
                p = place[np.unique(p)]
                self.hit[p] += 1
                self.hit[p + depth] -= 1
            deep = block.depth[own] <= depth
            _, at = np.unique(lo[deep], return_index=True)
            held = lo[deep][at], hi[deep][at], own[deep][at]
        fell(held[0], held[1], held, depth)
        self.hit = np.cumsum(self.hit)
        if pairs:
            code = np.unique(np.concatenate(pairs))
            self.pairs = np.stack((code // len(block.ids), code % len(block.ids)), axis=1)
            at = np.flatnonzero(best)
            at = at[np.lexsort((place[at], -best[at], row[at]))]
            r, once = np.unique(row[at], return_index=True)
            at = at[once]
            self.length[r], self.word[r], self.suffix[r] = best[at], place[at] - self.first[r], who[at]

    def spans(self) -> pa.ListArray:
        """By row, the disjoint [from, to) word ranges that are hit."""
        on = self.hit[:-1] > 0
        edge = np.flatnonzero(np.concatenate(([len(on) > 0], on[1:] != on[:-1], [len(on) > 0])))
        edge = np.unique(np.concatenate((edge, self.first)))
        a, b = edge[:-1], edge[1:]
        a, b = a[on[a]], b[on[a]]
        row = np.searchsorted(self.first, a, "right") - 1
        ends = np.searchsorted(row, np.arange(len(self.first))).astype(np.int32)
        both = pa.StructArray.from_arrays([pa.array(a - self.first[row]), pa.array(b - self.first[row])], ["from", "to"])
        return pa.ListArray.from_arrays(pa.array(ends), both)


SCHEMA = """doc_id long, tkey long, n_words long, hits array<struct<from:long,to:long>>, items array<string>, longest long,
    longest_at long, longest_item string, longest_word long"""


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[object, str]]]:
    held, words, size = [], 0, 0
    for item, text in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        own = len(_hashes(pa.array([text], pa.string()))[0])
        if held and (words + own > most or size + len(text) * 4 > BLOCK_BYTES):
            yield held
            held, words, size = [], 0, 0
        held.append((item, text))
        words, size = words + own, size + len(text) * 4
    yield held


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, block: int = BLOCK) -> DataFrame:
    """For every document: doc_id, tkey (hash of the text), n_words, hits (sorted disjoint [from, to) word ranges
    inside benchmark windows), items (sorted distinct item ids as strings) and its longest verbatim match: words, place in
    the document, item and place in it."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")

    def one(held):
        sent = spark.sparkContext.broadcast(Suffixes(held, window))

        def run(batches):
            own = sent.value
            for batch in batches:
                for a, b, data, off in tokens.chunks(batch.column(2), SHARD):
                    f = Found(data, off, own)
                    items = [set() for _ in range(b - a)]
                    for r, i in f.pairs.tolist():
                        if own.ids[i] is not None:
                            items[r].add(str(own.ids[i]))
                    none = pa.array(f.length == 0)
                    at = [pc.if_else(none, None, pa.array(x)) for x in (f.word, own.word[f.suffix] if len(own.word) else f.word)]
                    name = [None if not n or own.ids[own.item[z]] is None else str(own.ids[own.item[z]]) for n, z in zip(f.length.tolist(), f.suffix.tolist(), strict=True)]
                    cols = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(f.first)), f.spans(), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(f.length), at[0], pa.array(name, pa.string()), at[1]]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tkey", "n_words", "hits", "items", "longest", "longest_at", "longest_item", "longest_word"])

        return common.mapped(docs, run, SCHEMA)

    out = [one(held) for held in _blocks(benchmark, block)]
    if len(out) == 1:
        return out[0]
    found = common.cut(reduce(DataFrame.unionByName, [x.where("size(hits) > 0") for x in out]))
    best = F.max(F.struct("longest", "longest_at", "longest_item", "longest_word")).alias("best")
    hits = found.groupBy("doc_id", "tkey").agg(F.flatten(F.collect_set("hits")).alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("i"), best)
    merged = F.expr("""aggregate(array_sort(h), cast(array() as array<struct<from:bigint,to:bigint>>), (acc, s) ->
        CASE WHEN size(acc) = 0 OR element_at(acc, -1).to < s.from THEN concat(acc, array(s))
        ELSE concat(slice(acc, 1, size(acc) - 1), array(named_struct('from', element_at(acc, -1).from, 'to', greatest(element_at(acc, -1).to, s.to)))) END)""")
    hits = hits.select(F.col("doc_id").alias("d"), F.col("tkey").alias("t"), merged.alias("h"), "i", "best")
    base = out[0].select("doc_id", "tkey", "n_words")
    none = lambda t: F.expr(f"cast(array() as array<{t}>)")
    return base.join(hits, base.doc_id.eqNullSafe(hits.d) & (base.tkey == hits.t), "left").select(
        "doc_id", "tkey", "n_words", F.coalesce("h", none("struct<from:bigint,to:bigint>")).alias("hits"), F.coalesce("i", none("string")).alias("items"),
        F.coalesce("best.longest", F.lit(0)).alias("longest"), "best.longest_at", "best.longest_item", "best.longest_word",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block: int = BLOCK) -> DataFrame:
    """docs without the documents that hold a window of the benchmark; all columns stay. Rows are searched where they
    are, once for each block: no join, no shuffle."""
    text = docs.columns.index("text")
    for held in _blocks(benchmark, block):
        sent = docs.sparkSession.sparkContext.broadcast(Suffixes(held, window))

        def run(batches, sent=sent):
            for batch in batches:
                for a, b, data, off in tokens.chunks(batch.column(text), SHARD):
                    yield batch.slice(a, b - a).filter(pa.array(Found(data, off, sent.value).length == 0))

        docs = common.mapped(docs, run, docs.schema)
    return docs


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(hits, 0L, (n, s) -> n + s.to - s.from)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "longest",
        "longest_at",
        "longest_item",
        "longest_word",
    )
