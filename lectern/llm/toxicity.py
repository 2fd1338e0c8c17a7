"""Operator 7: toxicity by the nearest labelled examples.

A text's terms are its words and the beginnings of its words (STEMS bytes long). All terms that LEAST_DOCS and 1 in
LEAST_SHARE of at most MAX_TRAIN labelled rows hold, whatever their labels, are the vocabulary; a text is the TF-IDF
vector of those terms (term frequency times the IDF_POWER-th power of the logarithm of the inverse document frequency),
with document frequencies counted over all documents. A score comes from the K nearest of at most MAX_EXAMPLES labelled
examples by exact cosine, found with a block-max inverted index. Votes are weighted by 1 / (distance + 0.05) and
calibrated by isotonic regression on leave-one-out votes of the examples. The nearest examples are returned as evidence.

Index: examples are dealt into blocks of similar ones. Rare terms keep posting lists; the DENSE most frequent terms keep
their weights block by block, and their largest weight in every block. A query runs through its rare lists, bounds each
block by the best sum in it plus the block-maxima of its frequent terms, and opens the blocks whose bound reaches the
K-th best sum so far. Candidates are summed again in double precision, so a score does not depend on which
other texts are scored beside it.

The only sampled parts are the labelled rows that a model is fitted on, chosen by a hash of their doc_id. Held out are
rows whose crc32(doc_id as text) mod 5 is 0 (a null doc_id counts as the text ''): their labels are never read. Neither
labels nor lang, source or doc_id are part of a score.

Null and empty texts, and texts with no term of the vocabulary, get the calibrated share of toxic examples among those
without terms. Without usable labels all scores are 0. Repeated rows score alike. Several labels of one doc_id count as
toxic if one of them says so; labels other than 0 and 1 are ignored. Extra columns are ignored, without_toxic() passes
them on whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: Labelled rows that terms are chosen on, and that serve as examples, at most.
MAX_TRAIN, MAX_EXAMPLES = 20_000, 8_000
#: The labelled rows that a term must be in: so many, and one in so many.
LEAST_DOCS, LEAST_SHARE = 5, 150
K, BLOCK, IDF_POWER = 15, 64, 2
STEMS = (4, 6)
#: Terms of the index that are kept as block columns; texts scored at once; scores that a worker remembers.
DENSE, TEXTS, KNOWN = 1024, 96, 10_000
#: Entries of candidates that are summed at once: any number of examples may tie.
ENTRIES = 1 << 16


def term_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all terms of the rows of a chunk, with repeats."""
    starts, ends, h, first = tokens.words(data, off, tokens.ALNUM)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    all_h, all_row = [h], [row]
    up = tokens._powers(max(STEMS) + 1)[0]
    for n in STEMS:
        long = np.flatnonzero(ends - starts > n)
        s = starts[long]
        k = np.zeros(len(long), np.uint64)
        for j in range(n):
            k += tokens.ALNUM.value[data[s + j]] * up[j]
        all_h.append(tokens.mix(k + np.uint64(n)))
        all_row.append(row[long])
    return np.concatenate(all_h), np.concatenate(all_row)


class Vocabulary:
    """Sorted term hashes, found through a table of their first bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = max(1, min(20, int(16 * len(hashes) + 1).bit_length()))
        self.shift = np.uint64(64 - bits)
        at = np.searchsorted(hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self.first = at[:-1].astype(np.int32)
        self.longest = int(np.diff(at).max()) if len(hashes) else 0
        self.padded = np.concatenate((hashes, np.zeros(self.longest + 1, np.uint64)))

    def __len__(self) -> int:
        return len(self.hashes)

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is none of the terms."""
        start = self.first[h >> self.shift]
        out = np.full(len(h), -1, np.int64)
        for k in range(self.longest):
            at = start + k
            hit = (self.padded[at] == h) & (at < len(self.hashes))
            out[hit] = at[hit]
        return out


def vectors(data: np.ndarray, off: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each row and the total, terms, term frequencies) of the rows of a chunk; terms rise."""
    h, row = term_hashes(data, off)
    at = vocabulary.places(h)
    hit = at >= 0
    code, tf = np.unique(row[hit].astype(np.int64) << 32 | at[hit], return_counts=True)
    return np.searchsorted(code >> 32, np.arange(len(off))), (code & 0xFFFFFFFF).astype(np.int32), tf.astype(np.int32)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (size[0] of them), start[1], .."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Model:
    """Vocabulary, document frequencies, examples and calibration. What is sent to the tasks are the examples' vectors;
    the block-max index is built from them where it is used."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, examples: list[tuple[int | None, list[int], list[int], int]], k: int = K, block: int = BLOCK):
        some = [e for e in examples if len(e[1])]
        flat = [np.concatenate([np.zeros(0, np.int32), *(np.asarray(e[c], np.int32) for e in some)]) for c in (1, 2)]
        self._fill(vocabulary, idf, [e[0] for e in some], [e[3] for e in some], [len(e[1]) for e in some], *flat, [y for _, t, _, y in examples if not len(t)], k, block)

    @classmethod
    def of(cls, vocabulary, idf, ids, y, size, term, tf, none, k: int = K, block: int = BLOCK) -> Model:
        """From the examples' terms and frequencies one after the other, and the labels of those without terms."""
        model = cls.__new__(cls)
        model._fill(vocabulary, idf, ids, y, size, term, tf, none, k, block)
        return model

    def _fill(self, vocabulary, idf, ids, y, size, term, tf, none, k, block) -> None:
        self.vocabulary, self.idf, self.k, self.block = Vocabulary(vocabulary), idf, k, block
        self.none, self.ids, self.y = list(none), list(ids), np.array(y, float)
        size = np.array(size, int)
        start = np.concatenate(([0], np.cumsum(size)))
        w = np.zeros(len(term), np.float32)
        for a in range(0, len(size), 500):  # in double precision, some examples at a time
            here = slice(start[a], start[min(a + 500, len(size))])
            x = tf[here] * self.idf[term[here]]
            w[here] = x / np.repeat(np.sqrt(np.add.reduceat(x * x, start[a : a + 500][: len(size) - a] - start[a])), size[a : a + 500])
        self.place = _similar_first(term, w, start, block)  # example at each place of the index
        self.start = np.concatenate(([0], np.cumsum(size[self.place])))
        runs = [slice(a, b) for a, b in zip(start[self.place].tolist(), start[self.place + 1].tolist(), strict=True)]
        self.term, self.w = (np.concatenate([x[:0], *(x[r] for r in runs)]) for x in (term, w))  # by place
        self.steps, self.cols = None, None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("cols", "most", "column", "list", "list_at", "list_w")} | {"cols": None}

    def _index(self) -> None:
        """Posting lists of the rare terms, block columns and their maxima of the frequent ones."""
        n, term = len(self.place), self.term
        at = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.start))
        df = np.bincount(term, minlength=len(self.vocabulary))
        often = np.sort(np.argsort(-df, kind="stable")[:DENSE])
        self.column = np.full(len(self.vocabulary), -1, np.int32)
        self.column[often] = np.arange(len(often))
        dense = self.column[term] >= 0
        self.cols = np.zeros((len(often), n), np.float32)
        self.cols[self.column[term[dense]], at[dense]] = self.w[dense]
        self.most = np.maximum.reduceat(self.cols, self.heads, axis=1)
        rare = np.flatnonzero(~dense)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.list = np.concatenate(([0], np.cumsum(np.where(self.column < 0, df, 0))))
        self.list_at, self.list_w = at[rare].astype(np.intp), self.w[rare]

    @property
    def heads(self) -> np.ndarray:
        return np.arange(0, len(self.place), self.block)

    def left_out(self, places: np.ndarray) -> list[float]:
        """The votes of the examples at these places, each without itself."""
        own = [(self.term[a:b], self.w[a:b].astype(float)) for a, b in zip(self.start[places].tolist(), self.start[places + 1].tolist(), strict=True)]
        return [self._vote(i, s) for i, s in self.nearest_of(own, places)]

    def calibrate(self, votes: np.ndarray) -> None:
        """votes: left_out() of all places, in order."""
        if len(self.place) or self.none:
            raw = np.concatenate((votes, np.full(len(self.none), self.prior())))
            self.steps = isotonic(raw, np.concatenate((self.y[self.place], np.array(self.none, float))))

    def weights(self, terms, tf) -> tuple[np.ndarray, np.ndarray]:
        t = terms if isinstance(terms, np.ndarray) else np.array(terms, int)
        w = np.asarray(tf, float) * self.idf[t]
        return t, w / (np.sqrt((w * w).sum()) or 1.0)

    def prior(self) -> float:
        """Share of toxic examples among those without terms."""
        return (sum(self.none) + 0.1) / (len(self.none) + 1)

    def nearest(self, v, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine with v, ties by place, exactly; only those that share a term."""
        back = np.argsort(self.place)
        return next(self.nearest_of([v], back[[skip]] if skip >= 0 else None))

    def nearest_of(self, queries: list, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """nearest() for several vectors; skip: the place that each leaves out."""
        d, n = len(queries), len(self.place)
        if not n:
            yield from ((np.zeros(0, int), np.zeros(0)) for _ in queries)
            return
        if self.cols is None:
            self._index()
        row = np.repeat(np.arange(d), [len(t) for t, _ in queries])
        t, w = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries]).astype(np.float32)
        c = self.column[t]
        x = np.zeros((d, len(self.most)), np.float32)
        x[row[c >= 0], c[c >= 0]] = w[c >= 0]
        sums = np.zeros((d, n), np.float32)
        for q, (own, weight) in enumerate(queries):  # one at a time: the entries of a query's lists stay in the cache
            rare = self.column[own] < 0
            a, b = self.list[own[rare]], self.list[own[rare] + 1]
            if len(a):
                runs = [slice(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                w = np.repeat(weight[rare], b - a)
                w *= np.concatenate([self.list_w[x] for x in runs])
                sums[q] = np.bincount(np.concatenate([self.list_at[x] for x in runs]), w, n)
        bound = np.maximum.reduceat(sums, self.heads, axis=1) + x @ self.most + np.float32(1e-5)
        k = n - self.k - (skip is not None)  # sums only grow, so their K-th best is a lower bound of the K-th best cosine
        worst = np.partition(sums, k, axis=1)[:, k] if k > 0 else np.zeros(d, np.float32)
        pick = bound >= worst[:, None]
        for b in np.flatnonzero(pick.any(axis=0)):
            q, here = np.flatnonzero(pick[:, b]), slice(self.heads[b], self.heads[b] + self.block)
            sums[q, here] += x[q] @ self.cols[:, here]
        if skip is not None:
            sums[np.arange(d), skip] = -1
        worst = np.maximum(0, np.partition(sums, n - self.k, axis=1)[:, n - self.k]) if n > self.k else np.zeros(d, np.float32)
        q, at = np.nonzero(sums >= np.maximum(worst - np.float32(2e-5), np.float32(1e-30))[:, None])
        size = self.start[at + 1] - self.start[at]
        ends = np.searchsorted(q, np.arange(d + 1))
        work = np.concatenate(([0], np.cumsum(size)))[ends]
        a = 0
        while a < d:  # sums again in double precision, as many at once as take little memory
            z = min(max(a + 1, int(np.searchsorted(work, work[a] + ENTRIES, "right")) - 1), a + 32, d)
            scratch = np.zeros((z - a, len(self.vocabulary)))
            for k, (t, w) in enumerate(queries[a:z]):
                scratch[k, t] = w
            x, y = ends[a], ends[z]
            own = _runs(self.start[at[x:y]], size[x:y])
            parts = scratch.ravel()[np.repeat((q[x:y] - a) * len(self.vocabulary), size[x:y]) + self.term[own]] * self.w[own]
            s = np.add.reduceat(parts, np.cumsum(size[x:y]) - size[x:y]) if y > x else np.zeros(0)
            i = self.place[at[x:y]]
            order = np.lexsort((i, -s, q[x:y]))
            for u, v in zip(ends[a:z] - x, ends[a + 1 : z + 1] - x, strict=True):
                top = order[u : min(v, u + self.k)]
                yield i[top], s[top]
            a = z

    def _vote(self, i: np.ndarray, s: np.ndarray) -> float:
        w = 1 / (1.05 - np.minimum(s, 1))
        return (float((w * self.y[i]).sum()) + self.prior()) / (float(w.sum()) + 1)

    def scores(self, texts: list) -> list[tuple[float, list]]:
        """(score, nearest examples as (doc_id, cosine, label)) of each (terms, term frequencies)."""
        if self.steps is None:
            return [(0.0, [])] * len(texts)
        out = [(float(np.interp(self.prior(), *self.steps)), [])] * len(texts)
        some = [a for a, (t, _) in enumerate(texts) if len(t) and len(self.y)]
        for b in range(0, len(some), TEXTS):
            part = some[b : b + TEXTS]
            for a, (i, s) in zip(part, self.nearest_of([self.weights(*texts[a]) for a in part]), strict=True):
                near = [(self.ids[x], float(min(1, c)), int(self.y[x])) for x, c in zip(i[:3], s[:3], strict=True)]
                out[a] = float(np.interp(self._vote(i, s), *self.steps)), near
        return out


def _similar_first(term: np.ndarray, w: np.ndarray, start: np.ndarray, block: int) -> np.ndarray:
    """An order of the vectors in which runs of `block` are similar: halves along the main direction of 32 projections."""
    n = len(start) - 1
    if not n:
        return np.zeros(0, int)
    signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (32, 1 + int(term.max())))
    p = np.stack([np.add.reduceat(w * s[term], start[:-1]) for s in signs], axis=1)
    done, todo = [], [np.arange(n)]
    while todo:
        part = todo.pop()
        if len(part) <= block:
            done.append(part)
            continue
        x = p[part] - p[part].mean(axis=0)
        along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
        part = part[np.argsort(along, kind="stable")]
        half = -(-len(part) // block) // 2 * block  # whole blocks on either side
        todo += [part[half:], part[:half]]
    return np.concatenate(done)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising step function nearest to y(x) (pool adjacent violators), smoothed at both ends."""
    at, which, size = np.unique(x, return_inverse=True, return_counts=True)  # equal votes are one point
    pools: list[list[float]] = []
    for a, b, n in zip(at.tolist(), np.bincount(which, y, len(at)).tolist(), size.tolist(), strict=True):
        pools.append([b, n, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], hi]
    px, py = [], []
    for s, n, lo, hi in pools:
        v = (s + 0.02) / (n + 0.2)
        px += [lo, hi]
        py += [v, v]
    keep = np.concatenate(([True], np.diff(px) > 0))
    return np.array(px)[keep], np.maximum.accumulate(np.array(py)[keep])


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _train(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, toxic) of usable labels that aren't held out."""
    y = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND id IS NOT NULL")
    return y.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))


def _sampled(rows: DataFrame, key, limit: int) -> DataFrame:
    """All rows, or the `limit` that come first by their key; only about so many are sorted."""
    n = rows.count()
    if n <= limit:
        return rows
    near = rows.where(F.pmod(key, F.lit(1 << 20)) < int((1 << 20) * min(1.0, (limit + 8 * limit**0.5 + 100) / n)))
    return near.orderBy(F.pmod(key, F.lit(1 << 20)), key, *rows.columns[:1]).limit(limit)


def _vocabulary(train: DataFrame) -> np.ndarray:
    def count(batches):
        for batch in batches:
            for _, _, data, off in tokens.chunks(batch.column(0)):
                h, row = term_hashes(data, off)
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))[: len(h)]
                at, n = np.unique(h[new], return_counts=True)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(n)], ["h", "n"])

    n, n1 = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n1 < n:
        return np.zeros(0, np.uint64)
    c = common.mapped(train.select("text"), count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    held = c.where(F.col("n") >= max(LEAST_DOCS, -(-n // LEAST_SHARE))).select("h").toArrow()["h"].to_numpy()
    return np.sort(held.view(np.uint64))


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each term: counted within tasks, then summed."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches):
        total, df = 0, np.zeros(len(sent.value), np.int64)
        for batch in batches:
            total += batch.num_rows
            if len(df):
                for _, _, data, off in tokens.chunks(batch.column(0)):
                    df += np.bincount(vectors(data, off, sent.value)[1], minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], total))], ["t", "n"])

    got = common.mapped(docs.select("text"), run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    t, n = got["t"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(len(vocabulary), np.int64)
    df[t[t >= 0]] = n[t >= 0]
    return int(n[t < 0].sum()), df


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_examples: int = MAX_EXAMPLES) -> Model:
    """The model of the labelled documents among docs."""
    docs = docs.select("doc_id", "text")
    y = common.cut(_train(docs, labels))
    if not common.is_small(y, max_train):  # labels of documents that are there
        y = common.cut(_sampled(common.cut(y.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")), F.xxhash64("id"), max_train))
    key = F.xxhash64("doc_id", "text")
    rows = docs.join(F.broadcast(y), docs["doc_id"] == y["id"]).select("doc_id", "text", "toxic").dropDuplicates(["doc_id", "text"])
    rows = common.keep(rows)
    train = _sampled(rows, key, max_train)  # y has max_train ids at most, but an id may have several texts
    train = train if train is rows else common.keep(train)
    vocabulary = _vocabulary(train)
    n, df = _frequencies(docs, vocabulary)
    idf = np.log((1 + n) / (1 + df.astype(float))) ** IDF_POWER + 1e-3
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches):
        for batch in batches:
            for a, b, data, off in tokens.chunks(batch.column(1)):
                ends, t, tf = vectors(data, off, sent.value)
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in (t, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), *lists], ["doc_id", "toxic", "terms", "tf"])

    known = _sampled(train, key, max_examples).select("doc_id", "text", "toxic")
    got = common.mapped(known, run, "doc_id long, toxic int, terms array<int>, tf array<int>").toArrow()
    sent.destroy()
    examples = []
    for c in got.to_batches():  # views of what was gathered
        (off, t), (_, tf) = ((c.column(k).offsets.to_numpy(), c.column(k).values.to_numpy()) for k in ("terms", "tf"))
        examples += [(i, t[a:b], tf[a:b], y) for i, y, a, b in zip(c["doc_id"].to_pylist(), c["toxic"].to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True)]
    examples.sort(key=lambda e: (len(e[1]) > 0, blake2b(e[1].tobytes() + e[2].tobytes(), digest_size=16).digest(), e[3], e[0]))
    none = [e[3] for e in examples if not len(e[1])]
    del examples[: len(none)]
    ids, labelled, size = ([e[0] for e in examples], [e[3] for e in examples], [len(e[1]) for e in examples])
    term, freq = (np.concatenate([np.zeros(0, np.int32), *(e[c] for e in examples)]) for c in (1, 2))
    t = tf = c = None
    examples.clear()
    del got
    pa.default_memory_pool().release_unused()
    model = Model.of(vocabulary, idf, ids, labelled, size, term, freq, none)
    del term, freq
    model.calibrate(_left_out(docs.sparkSession, model))
    return model


def _left_out(spark, model: Model) -> np.ndarray:
    n, held = len(model.place), spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            for i in range(0, len(at), TEXTS):
                part = at[i : i + TEXTS]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held.value.left_out(part), pa.float64())], ["place", "vote"])

    got = common.mapped(spark.range(0, n, 1, max(1, n // 500)), run, "place long, vote double").toArrow()
    held.destroy()
    return got["vote"].to_numpy()[np.argsort(got["place"].to_numpy())]


def _scored(model: Model, known: dict, text: pa.Array) -> list[tuple[float, list]]:
    """(score, evidence) of each text; equal vectors are scored once."""
    keys, new = [], {}
    if len(known) > KNOWN:
        known.clear()
    for _, _, data, off in tokens.chunks(text):
        ends, t, tf = vectors(data, off, model.vocabulary)
        for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            keys.append(blake2b(t[x:y].tobytes() + tf[x:y].tobytes(), digest_size=16).digest())
            if keys[-1] not in known:
                new[keys[-1]] = t[x:y], tf[x:y]
    known.update(zip(new, model.scores(list(new.values())), strict=True))
    return [known[k] for k in keys]


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id, tkey (hash of the text), held_out, score, predicted and evidence for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_train, max_examples))
    pair = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        known: dict = {}
        for batch in batches:
            got = _scored(sent.value, known, batch.column(2))
            near = [[{"doc_id": a, "cosine": b, "toxic": c} for a, b, c in e] for _, e in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s for s, _ in got], pa.float64()), pa.array(near, pair)], ["doc_id", "tkey", "score", "evidence"])

    out = common.mapped(docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text"), run, "doc_id long, tkey long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")
    return out.select("doc_id", "tkey", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; all columns stay. Rows are scored where they are: no join, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    text = docs.columns.index("text")

    def run(batches):
        known: dict = {}
        for batch in batches:
            yield batch.filter(pa.array([s < 0.5 for s, _ in _scored(sent.value, known, batch.column(text))], pa.bool_()))

    return common.mapped(docs, run, docs.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).drop("tkey")
