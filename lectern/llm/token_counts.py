"""Operator 10: token counts by trie-shared dynamic programming.

Texts are split at ASCII white space into pre-tokens, each with the mark U+2581 in front. The tokens of a pre-token are
its most likely split into pieces of a unigram model. Distinct pre-tokens are put into a trie (sorted, so that a
common prefix is one path), and the forward scores and piece counts of the best split are computed once per trie node,
level by level: a node's score is the best of its ancestors' up to the longest piece plus the piece between. The counts
at terminal nodes are stored, and a document's count is the sum over its pre-tokens.

The unigram model takes the pieces of a public vocabulary in their order of rank r and gives them Zipf's log
probability -log(r * H), H the harmonic number of their count; control, byte and white-space-only pieces are left out. A
character that is no piece is spelled in bytes, one token each, at the least score minus 10 a character.

Tries are built in the tasks, from the pre-tokens that a task has not met yet, so no pre-token is shuffled; each task
holds the counts of at most KNOWN distinct ones and starts anew beyond. Pre-tokens of more than LONG characters (text
without blanks) are put into tries by length, of at most CELLS characters; a few of them alone are scored one by one, with
the same result. No tokenizer is trained, so the scores are those of the public ranks, not of a corpus. Null and empty texts have no tokens. Repeated rows count alike, extra columns are
ignored, bytes that aren't UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, tokens

#: White-space words, case kept.
RAW = tokens.Words(tokens.SPACED.is_word.__getitem__)
RAW.value = np.where(RAW.is_word, tokens.mix(np.uint64(0x7654321) + np.arange(256, dtype=np.uint64)), np.uint64(0))
KNOWN, LONG, SHARD = 1 << 20, 64, 1 << 22
#: Characters of a trie of long pre-tokens; such of less than FEW are scored one by one.
CELLS, FEW = 1 << 19, 8
MARK = "▁"
_B = np.uint64(0x9E3779B97F4A7C15)


def read_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece vocabulary that can be part of a text, by rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return [p for p in text if p == MARK or p.strip(MARK)]


@lru_cache(2)
def _model(pieces: tuple[str, ...]) -> Unigram:
    """One model for all tasks of a worker."""
    return Unigram(pieces)


class Unigram:
    def __init__(self, pieces: list[str] | tuple[str, ...]):
        pieces = list(dict.fromkeys(pieces))
        total = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
        self.scores = {p: -math.log(r) - total for r, p in enumerate(pieces, 1)}
        self.unknown = min(self.scores.values(), default=0.0) - 10
        self.longest = max(map(len, self.scores), default=1)
        self.power = np.array([pow(int(_B), i, 1 << 64) for i in range(self.longest + 1)], np.uint64)
        keys = tokens.mix(np.array([self._hash(p) for p in self.scores], np.uint64))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(self.scores.values()))[order]
        assert (np.diff(self.keys) > 0).all(), "two pieces share a hash"
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.keys >> np.uint64(42)] = True

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_B) + ord(c) + 1) % (1 << 64)
        return (h + len(piece) * 0x51ED27) % (1 << 64)

    def one(self, word: str) -> int:
        """Tokens of one pre-token, without a trie."""
        best, n = [0.0], [0]
        for d in range(1, len(word) + 1):
            top, count = -math.inf, 0
            for k in range(1, min(d, self.longest) + 1):
                s = self.scores.get(word[d - k : d])
                if s is not None and best[d - k] + s > top:
                    top, count = best[d - k] + s, n[d - k] + 1
            if word[d - 1] not in self.scores and (x := best[d - 1] + self.unknown) > top:
                top, count = x, n[d - 1] + len(word[d - 1].encode("utf-8", "surrogatepass"))
            best.append(top)
            n.append(count)
        return n[-1]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of distinct pre-tokens (with their mark)."""
        out = np.zeros(len(words), np.int64)
        short = sorted(i for i, w in enumerate(words) if len(w) <= LONG)
        short.sort(key=words.__getitem__)
        for i in range(0, len(short), 1 << 14):
            part = short[i : i + (1 << 14)]
            out[part] = self._trie([words[j] for j in part])
        long = sorted((i for i, w in enumerate(words) if len(w) > LONG), key=lambda i: len(words[i]))
        while long:
            n = max(1, CELLS // len(words[long[-1]]))
            part, long = long[-n:], long[:-n]
            if len(part) < FEW:
                out[part] = [self.one(words[i]) for i in part]
            else:
                part.sort(key=words.__getitem__)
                out[part] = self._trie([words[i] for i in part])
        return out

    def _trie(self, words: list[str]) -> np.ndarray:
        """words: sorted. Forward pass over the levels of their trie."""
        size = np.array([len(w) for w in words])
        width = int(size.max())
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.zeros((len(words), width), np.uint32)
        cp[np.arange(width)[None, :] < size[:, None]] = flat
        fresh = np.ones((len(words), width), bool)  # the prefix of length d + 1 isn't the one of the word before
        fresh[1:] = ~np.logical_and.accumulate(cp[1:] == cp[:-1], axis=1)
        fresh &= np.arange(width)[None, :] < size[:, None]
        node = np.cumsum(fresh, axis=0, dtype=np.int32) - 1  # a word's node at each level, where it is that long
        zero = np.zeros(len(words), np.int32)
        best, count, prefix = [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)]
        total = np.zeros(len(words), np.int64)
        for d in range(1, width + 1):
            rep = np.flatnonzero(fresh[:, d - 1])
            up = lambda k: (node[rep, k - 1] if k else zero[: len(rep)])  # noqa: B023, E731
            h = prefix[d - 1][up(d - 1)] * _B + cp[rep, d - 1].astype(np.uint64) + np.uint64(1)
            top, n, single = np.full(len(rep), -np.inf), np.zeros(len(rep), np.int64), np.zeros(len(rep), bool)
            for k in range(1, min(d, self.longest) + 1):
                a = up(d - k)
                key = tokens.mix(h - prefix[d - k][a] * self.power[k] + np.uint64(k * 0x51ED27))
                hit = np.flatnonzero(self.seen[key >> np.uint64(42)])
                if not len(hit):
                    continue
                at = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
                ok = self.keys[at] == key[hit]
                hit, s = hit[ok], best[d - k][a[hit[ok]]] + self.values[at[ok]]
                if k == 1:
                    single[hit] = True
                better = s > top[hit]
                hit = hit[better]
                top[hit], n[hit] = s[better], count[d - k][a[hit]] + 1
            a = up(d - 1)
            s = np.where(single, -np.inf, best[d - 1][a] + self.unknown)
            bytes_ = 1 + (cp[rep, d - 1] >= 0x80) + (cp[rep, d - 1] >= 0x800) + (cp[rep, d - 1] >= 0x10000)
            n = np.where(s > top, count[d - 1][a] + bytes_, n)
            best.append(np.maximum(top, s))
            count.append(n)
            prefix.append(h)
            ends = np.flatnonzero(size == d)
            total[ends] = n[node[ends, d - 1]]
        return total


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """doc_id, n_chars, n_pretokens and n_tokens of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(pieces))

    def run(batches):
        model = _model(sent.value)
        keys, held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for a, b, data, off in tokens.chunks(batch.column(1), SHARD):
                starts, ends, h, first = tokens.words(data, off, RAW)
                u, at, back = np.unique(h, return_index=True, return_inverse=True)
                place = np.minimum(np.searchsorted(keys, u), max(0, len(keys) - 1))
                new = keys[place] != u if len(keys) else np.ones(len(u), bool)
                if new.any():
                    raw = data.tobytes()
                    words = [MARK + raw[x:y].decode("utf-8", "replace") for x, y in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
                    n = model.counts(words)
                    if len(keys) + len(n) > KNOWN:
                        old = ~new
                        keys, held = u[old], held[place[old]] if old.any() else held[:0]
                    keys, held = np.concatenate((keys, u[new])), np.concatenate((held, n))
                    order = np.argsort(keys)
                    keys, held = keys[order], held[order]
                own = held[np.searchsorted(keys, u)][back] if len(u) else np.zeros(0, np.int64)
                sums = np.concatenate(([0], np.cumsum(own)))
                cont = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(cont[off])), pa.array(np.diff(first)), pa.array(np.diff(sums[first]))], ["doc_id", "n_chars", "n_pretokens", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, n_pretokens long, n_tokens long")


def op10_token_counts(spark, sf_dir: str, vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    common.bound_batches(spark)
    return count_tokens(common.table(spark, sf_dir, "documents"), read_pieces(vocabulary))
