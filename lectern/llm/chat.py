"""Operator 2: chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of the turns that carry loss are
intersected with the sorted token spans by binary search. Token spans are taken as a tiling (each token from the end of
the one before to its own end), so white space that a tokenizer leaves out of its offsets, and characters of several
tokens, belong to exactly one span in the mask; a token across a turn's edge is cut at the edge.

Template: each turn is <s>[INST]role[/INST]text</s>. In roles and texts a backslash is doubled and every control string
gets a backslash after its first character, so none of them can occur there; unescape() reverses this exactly.

Rows are ordered by turn, then role and text, null first. Null roles and texts are empty strings; a null conv_id is a
conversation of its own; repeated rows are turns of their own; extra columns are ignored; empty conversations don't
exist, so an empty table gives no rows. A conversation is one row of the result and is built in one task: its length is
the only bound on what a task holds.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The control strings of the template.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
#: Fixed value: how texts are split before the merges of the public byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the escaped assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[INST]{escape(role)}[/INST]", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _tiled(ends: np.ndarray, length: int, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts and ends of tokens as a tiling of the text, for each span its first token and the one behind its last)."""
    ends = np.maximum.accumulate(ends) if len(ends) else ends
    if len(ends):
        ends[-1] = max(ends[-1], length)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return starts, ends, np.searchsorted(ends, spans[:, 0], "right"), np.searchsorted(starts, spans[:, 1], "left")


def mask(offsets: list[tuple[int, int]], length: int, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """(1 for each token under the loss, for each span the pieces of it that tokens cover)."""
    starts, ends, first, last = _tiled(np.array([e for _, e in offsets], int), length, np.array(spans, int).reshape(-1, 2))
    loss, pieces = np.zeros(len(ends), np.int8), []
    for (a, b), i, j in zip(spans, first.tolist(), last.tolist(), strict=True):
        own = [(max(a, int(starts[t])), min(b, int(ends[t]))) for t in range(i, j)]
        loss[i:j] |= np.array([y > x for x, y in own], np.int8) if own else 0
        pieces.append([(x, y) for x, y in own if y > x])
    return loss, pieces


def covered(ends: np.ndarray, length: int, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """mask() with each span's pieces, which touch, as one: (loss, what tokens cover of each span that isn't empty)."""
    starts, ends, first, last = _tiled(ends, length, np.array(spans, int).reshape(-1, 2))
    loss = np.zeros(len(ends) + 1, np.int8)
    some = [(i, j, a, b) for i, j, (a, b) in zip(first.tolist(), last.tolist(), spans, strict=True) if j > i and b > a]
    for i, j, _, _ in some:
        loss[i:j] = 1
    loss = loss[:-1] & (ends > starts)
    return loss, [(max(a, int(starts[i])), min(b, int(ends[j - 1]))) for i, j, a, b in some]


@lru_cache(1)
def encoder(content: str) -> Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]]:
    """(token ids, place in the text behind each token) of texts, by a tokenizers file (JSON) or by byte ranks, one base64
    token and rank a line."""
    if content.lstrip().startswith("{"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(content)
        t.encode_special_tokens = True
        return lambda texts: [(np.array(e.ids, np.int32), np.array([y for _, y in e.offsets], int)) for e in t.encode_batch(texts, add_special_tokens=False)]
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, content.splitlines()) if token}
    t = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = [len(token) for token in ranks]

    def one(text):
        ids = np.array(t.encode_ordinary(text), np.int32)
        begun = np.concatenate(([0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)))
        return ids, begun[np.cumsum(size[ids])]  # a character belongs to the token with its first byte

    return lambda texts: [one(x) for x in texts]


def grouped(conversations: DataFrame) -> DataFrame:
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind)))


def format_chats(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, formatted, spans (of loss-carrying texts), ids and loss (0/1 of each token). tokenizer: the content of
    a tokenizers file or of a list of byte ranks, sent to the executors."""
    sent = conversations.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches):
        encode = encoder(sent.value)
        span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                part = batch.slice(i, 32)
                chats = [render([(x["role"], x["text"]) for x in turns]) for turns in part.column(1).to_pylist()]
                encoded = encode([c for c, _ in chats])
                masks = [covered(ends, len(c), s) for (_, ends), (c, s) in zip(encoded, chats, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([c for c, _ in chats], pa.string()),
                        pa.array([[{"from": a, "to": b} for a, b in own] for _, own in masks], span),
                        _lists([ids for ids, _ in encoded], np.int32),
                        _lists([m for m, _ in masks], np.int8),
                    ],
                    ["conv_id", "formatted", "spans", "ids", "loss"],
                )

    return common.mapped(grouped(conversations), run, "conv_id long, formatted string, spans array<struct<from:int,to:int>>, ids array<int>, loss array<byte>")


def read_back(chats: DataFrame) -> DataFrame:
    """What the formatted conversations hold: digests of their turns and of the text under the loss."""

    def run(batches):
        for batch in batches:
            n, sha, chars, loss_sha, size = [], [], [], [], []
            loss = batch.column(4)
            sums = np.concatenate(([0], np.cumsum(loss.values.to_numpy(), dtype=np.int64)))[loss.offsets.to_numpy()]
            for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(formatted)
                n.append(len(turns))
                sha.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                under = "".join(unescape(formatted[s["from"] : s["to"]]) for s in spans)
                chars.append(len(under))
                loss_sha.append(hashlib.sha256(under.encode()).hexdigest())
                size.append(len(formatted))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(size, pa.int64()), pa.array(np.diff(sums))]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "loss_tokens"])

    return common.mapped(chats, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, loss_tokens long")


def op2_chat_formatting(spark, sf_dir: str, tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    own = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    with open(tokenizer) as f:  # a driver-side parameter, not a table
        return read_back(format_chats(own, f.read()))
