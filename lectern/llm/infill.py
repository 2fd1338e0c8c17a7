"""Operator 13: fill-in-the-middle transformation by a table-driven byte automaton.

One table has, for each state and byte, the next state and what the transition emits: the start of a unit (a code point)
or the end of a sentinel. A state says how many continuation bytes are due and which sentinel has begun. It depends on
the last WARM bytes alone, so a text is cut into lanes that are scanned side by side, each from WARM bytes earlier on;
what the transitions emit is counted by lane. A second pass walks again only through the two lanes of each text that hold
its cuts, and finds their bytes.

Cuts and forms follow from the SHA-256 of seed and doc_id, so reruns and copies of a row agree. A text that holds a
sentinel, or that the draw leaves out, stays plain. No join, no shuffle: a row is transformed where it is, in pieces of
bounded size however long it is.

Null is an empty text: plain, empty output. A null doc_id is drawn as an empty one. Repeated rows get the same result.
Extra columns are passed on; a column that has the name of a result gives way to it. A byte that no UTF-8 text holds
there counts as a unit of its own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

#: Marks of the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of the texts that stay plain, and of the others that have the suffix first.
PLAIN, SPM, SEED = 10, 20, "1"
#: Bytes of a lane; lanes scanned side by side.
LANE, LANES = 256, 2048
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")
#: Symbol of a lane's places outside its text; what a transition emits at the start of a unit and the end of a sentinel.
PAD, UNIT, SENTINEL = 256, 1, 1 << 16


class Automaton:
    """The table for some sentinels. A state is (continuation bytes due, begun sentinel)."""

    def __init__(self, sentinels: tuple[bytes, ...]):
        begun = {s[:k] for s in sentinels for k in range(len(s))}

        def after(state: tuple[int, bytes], byte: int) -> tuple[tuple[int, bytes], int]:
            due, seen = state
            inner, seen = due and 0x80 <= byte < 0xC0, seen + bytes([byte])
            emits = (0 if inner else UNIT) + SENTINEL * any(seen.endswith(s) for s in sentinels)
            while seen not in begun:
                seen = seen[1:]
            return (due - 1 if inner else 0 if byte < 0xC0 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3 if byte < 0xF8 else 0, seen), emits

        number, next_, emit = {(0, b""): 0}, [], []
        for state in (order := [(0, b"")]):
            row = []
            for byte in range(256):
                to, emits = after(state, byte)
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
                emit.append(emits)
            next_ += [*row, number[state]]
            emit.append(0)
        self.next = np.array(next_, np.int32) * (PAD + 1)  # the place of a state's row in the table
        self.emit = np.array(emit, np.int32)
        self.warm = max(4, *(len(s) for s in sentinels))


def _lanes(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each lane, its row, first lane of each row and the total)."""
    per = -(-np.diff(off) // LANE)
    first = np.concatenate(([0], np.cumsum(per)))
    row = np.repeat(np.arange(len(per)), per)
    return off[row] + (np.arange(len(row)) - first[row]) * LANE, row, first


def _walk(table: Automaton, data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, target: np.ndarray | None = None) -> np.ndarray:
    """What the lanes from `at` of texts [lo, hi) emit in all; with a target, the place in each lane of its unit of that
    number (from 0)."""
    out = np.zeros(len(at), np.int64)
    for b in range(0, len(at), LANES):
        s = slice(b, b + LANES)
        place = at[s] + np.arange(-table.warm, LANE)[:, None]
        symbol = np.where((place >= lo[s]) & (place < hi[s]), data[np.clip(place, 0, len(data) - 1)].astype(np.int32), np.int32(PAD))
        state, count, found = np.zeros(len(at[s]), np.int32), np.zeros(len(at[s]), np.int32), np.zeros(len(at[s]), np.int64)
        for col in symbol[: table.warm]:
            state = table.next[state + col]
        for j, col in enumerate(symbol[table.warm :]):
            cell = state + col
            emitted, state = table.emit[cell], table.next[cell]
            if target is not None:
                found[(emitted & UNIT == UNIT) & (count & (SENTINEL - 1) == target[s])] = j
            count += emitted
        out[s] = count if target is None else found
    return out


class Scan:
    """The counts of a chunk of texts: units of each, whether it holds a sentinel; locate() is the second pass."""

    def __init__(self, table: Automaton, data: np.ndarray, off: np.ndarray):
        self.table, self.data, self.off = table, data, off
        self.at, self.row, self.first = _lanes(off)
        counts = _walk(table, data, self.at, off[self.row], off[self.row + 1])
        self.units = np.concatenate(([0], np.cumsum(counts & (SENTINEL - 1))))
        ends = np.concatenate(([0], np.cumsum(counts >> 16)))
        self.n = self.units[self.first[1:]] - self.units[self.first[:-1]]
        self.marked = ends[self.first[1:]] > ends[self.first[:-1]]

    def locate(self, rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The byte, in the chunk, at which unit `cut` of each row begins; the row's end for its number of units."""
        out = self.off[rows + 1].copy()
        inner = np.flatnonzero(cuts < self.n[rows])
        rows, unit = rows[inner], self.units[self.first[rows[inner]]] + cuts[inner]
        lane = np.searchsorted(self.units, unit, "right") - 1
        out[inner] = self.at[lane] + _walk(self.table, self.data, self.at[lane], self.off[rows], self.off[rows + 1], unit - self.units[lane])
        return out


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four unsigned numbers of 32 bits from the SHA-256 of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, plain: int = PLAIN, spm: int = SPM, seed: str = SEED) -> DataFrame:
    """docs with n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.
    A sentinel's first character stands nowhere else in any, and none begins another: so none arises where parts meet."""
    if any(s[:1] in t[1:] or s != t and t.startswith(s) for s in sentinels for t in sentinels) or len(set(sentinels)) < 3:
        raise ValueError("sentinels that could arise where parts of a text meet")
    kept = docs.drop(*RESULTS)
    names = [common.free(f"draw{k}", kept) for k in range(4)]
    df = kept.withColumns({k: c for k, c in zip(names, draws(F.col("doc_id"), seed), strict=True)})
    marks = tuple(s.encode() for s in sentinels)
    p, s, m = marks
    own = kept.columns

    def run(batches):
        table = Automaton(marks)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            drawn = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in names]
            for a, b, data, off in tokens.chunks(text):
                scan = Scan(table, data, off)
                h1, h2, h3, h4 = (x[a:b] for x in drawn)
                one, two = h1 % (scan.n + 1), h2 % (scan.n + 1)
                cut, end = np.minimum(one, two), np.maximum(one, two)
                whole = (scan.n == 0) | scan.marked | (h3 % 100 >= 100 - plain)
                rows = np.flatnonzero(~whole)
                x, y = off[:-1].copy(), off[:-1].copy()
                x[rows], y[rows] = scan.locate(rows, cut[rows]), scan.locate(rows, end[rows])
                form = np.where(whole, "plain", np.where(h4 % 100 < spm, "spm", "psm"))
                out = []
                for i, kind in enumerate(form.tolist()):
                    pre, mid, suf = data[off[i] : x[i]].tobytes(), data[x[i] : y[i]].tobytes(), data[y[i] : off[i + 1]].tobytes()
                    out.append(suf if kind == "plain" else b"".join((s, suf, p, pre, m, mid) if kind == "spm" else (p, pre, s, suf, m, mid)))
                cols = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in own]
                new = [pa.array(scan.n), pa.array(form.tolist(), pa.string()), pa.array(cut, mask=whole), pa.array(end - cut, mask=whole), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols + new, [*own, *RESULTS])

    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.BinaryType()]
    schema = T.StructType([*kept.schema.fields, *(T.StructField(k, t) for k, t in zip(RESULTS, kinds, strict=True))])
    return common.mapped(df, run, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that fill_in_middle() made an output of: only its own sentinels are in one that isn't plain."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    joined = lambda *order: F.concat(*[F.get(parts, k) for k in order])
    return F.when(form == "plain", output).when(form == "psm", joined(1, 3, 2)).otherwise(joined(2, 3, 1))


def op13_infill(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    r AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS one, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS two, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
    f AS (SELECT *, least(one, two) AS c, greatest(one, two) AS e, CASE WHEN n = 0 OR h3 >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
    p AS (SELECT *, substring(text, 1, c) AS pre, substring(text, c + 1, e - c) AS mid, substring(text, e + 1, n - e) AS suf FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN c END AS prefix_chars, CASE WHEN form <> 'plain' THEN e - c END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
