"""What rows carry along an ordered history, when the history of one reader is too long for one task.

A history is cut into blocks of its order. Each block says what it would carry on (its last value, its sum, or what it
makes of each state that it can be entered with), these are put together along the blocks, and each block is gone through
again with what it was entered with. So a long history is dealt out by its blocks; only one row a block meets in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Steps of a block of a history; milliseconds of a block of requests.
STEPS, MILLIS = 1 << 16, 1 << 22


def carried(df: DataFrame, by: list[str], block: str, order: list[str], last: dict[str, Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """df with, under each name of `last`, the last value that isn't null in the rows before, and under each name of
    `sums` the sum up to and with the row. `block` grows along the order."""
    sums = sums or {}
    d = df.withColumns({f"_v_{k}": c for k, c in {**last, **sums}.items()})
    w = W.partitionBy(*by, block).orderBy(*order)
    before, upto = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    within = {f"_w_{k}": F.last(f"_v_{k}", ignorenulls=True).over(before) for k in last} | {f"_w_{k}": F.sum(f"_v_{k}").over(upto) for k in sums}
    place = F.struct(*order)
    whole = [F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), place)).alias(f"_e_{k}") for k in last] + [F.sum(f"_v_{k}").alias(f"_e_{k}") for k in sums]
    blocks = W.partitionBy(*by).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    entered = d.groupBy(*by, block).agg(*whole)
    entered = entered.withColumns({f"_e_{k}": F.last(f"_e_{k}", ignorenulls=True).over(blocks) for k in last} | {f"_e_{k}": F.sum(f"_e_{k}").over(blocks) for k in sums})
    out = d.withColumns(within).join(entered, [*by, block])
    found = {k: F.coalesce(f"_w_{k}", f"_e_{k}") for k in last} | {k: F.coalesce(f"_w_{k}", F.lit(0)) + F.coalesce(f"_e_{k}", F.lit(0)) for k in sums}
    return out.withColumns(found).drop(*[f"_{x}_{k}" for x in "vwe" for k in found])


class Timers:
    """The requests of one block, in order, under a timer that runs `delay` and is started by the first request after it."""

    def __init__(self, at: np.ndarray, delay: int):
        self.at, self.delay = at, delay
        self.next = np.searchsorted(at, at + delay, "left")
        self.last = np.arange(len(at))
        for i in range(len(at) - 1, -1, -1):
            if self.next[i] < len(at):
                self.last[i] = self.last[self.next[i]]

    def exits(self, latest: int) -> tuple[list[int], list[int]]:
        """(up to which end of a timer that runs at entry, the end of the one that runs at exit), for entries to `latest`;
        a block that has no request after the entry's timer leaves it as it is."""
        n = min(len(self.at), int(np.searchsorted(self.at, latest, "left")) + 1)
        ends = self.at[self.last[:n]] + self.delay
        keep = np.flatnonzero(np.append(ends[1:] != ends[:-1], True))
        return self.at[keep].tolist(), ends[keep].tolist()

    def runs(self, due: int | None) -> np.ndarray:
        """For each request the end of the timer that it falls under, entered with one that ends at `due`, or none."""
        i = 0 if due is None else int(np.searchsorted(self.at, due, "left"))
        out = np.full(len(self.at), 0 if due is None else due)
        while i < len(self.at):
            out[i : self.next[i]] = self.at[i] + self.delay
            i = self.next[i]
        return out


def starts(f: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where the groups of an ordered frame start; nulls are one group."""
    new = np.zeros(len(f), bool)
    new[:1] = True
    for k in keys:
        v, before = f[k], f[k].shift()
        new[1:] |= (v.ne(before) & ~(v.isna() & before.isna())).to_numpy(bool)[1:]
    return np.flatnonzero(new)


def grouped(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Batches of ordered rows, cut anew so that none ends within a group, with the [from, to) of their groups."""
    kept: list[pd.DataFrame] = []

    def whole(f: pd.DataFrame):
        at = starts(f, keys).tolist()
        return f, list(zip(at, [*at[1:], len(f)]))

    for f in frames:
        if not len(f):
            continue
        at = int(starts(f, keys)[-1])
        if kept and (at or len(starts(pd.concat([kept[-1].iloc[-1:], f.iloc[:1]]), keys)) > 1):
            yield whole(pd.concat([*kept, f.iloc[:at]], ignore_index=True))
            kept = []
        elif at:
            yield whole(f.iloc[:at].reset_index(drop=True))
        kept.append(f.iloc[at:])
    if kept:
        yield whole(pd.concat(kept, ignore_index=True))


def timed(requests: DataFrame, delay: int, millis: int = MILLIS) -> DataFrame:
    """requests: queue, atMs, key. Each with firedMs: the end of the timer it falls under. Blocks that follow each other
    in a partition go through Python together, as most queues are short."""
    span, key = max(millis, delay), ["queue", "_block"]
    d = requests.where("atMs IS NOT NULL").withColumn("_block", F.expr(f"cast(floor(atMs / {span}) AS bigint)")).select(*key, "atMs", "key")
    d = d.repartition(*key)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, cuts in grouped(frames, key):
            at, block, out = f["atMs"].to_numpy(np.int64), f["_block"].to_numpy(), []
            for i, j in cuts:
                out.append(Timers(at[i:j], delay).exits(int(block[i]) * span + delay))
            first = [i for i, _ in cuts]
            yield pd.DataFrame({"queue": f["queue"].to_numpy()[first], "_block": block[first], "upto": [o[0] for o in out], "ends": [o[1] for o in out]})

    def along(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue, due = (), None
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if queue != (r.queue,):
                    queue, due = (r.queue,), None
                out.append(due)
                i = 0 if due is None else int(np.searchsorted(r.upto, due, "left"))
                due = int(r.ends[i]) if i < len(r.ends) else due
            yield f[key].assign(due=pd.array(out, "Int64"))

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, cuts in grouped(frames, key):
            at, fired = f["atMs"].to_numpy(np.int64), np.empty(len(f), np.int64)
            due, known = f["due"].fillna(0).to_numpy(np.int64), f["due"].notna().to_numpy()
            for i, j in cuts:
                fired[i:j] = Timers(at[i:j], delay).runs(int(due[i]) if known[i] else None)
            yield f[["queue", "atMs", "key"]].assign(firedMs=fired)

    maps = d.sortWithinPartitions(*key, "atMs").mapInPandas(summed, "queue string, _block long, upto array<long>, ends array<long>")
    entered = maps.repartition("queue").sortWithinPartitions(*key).mapInPandas(along, "queue string, _block long, due long")
    entered = entered.select(F.col("queue").alias("_q"), F.col("_block").alias("_b"), "due")
    both = d.join(entered, (F.col("queue").eqNullSafe(F.col("_q"))) & (F.col("_block") == F.col("_b")), "left").drop("_q", "_b")
    return both.repartition(*key).sortWithinPartitions(*key, "atMs", "key").mapInPandas(again, "queue string, atMs long, key string, firedMs long")
