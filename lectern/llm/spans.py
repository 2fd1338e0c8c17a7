"""Pattern spans in code points, with DataFrame functions only.

Spark gives the matches of a pattern but not their places; those follow from the matches and the gaps between them
(split by the same pattern), whose lengths are summed along the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string,before:array<string>,after:array<string>>"


def lit(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else 'r"' + pattern + '"' if '"' not in pattern else _plain(pattern)


def _plain(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Numbers summed by one fold; folds append to arrays, which copies them.
BLOCK = 128


def before(sizes: str) -> str:
    """SQL: for each number of an array that has some, the sum of those before it. Blocks of BLOCK, so its time is linear."""
    fold = "aggregate({over}, named_struct('at', 0, 'out', cast(array() AS array<int>)), (s, x) -> named_struct('at', s.at + {x}, 'out', array_append(s.out, s.at)), s -> s.out)"
    blocks = f"transform(sequence(0, (size({sizes}) - 1) div {BLOCK}), b -> slice({sizes}, cast(b * {BLOCK} + 1 AS int), {BLOCK}))"
    first = fold.format(over="bs", x="aggregate(x, 0, (t, y) -> t + y)")
    both = f"transform(array({blocks}), bs -> named_struct('bs', bs, 'first', {first}))"
    return f"flatten(transform({both}, p -> flatten(transform(p.bs, (b, i) -> transform({fold.format(over='b', x='x')}, y -> y + p.first[i])))))"


def places(df: DataFrame, m: str, g: str, out: str) -> DataFrame:
    """Adds the column `out`: where each match of the array m begins, from the gaps g before, between and behind them."""
    own = F.expr(f"CASE WHEN size({m}) > 0 THEN transform({m}, (x, i) -> length({g}[i]) + length(x)) END").alias(f"{out}_")
    df = df.select("*", own)
    ends = F.expr(f"CASE WHEN size({m}) > 0 THEN transform({before(f'{out}_')}, (x, i) -> x + length({g}[i])) END")
    return df.select(*[c for c in df.columns if c != f"{out}_"], ends.alias(out))


def find(df: DataFrame, text: str, kinds: list[tuple[str, str, str]], words: tuple[str, int] | None = None) -> DataFrame:
    """Adds one column for each (name, pattern, cheap SQL condition without which there is no match): the array of
    leftmost non-overlapping matches. With words (pattern, n) each has the n nearest words, in lower case, before and after
    it in the whole text, in the order of the text. text isn't null. Time is linear in the matches of a text."""
    kept = df.columns
    for name, pattern, may in kinds:
        df = df.withColumn(f"_m_{name}", F.expr(f"CASE WHEN {may} THEN regexp_extract_all({text}, {lit(pattern)}, 0) ELSE cast(array() AS array<string>) END"))
    df = df.select("*", *[F.expr(f"CASE WHEN size(_m_{n}) > 0 THEN split({text}, {lit(p)}, -1) END").alias(f"_g_{n}") for n, p, _ in kinds])
    none = "cast(array() AS array<string>)"
    cols = []
    for n, _, _ in kinds:
        df = places(df, f"_m_{n}", f"_g_{n}", f"_s_{n}")
        near, far = none, none
        if words:
            # the words of gaps and matches in one array, and how many of them come before each match
            said = lambda x: f"regexp_extract_all(lower({x}), {lit(words[0])}, 0)"  # noqa: B023, E731
            df = df.select("*", F.expr(f"CASE WHEN size(_m_{n}) > 0 THEN transform(_g_{n}, (x, i) -> named_struct('g', {said('x')}, 'm', CASE WHEN i < size(_m_{n}) THEN {said(f'_m_{n}[i]')} ELSE {none} END)) END").alias(f"_w_{n}"))
            df = df.select("*", F.expr(f"flatten(transform(_w_{n}, x -> concat(x.g, x.m)))").alias(f"_a_{n}"), F.expr(f"transform(_w_{n}, x -> size(x.g) + size(x.m))").alias(f"_c_{n}"))
            df = df.select("*", F.expr(f"CASE WHEN size(_m_{n}) > 0 THEN transform({before(f'_c_{n}')}, (x, i) -> x + size(_w_{n}[i].g)) END").alias(f"_b_{n}"))
            near = f"slice(_a_{n}, greatest(1, _b_{n}[i] - {words[1] - 1}), least(_b_{n}[i], {words[1]}))"
            far = f"slice(_a_{n}, _b_{n}[i] + size(_w_{n}[i].m) + 1, {words[1]})"
        cols.append(F.expr(f"CASE WHEN size(_m_{n}) > 0 THEN transform(_m_{n}, (x, i) -> named_struct('start', _s_{n}[i], 'end', _s_{n}[i] + length(x), 'value', x, 'before', {near}, 'after', {far})) ELSE cast(array() AS array<{SPAN}>) END").alias(n))
    return df.select(*kept, *cols)


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(d: str) -> str:
    """SQL: the digits d pass Luhn's check."""
    x = f"cast(substr({d}, i, 1) AS int)"
    return f"aggregate(sequence(1, length({d})), 0, (u, i) -> u + CASE WHEN (length({d}) - i) % 2 = 0 THEN {x} WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END) % 10 = 0"


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
