"""Positions of regular-expression matches as DataFrame columns, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 256


def _running_block(values: Column, start: Column) -> Column:
    zero = F.struct(start.alias("s"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))
    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def running(values: Column) -> Column:
    """The sum of what stands before each element of an array<int>.

    Two levels of blocks: the work grows as the length times the block size, not as its square.
    """
    count = F.ceil(F.size(values) / F.lit(_BLOCK)).cast("int")
    blocks = F.transform(F.filter(F.sequence(F.lit(0), count), lambda b: b < count), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, _running_block(totals, F.lit(0)), _running_block))


def with_spans(df: DataFrame, text: str, found: dict[str, str], needs: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with one column per pattern: array of (s, e, m): start, end (code points, end exclusive) and text of each
    leftmost, non-overlapping match. The gaps between matches come from split(), their lengths give the places. needs: by
    pattern, what holds for every text with a match; other texts are not searched."""
    none = F.array().cast("array<string>")
    steps = {f"_m_{k}": F.when((needs or {}).get(k, F.lit(True)), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in found.items()}
    df = df.withColumns(steps)
    gaps = {f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.transform(F.split(text, p, -1), lambda x: F.length(x))).otherwise(F.array().cast("array<int>")) for k, p in found.items()}
    df = df.withColumns(gaps)
    spans = {}
    for k in found:
        m, g = F.col(f"_m_{k}"), F.col(f"_g_{k}")
        before = running(F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, b: a + F.length(b)))
        start = F.zip_with(before, F.slice(g, F.lit(1), F.size(m)), lambda a, b: a + b)
        spans[k] = F.when(F.size(m) > 0, F.zip_with(start, m, lambda s, x: F.struct(s.alias("s"), (s + F.length(x)).alias("e"), x.alias("m")))).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))
    return df.withColumns(spans).drop(*steps, *gaps)
