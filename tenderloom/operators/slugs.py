"""Unique slugs by gaps: which suffixes are free is settled by counts, never by walking through rows.

Rows of a base take ``base``, ``base-2``, ``base-3`` … in order. A name ``q-m`` has two claimants only: the m-th name of base ``q``, and the first
row of the base that is itself called ``q-m``. So what one base takes from another is told by pairs (m, how many rows of q come before the
first row of q-m). A scan over those pairs of a base, in order of m, yields the suffixes it must skip; its i-th row then has suffix i plus the
skips up to there. Both counts are running totals over ranges of the order, whose sizes are added up: neither a name that all rows
share nor a family of names lies in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import counted, stored

#: A name with a suffix: the base that it could be a later name of, and the number.
_SUFFIXED = r"^(.*)-([2-9]|[1-9][0-9]+)$"


def running_total(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the total of ``value`` over the rows of the same ``by`` up to each, in two levels: inside ranges of the whole
    order, and over the ranges before."""
    ranged = stored(rows.withColumn("_v", value).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy(*by, "_part").agg(F.sum("_v").alias("_size")).select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.sum("_v").over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.join(starts, [*by, "_part"]).withColumn(name, within + F.col("_start")).drop("_v", "_part", "_start")


def scan(pairs: pd.DataFrame) -> pd.DataFrame:
    """Of one base's pairs (k, before), in order of k: which suffixes are skipped, and from which row on.

    Suffix k is skipped if the base has not come to it by then: fewer rows and skips before than k.
    """
    pairs = pairs.sort_values(["k", "before"])
    skipped, froms, held = 0, [], []
    last = None
    for k, before in zip(pairs["k"], pairs["before"], strict=True):
        again = k == last and held[-1]  # a name that is taken for two reasons is skipped once
        skip = not again and before + skipped < k
        held.append(again or skip)
        froms.append(k - skipped if skip else None)
        skipped += skip
        last = k
    return pairs.assign(held=held, row=pd.array(froms, "Int64"))


def unique_slugs(rows: DataFrame, slug: str, order: list[str], taken: DataFrame | None = None) -> DataFrame:
    """``rows`` with unique_slug: base, base-2, base-3 … in order of creation, the first that neither ``taken`` (slug) nor an earlier row has.

    ``order`` must tell the rows apart. A null base has a null slug.
    """
    spark = rows.sparkSession
    known = rows.where(F.col(slug).isNotNull())
    bases = stored(known.groupBy(F.col(slug).alias("base")).agg(F.min(F.struct(*order)).alias("first")), "bases")
    suffixed = lambda df, c: df.withColumns({"q": F.regexp_extract(c, _SUFFIXED, 1), "m": F.regexp_extract(c, _SUFFIXED, 2).try_cast("long")}).where("m is not null")
    parents = bases.select(F.col("base").alias("q"))
    edges, n_edges = counted(suffixed(bases, F.col("base")).join(parents, "q", "left_semi"), "edges")
    used = taken.select(F.col("slug").alias("base")).distinct() if taken is not None else spark.createDataFrame([], "base string")
    # suffixes of a base that stored rows have, the first included
    fixed = used.join(bases, "base", "left_semi").select("base", F.lit(1).cast("long").alias("k"))
    fixed = stored(fixed.unionByName(suffixed(used, F.col("base")).join(parents, "q", "left_semi").select(F.col("q").alias("base"), F.col("m").alias("k"))), "fixed")

    mine = known.select(F.col(slug).alias("base"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rows.columns).alias("row"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("m"), F.lit(None).cast("string").alias("child"))
    marks = edges.select(F.col("q").alias("base"), *[F.col(f"first.{c}").alias(f"o{i}") for i, c in enumerate(order)], F.lit(None).cast(mine.schema["row"].dataType).alias("row"), F.lit(1).alias("kind"), "m", F.col("base").alias("child"))
    counts = running_total(mine.unionByName(marks), ["base"], [f"o{i}" for i in range(len(order))] + ["kind"], 1 - F.col("kind"), "i")
    counts = stored(counts, "counts")
    pairs = stored(counts.where("kind = 1").select("base", F.col("m").alias("k"), F.col("i").alias("before"), "child"), "pairs")

    plain = "base string, k long, before long, child string, held boolean, row long"
    settle = lambda df: stored(df.groupBy("base").applyInPandas(lambda g: scan(g)[["base", "k", "before", "child", "held", "row"]], plain), "skips")
    always = fixed.select("base", "k", F.lit(0).cast("long").alias("before"), F.lit(None).cast("string").alias("child"))
    lost = spark.createDataFrame([], "base string")
    done = None
    # bases whose first name a parent may take wait for that parent; as deep as names have suffixes that are bases too
    waiting = pairs.select("base").distinct()
    ready = waiting.join(edges.select("base"), "base", "left_anti")
    while n_edges:
        ready, n = counted(ready, "ready")
        if not n:
            break
        first = lost.join(ready, "base", "left_semi").select("base", F.lit(1).cast("long").alias("k"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("string").alias("child"))
        now = settle(pairs.unionByName(always).join(ready, "base", "left_semi").unionByName(first))
        done = now if done is None else done.unionByName(now)
        gone = now.where("child is not null and not held").select(F.col("child").alias("base"))
        lost = lost.unionByName(gone)
        ready = now.where("child is not null").select(F.col("child").alias("base")).join(waiting, "base", "left_semi")
    # bases without such pairs: what is taken, and a first name that a parent took
    rest = always.unionByName(lost.select("base", F.lit(1).cast("long").alias("k"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("string").alias("child"))).join(waiting, "base", "left_anti")
    last = settle(rest)
    skips = (last if done is None else done.unionByName(last)).where("row is not null").select("base", F.col("row").alias("i"), F.lit(0).alias("kind"), F.lit(None).cast(mine.schema["row"].dataType).alias("row"))
    numbered = counts.where("kind = 0").select("base", "i", F.lit(1).alias("kind"), "row").unionByName(skips)
    shifted = running_total(numbered, ["base"], ["i", "kind"], 1 - F.col("kind"), "shift").where("kind = 1")
    n = F.col("i") + F.col("shift")
    name = F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string")))
    out = shifted.select("row.*", name.alias("unique_slug"))
    return out.unionByName(rows.where(F.col(slug).isNull()).withColumn("unique_slug", F.lit(None).cast("string")))
