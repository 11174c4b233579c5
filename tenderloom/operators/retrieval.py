"""Hybrid retrieval: dense top-k, weighted text top-k, reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_splits

ZONES = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
def postings(tenders: DataFrame, zones: dict[str, str]) -> DataFrame:
    """(tender_id, zone, pos, term) of the columns in ``zones`` (column -> zone)."""
    each = [tenders.select("tender_id", F.lit(z).alias("zone"), F.posexplode(word_splits(F.coalesce(F.col(c), F.lit("")))).alias("pos", "term")) for c, z in zones.items()]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def _runs(words: Column, n: int) -> Column:
    """All runs of n words, joined by blanks."""
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def phrase_hits(tenders: DataFrame, zones: dict[str, str], phrases: DataFrame) -> DataFrame:
    """(phrase, tender_id, zone): a row for each place where a phrase stands. phrases: (phrase, words).

    For each length that a phrase has, every run of so many words of a zone is known by two 64-bit fingerprints; these meet the
    phrases' fingerprints in one equi-join, and what meets is compared by its words. So nothing is joined that is not an
    occurrence (up to hashes of 128 bits), however frequent the words in it are. The lengths of phrases, not phrases, come to the driver.
    """
    lengths = sorted(r[0] for r in phrases.select(F.size("words")).distinct().collect())
    prints = lambda c: (F.xxhash64(c).alias("_k1"), F.xxhash64(F.lit(1), c).alias("_k2"))
    wanted = phrases.select("phrase", *prints(F.col("phrase")))
    each = []
    for c, z in zones.items():
        words = tenders.select("tender_id", word_splits(F.coalesce(F.col(c), F.lit(""))).alias("ws"))
        each.append(words.select("tender_id", F.lit(z).alias("zone"), F.explode(F.concat(*[_runs(F.col("ws"), n) for n in lengths])).alias("run")))
    runs = each[0]
    for e in each[1:]:
        runs = runs.unionByName(e)
    return runs.select("*", *prints(F.col("run"))).join(wanted, ["_k1", "_k2"]).where("run = phrase").select("phrase", "tender_id", "zone")


def text_topk(queries: DataFrame, tenders: DataFrame, zones: dict[str, str], k: int = 60) -> DataFrame:
    """(tenant_id, tender_id, rank, pos): tenders by weighted occurrences of any of a tenant's terms.

    queries: (tenant_id, term); a term of several words is a phrase: its words at consecutive positions of a zone.
    rank = s / (s + 1), s the zone weights over all occurrences. Ties: later published_at, then id. Postings of single words are
    cut to the queries' vocabulary before anything is shuffled, and summed per tender on the map side; phrases of several
    words are found by fingerprints of runs.
    """
    asked = queries.select("tenant_id", word_splits(F.col("term")).alias("words")).where("size(words) > 0").distinct()
    asked = asked.withColumn("phrase", F.array_join("words", " "))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), F.col("zone"))
    parts = []
    words = asked.where("size(words) = 1").select("phrase").distinct()
    if not words.isEmpty():
        found = postings(tenders, zones).withColumnRenamed("term", "phrase").join(words, "phrase", "left_semi")
        parts.append(found.groupBy("phrase", "tender_id").agg(F.sum(weight).alias("s")))
    phrases = asked.where("size(words) > 1").select("phrase", "words").distinct()
    if not phrases.isEmpty():
        hits = phrase_hits(tenders, zones, phrases)
        parts.append(hits.groupBy("phrase", "tender_id").agg(F.sum(weight).alias("s")))
    if not parts:
        return queries.sparkSession.createDataFrame([], "tenant_id long, tender_id long, rank double, pos int")
    by_phrase = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    scores = by_phrase.join(asked.select("tenant_id", "phrase"), "phrase").groupBy("tenant_id", "tender_id").agg(F.sum("s").alias("s"))
    ranked = scores.join(tenders.select("tender_id", "published_at"), "tender_id").select("tenant_id", "tender_id", F.round(F.col("s") / (F.col("s") + 1), 9).alias("rank"), "published_at")
    order = Window.partitionBy("tenant_id").orderBy(F.desc("rank"), F.desc("published_at"), "tender_id")
    return ranked.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).drop("published_at")


def rrf_fuse(dense: DataFrame, text: DataFrame, k: int = 60, limit: int = 40) -> DataFrame:
    """(tenant_id, tender_id, score, pos, dense_similarity, text_rank, sources) of two ranked lists.

    score = sum of 1 / (k + pos); ties: position in the first list that holds the item, dense before text, then id.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    d = dense.select("tenant_id", "tender_id", F.col("pos").alias("dp"), "distance")
    t = text.select("tenant_id", "tender_id", F.col("pos").alias("tp"), F.col("rank").alias("text_rank"))
    both = d.join(t, ["tenant_id", "tender_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", part("dp") + part("tp"))
    order = Window.partitionBy("tenant_id").orderBy(F.desc(F.round("score", 12)), F.coalesce("dp", "tp"), F.col("dp").isNull(), "tender_id")
    sources = F.array_compact(F.array(F.when(F.col("dp").isNotNull(), F.lit("dense")), F.when(F.col("tp").isNotNull(), F.lit("text"))))
    out = both.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)
    return out.select("tenant_id", "tender_id", "score", "pos", clamp_similarity(F.col("distance")).alias("dense_similarity"), "text_rank", sources.alias("sources"))


def clamp_similarity(distance):
    """1 - distance within 0 and 1; null stays null, what is not finite is 0."""
    s = F.lit(1.0) - distance
    return F.when(distance.isNull(), F.lit(None)).when(F.isnan(s) | (F.abs(s) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


#: Partial sums that one task of a merge adds up for a group, and bytes of sums that a task holds before it hands them on.
FAN, HELD = 256, 64 << 20


def _pooled(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.RecordBatch]:
    """(part, by, wx, x, w, n) of rows (by, w, v): the sums of each group over all batches of the task, handed on when they grow large."""
    from pyspark import TaskContext

    part, sums, size = TaskContext.get().partitionId(), {}, 0

    def out() -> pa.RecordBatch:
        keys, parts = list(sums), list(sums.values())
        lists = [pa.array([p[k] for p in parts], pa.list_(pa.float64())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int64()), pa.array([k for k, _ in keys], kind), *lists, pa.array([float(p[2]) for p in parts]), pa.array([int(p[3]) for p in parts], pa.int64())], ["part", by, "wx", "x", "w", "n"])

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        w = batch.column(1).to_numpy(zero_copy_only=False)
        if (w < 0).any():
            raise ValueError("negative weight")
        length = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
        for n in np.unique(length):
            rows = batch.filter(pa.array(length == n))
            x, w = rows.column(2).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, int(n)), rows.column(1).to_numpy(zero_copy_only=False)
            group = rows.column(0).dictionary_encode(null_encoding="encode")
            at = group.indices.to_numpy()
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            wx, plain, ws, ns = (np.add.reduceat(v[order], starts, axis=0) for v in (x * w[:, None], x, w, np.ones(len(w), np.int64)))
            for k, key in enumerate(group.dictionary.take(pa.array(at[order][starts])).to_pylist()):
                old = sums.get((key, int(n)))
                if old is None:
                    sums[key, int(n)] = [wx[k], plain[k], ws[k], ns[k]]
                    size += 16 * int(n) + 200
                else:
                    for i, v in enumerate((wx[k], plain[k], ws[k], ns[k])):
                        old[i] = old[i] + v
        if size >= HELD:
            yield out()
            sums, size = {}, 0
    if sums:
        yield out()


def mean_pool(chunks: DataFrame, by: str, vector: str, weight: str) -> DataFrame:
    """(by, vector): weighted mean of each group's vectors, by a tree of sums.

    Each task sums its rows by group; sums stay whole arrays and are merged by (group, a number of tasks), then by group. So a
    vector of 1,024 numbers is one row throughout, and no merge holds more than FAN sums of a group per 65,536 tasks. All-zero weights
    count as equal. A negative weight or vectors of different lengths are errors; null vectors take no part.
    """
    rows = chunks.where(F.col(vector).isNotNull()).select(by, F.col(weight).cast("double").alias("w"), F.col(vector).cast("array<double>").alias("v"))
    key = rows.schema[by].dataType.simpleString()
    shape = f"part long, `{by}` {key}, wx array<double>, x array<double>, w double, n long"

    def merged(sums: pa.Table) -> pa.Table:
        length = pc.unique(pc.list_value_length(sums["x"])).to_pylist()
        if len(length) > 1:
            raise ValueError("vectors of different lengths")
        total = [sums[c].combine_chunks().flatten().to_numpy().reshape(sums.num_rows, length[0]).sum(axis=0) for c in ("wx", "x")]
        return pa.table({"part": [sums["part"][0].as_py()], by: sums[by].slice(0, 1), "wx": pa.array([total[0]]), "x": pa.array([total[1]]), "w": [pc.sum(sums["w"]).as_py()], "n": [pc.sum(sums["n"]).as_py()]})

    sums = rows.mapInArrow(lambda batches: _pooled(batches, by), shape)
    sums = sums.withColumn("part", F.floor(F.col("part") / FAN)).groupBy(by, "part").applyInArrow(lambda t: merged(t), shape)
    sums = sums.groupBy(by).applyInArrow(lambda t: merged(t), shape)
    mean = F.when(F.col("w") == 0, F.transform("x", lambda v: v / F.col("n"))).otherwise(F.transform("wx", lambda v: F.try_divide(v, F.col("w"))))
    return sums.select(by, mean.alias(vector))
