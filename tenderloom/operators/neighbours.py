"""Exact nearest vectors by cosine: rings of clusters, and a bound that proves which rings a query need not read.

The searched vectors are dealt to the nearest of a fixed number of pivots and written in order of (pivot, angle to it), so that a block is a
ring of one cluster. By the triangle inequality on angles nothing in a ring is nearer to a query than the query's own angle to the
pivot, less the ring's outer (or its inner, less the query's). A first round reads each query's nearest rings; its k-th best angle is
the certificate with which a second round leaves out every ring whose bound is beyond. How many rounds there are does not
depend on how many queries there are: queries travel in packs, rings in groups, and meet in cells of bounded size on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import counted, few_rows, stored

#: Vectors of a ring, rings of a group, queries of a pack, packs of a bucket, rings of a chunk of bounds.
RING, GROUP, PACK, BUCKET, CHUNK = 1024, 16, 256, 32, 1 << 16
#: Pivots, and the sample on which they are fitted.
PIVOTS, SAMPLE = 64, 2048
#: What rounding may take from an angle.
SLACK = 1e-6

_RINGS = "grp long, ring long, pivot int, inner double, outer double, n long, ids array<long>, x array<double>"
_PACKS = "pack long, ids array<long>, x array<double>"
_FOUND = "pack long, at long, tenant_id long, tender_id long, distance double"


def unit_rows(column: pa.Array, rows: int) -> np.ndarray:
    """A list column as a matrix of unit rows in double precision; zero vectors stay zero."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def fit_pivots(rows: DataFrame, pivots: int, sample: int) -> np.ndarray:
    """Centres of a few rounds of spherical k-means over a bounded sample, chosen by a hash over all rows."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    x = np.array([r[0] for r in some], float)
    x = x[np.linalg.norm(x, axis=1) > 0] if len(x) else np.zeros((0, 1))
    if not len(x):
        return np.zeros((1, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = x[np.linspace(0, len(x) - 1, min(pivots, len(x))).astype(int)]
    for _ in range(4):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-300), centres)
    return centres


def _dealt(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows (id, vector) as (id, x, pivot, angle), in order of pivot and angle; zero vectors have a pivot of their own, after the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(batch.column(1), batch.num_rows)
            t = angles(x, pivots) if pivots.shape[1] == x.shape[1] else np.zeros((len(x), 1))
            zero = ~x.any(axis=1)
            near = np.where(zero, len(pivots), t.argmin(axis=1))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel())), pa.array(near, pa.int32()), pa.array(np.where(zero, 0.0, t.min(axis=1)))], ["id", "x", "pivot", "angle"])

    order = ("pivot", "angle", "id")
    return rows.mapInArrow(run, "id long, x array<double>, pivot int, angle double").repartitionByRange(*order).sortWithinPartitions(*order)


def _list(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values.ravel()))


def _runs(batches: Iterator[pa.RecordBatch], most: int, by_pivot: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of at most ``most`` sorted rows (of one pivot): pivot, ids, matrix, angles."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut() -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        return t["pivot"][0].as_py(), t["id"].to_numpy(), t["x"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1), t["angle"].to_numpy()

    for batch in batches:
        pivot = batch.column(2).to_numpy()
        cuts = np.flatnonzero(np.diff(pivot)) + 1 if by_pivot else np.zeros(0, int)
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if by_pivot and held and held[0].column(2)[0].as_py() != pivot[a]:
                yield cut()
                held, size = [], 0
            while a < b:
                n = int(min(b - a, most - size))
                held.append(batch.slice(int(a), n))
                a, size = a + n, size + n
                if size == most:
                    yield cut()
                    held, size = [], 0
    if held:
        yield cut()


def _write_rings(rows: DataFrame, pivots: np.ndarray) -> tuple[DataFrame, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, group, last, inside = TaskContext.get().partitionId() << 32, 0, None, 0
        for seq, (pivot, ids, x, angle) in enumerate(_runs(batches, RING, True)):
            if pivot != last or inside == GROUP:
                group, last, inside = seq, pivot, 0
            inside += 1
            around = (angle[0], angle[-1]) if pivot < len(pivots) else (0.0, math.pi)  # zero vectors are read by all
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (first + group, first + seq)] + [pa.array([pivot], pa.int32()), *(pa.array([v], pa.float64()) for v in around), pa.array([len(ids)], pa.int64()), _list(ids), _list(x)], [c.split()[0] for c in _RINGS.split(", ")])

    return counted(_dealt(rows, pivots).mapInArrow(run, _RINGS), "rings")


def _write_packs(rows: DataFrame, pivots: np.ndarray) -> tuple[DataFrame, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for seq, (_, ids, x, _) in enumerate(_runs(batches, PACK, False)):
            yield pa.RecordBatch.from_arrays([pa.array([first + seq]), _list(ids), _list(x)], ["pack", "ids", "x"])

    return counted(_dealt(rows, pivots).mapInArrow(run, _PACKS), "packs")


def least_angles(x: np.ndarray, pivots: np.ndarray, pivot: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """A lower bound of the angle between each query (rows) and anything in each ring (columns)."""
    t = np.concatenate([angles(x, pivots), np.zeros((len(x), 1))], axis=1)[:, pivot]
    bound = np.maximum(np.maximum(t - outer, inner - t), 0)
    bound[~x.any(axis=1)] = 0
    return bound


def _pack_rows(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    for row in range(table.num_rows):
        p = table.slice(row, 1)
        ids = p["ids"].chunk(0)[0].values.to_numpy()
        reach = p["reach"].chunk(0)[0].values.to_numpy() if "reach" in table.column_names else None
        yield p["pack"][0].as_py(), ids, p["x"].chunk(0)[0].values.to_numpy().reshape(len(ids), -1), reach


def _bucket(packs: int) -> Column:
    return F.pmod(F.xxhash64("pack"), F.lit(math.ceil(packs / BUCKET))).cast("int")


def units(packs: DataFrame, n_packs: int, rings: DataFrame, n_rings: int, pivots: np.ndarray, k: int) -> DataFrame:
    """(pack, grp): the groups that a pack reads. With ``reach`` (the angle within which each query's k best lie) all that the bounds do not
    rule out; without, each query's nearest rings that hold k vectors. Only bounds and queries are sent, no searched vector."""
    chunks = math.ceil(n_rings / CHUNK)
    bounds = rings.select("grp", "ring", "pivot", "inner", "outer", "n").withColumn("z", F.pmod(F.xxhash64("ring"), F.lit(chunks)).cast("int"))
    bounds = bounds.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(n_packs / BUCKET) - 1))))
    asked = packs.withColumn("b", _bucket(n_packs)).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def meet(ring: pa.Table, pack: pa.Table) -> pa.Table:
        grp, pivot, inner, outer, n = (ring[c].to_numpy() for c in ("grp", "pivot", "inner", "outer", "n"))
        out = [(0, np.zeros(0, np.int64))]
        for name, _, x, reach in _pack_rows(pack):
            bound = least_angles(x, pivots, pivot, inner, outer)
            if reach is not None:
                read = (bound <= reach[:, None]).any(axis=0)
            else:
                nearest = np.argsort(bound, axis=1, kind="stable")
                enough = np.cumsum(n[nearest], axis=1) - n[nearest] < k  # rings until k vectors are there
                read = np.zeros(len(grp), bool)
                read[nearest[enough]] = True
            out.append((name, np.unique(grp[read])))
        return pa.table({"pack": pa.array(np.repeat([p for p, _ in out], [len(g) for _, g in out]), pa.int64()), "grp": pa.array(np.concatenate([g for _, g in out]), pa.int64())})

    return bounds.groupBy("z", "b").cogroup(asked.groupBy("z", "b")).applyInArrow(lambda a, b: meet(a, b), "pack long, grp long").distinct()


def best_of(cosine: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Order of the k best of each query: higher cosine first, then the lesser id."""
    order = np.lexsort((ids, -cosine, at))
    first = at[order]
    return order[np.arange(len(at)) - np.searchsorted(first, first) < k]


def _scored(packs: DataFrame, n_packs: int, rings: DataFrame, read: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """The k best of every query in each cell (a group of rings, a bucket of packs), at 12 places of the cosine."""
    asked = read.join(packs, "pack").withColumn("b", _bucket(n_packs))
    found = rings.drop("n").join(read.select("grp", _bucket(n_packs).alias("b")).distinct(), "grp")

    def score(ring: pa.Table, pack: pa.Table) -> pa.Table:
        pivot, inner, outer = (ring[c].to_numpy() for c in ("pivot", "inner", "outer"))
        blocks = [(i.values.to_numpy(), v.values.to_numpy().reshape(len(i), -1)) for i, v in zip(ring["ids"].combine_chunks(), ring["x"].combine_chunks(), strict=True)]
        out = []
        for name, tenants, x, reach in _pack_rows(pack):
            bound = least_angles(x, pivots, pivot, inner, outer)
            worst = np.full(len(x), np.inf) if reach is None else reach.copy()
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for n in np.argsort(bound.min(axis=0, initial=np.inf), kind="stable"):
                rows = np.flatnonzero(bound[:, n] <= worst)
                if not len(rows):
                    continue
                ids, v = blocks[n]
                s = np.round(np.clip(x[rows] @ v.T, -1, 1), 12)
                most = min(k, s.shape[1])
                edge = np.partition(s, s.shape[1] - most, axis=1)[:, -most]
                i, j = np.nonzero(s >= edge[:, None])
                kept = best_of(s[i, j], i, ids[j], k)
                parts.append((rows[i[kept]], ids[j[kept]], s[i[kept], j[kept]]))
                if most == k:
                    worst[rows] = np.minimum(worst[rows], np.arccos(edge) + SLACK)
            at, ids, s = (np.concatenate(c) for c in zip(*parts, strict=True))
            kept = best_of(s, at, ids, k)
            at, ids, s = at[kept], ids[kept], s[kept]
            out.append(pa.table({"pack": pa.array(np.full(len(at), name), pa.int64()), "at": pa.array(at, pa.int64()), "tenant_id": pa.array(tenants[at], pa.int64()), "tender_id": pa.array(ids, pa.int64()), "distance": pa.array(1 - s)}))
        return pa.concat_tables(out) if out else pa.table({c.split()[0]: pa.array([], pa.float64() if c.endswith("double") else pa.int64()) for c in _FOUND.split(", ")})

    return found.groupBy("grp", "b").cogroup(asked.groupBy("grp", "b")).applyInArrow(lambda a, b: score(a, b), _FOUND)


def dense_topk(profiles: DataFrame, tenders: DataFrame, k: int = 60, pivots: int = PIVOTS) -> DataFrame:
    """(tenant_id, tender_id, distance, pos): the k nearest tenders of each profile by cosine distance, exactly.

    profiles: (tenant_id, embedding), tenders: (tender_id, embedding), all of one length; null vectors take no part, a zero vector has
    cosine 0; cosines count to 12 places, of equal ones the lesser id comes first. Each row of profiles is searched for.
    """
    searched = tenders.where("embedding is not null").select(F.col("tender_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    asked = profiles.where("embedding is not null").select(F.col("tenant_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    centres = fit_pivots(searched, pivots, SAMPLE)
    (rings, n_rings), (packs, n_packs) = _write_rings(searched, centres), _write_packs(asked, centres)
    if not n_rings or not n_packs:
        return tenders.sparkSession.createDataFrame([], "tenant_id long, tender_id long, distance double, pos int")
    order = Window.partitionBy("pack", "at").orderBy("distance", "tender_id")
    with few_rows(tenders.sparkSession):
        first = _scored(packs, n_packs, rings, stored(units(packs, n_packs, rings, n_rings, centres, k), "first-units"), centres, k)
        kth = first.withColumn("pos", F.row_number().over(order)).where(F.col("pos") == k).select("pack", "at", (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("distance")))) + SLACK).alias("angle"))
        by_pack = kth.groupBy("pack").agg(F.map_from_entries(F.collect_list(F.struct("at", "angle"))).alias("kth"))  # at most PACK entries
        reach = F.transform("ids", lambda _, at: F.coalesce(F.try_element_at("kth", at.cast("long")), F.lit(math.inf)))
        certified = stored(packs.join(by_pack, "pack", "left").withColumn("reach", reach).drop("kth"), "certified")
        read = stored(units(certified, n_packs, rings, n_rings, centres, k), "second-units")
        found = stored(_scored(certified, n_packs, rings, read, centres, k), "nearest")
    return found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).select("tenant_id", "tender_id", "distance", "pos")
