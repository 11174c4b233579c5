"""Hard negatives by windows of scores: Hilbert-ordered candidate blocks with zone maps.

Candidates are ordered by (label, Hilbert index of a few fitted directions) and written as Parquet rows of ``BLOCK`` vectors each, with the
least and greatest value of every dimension (the zone map). Interval arithmetic over a zone map bounds every score that the block
can have with an anchor: a block is read only for anchors one of whose windows it can reach. Anchors travel in packs, blocks in
groups of neighbours; what meets is a pack and a group that holds a wanted block, in cells of bounded size on both sides.
The bounds decide only what is read, so results are exact whatever the order; how much they spare depends on the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import counted, few_rows, in_arrow, stored

#: Vectors of a block, blocks of a group, anchors of a pack, packs of a bucket, zone maps of a chunk.
BLOCK, GROUP, PACK, BUCKET, ZONES = 1024, 16, 256, 32, 256
#: Rows on which the directions of the curve are fitted, directions, and bits of each.
SAMPLE, DIRECTIONS, BITS = 4096, 8, 6

_BLOCKS = "grp long, block long, label int, dim int, ids array<long>, q array<long>, lo array<long>, hi array<long>"
_PACKS = "pack long, label int, dim int, ids array<long>, q array<long>"


def components(vector: str) -> Column:
    """floor(256 x) of every component, as longs."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * 256))


def takes_part(vector: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    v = F.col(vector).cast("array<double>")
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell numbers below 2^bits (at most 63 bits in all), after Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) > 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


@dataclass
class Curve:
    """Directions of greatest variance in a sample, and the edges that cut each into cells of like count."""

    directions: np.ndarray
    edges: np.ndarray

    @classmethod
    def fit(cls, vectors: list[list[int]]) -> Curve:
        dims = [len(v) for v in vectors]
        dim = max(set(dims), key=dims.count) if dims else 0
        if not dim:
            return cls(np.zeros((0, 0)), np.zeros((0, 0)))
        x = np.clip(np.array([v for v in vectors if len(v) == dim], float), -1e12, 1e12)
        _, axes = np.linalg.eigh(np.cov(x, rowvar=False).reshape(dim, dim) if len(x) > 1 else np.eye(dim))
        d = axes[:, ::-1][:, :DIRECTIONS]
        return cls(d, np.quantile(x @ d, np.arange(1, 1 << BITS) / (1 << BITS), axis=0).T)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Of vectors of another dimension than the sample's: the first components count, missing ones are 0."""
        d = self.directions
        if not d.size:
            return np.zeros(len(x), np.int64)
        own = np.zeros((len(x), len(d)))
        n = min(x.shape[1], len(d))
        own[:, :n] = x[:, :n]
        p = own @ d
        return hilbert_index(np.stack([np.searchsorted(e, p[:, k]) for k, e in enumerate(self.edges)], axis=1), BITS)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """The integers of a list column as a matrix; its lists are of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _lists(*values: np.ndarray) -> list[pa.ListArray]:
    return [pa.ListArray.from_arrays(pa.array([0, v.size], pa.int32()), pa.array(v.ravel(), pa.int64())) for v in values]


def write_blocks(rows: DataFrame, name: str = "blocks") -> tuple[DataFrame, int]:
    """(grp, block, label, dim, ids, q, lo, hi): blocks of rows (vec_id, label, q) in Hilbert order, and their count. A block has one label and dimension."""
    sample = rows.select("q", F.xxhash64("vec_id", "q").alias("h")).orderBy("h", "q").limit(SAMPLE)
    curve = Curve.fit([r[0] for r in sample.collect()])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                part = batch.filter(pa.array(size == dim))
                at = curve.places(_matrix(part.column(2), part.num_rows).astype(float))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), dim, np.int32)), pa.array(at)], ["vec_id", "label", "q", "dim", "place"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, seq, last, group = TaskContext.get().partitionId() << 32, 0, None, -1
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, last, group, in_group
            t = pa.Table.from_batches(held).combine_chunks()
            kind = (t["label"][0].as_py(), t["dim"][0].as_py())
            if kind != last or in_group == GROUP:
                last, group, in_group = kind, seq, 0
            in_group += 1
            q = _matrix(t["q"].combine_chunks(), t.num_rows)
            head = [pa.array([first + group], pa.int64()), pa.array([first + seq], pa.int64()), pa.array([kind[0]], pa.int32()), pa.array([kind[1]], pa.int32())]
            seq += 1
            return pa.RecordBatch.from_arrays([*head, *_lists(t["vec_id"].to_numpy(), q, q.min(axis=0), q.max(axis=0))], [x.split()[0] for x in _BLOCKS.split(", ")])

        in_group, size = 0, 0
        for batch in batches:
            label, dim = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            cuts = np.flatnonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if held and (held[0].column(1)[0].as_py(), held[0].column(3)[0].as_py()) != (label[a], dim[a]):
                    yield flush()
                    held, size = [], 0
                while a < b:
                    n = int(min(b - a, BLOCK - size))
                    held.append(batch.slice(int(a), n))
                    a, size = a + n, size + n
                    if size == BLOCK:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    shape = "vec_id long, label int, q array<long>, dim int, place long"
    ordered = in_arrow(rows.select("vec_id", "label", "q"), placed, shape).repartitionByRange("label", "dim", "place", "vec_id").sortWithinPartitions("label", "dim", "place", "vec_id")
    return counted(in_arrow(ordered, packed, _BLOCKS), name)


def anchor_packs(blocks: DataFrame, every: int = 50) -> tuple[DataFrame, int]:
    """(pack, label, dim, ids, q) of the rows whose id is divisible by ``every``, in the order of the blocks, and their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, seq, kind = TaskContext.get().partitionId() << 32, 0, None
        ids, q = np.zeros(0, np.int64), np.zeros((0, 0), np.int64)

        def flush(n: int) -> pa.RecordBatch:
            nonlocal seq, ids, q
            out = pa.RecordBatch.from_arrays([pa.array([first + seq], pa.int64()), pa.array([kind[0]], pa.int32()), pa.array([kind[1]], pa.int32()), *_lists(ids[:n], q[:n])], [x.split()[0] for x in _PACKS.split(", ")])
            seq, ids, q = seq + 1, ids[n:], q[n:]
            return out

        for batch in batches:
            for label, dim, own, x in zip(*(c.to_pylist() for c in batch.columns[:2]), *batch.columns[2:], strict=True):
                own = own.values.to_numpy()
                mine = own % every == 0
                if not mine.any():
                    continue
                if (label, dim) != kind:
                    if len(ids):
                        yield flush(len(ids))
                    kind, ids, q = (label, dim), np.zeros(0, np.int64), np.zeros((0, dim), np.int64)
                ids, q = np.concatenate([ids, own[mine]]), np.concatenate([q, x.values.to_numpy().reshape(len(own), -1)[mine]])
                while len(ids) >= PACK:
                    yield flush(PACK)
        if len(ids):
            yield flush(len(ids))

    with few_rows(blocks.sparkSession):
        return counted(in_arrow(blocks.select("label", "dim", "ids", "q"), run, _PACKS), "anchors")


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor (rows) with anything inside each box (rows of lo and hi), exactly."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, exactly: in doubles as long as no sum can pass 2^53, then in 64-bit integers; an error beyond."""
    most = a.shape[1] * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if most < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most >= 1 << 62:
        raise ValueError("scores beyond 64-bit integers")
    return a @ b.T


def _meeting(packs: DataFrame, n_packs: int, blocks: DataFrame, n_blocks: int, same_label: bool, windowed: bool) -> DataFrame:
    """(pack, grp): which groups of blocks each pack must read. packs have ``windows`` (array of struct(at, k, least, most)) if windowed.

    Zone maps travel in chunks and packs in buckets, each to every other: cells of bounded size, of numbers only.
    """
    buckets, chunks = math.ceil(n_packs / BUCKET), math.ceil(n_blocks / ZONES)
    numbers = ["q", "windows"] if windowed else []
    zones = blocks.select("grp", "block", "label", "dim", *(["lo", "hi"] if windowed else [])).withColumn("z", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    mine = packs.withColumn("b", F.pmod(F.xxhash64("pack"), F.lit(buckets)).cast("int")).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def reached(zone: pa.Table, pack: pa.Table) -> pa.Table:
        label, dim, grp = (zone[c].to_numpy() for c in ("label", "dim", "grp"))
        out: list[tuple[int, np.ndarray]] = []
        for row in range(pack.num_rows):
            p = pack.slice(row, 1).combine_chunks()
            own = p["dim"][0].as_py()
            some = np.flatnonzero((dim == own) & ((label == p["label"][0].as_py()) == same_label))
            if windowed and len(some) and own:
                q = p["q"][0].values.to_numpy().reshape(-1, own)
                part = zone.take(pa.array(some)).combine_chunks()
                low, high = bounds(q, *(_matrix(part[c].combine_chunks(), len(some)) for c in ("lo", "hi")))
                w = p["windows"].combine_chunks().flatten()
                at = w.field("at").to_numpy()
                hit = (high[at] >= w.field("least").to_numpy()[:, None]) & (low[at] <= w.field("most").to_numpy()[:, None])
                some = some[hit.any(axis=0)]
            out.append((p["pack"][0].as_py(), np.unique(grp[some])))
        return pa.table({"pack": pa.array(np.repeat([k for k, _ in out], [len(g) for _, g in out]), pa.int64()), "grp": pa.array(np.concatenate([g for _, g in out]) if out else [], pa.int64())})

    wanted = mine.select("z", "b", "pack", "label", "dim", *numbers).groupBy("z", "b")
    return zones.groupBy("z", "b").cogroup(wanted).applyInArrow(lambda zone, pack: reached(zone, pack), "pack long, grp long").distinct()


def _best(score: np.ndarray, wanted: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best wanted scores of each row (all ties of the k-th too); score descending, then id."""
    n = min(k, score.shape[1])
    low = np.iinfo(np.int64).min
    masked = np.where(wanted, score, low)
    edge = np.partition(masked, masked.shape[1] - n, axis=1)[:, -n]
    i, j = np.nonzero((masked >= edge[:, None]) & wanted)
    order = np.lexsort((ids[j], -masked[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep]


def _scored(packs: DataFrame, n_packs: int, blocks: DataFrame, units: DataFrame, same_label: bool, k: int) -> DataFrame:
    """(pack, at, k, score, id): of each anchor (and window) the k best rows of every cell of a bucket of packs and a group of blocks."""
    buckets = math.ceil(n_packs / BUCKET)
    bucket = F.pmod(F.xxhash64("pack"), F.lit(buckets)).cast("int")
    asked = units.withColumn("b", bucket).join(packs, "pack")
    cells = units.select("grp", bucket.alias("b")).distinct()
    found = blocks.select("grp", "dim", "ids", "q", "lo", "hi").join(cells, "grp")
    columns = ["pack", "at", "k", "score", "id"]

    def score(block: pa.Table, pack: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 5]
        boxes = []
        for row in range(block.num_rows):
            b = block.slice(row, 1).combine_chunks()
            dim = b["dim"][0].as_py()
            boxes.append((*(b[c][0].values.to_numpy() for c in ("ids", "q", "lo", "hi")), dim))
        for row in range(pack.num_rows):
            p = pack.slice(row, 1).combine_chunks()
            own, name, dim = p["ids"][0].values.to_numpy(), p["pack"][0].as_py(), p["dim"][0].as_py()
            a = p["q"][0].values.to_numpy().reshape(len(own), dim)
            parts = []
            if same_label:
                at, number = np.arange(len(own)), np.zeros(len(own), np.int64)
                least, most = np.full(len(own), np.iinfo(np.int64).min), np.full(len(own), np.iinfo(np.int64).max)
            else:
                w = p["windows"].combine_chunks().flatten()
                at, number, least, most = (w.field(c).to_numpy() for c in ("at", "k", "least", "most"))
            # blocks with the highest bounds first; a window whose k best are above a block's bound does not read it
            limits = [bounds(a, lo[None], hi[None]) if dim else (np.zeros((len(own), 1), np.int64),) * 2 for _, _, lo, hi, _ in boxes]
            worst = np.full(len(at), np.iinfo(np.int64).min)
            for n in sorted(range(len(boxes)), key=lambda n: -int(limits[n][1].max(initial=0))):
                ids, q = boxes[n][0], boxes[n][1].reshape(-1, dim) if dim else np.zeros((len(boxes[n][0]), 0), np.int64)
                low, high = limits[n][0][at, 0], limits[n][1][at, 0]
                reach = np.flatnonzero((high >= least) & (low <= most) & (high >= worst))
                if not len(reach):
                    continue
                anchors, back = np.unique(at[reach], return_inverse=True)
                s = products(a[anchors], q)[back]
                wanted = (s >= least[reach, None]) & (s <= most[reach, None]) & (ids[None] != own[at[reach], None])
                i, j = _best(s, wanted, ids, k)
                parts.append((reach[i], s[i, j], ids[j]))
                # the k-th best of this block is a lower bound of the final k-th
                full, first = np.unique(i, return_index=True)
                n_found = np.diff(np.append(first, len(i)))
                enough = full[n_found == k]
                worst[reach[enough]] = np.maximum(worst[reach[enough]], s[i, j][first[n_found == k] + k - 1])
            if parts:
                r, s, x = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.lexsort((x, -s, r))
                r, s, x = r[order], s[order], x[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, s, x = r[keep], s[keep], x[keep]
                out.append([np.full(len(r), name), at[r], number[r], s, x])
        return pa.table({c: pa.array(np.concatenate(v).astype(np.int64), pa.int64()) for c, v in zip(columns, zip(*out, strict=True), strict=True)})

    best = found.groupBy("grp", "b").cogroup(asked.groupBy("grp", "b")).applyInArrow(lambda block, pack: score(block, pack), ", ".join(f"{c} long" for c in columns))
    order = Window.partitionBy("pack", "at", "k").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label).

    Anchors: rows whose vec_id is divisible by ``every``. A score is the inner product of floor(256 x) components, as an integer; higher first, then
    the smaller vec_id. An anchor's positives are its first other rows of the same label, the negatives of each the first rows
    of other labels with low * positive <= 100 * negative <= high * positive (none, where the positive's score is negative).
    Rows with a null id, label or vector, or a null or non-finite component, take no part; vectors meet only those of the same length; rows that
    share an anchor's id are not others to it, and otherwise each row counts. Scores that could pass 2^62 are an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & takes_part("embedding")).select(F.col("vec_id").cast("long"), F.col("label").cast("int"), components("embedding").alias("q"))
    blocks, n_blocks = write_blocks(rows)
    packs, n_packs = anchor_packs(blocks, every)
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_packs:
        return spark.createDataFrame([], shape)
    with few_rows(spark, 64):
        units = stored(_meeting(packs, n_packs, blocks, n_blocks, True, False), "positive-units")
        best = stored(_scored(packs, n_packs, blocks, units, True, positives), "positives")
    anchors = packs.select("pack", F.posexplode("ids").alias("at", "anchor_id"))
    best = best.select("pack", "at", F.col("rank").cast("long").alias("k"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    # low * p <= 100 * n <= high * p in integers; the window of a negative score is empty
    wide = "CAST(positive_score AS DECIMAL(20,0))"
    least, most = F.expr(f"({wide} * {low} + 99) DIV 100"), F.expr(f"({wide} * {high}) DIV 100")
    windows = best.where("positive_score >= 0").select("pack", F.struct("at", "k", least.alias("least"), most.alias("most")).alias("w"))
    windowed = stored(packs.join(windows.groupBy("pack").agg(F.collect_list("w").alias("windows")), "pack"), "windows")  # at most ``positives`` of each anchor
    with few_rows(spark, 64):
        units = stored(_meeting(windowed, n_packs, blocks, n_blocks, False, True), "negative-units")
        found = stored(_scored(windowed, n_packs, blocks, units, False, negatives), "negatives")
    found = found.select("pack", "at", "k", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(best, ["pack", "at", "k"]).join(anchors.withColumn("at", F.col("at").cast("long")), ["pack", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
