"""Near-duplicate embeddings by a robust-pruned flat graph.

Vectors of one label (and length) are dealt into overlapping shards around pivots: each goes to its nearest pivot
(its home) and to every pivot whose bisecting plane it is near. Each shard builds a pruned neighbour graph; the
adjacency lists of a vector from all its shards are united. A shard that cannot be dealt smaller (many near copies)
is compared by brute force instead, block by block across tasks. Each home shard then searches all its own vectors at once:
greedily from the medoid, then expanding through everything within range. Hits are exact cosines in double precision.
The overlap is the distance of two vectors at the threshold, so dealing loses no pair. In each shard a sixteenth of the home vectors
(all of them in small shards) is audited by brute force; a shard that has lost a link of theirs is compared by brute force as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .shared import connected_components, in_arrow, stored

#: Neighbours of a vector that the greedy walk looks at; the expansion looks at all.
GREEDY = 32
#: How far below the range the expansion goes on.
SLACK = 0.04


def _matrix(column) -> np.ndarray:
    """Unit rows of a column of floats or doubles, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, near: int = 24, keep: int = 12, alpha: float = 1.2, block: int = 512) -> np.ndarray:
    """[n, keep] places of pruned neighbours, -1 where there are fewer.

    Of the ``near`` closest, from the closest on, one is kept unless a kept one is closer to it by the factor
    ``alpha`` (in squared distance) than the vector itself is.
    """
    n = len(x)
    near = min(near, n - 1)
    out = np.full((n, keep), -1)
    for at in range(0, n if near > 0 else 0, block):
        rows = np.arange(at, min(at + block, n))
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -2
        c = np.argpartition(-s, near - 1, axis=1)[:, :near]
        order = np.argsort(-np.take_along_axis(s, c, axis=1), axis=1, kind="stable")
        c = np.take_along_axis(c, order, axis=1)
        own = 1 - np.take_along_axis(s, c, axis=1)
        among = 1 - np.matmul(x[c], x[c].transpose(0, 2, 1))
        taken, count = np.zeros(c.shape, bool), np.zeros(len(rows), int)
        for j in range(near):
            shadowed = (taken & (alpha * among[:, j] <= own[:, j : j + 1])).any(axis=1)
            ok = np.flatnonzero(~shadowed & (count < keep))
            taken[ok, j] = True
            out[rows[ok], count[ok]] = c[ok, j]
            count[ok] += 1
    return out


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, low: float, beam: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, hit) of places with cosine >= low; graph: [n, width] neighbours, -1 for none."""
    n, found_q, found_h = len(x), [], []
    medoid = int((x @ x.mean(axis=0)).argmax())
    step = max(1, 200_000 // graph.shape[1])
    for at in range(0, len(queries), 128):
        q = queries[at : at + 128]
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True  # the place of "none"
        inside = np.zeros((len(q), n + 1), bool)
        # greedy: each query opens the best of its beam until all of it is open
        ids, score, opened = np.full((len(q), beam), n), np.full((len(q), beam), -3.0), np.ones((len(q), beam), bool)
        ids[:, 0], score[:, 0], opened[:, 0] = medoid, x[q] @ x[medoid], False
        seen[:, medoid] = True
        inside[:, medoid] = score[:, 0] >= low
        live = rows
        while len(live):
            best = np.where(opened[live], -4, score[live]).argmax(axis=1)
            opened[live, best] = True
            new = graph[ids[live, best], :GREEDY]
            new = np.where(new < 0, n, new)
            fresh = ~seen[live[:, None], new]
            seen[live[:, None], new] = True
            s = np.where(fresh, np.einsum("qkd,qd->qk", x[np.minimum(new, n - 1)], x[q[live]]), -3)
            inside[live[:, None], new] |= s >= low
            all_ids, all_s = np.concatenate([ids[live], new], axis=1), np.concatenate([score[live], s], axis=1)
            all_open = np.concatenate([opened[live], ~fresh], axis=1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            ids[live], score[live], opened[live] = (np.take_along_axis(a, top, axis=1) for a in (all_ids, all_s, all_open))
            live = live[~opened[live].all(axis=1)]
        # expansion: from the query itself and every hit, through all neighbours down to somewhat below the range,
        # some pairs at a time; what is within range need not be connected by itself
        inside[rows, q] = True
        tried = inside[:, :n].copy()
        front = np.flatnonzero(tried)
        while len(front):
            reached = []
            for k in range(0, len(front), step):
                part = front[k : k + step]
                to = graph[part % n]
                key = ((part // n)[:, None] * n + to)[to >= 0]
                key = np.unique(key[~tried.ravel()[key]])
                tried.ravel()[key] = True
                s = np.einsum("kd,kd->k", x[q[key // n]], x[key % n])
                hit = key[s >= low]
                inside[hit // n, hit % n] = True
                reached.append(key[s >= low - SLACK])
            front = np.concatenate(reached)
        inside[rows, q] = False
        a, b = np.nonzero(inside[:, :n])
        found_q.append(q[a])
        found_h.append(b)
    return np.concatenate([np.zeros(0, int), *found_q]), np.concatenate([np.zeros(0, int), *found_h])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each place reaches over the pairs."""
    root = np.arange(n)
    while len(a):
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            break
        root = least
    return root


def all_pairs(x: np.ndarray, queries: np.ndarray, low: float, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs as of ``range_search`` by brute force, some queries at a time."""
    for k in range(0, len(queries), block):
        q = queries[k : k + block]
        i, h = np.nonzero(x[q] @ x.T >= low)
        apart = q[i] != h
        yield q[i[apart]], h[apart]


def lost(x: np.ndarray, homes: np.ndarray, ids: np.ndarray, n: np.ndarray, low: float) -> bool:
    """Whether an audited home vector has more true links than the ``n`` found: those of a sixteenth of the ids by hash,
    or all in shards of up to 512 vectors."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)
    audited = homes[(mixed[homes] == 0) | (len(ids) <= 512)]
    true = np.zeros(len(ids), np.int64)
    for q, _ in all_pairs(x, audited, low):
        true += np.bincount(q, minlength=len(ids))
    return bool((true > n)[audited].any())


def deal(classes: DataFrame, margin: float, shard_rows: int, kind: str = "float", pivots: int = 48, levels: int = 6) -> tuple[DataFrame, DataFrame]:
    """Two tables of (shard, id, v, copies, home): overlapping shards of at most ``shard_rows`` vectors, and those of
    more that dealing does not make smaller.

    A shard that is too large is dealt again around pivots of its own (its lowest hashes, ``pivots`` at most), ``levels``
    times at most. A deal counts only where it halves the pairs (the sum of the squared sizes); else the shard stays whole, as a
    group of near copies does, which lie within the margin of every pivot. Pivots are joined by shard, and the largest
    collected figure is one boolean per level.
    """
    dealt = classes.select(F.xxhash64("label", F.size("v")).alias("shard"), "id", "v", "copies", F.lit(True).alias("home"))
    whole = dealt.limit(0)
    for level in range(levels):
        sizes = dealt.groupBy("shard").agg(F.count("*").alias("n"))
        large = stored(sizes.where(F.col("n") > shard_rows), "large")
        if large.isEmpty():
            break
        order = Window.partitionBy("shard").orderBy(F.xxhash64("id", F.lit(level)), "id")
        many = F.least(F.lit(pivots), F.ceil(2 * F.col("n") / shard_rows) + 1)
        chosen = dealt.join(large, "shard").withColumn("r", F.row_number().over(order)).where((F.col("r") <= pivots) & (F.col("r") <= many))
        chosen = chosen.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias("p"))

        def split(batches: Iterator[pa.RecordBatch], level=level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard = batch.column(0).to_numpy()
                first = np.unique(shard, return_index=True)[1]
                for at in first.tolist():
                    rows = np.flatnonzero(shard == shard[at])
                    p = np.array([e["v"] for e in batch.column(4)[at].as_py()], float)
                    p /= np.linalg.norm(p, axis=1, keepdims=True)
                    part = batch.take(pa.array(rows))
                    s = _matrix(part.column(2)) @ p.T
                    best = s.argmax(axis=1)
                    apart = np.linalg.norm(p[best][:, None] - p[None], axis=2)
                    gap = (s[np.arange(len(s)), best][:, None] - s) / np.maximum(apart, 1e-9)  # distance to the bisecting plane
                    i, k = np.nonzero(gap <= margin)
                    key = np.array([hash((int(shard[at]), level, int(j))) for j in range(len(p))], np.int64)[k]
                    home = part.column(5).to_numpy(zero_copy_only=False)[i] & (best[i] == k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), shard[at])), pa.array(key), part.column(1).take(pa.array(i)), part.column(2).take(pa.array(i)), part.column(3).take(pa.array(i)), pa.array(home)], ["parent", "shard", "id", "v", "copies", "home"])

        again = in_arrow(dealt.join(chosen, "shard").select("shard", "id", "v", "copies", "p", "home"), split, f"parent long, shard long, id long, v array<{kind}>, copies long, home boolean")
        again = stored(again, "split")
        pairs = again.groupBy("parent", "shard").agg(F.count("*").alias("m")).groupBy("parent").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs"))
        less = large.join(pairs, F.col("shard") == F.col("parent")).where(2 * F.col("pairs") <= F.col("n").cast("double") * F.col("n")).select("parent")
        less = stored(less, "less")
        as_before = large.join(less, F.col("shard") == F.col("parent"), "left_anti").select("shard")
        whole = whole.unionByName(dealt.join(as_before, "shard", "left_semi"))
        dealt = dealt.join(large, "shard", "left_anti").unionByName(again.join(less, "parent", "left_semi").drop("parent"))
        dealt = stored(dealt, "shards")
    else:
        sizes = dealt.groupBy("shard").agg(F.count("*").alias("n"))
        large = stored(sizes.where(F.col("n") > shard_rows).select("shard"), "large")
        whole = whole.unionByName(dealt.join(large, "shard", "left_semi"))
        dealt = dealt.join(large, "shard", "left_anti")
    return dealt, stored(whole, "whole")


def _in_blocks(whole: DataFrame, low: float, block: int) -> DataFrame:
    """Rows as of ``_search`` for shards of any size, by brute force: salted blocks of the vectors at home there against blocks
    of all vectors. A vector's links come in one row for each block that it meets."""
    n = whole.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    salted = whole.join(n, "shard").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    queries = salted.where("home").select("shard", F.col("own").alias("q"), every.alias("h"), "id", "v", "copies")
    others = salted.select("shard", every.alias("q"), F.col("own").alias("h"), "id", "v", "copies")
    others = others.toDF(*others.columns)  # columns of their own for the cogroup

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({k: pa.array([], pa.int64()) for k in ("id", "root", "links")})
        ids, places = np.unique(np.concatenate([a.column("id").to_numpy(), b.column("id").to_numpy()]), return_inverse=True)
        at, to, x, y, copies = places[: len(a)], places[len(a) :], _matrix(a.column("v")), _matrix(b.column("v")), b.column("copies").to_numpy()
        links, root = np.zeros(len(a), np.int64), np.arange(len(ids))
        for k in range(0, len(a), 256):
            i, j = np.nonzero(x[k : k + 256] @ y.T >= low)
            apart = at[k + i] != to[j]
            i, j = k + i[apart], j[apart]
            links += np.bincount(i, weights=copies[j], minlength=len(a)).astype(np.int64)
            root = _roots(len(ids), np.concatenate([at[i], np.arange(len(ids))]), np.concatenate([to[j], root]))
        tied = np.flatnonzero(root != np.arange(len(ids)))
        tied = tied[~np.isin(tied, at)]
        none = pa.nulls(len(tied), pa.int64())
        return pa.table({"id": np.concatenate([ids[at], ids[tied]]), "root": np.concatenate([ids[root[at]], ids[root[tied]]]), "links": pa.concat_arrays([pa.array(links), none])})

    return queries.groupBy("shard", "q", "h").cogroup(others.groupBy("shard", "q", "h")).applyInArrow(compare, "id long, root long, links long")


def _search(shards: DataFrame, low: float) -> DataFrame:
    """Per vector in its home shard: id, root (least id of its component there), links (copies within range); further
    rows tie vectors of the shard that are home elsewhere to the root (links null)."""

    def build(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        g = neighbour_graph(_matrix(t.column("v")))
        a, k = np.nonzero(g >= 0)
        b = g[a, k]
        return pa.table({"id": np.concatenate([ids[a], ids[b]]), "to": np.concatenate([ids[b], ids[a]])})

    edges = shards.groupBy("shard").applyInArrow(build, "id long, to long").groupBy("id").agg(F.collect_set("to").alias("to"))

    def search(t: pa.Table) -> pa.Table:
        ids, copies, home = t.column("id").to_numpy(), t.column("copies").to_numpy(), t.column("home").to_numpy(zero_copy_only=False)
        order = np.argsort(ids)
        lists = t.column("to").combine_chunks()
        to = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy())) if len(to) else np.zeros(0, int)
        at = np.minimum(np.searchsorted(ids[order], to), len(ids) - 1)
        here = ids[order][at] == to  # neighbours that are in this shard
        owner, to = owner[here], order[at[here]]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        graph = np.full((len(ids), int(place.max()) + 1 if len(place) else 1), -1)
        graph[owner, place] = to
        x, homes = _matrix(t.column("v")), np.flatnonzero(home)
        # places in order of ids, so that the least place is the least id
        rank = np.empty(len(ids), int)
        rank[order] = np.arange(len(ids))

        def gather(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            links, n, root = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.arange(len(ids))
            for q, h in pairs:
                links += np.bincount(q, weights=copies[h], minlength=len(ids)).astype(np.int64)
                n += np.bincount(q, minlength=len(ids))
                root = _roots(len(ids), np.concatenate([rank[q], np.arange(len(ids))]), np.concatenate([rank[h], root]))
            return links, n, root

        links, n, root = gather(range_search(x, graph, homes[k : k + 512], low) for k in range(0, len(homes), 512))
        if lost(x, homes, ids, n, low):
            links, _, root = gather(all_pairs(x, homes, low))
        root = ids[order][root][rank]
        out = home | (root != ids)
        return pa.table({"id": ids[out], "root": root[out], "links": pa.array(links[out], mask=~home[out])})

    both = shards.join(edges, "id", "left").withColumn("to", F.coalesce("to", F.array().cast("array<long>")))
    return both.groupBy("shard").applyInArrow(search, "id long, root long, links long")


def near_duplicates(vectors: DataFrame, low: float = 0.98, margin: float | None = None, shard_rows: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Vectors of one label are linked when their cosine is at least ``low``, computed in double precision of floats or doubles as they
    are given. A null label, a null, empty or zero vector and one with null or non-finite components is linked with nothing.
    Equal vectors of a label are one class in the search, and count as linked with each other. Rows that repeat a vec_id are
    reported as often as they come, each by its own vector. A row with a null vec_id is linked with nothing; its component is
    null, and it is kept. Vectors of different lengths are never linked; other columns are not read; an empty table gives an empty
    result. ``margin``, the overlap of shards, is by default the distance of unit vectors at cosine ``low``: with less, links across
    borders are lost.
    """
    margin = (2 - 2 * low) ** 0.5 + 1e-6 if margin is None else margin
    given = vectors.schema["embedding"].dataType
    kind = "double" if isinstance(getattr(given, "elementType", None), DoubleType) else "float"
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>").alias("v"), F.col("label").cast("long"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("v", lambda x: x != 0)
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True))
    v = v.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = v.where("good").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count_distinct("vec_id").alias("copies"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    shards, whole = deal(classes, margin, shard_rows, kind)
    found = stored(_search(shards, low).unionByName(_in_blocks(whole, low, shard_rows)), "found")
    homes = found.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component_id", "c")
    least = components.join(classes.select("id", "first"), "id").groupBy("c").agg(F.min("first").alias("least"))
    by_class = classes.join(homes, "id").join(components, "id", "left").join(least, "c", "left")
    by_class = by_class.select("label", "v", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    linked = v.where("good").join(by_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = v.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
