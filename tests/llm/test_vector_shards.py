"""Shards of near-duplicate vectors: groups that cannot be dealt smaller, and links across borders."""

import numpy as np
from pyspark.sql import functions as F

from tenderloom.llm import vector_dedup


def _table(spark, x, label=0):
    return spark.createDataFrame([(i, v.tolist(), label) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")


def _truth(x, low=0.98):
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= low
    np.fill_diagonal(s, False)
    root = vector_dedup._roots(len(x), *np.nonzero(s))
    return {i: (int(s[i].sum()), int(root[i])) for i in range(len(x))}


def test_near_copies_are_not_dealt_on_and_on(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([np.ones((400, 8)) + r.normal(scale=0.02, size=(400, 8)), r.normal(size=(200, 8))])
    classes = _table(spark, x).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(1).cast("long").alias("copies"), "label")
    shards, whole = vector_dedup.deal(classes, 0.2, 64)
    assert shards.groupBy("shard").count().where("count > 64").count() == 0
    assert whole.count() >= 400 and shards.count() + whole.count() < 20 * len(x)
    assert sorted(r.id for r in shards.unionByName(whole).where("home").collect()) == list(range(len(x)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(_table(spark, x), shard_rows=64).collect()}
    assert got == _truth(x)


def test_more_near_copies_than_a_shard_holds(spark):
    r = np.random.default_rng(9)
    x = np.ones((4300, 16)) + r.normal(scale=0.01, size=(4300, 16))
    got = vector_dedup.near_duplicates(_table(spark, x)).groupBy("n_links", "component_id").count().collect()
    assert [tuple(r) for r in got] == [(4299, 0, 4300)]


def test_links_across_borders(spark):
    r = np.random.default_rng(10)
    base = r.normal(size=(300, 4))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = r.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    near = base[:1] + r.normal(scale=0.005, size=(150, 4))  # many links, among which lost ones are few
    x = np.concatenate([base, base + 0.19 * side / np.linalg.norm(side, axis=1, keepdims=True), near])
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(_table(spark, x), shard_rows=250).collect()}
    assert got == _truth(x)


def test_a_lost_link_is_seen():
    x = np.ones((6, 4)) + np.eye(6, 4) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    full = np.full(6, 5)
    assert not vector_dedup.lost(x, np.arange(6), np.arange(6), full, 0.98)
    assert vector_dedup.lost(x, np.arange(6), np.arange(6), full - np.eye(6, dtype=int)[2], 0.98)
