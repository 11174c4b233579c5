import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50):
    v = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        v.append((i, [int(np.floor(256 * x)) for x in e], label))
    out = []
    for i, a, label in v:
        if i % every:
            continue
        score = [(-sum(x * y for x, y in zip(a, b, strict=True)), j, kind) for j, b, kind in v if j != i and len(a) == len(b)]
        for p, j, _ in sorted(x for x in score if x[2] == label)[:5]:
            fits = sorted((n, k) for n, k, kind in score if kind != label and 50 * -p <= 100 * -n <= 95 * -p)[:3]
            out += [(i, j, r, k, -p, -n) for r, (n, k) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, every=50):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in H.mine(df, every).collect())


def clustered(n, dim=6, seed=3, spread=0.2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    which = r.integers(0, 12, n)
    return [(k, [float(x) for x in centres[c] + spread * r.normal(size=dim)], int(c % 4 if k % 3 else 0)) for k, c in enumerate(which)]


def test_clusters_in_small_blocks(spark, monkeypatch):
    for name, size in {"BLOCK": 16, "GROUP": 3, "PACK": 5, "BUCKET": 2, "ZONES": 7}.items():
        monkeypatch.setattr(H, name, size)
    rows = clustered(600)
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.4], 1), (2, [0.9, 0.4], 1), (3, [0.7, 0.3], 2), (4, [0.7, 0.3], 2), (5, [0.7, 0.3], 2), (6, [0.7, 0.3], 2), (7, [-1.0, 0.0], 1), (8, [0.0, 0.0], 2), (9, [0.6, 0.35], 3),
        (50, [0.0, 0.0], 1), (100, [1.0, 1.0, 1.0], 1), (101, [1.0, 1.0, 1.0], 1), (102, [0.8, 0.8, 0.8], 2), (150, [], 1), (151, [], 1), (152, [], 2), (200, [-0.3, 0.1], 4), (10, None, 1), (11, [nan, 0.0], 1), (12, [inf, 0.0], 2), (13, [None, 1.0], 1), (14, [1.0, 0.5], None), (None, [1.0, 0.5], 1),
        (0, [0.2, 0.9], 2), (250, [0.004, -0.004], 2),
    ]
    assert mined(spark, rows) == brute(rows)


def test_empty_table_no_anchor_and_clashing_columns(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [0.9], 2)]) == []
    df = spark.createDataFrame(clustered(120), SCHEMA).withColumns({c: F.lit("x") for c in ("q", "pack", "rank", "b", "dim")})
    assert sorted(tuple(r) for r in H.mine(df).collect()) == brute(clustered(120))


def test_scores_past_doubles_are_exact_and_past_longs_an_error(spark):
    rows = [(0, [1e6, 1.0 / 256], 1), (1, [1e6, 2.0 / 256], 1), (2, [1e6, 3.0 / 256], 1), (3, [9e5, 1.0 / 256], 2), (4, [9e5, 2.0 / 256], 2)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(ValueError, match="beyond"):
        H.products(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_bounds_hold_and_spare_blocks(spark, monkeypatch):
    """Every score lies within its block's bounds, and in clustered vectors windows leave most groups of blocks unread."""
    for name, size in {"BLOCK": 32, "GROUP": 1, "PACK": 4}.items():
        monkeypatch.setattr(H, name, size)
    r = np.random.default_rng(5)
    a, x = r.integers(-99, 99, (7, 5)), r.integers(-99, 99, (40, 5))
    low, high = H.bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
    s = a @ x.T
    assert (low <= s.min(axis=1, keepdims=True)).all() and (high >= s.max(axis=1, keepdims=True)).all()
    df = spark.createDataFrame(clustered(2000, spread=0.02), SCHEMA).select("vec_id", "label", H.components("embedding").alias("q"))
    blocks, n = H.write_blocks(df)
    packs, m = H.anchor_packs(blocks)
    assert blocks.select(F.sum(F.size("ids"))).first()[0] == 2000 and packs.select(F.sum(F.size("ids"))).first()[0] == 40
    best = packs.select("pack", F.transform("ids", lambda _, k: F.struct(k.cast("long").alias("at"), F.lit(1).cast("long").alias("k"), F.lit(150000).cast("long").alias("least"), F.lit(10**9).cast("long").alias("most"))).alias("windows"))
    read = H._meeting(packs.join(best, "pack"), m, blocks, n, False, True).count()
    assert 0 < read < m * n / 2


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_steps_to_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    place = H.hilbert_index(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
