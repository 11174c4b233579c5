import numpy as np
import pytest

from tenderloom.operators import neighbours as N
from tenderloom.operators import retrieval as Q

P, T = "tenant_id long, embedding array<float>", "tender_id long, embedding array<float>"


def brute(profiles, tenders, k):
    out = []
    unit = lambda v: np.array(v, np.float32).astype(float) / max(np.linalg.norm(np.array(v, np.float32).astype(float)), 1e-300)
    for tenant, p in profiles:
        if p is not None:
            found = sorted((round(1 - round(float(np.clip(unit(p) @ unit(t), -1, 1)), 12), 9), i) for i, t in tenders if t is not None)
            out += [(tenant, i, d, n) for n, (d, i) in enumerate(found[:k], 1)]
    return sorted(out)


def found(spark, profiles, tenders, k):
    df = N.dense_topk(spark.createDataFrame(profiles, P), spark.createDataFrame(tenders, T), k)
    return sorted((r.tenant_id, r.tender_id, round(r.distance, 9), r.pos) for r in df.collect())


def clustered(n, centres, dim, spread, seed):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    return [(k, [float(x) for x in c[j] + spread * r.normal(size=dim)]) for k, j in enumerate(r.integers(0, centres, n))]


@pytest.fixture
def small(monkeypatch):
    for name, size in {"RING": 8, "GROUP": 2, "PACK": 5, "BUCKET": 2, "CHUNK": 9, "PIVOTS": 6}.items():
        monkeypatch.setattr(N, name, size)


def test_nulls_zeros_ties_and_more_asked_than_there(spark, small):
    t = [(i, [1.0, float(i % 4)]) for i in range(30)] + [(70, [0.0, 0.0]), (71, None), (72, [-1.0, 0.0]), (5, [1.0, 1.0])]
    p = [(i, [float(i), 1.0]) for i in range(5)] + [(9, None), (10, [0.0, 0.0]), (3, [1.0, 0.0])]
    for k in (1, 3, 50):
        assert found(spark, p, t, k) == brute(p, t, k)


def test_empty_sides(spark):
    some = [(1, [1.0, 2.0])]
    assert found(spark, [], some, 3) == found(spark, some, [], 3) == found(spark, [(1, None)], some, 3) == []


def test_clusters_and_noise(spark, small):
    t = clustered(700, 5, 6, 0.3, 1) + [(1000 + k, v) for k, v in clustered(150, 150, 6, 1, 2)]
    p = [t[i] for i in range(0, 850, 20)]
    assert found(spark, p, t, 7) == brute(p, t, 7)


def test_bounds_hold_and_rings_are_left_out(spark, small):
    """No vector is nearer than its ring's bound; in clusters the second round reads few rings, and reads are no more rounds for more queries."""
    t = clustered(2000, 12, 8, 0.02, 3)
    rows = spark.createDataFrame(t, "id long, vector array<float>")
    pivots = N.fit_pivots(rows, 12, 500)
    rings, n = N._write_rings(rows, pivots)
    packs, m = N._write_packs(rows.where("id % 50 = 0"), pivots)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    queries = np.array([unit(v) for _, v in t[::50]])
    read = rings.collect()
    assert sum(r.n for r in read) == 2000
    for r in read:
        x = np.array(r.x).reshape(r.n, -1)
        bound = N.least_angles(queries, pivots, np.array([r.pivot]), np.array([r.inner]), np.array([r.outer]))[:, 0]
        assert (np.arccos(np.clip(queries @ x.T, -1, 1)).min(axis=1) >= bound - 1e-7).all()
    from pyspark.sql import functions as F

    reach = packs.withColumn("reach", F.transform("ids", lambda _: F.lit(0.1)))
    assert 0 < N.units(reach, m, rings, n, pivots, 5).count() < m * rings.select("grp").distinct().count() / 3


def test_phrases_are_joined_by_occurrence_alone(spark):
    """The join of runs and phrases yields the occurrences and no more, though one word is everywhere."""
    docs = spark.createDataFrame([(1, "the the the cat", "the cat the cat sat"), (2, None, "THE, cat!"), (3, "", "cat the"), (4, "a b", "the cat sat the cat sat")], "tender_id long, title string, text string")
    phrases = spark.createDataFrame([("the cat", ["the", "cat"]), ("the cat sat", ["the", "cat", "sat"]), ("no such phrase", ["no", "such", "phrase"]), ("the the", ["the", "the"])], "phrase string, words array<string>")
    hits = Q.phrase_hits(docs, {"title": "A", "text": "D"}, phrases)
    got = sorted((r.phrase, r.tender_id, r.zone) for r in hits.collect())
    assert got == sorted([("the cat", 1, "A"), ("the cat", 1, "D"), ("the cat", 1, "D"), ("the cat sat", 1, "D"), ("the the", 1, "A"), ("the the", 1, "A"), ("the cat", 2, "D")] + [("the cat", 4, "D"), ("the cat sat", 4, "D")] * 2)


def test_phrases_of_mixed_length_rank_like_counted_ones(spark):
    docs = spark.createDataFrame([(i, "x", "alpha beta gamma " * (i % 4) + "beta gamma") for i in range(9)], "tender_id long, title string, text string").selectExpr("*", "timestamp'1998-01-01' AS published_at")
    asked = spark.createDataFrame([(1, "alpha beta"), (1, "Beta"), (1, "beta, gamma"), (2, "gamma alpha beta"), (2, ""), (3, "zeta eta")], "tenant_id long, term string")
    got = {(r.tenant_id, r.tender_id): round(r.rank, 6) for r in Q.text_topk(asked, docs, {"title": "A", "text": "D"}).collect()}
    score = lambda s: round(s / (s + 1), 6)
    want = {(1, i): score(0.1 * (i % 4) + 0.2 * (i % 4 + 1)) for i in range(9)} | {(2, i): score(0.1 * (i % 4 - 1)) for i in range(9) if i % 4 > 1}
    assert got == want
