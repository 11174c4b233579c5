"""Mean pooling by a tree of sums."""

import numpy as np
import pytest

from tenderloom.operators import retrieval as Q


def test_a_thousand_dimensions_over_many_tasks(spark, monkeypatch):
    """Sums stay arrays: no step has a row per dimension; tasks hand on what they hold, and hot groups are merged in levels."""
    monkeypatch.setattr(Q, "FAN", 2)
    monkeypatch.setattr(Q, "HELD", 40_000)
    r = np.random.default_rng(2)
    rows = [(None if k % 11 == 0 else int(r.integers(0, 3)) if k % 2 else 7, float(k % 5), [float(x) for x in r.normal(size=1024)]) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, w double, v array<double>").repartition(9)
    got = {x.g: np.array(x.v) for x in Q.mean_pool(df, "g", "v", "w").collect()}
    for g in {x[0] for x in rows}:
        mine = [(w, np.array(v)) for h, w, v in rows if h == g]
        assert np.allclose(got[g], sum(w * v for w, v in mine) / sum(w for w, _ in mine))
    assert len(got) == 5 and "Generate" not in Q.mean_pool(df, "g", "v", "w")._jdf.queryExecution().toString()


def test_zero_weights_nulls_and_errors(spark):
    df = spark.createDataFrame([(1, 0.0, [1.0, 2.0]), (1, 0.0, [3.0, 4.0]), (2, 1.0, None), (3, 2.0, [5.0, 5.0])], "g int, w double, v array<double>")
    assert {r.g: r.v for r in Q.mean_pool(df, "g", "v", "w").collect()} == {1: [2.0, 3.0], 3: [5.0, 5.0]}
    assert Q.mean_pool(df.limit(0), "g", "v", "w").collect() == []
    with pytest.raises(Exception, match="different lengths"):
        Q.mean_pool(spark.createDataFrame([(1, 1.0, [1.0]), (1, 1.0, [1.0, 2.0])], df.schema), "g", "v", "w").collect()
    with pytest.raises(Exception, match="negative"):
        Q.mean_pool(spark.createDataFrame([(1, -1.0, [1.0])], df.schema), "g", "v", "w").collect()
