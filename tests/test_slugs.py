"""Slugs by gaps against the rule, row by row."""

import numpy as np
import pandas as pd
import pytest

from tenderloom.operators.slugs import scan, unique_slugs


def rule(rows, taken=()):
    used, last, out = set(taken), {}, {}
    for i, base in sorted(rows):
        k = last.get(base, 1)
        while (name := base if k == 1 else f"{base}-{k}") in used:
            k += 1
        used.add(name)
        last[base], out[i] = k, name
    return out


def got(spark, rows, taken=None):
    t = None if taken is None else spark.createDataFrame([(x,) for x in taken], "slug string")
    return {r.id: r.unique_slug for r in unique_slugs(spark.createDataFrame(rows, "id long, slug string"), "slug", ["id"], t).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_families_as_the_rule(spark, seed):
    """Chains of suffixes that are bases themselves (a, a-2, a-2-2, a-3 …), with names that are taken already."""
    r = np.random.default_rng(seed)
    names = ["a", "a-2", "a-3", "a-2-2", "a-2-3", "a-2-2-2", "a-10", "b", "b-1", "b-02", "b-2", "c-5", "a-99999999999999999999", ""]
    weight = r.dirichlet(np.full(len(names), 0.4))
    rows = [(int(i), str(x)) for i, x in enumerate(r.choice(names, 150, p=weight))]
    r.shuffle(rows)
    taken = [str(x) for x in r.choice([f"{n}-{k}" if k > 1 else n for n in names for k in range(1, 9)], 12 * (seed % 3))]
    rows = [(int(i), str(x)) for i, x in rows]
    want = rule(rows, taken)
    assert len(set(want.values())) == len(rows)
    assert got(spark, rows, taken if seed else None) == want


def test_nulls_empty_and_one_name_for_all(spark):
    assert got(spark, []) == {}
    rows = [(i, "same") for i in range(300)] + [(1000, None)]
    assert got(spark, rows, ["same-7", "same-8", "same-300"]) == rule(rows[:-1], ["same-7", "same-8", "same-300"]) | {1000: None}


def test_scan_looks_at_pairs_alone():
    """Suffix 2 is met before the base comes to it, 3 after, 5 is taken."""
    found = scan(pd.DataFrame({"base": "a", "k": [5, 2, 3, 5], "before": [0, 1, 9, 4], "child": [None, "a-2", "a-3", "a-5"]}))
    assert list(zip(found["k"], found["held"], found["row"].fillna(-1), strict=True)) == [(2, True, 2), (3, False, -1), (5, True, 4), (5, True, -1)]
