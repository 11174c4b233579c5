"""Every query outside the training-data operators against its SQL."""

import pytest
from conftest import SF, same_rows

from tenderloom.plans import queries as plan

SQL = plan.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    mine, theirs = same_rows(plan.queries()[name](spark, SF), SQL[name])
    assert mine == theirs


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["tenant_id", "company_name", "n", "subject", "items"]


def test_chunks_keep_their_places(spark):
    from test_functions import restated

    rows = plan.queries()["chunk_text"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, a, b) for r in docs for _, a, b in restated(r.text or "", 1500, 200)]
    assert all(r.same for r in rows) and sorted((r.doc_id, r.start, r.end) for r in rows) == sorted(want)


def test_slugs_as_the_rule(spark):
    import re

    bases = {r.c_custkey: re.sub("[^a-z0-9]+", "-", f"{r.c_mktsegment} & {r.c_nationkey}".lower() if r.c_nationkey > 1 else r.c_mktsegment.lower()).strip("-") for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    used, want = {f"building-{k}" for k in range(25) if str(k).endswith("2")}, {}
    for key in sorted(bases):
        k, name = 1, bases[key]
        while name in used:
            k += 1
            name = f"{bases[key]}-{k}"
        used.add(name)
        want[key] = name
    assert {r.c_custkey: r.unique_slug for r in plan.queries()["unique_slug"](spark, SF).collect()} == want
