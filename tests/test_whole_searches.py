"""Searches of every row whose id is divisible by 20 against brute force over all rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF

from tenderloom.plans import queries as plan


def _words(text):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


@pytest.fixture(scope="module")
def texts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id % 20 = 0").select("item_id", "text").collect()}
    return docs, items


def _vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    q = np.flatnonzero(ids % 20 == 0)
    s = np.round(x[q] @ x.T, 12)
    return {int(ids[i]): [(int(ids[j]), 1 - s[n, j]) for j in np.lexsort((ids, -s[n]))[:60]] for n, i in enumerate(q)}


def _ranked(docs, asked, size):
    out = {}
    for item, terms in asked.items():
        found = []
        for d, text in docs.items():
            s = 0
            for weight, zone in ((10, (text or "")[:80]), (1, text)):
                w = _words(zone)
                count = Counter(" ".join(w[i : i + size]) for i in range(len(w) - size + 1))
                s += weight * sum(count[t] for t in terms)
            if s:
                found.append((-round(s / 10 / (s / 10 + 1), 9), -d))
        out[item] = [(-d, -r) for r, d in sorted(found)[:60]]
    return {k: v for k, v in out.items() if v}


def _got(rows, value):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.tenant_id, r.pos)):
        out[r.tenant_id].append((r.tender_id, r[value]))
    return dict(out)


def _same(got, want):
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_dense_of_all(spark):
    want = _vectors(spark)
    assert len(want) == 25
    _same(_got(plan.queries()["dense_topk"](spark, SF).collect(), "distance"), want)


def test_terms_of_all(spark, texts):
    docs, items = texts
    assert max(map(len, map(_words, items.values()))) > 6
    _same(_got(plan.queries()["text_topk_terms"](spark, SF).collect(), "rank"), _ranked(docs, {i: set(_words(t)) for i, t in items.items()}, 1))


def test_phrases_of_all(spark, texts):
    docs, items = texts
    asked = {i: {" ".join(_words(t)[k : k + 3]) for k in range(len(_words(t)) - 2)} for i, t in items.items()}
    _same(_got(plan.queries()["text_topk_phrase"](spark, SF).collect(), "rank"), _ranked(docs, asked, 3))


def test_fused_of_all(spark, texts):
    docs, items = texts
    dense, text = _vectors(spark), _ranked(docs, {i: set(_words(t)) for i, t in items.items()}, 1)
    got = _got(plan.queries()["rrf_fuse"](spark, SF).collect(), "score")
    assert set(got) == set(dense) | set(text)
    for k, rows in got.items():
        score = defaultdict(float)
        for ranked in (dense.get(k, []), text.get(k, [])):
            for pos, (i, _) in enumerate(ranked, 1):
                score[i] += 1 / (60 + pos)
        assert [round(s, 9) for _, s in rows] == sorted((round(s, 9) for s in score.values()), reverse=True)[:40]
        assert all(abs(score[i] - s) < 1e-8 for i, s in rows)
