import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tenderloom.llm import collocations as C
from tenderloom.llm import shared

SCHEMA = "doc_id long, text string, lang string"
_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_count, longest, top):
    f, n, out = defaultdict(Counter), Counter(), []
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(_LOW)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        inner = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= c[p[i:j]]}
        scored = []
        for p, a in found.items():
            if p not in inner:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def mined(spark, rows, min_count=2, longest=5, top=2000):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in C.collocations(df, min_count, longest, top).collect())


def test_odd_rows_against_brute_force(spark):
    rows = [
        (1, None, "en"), (2, "", None), (3, "a b a b. a b\ta b", None), (4, "A B c, a b C", "und"), (5, " . ,;!?\n", "en"),
        (6, "x y z x y z", "en"), (6, "x y z x y z", "en"), (None, "é É é É\r\né É", "fr"), (7, "one two three four five six " * 300, "en"), (8, "w", ""),
    ]
    assert mined(spark, rows) == brute(rows, 2, 5, 2000)
    assert mined(spark, rows, 3, 3, 2) == brute(rows, 3, 3, 2)


def test_empty_table_and_clashing_columns(spark):
    assert mined(spark, []) == []
    df = spark.createDataFrame([("a b", "en", 1, "x", 2)] * 3, "text string, lang string, n int, phrase string, chunk int")
    assert [tuple(r) for r in C.collocations(df, 2).collect()] == [("en", 1, "a b", 3, 3, 3, 6, 2000)]


def test_products_past_64_bits(spark):
    from pyspark.sql import functions as F

    big = 1 << 40
    one = spark.createDataFrame([("en", "a", "a", big, 0, None, None, [], [])], "lang string, phrase string, last string, f long, id long, a long, b long, pf array<long>, sf array<long>")
    two = one.select("lang", F.lit("a a").alias("phrase"), "last", F.lit(big - 1).alias("f"), "id", "id", "id", F.array("f").alias("pf"), F.array("f").alias("sf")).toDF(*one.columns)
    total = spark.createDataFrame([("en", 1 << 45)], "lang string, n long")
    kept, C.phrases = C.phrases, lambda *_: ([one, two], total)
    try:
        (row,) = C.collocations(one).collect()
    finally:
        C.phrases = kept
    assert row.score == 1000 * (big - 1) * (1 << 45) // (big * big)


def test_groups_beyond_a_broadcast_are_joined(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(C, "CHUNK", 200)
    rows = [(k, f"a b c a b c {k % 4} a b. C a\tb", ("en", "de")[k % 2]) for k in range(40)]
    assert mined(spark, rows, 4) == brute(rows, 4, 5, 2000)


def test_rows_of_megabytes_are_handled_one_by_one(spark, monkeypatch, tmp_path):
    """The relation's rows of one task (one per language): each is a row group of its own and reaches Python alone, by both ways of the semi-join."""
    import pyarrow.parquet as pq

    sizes = spark.sparkContext.accumulator(0)
    extended = C._extended

    def seen(batches, kept):
        def each():
            for batch in batches:
                sizes.add(int(batch.num_rows > 1))
                yield batch

        return extended(each(), kept)

    monkeypatch.setattr(C, "_extended", seen)
    monkeypatch.setattr(C, "drop_stored", lambda df: None)
    before = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    rows = [(k, f"a b c d e a b c {k % 4} a b. C a b", f"l{k % 8}") for k in range(40)]
    for most in (shared.BROADCAST_ROWS, 0):
        folder = f"file://{tmp_path}/{most}"
        monkeypatch.setattr(shared, "BROADCAST_ROWS", most)
        monkeypatch.setattr(shared, "new_path", lambda spark, name, folder=folder: f"{folder}/{name}")
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        assert sorted(tuple(r) for r in C.collocations(df, 4).collect()) == brute(rows, 4, 5, 2000)
        for k in range(1, 6):
            groups = [f.metadata.row_group(g).num_rows for p in (tmp_path / str(most) / f"setm-{k}").glob("*.parquet") for f in [pq.ParquetFile(p)] for g in range(f.metadata.num_row_groups)]
            assert len(groups) == 8 and max(groups) == 1, (k, groups)
    assert sizes.value == 0
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == before


@pytest.mark.parametrize("chunk", [1, 40, 8 << 20])
def test_chunks_of_any_size(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rows = [(k, f"the cat sat on the mat, the cat {k % 3} sat. on the mat", ("en", "de", None)[k % 3]) for k in range(30)]
    assert mined(spark, rows, 5) == brute(rows, 5, 5, 2000)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.text("abA .,\t\n", max_size=60), st.sampled_from(["x", "y", None])), max_size=12))
def test_random_texts(spark, rows):
    assert mined(spark, rows, 2, 4) == brute(rows, 2, 4, 2000)
