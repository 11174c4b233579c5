"""Training-data queries against SQL or a brute-force restatement, over the smallest tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import SF, same_rows

from tenderloom.llm import queries as q

SQL = q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    mine, theirs = same_rows(q.queries()[name](spark, SF), SQL[name])
    assert mine == theirs


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    from tenderloom.llm.token_text import default_tokenizer

    return Tokenizer.from_file(default_tokenizer())


def test_bpe_as_the_library(spark, docs, library):
    got = {r.doc_id: tuple(r)[1:] for r in q.op7_bpe_transducer(spark, SF).collect()}
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_token_files(spark, docs, library):
    got = {r.doc_id: tuple(r)[1:] for r in q.op9_token_output(spark, SF).collect()}
    start = 0
    for r in docs:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert got[r.doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_language_accuracy(spark, docs):
    got = q.op10_language_bitmask(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in docs}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def _luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and _luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]  # noqa: B023
            if fits():
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_pii_rules(spark, docs):
    from tenderloom.llm import pii

    odd = ["a@b.c_d@e.f x@y x@y.z 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1111  4111  1111111111111111", "+1 (743) 555-3824 +1+2345678901 +49 30 1234567.", "", None, "x" * 2000 + "1" * 2000 + "1.1.1.1 " * 600, "\U0001f642 me@x.org 9.9.9.9"]
    rows = [(r.doc_id, r.text) for r in docs] + [(9000 + i, x) for i, x in enumerate(odd)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        spans = pii_spans(text or "")
        assert got[d].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(got[d].spans.split(","))


SECRET = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def test_secret_rules(spark, docs):
    from tenderloom.llm import secret_scan

    odd = ['PassWord = "abcdefgh1" token:short api_key: xſecret=12345678', "AKIA0123456789AB AKIAX", "f" * 40 + "g" + "0" * 31, None, "", "secret=" + "a" * 5000]
    rows = [(r.doc_id, r.text) for r in docs] + [(9000 + i, x) for i, x in enumerate(odd)]
    got = {r.doc_id: r for r in secret_scan.secrets_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        out = []
        for k, (kind, pattern) in enumerate(SECRET.items()):
            for m in re.finditer(pattern, text or "", re.I | re.A if kind == "assign" else 0):
                if (len(m[2]) >= 8) if kind == "assign" else len(m[0]) >= {"access": 16, "hex": 32}[kind]:
                    out.append((m.start(), k, m.end(), kind))
        spans = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))
        assert got[d].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def words(line):
    return tuple(w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)) if w)


def dedup_lines(docs):
    """{doc_id: (lines, exact, near, text left)}: near is looked up by all variants of all earlier lines."""
    firsts, dropped, seen = {}, set(), set()
    for d, t in docs:
        for k, line in enumerate([] if t is None or d is None else t.split("\n")):
            if words(line):
                firsts.setdefault(words(line), (d, k))
    for w, _ in sorted(firsts.items(), key=lambda x: x[1]):
        if len(w) < 8:
            continue
        less = {(w[:i] + w[i + 1 :], i) for i in range(len(w))}
        if any(v in seen or (v[0], -1) in seen for v in less) or any((w, i) in seen for i in range(len(w) + 1)):
            dropped.add(w)
        seen |= less | {(w, -1)}
    out = {}
    for d, t in docs:
        lines, left, n = [] if t is None else t.split("\n"), [], [0, 0]
        for k, line in enumerate(lines):
            w = words(line)
            near = d is not None and w in dropped
            exact = not near and d is not None and bool(w) and firsts[w] != (d, k)
            n[0] += exact
            n[1] += near
            left += [] if near or exact else [line]
        out[d] = (len(lines), *n, len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def test_line_dedup(spark, docs):
    from tenderloom.llm import line_dedup

    b = "a b c d e f g h i j k l"
    odd = ["A  b c d e\tF g h i j k l\n\n\n", None, "", "\n", "x\nx\nX", b, b.replace("a", "z"), b.replace(" l", ""), b + " m", "q " + b, "a b c d e f g", "a b c d e f h", b.replace("c", "c c"), "a b c d e f g h", "a b c d e f g h i", "long " * 3000]
    rows = [(r.doc_id, r.text) for r in docs] + [(9000 + i, x) for i, x in enumerate(odd)] + [(None, b)]
    got = {r[0]: tuple(r)[1:] for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dedup_lines(rows)
    assert line_dedup.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


_BLANK = [" " if c < 128 and not chr(c).isalpha() else chr(c).lower() if c < 128 else c for c in range(256)]


def grams(text):
    """N-grams of four bytes: A-Z as a-z, what is no ASCII letter a blank, none over two blanks in a row."""
    folded = bytes(ord(x) if isinstance(x, str) else x for x in (_BLANK[b] for b in text.encode()))
    return [g for g in (folded[k : k + 4] for k in range(len(folded) - 3)) if b"  " not in g]


def language_rule(docs):
    """{doc_id: (language, share)} by plain sets: what at least two (or the share) of a language's documents hold is its own."""
    held, sizes = collections.defaultdict(collections.Counter), collections.Counter()
    for r in docs:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            held[r.lang].update(set(grams(r.text)))
            sizes[r.lang] += 1
    own = {k: {g for g, n in c.items() if n >= max(min(2, (sizes[k] + 1) // 2), 0.002 * sizes[k])} for k, c in held.items()}
    out = {}
    for r in docs:
        found = grams(r.text or "")
        count = {k: sum(g in own[k] for g in found) for k in sorted(own, key=lambda k: (-sizes[k], k))}
        best = max(count, key=count.get)
        out[r.doc_id] = (best if any(map(str.isalpha, r.text or "")) else "und", count[best] / len(found) if found else 1)
    return out


def test_language_rule(spark, docs):
    want = language_rule(docs)
    got = {r.doc_id: r.lang_pred for r in q.op10_language_bitmask(spark, SF).collect()}
    assert got == {d: x for d, (x, _) in want.items()}


def near_groups(docs):
    """{doc_id: least doc_id of its group} over all pairs of shingle sets."""
    sets = {}
    for d, t in docs:
        w = words(t or "")
        sets[d] = {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: find(d) for d in sets}


def hit(text, windows):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))


def test_pipeline_stages(spark, docs, library):
    """Every stage against brute force over the whole of its own input, and run() against the last."""
    import corpus_pipeline as p

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    left = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = left.columns, []
    for name, stage in p.STAGES:
        rows = left.collect()
        before = {r.doc_id: r.text for r in rows}
        left = stage(spark, left, SF)
        seen.append(name)
        if name == "bpe":
            break
        assert left.columns == columns
        left = left.cache()
        after = {r.doc_id: r.text for r in left.collect()}
        assert left.count() == len(after)
        if name == "language_id":
            rule = language_rule(rows)
            assert after == {d: t for d, t in before.items() if rule[d][0] != "und" and rule[d][1] >= 0.02}
        if name == "line_dedup":
            want = dedup_lines(sorted(before.items()))
            assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in after.items()} == {d: x[4] for d, x in want.items() if d in after}
            gone = {d for d in before if d not in after}
            assert all(want[d][1] + want[d][2] > 0 for d in gone) and all(words(t) or not want[d][1] + want[d][2] for d, t in after.items())
        if name == "minhash_dedup":
            group = near_groups(before.items())
            assert after == {d: t for d, t in before.items() if group[d] == d}
        if name == "decontamination":
            assert after == {d: t for d, t in before.items() if not hit(t, windows)}
    assert seen == ["language_id", "line_dedup", "minhash_dedup", "decontamination", "bpe"]
    want = []
    for d, text in before.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, p.run(spark, SF).collect())) == sorted(map(tuple, left.collect())) == sorted(want)


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls in any column, repeats, an empty table, clashing columns: nothing crashes, clean rows stay as they are."""
    import corpus_pipeline as p

    for name in ("benchmark", "documents"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(30).write.parquet(f"{tmp_path}/{name}.parquet")
    own = spark.createDataFrame([(k, f"word{k} number {k} of the text that stands here for row {k}" if k != 3 else None, None, None, None, "mine", 9) for k in (1, 2, 3, None, None, 4)] + [(4, "word4 number 4 of the text that stands here for row 4", "en", "s", 1, "mine", 9)] * 2, "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_words int")
    for left in (own, own.limit(0)):
        n = left.count()
        for name, stage in p.STAGES:
            left = stage(spark, left, str(tmp_path))
            if name != "bpe":
                assert left.columns == own.columns and {(r.n_lines, r.n_words) for r in left.collect()} <= {("mine", 9)}
        assert left.count() == (n and 5)  # of three rows of one document, one
