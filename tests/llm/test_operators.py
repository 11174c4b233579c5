"""Edge cases of the training-data operators: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import bpe, chat_format, decontaminate, line_dedup, language_id, minhash_dedup, shared, token_output, token_text, vector_dedup

DOCS = "doc_id long, text string"
PATH = token_text.default_tokenizer()
ODD = ["Hi <|endoftext|>x THE it's 2½ a_b Σας ΑΣ İ ß ﬁ x\x1cy\x1f z", "日本語 中文\U0001f642 क्षि", "", "́abc é", "don't WON'T 's's'll", "<|endoftext|><|startoftext|>", "a\xa0b c　d", "Ⅷ ²³ ٣ 1234", "\x01 a\x01b \x01\x01", "x" * 300, "thereandback" * 40, "a" * 63 + " " + "ab" * 32 + " " + "é" * 40, "the" * 3000]


def test_encoders_agree_with_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    merges = bpe.Merges.of(PATH)
    lexicon = bpe.Lexicon.compile(dict(zip(some := [b"the", b"bath", b"math", b"them", b"x"], merges.merge(some), strict=True)))
    ours, cached = bpe.Encoder(merges, lexicon, memo=3), bpe.Encoder(merges, bpe.Lexicon.compile({}), 3, token_output.LibraryWords(PATH))
    for text in ODD * 2:
        ids = library.encode(text, add_special_tokens=False).ids
        for coder in (ours, cached):
            assert coder.encode(pa.array([text]))[0].tolist() == ids
    whole = [library.encode(x, add_special_tokens=False).ids for x in ODD]
    for coder in (ours, cached):
        ids, bounds = coder.encode(pa.array([None, *ODD, ""]).slice(1))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [*whole, []]
    assert (lexicon.find(pa.array([b"the", b"math", b"mat", b"", b"q"])) >= 0).tolist() == [True, True, False, False, False]


@pytest.mark.parametrize("seed", range(4))
def test_splitting_as_the_library(seed):
    """Random texts of every kind of character that the tables know, with apostrophes everywhere."""
    from tokenizers import Tokenizer

    library, r = Tokenizer.from_file(PATH), np.random.default_rng(seed)
    kinds = [*("'" * 3 + "stmdrevlRE 19.,!\n<|\x85"), *map(chr, range(0xA0, 0x180)), *map(chr, range(0x370, 0x400)), *map(chr, range(0x2FE, 0x302))]
    usual = kinds[:27]
    texts = ["".join(r.choice(usual if k % 2 else kinds, r.integers(0, 40))) for k in range(400)]
    merges = bpe.Merges.of(PATH)
    for coder in (bpe.Encoder(merges, bpe.Lexicon.compile({b"s": merges.merge([b"s"])[0]})), bpe.Encoder(merges, bpe.Lexicon.compile({}), merge=token_output.LibraryWords(PATH))):
        ids, bounds = coder.encode(pa.array(texts))
        for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text



def test_word_table_against_the_library():
    """Ids are the library's however few words the table keeps, odd characters and special strings among them; a word met before is not merged again."""
    from tokenizers import Tokenizer

    library, r = Tokenizer.from_file(PATH), np.random.default_rng(11)
    library.no_truncation()
    letters = list("abcdeé'’ß12 \n.,İ한語e\u0301\u00a0") + ["</s>", "don't", " the ", "🙂"]
    texts = pa.array([None, "", " ", *["".join(r.choice(letters, int(n))) for n in r.integers(1, 60, 120)], "x" * 5000])
    want = [library.encode(x or "", add_special_tokens=False).ids for x in texts.to_pylist()]
    asked = []

    class Asked(token_output.LibraryWords):
        def ids(self, words):
            asked.append(len(words))
            return super().ids(words)

    for limits in ({}, {"most": 5}, {"most_bytes": 100}):
        table = token_output.WordTable(bpe.Merges.of(PATH), Asked(PATH), **limits)
        for part in (texts, texts.slice(60), texts.slice(0, 3), texts):
            asked.clear()
            ids, bounds = table.encode(part)
            at = 0 if len(part) == len(texts) or part[0].as_py() is None else 60
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want[at : at + len(part)]
        assert limits or not asked


def test_encode_then_decode(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rows = [(i, x) for i, x in enumerate(ODD)] + [(90, None), (None, "a b"), (0, ODD[0])]
    docs = spark.createDataFrame(rows, DOCS)
    name = bpe.build_lexicon(docs, PATH, most=5)
    apart = bpe.decode(bpe.encode(docs, PATH, name), PATH).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert sorted(map(tuple, apart), key=str) == sorted(map(tuple, bpe.round_trip(docs, PATH, name).collect()), key=str)
    want = {i: library.decode(library.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, x in rows}
    assert all(r.text == want[r.doc_id] for r in sorted(apart, key=key)) and len(apart) == len(rows)
    assert bpe.encode_digests(docs.limit(0), PATH).count() == 0


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, most in ((1, 0), (5, 0), (300, 10), (1000, 10**9), (200, 255), (400, -1)):
        v = np.sort(r.integers(0, most + 1, n)) if most >= 0 else np.concatenate([np.arange(200), 10**6 + np.arange(200)])
        most = int(v[-1])
        ef = token_output.EliasFano.of(v)
        assert (ef.all() == v).all() and (ef.select(np.arange(n)) == v).all()
        assert len(ef.low) + len(ef.high) <= n * (max(1, most // n).bit_length() + 3) / 8 + 16


def test_token_files_with_odd_rows(spark, tmp_path):
    rows = [(None, "b"), (3, None), (1, "a b"), (3, ""), (3, "z"), (2, "word " * 5000)]
    folder = f"file://{tmp_path}/t"
    token_output.write_tokens(spark.createDataFrame(rows, DOCS), folder, PATH, shard_ids=100)
    got = token_output.read_tokens(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 3]
    assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)])[:-1])
    assert token_output.token_index(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_fm_index_counts_and_places():
    r = np.random.default_rng(2)
    for _ in range(5):
        text = r.integers(1, 5, 400)
        index = decontaminate.FMIndex(text)
        patterns = r.integers(1, 6, (40, 3))
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi, strict=True):
            places = [i for i in range(398) if (text[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == places


def test_contamination_in_blocks(spark):
    bench = spark.createDataFrame([(1, "The of"), (2, "and"), (3, None), (4, ""), (5, "the OF"), (None, "the"), (6, "a b c d e f g h i j k")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x the of and", 7), (2, None, 7), (3, "", 7), (4, "THE! of", 7), (5, "a b c d e f g h i j k", 7), (6, "a b c d e f g h i k", 7)], f"{DOCS}, n_words int")
    for block in (1, 10**6):
        got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, block_words=block).collect()}
        assert {d: (r.n_words, list(zip(r.hit_from, r.hit_to, strict=True)), r.hit_items) for d, r in got.items()} == {1: (4, [(1, 4)], [1, 2, 5]) if block > 1 else (4, [(1, 4)], [1, 2, 5]), 2: (0, [], []), 3: (0, [], []), 4: (2, [(0, 2)], [1, 5]), 5: (11, [(0, 11)], [6]), 6: (10, [], [])}
    clean = decontaminate.clean(docs.withColumn("_hit_items", F.lit("x")), bench)
    assert clean.columns == [*docs.columns, "_hit_items"] and {(r.doc_id, r.n_words, r._hit_items) for r in clean.collect()} == {(k, 7, "x") for k in (2, 3, 6)}
    none = decontaminate.contamination(docs, bench.limit(0)).orderBy("doc_id").collect()
    assert [r.n_words for r in none] == [4, 0, 0, 2, 11, 10]


def test_minhash_with_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base.upper()), (2, base.upper()), (3, base + " tail"), (4, None), (5, " \n"), (6, "one two"), (7, "ONE  two"), (8, "one"), (None, base), (9, base + " end"), (9, "else"), (None, None)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], f"{DOCS}, component_id string")
    got = sorted((tuple(r) for r in minhash_dedup.near_duplicates(docs).collect()), key=str)
    want = [(1, 56, 1, True), (2, 56, 1, False), (2, 56, 1, False), (3, 57, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True), (9, 1, 9, True), (9, 57, 1, False), (None, 0, None, True), (None, 56, None, True)]
    assert got == sorted(want, key=str)
    kept = minhash_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, base), (4, None), (5, " \n"), (6, "one two"), (8, "one"), (9, "else"), (None, base), (None, None)], key=str)
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_minhash_keeps_one_row_of_each_group(spark):
    """Rows of one doc_id: equal ones are one row, near ones one group, others stay."""
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base, "a"), (1, base, "b"), (1, base + " more", "c"), (1, "something else", "d"), (1, "something else", "d"), (1, "something else", "d"), (2, None, "e"), (2, None, "e"), (2, "", "f"), (3, base, "g"), (None, base, "h"), (None, base, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = minhash_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got in [sorted([(1, x), (1, "something else"), (2, None), (2, ""), (None, base), (None, base)], key=repr) for x in (base, base + " more")]
    three = spark.createDataFrame(rows[:3], docs.schema)
    assert minhash_dedup.one_of_each(three).count() == 1 and minhash_dedup.one_of_each(three).collect() == minhash_dedup.one_of_each(three).collect()


def test_minhash_as_brute_force(spark):
    """Families of texts around the bound, chained copies, and a passage that all share: components as of all pairs."""
    r = np.random.default_rng(8)
    passage, texts = [f"p{i}" for i in range(30)], []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(int(r.integers(20, 120)))]
        for _ in range(int(r.integers(2, 12))):
            words = list(base)
            for _ in range(int(r.integers(0, 5))):
                words[int(r.integers(len(words)))] = f"x{int(r.integers(10**6))}"
            texts.append(" ".join(words if f % 2 else [*passage, *words]))
            base = words if r.random() < 0.5 else base
    texts += [" ".join([*passage, *(f"s{k}q{i}" for i in range(3 + k % 9))]) for k in range(60)]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {k: find(k) for k in range(len(texts))}
    assert len(set(got.values())) < len(got)


def test_sketch_keeps_what_is_similar():
    """Pairs just above the bound must pass the sketch."""
    r = np.random.default_rng(3)
    for n in (4, 20, 100, 1000):
        for _ in range(50):
            common = r.integers(0, 2**63, int(n * 0.9), dtype=np.uint64)
            sets = [np.unique(np.concatenate([common, r.integers(0, 2**63, n - len(common), dtype=np.uint64)]) * np.uint64(2) + np.uint64(1)) for _ in range(2)]
            x = minhash_dedup.sketches(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
            count = lambda v: int(np.bitwise_count(v).sum())
            both, either = count(x[0, :4] & x[1, :4]), count(x[0, :4] | x[1, :4])
            differ = count((x[0, 4:] ^ x[1, 4:]) & x[0, :4] & x[1, :4])
            assert both - 2 * differ >= 0.75 * either - 3.2 * either**0.5


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7), (200, 200)]
    got = {r.id: r.component_id for r in shared.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_with_odd_rows(spark, kind):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [2.0, 0.0], 0), (4, [1.0, 0.0], 1), (5, None, 0), (6, [0.0, 0.0], 0), (7, [float("nan"), 1.0], 0), (8, [1.0, None], 0), (9, [1.0, 0.0], None), (10, [1.0, 0.0], 0), (11, [], 0), (12, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (13, [0.0, 1.0], 2), (13, [1.0, 0.0], 2), (14, [1.0, 0.02], 2), (14, [1.0, 0.02], 2)]
    vectors = spark.createDataFrame([(*r, 7) for r in rows], f"vec_id long, embedding array<{kind}>, label int, n_links int")
    got = sorted((tuple(r) for r in vector_dedup.near_duplicates(vectors).collect()), key=str)
    linked = {1, 2, 3, 10}
    want = [(i, 3, 1, i == 1) if i in linked else (i, 0, i, True) for i in range(1, 13)] + [(None, 0, None, True), (13, 0, 13, True), (13, 1, 13, True), (14, 1, 13, False), (14, 1, 13, False)]
    assert got == sorted(want, key=str)
    assert vector_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_graph_search_recall():
    r = np.random.default_rng(5)
    centres = r.normal(size=(60, 32))
    x = np.concatenate([c + r.normal(scale=0.05, size=(12, 32)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, h = vector_dedup.range_search(x, vector_dedup.neighbour_graph(x), np.arange(len(x)), 0.98)
    s = x @ x.T
    np.fill_diagonal(s, 0)
    true = set(zip(*np.nonzero(s >= 0.98), strict=True))
    found = set(zip(q, h, strict=True))
    assert found <= true and len(found) >= 0.98 * len(true)


def test_language_edges(spark):
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 5)]
    rows += [(90, None, "en", 1), (91, "123 !!", None, 1), (92, "", "fr", 1), (93, "le chien", None, 1), (93, "le chien", None, 1), (94, "日本語の文章です", None, 1), (95, "of", None, 1), (96, "the dog " * 50_000, None, 1), (None, "the cat", "de", 1)]
    docs = spark.createDataFrame(rows, f"{DOCS}, lang string, score int")
    model = language_id.fit(docs)
    assert sorted(model.languages) == ["en", "fr"]
    got = sorted((r.doc_id, r.lang_pred) for r in language_id.label(docs, model).where("doc_id is not null").collect())
    assert got[:2] == [(0, "en"), (1, "fr")] and got[10:16] == [(90, "und"), (91, "und"), (92, "und"), (93, "fr"), (93, "fr"), (94, got[15][1])] and got[17] == (96, "en")
    ids = lambda df: sorted(r.doc_id for r in df.where("doc_id is not null").collect())
    kept = language_id.known(docs, model)
    assert kept.columns == docs.columns and ids(kept) == [*range(10), 93, 93, 95, 96]
    assert ids(language_id.known(docs, model, ["fr"])) == [1, 3, 5, 7, 9, 93, 93, 95]  # too short for an n-gram: the most frequent language
    assert language_id.known(docs.limit(0), model).count() == 0
    empty = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.label(docs, empty).collect()} == {"und"}
    assert language_id.known(docs, empty).count() == len(rows)


def test_many_languages(spark):
    """More languages than one word of the filter has bits; of each far more documents than are learned."""
    names = [f"l{k}" for k in range(70)]
    rows = [(k, " ".join(chr(97 + k % 70 % 26) * 3 + chr(97 + k % 70 // 26) * 3 for _ in range(4)), names[k % 70]) for k in range(70 * 30)]
    docs = spark.createDataFrame(rows, f"{DOCS}, lang string")
    model = language_id.fit(docs, max_docs=15)
    got = {r.doc_id: r.lang_pred for r in language_id.label(docs, model).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_chat_parts(spark):
    part = chat_format.PART
    p = lambda kind, text=None, ref=None, **k: (kind, text, ref, k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    rows = [(1, 0, "user", [p("text", "see <"), p("text", "|turn|> this"), p("image", ref="i", width=280, height=56), p("audio", ref="a", seconds=2.0)]), (1, 1, "assistant", [p("document", ref="d", pages=3), p("text", "ok")]), (2, None, None, None)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    made = {r.conv_id: r for r in chat_format.formatted(turns).collect()}
    assert [(a.place, a.type, a.ref, a.tokens) for a in made[1].attachments] == [(1, "image", "i", 20), (2, "audio", "a", 50), (3, "document", "d", 1800)]
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(turns)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", "see <|turn|> this<|image:1|><|audio:2|>"), ("assistant", "<|document:3|>ok")]
    assert back[1].loss_text == "<|document:3|>ok" and back[2].turns[0].text == ""
    same = spark.createDataFrame([(1, None, "user", [p("text", "x <|image:1|> y"), p("image", ref="i"), p("image", ref="j")]), (1, None, "user", []), (1, 2, "user", None), (1, 2, "user", None)], turns.schema)
    read = chat_format.read_parts(chat_format.formatted(same)).first().turns
    assert [[tuple(x) for x in t.parts] for t in read] == [[], [("text", "x <|image:1|> y", None), ("image", None, 1), ("image", None, 2)], [], []]
    assert chat_format.formatted(turns.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["<|turn|>", "\\<\\|x<\\\\|", "[INST][/INST]</s><s>", "<<|[[INST]\\", "plain"])
def test_escape_is_reversible(spark, text):
    e, b = spark.range(1).select(chat_format.escaped(F.lit(text)).alias("e"), chat_format.restored(chat_format.escaped(F.lit(text))).alias("b")).first()
    assert b == text and not any(c in e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


def test_shingles_of_sliced_columns():
    texts = pa.array(["skip me please now ok", None, "a b c d e f", ""])
    sets, bounds = minhash_dedup.shingle_sets(texts.slice(1))
    assert bounds.tolist() == [0, 0, 2, 2] and len(sets) == 2


def test_lines_of_rows_that_share_an_id(spark):
    from tenderloom.llm import line_dedup

    rows = [(1, "p q\nkeep me here", "u"), (1, "p q\nanother line", "u"), (0, "keep me here", "u"), (2, "a b\na b", "u"), (2, "a b\na b", "u"), (3, "p q", "u"), (None, "p q", "u"), (4, None, "u")]
    docs = spark.createDataFrame(rows, f"{DOCS}, n_lines string")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.deduplicated(docs).collect()), key=str)
    first, second = sorted(got[1:3], key=lambda x: len(x[1]))
    assert got[0] == (0, "keep me here") and (second in [(1, "p q\nanother line"), (1, "another line")]) and first in [(1, "p q"), (1, "")]
    assert got[3:] == [(2, "a b"), (2, "a b"), (3, ""), (4, None), (None, "p q")]
    left = line_dedup.without_copies(docs)
    assert left.columns == docs.columns and {r.n_lines for r in left.collect()} == {"u"}
    assert sorted(str(r.doc_id) for r in left.collect() if r.doc_id != 1) == ["0", "2", "2", "4", "None"]
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def test_very_long_addresses(spark):
    from tenderloom.llm import pii

    text = "a@" + ".".join(["x"] * 20_000) + " b@c.d " + "y." * 20_000 + "z@q.r"
    found = pii.find(spark.createDataFrame([(1, text), (1, text)], DOCS), None).select("base").collect()
    assert [[(x.s, x.e) for x in r.base] for r in found] == [[(0, 40_001), (40_002, 40_007), (40_008, 80_013)]] * 2
    assert pii.find(spark.createDataFrame([], DOCS), None).count() == 0


def test_other_columns_are_not_read(spark):
    """Columns that clash with an operator's own, repeats and empty tables, for what reads only doc_id and text."""
    from tenderloom.llm import pii, secret_scan

    docs = spark.createDataFrame([(1, "mail a@b.c password=abcdefgh1", 5, 6), (1, "mail a@b.c password=abcdefgh1", 5, 6), (2, None, 5, 6)], f"{DOCS}, ids int, spans int")
    plain = docs.select("doc_id", "text")
    for run in (pii.report, secret_scan.secrets_report, lambda d: bpe.encode_digests(d, PATH), lambda d: token_output.token_index(d, PATH)):
        rows = [sorted(map(tuple, run(d).collect())) for d in (docs, plain)]
        assert rows[0] == rows[1] and len(rows[0]) == 3
        assert run(docs.limit(0)).count() == 0


def test_texts_of_one_id_whose_short_hashes_are_equal(spark):
    """Two texts of one doc_id with the same last 31 bits of their hashes: no line is lost to the other's, and nothing crashes."""
    import xxhash

    near = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    seen, pair = {}, None
    for k in range(400_000):
        text = f"keep this line {k}\nand this\n{near}\n{near} lambda" if k % 2 else f"short {k}"
        bits = xxhash.xxh64(text.encode(), seed=42).intdigest() & 0x7FFFFFFF
        other = seen.setdefault(bits, text)
        if other is not text and ("short" in other) != ("short" in text):
            pair = (other, text)
            break
    assert pair is not None
    rows = [(1, f"{near}\nshort of it\n{near}s"), (5, pair[0]), (5, pair[1]), (5, pair[1]), (7, f"{near} lambda")]
    got = {(r.doc_id, r.text) for r in line_dedup.deduplicated(spark.createDataFrame([(*r,) for r in rows], "doc_id long, text string")).collect()}
    long, short = sorted(pair, key=len, reverse=True)
    first = long.split("\n")
    assert got == {(1, f"{near}\nshort of it"), (5, "\n".join(first[:2])), (5, short), (7, "")}


def test_many_texts_of_one_id(spark):
    """Three hundred texts share an id: each is a document of its own, in the order of its hash."""
    rows = [(1, f"own line {k}\nshared by all\nown too {k}") for k in range(300)] + [(2, "shared by all"), (0, "before them")]
    left = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(left) == 302 and sum("shared by all" in r.text for r in left) == 1 and sum(r.n_exact for r in left) == 300
    assert all(f"own line {k}" in " ".join(r.text for r in left) for k in range(300))
