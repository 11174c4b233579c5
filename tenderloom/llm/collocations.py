"""Phrase collocations by set-oriented relational mining (SETM).

An occurrence relation holds (piece, position, phrase) of every occurrence, in that order. Length by length: merge-join the
relation with itself by piece and adjacent position, count the groups, keep the frequent ones, and semi-join the
relation with them before the next extension. Every relation is written and read again.

Pieces never leave their chunk of documents, so the relation of a chunk is stored as one row of sorted columns (steps between
positions, a number of the phrase in the chunk's own dictionary) and the merge-join needs no shuffle. Only dictionaries
are exploded: a phrase has one row per chunk, so a phrase that holds a third of all occurrences is as light as any other.
Phrases of k + 1 words are known by the two phrases of k words that overlap in them, words by themselves: nothing is hashed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import shared
from .shared import drop_stored, few_read, few_rows, in_arrow, small, stored
from .textnp import LOWER, raw, slices, words

#: Bytes that end a piece, and bytes of words.
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_CUT
_WORD[[0x20, 0x09]] = False
#: Text of a chunk, in bytes (a longer document is one chunk).
CHUNK = 8 << 20
#: Rows of the relation (some MB each) that are decoded at a time, and in a row group of its files. Python gets them one by one.
_AT_ONCE = 1
#: A frequent phrase with its text and counts, as a join's side, in rows of shared.BROADCAST_ROWS.
_TEXTS = 8

_RELATION = "chunk long, lang string, {} n array<long>, steps binary, codes binary"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, lang, word[], n[], steps, codes) of the batches' texts: a row per chunk and language."""
    from pyspark import TaskContext

    first, seq = TaskContext.get().partitionId() << 32, 0
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal seq
        table = pa.Table.from_batches(held).sort_by("lang").combine_chunks()
        lang = table.column("lang").combine_chunks()
        data, offsets = raw(table.column("text"))
        begin, end, bounds = words(data, offsets, _WORD)
        inside = data[_WORD[data]]
        ends = np.zeros(len(begin) + 1, np.int32)
        np.cumsum(end - begin, out=ends[1:])
        all_words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(LOWER[inside]))
        # a step of 1 within a piece, of 2 to the next piece
        cuts = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_CUT[data], out=cuts[1:])
        steps = np.ones(len(begin), np.int32)
        steps[1:] += cuts[begin[1:]] != cuts[end[:-1]]
        steps[bounds[:-1][np.diff(bounds) > 0]] = 2
        runs = pc.run_end_encode(lang)
        row = 0
        for name, to in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            a, b = int(bounds[row]), int(bounds[to])
            row = to
            if a == b:
                continue
            own = all_words.slice(a, b - a).dictionary_encode()
            codes = own.indices.to_numpy().astype(np.int32)
            yield _row(first + seq, name, {"word": own.dictionary}, np.bincount(codes, minlength=len(own.dictionary)), steps[a:b], codes)
            seq += 1

    for batch in batches:
        for piece in slices(batch, 1, CHUNK):
            held.append(piece)
            size += piece.column(1).nbytes
            if size >= CHUNK:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _row(chunk: int, lang: str, phrase: dict[str, object], n: np.ndarray, steps: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    lists = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for k, v in (phrase | {"n": n.astype(np.int64)}).items()}
    fixed = {"chunk": pa.array([chunk], pa.int64()), "lang": pa.array([lang], pa.string())}
    return pa.RecordBatch.from_pydict(fixed | lists | {"steps": pa.array([steps.astype("<i4").tobytes()], pa.binary()), "codes": pa.array([codes.astype("<i4").tobytes()], pa.binary())})


def _extended(batches: Iterator[pa.RecordBatch], kept: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of (chunk, lang, steps, codes, ...) to (chunk, lang, a[], b[], n[], steps, codes): phrases one word longer.

    ``kept`` tells of a row the codes of its frequent phrases and these phrases' numbers. Occurrences of others go first (the
    semi-join); those at adjacent positions then merge.
    """
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            steps, codes = (np.frombuffer(row.column(c)[0].as_buffer(), "<i4") for c in (2, 3))
            at, ids = kept(row)
            order = np.argsort(ids)  # in the order of numbers: rows of the counts' shuffle then share most bytes with the row before
            at, ids = at[order], ids[order]
            new = np.full(int(codes.max(initial=0)) + 1, -1, np.int32)
            new[at] = np.arange(len(at), dtype=np.int32)
            code, place = new[codes], np.cumsum(steps, dtype=np.int64)
            here = code >= 0
            code, place = code[here], place[here]
            meets = np.flatnonzero(place[1:] == place[:-1] + 1)
            if not len(meets):
                continue
            pair, where, n = np.unique(code[meets].astype(np.int64) * len(at) + code[meets + 1], return_inverse=True, return_counts=True)
            yield _row(row.column(0)[0].as_py(), row.column(1)[0].as_py(), {"a": ids[pair // len(at)], "b": ids[pair % len(at)]}, n, np.diff(place[meets], prepend=-1), where)


class Words:
    """Numbers of frequent words, by language."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("lang").combine_chunks()
        runs = pc.run_end_encode(table["lang"].combine_chunks()) if table.num_rows else None
        ends = [0, *runs.run_ends.to_pylist()] if runs else []
        self.of = {name: table.slice(a, b - a) for name, a, b in zip(runs.values.to_pylist() if runs else [], ends[:-1], ends[1:], strict=True)}

    def kept(self, row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        mine = self.of.get(row.column(1)[0].as_py())
        if mine is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = pc.index_in(row.column(4).flatten(), value_set=mine["phrase"].combine_chunks())
        at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        return at, mine["id"].to_numpy()[found.drop_null().to_numpy()]


class Pairs:
    """Numbers of frequent phrases, by the numbers of their two parts."""

    def __init__(self, table: pa.Table):
        a, b, ids = (table[c].to_numpy() for c in ("a", "b", "id"))
        self.a, self.b = np.unique(a), np.unique(b)
        key = np.searchsorted(self.a, a) * len(self.b) + np.searchsorted(self.b, b)
        order = np.argsort(key)
        self.keys, self.ids = key[order], ids[order]

    def kept(self, row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        a, b = (row.column(c).flatten().to_numpy() for c in (4, 5))
        if not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = (np.minimum(np.searchsorted(known, x), len(known) - 1) for known, x in ((self.a, a), (self.b, b)))
        key = i * len(self.b) + j
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        at = np.flatnonzero((self.a[i] == a) & (self.b[j] == b) & (self.keys[k] == key))
        return at, self.ids[k[at]]


_LONGER = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), *((c, pa.list_(pa.int64())) for c in "abn"), ("steps", pa.binary()), ("codes", pa.binary())])


def _joined(row: pa.Table, kept: pa.Table) -> pa.Table:
    """_extended() of a chunk's row and the (code, id) of its frequent phrases."""
    at, ids = kept["code"].to_numpy(), kept["id"].to_numpy()
    try:
        return pa.Table.from_batches(list(_extended(iter(row.combine_chunks().to_batches()), lambda _: (at, ids))), _LONGER)
    finally:
        shared.give_back()


def _longer(relation: DataFrame, frequent: DataFrame, rows: int, k: int) -> DataFrame:
    """The relation of phrases of k words, from the one of k - 1 and its frequent groups.

    Groups of up to shared.BROADCAST_ROWS (a number and two parts, or a word, each) go to all tasks; more of them meet the
    relation's dictionaries in a join, of which each chunk gets its own part: sorted by chunk, so that a task holds one at a time.
    """
    spark, parts = relation.sparkSession, ["word"] if k == 2 else ["a", "b"]
    shape = _RELATION.format("a array<long>, b array<long>,")
    if rows <= shared.BROADCAST_ROWS:
        known = spark.sparkContext.broadcast(Words(frequent.select("lang", "phrase", "id").toArrow()) if k == 2 else Pairs(frequent.select("a", "b", "id").toArrow()))
        plan = in_arrow(relation.select("chunk", "lang", "steps", "codes", *parts), lambda batches: _extended(batches, known.value.kept), shape)
    else:
        zipped = F.posexplode(F.arrays_zip(*parts)).alias("code", "g")
        each = relation.select("chunk", "lang", zipped).select("chunk", "lang", "code", "g.*")
        found = each.join(frequent.select("lang", F.col("phrase").alias("word"), "id"), ["lang", "word"]) if k == 2 else each.drop("lang").join(frequent.select("a", "b", "id"), ["a", "b"])
        kept = found.select(F.col("chunk").alias("in_chunk"), "code", "id").groupBy("in_chunk")
        plan = relation.select("chunk", "lang", "steps", "codes").groupBy("chunk").cogroup(kept).applyInArrow(_joined, shape)
        return stored(plan, f"setm-{k}", _AT_ONCE)
    with few_rows(spark, 1):
        return stored(plan, f"setm-{k}", _AT_ONCE)


def _numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """stored() with a number for each row, unique because it is written, and the count of rows."""
    seen = Observation()
    out = stored(df.withColumn("id", F.monotonically_increasing_id()).observe(seen, F.count("*").alias("n")), name)
    return out, seen.get["n"]


def phrases(docs: DataFrame, min_count: int = 100, longest: int = 5) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases by length, and the words of each language.

    The first: a table for each length from 1 on, (lang, phrase, last, f, id, a, b, pf, sf): the phrase and its last word, its count, its
    number and those of its two parts one word shorter, counts of its beginnings and of its ends of 1, 2, ... words.
    The second: (lang, n). docs: (text, lang); a null text is empty, a null language ``und``.
    """
    with few_read(docs.sparkSession, _AT_ONCE):
        return _phrases(docs, min_count, longest)


def _phrases(docs: DataFrame, min_count: int, longest: int) -> tuple[list[DataFrame], DataFrame]:
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    relation = stored(in_arrow(texts, _occurrences, _RELATION.format("word array<string>,")), "setm-1", _AT_ONCE)
    groups = relation.select("lang", F.explode(F.arrays_zip("word", "n")).alias("g")).groupBy("lang", F.col("g.word").alias("phrase")).agg(F.sum("g.n").alias("f"))
    each = relation.select("lang", F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    total = stored(each.groupBy("lang").agg(F.sum("n").alias("n")), "setm-n")
    none = F.array().cast("array<long>")
    frequent, rows = _numbered(groups.where(F.col("f") >= min_count).select("lang", "phrase", F.col("phrase").alias("last"), "f", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), none.alias("pf"), none.alias("sf")), "phrases-1")
    out = [frequent]
    for k in range(2, longest + 1):
        if not rows:
            break
        longer = _longer(relation, frequent, rows, k)
        drop_stored(relation)
        relation = longer
        groups = relation.select(F.explode(F.arrays_zip("a", "b", "n")).alias("g")).groupBy("g.a", "g.b").agg(F.sum("g.n").alias("f")).where(F.col("f") >= min_count)
        head = frequent.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("_p"), F.col("f").alias("_fa"), "pf")
        tail = frequent.select(F.col("id").alias("b"), "last", F.col("f").alias("_fb"), "sf")
        joined = groups.join(small(head, _TEXTS * rows), "a").join(small(tail, _TEXTS * rows), "b")
        longer_beginnings, longer_ends = F.concat("pf", F.array("_fa")), F.concat("sf", F.array("_fb"))
        frequent, rows = _numbered(joined.select("lang", F.concat_ws(" ", "_p", "last").alias("phrase"), "last", "f", "a", "b", longer_beginnings.alias("pf"), longer_ends.alias("sf")), f"phrases-{k}")
        out.append(frequent)
    drop_stored(relation)
    return out, total


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best-scored phrases of 2 to ``longest`` words of each language.

    A-Z count as a-z; pieces end at ``. , ; : ! ?`` and line ends, words at spaces and tabs. a, l, r: occurrences of the
    phrase and of its two parts at its worst cut; n: words of the language; score = floor(1000 a n / (l r)), in exact
    decimals. A phrase inside a longer frequent one that occurs as often is dropped: one that is a word longer then occurs
    as often too, so only those are looked at. Ties: more occurrences, then the phrase in byte order. Null texts are empty,
    null languages ``und``; repeated rows count as often as they stand there; other columns are not read; an empty table gives no rows.
    """
    by_length, total = phrases(docs, min_count, longest)
    found = None
    for k, table in enumerate(by_length[1:], 2):
        rows = table.select("id", "lang", "phrase", F.col("f").alias("a"), "pf", "sf")
        if k < len(by_length):
            longer = by_length[k]
            inner = longer.select(F.col("a").alias("id"), F.col("f").alias("a")).unionByName(longer.select(F.col("b").alias("id"), F.col("f").alias("a"))).distinct()
            rows = rows.join(inner, ["id", "a"], "left_anti")
        rows = rows.drop("id")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    cut = "struct((1000BD * CAST(a AS DECIMAL(38,0)) * CAST(n AS DECIMAL(38,0))) DIV (CAST(pf[k - 1] AS DECIMAL(19,0)) * CAST(sf[size(sf) - k] AS DECIMAL(19,0))) AS score, k AS k, pf[k - 1] AS l, sf[size(sf) - k] AS r)"
    worst = found.join(total, "lang").withColumn("_cut", F.expr(f"array_min(transform(sequence(1, size(pf)), k -> {cut}))"))
    scored = worst.select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score"))
    return _ranked(scored, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _ranked(rows: DataFrame, by: list[str], order: list[Column], top: int) -> DataFrame:
    """``rank`` (long) of each row of its group, up to ``top``: ranges of the whole order are numbered apart and their sizes added up,
    so that a group that holds most rows is no task of its own."""
    ranged = stored(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_start")).where(F.col("_start") < top)
    rank = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) + F.col("_start")
    return ranged.join(starts, [*by, "_part"]).withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
