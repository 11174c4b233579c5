"""Line dedup across documents: exact copies, and near copies by a deletion-neighbourhood join.

Words are the symbols: a line's variants are the line itself and the line without one word, as
64-bit keys. Two lines are within one edit if they share a variant by deleting the word at the same
place (substitution), or if one line is a variant of the other (insertion). Lines of fewer than
``min_near`` words, a parameter, have an edit bound of 0: one word of so few is another line.

A line's place is the document and, in one integer (``sub``), the number of the text among those of its doc_id and of the line in the text:
rows that share a doc_id but not a text are documents of their own, numbered by the 64-bit hashes of their texts.

One edit leaves the first or the last half of a line as it is. So before any variant is made, a
join on hashes of both ends finds the lines that can have a neighbour at all; the others
provably have none. Only those lines go into the neighbourhood join, whose groups are settled by
their earliest member and never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import counted, drop_stored, free_names, in_arrow, small, stored
from .textnp import NOT_SPACE, mix, powers, raw, run_hashes, slices, word_hashes, words

#: Words from which on a line has an edit bound of 1.
MIN_NEAR = 8
#: What places a line, in the order in which the earliest stays.
_AT = ("doc_id", "sub")
_SECOND = np.uint64(0x5851F42D4C957F2D)


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all lines, their bounds, each line's text, and its number in the text."""
    data, offsets = raw(texts)
    cuts = np.flatnonzero(data == 0x0A) + 1
    starts = np.sort(np.concatenate([offsets[:-1], cuts]), kind="stable")
    line_offsets = np.append(starts, len(data))
    # a cut at a text's last byte starts an empty last line of that text, before the next text's first line
    text = np.repeat(np.arange(len(offsets) - 1), np.bincount(np.searchsorted(offsets, cuts - 1, side="right") - 1, minlength=len(offsets) - 1) + 1)
    first = np.searchsorted(text, np.arange(len(offsets) - 1))
    begin, end, bounds = words(data, line_offsets, NOT_SPACE)
    return word_hashes(data, begin, end), bounds, text, np.arange(len(text)) - first[text]


def _ends(n: np.ndarray) -> np.ndarray:
    """Words of an end that one edit may leave whole: at most (n - 1) // 2, rounded down to three leading bits."""
    half = np.maximum((n - 1) // 2, 1)
    unit = 1 << np.maximum(np.log2(half).astype(np.int64) - 2, 0)
    return half // unit * unit


def _end_keys(h: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = mix(p.astype(np.uint64))
    return run_hashes(h, a, a + p) ^ size, mix(run_hashes(h, b - p, b) ^ size)


def numbered_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, print, number): of ids with several texts, each text's hash (64 bits) and its number in the order of hashes, from 0.

    Only ids and hashes move. An id that most rows share is numbered by ranges of its hashes, whose sizes are then added up.
    """
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("print")).where("doc_id is not null")
    several = prints.groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).where("x <> y").select("doc_id")
    ranged = prints.join(several, "doc_id", "left_semi").distinct().repartitionByRange("doc_id", "print").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "several-texts")
    before = F.sum("size").over(Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("doc_id", "part").agg(F.count("*").alias("size")).select("doc_id", "part", F.coalesce(before, F.lit(0)).alias("start"))
    n = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("print")) - 1 + F.col("start")
    return ranged.join(starts, ["doc_id", "part"]).select("doc_id", "print", n.cast("long").alias("number"))


class Numbers:
    """The numbers of texts, joined to rows of documents: by a broadcast as long as few ids have several texts."""

    def __init__(self, docs: DataFrame):
        self.table, self.rows = counted(numbered_texts(docs), "text-numbers")

    def add(self, docs: DataFrame, name: str) -> DataFrame:
        """``docs`` with the number of each text (0 for the only one of its id)."""
        own, print_, n = free_names(docs, "own", "print", "n")
        right = small(self.table.toDF(own, print_, n), self.rows)
        met = (docs["doc_id"].cast("long") == right[own]) & (F.xxhash64(docs["text"].cast("string")) == right[print_])
        return docs.join(right, met, "left").select(*[docs[c] for c in docs.columns], F.coalesce(right[n], F.lit(0)).alias(name))


def _placed(docs: DataFrame, numbers: Numbers) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return numbers.add(rows, "number").select("doc_id", "number", "text")


def line_table(docs: DataFrame, numbers: Numbers, min_near: int) -> DataFrame:
    """doc_id, sub, h, h2 (128-bit hash of the words), n (words), ends (hashes of both ends, of near-able lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 2):
                h, bounds, text, number = _lines(piece.column(2))
                a, b = bounds[:-1], bounds[1:]
                n = b - a
                p, q = _ends(n), _ends(np.maximum(n - 1, 1))
                keys = np.stack([*_end_keys(h, a, b, np.minimum(p, n)), *_end_keys(h, a, b, np.minimum(q, n))], axis=1)
                many = np.where(n < min_near, 0, np.where((p != q) & (n > min_near), 4, 2))
                flat = keys[np.arange(4)[None, :] < many[:, None]].view(np.int64)
                ends = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(flat))
                rows = pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(text)), pa.array((piece.column(1).to_numpy()[text] << 32) + number), pa.array(run_hashes(h, a, b).view(np.int64)), pa.array(run_hashes(mix(h ^ _SECOND), a, b).view(np.int64)), pa.array(n.astype(np.int32)), ends], [*_AT, "h", "h2", "n", "ends"])
                yield rows.filter(pa.array(n > 0))

    return in_arrow(_placed(docs, numbers), run, "doc_id long, sub long, h long, h2 long, n int, ends array<long>")


def _wanted_lines(docs: DataFrame, numbers: Numbers, wanted: DataFrame) -> DataFrame:
    """The text of wanted lines: doc_id, sub, line. wanted: doc_id, number, at (array of sub)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for doc_id, text, at in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                lines = text.split("\n")
                for x in at:
                    for column, value in zip(out, (doc_id, x, lines[x & 0xFFFFFFFF]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True)], [*_AT, "line"])

    texts = _placed(docs, numbers).where("text is not null").join(wanted, ["doc_id", "number"])
    return in_arrow(texts.select("doc_id", "text", "at"), run, "doc_id long, sub long, line string").dropDuplicates([*_AT])


def _variants(lines: DataFrame) -> DataFrame:
    """key, place (-1: the whole line, else the word left out), doc_id, sub of every variant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 2):
                data, offsets = raw(piece.column(2))
                begin, end, bounds = words(data, offsets, NOT_SPACE)
                h = word_hashes(data, begin, end)
                n = np.diff(bounds)
                line = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(h)) - bounds[:-1][line]
                # a run without one word: both sides, joined as one run of n - 1 words
                key = np.concatenate([run_hashes(h, bounds[:-1], bounds[1:]), _without(h, bounds, line)])
                line, place = np.concatenate([np.arange(len(n)), line]), np.concatenate([np.full(len(n), -1), place])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)), *[c.take(pa.array(line)) for c in piece.columns[:2]]], ["key", "place", *_AT])

    return in_arrow(lines.select(*_AT, "line"), run, "key long, place int, doc_id long, sub long")


def _without(h: np.ndarray, bounds: np.ndarray, line: np.ndarray) -> np.ndarray:
    """For every word of every line, the hash of its line without it, as run_hashes() gives for the shorter line."""
    p, inv = powers(len(h) + 1)
    a, b = bounds[:-1][line], bounds[1:][line]
    i = np.arange(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=total[1:])
    before = (total[i] - total[a]) * inv[a]
    after = (total[b] - total[i + 1]) * inv[a + 1]
    return mix(before + after + (b - a - 1).astype(np.uint64))


def within_one_edit(x: list[str], y: list[str]) -> bool:
    """Whether two lists of words differ by one inserted, deleted or replaced word at most."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    k = 0
    while k < len(x) and x[k] == y[k]:
        k += 1
    return x[k + (len(x) == len(y)) :] == y[k + 1 :]


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Of pairs (doc_id, sub, by) those whose lines are within one edit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = lambda s: [w for w in s.translate(_FOLD).split(" ") if w]
            ok = [within_one_edit(split(a), split(b)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([*_AT]).filter(pa.array(ok, pa.bool_()))

    near = pairs.join(lines.select(*_AT, "line"), [*_AT]).select(*_AT, "line", "by.*")
    near = near.toDF(*_AT, "line", *[f"by_{k}" for k in _AT])
    other = lines.select(*[F.col(k).alias(f"by_{k}") for k in _AT], F.col("line").alias("other"))
    near = near.join(other, [f"by_{k}" for k in _AT])
    return in_arrow(near.select(*_AT, "line", "other"), run, "doc_id long, sub long")


_FOLD = {k: k + 32 for k in range(65, 91)} | dict.fromkeys(range(9, 14), 32)


def dropped_lines(docs: DataFrame, min_near: int = MIN_NEAR, numbers: Numbers | None = None) -> DataFrame:
    """doc_id, sub, near: the lines that an earlier line (by doc_id, then place) copies exactly or within the bound."""
    numbers = numbers or Numbers(docs)
    table = stored(line_table(docs, numbers, min_near), "lines")
    at = F.struct(*_AT)
    distinct = table.groupBy("h", "h2").agg(F.min(at).alias("first"), F.count("*").alias("copies"), F.first("ends").alias("ends"))
    distinct = stored(distinct, "distinct")
    ends = distinct.select(F.explode("ends").alias("end"), "first", "h")
    shared = ends.groupBy("end").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").select("end")
    able = ends.join(shared, "end", "left_semi").select("first.*")
    wanted = able.groupBy("doc_id", F.shiftright("sub", 32).alias("number")).agg(F.collect_set("sub").alias("at"))
    lines = stored(_wanted_lines(docs, numbers, wanted), "near-lines")
    variants = stored(_variants(lines), "variants").withColumn("at", at)
    # replaced word: all of one key and place are within one edit of each other, the earliest stays
    groups = variants.where("place >= 0").groupBy("key", "place").agg(F.min("at").alias("by"), F.max("at").alias("to")).where("by <> to")
    swapped = variants.join(groups.select("key", "place", "by"), ["key", "place"]).where("at <> by").select("at", "by")
    # left-out word: a whole line meets the variants of longer ones; of both, the later goes
    whole = variants.where("place < 0").select("key", F.col("at").alias("other"))
    longer = variants.where("place >= 0").join(whole, "key").select(F.greatest("at", "other").alias("at"), F.least("at", "other").alias("by"))
    pairs = swapped.unionByName(longer).where("at <> by").groupBy("at").agg(F.min("by").alias("by")).select("at.*", "by")
    near = stored(_verified(pairs, lines), "near")
    drop_stored(variants)
    # a near line goes with all its copies; of an exactly repeated line the first stays
    firsts = distinct.select("h", "h2", "first.*", "first", "copies")
    gone = firsts.join(near.withColumn("near", F.lit(True)), [*_AT], "left").select("h", "h2", "first", "copies", F.coalesce("near", F.lit(False)).alias("near"))
    gone = gone.where("near or copies > 1")
    return table.join(gone, ["h", "h2"]).where(F.col("near") | (at != F.col("first"))).select(*_AT, "near")


_COUNTS = ("n_lines", "n_exact", "n_near")


def deduplicated(docs: DataFrame, min_near: int = MIN_NEAR) -> DataFrame:
    """``docs`` with n_lines, n_exact, n_near added and the dropped lines cut out of ``text``.

    Lines end at ``\\n``; case of A-Z and amounts of white space do not tell lines apart. A line without words is never
    dropped. Every row stays with all its columns (of these three names, the old ones go); a null text stays null with no
    lines. A null doc_id has no place in the order: such rows stay as they are. Rows that repeat a doc_id with the same text are one
    document and lose the same lines; with other texts they are documents of their own, in the order of their texts' hashes.
    An empty table gives an empty result.
    """
    return _cut(docs.drop(*[c for c in docs.columns if c.lower() in _COUNTS]), _COUNTS, min_near)


def _cut(docs: DataFrame, counts: tuple[str, ...], min_near: int) -> DataFrame:
    """deduplicated() with the counts under these names, which ``docs`` must not have."""
    doc, of, gone, number = free_names(docs, "doc", "of", "gone", "number")
    numbers = Numbers(docs)
    found = dropped_lines(docs, min_near, numbers).distinct().groupBy(F.col("doc_id").alias(doc), F.shiftright("sub", 32).alias(of)).agg(F.collect_list(F.struct(F.col("sub").bitwiseAND(0xFFFFFFFF).alias("line_no"), "near")).alias(gone))
    both = numbers.add(docs, number)
    both = both.join(found, (F.col("doc_id").cast("long") == F.col(doc)) & (F.col(number) == F.col(of)), "left")
    names = docs.columns
    at = names.index("text")
    out_schema = docs.select("*", *[F.lit(0).cast("long").alias(c) for c in counts]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers = [], ([], [], [])
            for text, out in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                near = {x["line_no"]: x["near"] for x in out or ()}
                numbers[0].append(len(lines))
                numbers[2].append(sum(near.values()))
                numbers[1].append(len(near) - numbers[2][-1])
                texts.append("\n".join([x for k, x in enumerate(lines) if k not in near]) if near else text)
            columns = [*batch.columns[: len(names)], *[pa.array(c, pa.int64()) for c in numbers]]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, [*names, *counts])

    return in_arrow(both.select(*names, gone), run, out_schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, n_kept, kept_sha256 (of the text that is left; a null text counts as empty)."""
    left = deduplicated(docs.select("doc_id", "text"))
    kept = F.col("n_lines") - F.col("n_exact") - F.col("n_near")
    return left.select("doc_id", "n_lines", "n_exact", "n_near", kept.alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def without_copies(docs: DataFrame, min_near: int = MIN_NEAR) -> DataFrame:
    """``docs`` with the dropped lines cut out, without documents that lost every line with words; no other column changes."""
    n_lines, n_exact, n_near = free_names(docs, *_COUNTS)
    left = _cut(docs, (n_lines, n_exact, n_near), min_near)
    empty = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "") == ""
    return left.where(~empty | (F.col(n_exact) + F.col(n_near) == 0)).drop(n_lines, n_exact, n_near)
