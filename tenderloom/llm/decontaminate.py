"""Benchmark decontamination with an FM-index per training shard.

Each task turns its shard (a few MB of whole texts) into one sequence of benchmark-vocabulary
word numbers, builds its Burrows-Wheeler transform and a wavelet matrix over it, and searches
all benchmark windows backwards at once. Occurrences are located from sampled suffix positions
and merged to spans. Words outside the benchmark's vocabulary can be in no window: runs of them
become one separator, and runs of vocabulary words shorter than the shortest window are not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_names, in_arrow
from .textnp import ALNUM, raw, slices, word_hashes, words


class Bits:
    """A bit vector with rank from 64-bit words and running counts."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        part = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(part)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Rank and access of symbols below 2**levels."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.rows = levels, []
        for k in range(levels - 1, -1, -1):
            bit = (symbols >> k & 1).astype(np.uint8)
            self.rows.append((k, Bits(bit), len(symbols) - int(bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place i."""
        begin = np.zeros_like(i)
        for k, bits, zeros in self.rows:
            one = (symbol >> k & 1).astype(bool)
            a, b = bits.rank(begin), bits.rank(i)
            begin, i = np.where(one, zeros + a, begin - a), np.where(one, zeros + b, i - b)
        return i - begin

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for _, bits, zeros in self.rows:
            one, r = bits.get(i), bits.rank(i)
            out = out << 1 | one
            i = np.where(one == 1, zeros + r, i - r)
        return out


class FMIndex:
    """Index of a sequence of numbers from 1 (0 ends it). Suffixes are sorted by doubling, until all are told apart."""

    def __init__(self, sequence: np.ndarray, sample: int = 8):
        text = np.append(sequence, 0).astype(np.int64)
        n = len(text)
        rank, done = np.unique(text, return_inverse=True)[1], 1
        while rank.max() < n - 1:
            ahead = np.zeros(n, np.int64)
            ahead[: n - done] = rank[done:] + 1
            rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1]
            done *= 2
        order = np.argsort(rank)
        self.n, self.levels = n, max(1, int(text.max()).bit_length())
        last = text[order - 1]
        self.wavelet = WaveletMatrix(last, self.levels)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=(1 << self.levels) + 1))])
        marked = order % sample == 0
        self.marks, self.places = Bits(marked), order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all patterns (rows of equal length; 0: a word that the shard lacks) by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        live = np.flatnonzero((patterns > 0).all(axis=1) & (patterns < 1 << self.levels).all(axis=1))
        hi[np.setdiff1d(np.arange(len(patterns)), live)] = 0
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            lo[live] = self.below[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.below[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: steps back to the next sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live := live[self.marks.get(at[live]) == 0]):
            c = self.wavelet.access(at[live])
            at[live] = self.below[c] + self.wavelet.rank(c, at[live])
            steps[live] += 1
        return self.places[self.marks.rank(at)] + steps


@dataclass
class Windows:
    """A block of benchmark windows: vocabulary hashes (sorted), patterns by length, the items of each pattern."""

    vocabulary: np.ndarray
    patterns: list[np.ndarray]
    owners: list[np.ndarray]  # CSR over patterns
    items: list[np.ndarray]
    shortest: int

    @classmethod
    def of(cls, item_ids: list[int], texts: pa.Array, window: int) -> Windows | None:
        data, offsets = raw(texts)
        starts, ends, bounds = words(data, offsets, ALNUM)
        vocabulary, number = np.unique(word_hashes(data, starts, ends), return_inverse=True)
        by: dict[tuple[int, ...], set[int]] = {}
        for i, item in enumerate(item_ids):
            own = (number[bounds[i] : bounds[i + 1]] + 1).tolist()
            for k in range(max(1, len(own) - window + 1) if own else 0):
                by.setdefault(tuple(own[k : k + window]), set()).add(item)
        if not by:
            return None
        sizes = sorted({len(p) for p in by})
        patterns, owners, items = [], [], []
        for size in sizes:
            own = [(p, sorted(x)) for p, x in by.items() if len(p) == size]
            patterns.append(np.array([p for p, _ in own], np.int64))
            owners.append(np.cumsum([0, *(len(x) for _, x in own)]))
            items.append(np.concatenate([np.array(x, np.int64) for _, x in own]))
        return cls(vocabulary, patterns, owners, items, sizes[0])

    def find(self, texts: pa.Array) -> tuple[np.ndarray, list[list[int]], list[list[int]], list[list[int]]]:
        """Per text: its number of words, hit words, first and last-plus-one byte of merged spans' words as word places, items."""
        data, offsets = raw(texts)
        starts, ends, bounds = words(data, offsets, ALNUM)
        n, n_words = len(texts), np.diff(bounds)
        if not len(starts):
            return n_words, [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
        h = word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        inside = self.vocabulary[at] == h
        number = np.where(inside, at + 1, 0)
        # runs of vocabulary words within one text
        edge = np.zeros(len(h) + 1, bool)
        edge[bounds] = True
        begin = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
        end = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
        long = end - begin >= self.shortest
        begin, end = begin[long], end[long]
        spans_from, spans_to, items = ([[] for _ in range(n)] for _ in range(3))
        if not len(begin):
            return n_words, spans_from, spans_to, items
        size = end - begin + 1  # a separator after each run; numbers rise by one so that 0 stays the end
        where = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        sequence = np.where(np.isin(np.arange(len(where)), np.cumsum(size) - 1), 1, number[np.minimum(where, len(h) - 1)] + 1)
        present, compact = np.unique(sequence, return_inverse=True)
        index = FMIndex(compact + 1)
        cover, pairs = np.zeros(len(h) + 1, np.int64), []
        for patterns, owners, owned in zip(self.patterns, self.owners, self.items, strict=True):
            p = np.minimum(np.searchsorted(present, patterns + 1), len(present) - 1)
            lo, hi = index.search(np.where(present[p] == patterns + 1, p + 1, 0))
            found = np.flatnonzero(lo < hi)
            count = (hi - lo)[found]
            rows = np.repeat(lo[found] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            place = where[index.locate(rows)]
            np.add.at(cover, place, 1)
            np.add.at(cover, place + patterns.shape[1], -1)
            # each occurrence belongs to all items of its window
            which = np.repeat(found, count)
            many = owners[which + 1] - owners[which]
            text = np.repeat(np.searchsorted(bounds, place, side="right") - 1, many)
            item = owned[np.repeat(owners[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            pairs.append(np.unique(np.stack([text, item], axis=1), axis=0))
        for text, item in np.unique(np.concatenate(pairs), axis=0).tolist():
            items[text].append(item)
        hit = np.cumsum(cover)[:-1] > 0
        first = np.flatnonzero(hit & (edge[:-1] | ~np.append(False, hit[:-1])))
        past = np.flatnonzero(hit & (edge[1:] | ~np.append(hit[1:], False))) + 1
        for text, a, b in zip((np.searchsorted(bounds, first, side="right") - 1).tolist(), first.tolist(), past.tolist(), strict=True):
            spans_from[text].append(a - int(bounds[text]))
            spans_to[text].append(b - int(bounds[text]))
        return n_words, spans_from, spans_to, items


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Windows]:
    """Benchmark items in blocks of about ``block_words`` words; one block is in the driver at a time."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1]) // 6 + 1
        if size >= block_words:
            if (found := Windows.of(ids, pa.array(texts, pa.string()), window)) is not None:
                yield found
            ids, texts, size = [], [], 0
    if ids and (found := Windows.of(ids, pa.array(texts, pa.string()), window)) is not None:
        yield found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 400_000) -> DataFrame:
    """``docs`` with n_words, hit_from and hit_to (merged word spans) and hit_items added.

    Every row of ``docs`` stays, with all its columns (of these four names, the old ones go); a null text has no words. An item of fewer than
    ``window`` words is one window; one without words, or with a null id or text, has none. Items
    of equal text are all reported. An empty benchmark hits nothing. The benchmark is searched
    in blocks of bounded size, each broadcast by itself; documents are not shuffled.
    """
    return _searched(docs.drop(*[c for c in docs.columns if c.lower() in _ADDED]), benchmark, _ADDED, window, block_words)


_ADDED = ("n_words", "hit_from", "hit_to", "hit_items")


def _searched(docs: DataFrame, benchmark: DataFrame, names: tuple[str, ...], window: int = 10, block_words: int = 400_000) -> DataFrame:
    """contamination() with its columns under these names, which ``docs`` must not have."""
    text, width = docs.columns.index("text"), len(docs.columns)
    spans = "array<long>"
    out = docs.select("*", F.lit(0).cast("long").alias(names[0]), *[F.array().cast(spans).alias(c) for c in names[1:]])

    def search(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch, text, 2 << 20):
                    n_words, *new = block.value.find(piece.column(text))
                    old = [piece.column(width + 1 + k).to_pylist() for k in range(3)]
                    merged = ([], [], [])
                    for a, b, i, a0, b0, i0 in zip(*new, *old, strict=True):
                        if a0 and a:
                            a, b = _union(a + a0, b + b0)
                        merged[0].append(a or a0)
                        merged[1].append(b or b0)
                        merged[2].append(sorted({*i, *i0}))
                    yield pa.RecordBatch.from_arrays([*piece.columns[:width], pa.array(n_words, pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in merged]], schema=piece.schema)

        return run

    sc, found = docs.sparkSession.sparkContext, False
    for block in _blocks(benchmark, window, block_words):
        out, found = in_arrow(out, search(sc.broadcast(block)), out.schema), True
    if not found:
        n = F.coalesce(F.size(F.filter(F.split(F.col("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda x: x != "")), F.lit(0))
        out = out.withColumn(names[0], F.when(F.col("text").isNull(), 0).otherwise(n).cast("long"))
    return out


def _union(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    a, b = [], []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if a and s <= b[-1]:
            b[-1] = max(b[-1], e)
        else:
            a.append(s)
            b.append(e)
    return a, b


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs.select("doc_id", "text"), benchmark)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    items = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    n_hit = total("hit_to") - total("hit_from")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with their columns, none of them changed."""
    names = free_names(docs, *_ADDED)
    return _searched(docs, benchmark, tuple(names)).where(F.size(names[3]) == 0).drop(*names)
