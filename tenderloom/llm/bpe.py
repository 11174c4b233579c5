"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The corpus's most frequent words are compiled into an automaton that shares prefixes and
suffixes. Its arcs carry numbers whose sum along a word is the word's rank in sorted
order, which leads to the word's ids. The automaton is one file that every Python worker
maps into memory. A column of texts is split in numpy; all its distinct words walk through the automaton
together, letter by letter. Words that it does not hold are merged exactly, lowest rank first.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_words import Merges
from .shared import in_arrow, map_file, new_path, write_file
from .textnp import gather, slices
from .token_text import Memo

#: Bytes of text that are encoded at once.
_PIECE = 1 << 19


@lru_cache(maxsize=2)
def token_texts(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of all token texts by id, the added ones included, each with a blank behind; their starts and sizes."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
    out = [b" "] * (1 + max(ids.values()))
    for token, i in ids.items():
        out[i] = f"{token} ".encode()
    sizes = np.fromiter(map(len, out), np.int64, len(out))
    return np.frombuffer(b"".join(out), np.uint8), np.cumsum(sizes) - sizes, sizes


class Lexicon:
    """The automaton: arcs sorted by (state, byte), their targets and rank parts; ids by rank."""

    def __init__(self, arcs: np.ndarray, to: np.ndarray, add: np.ndarray, final: np.ndarray, starts: np.ndarray, ids: np.ndarray):
        self.arcs, self.to, self.add, self.final, self.starts, self.ids = arcs, to, add, final, starts, ids

    @classmethod
    def compile(cls, entries: dict[bytes, bytes]) -> Lexicon:
        """Minimal automaton of words with their ids (unsigned 32-bit integers), built in one pass over the sorted words: a state is frozen once no later word can
        pass through it, and equal frozen states are one."""
        words = sorted(entries)
        frozen: dict[tuple, int] = {}
        below: list[int] = []  # words that can be read from each frozen state
        shape: list[tuple] = []
        path: list[list] = [[False, []]]  # per letter of the last word: is it final, its arcs [byte, state]

        def freeze(state: list) -> int:
            key = (state[0], tuple(map(tuple, state[1])))
            if key not in frozen:
                frozen[key] = len(shape)
                shape.append(key)
                below.append(int(key[0]) + sum(below[t] for _, t in key[1]))
            return frozen[key]

        last = b""
        for word in words:
            same = len(os.path.commonprefix([last, word]))
            while len(path) - 1 > same:
                done = path.pop()
                path[-1][1][-1][1] = freeze(done)
            for b in word[same:]:
                path[-1][1].append([b, -1])
                path.append([False, []])
            path[-1][0] = True
            last = word
        while len(path) > 1:
            done = path.pop()
            path[-1][1][-1][1] = freeze(done)
        root = freeze(path[0])
        # the root becomes state 0
        name = {root: 0} | {s: s + 1 if s < root else s for s in range(len(shape)) if s != root}
        arcs, to, add = [], [], []
        for s, (is_final, out) in enumerate(shape):
            passed = int(is_final)
            for b, t in out:
                arcs.append(name[s] << 8 | b)
                to.append(name[t])
                add.append(passed)
                passed += below[t]
        order = np.argsort(np.array(arcs, np.int64))
        final = np.zeros(len(shape), np.uint8)
        final[[name[s] for s, k in enumerate(shape) if k[0]]] = 1
        lists = [entries[w] for w in words]
        starts = np.cumsum([0, *(len(x) // 4 for x in lists)]).astype(np.int64)
        return cls(np.array(arcs, np.int64)[order], np.array(to, np.int64)[order], np.array(add, np.int64)[order], final, starts, np.frombuffer(b"".join(lists), "<u4"))

    def to_bytes(self) -> bytes:
        parts = [self.arcs.astype("<i8"), self.to.astype("<i8"), self.add.astype("<i8"), self.starts.astype("<i8"), self.ids.astype("<u4"), self.final]
        return struct.pack("<6Q", *map(len, parts)) + b"".join([p.tobytes() for p in parts])

    @classmethod
    def read(cls, data: np.ndarray) -> Lexicon:
        """The automaton over the bytes of a file, which are not copied."""
        at, parts = 48, []
        for n, kind in zip(struct.unpack("<6Q", data[:48].tobytes()), ("<i8", "<i8", "<i8", "<i8", "<u4", "u1"), strict=True):
            size = n * np.dtype(kind).itemsize
            parts.append(data[at : at + size].view(kind))
            at += size
        arcs, to, add, starts, ids, final = parts
        return cls(arcs, to, add, final, starts, ids)

    def find(self, words: pa.Array) -> np.ndarray:
        """The rank of each word of a binary column, -1 for those it does not hold; all walk step by step together."""
        n = len(words)
        if not n or not len(self.arcs):
            return np.full(n, -1)
        offsets = np.frombuffer(words.buffers()[1], np.int32, n + 1 + words.offset)[words.offset :].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        begin, sizes = offsets[:-1], np.diff(offsets)
        rank, final = np.zeros(n, np.int64), np.full(n, -1)
        live = np.flatnonzero(sizes)
        state = np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state << 8 | data[begin[live] + step]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            ok = self.arcs[arc] == key
            live, arc = live[ok], arc[ok]
            state = self.to[arc]
            rank[live] += self.add[arc]
            step += 1
            ended = sizes[live] == step
            final[live[ended]] = state[ended]
            live, state = live[~ended], state[~ended]
        hit = (final >= 0) & (self.final[final] == 1)
        return np.where(hit, rank, -1)


def frequent_words(docs: DataFrame, tokenizer: str, most: int, held: int = 400_000) -> DataFrame:
    """The ``most`` most frequent words of all texts: (word, n). Counts are exact, but for chunks beyond the tables."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, parts, rows = Merges.of(tokenizer), [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for piece in slices(batch, 0, _PIECE):
                units = merges.split(piece.column(0))
                n = np.bincount(units.index, minlength=len(units.words) + len(units.odd))[: len(units.words)]
                parts.append(pa.table({"word": units.words, "n": n}))
                rows += len(n)
                if rows > held:
                    parts = [summed()]
                    rows = len(parts[0])
                    if rows > held // 2:
                        yield from parts[0].to_batches()
                        parts, rows = [], 0
        if parts:
            yield from summed().to_batches()

    counts = in_arrow(docs.select(F.col("text").cast("string")), count, "word binary, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def build_lexicon(docs: DataFrame, tokenizer: str, most: int = 60_000) -> str:
    """Compile the ``most`` most frequent words of ``docs`` into a file in the shared folder and return its path.

    At most ``most`` words reach the driver. The lexicon only saves work: ids never depend on it.
    """
    merges = Merges.of(tokenizer)
    words = [bytes(r["word"]) for r in frequent_words(docs, tokenizer, most).toLocalIterator()]
    path = new_path(docs.sparkSession, "lexicon")
    write_file(path, f"{uuid.uuid4().hex[:12]}.bin", Lexicon.compile(dict(zip(words, merges.merge(words), strict=True))).to_bytes())
    return path


class Encoder:
    """Ids of texts: words by the automaton, others from a bounded memo or by ``merge`` (words to ids)."""

    _by_path: dict[str, Encoder] = {}

    def __init__(self, merges: Merges, lexicon: Lexicon, memo: int = 120_000, merge: Callable[[list[bytes]], list[bytes]] | None = None):
        self.merges, self.lexicon, self.memo, self.merge = merges, lexicon, Memo(memo), merge or merges.merge

    @classmethod
    def of(cls, tokenizer: str, path: str) -> Encoder:
        """One per Python worker: workers live on from task to task."""
        if path not in cls._by_path:
            cls._by_path = {path: cls(Merges.of(tokenizer), Lexicon.read(map_file(path)))}
        return cls._by_path[path]

    def _unseen(self, words: list[bytes]) -> list[bytes]:
        memo = self.memo.current()
        for part in self.memo.missing(list(dict.fromkeys(words)), 1 << 14):
            memo.update(zip(part, self.merge(part), strict=True))
        return [memo[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a whole column, one text after the other, and the bounds of each text."""
        units, lexicon = self.merges.split(texts), self.lexicon
        rank = lexicon.find(units.words)
        new = np.flatnonzero(rank < 0)
        merged = self._unseen(units.words.take(pa.array(new)).to_pylist())
        for chunk in units.odd:
            words = self.merges.words(chunk)
            ids = iter(self._unseen([w for w in words if isinstance(w, bytes)]))
            merged.append(b"".join([next(ids) if isinstance(w, bytes) else struct.pack("<I", w) for w in words]))
        # the ids of words in the automaton, then those of the others
        sizes = np.fromiter(map(len, merged), np.int64, len(merged)) // 4
        starts = len(lexicon.ids) + np.cumsum(sizes) - sizes
        held = rank >= 0
        start, size = np.empty(len(rank) + len(units.odd), np.int64), np.empty(len(rank) + len(units.odd), np.int64)
        start[:-len(units.odd) or None][held] = lexicon.starts[rank[held]]
        size[:-len(units.odd) or None][held] = np.diff(lexicon.starts)[rank[held]]
        others = np.concatenate([new, np.arange(len(rank), len(size))])
        start[others], size[others] = starts, sizes
        values = np.concatenate([lexicon.ids, np.frombuffer(b"".join(merged), "<u4")])
        n = size[units.index]
        return gather(values, start[units.index], n), np.concatenate([[0], np.cumsum(n)])[units.bounds]


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A binary or string column of the bytes of values[bounds[i]:bounds[i + 1]]."""
    offsets = (bounds * values.itemsize).astype(np.int64)
    large = pa.Array.from_buffers(pa.large_binary() if pa.types.is_binary(kind) else pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
    return large.cast(kind)


def _texts(ids: np.ndarray, bounds: np.ndarray, tokenizer: str) -> pa.Array:
    """The tokens of each text's ids, joined by blanks (the vocabulary has no decoder of its own)."""
    data, starts, sizes = token_texts(tokenizer)
    size = sizes[ids]
    out = gather(data, starts[ids], size)
    ends = np.concatenate([[0], np.cumsum(size)])[bounds]
    last = ends[1:][ends[1:] > ends[:-1]] - 1  # the blank behind each text's last token
    return _lists(np.delete(out, last), ends - np.searchsorted(last, ends), pa.string())


def encode(docs: DataFrame, tokenizer: str, lexicon: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) for every row of (doc_id, text).

    A null or empty text has no ids. Rows keep their number and are independent of each other, so repeats
    and ties need no rule; texts of any length are encoded whole; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.of(tokenizer, lexicon)
        for batch in batches:
            for piece in slices(batch, 1, _PIECE):
                yield pa.RecordBatch.from_arrays([piece.column(0), _lists(*coder.encode(piece.column(1)), pa.binary())], ["doc_id", "ids"])
        coder.memo.clear()

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids, text for every row of (doc_id, ids); null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1, _PIECE):
                sizes = pc.fill_null(pc.binary_length(piece.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                ids = np.frombuffer(b"".join(x or b"" for x in piece.column(1).to_pylist()), "<u4")
                yield pa.RecordBatch.from_arrays([*piece.columns, _texts(ids, np.concatenate([[0], np.cumsum(sizes)]), tokenizer)], ["doc_id", "ids", "text"])

    return in_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, tokenizer: str, lexicon: str) -> DataFrame:
    """decode(encode(docs)) in one Python worker per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.of(tokenizer, lexicon)
        for batch in batches:
            for piece in slices(batch, 1, _PIECE):
                ids, bounds = coder.encode(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), _lists(ids, bounds, pa.binary()), _texts(ids, bounds, tokenizer)], ["doc_id", "ids", "text"])
        coder.memo.clear()

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids binary, text string")


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = round_trip(docs, tokenizer, build_lexicon(docs, tokenizer))
    n = (F.length("ids") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
