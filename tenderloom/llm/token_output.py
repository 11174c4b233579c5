"""Token-ID output: concatenated id arrays with Elias-Fano document boundaries.

File format (one file per shard, little endian):

    magic "TLEF1\\0\\0\\0", then ten unsigned 64-bit integers: documents, ids, bytes per id,
    low bits l, bytes of the low part, bytes of the high part, select samples, bytes of null
    flags, 0, 0; then doc_ids (int64 each), null flags (bit per doc_id), low part, high part,
    select samples (u32 each), ids.

Boundaries b_0 = 0 <= b_1 <= ... <= b_n are kept as Elias-Fano: the low l bits of each packed
side by side, the rest in unary. ``select`` starts at a sampled position (every 64th one) and counts
the ones word by word from there, without a table of 64-bit offsets: about l + 2 bits and
half a bit of samples per document.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe_words import Merges
from .shared import in_arrow, new_path, write_file
from .textnp import gather, slices

MAGIC = b"TLEF1\0\0\0"
SAMPLE = 64


class EliasFano:
    """A non-decreasing list of integers in near-minimal space with select."""

    def __init__(self, low: np.ndarray, high: np.ndarray, samples: np.ndarray, l: int, n: int):
        self.low, self.high, self.samples, self.l, self.n = low, high, samples, l, n

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        l = max(0, (most // max(n, 1)).bit_length() - 1)
        if l:
            bits = (values[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        at = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(at[-1]) // 64 + 1) * 64 if n else 0, np.uint8)
        unary[at] = 1
        return cls(low, np.packbits(unary, bitorder="little"), at[::SAMPLE].astype("<u4"), l, n)

    def select(self, i: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        i = np.asarray(i, np.int64)
        words = self.high.view("<u8")
        at = self.samples[i // SAMPLE].astype(np.int64)
        rest, word = i % SAMPLE, at >> 6
        bits = words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) << (at & 63).astype(np.uint64))
        live = np.arange(len(i))
        while True:  # on to the word that holds the one in question
            ones = np.bitwise_count(bits[live]).astype(np.int64)
            live, ones = live[rest[live] >= ones], ones[rest[live] >= ones]
            if not len(live):
                break
            rest[live] -= ones
            word[live] += 1
            bits[live] = words[word[live]]
        ones = np.cumsum(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=1)
        at = word * 64 + np.argmax(ones > rest[:, None], axis=1)
        low = np.zeros(len(i), np.int64)
        if self.l:
            where = i[:, None] * self.l + np.arange(self.l)
            low = (((self.low[where >> 3] >> (where & 7)) & 1).astype(np.int64) << np.arange(self.l)).sum(axis=1)
        return ((at - i) << self.l) | low

    def all(self) -> np.ndarray:
        """Every value, in one pass."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        low = np.zeros(self.n, np.int64)
        if self.l:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.l].reshape(self.n, self.l)
            low = (bits.astype(np.int64) << np.arange(self.l)).sum(axis=1)
        return ((at - np.arange(self.n)) << self.l) | low


def pack(doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray, width: int) -> bytes:
    """The bytes of one file: ids of all documents, one after the other, and how many each has."""
    ef = EliasFano.of(np.concatenate([[0], np.cumsum(sizes)]))
    nulls = np.packbits(np.array([d is None for d in doc_ids], np.uint8), bitorder="little")
    head = struct.pack("<10Q", len(doc_ids), len(ids), width, ef.l, len(ef.low), len(ef.high), len(ef.samples), len(nulls), 0, 0)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([MAGIC, head, keys.tobytes(), nulls.tobytes(), ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes(), ids.astype(f"<u{width}").tobytes()])


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, EliasFano, np.ndarray]:
    """doc_ids, null flags, boundaries and ids of one file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n, total, width, l, low, high, samples, nulls, _, _ = struct.unpack_from("<10Q", data, 8)
    at = 88
    keys = np.frombuffer(data, "<i8", n, at)
    at += 8 * n
    null = np.unpackbits(np.frombuffer(data, np.uint8, nulls, at), bitorder="little")[:n].astype(bool)
    at += nulls
    ef = EliasFano(np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low).copy(), np.frombuffer(data, "<u4", samples, at + low + high), l, n + 1)
    at += low + high + 4 * samples
    return keys, null, ef, np.frombuffer(data, f"<u{width}", total, at)


class LibraryWords:
    """Ids of words by the tokenizers library: its model of the vocabulary file, fed with words that are split already.

    The splitting is that of ``bpe_words``, the same as the library's own (tests hold it so); its regular-expression
    splitter takes most of the library's time. Every word's last token has the end-of-word mark, which tells words apart.
    """

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.normalizer = normalizers.Sequence([])
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def __call__(self, words: list[bytes]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a binary column's words, one after the other, and how many each has."""
        starts, data = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1 + words.offset)[words.offset :], np.frombuffer(words.buffers()[2], np.uint8)
        text = np.insert(data[starts[0] : starts[-1]], starts[1:] - starts[0], 0x20)
        ids = np.array(self.tokenizer.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, "<u4")
        sizes = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        if len(sizes) != len(words):
            raise ValueError("the library's model did not end every word with its mark")
        return ids, sizes


class WordTable:
    """Ids of texts by way of a table of the words met so far: a piece's distinct words are looked up together, new ones go to the library's
    model together. Past ``most`` words or ``most_bytes`` of them only those of the piece at hand stay, so memory is bounded; ids never depend on what the table holds."""

    _by_path: dict[str, WordTable] = {}

    def __init__(self, merges: Merges, library: LibraryWords, most: int = 400_000, most_bytes: int = 1 << 25):
        self.merges, self.library, self.most, self.most_bytes = merges, library, most, most_bytes
        self.words, self.ids, self.sizes = pa.array([], pa.binary()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    @classmethod
    def of(cls, path: str) -> WordTable:
        """One per Python worker: workers live on from task to task, and so does the table."""
        if path not in cls._by_path:
            cls._by_path[path] = cls(Merges.of(path), LibraryWords(path))
        return cls._by_path[path]

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each word stands in the table, which takes in the new ones."""
        found = pc.index_in(words, value_set=self.words)
        at, missing = found.fill_null(-1).to_numpy().astype(np.int64), found.is_null()
        new = words.filter(missing).unique()
        if not len(new):
            return at
        if len(self.words) + len(new) > self.most or self.words.nbytes + new.nbytes > self.most_bytes:
            kept = np.unique(at[at >= 0])
            starts = np.cumsum(self.sizes) - self.sizes
            self.words, self.ids, self.sizes = self.words.take(pa.array(kept)), gather(self.ids, starts[kept], self.sizes[kept]), self.sizes[kept]
            at = np.where(at >= 0, np.searchsorted(kept, at), -1)
        merged = [self.library.ids(new.slice(k, 1 << 14)) for k in range(0, len(new), 1 << 14)]
        unseen = np.flatnonzero(at < 0)
        at[unseen] = len(self.words) + pc.index_in(words.take(pa.array(unseen)), value_set=new).to_numpy()
        self.words = pa.concat_arrays([self.words, new])
        self.ids, self.sizes = np.concatenate([self.ids, *(i for i, _ in merged)]), np.concatenate([self.sizes, *(n for _, n in merged)])
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a whole column, one text after the other, and the bounds of each text."""
        units = self.merges.split(texts)
        odd = [self.merges.words(chunk) for chunk in units.odd]
        own = pa.array([w for words in odd for w in words if isinstance(w, bytes)], pa.binary())
        at = self.places(pa.concat_arrays([units.words, own]))
        starts = np.cumsum(self.sizes) - self.sizes
        # behind the table's ids, those of odd chunks
        ids, more, place = [], [], len(units.words)
        for words in odd:
            parts = []
            for w in words:
                if isinstance(w, bytes):
                    k, place = at[place], place + 1
                    parts.append(self.ids[starts[k] : starts[k] + self.sizes[k]])
                else:
                    parts.append(np.array([w], "<u4"))
            ids += parts
            more.append(sum(map(len, parts)))
        at, more = at[: len(units.words)], np.array(more, np.int64)
        start, size = np.concatenate([starts[at], len(self.ids) + np.cumsum(more) - more]), np.concatenate([self.sizes[at], more])
        n = size[units.index]
        return gather(np.concatenate([self.ids, *ids]), start[units.index], n), np.concatenate([[0], np.cumsum(n)])[units.bounds]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, shard_ids: int = 1 << 20) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token files under ``folder``/ids, in ascending doc_id order.

    Returns the manifest (file, part, seq, n_docs, n_ids), itself written to ``folder``/manifest.
    A null text is empty, so its document holds the end id alone; a null doc_id sorts first; rows of
    one doc_id are kept, in text order. An empty table gives an empty manifest and no files. Other
    columns of ``docs`` are not read. Documents are range-partitioned by doc_id (only the
    documents move, once); each task streams its sorted range, about a megabyte of text at a time, into files of
    ``shard_ids`` ids and more. File names carry the task attempt: files of lost or repeated
    attempts are not in the manifest, and the manifest alone says which files count.
    """
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, attempt, seq = WordTable.of(tokenizer), TaskContext.get().partitionId(), uuid.uuid4().hex[:8], 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:05d}-{attempt}.ids"
            write_file(f"{folder}/ids", name, pack(keys, np.concatenate(held), np.concatenate(sizes), width))
            return pa.RecordBatch.from_pydict({"file": [name], "part": [part], "seq": [seq], "n_docs": [len(keys)], "n_ids": [size]}, schema)

        for batch in batches:
            for piece in slices(batch, 1, 1 << 20):
                ids, bounds = coder.encode(piece.column(1))
                n = np.diff(bounds)
                keys += piece.column(0).to_pylist()
                held.append(np.insert(ids, bounds[1:], end_id))  # each document ends with the end id
                sizes.append(n + 1)
                size += len(held[-1])
                if size >= shard_ids:
                    yield flush()
                    keys, held, sizes, size, seq = [], [], [], 0, seq + 1
        if keys:
            yield flush()

    schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = in_arrow(ordered, encode, "file string, part int, seq int, n_docs long, n_ids long")
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema("file string, part int, seq int, n_docs long, n_ids long").parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids (u32 bytes).

    Bases of files are prefix sums in two levels: over the files of a part, then over the parts, so
    no window holds more rows than there are parts or files in a part.
    """
    manifest = spark.read.schema("file string, part int, seq int, n_docs long, n_ids long").parquet(f"{folder}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("part_base"))
    within = F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("seq")), F.lit(0))
    bases = manifest.select("file", "part", within.alias("base")).join(parts, "part").select("file", (F.col("base") + F.col("part_base")).alias("base"))
    files = spark.read.format("binaryFile").load(f"{folder}/ids").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, base in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                keys, null, ef, ids = unpack(data.as_py())
                bounds = ef.select(np.arange(len(keys) + 1))
                for at in range(0, len(keys), 4096):
                    b = bounds[at : at + 4097]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys[at : at + 4096], pa.int64(), mask=null[at : at + 4096]),
                        pa.array(base + b[:-1], pa.int64()),
                        pa.array(np.diff(b), pa.int64()),
                        pa.array([ids[x:y].astype("<u4").tobytes() for x, y in zip(b[:-1], b[1:], strict=True)], pa.binary()),
                    ], ["doc_id", "start", "n_tokens", "ids"])

    return in_arrow(files.join(bases, "file").select("content", "base"), docs, "doc_id long, start long, n_tokens long, ids binary")


def token_index(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write, read back, and sum up: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    write_tokens(docs, folder, tokenizer, end_id)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
