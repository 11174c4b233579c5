"""Words of an Arrow string column as 64-bit hashes, in numpy over the column's own bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C1B)  # odd and 3 modulo 8
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word that ends only at white space.
NOT_SPACE = ~_SPACE
#: Bytes of a word of ASCII letters, digits and everything from U+0080.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[LOWER]


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse, 0 to n."""
    if not _powers or len(_powers["p"]) <= n:
        inv = np.uint64(pow(int(_P), -1, 1 << 64))
        for k, base in (("p", _P), ("i", inv)):
            out = np.ones(n + 1, np.uint64)
            out[1:] = base
            _powers[k] = np.multiply.accumulate(out)
    return _powers["p"], _powers["i"]


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if n else np.zeros(1, np.int64)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the bounds of each text in that list."""
    inside = kind[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = before[-1] = False
    before[1:] = inside
    ahead = before[1:].copy()
    ahead[:-1] = inside[1:]
    ahead[-1:] = False
    before = before[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    ahead[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~ahead) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z; the same in every batch and process."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    base = int(starts[0])
    part = data[base : int(ends[-1])]
    p, inv = powers(len(part))
    total = np.empty(len(part) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_byte_values()[part] * p[: len(part)], out=total[1:])
    s, e = starts - base, ends - base
    return mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64))


def run_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run h[start:end] of word hashes (ends >= starts; empty runs are 0)."""
    p, inv = powers(len(h))
    total = np.empty(len(h) + 1, np.uint64)
    total[0] = 0
    np.cumsum(h * p[: len(h)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start:start + size] of all places, one after the other."""
    total = int(sizes.sum())
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return values[at]


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 19):
    """Cut a batch by rows so that each piece has about ``most_bytes`` of text (one row at least)."""
    col = batch.column(column)
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to
