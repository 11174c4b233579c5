"""Overlapping chunks of long texts, cut at the coarsest separator that helps: whole Arrow columns at a time.

All texts of a batch are one array of bytes; places are numbers of characters in it, so that pieces of all texts are cut in the same few
rounds (one for each separator), and packing is one search for where each piece's chunk would end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNKS = "array<struct<text:string,start:int,end:int>>"
#: Bytes of text that are cut together.
SLICE = 4 << 20


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the counted items: whose it is, and its number among that one's."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _separators(data: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Places and lengths of blank lines, line ends, sentence ends and blanks. Blank lines do not overlap: in a run of line ends every other one."""
    line = data == 0x0A
    ends = np.flatnonzero(line)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = ends[~(np.append(False, line[:-1])[ends] & ~cut[ends])] if len(ends) else ends
    run = np.searchsorted(first, ends, side="right") - 1
    even = (ends - first[run]) % 2 == 0 if len(ends) else np.zeros(0, bool)
    follows = lambda p, byte: p[(p + 1 < len(data)) & (data[np.minimum(p + 1, len(data) - 1)] == byte) & ~cut[p + 1]]
    return [(at[follows(ends[even], 0x0A)], 2), (at[ends], 1), (at[follows(np.flatnonzero(data == 0x2E), 0x20)], 2), (at[np.flatnonzero(data == 0x20)], 1)]


def _pieces(a: np.ndarray, b: np.ndarray, separators: list[tuple[np.ndarray, int]], target: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of at most ``target`` characters of the texts [a, b), in order. Separators belong to no piece; a piece that is still too long is
    cut again from the coarsest separator on; without any separator it is cut by length."""
    done = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(a):
        fits = b - a <= target
        done.append((a[fits & (b > a)], b[fits & (b > a)]))
        a, b = a[~fits], b[~fits]
        nexts = []
        for places, size in separators:
            lo, hi = np.searchsorted(places, a), np.searchsorted(places, b - size, side="right")
            some = hi > lo
            owner, k = _spread((hi - lo)[some] + 1)
            start, end = a[some][owner], b[some][owner]
            here = lo[some][owner] + k
            last = k == (hi - lo)[some][owner]
            nexts.append((np.where(k > 0, places[np.maximum(here - 1, 0)] + size, start), np.where(last, end, places[np.minimum(here, len(places) - 1)])))
            a, b = a[~some], b[~some]
        owner, k = _spread(-(-(b - a) // target))
        start = a[owner] + k * target
        nexts.append((start, np.minimum(start + target, b[owner])))
        a, b = (np.concatenate(x) for x in zip(*nexts, strict=True))
    a, b = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(a)
    return a[order], b[order]


def _slice_chunks(texts: pa.Array, target: int, overlap: int) -> pa.Array:
    texts = texts.cast(pa.large_string()).fill_null("")
    blank = pc.equal(pc.binary_length(pc.utf8_trim_whitespace(texts)), 0).to_numpy(zero_copy_only=False)
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    starts = np.flatnonzero((data & 0xC0) != 0x80)  # bytes at which characters start
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=at[1:])
    place = at[offsets]  # characters before each text
    at = at[:-1]
    byte_at = np.append(starts, len(data))
    long = np.flatnonzero(~blank & (np.diff(place) > target))
    a, b = _pieces(place[long], place[long + 1], _separators(data, at, offsets), target)
    # from each piece, the first that its chunk cannot take: packed length is the span so far and that piece's own length
    bounds = np.searchsorted(a, np.append(place[long], place[-1]))
    whose = np.searchsorted(place[long], a, side="right") - 1
    reach = np.append(0, b[:-1]) + (b - a) if len(a) else a
    reach = np.maximum.accumulate(reach) if len(reach) else reach
    beyond = np.minimum(np.maximum(np.searchsorted(reach, a + target, side="right"), np.arange(len(a)) + 1), bounds[1:][whose]) if len(a) else a
    here, heads = bounds[:-1][np.diff(bounds) > 0], []
    while len(here):
        heads.append(here)
        here, end = beyond[here], bounds[1:][whose[here]]
        here = here[here < end]
    head = np.sort(np.concatenate(heads)) if heads else np.zeros(0, np.int64)
    start, end, text = a[head], b[beyond[head] - 1], long[whose[head]] if len(head) else head
    if overlap and len(head):
        again = np.append(False, text[1:] == text[:-1])
        start = np.where(again, np.maximum(np.append(0, start[:-1]), np.append(0, end[:-1]) - overlap), start)
    whole = np.flatnonzero(~blank & (np.diff(place) <= target))
    text, start, end = np.append(text, whole), np.append(start, place[whole]), np.append(end, place[whole + 1])
    order = np.lexsort((end, text))
    text, start, end = text[order], start[order], end[order]
    size = byte_at[end] - byte_at[start]
    owner, k = _spread(size)
    strings = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(data[byte_at[start][owner] + k])).cast(pa.string())
    each = pa.StructArray.from_arrays([strings, pa.array(start - place[text], pa.int32()), pa.array(end - place[text], pa.int32())], ["text", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), each)


def chunk_column(texts: pa.Array, target: int = 1500, overlap: int = 200) -> pa.Array:
    """A list of (text, start, end) for each text. Blank and null texts have none; a text that fits is one. Pieces are packed while the span so
    far and the next piece's own length stay within ``target``; then each chunk starts up to ``overlap`` characters inside the packed chunk before it."""
    target = max(50, target)
    overlap = max(0, min(target - 1, overlap))
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, side="right")))
        out.append(_slice_chunks(texts.slice(at, to - at), target, overlap))
        at = to
    return pa.concat_arrays(out) if out else _slice_chunks(texts.slice(0, 0), target, overlap)


def split_text(text: str | None, target: int = 1500, overlap: int = 200) -> list[tuple[str, int, int]]:
    """The chunks of one text."""
    return [(x["text"], x["start"], x["end"]) for x in chunk_column(pa.array([text], pa.string()), target, overlap)[0].as_py()]


def chunk_text(text: Column, target: int = 1500, overlap: int = 200) -> Column:
    """array of (text, start, end)."""

    @F.arrow_udf(CHUNKS)
    def cut(texts: pa.Array) -> pa.Array:
        return chunk_column(texts, target, overlap)

    return cut(text)
