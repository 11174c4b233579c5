"""Words of a word-level BPE vocabulary: splitting whole columns in numpy, and exact merges of single words."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .textnp import raw
from .token_text import chunks

_END = "</w>"
#: Below this code point (Latin to Armenian) letters are told by tables; beyond, by the library.
_PLAIN = 0x590
#: Symbols from which on a word is merged by itself.
_LONG = 64
_WHITE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


def _class(start: str) -> str:
    """Code points below _PLAIN of a Unicode category, as regular-expression ranges."""
    points = [c for c in range(_PLAIN) if unicodedata.category(chr(c)).startswith(start)]
    return "".join(re.escape(chr(c)) for c in points)


_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_class('L')}{_class('N')}]+")
_BEYOND = re.compile(f"[^\x00-{chr(_PLAIN - 1)}]")


def _lower(c: str) -> str:
    return "σ" if c == "Σ" else c.lower()


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of every code point below _PLAIN; the last place stands for all others. Odd are those that
    compose with others, or whose lower case is not one code point of the table."""
    kind, low = np.full(_PLAIN + 1, _ODD, np.uint8), np.zeros(_PLAIN + 1, np.uint16)
    for i in range(_PLAIN):
        c, small = chr(i), _lower(chr(i))
        category = unicodedata.category(c)
        if category[0] == "M" or len(small) != 1 or ord(small) >= _PLAIN or unicodedata.normalize("NFC", small) != small or unicodedata.normalize("NFC", c) != c:
            continue
        low[i] = ord(small)
        white = 0x09 <= i <= 0x0D or i in (0x20, 0x85, 0xA0)
        kind[i] = _WHITE if white else _LETTER if category[0] == "L" else _DIGIT if category[0] == "N" else _OTHER
    return kind, low


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


@dataclass
class Units:
    """What a column of texts is made of, in order: words of the tables' letters, and odd chunks as they are.

    index: for each unit its place in words (first) and odd (after them); bounds: of each text in index."""

    words: pa.Array
    odd: list[str]
    index: np.ndarray
    bounds: np.ndarray


class Merges:
    """Vocabulary, merge ranks and splitting rules of a word-level BPE file."""

    _by_path: dict[str, Merges] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + _END] for s in symbols], np.int32)
        self.back = {ord(s): b for b, s in enumerate(symbols)}
        merges = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        self.pairs = Pairs(*(np.array(x, np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], strict=True)))
        self.path, self._library = path, None

    @classmethod
    def of(cls, path: str) -> Merges:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def split(self, texts: pa.Array) -> Units:
        """The units of a whole column. A chunk between white space is odd if it has a character beyond the tables, or
        what may be a special string."""
        data, offsets = raw(texts)
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        n = len(cp)
        cuts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        kinds, lows = _tables()
        at = np.minimum(cp, _PLAIN)
        kind, low = kinds[at], lows[at]
        edge = np.zeros(n + 1, bool)  # a text starts here
        edge[cuts] = True
        inside = kind != _WHITE
        chunk = inside & edge[:n]
        chunk[1:] |= inside[1:] & ~inside[:-1]
        start = inside & edge[:n]
        start[1:] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        self._contractions(start, kind, low, edge)
        strange = kind == _ODD
        for s in self.special:
            hit = cp == ord(s[0])
            if len(s) > 1:
                hit[:-1] &= cp[1:] == ord(s[1])
            strange |= hit
        odd: list[str] = []
        if strange.any():
            number = np.cumsum(chunk, dtype=np.int32) - 1
            bad = np.zeros(int(number[-1]) + 1, bool)
            bad[number[strange]] = True
            bad = bad[number] & inside
            first = np.flatnonzero(chunk & bad)
            stop = np.flatnonzero(bad & (np.append(chunk, True)[1:] | ~np.append(inside, False)[1:])) + 1
            size = stop - first
            whole = cp[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes().decode("utf-32-le")
            ends = np.cumsum(size).tolist()
            pieces = [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            place = {c: k for k, c in enumerate(dict.fromkeys(pieces))}
            odd = list(place)
            start = np.where(bad, chunk, start)
        else:
            bad = np.zeros(n, bool)
        where = np.flatnonzero(start)
        plain = inside & ~bad
        words = _strings(low[plain], start[plain]).dictionary_encode()
        index = np.empty(len(where), np.int64)
        strange = bad[where]
        index[~strange] = words.indices.to_numpy()
        if odd:
            index[strange] = len(words.dictionary) + np.array([place[c] for c in pieces], np.int64)
        return Units(words.dictionary, odd, index, np.searchsorted(where, cuts))

    @staticmethod
    def _contractions(start: np.ndarray, kind: np.ndarray, low: np.ndarray, edge: np.ndarray) -> None:
        """Words that begin with an apostrophe end after s, t, m, d, re, ve or ll."""
        n = len(start)
        quote = np.flatnonzero(start & (low == ord("'")) & (kind == _OTHER))
        if not len(quote):
            return
        ahead = [np.where((quote + k < n) & ~edge[np.minimum(quote + k, n)], low[np.minimum(quote + k, n - 1)], 0) for k in (1, 2)]
        ahead[1] = np.where(edge[np.minimum(quote + 1, n)], 0, ahead[1])
        one = np.isin(ahead[0], [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (ahead[0] == ord(a)) & (ahead[1] == ord(b))
        for size, hit in ((1, one), (2, two)):
            at = quote[hit]
            start[at + 1] = False
            rest = at + size + 1
            rest = rest[rest < n]
            start[rest] |= (kind[rest] == _LETTER) & ~edge[rest]

    def words(self, chunk: str) -> list[bytes | int]:
        """Words of an odd chunk as UTF-8, special strings as their id."""
        out: list[bytes | int] = []
        for part in chunks(chunk):
            for x in self.cut.split(part) if self.cut is not None and self.cut.search(part) else [part]:
                if x in self.special:
                    out.append(self.special[x])
                elif x:
                    out += self._plain(x)
        return out

    def _plain(self, chunk: str) -> list[bytes]:
        if not _BEYOND.search(chunk):
            low = "".join(map(_lower, unicodedata.normalize("NFC", chunk)))
            if not _BEYOND.search(low):
                return [w.encode() for w in _WORD.findall(low)]
        if self._library is None:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self.path)
            self._library = t.normalizer, t.pre_tokenizer  # without the model, which takes most of the memory
        normalizer, splitter = self._library
        split = splitter.pre_tokenize_str(normalizer.normalize_str(chunk))
        return [bytes(self.back[ord(c)] for c in w) for w, _ in split]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (none empty) as little-endian unsigned 32-bit integers: of all neighbours that merge, the lowest rank
        first, leftmost first. Words of like length are merged together, one pair of each at a time; long ones by a heap."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order, at, width = np.argsort(sizes, kind="stable"), 0, 4
        while at < len(words):
            if width > _LONG:
                for i in order[at:].tolist():
                    out[i] = self._merged_long(words[i])
                break
            to = int(np.searchsorted(sizes[order], width, side="right"))
            for k in range(at, to, max(1, (1 << 18) // width)):
                part = order[k : min(to, k + max(1, (1 << 18) // width))]
                for i, ids in zip(part.tolist(), self._merged([words[i] for i in part.tolist()], sizes[part], width), strict=True):
                    out[i] = ids
            at, width = to, width * 2
        return out

    def _merged_long(self, word: bytes) -> bytes:
        ids = self.inner[np.frombuffer(word, np.uint8)].copy()
        ids[-1] = self.last[word[-1]]
        none, into = len(self.pairs.into), self.pairs.into
        ranks = self.pairs.find(ids[:-1], ids[1:])
        heap = [(r, i) for i, r in enumerate(ranks.tolist()) if r < none]
        heapq.heapify(heap)
        ids, after, before = ids.tolist(), [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]

        def rank(i: int) -> int:
            """Of the pair that starts at place i; none if there is no such pair (any more)."""
            if i < 0 or ids[i] < 0 or after[i] < 0:
                return none
            return int(self.pairs.find(np.array([ids[i]]), np.array([ids[after[i]]]))[0])

        while heap:
            r, i = heapq.heappop(heap)
            if rank(i) != r:
                continue  # one of the two has changed since
            j = after[i]
            ids[i], ids[j], after[i] = int(into[r]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if (new := rank(k)) < none:
                    heapq.heappush(heap, (new, k))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _merged(self, words: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        n = len(words)
        cell = np.arange(width) < sizes[:, None]
        ids = np.zeros((n, width), np.int32)
        ids[cell] = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        ids[np.arange(n), sizes - 1] = self.last[np.fromiter((w[-1] for w in words), np.int64, n)]
        left = sizes.copy()  # symbols of each word
        place = self.pairs.find(ids[:, :-1], ids[:, 1:])
        place[~cell[:, 1:]] = len(self.pairs.into)
        # row by row of what can still merge: pairs by rank, so that the place in the merge list is the rank
        row = np.arange(n)
        work = ids
        while True:
            best = place.argmin(axis=1)
            rank = place[np.arange(len(row)), best]
            on = rank < len(self.pairs.into)
            if not on.all():
                ids[row[~on]] = work[~on]
                row, work, place, best, rank = row[on], work[on], place[on], best[on], rank[on]
            if not len(row):
                break
            r = np.arange(len(row))
            work[r, best] = self.pairs.into[rank]
            # everything behind the second symbol moves up by one
            moved = np.minimum(np.arange(width) + (np.arange(width) > best[:, None]), width - 1)
            work = np.take_along_axis(work, moved, axis=1)
            place = np.take_along_axis(place, np.minimum(moved[:, : width - 1], width - 2), axis=1)
            left[row] -= 1
            last = left[row]
            place[np.arange(width - 1) >= (last - 1)[:, None]] = len(self.pairs.into)
            has = best < last - 1
            place[r[has], best[has]] = self.pairs.find(work[r[has], best[has]], work[r[has], best[has] + 1])
            has = best > 0
            place[r[has], best[has] - 1] = self.pairs.find(work[r[has], best[has] - 1], work[r[has], best[has]])
        data = ids[np.arange(width) < left[:, None]].astype("<u4").tobytes()
        ends = (4 * np.cumsum(left)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Pairs:
    """The merge list as a hash table: the place (rank) of a pair of ids, and the id that it becomes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, into: np.ndarray):
        self.into, self.bits = into.astype(np.int32), max(4, 2 + len(a).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, len(into), np.int32)
        key, rank = a.astype(np.int64) << 32 | b, np.arange(len(a), dtype=np.int32)
        slot = self._slot(key)
        while len(key):  # the first of those that want a free slot takes it; the others go on to the next
            taken = self.keys[slot] >= 0
            first = np.zeros(len(key), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            sits = first & ~taken
            self.keys[slot[sits]], self.ranks[slot[sits]] = key[sits], rank[sits]
            key, rank, slot = key[~sits], rank[~sits], (slot[~sits] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of pairs where the list lacks it."""
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], len(self.into))
        on = np.nonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        slot = slot[on]
        while len(slot):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slot] == key[on]
            out[tuple(x[hit] for x in on)] = self.ranks[slot[hit]]
            more = ~hit & (self.keys[slot] >= 0)
            on, slot = tuple(x[more] for x in on), slot[more]
        return out


def _strings(low: np.ndarray, start: np.ndarray) -> pa.Array:
    """Code points (below 2048), cut at the starts, as UTF-8 in a binary column."""
    two = low >= 0x80
    at = np.cumsum(1 + two) - (1 + two)
    out = np.empty(len(low) + int(two.sum()), np.uint8)
    out[at] = np.where(two, 0xC0 | (low >> 6), low)
    out[at[two] + 1] = 0x80 | (low[two] & 0x3F)
    offsets = np.append(at[start], len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
