"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds, for every slot, a bit per language; the AND of an n-gram's
slots is the set of all languages that contain it. A text's popcount per language, less what
the filter's own false positives add, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow
from .textnp import LOWER, mix, raw, slices

UNKNOWN = "und"
_N = 4  # bytes of an n-gram
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_FOLD = LOWER.copy()
_FOLD[: 0x80][~_LETTER[:0x80]] = 0x20


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of letters and single blanks inside each text, with the number of their text."""
    folded = _FOLD[data]
    if len(folded) < _N:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    blank = folded == 0x20
    wide = blank[:-1] & blank[1:]  # two blanks: left out, so that layout does not count
    n = len(folded) - _N + 1
    ok = ~(wide[:n] | wide[1 : n + 1] | wide[2 : n + 2])
    for cut in range(1, _N):  # windows across a text's end
        at = offsets[1:-1] - cut
        ok[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(ok)
    grams = np.zeros(len(at), np.uint32)
    for k in range(_N):
        grams |= folded[at + k].astype(np.uint32) << np.uint32(8 * k)
    return grams, np.searchsorted(offsets, at, side="right") - 1


@dataclass
class LanguageFilter:
    """languages: learned, most frequent first. table: [slots, words of 64 languages]. false: chance that a foreign n-gram passes."""

    languages: list[str]
    table: np.ndarray
    false: np.ndarray

    def slots(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        size = np.uint64(len(self.table) - 1)
        return (h & size).astype(np.int64), ((h >> np.uint64(32)) & size).astype(np.int64)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text, and how many of them each language holds, corrected for false positives."""
        texts = len(offsets) - 1
        grams, text = _grams(data, offsets)
        total = np.bincount(text, minlength=texts).astype(float)
        a, b = self.slots(grams)
        held = np.zeros((texts, len(self.languages)))
        for w in range(self.table.shape[1]):
            mask = self.table[a, w] & self.table[b, w]
            for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                held[:, k] = np.bincount(text, weights=((mask >> mask.dtype.type(k % 64)) & mask.dtype.type(1)), minlength=texts)
        return total, np.maximum(0, (held - total[:, None] * self.false) / np.maximum(1 - self.false, 1e-9))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score (the winner's share of all corrected counts) of each text."""
        return self.shares(texts)[:2]

    def shares(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and the share of the text's n-grams that are the language's (1 for a text without any)."""
        data, offsets = raw(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        total, held = self.counts(data, offsets)
        best = held.argmax(axis=1)
        score = held[np.arange(len(best)), best] / np.maximum(held.sum(axis=1), 1e-9)
        ascii_letter = np.concatenate([[0], np.cumsum(_LETTER[data])])
        plain = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
        out = []
        for i, k in enumerate(best):
            known = plain[i] or any(map(str.isalpha, texts[i].as_py() or ""))
            out.append(self.languages[k] if known else UNKNOWN)
            if not known:
                score[i] = 0
        return out, score, np.where(total > 0, held[np.arange(len(best)), best] / np.maximum(total, 1), 1.0)


def fit(docs: DataFrame, max_docs: int = 2000, min_share: float = 0.002, slots: int = 1 << 20) -> LanguageFilter:
    """Learn from (doc_id, text, lang), rows with both text and lang.

    Bounded sample, as documented: of each language the documents whose doc_id hashes below the share that makes
    ``max_docs`` expected; no rows are ranked, so no language is gathered in one task. An n-gram belongs to a language if a share
    ``min_share`` of its sampled documents (two at least, or one where fewer than three documents are at hand) hold it.
    To the driver come one count for each language and the filter itself, ``slots`` rows for each 64 languages at
    most. Every language has bits of its own in all slots, so their number does not fill the filter. Rows with a null doc_id are
    not learned from, repeated rows count as often as they come, and an empty table gives a filter without languages.
    """
    rows = docs.where("text is not null and lang is not null and doc_id is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("h"))
    counted = docs.where("text is not null and lang is not null and doc_id is not null").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in counted.collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    words = max(1, -(-len(languages) // 64))
    found = LanguageFilter(languages, np.zeros((slots, words), np.uint8 if len(languages) <= 8 else np.uint64), np.zeros(len(languages)))
    if not languages:
        return found
    per_language = lambda f: F.create_map(*[F.lit(x) for k in languages for x in (k, float(f(sizes[k])))])[F.col("lang")]
    sample = rows.where(F.pmod("h", F.lit(1 << 32)) < per_language(lambda n: min(1, max_docs / n) * 2**32)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                grams, text = _grams(*raw(piece.column(1)))
                lang = piece.column(0).dictionary_encode()
                pair = np.unique((text.astype(np.uint64) << np.uint64(32)) | grams)
                code = lang.indices.to_numpy(zero_copy_only=False).astype(np.uint64)[(pair >> np.uint64(32)).astype(np.int64)]
                keys, n = np.unique((code << np.uint64(32)) | (pair & np.uint64(0xFFFFFFFF)), return_counts=True)
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array((keys >> np.uint64(32)).astype(np.int64))), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    kept = in_arrow(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def enough(n: int) -> float:
        n = min(n, max_docs)
        return max(min(2, (n + 1) // 2), min_share * n)

    number = F.create_map(*[F.lit(x) for k, name in enumerate(languages) for x in (name, k)])[F.col("lang")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(found.slots(batch.column(1).to_numpy().astype(np.uint64)))
            number = np.tile(batch.column(0).to_numpy(), 2)
            bits = (np.uint64(1) << (number % 64).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(number // 64), pa.array(bits)], ["slot", "word", "bits"])

    bits = in_arrow(kept.where(F.col("n") >= per_language(enough)).select(number.alias("k"), "gram"), place, "slot long, word int, bits long")
    bits = bits.groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toPandas()
    found.table[bits.slot, bits.word] = bits.bits.to_numpy(np.int64).view(np.uint64).astype(found.table.dtype)
    for k in range(len(languages)):
        found.false[k] = float(((found.table[:, k // 64] >> found.table.dtype.type(k % 64)) & found.table.dtype.type(1)).mean() ** 2)
    return found


def label(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred, score for every row of (doc_id, text); nothing else of ``docs`` is read.

    A null or empty text, or one without a letter, is ``und`` with score 0. Rows with equal texts get
    equal answers; repeated rows stay; ties go to the language with more sampled documents, then by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots x languages/8 bytes: fixed by fit()

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                lang, score = shared.value.predict(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), tag, "doc_id long, lang_pred string, score double")


def known(docs: DataFrame, model: LanguageFilter, languages: list[str] | None = None, least: float = 0.02) -> DataFrame:
    """The rows of ``docs`` in one of the languages asked for (None: any that was learned), with all their columns.

    A text is rejected if it has no letter (or is null), if its predicted language is not asked for, or if of its n-grams less
    than the share ``least`` are that language's, corrected for false positives: then it is in none of the learned ones.
    A text too short for an n-gram has no such share and is held to its prediction. A model without languages knows nothing to reject by,
    and every row stays.
    """
    if not model.languages:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    asked = None if languages is None else set(languages)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, at):
                lang, _, share = shared.value.shares(piece.column(at))
                yield piece.filter(pa.array([x != UNKNOWN and s >= least and (asked is None or x in asked) for x, s in zip(lang, share.tolist(), strict=True)], pa.bool_()))

    return in_arrow(docs, keep, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """The fifth of documents that training never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
