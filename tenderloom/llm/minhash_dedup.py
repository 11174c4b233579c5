"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of ``side`` small hashes each are made, every small hash from ``rows`` minhashes.
A table key is a pair of one small hash of either collection: side * side tables from
2 * side * rows minhashes, where plain banding with keys of the same length would take
side * side * 2 * rows of them. With side 10 and rows 2, two sets of similarity 0.75 share
at least one table with probability (1 - (1 - 0.75^2)^10)^2 = 0.9995.

Only connectivity is asked for, so no group becomes pairs. Documents of one shingle set are one class.

1. Every table key compares its members with one of them, picked by hash of key and class, so that a class meets other
   centres in each of its keys. A sketch of 256 one-bit bins leaves out pairs that are probably far apart: it only
   saves work here. Keys whose members are then one component are settled.
2. What is in other keys is told apart by rare shingles. Shingles are ordered by their count over those classes, rarest
   first. Two sets of the similarity share one of their first n - ceil(0.75 n) + 1, and at the first one that they
   share, what is left in both must still be enough: exact for every pair, and a passage in very many documents comes
   last in the order. Again each shingle first compares its members with one of them; where components are left apart,
   all members of different components that pass the bounds are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, contracted, counted, free_names, in_arrow, small, stored
from .textnp import NOT_SPACE, mix, raw, run_hashes, slices, word_hashes, words

SHINGLE = 5
BINS = 256


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts, one after the other, and their bounds."""
    data, offsets = raw(texts)
    starts, ends, bounds = words(data, offsets, NOT_SPACE)
    h = word_hashes(data, starts, ends)
    count = np.diff(bounds)
    shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), shingles)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + bounds[:-1][owner]
    s = run_hashes(h, first, np.minimum(first + size, bounds[1:][owner]))
    order = np.lexsort((s, owner))
    s = s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(count)))])


def small_hashes(sets: np.ndarray, bounds: np.ndarray, side: int, rows: int) -> np.ndarray:
    """[texts, 2 * side] small hashes, each of ``rows`` minhashes; a text without shingles has zeros."""
    out = np.zeros((len(bounds) - 1, 2 * side), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    for k in range(2 * side):
        key = np.full(len(full), k + 1, np.uint64)
        for r in range(rows):
            seed = mix(np.array([k * rows + r + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            least = np.minimum.reduceat((sets ^ seed) * np.uint64(0xBF58476D1CE4E5B9) ^ (sets >> np.uint64(29)), bounds[full])
            key = mix(key * np.uint64(0x94D049BB133111EB) + least)
        out[full, k] = key
    return out


def sketches(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """[texts, 8]: which of 256 bins (top bits) hold a shingle, and the last bit of the least one in each."""
    texts = len(bounds) - 1
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    place = owner * BINS + (sets >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, int)
    bits = np.zeros((2, texts * BINS), np.uint8)
    bits[0, place[first]] = 1
    bits[1, place[first]] = (sets[first] & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(bits.reshape(2, texts, BINS), axis=2, bitorder="little").view("<u8")
    return np.concatenate([packed[0], packed[1]], axis=1)


def far_apart(a: str, b: str, percent: int):
    """Whether the sketches of two rows (columns ``a`` and ``b``) rule out the similarity. In shared bins that are not
    decided by a common shingle the last bits agree by chance, half of the time: their surplus estimates the similarity."""
    x, y = (lambda k: F.get(a, F.lit(k))), (lambda k: F.get(b, F.lit(k)))
    total = lambda f: sum((F.bit_count(f(k)) for k in range(1, 4)), F.bit_count(f(0)))
    both = total(lambda k: x(k).bitwiseAND(y(k)))
    either = total(lambda k: x(k).bitwiseOR(y(k)))
    differ = total(lambda k: x(k + 4).bitwiseXOR(y(k + 4)).bitwiseAND(x(k)).bitwiseAND(y(k)))
    return both - 2 * differ < F.lit(percent / 100) * either - F.lit(3.2) * F.sqrt(either)


def signatures(docs: DataFrame, side: int, rows: int) -> DataFrame:
    """doc_id, fp (hash of the text), n_shingles, set_a, set_b (a 128-bit hash of the whole set), small (2 * side hashes),
    sketch per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 2):
                sets, bounds = shingle_sets(piece.column(2))
                columns = [*piece.columns[:2], pa.array(np.diff(bounds)), *map(pa.array, set_hashes(sets, bounds))]
                for x in (small_hashes(sets, bounds, side, rows), sketches(sets, bounds)):
                    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).ravel().view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "n_shingles", "set_a", "set_b", "small", "sketch"])

    kind = "doc_id long, fp long, n_shingles long, set_a long, set_b long, small array<long>, sketch array<long>"
    return in_arrow(_with_fp(docs), run, kind)


def _with_fp(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("fp"), text.alias("text"))


def set_hashes(sets: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Both halves of a 128-bit hash of each whole set."""
    total = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (mix(sets), mix(sets ^ np.uint64(0x5851F42D4C957F2D)))]
    return [(t[bounds[1:]] - t[bounds[:-1]]).view(np.int64) for t in total]


def full_sets(texts: DataFrame) -> DataFrame:
    """id, n, shingles (all distinct shingle hashes) of rows of (id, set_a, set_b, text); one row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 3):
                sets, bounds = shingle_sets(piece.column(3))
                found = pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))], ["id", "n", "shingles"])
                same = [x == piece.column(1 + k).to_numpy() for k, x in enumerate(set_hashes(sets, bounds))]
                yield found.filter(pa.array(same[0] & same[1]))

    return in_arrow(texts.select("id", "set_a", "set_b", "text"), run, "id long, n long, shingles array<long>").dropDuplicates(["id"])


def _keys(classes: DataFrame, side: int) -> DataFrame:
    """(key, id): the side * side table keys of each class that a second class shares."""
    pairs = F.flatten(F.transform(F.slice("small", 1, side), lambda a: F.transform(F.slice("small", side + 1, side), lambda b: F.xxhash64(a, b))))
    keys = classes.select("id", F.explode(pairs).alias("key"))
    two = keys.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("key")
    return keys.join(two, "key", "left_semi")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those with 100 * intersection >= percent * union on full sets."""
    at = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    at = at.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return at.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 75, side: int = 10, rows: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text).

    A document's set is its distinct 5-word shingles (white-space words, A-Z lower-cased); of fewer
    words, the whole sequence. Null, empty and blank texts have an empty set and are linked with nothing: each is
    its own component and kept. Documents of equal sets are one component (ties: the least doc_id
    stays). Rows that repeat a doc_id are reported as often as they come, each by its own text. A row with a null
    doc_id is linked with nothing; its component is null, and it is kept. An empty table gives an empty result; further
    columns are not read.
    """
    return _by_row(docs, percent, side, rows).drop("fp", "part")


def _by_row(docs: DataFrame, percent: int, side: int, rows: int) -> DataFrame:
    """The rows of near_duplicates() with fp, the hash of their text, and part, a number of their component (null: linked with nothing)."""
    signed = stored(signatures(docs, side, rows), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    group = ["set_a", "set_b", "n_shingles"]
    classes = full.groupBy(*group).agg(F.min(F.struct("doc_id", "fp")).alias("first"), F.first("small").alias("small"), F.first("sketch").alias("sketch"))
    classes = stored(classes.select(*group, "first.*", "small", "sketch", F.col("n_shingles").alias("n"), F.monotonically_increasing_id().alias("id")), "classes")
    open_keys = stored(_keys(classes, side), "keys")
    named = classes.select(*group, "id", F.col("id").alias("part"), F.col("doc_id").alias("component_id"))
    if not open_keys.isEmpty():
        components = _link(open_keys, classes, docs, percent)
        least = components.join(classes.select("id", "doc_id"), "id").groupBy("c").agg(F.min("doc_id").alias("component_id"))
        linked = components.join(least, "c").select("id", "c", F.col("component_id").alias("least"))
        named = named.join(linked, "id", "left").withColumns({"component_id": F.coalesce("least", "component_id"), "part": F.coalesce("c", "part")})
    found = full.select("doc_id", "fp", *group).join(named.select(*group, "component_id", "part"), group).select("doc_id", "fp", "n_shingles", "component_id", "part")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "fp", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("part"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows (id, ...) with c: the least id that the known edges (a, b) lead to directly, else the id itself."""
    of = known.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("c"))
    return rows.join(of, "id", "left").withColumn("c", F.coalesce("c", "id"))


def _apart(rows: DataFrame, by: str, known: DataFrame) -> DataFrame:
    """The rows, with their components, of values of ``by`` that still hold two components."""
    here = _labelled(rows, known)
    held = here.groupBy(by).agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select(by)
    return here.join(held, by, "left_semi")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, id, n, rest): each set's shingles, rarest first, that a second set holds and by which a similar
    set must be met; rest: how many the set has from there on."""
    every = sets.select("id", "n", F.explode("shingles").alias("shingle"))
    often = every.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    shared = every.join(often, "shingle").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("x"))
    # shingles of one set alone come first in the order: they take places, but meet nothing
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("x"))
    head = shared.where(room > 0).select("id", "n", F.size("x").alias("size"), F.posexplode(F.slice("x", F.lit(1), room.cast("int"))).alias("at", "s"))
    return head.select(F.col("s.shingle").alias("shingle"), "id", "n", (F.col("size") - F.col("at")).alias("rest"))


def _link(keys: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Components (id, c) of all classes that the keys bring together and full sets confirm.

    Between the steps, components need not be final: two rows of one component that is not known as one are only compared
    once more.
    """
    like = f"100 * least(n, an) >= {percent} * greatest(n, an)"
    wanted = keys.select("id").distinct().join(classes.select("id", "set_a", "set_b", "doc_id", "fp"), "id")
    texts = _with_fp(docs).join(wanted, ["doc_id", "fp"])
    sets = stored(full_sets(texts), "sets")

    about = classes.select("id", "n", "sketch")
    centre = keys.groupBy("key").agg(F.min_by("id", F.xxhash64("id", "key")).alias("a"))
    met = keys.join(centre, "key").where("id <> a").select("a", "id")
    met = _ordered(met).select("a", F.col("b").alias("id")).join(about, "id").join(about.toDF("a", "an", "asketch"), "a")
    met = met.where(like).where(~far_apart("sketch", "asketch", percent)).select("a", F.col("id").alias("b"))
    known, _ = contracted(_confirmed(met, sets, percent), 1)

    left = stored(_apart(keys, "key", known).select("id").distinct(), "open")
    rare = stored(rare_shingles(sets.join(left, "id", "left_semi"), percent), "rare")
    # of both sets together, what is left at the first common shingle is enough for the similarity
    enough = f"least(rest, arest) * {100 + percent} >= {percent} * (n + an)"
    pick = F.struct(F.col("id").alias("a"), F.col("n").alias("an"), F.col("rest").alias("arest"), F.col("c").alias("ac"))
    here = _apart(rare, "shingle", known)
    centre = here.groupBy("shingle").agg(F.min_by(pick, F.xxhash64("id", "shingle")).alias("m")).select("shingle", "m.*")
    met = _ordered(here.join(centre, "shingle").where("c <> ac").where(like).where(enough))
    known, _ = contracted(known.unionByName(_confirmed(met, sets, percent)), 1)

    here = stored(_apart(rare, "shingle", known), "apart")
    met = _ordered(here.join(here.select("shingle", pick.alias("m")).select("shingle", "m.*"), "shingle").where("c < ac").where(like).where(enough))
    return connected_components(known.unionByName(_confirmed(met, sets, percent))).withColumnRenamed("component_id", "c")


def one_of_each(docs: DataFrame, percent: int = 75, side: int = 10, rows: int = 2) -> DataFrame:
    """One row of ``docs`` for each component of near_duplicates(), with its columns: the least doc_id, of its texts the one of the least hash.

    Rows that repeat a doc_id and its text are one row (of the least hash over all columns); texts linked with nothing stay once for each
    doc_id. Rows without doc_id all stay.
    """
    found = stored(_by_row(docs, percent, side, rows).where("doc_id is not null").groupBy("doc_id", "fp", "part").agg(F.count("*").alias("n")), "components")
    first = found.where("part is not null").groupBy("part").agg(F.min(F.struct("doc_id", "fp")).alias("first"))
    gone = found.join(first, "part").where(F.struct("doc_id", "fp") != F.col("first")).select("doc_id", "fp")
    of, print_ = free_names(docs, "of", "print")
    marked = docs.withColumns({of: F.col("doc_id").cast("long"), print_: F.xxhash64(F.col("text").cast("string"))})
    left = marked.join(gone.toDF(of, print_), [of, print_], "left_anti")
    repeats, n = counted(found.where("n > 1").select("doc_id", "fp").toDF(of, print_), "repeats")
    if n:
        rest = left.join(small(repeats, n), [of, print_], "left_anti")
        once = left.join(small(repeats, n), [of, print_], "left_semi").groupBy(of, print_).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
        left = rest.select(*docs.columns).unionByName(once.select("row.*"))
    return left.select(*docs.columns)
