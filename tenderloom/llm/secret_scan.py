"""Secret scan: rules plus a character convolutional network over every candidate with its context.

The rules give findings; all of them, as found, and random keys of any alphabet, length, tag and parts at their places and at
others, train the network against names, links, files, dates and numbers made of the words of all documents. What no rule covers is not
labelled, and no issuer's form is a training form. Groups of pictures are trained in tasks from common weights, which are averaged after each round.
A third of the pictures, held out, calibrates the scores and sets the threshold that keeps the demanded
share of known secrets. The
network then scores every candidate of every whole text and adds what the rules do not name.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_stored, in_arrow, stored
from .textnp import slices

#: The rules, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: One of these is in every text that has such a finding.
_ASSIGN_CUES = ("passw", "secret", "token", "api")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{32,}")
#: Any long run of key characters with a digit, or with capitals after small letters, may be a secret.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z0-9+/_.=-]{12})(?=[A-Za-z+/_.=-]*[0-9]|[A-Za-z+/_.=-]*[a-z][A-Z])[A-Za-z0-9+/_.=-]+")
_ADDED = "cnn"
_BEFORE, _AFTER = 20, 8
#: Characters that one filter of the network spans.
_SPAN = 5
#: Rounds of training, pictures of a group in a round, and pictures up to which each round takes all (beyond, each takes its share: one pass).
_ROUNDS, _GROUP, _FEW = 4, 8192, 1 << 18
#: What of a network is trained.
_WEIGHTS = ("embed", "filters", "bias", "out")
#: Sums over a picture's places are divided by this, so that its length counts.
_USUAL = 72


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, order, kind, end) of the rules' findings, sorted."""
    low = text.lower()
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8] if any(c in low for c in _ASSIGN_CUES) else []
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text)]


def picture(text: str, start: int, end: int) -> bytes:
    """Context before, the whole candidate and context after, one byte per character."""
    parts = (text[max(0, start - _BEFORE) : start].rjust(_BEFORE, "\0"), text[start:end], text[end : end + _AFTER].ljust(_AFTER, "\0"))
    return "".join(parts).encode("latin-1", "replace")


def by_width(pictures: list[bytes], most: int, cells: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of like width: places in the list, characters (rows padded with 0), and width of each; ``most`` rows or
    ``cells`` characters at most, one row at least."""
    size = np.fromiter(map(len, pictures), np.int64, len(pictures))
    order, at = np.argsort(size, kind="stable"), 0
    while at < len(order):
        take = order[at : at + most]
        fits = np.arange(1, len(take) + 1) * size[take] <= cells
        take = take[: max(1, int(fits.sum()))]
        width = int(size[take[-1]])
        x = np.frombuffer(b"".join([pictures[i].ljust(width, b"\0") for i in take.tolist()]), np.uint8).reshape(len(take), width)
        yield take, x, size[take]
        at += len(take)


@dataclass
class CharNet:
    """Characters -> vectors -> convolution, ReLU -> greatest and scaled sum -> logistic; then calibrated."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1

    @classmethod
    def new(cls, seed: int = 7, dim: int = 12, filters: int = 32) -> CharNet:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.3, (256, dim)), r.normal(0, (_SPAN * dim) ** -0.5, (_SPAN * dim, filters)), np.zeros(filters), r.normal(0, 0.1, 2 * filters + 1))

    def logits(self, pictures: list[bytes], cells: int = 1 << 16) -> np.ndarray:
        """Scores of any number of pictures of any width, some of their characters at a time."""
        out = np.zeros(len(pictures))
        filters = len(self.bias)
        for i, x, width in by_width(pictures, 1024, cells):
            places = (width - _SPAN + 1)[:, None]
            most, total = np.zeros((len(i), filters)), np.zeros((len(i), filters))
            step = max(1, cells // len(i))
            for k in range(0, x.shape[1] - _SPAN + 1, step):
                part = x[:, k : k + step + _SPAN - 1]
                at = np.arange(part.shape[1] - _SPAN + 1)[:, None] + np.arange(_SPAN)
                z = np.maximum(self.embed[part][:, at].reshape(len(i), len(at), -1) @ self.filters + self.bias, 0) * (k + np.arange(len(at)) < places)[:, :, None]
                most, total = np.maximum(most, z.max(axis=1)), total + z.sum(axis=1)
            out[i] = np.concatenate([most, total / _USUAL, np.ones((len(i), 1))], axis=1) @ self.out
        return out

    def probability(self, pictures: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(pictures) + self.shift, -30, 30)))

    def flat(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([getattr(self, k).ravel() for k in _WEIGHTS])

    def take(self, flat: np.ndarray) -> None:
        """The weights of such a row."""
        at = 0
        for k in _WEIGHTS:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape))
            at += old.size

    def gradients(self, x: np.ndarray, width: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss, summed over pictures of like width."""
        (n, wide), dim, f = x.shape, self.embed.shape[1], len(self.bias)
        at = wide - _SPAN + 1
        seen = self.embed[x]
        cols = np.lib.stride_tricks.sliding_window_view(seen.reshape(n, -1), _SPAN * dim, axis=1)[:, ::dim].reshape(n * at, -1)
        share = ((np.arange(at) < (width - _SPAN + 1)[:, None]) / _USUAL).astype(seen.dtype)  # 0 behind a row's own width
        z = np.maximum((cols @ self.filters).reshape(n, at, f) + self.bias, 0) * (share > 0)[:, :, None]
        top = z.argmax(axis=1)[:, None]
        features = np.concatenate([np.take_along_axis(z, top, axis=1)[:, 0], (share[:, None] @ z)[:, 0], np.ones((n, 1), seen.dtype)], axis=1)
        delta = weight * (1 / (1 + np.exp(-np.clip(features @ self.out, -30, 30))) - y)
        back = delta[:, None] * self.out
        dz = share[:, :, None] * back[:, None, f : 2 * f]
        np.put_along_axis(dz, top, np.take_along_axis(dz, top, axis=1) + back[:, None, :f], axis=1)
        dz *= z > 0
        dz = dz.reshape(n * at, f)
        dcols, dseen = (dz @ self.filters.T).reshape(n, at, _SPAN, dim), np.zeros_like(seen)
        for k in range(_SPAN):
            dseen[:, k : k + at] += dcols[:, :, k]
        embed = np.stack([np.bincount(x.ravel(), dseen[:, :, d].ravel(), len(self.embed)) for d in range(dim)], axis=1)
        return {"embed": embed, "filters": cols.T @ dz, "bias": dz.sum(axis=0), "out": features.T @ delta}

    def train(self, pictures: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = 1, rate: float = 0.01, batch: int = 128, seed: int = 3) -> None:
        """Weighted logistic loss with Adam, in single precision."""
        r = np.random.default_rng(seed)
        y, weight = y.astype(np.float32), weight.astype(np.float32)
        self.take(self.flat().astype(np.float32))
        first, second = ({k: np.zeros_like(getattr(self, k)) for k in _WEIGHTS} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(pictures))
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                grads = {k: np.zeros_like(getattr(self, k)) for k in _WEIGHTS}
                for i, x, width in by_width([pictures[j] for j in part.tolist()], batch):
                    for name, g in self.gradients(x, width, y[part[i]], weight[part[i]] / np.float32(len(part))).items():
                        grads[name] += g.astype(np.float32)
                step += 1
                for name in _WEIGHTS:
                    first[name] = 0.9 * first[name] + 0.1 * grads[name]
                    second[name] = 0.999 * second[name] + 0.001 * grads[name] ** 2
                    setattr(self, name, getattr(self, name) - np.float32(rate) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + np.float32(1e-8)))
        self.take(self.flat().astype(float))


_CUES = ("Authorization: Bearer ", "pwd ", "credential: ", "use the key ", "private key ", "login with ", "", "auth ", "export KEY=", "here it is: ", "and then ", '"')
_NAMES = re.compile("[A-Za-z]{3,12}")
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALPHABETS = (_DIGITS + "ABCDEF", _LOWER + _DIGITS, _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + "+/", _LOWER + _UPPER + _DIGITS + "-_", _DIGITS + "abcdef")
#: Ways to make a key: of one run, behind a short tag, of parts joined by a mark.
FORMS = ("plain", "tagged", "parts")


def made_key(r: np.random.Generator, form: str) -> str:
    """A random key: any alphabet and length; its tag and marks are random too, so that no issuer's form is learned as such."""
    run = lambda alphabet, n: "".join(r.choice(list(alphabet), n))
    alphabet, n = _ALPHABETS[r.integers(len(_ALPHABETS))], int(16 + 48 * r.random() ** 2)
    if form == "plain":
        return run(alphabet, n)
    tag = run(_LOWER if r.random() < 0.6 else _LOWER + _UPPER, int(r.integers(2, 6)))
    if form == "tagged":
        more = run(_LOWER, int(r.integers(3, 6))) + "_-"[r.integers(2)] if r.random() < 0.4 else ""
        return tag + ("_-" if r.random() < 0.75 else "  ")[r.integers(2)].strip() + more + run(alphabet, max(n, 20))
    mark = ".-_"[r.integers(3)]
    sizes = r.integers(8, 40, int(r.integers(2, 4)))
    return ("" if r.random() < 0.5 else tag + mark) + mark.join(run(_DIGITS if mark == "-" and k + 1 < len(sizes) and r.random() < 0.5 else alphabet, int(n)) for k, n in enumerate(sizes))


def rewritten(text: str, start: int, end: int, forms: tuple[str, ...] = FORMS) -> list[tuple[str, int, int]]:
    """(text, start, end): a rule's finding, and random keys, where it stands and after other words; the finding's checksum chooses them."""
    value = re.split("[:=]\\x20*[\"']?", text[start:end], maxsplit=1)[-1].strip("\"'")
    r = np.random.default_rng(zlib.crc32(f"{start}:{value}".encode()))
    out = []
    for form in (value, value.upper(), *(made_key(r, f) for f in forms for _ in range(4))):
        at = int(r.integers(len(text) + 1))
        before, after = (text[max(0, start - _BEFORE) : start], text[end : end + _AFTER]) if r.random() < 0.3 else (_tail(text[max(0, at - _BEFORE) : at]), f" {text[at : at + _AFTER]}")
        before += _CUES[r.integers(len(_CUES))]
        out.append((before + form + after, len(before), len(before) + len(form)))
    return out


def _tail(text: str) -> str:
    """Words before a place, up to a blank, so that what comes next stands alone."""
    return text.rstrip() + " " if text.strip() else ""


def clean(text: str, least: int = 8, every: int = 40) -> list[tuple[str, int, int]]:
    """(text, start, end): names, paths, links, files, dates, versions and numbers made of a text's words, at the place of the words:
    one for ``every`` words of a long text, ``least`` of a shorter one that has the words for them."""
    words = list(_NAMES.finditer(text))
    out = []
    for k in range(0, len(words) - 3, min(every, max(3, len(words) // least))):
        a, b, c = (w[0].lower() for w in words[k : k + 3])
        n = zlib.crc32(f"{a}{b}{c}{k}".encode())
        day = f"20{n % 30:02}-{n % 12 + 1:02}-{n % 28 + 1:02}"
        forms = (
            f"{a}_{b}_{c}{n % 100}", f"/{a}/{b}/{c}.html", f"{a}{b.title()}{c.title()}", f"{day}T{n % 24:02}", f"{a}-{b}-{n % 10}.{n % 7}.{n % 19}", f"{a}.{b}/{c}?id={n % 10000}", f"{a}-{day}", f"{n % 10**12:012}",
            f"{a.title()}{b.title()}{c.title()}Factory", f"get{a.title()}By{b.title()}", f"{a.upper()}_{b.upper()}_{n % 1000}", f"www.{a}-{b}.com/{c}/{n % 10**6}", f"IMG_{day.replace('-', '')}_{n % 10**6:06}.jpg", f"{a}{b}{c}{n % 10**4}", f"{a}/{b}_{c}/v{n % 9}", f"+{n % 90 + 10}-{n % 1000:03}-{n % 10**7:07}", f"{day}T{n % 24:02}.{n % 60:02}.{n % 59:02}Z",
            f"{a}-{b}-{c}-{n % 100}", f"{n % 10**5}-{n % 10**7}-{n % 10**4}", f"{a}{n % 100}.{b}{n % 7}.{c}", f"1.{n % 10**3}.{n % 10**3}.{n % 10**5}", f"{a.title()}-{b.title()}/{n % 300}.{n % 10}", f"--{a}-{b}={n % 10**4}", f"{a}.{b}.{c.title()}Test",
        )
        before = _tail(text[max(0, words[k].start() - _BEFORE) : words[k].start()]) + (_CUES[n % len(_CUES)] if n % 3 == 0 else "")
        form = forms[n % len(forms)]
        out.append((f"{before}{form} {b}", len(before), len(before) + len(form)))
    return out


def _findings(docs: DataFrame) -> DataFrame:
    """Labelled candidates of all rows: h (hash of text and start), picture, secret: those of a rule's finding, as found and
    rewritten, and of clean spans. Others are not labelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                places, pictures, labels = [], [], []

                def add(place: str, text: str, start: int, end: int, secret: bool) -> None:
                    for a, b in candidates(text):  # noqa: B023
                        if a < end and start < b:
                            places.append(place)  # noqa: B023
                            pictures.append(picture(text, a, b))  # noqa: B023
                            labels.append(secret)  # noqa: B023

                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    text = text or ""
                    name = f"{doc_id}:{zlib.crc32(text.encode())}"
                    for start, _, end in base_spans(text):
                        place, first = f"{name}:{start}", max(0, start - 200)
                        for made in ((text[first : end + 200], start - first, end - first), *rewritten(text, start, end)):
                            add(place, *made, True)
                    for k, made in enumerate(clean(text)):
                        if not base_spans(made[0]):
                            add(f"{name}:clean:{k}", *made, False)
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.string()), pa.array(pictures, pa.binary()), pa.array(labels, pa.bool_())], ["place", "picture", "secret"])

    found = in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "place string, picture binary, secret boolean")
    return found.select(F.xxhash64("place").alias("h"), "picture", "secret")


def _trained(rows: DataFrame, n: int, weight: tuple[float, float]) -> CharNet:
    """A network trained on all ``n`` rows (h, picture, secret) in rounds: groups of some thousand pictures, dealt by hash, go on from the last
    round's weights, each in a task; then the weights are averaged by pictures. Up to _FEW pictures each round takes all of them, more
    are dealt over the rounds. Only the averages come to the driver."""
    net, parts = CharNet.new(), 1 if n <= _FEW else _ROUNDS
    groups = -(-n // (parts * _GROUP))
    for k in range(_ROUNDS):
        start, rate = net.flat(), 0.01 * (1 - k / _ROUNDS)

        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by([("h", "ascending"), ("picture", "ascending")])
            y, own = group["secret"].to_numpy().astype(float), CharNet.new()
            own.take(start)  # noqa: B023
            own.train(group["picture"].to_pylist(), y, np.where(y == 1, weight[1], weight[0]), epochs=min(8, max(1, _GROUP // len(y))), rate=rate, seed=k)  # noqa: B023
            return pa.table({"n": [len(y)], "w": pa.array([own.flat()], pa.list_(pa.float64()))})

        part = rows.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == k % parts)
        dealt = part.withColumn("group", F.pmod(F.xxhash64("h", "picture"), F.lit(groups)))
        weights = dealt.groupBy("group").applyInArrow(run, "n long, w array<double>").select("n", F.posexplode("w"))
        total = F.sum((F.col("col") * F.col("n")).cast("decimal(38,18)"))  # decimals: in any order the same sum
        mean = weights.groupBy("pos").agg((total.cast("double") / F.sum("n")).alias("w")).orderBy("pos").toPandas().w.to_numpy(float)
        if len(mean):
            net.take(mean)
    return net


def kth(df: DataFrame, column: str, k: int) -> float:
    """The value at place ``k`` (from 0) of a column's sorted values: counts of 1024 bins, of which the right one is cut again until it is one value."""
    x = F.col(column)
    low, high = df.agg(F.min(x), F.max(x)).first()
    while low < high:
        place = F.least(F.floor((x - low) / F.lit(high - low) * 1024), F.lit(1023))
        for _, n, low, high in df.where(x.between(low, high)).groupBy(place.alias("bin")).agg(F.count("*"), F.min(x), F.max(x)).orderBy("bin").collect():  # noqa: B007, B020
            if k < n:
                break
            k -= n
    return low


def _calibrate(net: CharNet, held: DataFrame, secrets: int, recall: float) -> None:
    """A logistic fit of the logits of all held-out rows, then the greatest threshold that still finds ``recall`` of their ``secrets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(net.logits(batch.column(0).to_pylist())), batch.column(1)], ["logit", "secret"])

    scores = stored(in_arrow(held.select("picture", "secret"), run, "logit double, secret boolean"), "held-out-logits")
    x, y, a, b = F.col("logit"), F.col("secret").cast("double"), 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + F.exp(-F.least(F.greatest(a * x + b, F.lit(-30.0)), F.lit(30.0))))
        w = p * (1 - p)
        ga, gb, aa, ab, bb = scores.agg(*map(F.avg, ((p - y) * x, p - y, w * x * x, w * x, w))).first()
        d = np.linalg.solve(np.array([[aa + 1e-3, ab], [ab, bb + 1e-6]]), np.array([ga + 1e-3 * (a - 1), gb]))
        a, b = a - float(np.clip(d[0], -1, 1)), b - float(np.clip(d[1], -1, 1))
        if abs(d).max() < 1e-6:
            break
    net.scale, net.shift = round(a, 6), round(b, 6)
    least = kth(scores.where("secret").select((net.scale * x + net.shift).alias("z")), "z", int((1 - recall) * secrets))
    net.threshold = float(1 / (1 + np.exp(-np.clip(least, -30, 30))))
    drop_stored(scores)


def fit(docs: DataFrame, recall: float = 0.98, least: int = 20) -> CharNet | None:
    """Train on the findings and clean spans of all documents; a third of their places, by hash, calibrates. With fewer than ``least``
    findings of either kind there is no network (None), and the scan adds nothing to the rules."""
    found = stored(_findings(docs), "labelled-candidates")
    held = F.pmod("h", F.lit(3)) == 0
    counts = {(r.secret, r.held): r.n for r in found.groupBy("secret", held.alias("held")).agg(F.count("*").alias("n")).collect()}
    (clean_in, clean_out), (known_in, known_out) = ([counts.get((k, h), 0) for h in (False, True)] for k in (False, True))
    if min(known_in + known_out, clean_in + clean_out) < least or min(known_out, clean_out) < 3 or not min(known_in, clean_in):
        return None
    n = known_in + clean_in
    net = _trained(found.where(~held), n, (0.5 * n / clean_in, 0.5 * n / known_in))
    _calibrate(net, found.where(held), known_out, recall)
    drop_stored(found)
    return net


def scan(docs: DataFrame, net: CharNet | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans for every row of (doc_id, text).

    base and spans list kind:start:end (code points, end exclusive) by start, then kind; spans also holds what
    the network adds (kind ``cnn``), which never overlaps a rule's finding. A null or empty text has no spans; rows keep
    their number, repeated ones too, and do not depend on one another; texts of any length are scanned whole; an empty table gives an
    empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for piece in slices(batch, 1):
                bases, open_ones, pictures = [], [], []
                for i, text in enumerate(piece.column(1).to_pylist()):
                    text = text or ""
                    base = base_spans(text)
                    bases.append(base)
                    if net is not None:
                        starts = [s for s, _, _ in base]
                        reach = list(accumulate((e for _, _, e in base), max))
                        for a, b in candidates(text):
                            before = bisect_left(starts, b)  # rule findings that start before the candidate ends
                            if not before or reach[before - 1] <= a:
                                open_ones.append((i, a, b))
                                pictures.append(picture(text, a, b))
                added: list[list[tuple[int, int, int]]] = [[] for _ in bases]
                if pictures:
                    for (i, a, b), take in zip(open_ones, (net.probability(pictures) >= net.threshold).tolist(), strict=True):
                        if take:
                            added[i].append((a, len(KINDS), b))
                names = (*KINDS, _ADDED)
                show = lambda spans: ",".join([f"{names[k]}:{a}:{b}" for a, k, b in spans])
                counts = [pa.array([sum(k == n for _, k, _ in x) for x in bases], pa.int64()) for n in range(3)]
                yield pa.RecordBatch.from_arrays([piece.column(0), *counts, pa.array(map(show, bases), pa.string()), pa.array([show(sorted(x + y)) for x, y in zip(bases, added, strict=True)], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    kind = "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string"
    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, kind)


def secrets_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs, fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
