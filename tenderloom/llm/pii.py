"""Personal data: candidate spans scored by gradient-boosted trees, with DataFrame functions only.

Generators with high recall propose overlapping spans: the four rule patterns, number-like runs,
address-like runs (also with "at" and "dot" spelled out) and account-like codes. Of added spans that overlap the best stays. Boosted trees
(MLlib, trained here on a bounded sample) use format and context features; their scores are calibrated
on held-out candidates, whose precision sets the threshold. The trees are then unrolled into one column expression, so
scoring is part of the same scan and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_spans import with_spans
from .shared import stored

#: The rules' kinds in the order in which spans of one start are listed; the model's own kind comes last.
KINDS = ("email", "ip", "card", "phone")
ADDED = "gbt"

# Each pattern finds what its rule finds, with possessive loops over groups of unbounded count (Java's engine recurses
# in others; nothing follows them, so nothing is lost) and without starting again inside a run that has failed from its start:
# a mail address may also start where the last match ended; a card's digits are bounded by its rule.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What may be personal data beyond the rules.
GENERATORS = {
    "number": r"(?<![0-9A-Za-z+(])[+(]?[0-9][0-9 ()./-]{5,}[0-9](?![0-9A-Za-z])",
    "address": rf"(?i)(?<!{_LOCAL})[a-z0-9._%+-]{{2,}} ?(?:@|\(at\)|\[at\]) ?[a-z0-9-]{{2,}}(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)[a-z0-9-]{{2,}}){{0,4}} ?(?:\.|\(dot\)|\[dot\]) ?[a-z]{{2,}}(?![a-z0-9])",
    "code": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
#: What every match of a pattern holds, as far as that is found faster than the match.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "number": r"[0-9][0-9 ()./-]{5}", "address": r"@|[(\[][aA][tT][)\]]", "code": "[A-Z]{2}[0-9]{2}"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CUE = r"(?i)(?:mail|phone|tel|call|mobile|fax|card|account|iban|contact|ssn|passport|address|\bip\b)"
_BEFORE = 24
#: A day, or a month with its year, stands in the span.
_DATE = r"(?<![0-9])(?:0?[1-9]|1[0-2])[-/.](?:19|20)[0-9]{2}(?![0-9])|(?:19|20)[0-9]{2}[-/. ](?:0?[1-9]|1[0-2])(?![0-9])|(?<![0-9])(?:0?[1-9]|[12][0-9]|3[01])[-/. ](?:0?[1-9]|1[0-2])[-/. ](?:19|20)?[0-9]{2}(?![0-9])"
#: Words of which clean spans are made.
_PLAIN_WORDS = ("store", "noon", "home", "thanks", "please", "bring", "office", "table", "three", "market", "bahnhof", "danke", "maison", "merci", "casa", "gracias", "work", "lunch", "then", "more")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test: every second digit from the right is doubled, with its digits added."""
    last_first = F.reverse(digits)
    at = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substring(last_first, i, F.lit(1))
    total = F.aggregate(at, F.lit(0), lambda s, i: s + F.when(i % 2 == 1, value(i)).otherwise(F.translate(value(i), "0123456789", "0246813579")).cast("int"))
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code passes its check: the first four characters last, letters as 10 to 35, remainder 1 by 97."""
    x = F.regexp_replace(code, " ", "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda r, c: ((r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97).cast("int")
    rest = F.aggregate(F.split(F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4)), ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c)))
    return F.when(x.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{8,31}$"), rest == 1).otherwise(False)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _rule(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


FEATURES = ("chars", "digits", "letters", "separators", "groups", "plus", "at", "dots", "capitals", "luhn", "octets", "cue", "edge", "generator", "mod97", "at_tight", "at_spelled", "dot_tight", "dot_even", "dot_spelled", "last_word", "date", "longest_digits", "parens")


def _features(m: Column, before: Column, after: Column, generator: int) -> list[Column]:
    """Format and context of a candidate, in the order of FEATURES."""
    count = lambda p: F.length(m) - F.length(F.regexp_replace(m, p, ""))
    d = _digits(m)
    passes = F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    return [x.cast("double") for x in (
        F.length(m), F.length(d), count("[A-Za-z]"), count("[ ()/-]"), F.size(F.split(m, "[^0-9A-Za-z]+")), m.startswith("+"), count("@"), count(r"\."), count("[A-Z]"),
        passes, m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), before.rlike(_CUE), after.rlike("^[^0-9A-Za-z]?$") & ~before.rlike("[0-9]$"), F.lit(generator), mod97(m),
        m.rlike(r"[^ ](?:@|[(\[](?i:at)[)\]])[^ ]"), m.rlike(r"(?i)[(\[]at[)\]]"), m.rlike(r"[0-9A-Za-z-]\.[0-9A-Za-z]"), m.rlike(r" \. "), m.rlike(r"(?i)[(\[]dot[)\]]"), F.length(F.regexp_extract(m, "[A-Za-z]+$", 0)), m.rlike(_DATE),
        F.array_max(F.transform(F.split(m, "[^0-9]+"), lambda x: F.length(x))), m.contains("("),
    )]


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with base (array of s, kind, e) and open (array of s, e, features, labelled) added.

    open holds what the generators propose; labelled tells whether a rule's finding overlaps the span.
    """
    found = with_spans(docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))), "text", {f"_{k}": p for k, p in (PATTERNS | GENERATORS).items()}, {f"_{k}": F.col("text").rlike(p) for k, p in _NEEDS.items()})

    def ruled(k: str, i: int) -> Column:
        return F.transform(F.filter(f"_{k}", lambda x: _rule(k, x["m"])), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("kind"), x["e"].alias("e")))

    found = found.withColumn("base", F.array_sort(F.concat(*[ruled(k, i) for i, k in enumerate(KINDS)])))
    text = F.col("text")

    def proposed(k: str, i: int) -> Column:
        before = lambda x: F.substring(text, F.greatest(x["s"] - _BEFORE + 1, F.lit(1)), F.least(x["s"], F.lit(_BEFORE)))
        after = lambda x: F.substring(text, x["e"] + 1, F.lit(1))
        near = lambda x: F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        return F.transform(f"_{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.array(*_features(x["m"], before(x), after(x), i)).alias("f"), near(x).alias("labelled")))

    found = found.withColumn("open", F.concat(*[proposed(k, i) for i, k in enumerate(GENERATORS)]))
    return found.drop(*[f"_{k}" for k in (*PATTERNS, *GENERATORS)])


@dataclass
class SpanModel:
    """Boosted trees as (weight, tree); tree: a leaf's value or (feature, threshold, left, right). Calibration: scale, shift, threshold."""

    trees: list[tuple[float, tuple | float]]
    threshold: float

    def margin(self, f: Column) -> Column:
        def node(t: tuple | float) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(F.element_at(f, t[0] + 1) <= t[1], node(t[2])).otherwise(node(t[3]))

        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + F.lit(weight) * node(tree)
        return total

    @classmethod
    def of(cls, model: GBTClassificationModel, threshold: float) -> SpanModel:
        def read(n) -> tuple | float:
            if n.subtreeDepth() == 0:
                return float(n.prediction())
            s = n.split()
            return (s.featureIndex(), float(s.threshold()), read(n.leftChild()), read(n.rightChild()))

        return cls([(float(w), read(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)], threshold)


def _rewritten(kind: Column, m: Column) -> Column:
    """Array of (v, label): a rule's finding in forms outside the rules, and clean spans of every generator made of its characters:
    mentions of places and prices with @ and at, dates and times, ranges, amounts, and codes with a wrong check."""
    d = F.rpad(_digits(F.concat(m, F.abs(F.xxhash64(m)).cast("string"))), 18, "7")
    part = lambda a, n: F.substring(d, a, n)
    t = F.lit
    cat = lambda *x: F.concat(*[t(y) if isinstance(y, str) else y for y in x])
    group = lambda check, country: cat(country, F.lpad(check.cast("string"), 2, "0"), *[x for i in (1, 5, 9, 13) for x in (" ", part(i, 4))], " ", part(17, 2))
    account = lambda check: group(check, "DE")
    check = F.lit(98) - (F.concat(d, F.lit("131400")).cast("decimal(38,0)") % 97).cast("int")
    french = F.lit(98) - (F.concat(d, F.lit("152700")).cast("decimal(38,0)") % 97).cast("int")
    two = lambda a, most: F.lpad((part(a, 2).cast("int") % most + 1).cast("string"), 2, "0")
    word = lambda k: F.element_at(F.array(*map(t, _PLAIN_WORDS)), (F.pmod(F.xxhash64(m, t(k)), t(len(_PLAIN_WORDS))) + 1).cast("int"))
    plain_mail = cat(word(17), ".", word(18), F.regexp_extract(m, "@.*$", 0))  # without the finding's own digits
    spell = lambda at, dot, of=m: F.replace(F.replace(of, t("@"), t(at)), t("."), t(dot))
    last = F.substring(F.lpad(_digits(m), 10, "5"), -10, 10)
    piece = lambda a, n: F.substring(last, a, n)
    yes, no = (lambda v: F.struct(v.alias("v"), F.lit(1.0).alias("label"))), (lambda v: F.struct(v.alias("v"), F.lit(0.0).alias("label")))
    local = [cat("(", piece(1, 3), ") ", piece(4, 3), "-", piece(7, 4)), cat("0", piece(1, 3), " ", piece(4, 7)), cat(piece(1, 3), "-", piece(4, 3), "-", piece(7, 4)), cat("00", piece(1, 2), " ", piece(3, 3), " ", piece(6, 5)), cat("0", piece(1, 4), "-", piece(5, 6)), cat(piece(1, 3), ".", piece(4, 3), ".", piece(7, 4))]
    date = cat("20", part(1, 2), "-", two(3, 12), "-", two(5, 28))
    day = cat(two(5, 28), "/", two(3, 12), "/20", part(1, 2))
    plain = [
        date, cat(date, " ", part(7, 2)), cat(day, " - ", part(7, 2)), cat(part(1, 2), " ", part(3, 3), ".", part(6, 2)), cat(part(1, 4), "/", part(5, 5)), cat(two(5, 28), ".", two(3, 12), ".20", part(1, 2)), part(1, 8), cat("19", part(1, 2), "-20", part(3, 2)), cat(part(1, 3), "-", part(4, 3)), cat(part(1, 1), ".", part(2, 9)), cat(part(1, 1), " 000 000"), cat(part(1, 2), ".", part(3, 1), ".", part(4, 2), "-", part(6, 2)),
        cat(part(1, 2), " @ ", word(1), ". ", word(2)), cat(word(3), " @ ", word(4), ". ", word(5)), cat(word(6), " (at) ", word(7), ". ", word(8)), cat(word(9), " @ ", part(1, 3), ". ", word(10)), cat(word(11), "@", word(12), ". ", word(13)), cat(word(14), " [at] ", word(15), ". ", word(16)), cat(word(19), part(1, 2), " (at) ", word(20), ". ", word(21)), cat(word(22), ".", word(23), " @ ", word(24), part(3, 2), ". ", word(25)),
        account(check % 97 + 1), cat("AB", part(1, 2), " ", part(3, 4), " ", part(7, 4)), cat("XK", part(1, 2), part(3, 4), "A", part(7, 3)),
    ]
    mail = F.array(*[yes(spell(*x)) for x in ((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" @ ", " . "), (" (at) ", "."), ("[at]", "[dot]"), ("@", " (dot) "), (" (at) ", " (dot) ", plain_mail), (" [at] ", ".", plain_mail), (" @ ", " . ", plain_mail))])
    forms = F.when(kind == KINDS.index("email"), mail).when(kind == KINDS.index("phone"), F.array(*map(yes, local))).otherwise(F.array().cast("array<struct<v:string,label:double>>"))
    return F.concat(forms, F.array(yes(account(check)), yes(group(french, "FR")), *map(no, plain)))


def training_spans(docs: DataFrame, max_spans: int) -> DataFrame:
    """(f, label, h): candidates of rule findings rewritten into other formats (1) and of clean spans (0), in the findings'
    own context; h is the finding's hash. What no rule covers in the documents is not labelled."""
    found = candidates(docs).select("doc_id", "text", F.explode("base").alias("b")).withColumn("h", F.xxhash64("doc_id", "b.s", "b.e"))
    text, s = F.col("text"), F.col("b.s")
    found = found.select("doc_id", "h", F.col("b.kind").alias("kind"), F.substring(text, s + 1, F.col("b.e") - s).alias("m"), F.substring(text, F.greatest(s - _BEFORE + 1, F.lit(1)), F.least(s, F.lit(_BEFORE))).alias("before"), F.substring(text, F.col("b.e") + 1, F.lit(1)).alias("after"))
    found = stored(found.orderBy("h", "m").limit(max_spans), "pii-findings").repartition(4)
    made = found.select("doc_id", "h", "before", "after", F.explode(_rewritten(F.col("kind"), F.col("m"))).alias("x"))
    made = made.select("doc_id", "h", F.length("before").alias("a"), (F.length("before") + F.length("x.v")).alias("z"), F.col("x.label").alias("label"), F.concat("before", "x.v", "after").alias("text"))
    return candidates(made).select("h", "a", "z", "label", F.explode("open").alias("o")).where("not o.labelled and o.s < z and a < o.e").select("o.f", "label", "h")


def fit(docs: DataFrame, max_docs: int = 20_000, max_spans: int = 2000, least: int = 20, precision: float = 0.95) -> SpanModel | None:
    """Train on rewritten findings of the ``max_docs`` documents whose doc_id hashes lowest, ``max_spans`` of either label at most.

    A third of them, by hash, calibrates: the threshold is the lowest margin above which the share of labelled held-out
    candidates is ``precision``, and 0 (even odds) at least. With fewer than ``least`` candidates of a label there is no
    model (None), and the rules stand alone.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    # written first: else the filters of the candidates are evaluated before the join, on all documents
    sample = stored(docs.join(F.broadcast(chosen), "doc_id", "left_semi"), "pii-documents")
    rows = stored(training_spans(sample, max_spans), "pii-candidates")
    rows = rows.where("label = 1").orderBy("h").limit(max_spans).unionByName(rows.where("label = 0").orderBy("h").limit(max_spans))
    rows = stored(rows.coalesce(2), "pii-sample")
    sizes = {(r["label"], r["held"]): r["count"] for r in rows.groupBy("label", (F.pmod("h", F.lit(3)) == 0).alias("held")).count().collect()}
    if min(sizes.get((k, False), 0) for k in (0.0, 1.0)) < least or not all((k, True) in sizes for k in (0.0, 1.0)):
        return None
    wide = rows.select("h", "label", *[F.element_at("f", i + 1).alias(n) for i, n in enumerate(FEATURES)])
    wide = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(wide)
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=12, maxDepth=4, maxBins=32, stepSize=0.3, seed=11).fit(wide.where("pmod(h, 3) <> 0"))
    found = SpanModel.of(model, 0.0)
    held = rows.where("pmod(h, 3) = 0").select("label", found.margin(F.col("f")).alias("margin")).groupBy("margin").agg(F.sum("label").alias("yes"), F.count("*").alias("n")).orderBy(F.desc("margin")).collect()
    yes = n = 0
    threshold = float("inf")
    for r in held:  # held-out margins: bounded by max_spans
        yes, n = yes + r["yes"], n + r["n"]
        if yes >= precision * n:
            threshold = float(r["margin"])
    found.threshold = max(threshold, 0.0)
    return found


def _apart(spans: Column) -> Column:
    """Of sorted spans (s, e, p) those that stay: a span that overlaps the last one replaces it if its score is higher (if equal, if it is longer)."""
    last = lambda acc: F.element_at(acc, -1)
    better = lambda acc, x: (x["p"] > last(acc)["p"]) | ((x["p"] == last(acc)["p"]) & (x["e"] - x["s"] > last(acc)["e"] - last(acc)["s"]))
    step = lambda acc, x: F.when((F.size(acc) == 0), F.array(x)).when(x["s"] >= last(acc)["e"], F.concat(acc, F.array(x))).when(better(acc, x), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x))).otherwise(acc)
    return F.aggregate(spans, F.array().cast("array<struct<s:int,e:int,p:double>>"), step)


def find(docs: DataFrame, model: SpanModel | None) -> DataFrame:
    """doc_id, text, base and spans (arrays of s, kind, e) for every row of (doc_id, text).

    spans holds base and what the model adds, which never overlaps a rule's finding; of added spans that overlap, one after the other in
    the text, the one with the highest score stays (of equal scores the longer). A null text is
    empty; rows keep their number, repeated ones too, and do not depend on one another; texts of any length are searched whole; an
    empty table gives an empty result; other columns are not read.
    """
    found = candidates(docs.select(F.col("doc_id").cast("long"), "text"))
    added = F.array().cast("array<struct<s:int,kind:int,e:int>>")
    if model is not None:
        scored = F.transform(F.filter("open", lambda x: ~x["labelled"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), model.margin(x["f"]).alias("p")))
        taken = F.array_sort(F.filter(scored, lambda x: x["p"] >= model.threshold))
        added = F.transform(_apart(taken), lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("kind"), x["e"].alias("e")))
    return found.withColumn("spans", F.array_sort(F.concat("base", added))).select("doc_id", "text", "base", "spans")


def shown(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, ADDED)])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(found: DataFrame) -> DataFrame:
    """doc_id and text of ``find()``'s rows with every span replaced by its kind in brackets; what overlaps is one."""
    names = F.array(*[F.lit(k) for k in (*KINDS, ADDED)])
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = lambda acc, x: F.when(x["e"] <= acc["at"], acc).otherwise(F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), F.when(x["s"] >= acc["at"], F.concat(F.lit("["), F.element_at(names, x["kind"] + 1), F.lit("]"))).otherwise("")).alias("out")))
    done = F.aggregate("spans", first, cut)
    return found.withColumn("_d", done).select("doc_id", F.concat("_d.out", F.substring(F.col("text"), F.col("_d.at") + 1, F.length("text"))).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find(docs, fit(docs))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")

    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(shown("base").cast("binary"), 256).alias("base_sha256"), shown("spans").alias("spans"))
