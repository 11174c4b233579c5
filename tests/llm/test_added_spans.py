"""What the learned methods must add to the rules: addresses, accounts and keys in forms that no rule names."""

import base64
import hashlib

import numpy as np

from tenderloom.llm import pii, secret_scan

WORDS = "the board met to review plans for river harbour bridge and market street houses while workers waited outside".split()


def _say(r, n=12):
    return " ".join(r.choice(WORDS, n))


def test_obfuscated_data_is_added(spark):
    r = np.random.default_rng(1)
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    rows = [(i, f"{_say(r)} mail {r.choice(WORDS)}{d(2)}@{r.choice(WORDS)}.com {_say(r)} call +1 ({d(3)}) {d(3)}-{d(4)} {_say(r)}") for i in range(150)]
    new = {900: "john (at) example (dot) com", 901: "DE89 3704 0044 0532 0130 00", 902: "(743) 555-3824"}
    rows += [(i, f"please write to {x} soon") for i, x in new.items()] + [(990, "on 2024-03-15 the board paid 12 345.67")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs).where("doc_id >= 900").collect()}
    for i, x in new.items():
        assert f"gbt:16:{16 + len(x)}" in got[i], (i, got)
    assert got[990] == ""


def test_keys_outside_the_rules_are_added(spark):
    r = np.random.default_rng(2)
    key = lambda n: base64.b64encode(r.bytes(n)).decode().rstrip("=")
    rows = [(i, f"{_say(r)} password={key(15)} {_say(r)} {hashlib.md5(r.bytes(4)).hexdigest()} {_say(r)}") for i in range(150)]
    new = {900: f"ghp_{key(27)}", 901: key(30), 902: hashlib.sha256(b"x").hexdigest().upper()}
    rows += [(i, f"please login with {x} soon") for i, x in new.items()] + [(990, "see /market/harbour/bridge.html and river_board_12")]
    got = {r.doc_id: r.spans for r in secret_scan.secrets_report(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 900").collect()}
    for i, x in new.items():
        assert got[i] == f"cnn:18:{18 + len(x)}", (i, got)
    assert got[990] == ""


def test_personal_data_in_forms_held_out_whole(spark):
    """Forms that training does not make: nine of ten of each are found whole, prose with @, at, dates and amounts is left alone, and
    no two added spans overlap."""
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    r = np.random.default_rng(3)
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    w = lambda: str(r.choice(WORDS))

    def iban(country, body):
        number = "".join(str(int(c, 36)) for c in body + country + "00")
        code = f"{country}{98 - int(number) % 97:02}{body}"
        return " ".join(code[k : k + 4] for k in range(0, len(code), 4))

    forms = {
        "no blanks": lambda: f"{w()}.{w()}(at){w()}.org", "capitals": lambda: f"{w().upper()} (AT) {w().upper()} (DOT) COM", "two dots": lambda: f"{w()}{d(2)} [at] mail.{w()}.net", "british": lambda: iban("GB", f"NWBK{d(14)}"), "spanish": lambda: iban("ES", d(20)),
        "slashed phone": lambda: f"0{d(3)}/{d(3)} {d(4)}", "spaced phone": lambda: f"0{d(3)} {d(3)} {d(4)}", "area in brackets": lambda: f"(0{d(3)}) {d(7)}",
    }
    prose = [
        lambda: f"meet us @ {w()}. bring", lambda: f"{d(2)} @ {w()}. thanks", lambda: f"anna (at) {w()}. please", lambda: f"on 2024-{r.integers(10, 13)}-{r.integers(10, 29)} {d(2)}", lambda: f"from 1{d(2)}-1{d(2)} / 2{d(2)}", lambda: f"in {r.integers(1, 13):02}/2023 - 01/2024", lambda: f"about 3.{d(8)} of it", lambda: f"some {r.integers(1, 9)} 500 000 of them",
        lambda: f"version {r.integers(1, 9)}.{d(1)}.{d(2)}-{d(2)}", lambda: f"by {w()} @ {w()}, and", lambda: f"the years 1998-2004 and {w()}", lambda: f"part AB{d(2)} {d(4)} {d(4)} of it",
    ]
    rows, want = [], {}
    for name, make in forms.items():
        for _ in range(40):
            x = make()
            want[len(rows)] = (name, f"gbt:16:{16 + len(x)}")
            rows.append((len(rows), f"please write to {x} soon, {w()}"))
    first = len(rows)
    rows += [(first + k, f"so {make()} {w()}") for k, make in enumerate(prose * 30)]
    got = {x.doc_id: x.spans for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), model).select("doc_id", pii.shown("spans").alias("spans")).collect()}
    share = {name: np.mean([want[i][1] == got[i] for i in want if want[i][0] == name]) for name in forms}
    assert min(share.values()) >= 0.9, {k: float(v) for k, v in share.items()}
    taken = [(rows[i][1], got[i]) for i in range(first, len(rows)) if got[i]]
    assert len(taken) <= 0.02 * (len(rows) - first), taken[:10]
    assert all(got[i].count("gbt") <= 1 for i in got)


def _secret_forms(r):
    run = lambda alphabet, n: "".join(r.choice(list(alphabet), n))
    low, any_, digits = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789"
    b64 = lambda text: base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")
    jwt = lambda: f"{b64('{\"alg\":\"HS256\",\"typ\":\"JWT\"}')}.{b64('{\"sub\":\"' + run(digits, 10) + '\"}')}.{run(any_ + '-_', 43)}"
    return {
        "code host": lambda: "ghp_" + run(any_, 36), "chat": lambda: f"xoxb-{run(digits, 11)}-{run(digits, 12)}-{run(any_, 24)}", "web token": jwt, "maps": lambda: "AIza" + run(any_ + "-_", 35), "payments": lambda: "sk_live_" + run(any_, 24), "packages": lambda: "npm_" + run(any_, 36),
        "mail": lambda: f"SG.{run(any_ + '-_', 22)}.{run(any_ + '-_', 43)}", "cloud": lambda: run(any_ + "+/", 40), "upper hex": lambda: run(digits + "ABCDEF", 64), "words and digits": lambda: run(low, 4) + run(any_, 30),
    }


def _clean_forms(r):
    w = lambda: str(r.choice(WORDS))
    n = lambda most: int(r.integers(most))
    return [
        lambda: f"{w()}{w().title()}{w().title()}Id", lambda: f"{w()}_{w()}_{w()}_{n(2000)}", lambda: f"2024-{n(12) + 1:02}-{n(28) + 1:02}T{n(24):02}:00", lambda: f"/usr/{w()}/{w()}{n(9)}/{w()}.conf", lambda: f"{w()}.example.org/{w()}/{n(10**5)}", lambda: f"{w()}-{w()}-1.{n(20)}.{n(9)}-beta",
        lambda: f"0{n(10**9):09}-{n(99)}", lambda: f"978-0-{n(10**3):03}-{n(10**5):05}-{n(10)}", lambda: f"10.1{n(999):03}/{w()}.2020.{n(10**6)}", lambda: f"ORD-{n(10**8):08}", lambda: f"MAX_{w().upper()}_{w().upper()}_{n(99)}",
    ]


def test_recall_of_forms_held_out_whole(spark):
    """Issuers' forms of keys, none of them made in training: nine of ten of each are found, and hardly a clean form is taken."""
    net = secret_scan.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    r = np.random.default_rng(7)

    def share(make, times):
        pictures = []
        for _ in range(times):
            before, key = _say(r, 6) + " ", make()
            text = f"{before}{key} {_say(r, 3)}"
            spans = [x for x in secret_scan.candidates(text) if x[0] < len(before) + len(key) and x[1] > len(before)]
            pictures += [secret_scan.picture(text, *spans[0])] if spans else []
        return (net.probability(pictures) >= net.threshold).sum() / times if pictures else 0.0

    found = {name: share(make, 200) for name, make in _secret_forms(r).items()}
    assert min(found.values()) >= 0.9, found
    assert np.mean([share(make, 100) for make in _clean_forms(r)]) <= 0.02


def test_secrets_of_every_document_train(spark):
    """Findings in 40 of 30,000 documents, those whose doc_id hashes highest: no document is left out of the training, and tables dealt otherwise give the same network."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    ids = [x.id for x in spark.range(30_000).orderBy(F.xxhash64("id").desc()).limit(40).collect()]
    texts = [f"{_say(r)} password={base64.b64encode(r.bytes(15)).decode()} {_say(r)} {hashlib.md5(r.bytes(4)).hexdigest()} {_say(r)}" for _ in ids]
    docs = spark.range(30_000).join(F.broadcast(spark.createDataFrame(list(zip(ids, texts, strict=True)), "id long, found string")), "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("found", F.lit("ab")).alias("text"))
    net, again = secret_scan.fit(docs), secret_scan.fit(docs.repartition(7))
    assert net is not None
    assert np.abs(net.flat() - again.flat()).max() < 1e-6 and abs(net.threshold - again.threshold) < 1e-6


def test_pictures_dealt_over_rounds(spark, monkeypatch):
    """Many pictures: every one is in the training of one round; few: in that of each."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    class Counting(secret_scan.CharNet):
        def train(self, pictures, *args, **kwargs):
            seen.add(len(pictures))

    rows = spark.range(5000).select(F.xxhash64("id").alias("h"), F.encode(F.lpad(F.col("id").cast("string"), 40, "x"), "utf-8").alias("picture"), (F.col("id") % 9 == 0).alias("secret"))
    monkeypatch.setattr(secret_scan, "CharNet", Counting)
    monkeypatch.setattr(secret_scan, "_GROUP", 500)
    secret_scan._trained(rows, 5000, (1.0, 1.0))
    assert seen.value == 20_000
    monkeypatch.setattr(secret_scan, "_FEW", 1000)
    secret_scan._trained(rows, 5000, (1.0, 1.0))
    assert seen.value == 25_000


def test_kth_value(spark):
    x = np.concatenate([np.random.default_rng(4).normal(0, 5, 3000), np.full(50, 1.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for k in (0, 7, 1500, len(x) - 1):
        assert secret_scan.kth(df, "x", k) == np.sort(x)[k]
