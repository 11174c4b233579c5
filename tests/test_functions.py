"""Scalar functions and small operators on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tenderloom.functions import profiles as P
from tenderloom.functions import text as T
from tenderloom.functions import values as V
from tenderloom.functions.chunks import split_text
from tenderloom.operators import matching as M
from tenderloom.operators import results as R
from tenderloom.operators import retrieval as Q
from tenderloom.operators import tables as K
from tenderloom.operators.slugs import unique_slugs
from tenderloom.sources import feeds as S
from tenderloom.sources import html as H
from tenderloom.sources import portals as L


def now():
    return F.lit("2026-02-01 00:00:00").cast("timestamp")


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize("raw, shown", [("a &amp;lt; b", "a < b"), ("&#233;&#x41;&nbsp;", "éA "), ("&#128512;x", "x"), (None, ""), ("&quot;&#39;&apos;", "\"''")])
def test_entities(spark, raw, shown):
    assert one(spark, T.decode_entities(F.col("x").cast("string")), x=raw) == shown


def test_html(spark):
    assert one(spark, T.strip_tags(F.col("x")), x="<p>a  <b>b</b></p>") == "a b"
    assert one(spark, T.html_to_text(F.col("x")), x="<div>a</div><p class='x'>b<br/>c</p>\n\n\n\nd &ndash;") == "a\n\nb\nc\n\nd –"
    assert one(spark, T.first_link(F.col("x")), x="<a HREF='/t/1'>x</a>") == "/t/1"
    assert one(spark, T.absolutize(F.col("x"), "https://h.org/"), x="t/1") == "https://h.org/t/1"
    assert one(spark, T.pick_field(F.col("x"), [r"Nope[^<]*<[^>]*>([^<]+)", r"Value[^<]*<[^>]*>\s*([^<]+)"]), x="<b>Value</b> 7 &amp; 8<i>") == "7 & 8"
    assert one(spark, T.slugify(F.col("x")), x="  Ümlaut & Söhne -- Ltd. ") == "mlaut-s-hne-ltd"
    assert one(spark, T.slugify(F.col("x")), x="!!!") == "tenant"


@pytest.mark.parametrize("amount, currency, rate, usd", [(2.5, "USD", None, 3), (-2.5, "USD", None, -2), (100.0, "gbp", None, 127), (1.0, "ZZZ", None, None), (1.0, "ZZZ", 4.0, 4), (1e12, "EUR", None, 2147483647), (float("nan"), "USD", None, None), (None, "USD", None, None), (5.0, None, None, None)])
def test_usd(spark, amount, currency, rate, usd):
    cols = spark.range(1).select(F.lit(amount).cast("double").alias("a"), F.lit(currency).cast("string").alias("c"), F.lit(rate).cast("double").alias("r"))
    assert cols.select(V.to_usd(F.col("a"), F.col("c"), F.col("r"))).first()[0] == usd


@pytest.mark.parametrize("portal, text, at", [
    ("loose", "Jan 5, 2026 2:30 PM", (2026, 1, 5, 14, 30)), ("loose", "5th March 2026", (2026, 3, 5)), ("loose", "2026-01-05T10:20:00Z", (2026, 1, 5, 10, 20)), ("ppra", "Jan 5, 2026 2:30 AM", (2026, 1, 4, 21, 30)),
    ("punjab", "05/01/2026", (2026, 1, 4, 19)), ("austender", "5-Jan-2026 2:00 pm", (2026, 1, 5, 4)), ("gem", "05-Jan-2026", (2026, 1, 4, 18, 30)), ("ungm", "05-Jan-2026 10:00 (GMT 5.30)", (2026, 1, 5, 4, 42)), ("jica", "2026/02/30", None), ("iadb", "Feb. 3 2026", (2026, 2, 3)), ("iso", "soon", None),
])
def test_dates(spark, portal, text, at):
    got = one(spark, V.parse_date(F.col("x"), portal), x=text)
    assert got == (None if at is None else dt.datetime(*at))


def test_cell_helpers(spark):
    days = F.array(*[F.to_timestamp(F.lit(x)) for x in ("2026-01-03", "2026-01-01")], F.lit(None).cast("timestamp"))
    a, b = V.min_max_dates(days)
    assert one(spark, F.struct(a, b), x=1) == (dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 3))
    assert one(spark, T.longest(F.split("x", ","), lambda p: F.length(p) > 2), x="ab,four,five,xyz") == "four"
    c, s = T.country_and_subject(F.col("x"))
    assert one(spark, F.struct(c, s), x="Kenya: Roads: north") == ("Kenya", "Roads: north")


def test_keywords_and_query(spark):
    terms = P.profile_keywords(F.array(F.lit("custom software dev")), F.array(F.lit("TypeScript"), F.lit(" AWS ")), F.array(F.lit("ISO 27001")), F.array(F.lit("fintech"), F.lit("")))
    assert one(spark, terms, x=1) == ["custom software dev", "TypeScript", "AWS", "ISO 27001", "fintech"]
    assert one(spark, P.build_query(terms), x=1) == '"custom software dev" OR TypeScript OR AWS OR "ISO 27001" OR fintech'
    assert one(spark, P.build_query(F.array().cast("array<string>")), x=1) == ""


def test_chunks():
    assert split_text("  \n") == [] and split_text(None) == []
    assert split_text("abc", 250) == [("abc", 0, 3)]
    text = "\n\n".join(["word " * 20] * 6)
    parts = split_text(text, 250, 0)
    assert len(parts) >= 2 and all(text[a:b] == t for t, a, b in parts)
    two = split_text(("x" * 393 + ". ") * 2, 500, 100)
    assert len(two) == 2 and two[0][2] - two[1][1] >= 50
    long = split_text("x" * 2500, 500, 0)
    assert len(long) >= 5 and all(len(t) <= 500 for t, _, _ in long)


def restated(text, target, overlap):
    """Chunks by recursion: cut at the first separator that the piece has, pack, then reach back into the chunk before."""

    def cut(a, b):
        if b - a <= target:
            return [(a, b)] if b > a else []
        for sep in ("\n\n", "\n", ". ", " "):
            if sep in text[a:b]:
                out, at = [], a
                while (k := text.find(sep, at, b)) >= 0:
                    out += cut(at, k)
                    at = k + len(sep)
                return out + cut(at, b)
        return [(k, min(k + target, b)) for k in range(a, b, target)]

    if not text.strip():
        return []
    if len(text) <= target:
        return [(text, 0, len(text))]
    chunks = []
    for a, b in cut(0, len(text)):
        if chunks and (chunks[-1][1] - chunks[-1][0]) + (b - a) <= target:
            chunks[-1] = (chunks[-1][0], b)
        else:
            chunks.append((a, b))
    if not chunks:  # separators alone
        return []
    starts = [chunks[0][0], *(max(p[0], p[1] - overlap) if overlap else c[0] for p, c in zip(chunks, chunks[1:], strict=False))]
    return [(text[s:b], s, b) for s, (_, b) in zip(starts, chunks, strict=True)]


@pytest.mark.parametrize("target, overlap", [(1500, 200), (250, 40), (60, 0)])
def test_chunks_as_restated(target, overlap):
    import pyarrow.parquet as pq

    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist():
        assert split_text(text, target, overlap) == restated(text or "", target, overlap)


def test_pooling(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0], 3.0), (1, [0.0, 1.0, 0.0], 1.0), (2, [2.0, 4.0, 6.0], 0.0), (2, [4.0, 6.0, 8.0], 0.0)], "id int, v array<double>, w double")
    assert {r.id: r.v for r in Q.mean_pool(rows, "id", "v", "w").collect()} == {1: [0.75, 0.25, 0.0], 2: [3.0, 5.0, 7.0]}
    bad = spark.createDataFrame([(1, [1.0], 1.0), (1, [1.0, 2.0], 1.0)], rows.schema)
    with pytest.raises(Exception, match="different lengths"):
        Q.mean_pool(bad, "id", "v", "w").collect()


def test_pooling_of_groups_over_batches(spark):
    rows = spark.range(400).selectExpr("cast(id % 3 as string) k", "array(cast(id as float), 1f) v", "id % 5 w").repartition(7)
    want = {str(k): [sum(i * (i % 5) for i in range(400) if i % 3 == k) / sum(i % 5 for i in range(400) if i % 3 == k), 1.0] for k in range(3)}
    assert {r.k: [round(x, 9) for x in r.v] for r in Q.mean_pool(rows, "k", "v", "w").collect()} == {k: [round(x, 9) for x in v] for k, v in want.items()}
    with pytest.raises(Exception, match="negative weight"):
        Q.mean_pool(rows.selectExpr("k", "v", "-1 w"), "k", "v", "w").collect()


def test_fusion(spark):
    dense = spark.createDataFrame([(1, 1, 0.1, 1), (1, 2, 0.2, 2), (1, 3, 0.3, 3)], "tenant_id int, tender_id int, distance double, pos int")
    text = spark.createDataFrame([(1, 2, 0.9, 1), (1, 4, 0.7, 2)], "tenant_id int, tender_id int, rank double, pos int")
    got = {r.tender_id: r for r in Q.rrf_fuse(dense, text).collect()}
    assert got[2].score == pytest.approx(1 / 62 + 1 / 61) and got[2].sources == ["dense", "text"] and got[2].pos == 1
    assert got[1].text_rank is None and got[4].dense_similarity is None and got[1].dense_similarity == pytest.approx(0.9)
    assert Q.rrf_fuse(dense.limit(0), text.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Q.rrf_fuse(dense, text, k=0)


def test_confusion(spark):
    rows = spark.createDataFrame([(85, True, "sam_gov"), (72, True, "sam_gov"), (80, False, "ted_eu"), (30, True, "ppra_pk"), (20, False, "ppra_pk"), (10, False, None)], "predicted int, label boolean, `group` string")
    got = {(r.threshold, r.group): r for r in R.eval_metrics(R.confusion(rows, (0, 60, 101))).collect()}
    r = got[60, None]
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 2) and r.precision == pytest.approx(2 / 3) and r.f1 == pytest.approx(2 / 3) and r.agreement == pytest.approx(4 / 6)
    assert got[101, None].precision == 0 and got[0, None].recall == 1 and (60, "(ungrouped)") in got
    empty = R.confusion(rows.limit(0), (40, 60)).collect()
    assert {(x.threshold, x.group, x.total) for x in empty} == {(40, None, 0), (60, None, 0)}


PROFILE = "geographies array<string>, ignore_location boolean, profile_min int, profile_max int, team_size int, industries array<string>, project_sectors array<string>, country string, sector string, budget_min int, budget_max int, wins array<struct<sector:string,country:string>>"


@pytest.mark.parametrize("row, level, score", [
    ((["pk"], False, 0, 10, 10, ["IT"], ["it"], "PK", "it services", 5, 15, [("IT Services", "PK")]), "high", 12),
    (([], False, 0, 0, 2, [], [], None, None, None, None, None), "medium", 1),
    ((["PK"], False, 1, 5, 2, [], [], "DE", "", None, 2_000_000, []), "low", -7),
    ((["PK"], True, 5, 9, 25, [], [], "DE", "roads", 1, None, [("x", "DE")]), "low", -1),
])
def test_win_probability(spark, row, level, score):
    df = spark.createDataFrame([row], PROFILE)
    got = df.select(*[c.alias(n) for c, n in zip(M.win_probability({c: F.col(c) for c in df.columns}), ("l", "s", "r"), strict=True)]).first()
    assert (got.l, got.s) == (level, score) and got.r.startswith(f"{level.upper()} (score={score}): ")


def schedule(**k):
    base = {"tenant_id": 1, "frequency": "daily", "interval_days": 2, "hour_local": 8, "hour_local_end": 10, "day_of_week": None, "day_of_month": None, "timezone": "UTC", "enabled": True, "last_sent_at": None}
    return tuple((base | k).values())


@pytest.mark.parametrize("now, k, due", [
    ("2026-02-02 10:59:00", {}, True), ("2026-02-02 11:00:00", {}, False), ("2026-02-01 09:00:00", {"frequency": "weekdays"}, False), ("2026-02-28 09:00:00", {"frequency": "monthly", "day_of_month": 31}, True),
    ("2026-02-02 09:00:00", {"frequency": "monthly"}, False), ("2026-02-02 09:00:00", {"frequency": "weekly", "day_of_week": 1}, True), ("2026-02-02 09:00:00", {"last_sent_at": dt.datetime(2026, 2, 2, 8)}, False),
    ("2026-02-04 08:00:00", {"frequency": "every_n_days", "last_sent_at": dt.datetime(2026, 2, 2, 8, 29)}, True), ("2026-02-02 04:00:00", {"timezone": "Asia/Karachi"}, True), ("2026-02-02 09:00:00", {"timezone": "Mars/Base"}, False), ("2026-02-02 09:00:00", {"timezone": ""}, True), ("2026-02-02 09:00:00", {"enabled": False}, False),
])
def test_due(spark, now, k, due):
    names = "tenant_id int, frequency string, interval_days int, hour_local int, hour_local_end int, day_of_week int, day_of_month int, timezone string, enabled boolean, last_sent_at timestamp"
    zones = spark.createDataFrame([("UTC",), ("Asia/Karachi",)], "timezone string")
    assert R.is_due(spark.createDataFrame([schedule(**k)], names), zones, F.lit(now).cast("timestamp")).count() == int(due)


def payload(spark, text):
    return spark.createDataFrame([(0, text)], "page int, payload string")


def test_feeds(spark):
    sam = S.read_sam(payload(spark, '{"opportunitiesData":[{"noticeId":"abc123","title":"T","postedDate":"2026-01-05","award":{"amount":"1500000"}}]}'), now()).first()
    assert (sam.external_id, sam.country, sam.budget_max_usd) == ("abc123", "US", 1500000)
    ted = '{"notices":[{"publication-number":"1-2026","title":{"fra":"f","eng":"e"},"buyer-name":["B"],"buyer-country":"BEL","classification-cpv":["72000000","72200000"],"estimated-value-lot":{"amount":2000000,"currency":"EUR"},"publication-date":"2026-01-05+01:00"}]}'
    r = S.read_ted(payload(spark, ted), now()).first()
    assert (r.title, r.buyer, r.country, r.cpv_codes, r.budget_max_usd) == ("e", "B", "BE", ["72000000", "72200000"], 2160000)
    rss = "<rss><channel><item><title><![CDATA[A &amp; B]]></title><link>https://x.org/1</link><pubDate>d</pubDate><guid>g</guid></item><entry><title>E</title><link href='/2'/><updated>u</updated><id>i</id></entry></channel></rss>"
    items = S.read_feed_items(payload(spark, rss)).orderBy("pos").collect()
    assert [(i.title, i.link, i.published, i.guid) for i in items] == [("A & B", "https://x.org/1", "d", "g"), ("E", "/2", "u", "i")]


def test_pages(spark):
    html = "<h4>one</h4>x<h4>two</h4>y<a href=\"/t/1\">First <b>one</b></a>zz<a href=\"/t/1\">Again</a><a href=\"/u\"></a>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [(r.capture, r.body[:1]) for r in H.split_blocks(pages, "<h4>([^<]*)</h4>").orderBy("block").collect()] == [("one", "x"), ("two", "y")]
    found = H.first_of_page(H.extract_anchor_blocks(pages, before=1, after=2), "href").collect()
    assert [(r.href, r.title, r.context[0], r.context[-2:]) for r in found] == [("/t/1", "First one", "y", "zz")]


def test_schedules_and_profiles(spark):
    bad = spark.createDataFrame([("weekly", 1, 9, 8, None, None, ["x@y.org", "no"])], "frequency string, interval_days int, hour_local int, hour_local_end int, day_of_week int, day_of_month int, recipients array<string>")
    assert K.validate_schedules(bad)[1].first().failed == ["recipients[1]", "hour_local_end", "day_of_week"]
    p = spark.createDataFrame([(None, None, None, None)], "languages array<string>, industries array<string>, team_size int, ignore_location boolean")
    assert tuple(K.profile_defaults(p).first()) == (["en"], [], 0, False)


def test_upsert_is_idempotent(spark):
    now = F.lit("2026-01-01").cast("timestamp")
    empty = spark.createDataFrame([], "k int, v int, n int, embedding_status string, ingested_at timestamp")
    batch = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], "k int, v int, n int")
    once = K.upsert(empty, batch, ["k"], ["v", "n"], ["n"], now).drop("change")
    again = K.upsert(once, batch, ["k"], ["v", "n"], ["n"], now)
    assert {(r.k, r.v, r.embedding_status, r.change) for r in again.collect()} == {(1, 11, "pending", "updated"), (2, 20, "pending", "updated")}


def test_latest_and_profiles(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, None)], "k int, at int, note string")
    assert {(r.k, r.at, r.note) for r in K.latest(rows, "k", "at").collect()} == {(1, 7, "b"), (2, 1, None)}
    current = spark.createDataFrame([(1, "x", "ready"), (2, "y", "ready")], "tenant_id int, one_liner string, embedding_status string")
    new = spark.createDataFrame([(1, "z")], "tenant_id int, one_liner string")
    assert {tuple(r) for r in K.save_profile(current, new).collect()} == {(1, "z", "pending"), (2, "y", "ready")}


def test_titles_and_places_of_anchors(spark):
    """Every portal has its own least title and navigation words; a notice is known by its own id, its window has both sides."""
    page = '<a href="/en/documents/a">Procurement</a><a href="/en/documents/b">Roads</a><a href="/en/documents/c">Road works</a><a href="/agreements/RM1?x=1">Abc</a><a href="/agreements/RM1">Abcd</a><a href="/agreements/RM2">Ab</a>'
    pages = spark.createDataFrame([(1, page), (2, page), (3, None)], "page_id long, html string")
    assert sorted((r.page_id, r.title, r.external_id) for r in L.listing_items(pages, "afdb").collect()) == [(i, "Road works", "https://www.afdb.org/en/documents/c") for i in (1, 2)]
    assert sorted((r.page_id, r.title, r.external_id) for r in L.listing_items(pages, "gca_uk").collect()) == [(i, "Abc", "RM1") for i in (1, 2)]
    assert all(L.listing_items(pages.where("page_id = 3"), s).count() == 0 for s in ("afdb", "ebrd", "ungm", "sop_pk"))


def test_fallbacks_of_listings(spark):
    row = "<table><tr>" + "".join(f"<td>{x}</td>" for x in ("7", "Supply of water pumps", "none", "n/a", "x")) + "</tr></table>"
    r = L.read_listing(spark.createDataFrame([(1, row)], "page_id long, html string"), "ppra_punjab", now()).first()
    assert (r.external_id, r.buyer, r.url, r.deadline_at, r.description) == ("ppra-punjab-Supply-of-water-pumps-nodeadline", "none", "https://eproc.punjab.gov.pk/ActiveTenders.aspx", None, "Supply of water pumps")
    few = "<tr><td><a href='x'></a><a href=\"/delta/viewNotice.html?displayNoticeId=5\">Road works</a></td><td>Request for Proposals</td><td>N/A</td><td>05/01/2026</td><td>N/A</td><td>OPEN</td></tr>"
    r = L.read_listing(spark.createDataFrame([(1, few)], "page_id long, html string"), "ebrd", now()).first()
    assert (r.buyer, r.country, r.description, r.deadline_at, r.url) == ("EBRD", None, "Request for Proposals", None, "https://ecepp.ebrd.com/delta/delta/viewNotice.html?displayNoticeId=5")


@pytest.mark.parametrize("url, at", [("a.pdf", "https://h.org/p/a.pdf"), ("./a.pdf", "https://h.org/p/a.pdf"), ("/a", "https://h.org/a"), ("//k.org/a", "https://k.org/a"), ("?q=1", "https://h.org/p/q?q=1"), ("mailto:x@y", "mailto:x@y"), ("HTTP://k.org", "HTTP://k.org")])
def test_links(spark, url, at):
    assert one(spark, T.absolutize(F.col("x"), "https://h.org/p/q"), x=url) == at


def test_long_entities(spark):
    assert one(spark, T.decode_entities(F.col("x")), x="&#0000000000065;&#x00000000000042;&#4294967361;") == "ABA"


def test_slugs_are_unique(spark):
    """The rule row by row: the first of base, base-2, base-3 ... that nobody has."""
    bases = ["a", "a", "a-2", "b", "a-2", "a", "a-3", "tenant", "tenant", "tenant", "b-7", "c", "a-2-2", "a", "c", "b"] + ["x"] * 30
    taken = {"b", "b-3", "tenant-2"}
    used, want = set(taken), []
    for base in bases:
        k, name = 1, base
        while name in used:
            k += 1
            name = f"{base}-{k}"
        used.add(name)
        want.append(name)
    rows = spark.createDataFrame(list(enumerate(bases)), "id int, slug string").repartition(3)
    got = unique_slugs(rows, "slug", ["id"], spark.createDataFrame([(x,) for x in taken], "slug string")).collect()
    assert [r.unique_slug for r in sorted(got, key=lambda r: r.id)] == want
    assert {r.unique_slug for r in unique_slugs(rows.where("id < 2"), "slug", ["id"]).collect()} == {"a", "a-2"}


def test_tenants_of_an_address(spark):
    users = spark.createDataFrame([("A@x.org", 2), ("a@x.org", 1), ("b@x.org", 3)], "email string, tenant_id int")
    tenants = spark.createDataFrame([(1, 5), (2, 4), (3, 3)], "tenant_id int, created_at int")
    profiles = spark.createDataFrame([(1,), (1,)], "tenant_id int")
    assert [(r.tenant_id, r.has_profile) for r in K.owned_tenants(users, tenants, profiles, "a@X.org").collect()] == [(2, False), (1, True)]


def test_failing_pairs_cost_only_themselves(spark):
    def score(pairs):
        if (pairs.tender_id % 7 == 0).any():
            raise ValueError("no")
        return pairs.tender_id * 2.0

    rows = M.score_pairs(spark.range(50).selectExpr("1L tenant_id", "id tender_id").coalesce(1), score).collect()
    assert {r.tender_id for r in rows if r.error} == set(range(0, 50, 7)) and all(r.score == 2 * r.tender_id for r in rows if not r.error)


def test_failing_pairs_need_few_calls(spark):
    """One pair in a hundred fails: some eleven calls for each (halving both sides took fifteen), one batch out for one in, scores by their index."""
    calls = spark.sparkContext.accumulator(0)

    def score(pairs):
        calls.add(1)
        if (pairs.tender_id % 101 == 0).any():
            raise ValueError(f"no {pairs.tender_id.iloc[0]}")
        return (pairs.tender_id * 2)[::-1]

    scored = M.score_pairs(spark.range(0, 40_000, 1, 1).selectExpr("1L tenant_id", "id tender_id"), score).coalesce(1)
    rows = scored.collect()
    bad = set(range(0, 40_000, 101))
    assert {(r.tender_id, r.error) for r in rows if r.error} == {(i, f"no {i}") for i in bad} and len(rows) == 40_000
    assert all(r.score == 2 * r.tender_id for r in rows if not r.error)
    assert calls.value < 12 * len(bad), calls.value


def test_results_by_partition(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    K.write_results(spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string"), path, ["k"])
    K.write_results(spark.createDataFrame([(3, "b")], "x int, k string"), path, ["k"])
    assert {(r.x, r.k) for r in spark.read.parquet(path).collect()} == {(1, "a"), (3, "b")}


def test_sources(spark):
    catalog = spark.createDataFrame([("a", "available", None), ("b", "available", "no key"), ("c", "planned", None)], "source string, availability string, unavailable_reason string")
    assert {r.source for r in K.select_sources(catalog, " b, x,b ").collect()} == {"b"} and K.select_sources(catalog, "").count() == 3 and K.select_sources(catalog, "", filtered=True).count() == 0
    assert {r.source for r in K.enabled_sources(catalog).collect()} == {"a"}


def test_chunks_of_whole_columns():
    """Many texts at once, of any separators and scripts, in slices of any size: each as alone, and as restated."""
    import numpy as np
    import pyarrow as pa

    from tenderloom.functions import chunks

    r = np.random.default_rng(4)
    parts = ["word ", "é", "\n", "\n\n", "\n\n\n", ". ", ".", " ", "xxxxxxxxxxxxxxxxxxxx", "日本", "\U0001f600", " ", "\t"]
    texts = ["".join(r.choice(parts, int(r.integers(0, 400)), p=r.dirichlet(np.full(len(parts), 0.5)))) for _ in range(150)] + [None, "", " \n", "\n" * 700, "." * 300, ". " * 300, "a" * 49 + "\n\n\n" + "b" * 80, " " * 900, "x\n", "\n\nx" * 60]
    kept = chunks.SLICE
    try:
        for size, target, overlap in ((kept, 60, 20), (50, 50, 0), (1, 120, 119), (3000, 75, 74)):
            chunks.SLICE = size
            got = [[(x["text"], x["start"], x["end"]) for x in row] for row in chunks.chunk_column(pa.array(texts), target, overlap).to_pylist()]
            for text, mine in zip(texts, got, strict=True):
                assert mine == restated(text or "", target, overlap), (target, overlap, text)
            assert [[(x["text"], x["start"], x["end"]) for x in row] for row in chunks.chunk_column(pa.array(texts).slice(7, 20), target, overlap).to_pylist()] == got[7:27]
    finally:
        chunks.SLICE = kept
    assert chunks.chunk_column(pa.array([], pa.string())).to_pylist() == []


def test_texts_of_listings_are_computed_once(spark):
    """The plan names what a text comes from once, however deep the cleaning and however many columns and filters use it."""
    from tenderloom.plans.queries import _pages

    source = spark.range(1).select(F.md5(F.col("id").cast("string")).alias("h"))
    for column in (T.clean(T.clean(F.col("h"))), T.cell_text(F.col("h")), T.absolutize(T.clean(F.col("h")), "https://x.org/a/b"), V.parse_date(T.clean(F.col("h")), "loose"), V.parse_date(F.col("h"), "ungm")):
        plan = source.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("md5(") == 1, plan.count("md5(")
    pages = spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string")
    sizes = {s: len(L.read_listing(pages, s, F.lit("2026-01-01").cast("timestamp"))._jdf.queryExecution().optimizedPlan().toString()) for s in ("nitb_pk", "kuwait_capt", "ebrd")}
    assert max(sizes.values()) < 150_000, sizes
    few = _pages(spark, "/root/testdata/sf0.001", "{c_name}")
    assert few.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
