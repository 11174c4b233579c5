"""Dates of feeds with their zones, feeds as XML files, payloads that are lists, maps or broken."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tenderloom.functions import values as V
from tenderloom.sources import feeds as S


@pytest.mark.parametrize("text, hour, minute, day", [
    ("Tue, 05 Mar 2024 10:00:00 GMT", 10, 0, 5), ("Tue, 05 Mar 2024 10:00:00 +0300", 7, 0, 5), ("5 Mar 2024 10:00 -05:30", 15, 30, 5), ("Tue, 5 March 24 10:00:00 EST", 15, 0, 5), ("05 Mar 2024 22:30:00 pdt", 5, 30, 6), ("05 Mar 2024 10:00:00 Z", 10, 0, 5), ("05 Mar 2024 10:00:00", 10, 0, 5), ("05 Mar 2024", 0, 0, 5),
    ("2024-03-05T10:00:00+03:00", 7, 0, 5), ("2024-03-05T10:00:00.123Z", 10, 0, 5), ("2024-03-05 10:00-0500", 15, 0, 5), ("2024-03-05", 0, 0, 5), ("2024-03-05T01:00:00+03:00", 22, 0, 4), ("05 Mar 2024 10:00:00 XYZ", None, 0, 0), ("31 Feb 2024 10:00:00 GMT", None, 0, 0), ("soon", None, 0, 0), ("", None, 0, 0), (None, None, 0, 0),
])
def test_instants_of_feed_dates(spark, text, hour, minute, day):
    got = spark.createDataFrame([(text,)], "x string").select(V.feed_date(F.col("x")).alias("at")).first().at
    assert got == (None if hour is None else dt.datetime(2024, 3, day, hour, minute))


FEED = """<?xml version="1.0"?><rss version="2.0"><channel><title>all</title>
<item><title><![CDATA[A & B]]></title><link>https://x.org/1</link><description>&lt;b&gt;one&lt;/b&gt;</description><pubDate>Tue, 05 Mar 2024 10:00:00 +0300</pubDate><guid isPermaLink="false">g1</guid></item>
<item><title>Second</title><link>https://x.org/2</link></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link rel="alternate" href="/e"/><summary>s</summary><updated>2024-03-05T10:00:00-05:00</updated><id>i</id></entry></feed>"""


def test_feeds_as_files_are_as_payloads(spark, tmp_path):
    """Spark's XML source and the payload reader agree on well-formed feeds; offsets give the right instant."""
    for name, text in (("a.xml", FEED), ("b.xml", ATOM)):
        (tmp_path / name).write_text(text)
    columns = ("pos", "title", "link", "description", "published", "guid")
    files = S.read_feed_files(spark, f"file://{tmp_path}")
    by_file = sorted((r.page[-5:], *(r[c] for c in columns)) for r in files.collect())
    payloads = spark.createDataFrame([("a.xml", FEED), ("b.xml", ATOM)], "page string, payload string")
    assert by_file == sorted((r.page, *(r[c] for c in columns)) for r in S.read_feed_items(payloads).collect())
    undp = {r.external_id: r.published_at for r in S.read_undp(payloads, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert undp == {"g1": dt.datetime(2024, 3, 5, 7), "https://x.org/2": dt.datetime(2025, 1, 1), "i": dt.datetime(2024, 3, 5, 15)}


def test_notices_in_lists_maps_and_broken_payloads(spark):
    doc = {"id": "1", "project_name": "P", "notice_type": "Invitation for Bids", "project_ctry_code": "ke", "total_contract_amount": 12.5}
    bodies = [{"procnotices": [doc, None, "x"]}, {"procnotices": {"a": doc | {"id": "2"}, "b": doc | {"id": 3}}}, {"procnotices": None}, {"procnotices": "none"}, {}, []]
    payloads = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(6, "{broken"), (7, None)], "page int, payload string")
    assert sorted(r.id for r in S.world_bank_docs(payloads).collect()) == ["1", "2", "3"]
    assert sorted(r.budget_max_usd for r in S.read_world_bank(payloads, F.lit("2025-01-01").cast("timestamp")).collect()) == [13, 13, 13]
    assert sorted((r.page, r.failed[0]) for r in S.broken_payloads(payloads).collect()) == [(6, "json"), (7, "json")]
