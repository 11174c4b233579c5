import base64
import glob
import hashlib
import io
import struct
from collections import defaultdict

import pytest
import zstandard
from hypothesis import given
from hypothesis import strategies as st

from tenderloom.llm import warc as W
from tenderloom.llm.shared import new_path

SCHEMA = "page_id long, url string, html string"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[html or ""].append(page_id)
    out = []
    for page_id, _, html in rows:
        data, ids = (html or "").encode(), [x for x in groups[html or ""] if x is not None]
        origin = max(ids) if ids and page_id != max(ids) else None
        out.append((page_id, len(data), b32(data), "response" if origin is None else "revisit", origin))
    return sorted(out, key=repr)


ODD = [
    (1, "http://a/x y\r\nWARC-Type: evil", "<p>same</p>"), (2, None, "<p>same</p>"), (9, "http://b", "<p>same</p>"), (3, "", None), (4, "http://c", ""), (5, "http://d", "é\0\r\n\r\nWARC/1.1\r\n" * 50000),
    (6, "http://e", "x"), (6, "http://e", "x"), (None, "http://f", "x"), (None, None, "only nulls"), (None, None, "only nulls"), (-7, "http://g", "negative"),
]


def test_round_trip_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert sorted((tuple(r) for r in W.page_index(df, new_path(spark, "warc")).collect()), key=repr) == brute(ODD)


def test_empty_table_and_clashing_columns(spark):
    assert W.page_index(spark.createDataFrame([], SCHEMA), new_path(spark, "warc")).collect() == []
    df = spark.createDataFrame([(1, "u", "h", "x", 5)], SCHEMA + ", _key string, _origin int")
    assert [tuple(r) for r in W.page_index(df, new_path(spark, "warc")).collect()] == [(1, 1, b32(b"h"), "response", None)]


def pages(spark, n=600):
    return spark.createDataFrame([(k, f"http://h/{k}", f"<html><title>page number {k % 500} of the site</title><p>{'words and words ' * (k % 500 % 7)}</p></html>") for k in range(n)], SCHEMA)


def test_files_as_another_reader_sees_them(spark):
    """A leading dictionary frame, a frame per record, whole records one after the other, small files."""
    folder = new_path(spark, "warc")
    manifest = W.write_archives(pages(spark), folder, archive_bytes=8000).collect()
    assert len(manifest) > 4 and sum(r.n_records for r in manifest) == 600
    payloads = {}
    for name in glob.glob(f"{folder.removeprefix('file://')}/warc/*.warc.zst"):
        data = open(name, "rb").read()
        magic, size = struct.unpack_from("<II", data)
        assert magic == 0x184D2A5D
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompressobj().decompress(data[8 : 8 + size]))
        text = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True).read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        at = 0
        while at < len(text):
            end = text.index(b"\r\n\r\n", at) + 4
            h = dict(x.split(b": ", 1) for x in text[at:end].split(b"\r\n")[1:-2])
            block = text[end : end + int(h[b"Content-Length"])]
            at = end + len(block) + 4
            assert text[at - 4 : at] == b"\r\n\r\n"
            if h[b"WARC-Type"] == b"response":
                payloads[h[b"WARC-Record-ID"]] = block.partition(b"\r\n\r\n")[2]
    back = {r.record_id.encode(): bytes(r.payload) for r in W.read_archives(spark, folder).where("record_type = 'response'").collect()}
    assert back == payloads and len(back) == 500


def test_without_dictionary_and_minimum_size(spark):
    folder = new_path(spark, "warc")
    W.write_archives(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], SCHEMA), folder, revisit_min_bytes=3, dictionary=b"").collect()
    rows = W.read_archives(spark, folder, payload=False).where("record_type <> 'warcinfo'").select("record_id", "record_type", "refers_to").collect()
    assert sorted(tuple(r) for r in rows) == [("<urn:x-page:1>", "response", None), ("<urn:x-page:2>", "response", None), ("<urn:x-page:3>", "revisit", "<urn:x-page:4>"), ("<urn:x-page:4>", "response", None)]


def archive(*recs, dictionary=b"", **kw):
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, **kw)
    return (W._leading_frame(dictionary) if dictionary else b"") + b"".join(c.compress(r) for r in recs)


GOOD = W.page_record(1, "http://a", b"hello", None, None, "2020-01-01T00:00:00Z")


@pytest.mark.parametrize("was, becomes, error", [
    (b"WARC/1.1", b"WARC/9.9", "no WARC header"), (b"WARC-Date: 2020", b"WARC-Date: x020", "malformed date"), (b"WARC-Type: response\r\n", b"", "without warc-type"), (b"hello", b"hell", "record length"), (b"hello", b"hullo", "block digest"),
    (b"WARC-Type", b"no colon\r\nWARC-Type", "malformed header line"),
])
def test_a_wrong_record_costs_only_itself(was, becomes, error):
    found = list(W.records(archive(GOOD, GOOD.replace(was, becomes), GOOD)))
    assert [r.get("error") for r in found] == [None, error, None] and found[2]["payload"] == b"hello"


def test_lengths_of_payload_and_frames():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nhello"
    record = W._record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x-page:1>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{b32(b'hello')}")], block)
    assert [r["error"] for r in W.records(archive(record))] == ["payload length"]
    whole = archive(GOOD, GOOD)
    for cut in (1, 5, len(whole) // 2 - 3):
        assert [r.get("error") for r in W.records(whole[:-cut])] == [None, "frame cut short"] or cut > 5
    assert [r.get("error") for r in W.records(whole + b"junk")] == [None, None, "no frame"]
    assert [r.get("error") for r in W.records(struct.pack("<II", 0x184D2A5D, 4) + b"junk" + whole)] == ["no dictionary in the leading frame"]
    assert [r.get("error") for r in W.records(struct.pack("<II", 0x184D2A5D, 999) + whole)] == ["dictionary cut short"] or len(whole) > 999
    assert [r.get("error") for r in W.records(whole + struct.pack("<II", 0x184D2A50, 3) + b"abc" + archive(GOOD))] == [None] * 3
    flipped = bytearray(archive(GOOD, write_checksum=True))
    flipped[-1] ^= 1
    assert next(W.records(bytes(flipped)))["error"]


@given(st.lists(st.binary(max_size=400), max_size=5), st.booleans(), st.sampled_from([1, 3, 19]))
def test_any_payload_comes_back(payloads, content_size, level):
    recs = [W.page_record(k, f"http://{k}", p, None, None, "2020-01-01T00:00:00Z") for k, p in enumerate(payloads)]
    found = list(W.records(archive(*recs, level=level, write_content_size=content_size)))
    assert [r["payload"] for r in found] == payloads and [r["record_id"] for r in found] == [f"<urn:x-page:{k}>" for k in range(len(payloads))]


def test_an_unreadable_record_fails_the_index(spark, monkeypatch):
    whole = W.page_record
    monkeypatch.setattr(W, "page_record", lambda *a: whole(*a).replace(b"HTTP/1.1", b"HTTP/1.0"))
    folder = new_path(spark, "warc")
    W.write_archives(spark.createDataFrame([(1, "u", "h")], SCHEMA), folder)
    assert {r.error for r in W.read_archives(spark, folder).collect()} <= {None, "block digest"}
