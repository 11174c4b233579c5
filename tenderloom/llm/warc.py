"""WARC archives in Zstandard: one frame per record, the dictionary in a skippable frame at the head of each file.

Writing: payloads that occur more than once are found by a group-by on their SHA-256; of equal ones that of the largest page_id is a
``response`` and the others are ``revisit`` records that name it. Each task streams its rows into files of a bounded size.
Reading: the dictionary comes from the leading frame, frames are walked block by block without decoding, then decoded one at a time; record
headers, lengths and digests are checked, and what fails is a row with an ``error``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import counted, in_arrow, small, write_file

_FRAME, _SKIPPABLE, _DICTIONARY = 0xFD2FB528, 0x184D2A5D, 0xEC30A437
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:x-page:{}>"
_DATE = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z")
_RECORDS = "file string, at long, record_type string, record_id string, target_uri string, date string, payload_bytes long, payload_digest string, refers_to string, error string, payload binary"
_FIELDS = [(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _RECORDS.split(", "))]


def digest(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(pages: DataFrame, samples: int = 400, most_bytes: int = 1 << 16, size: int = 1 << 15) -> bytes:
    """A dictionary fitted on ``samples`` payloads of at most ``most_bytes``, chosen by a hash over all rows; empty where these are too few."""
    import zstandard

    whole = pages.where(F.octet_length("html").between(1, most_bytes)).select("html", F.xxhash64("page_id", "url", "html").alias("h"))
    texts = [r[0].encode() for r in whole.orderBy("h", "html").limit(samples).collect()]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _leading_frame(dictionary: bytes) -> bytes:
    import zstandard

    packed = zstandard.ZstdCompressor(19).compress(dictionary)
    return struct.pack("<II", _SKIPPABLE, len(packed)) + packed


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n%bContent-Length: %d\r\n\r\n%b\r\n\r\n" % (head.encode(), len(block), block)


def _uri(url: str | None) -> str:
    """A URL as a header value: control characters and spaces as %XX; about:blank for a null."""
    return "about:blank" if not url else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_record(page_id: int | None, url: str | None, payload: bytes, origin: int | None, origin_url: str | None, date: str) -> bytes:
    """One page as a response, or as a revisit of page ``origin``."""
    own = _ID.format(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, (url or '') + digest(payload))}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    extra = []
    if origin is None:
        block += payload
    else:
        extra = [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _ID.format(origin)), ("WARC-Refers-To-Target-URI", _uri(origin_url))]
    kind = "response" if origin is None else "revisit"
    return _record(
        [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Target-URI", _uri(url)), ("WARC-Date", date), *extra, ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
         ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response")],
        block,
    )


def write_archives(pages: DataFrame, folder: str, date: str = "1998-01-01T00:00:00Z", revisit_min_bytes: int = 0, archive_bytes: int = 64 << 20, dictionary: bytes | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as ``folder``/warc/*.warc.zst; returns the manifest (file, n_records, n_bytes), written to ``folder``/manifest.

    A null html is empty. Of equal payloads of at least ``revisit_min_bytes``, rows of the largest page_id are responses and the others
    revisit it (rows that repeat the largest page_id and its payload are all responses; rows without page_id are responses
    only where no equal payload has one). An empty table gives no files. Other columns are not read. Files are cut after ``archive_bytes`` and
    named by task attempt: the manifest alone says which count.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    if dictionary is None:
        dictionary = train_dictionary(pages.select("page_id", "url", F.col("html").cast("string").alias("html")))
    key = F.unhex(F.sha2("html", 256))
    groups = rows.where(F.octet_length("html") >= revisit_min_bytes).groupBy(key.alias("_key")).agg(F.max("page_id").alias("_origin"), F.max_by("url", "page_id").alias("_origin_url"), F.count("*").alias("_n"))
    repeated, n = counted(groups.where("_n > 1 and _origin is not null").drop("_n"), "repeated-payloads")
    marked = rows.withColumn("_key", key).join(small(repeated, n), "_key", "left")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("_origin")), F.col("_origin"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, attempt, seq = TaskContext.get().partitionId(), uuid.uuid4().hex[:8], 0
        packer = zstandard.ZstdCompressor(3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_checksum=True)
        head = _leading_frame(dictionary) if dictionary else b""
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq
            name = f"part-{part:06d}-{seq:05d}-{attempt}.warc.zst"
            info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            data = b"".join([head, packer.compress(info), *held])
            write_file(f"{folder}/warc", name, data)
            seq += 1
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([len(held)], pa.int64()), "n_bytes": pa.array([len(data)], pa.int64())})

        for batch in batches:
            for page_id, url, html, origin, origin_url in zip(*batch.columns, strict=True):
                held.append(packer.compress(page_record(page_id.as_py(), url.as_py(), html.as_py(), origin.as_py(), origin_url.as_py(), date)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    shape = "file string, n_records long, n_bytes long"
    in_arrow(marked.select("page_id", "url", "html", other.alias("origin"), F.when(other.isNotNull(), F.col("_origin_url")).alias("origin_url")), write, shape).write.parquet(f"{folder}/manifest")
    return spark.read.schema(shape).parquet(f"{folder}/manifest")


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by its header and the sizes of its blocks."""
    if len(data) < at + 6 or struct.unpack_from("<I", data, at)[0] != _FRAME:
        raise ValueError("no frame")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = 0
    while not last:
        if at + 3 > len(data):
            raise ValueError("frame cut short")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind = block & 1, block >> 1 & 3
        if kind == 3:
            raise ValueError("reserved block")
        at += 3 + (1 if kind == 1 else block >> 3)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ValueError("frame cut short")
    return at


def leading_dictionary(data: memoryview) -> tuple[bytes, int]:
    """The dictionary (plain or itself compressed) of the skippable frame that leads a file, and where records begin; empty without such a frame."""
    import zstandard

    if len(data) < 8 or struct.unpack_from("<I", data)[0] != _SKIPPABLE:
        return b"", 0
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    if end > len(data):
        raise ValueError("dictionary cut short")
    found = bytes(data[8:end])
    if found[:4] == struct.pack("<I", _FRAME):
        found = zstandard.ZstdDecompressor().decompressobj().decompress(found)
    if found[:4] != struct.pack("<I", _DICTIONARY):
        raise ValueError("no dictionary in the leading frame")
    return found, end


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError("malformed header line")
        out[name.lower()] = value.strip()
    return out


def parse_record(record: bytes) -> dict[str, object]:
    """The fields of one decoded record; ValueError where its headers, lengths or digests are wrong."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    h = _headers(lines)
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if not h.get(k)]:
        raise ValueError(f"without {missing[0]}")
    if not _DATE.fullmatch(h["warc-date"]):
        raise ValueError("malformed date")
    if not re.fullmatch(r"[0-9]+", h["content-length"]) or rest[(n := int(h["content-length"])) :] != b"\r\n\r\n" or len(rest) != n + 4:
        raise ValueError("record length")
    block = rest[:n]
    if "warc-block-digest" in h and h["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest")
    out: dict[str, object] = {"record_type": h["warc-type"], "record_id": h["warc-record-id"], "target_uri": h.get("warc-target-uri"), "date": h["warc-date"]}
    if h["warc-type"] in ("response", "revisit"):
        top, gap, payload = block.partition(b"\r\n\r\n")
        status, *lines = top.split(b"\r\n")
        if not gap or not status.startswith(b"HTTP/"):
            raise ValueError("no HTTP header")
        size = _headers(lines).get("content-length", "")
        if not re.fullmatch(r"[0-9]+", size):
            raise ValueError("HTTP length")
        named = h.get("warc-payload-digest", "")
        if not re.fullmatch(r"sha1:[A-Z2-7]{32}", named):
            raise ValueError("no payload digest")
        if h["warc-type"] == "response":
            if int(size) != len(payload):
                raise ValueError("payload length")
            if named != f"sha1:{digest(payload)}":
                raise ValueError("payload digest")
            out["payload"] = payload
        elif payload or h.get("warc-profile") != _REVISIT or not h.get("warc-refers-to"):
            raise ValueError("malformed revisit")
        out |= {"payload_bytes": int(size), "payload_digest": named[5:], "refers_to": h.get("warc-refers-to")}
    return out


def records(data: bytes | memoryview) -> Iterator[dict[str, object]]:
    """The records of an archive in order, with ``at``, the place of the frame; an ``error`` where one can't be read.

    A record that fails its checks costs only itself; where the frames themselves break off, the rest of the file is one error.
    """
    import zstandard

    data = memoryview(data)
    try:
        dictionary, at = leading_dictionary(data)
    except (ValueError, zstandard.ZstdError) as e:
        yield {"at": 0, "error": str(e)}
        return
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while at < len(data):
        if len(data) >= at + 8 and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            began, at = at, at + 8 + struct.unpack_from("<I", data, at + 4)[0]  # other skippable frames hold no record
            if at > len(data):
                yield {"at": began, "error": "skippable frame cut short"}
            continue
        try:
            end = frame_end(data, at)
        except ValueError as e:
            yield {"at": at, "error": str(e)}
            return
        try:
            yield {"at": at, **parse_record(reader.decompressobj().decompress(data[at:end]))}
        except (ValueError, zstandard.ZstdError) as e:
            yield {"at": at, "error": str(e)}
        at = end


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Every record of the archives that ``folder``/manifest names: file, at, record_type, record_id, target_uri, date, payload_bytes, payload_digest,
    refers_to (a record id), error, and the payload (null for revisits, and without ``payload``)."""
    manifest = spark.read.schema("file string, n_records long, n_bytes long").parquet(f"{folder}/manifest")
    if not (n := manifest.count()):
        return spark.createDataFrame([], _RECORDS)
    files = spark.read.format("binaryFile").load(f"{folder}/warc").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    counted_files = files.join(small(manifest.select("file"), n), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[dict[str, object]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind) for c, kind in _FIELDS], [c for c, _ in _FIELDS])

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for r in records(memoryview(content.as_buffer())):
                    size += len(r.get("payload") or b"") if payload else 100
                    rows.append(r | {"file": file} | ({} if payload else {"payload": None}))
                    if size >= 1 << 20:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    return in_arrow(counted_files, read, _RECORDS)


def page_index(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to of each page.

    A record that can't be read is an error of the job.
    """
    write_archives(pages, folder)
    found = read_archives(pages.sparkSession, folder, payload=False).where("record_type is null or record_type <> 'warcinfo'")
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("long")
    kind = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("unreadable record: "), "file", F.lit(" "), F.col("at").cast("string"), F.lit(" "), "error"))).otherwise(F.col("record_type"))
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", kind.cast("string").alias("record_type"), page("refers_to").alias("refers_to"))
