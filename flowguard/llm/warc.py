"""WARC archives compressed by zstandard with a shared dictionary: a writer and a validating reader.

An archive begins with a skippable frame that holds the dictionary and goes on with one frame for each record. Archives
are rows with a binary column, so any store that Spark reads will do; frames of the binaryFile source fit the reader.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC, ZSTD_DICTIONARY = 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: So many digests of repeated payloads, some hundred bytes each, may be broadcast.
MOST_REPEATED = 400_000
_DATE = "2024-01-01T00:00:00Z"


def train_dictionary(pages: DataFrame, rows: int = 400, size: int = 64 << 10) -> bytes:
    """A dictionary from a bounded sample of about `rows` whole payloads by hash of id and payload; empty if they are too few to train one."""
    total = pages.count()
    if not total:
        return b""
    place = F.pmod(F.xxhash64("page_id", "html"), F.lit(1_000_000))
    sample = pages.where(F.col("html").isNotNull() & (place < int(1_000_000 * min(1.0, rows / total) + 1)))
    texts = sorted(r[0].encode("utf-8", "replace") for r in sample.select("html").collect())
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame, its dictionary compressed; nothing without a dictionary."""
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: object) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit that has the HTTP head alone. Both name the payload's full length and digest."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", _header(url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    else:
        block += payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = VERSION.decode() + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with revisit and refers_to: of equal payloads of at least least_bytes the one with the
    largest page_id is the response. Rows that repeat this page_id are responses too; a null page_id revisits any other,
    and among nulls alone each is a response."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html"))
    # Only payloads that several rows have say anything; most have one, and then there is little to join.
    last = rows.select("digest", "page_id").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("k")).where("k > 1").drop("k")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")) & (F.col("bytes") >= least_bytes)
    return rows.join(small(materialize(last), MOST_REPEATED), "digest", "left").select("page_id", "url", "html", again.alias("revisit"), F.when(again, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, dictionary: bytes, archive_bytes: int = 1 << 20) -> DataFrame:
    """(content): archives of about archive_bytes each of what mark_revisits returns."""
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = dictionary_frame(shared.value)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None, write_checksum=True)
        parts, size = [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "revisit", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, revisit, refers_to = (c[i].as_py() for c in columns)
                parts.append(packer.compress(record(page_id, url, html.encode("utf-8", "replace"), refers_to, revisit)))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([lead + b"".join(parts)], pa.binary())], names=["content"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([lead + b"".join(parts)], pa.binary())], names=["content"])

    return pages.mapInArrow(run, "content binary")


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at `at` ends, by its header and block headers."""
    descriptor = data[at + 4]
    single, checksum = descriptor >> 5 & 1, descriptor >> 2 & 1
    sizes = (1 if single else 0, 2, 4, 8)[descriptor >> 6]
    at += 5 + (0 if single else 1) + (0, 1, 2, 4)[descriptor & 3] + sizes
    last = 0
    while not last:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checksum
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def records(content: bytes) -> Iterator[bytes]:
    """The decompressed records of an archive, one for each frame. Raises ValueError where the archive is damaged."""
    data, at, packer = memoryview(content), 0, zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        dictionary = bytes(data[8 : 8 + size])
        if len(dictionary) < size:
            raise ValueError("the dictionary is cut off")
        if dictionary[:4] == struct.pack("<I", ZSTD_MAGIC):
            dictionary = packer.decompressobj().decompress(dictionary)
        if dictionary[:4] != struct.pack("<I", ZSTD_DICTIONARY):
            raise ValueError("the leading frame holds no dictionary")
        packer, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)), 8 + size
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("a frame is cut off")
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # any other skippable frame
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if magic != ZSTD_MAGIC:
            raise ValueError("no frame starts where one should")
        end = _frame_end(data, at)
        try:
            yield packer.decompressobj().decompress(bytes(data[at:end]))
        except zstandard.ZstdError as e:
            raise ValueError(f"a frame can't be decoded: {e}") from e
        at = end


def parse(raw: bytes) -> dict:
    """Headers, lower-cased, and what a record says of its payload. Raises ValueError unless headers, lengths and digest hold."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"no header: {line[:60]}")
        headers[name.strip().lower()] = value.strip()
    if missing := [x for x in MANDATORY if x not in headers]:
        raise ValueError(f"missing: {', '.join(missing)}")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block's length isn't as stated")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    stated = next((int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if not gap or stated is None:
        raise ValueError("no HTTP head with a length")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers["warc-type"] == "response" and (len(payload) != stated or sha1_base32(payload) != digest):
        raise ValueError("the payload isn't as stated")
    if headers["warc-type"] == "revisit" and (payload or headers.get("warc-profile") != PROFILE or "warc-refers-to" not in headers):
        raise ValueError("no valid revisit")
    return headers | {"payload": payload, "payload_bytes": stated, "digest": digest}


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to), and payload if asked for, of every record of
    archives (content binary). A damaged archive fails the read; an archive without records gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found = [parse(x) for x in records(content.as_py() or b"")]
                columns = [
                    pa.array([_page(x["warc-record-id"]) for x in found], pa.int64()),
                    pa.array([x.get("warc-target-uri") for x in found], pa.string()),
                    pa.array([x["warc-type"] for x in found], pa.string()),
                    pa.array([x["payload_bytes"] for x in found], pa.int64()),
                    pa.array([x["digest"] for x in found], pa.string()),
                    pa.array([_page(x.get("warc-refers-to")) for x in found], pa.int64()),
                ]
                names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
                if payloads:
                    columns.append(pa.array([x["payload"] for x in found], pa.binary()))
                    names.append("payload")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
    return archives.select("content").mapInArrow(run, schema + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame, least_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html, ...) and read the archives back.

    A null html is an empty payload, a null url gives no target header, line ends in a url are percent-encoded. A payload
    of any length is one record of one frame. Equal rows give equal records. Extra columns are not read. An empty table gives none.
    """
    pages = pages.select("page_id", "url", "html")
    return read_archives(materialize(write_archives(mark_revisits(pages, least_bytes), train_dictionary(pages))), payloads)
