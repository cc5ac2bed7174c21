"""WARC archives with a Zstandard dictionary of their own.

An archive begins with a skippable frame that holds the dictionary trained on its
records; every record behind it is a frame of its own, compressed with that
dictionary, so records can be read alone. Payloads that occur more than once are
stored once, as a response; the other records are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerisk.llm.common import settle, shuffle_parts
from pagerisk.session import work_dir

# Fixed values of the archive formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 32 << 20, 64 << 10, 4 << 20, 6
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_TAG = 0x5041474552


def record_id(page_id: int | None) -> str:
    """A record's URI: a custom (version 8) UUID that holds the page id."""
    low = (page_id or 0) & ((1 << 64) - 1)
    custom = (_TAG << 8 | (page_id is None)) << 80 | 8 << 76 | (low >> 62) << 64 | 2 << 62 | low & ((1 << 62) - 1)
    return f"<urn:uuid:{uuid.UUID(int=custom)}>"


def page_of(uri: str) -> int | None:
    n = uuid.UUID(uri.strip("<>")).int
    if n >> 80 & 255:
        return None
    low = (n >> 64 & 3) << 62 | n & ((1 << 62) - 1)
    return low - (1 << 64) if low >> 63 else low


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with the response's head only."""
    head = _HTTP.format(len(payload)).encode()
    block = head if revisit else head + payload
    fields = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
    ]
    if url is not None:
        quoted = re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
        fields.append(f"WARC-Target-URI: {quoted}")
    if revisit:
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join([*fields, "", ""]).encode() + block + b"\r\n\r\n"


def train(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary from ``sample`` bytes at most, taken evenly over all records.

    Long records are cut into pieces of 128 KB or of a 64th of all bytes, if that is
    less, so a few of them are enough. Where the trainer still finds nothing to
    learn, as in a single short record, the pieces themselves are the dictionary.
    """
    total = sum(map(len, records))
    piece, step = min(128 << 10, max(64, total // 64)), max(1, -(-total // sample))
    places = ((r, at) for r in records for at in range(0, len(r), piece))
    chosen = [r[at : at + piece] for r, at in itertools.islice(places, 0, None, step)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, chosen)) // 8)), chosen, k=1024, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(chosen)[-size:], zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """The bytes of an archive: the dictionary in a skippable frame, then a frame for each record."""
    trained = train(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
    raw = trained.as_bytes()
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw, *map(packer.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """End of the Zstandard frame that begins at ``at``, from its block headers."""
    flags = data[at + 4]
    place = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        head = int.from_bytes(data[place : place + 3], "little")
        place += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return place + 4 * (flags >> 2 & 1)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    view, at, trained = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        trained, at = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=trained)
    while at < len(data):
        end = frame_end(view, at)
        yield unpacker.decompress(view[at:end])
        at = end


def parse(data: bytes) -> dict:
    """What a record says: page_id, url, record_type, payload_bytes, payload_digest, refers_to, and the payload of a response."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_bytes": size,
        "payload_digest": digest, "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit): of equal payloads of at least ``min_bytes`` the largest page_id is the response.

    Only ids and digests are grouped and joined; a payload moves once, dealt out by page_id.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    ids = rows.filter(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    repeated = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 AND refers_to IS NOT NULL")
    revisits = ids.join(repeated, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()
    both = rows.alias("r").join(revisits.alias("v"), F.col("r.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("r.digest") == F.col("v.digest")), "left")
    return both.select("r.page_id", "r.url", "r.payload", "v.refers_to", F.col("v.refers_to").isNotNull().alias("revisit"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page into archives under ``folder``; returns path and records of each archive.

    A task writes archives of about ``archive_bytes`` of records each. Archives
    get their names when complete and names are never used twice, so only those
    that the returned table lists count, whatever tasks were lost. Pages without
    html have an empty payload; rows that repeat are stored as often.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        partition, waiting, size = TaskContext.get().partitionId(), [], 0

        def flush() -> pa.RecordBatch:
            name = f"pages-{partition:05}-{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/.{name}.part", compression=None) as out:
                out.write(archive(waiting))
            store.move(f"{root}/.{name}.part", f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(waiting)], pa.int64())})

        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "revisit"))
            for row in zip(*columns, strict=True):
                waiting.append(record(*(v.as_py() for v in row), date))
                size += len(waiting[-1])
                if size >= archive_bytes:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    return settle(with_revisits(pages, min_bytes).mapInArrow(write, "path string, records bigint"), "warc-archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the listed archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to, and payload if asked."""
    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint" + ", payload binary" * payloads
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            store, place = fs.FileSystem.from_uri(path)
            with store.open_input_stream(place, compression=None) as file:
                data = file.read()
            rows: list[dict] = []
            for raw in read_archive(data):
                rows.append(parse(raw))
                if len(rows) == 500:
                    yield block(rows)
                    rows = []
            if rows:
                yield block(rows)

    def block(rows: list[dict]) -> pa.RecordBatch:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *["payload"] * payloads]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=False)], names)

    return archives.repartition(shuffle_parts(archives.sparkSession)).mapInArrow(read, schema)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages into archives in the shared folder and read the archives back."""
    return read_archives(write_archives(pages, work_dir(pages.sparkSession, "warc"), min_bytes)).drop("url")
