"""WARC archives of Zstandard frames: writing, and reading back frame by frame.

An archive starts with a skippable frame that holds its dictionary (magic 0x184D2A5D), trained on the archive's first records, and then has
one frame for each record. Reading walks over the frames by their block headers, decodes one at a time, and
validates each record: version line, required headers, Content-Length against the block, the closing blank lines, the HTTP length and the payload's digest.

Archives are written by Spark's text writer, one row a file, with an empty skippable frame as line separator, so that they go to any file
system that Spark knows, under its commit protocol: a lost executor's archives are written again, half ones never appear. They are read by Spark's binary reader,
a whole archive at a time, so archives of other makers must be below 2 GiB.

Cases: null html is an empty payload; a null url is left out. Of rows that share the smallest page_id of their payload, all are responses; a null page_id is greater than
any other, and refers to nothing if no row of its payload has one. A payload of any length below that is one record. An empty table writes no record. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_dir, remove_dir, small_batches, table, with_key_min

#: Fixed values of the formats.
DICTIONARY_MAGIC, SKIPPABLE, SKIPPABLE_MASK, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFFFFFFF0, 0xFD2FB528
EMPTY_FRAME = struct.pack("<II", SKIPPABLE, 0)  # all below 0x80, so that it may be a separator of text files
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Compressed bytes at which an archive is closed, bytes of records that a dictionary is trained on, and its size.
ARCHIVE_BYTES, TRAINING_BYTES, DICTIONARY_BYTES = 16 << 20, 1 << 20, 32 << 10
DATE = "2024-01-01T00:00:00Z"
#: Payloads from this size on are revisits when they repeat.
LEAST_BYTES = 0
LEVEL = 3


class BadArchive(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A record as bytes. A revisit holds the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:x-page:{refers_to}>")
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def archives(records: Iterator[bytes], archive_bytes: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """Whole archives; holds the training records and one archive at a time."""
    records = iter(records)
    ahead: list[bytes] = []
    while True:
        size = sum(map(len, ahead))
        for r in records:
            ahead.append(r)
            size += len(r)
            if size >= TRAINING_BYTES:
                break
        if not ahead:
            return
        out, trained = bytearray(), None
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:65536] for r in ahead])
            out += struct.pack("<II", DICTIONARY_MAGIC, len(trained.as_bytes())) + trained.as_bytes()
        except zstandard.ZstdError:  # too few records to train on
            trained = None
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True).compress
        waiting, ahead = iter(ahead), []
        for r in waiting:
            out += squeeze(r)
            if len(out) >= archive_bytes:
                break
        else:
            for r in records:
                out += squeeze(r)
                if len(out) >= archive_bytes:
                    break
        ahead = list(waiting)
        yield bytes(out)


def frame_end(raw: memoryview, at: int) -> int:
    """Where the frame at `at` ends, by its header and its blocks' headers."""
    if at + 8 > len(raw):
        raise BadArchive("cut short")
    magic, size = struct.unpack_from("<II", raw, at)
    if magic & SKIPPABLE_MASK == SKIPPABLE:
        end = at + 8 + size
    else:
        if magic != FRAME_MAGIC:
            raise BadArchive(f"no frame at byte {at}")
        flags = raw[at + 4]
        single = flags >> 5 & 1
        content = (1, 2, 4, 8)[flags >> 6] if flags >> 6 or single else 0
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + content
        last = 0
        while not last:
            if end + 3 > len(raw):
                raise BadArchive("cut short")
            block = raw[end] | raw[end + 1] << 8 | raw[end + 2] << 16
            last = block & 1
            end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        end += 4 * (flags >> 2 & 1)
    if end > len(raw):
        raise BadArchive("cut short")
    return end


def frames(raw: bytes) -> Iterator[bytes]:
    """The content of each frame of an archive, with the dictionary of its leading frame."""
    view, at, first = memoryview(raw), 0, True
    unpack = zstandard.ZstdDecompressor()
    while at < len(view):
        end = frame_end(view, at)
        magic = struct.unpack_from("<I", view, at)[0]
        if magic & SKIPPABLE_MASK == SKIPPABLE:
            if magic == DICTIONARY_MAGIC:
                if not first:
                    raise BadArchive("the dictionary does not lead")
                held = bytes(view[at + 8 : end])
                if held[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be compressed itself
                    held = zstandard.ZstdDecompressor().decompress(held, max_output_size=64 << 20)
                try:
                    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
                except zstandard.ZstdError as e:
                    raise BadArchive(str(e)) from e
        else:
            try:
                yield unpack.decompressobj().decompress(view[at:end])
            except zstandard.ZstdError as e:
                raise BadArchive(str(e)) from e
        at, first = end, False


def parse(raw: bytes) -> dict:
    """A record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (None of a revisit)."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not blank or version not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive(f"no record: {version[:40]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadArchive(f"no header: {line[:40]!r}")
        headers[name] = value.strip()
    if missing := [n for n in REQUIRED if n not in headers]:
        raise BadArchive(f"no {', '.join(missing)}")
    if not headers["Content-Length"].isdigit() or len(rest) != int(headers["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("Content-Length is not the block's length")
    http, blank, payload = rest[:-4].partition(b"\r\n\r\n")
    stated = [x.split(b":")[1].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not blank or len(stated) != 1:
        raise BadArchive("no HTTP headers")
    kind, said = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "")
    if kind not in ("response", "revisit") or not said.startswith("sha1:"):
        raise BadArchive(f"a {kind} with digest {said[:40]!r}")
    size = int(stated[0])
    if kind == "response" and (size != len(payload) or said[5:] != digest(payload)):
        raise BadArchive("the payload is not of the stated length and digest")
    if kind == "revisit" and payload:
        raise BadArchive("a revisit with a payload")
    number = lambda name: int(x) if (x := headers.get(name, "").removeprefix("<urn:x-page:").rstrip(">")) else None
    return {"page_id": number("WARC-Record-ID"), "url": headers.get("WARC-Target-URI"), "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload_bytes": size, "payload_digest": said[5:], "payload": payload if kind == "response" else None}


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record for each row of pages (page_id, url, html) to archives in the folder path."""
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumn("key", F.concat_ws(":", F.sha2("payload", 256), F.octet_length("payload")))
    own = with_key_min(own, "key", "page_id", "first").drop("key")
    repeat = (F.octet_length("payload") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    own = own.select("page_id", "url", "payload", F.when(repeat, F.col("first")).alias("refers_to"), repeat.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (record(*(c[i].as_py() for c in b.columns)) for b in batches for i in range(b.num_rows))
        for a in archives(rows, archive_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.binary())], ["archive"])

    small_batches(spark, 64)
    made = own.mapInArrow(run, "archive binary")
    made.select(F.expr("cast(archive as string)").alias("value")).write.option("lineSep", EMPTY_FRAME.decode()).option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload]) for each record of the archives in the folder path."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds], [n for n, _ in kinds])

        for b in batches:
            for raw in b.column(0):
                rows = []
                for f in frames(raw.as_py()):
                    rows.append(parse(f))
                    if len(rows) >= 256:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    small_batches(spark, 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    found = cut(read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove_dir(spark, path)
    return found
