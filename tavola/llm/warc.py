"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Each task writes one ``.warc.zst`` archive: a skippable frame (magic 0x184D2A5D) that holds a
dictionary trained on records of this archive, then one Zstandard frame per record.
A reader takes the dictionary from the first frame and can start at any record.

Payloads are deduplicated by SHA-1 before writing: of equal payloads of at least
``min_bytes`` bytes the page with the largest id is a response, the others are
revisit records without payload.  Only (id, digest) pairs are grouped for that, with partial
maxima; the payload moves once, by id, to meet its decision.

Archives go to the shared folder through pyarrow's file systems under names of their
own for each attempt; the result is the manifest of the attempts that succeeded, and only
files in it are read.  So a lost executor or a repeated task does no harm.

Defined cases: a null payload is empty; a null URL gives a record without target; line breaks and controls
in a URL are percent-encoded; rows without an id are always responses, unless an equal payload has an id: then
they revisit it; rows that repeat id and payload are responses each; a repeated id with two payloads
is handled payload by payload; an empty table gives no archive; input columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.llm.staging import new_folder, stage

#: Bytes of records that a dictionary is trained on at most, and of each record.
SAMPLE_BYTES, RECORD_SAMPLE = 8 << 20, 16 << 10
DICTIONARY_BYTES = 64 << 10
LEVEL = 6
#: Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_CHUNK = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _record_id(page: int | None, number: int) -> str:
    return f"<urn:page:{page}>" if page is not None else f"<urn:uuid:{uuid.UUID(int=number)}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, number: int = 0) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page, number)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to, 0))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8") + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record and its payload; the digest of a payload is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or digest(payload) != said):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")

    def page(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(found[1]) if found else None

    return {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": length, "payload_digest": said, "refers_to": page("WARC-Refers-To"), "payload": payload if kind == "response" else None}


class Writer:
    """Writes an archive: the dictionary in a skippable frame, then a frame per record."""

    def __init__(self, out: BinaryIO, dictionary: zstandard.ZstdCompressionDict | None):
        self.out = out
        if dictionary is not None:
            data = dictionary.as_bytes()
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)

    def add(self, data: bytes) -> None:
        self.out.write(self.zstd.compress(data))


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the samples, or None where they are too few for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL)
    except zstandard.ZstdError:
        whole = b"".join(samples)[-DICTIONARY_BYTES:]  # too few to train on: their own bytes
        return zstandard.ZstdCompressionDict(whole, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(whole) >= 8 else None


def read_records(source: BinaryIO) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    pending = source.read(8)
    dictionary = None
    if len(pending) == 8 and struct.unpack("<II", pending)[0] == DICTIONARY_MAGIC:
        data = source.read(struct.unpack("<II", pending)[1])
        trained = data[:4] == b"\x37\xa4\x30\xec"
        dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
        pending = b""
    zstd = zstandard.ZstdDecompressor(dict_data=dictionary)
    while pending or (pending := source.read(_CHUNK)):
        frame, parts = zstd.decompressobj(), []
        while not frame.eof:
            if not pending and not (pending := source.read(_CHUNK)):
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(pending))
            pending = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def _open(uri: str):
    system, path = pafs.FileSystem.from_uri(uri if re.match(r"\w+:/", uri) else f"file://{uri}")
    return system, path


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[bytes]:
            number = uuid.uuid4().int >> 64 << 64
            for batch in batches:
                for page, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    number += 1
                    yield record(page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8"), refers.as_py(), number)

        stream, held, size = rows(), [], 0
        for data in stream:
            held.append(data)
            size += len(data)
            if size >= SAMPLE_BYTES:
                break
        if not held:
            return
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.zst"
        n = 0
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            writer = Writer(out, train([x[:RECORD_SAMPLE] for x in held]))
            while held:
                writer.add(held.pop(0))
                n += 1
            for data in stream:
                writer.add(data)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([system.get_file_info(f"{path}/{name}").size], pa.int64())], names=["archive", "records", "bytes"])

    return run


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] * payloads)]
        schema = pa.schema(fields)

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)

        for names in batches:
            for name in names.column("archive").to_pylist():
                system, path = _open(name)
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as source:
                    for data in read_records(source):
                        rows.append(parse(data))
                        size += len(data) if payloads else 256
                        if size >= 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return run


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the page that holds the payload, for a revisit."""
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = stage(pages.select("page_id", F.sha1(data).alias("sha"), F.octet_length(data).alias("n")), "digests")
    holders = narrow.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("holder"), F.count("*").alias("rows")).where("rows > 1 and holder is not null")
    revisits = narrow.where(F.col("n") >= min_bytes).join(holders, "sha").where(~F.col("page_id").eqNullSafe(F.col("holder")))
    revisits = stage(revisits.select("page_id", "sha", F.col("holder").alias("refers_to")).distinct(), "revisits")
    keyed = pages.withColumn("sha", F.sha1(data))
    of = revisits.toDF("of_page", "of_sha", "refers_to")
    return keyed.join(of, keyed["page_id"].eqNullSafe(of["of_page"]) & (keyed["sha"] == of["of_sha"]), "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, html: str = "html", url: str = "url", id: str = "page_id") -> DataFrame:  # noqa: A002
    """Write a record per page below ``folder``; returns the manifest (archive, records, bytes)."""
    pages = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    written = with_references(pages, min_bytes).mapInArrow(_write(folder), "archive string, records long, bytes long")
    return stage(written, "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in a manifest, each archive by a task of its own."""
    n = max(1, manifest.count())  # an explicit number: adaptive execution would merge the few names into one task
    spread = manifest.select("archive").repartitionByRange(n, "archive")
    columns = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    return spread.mapInArrow(_read(payloads), columns)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read the records back, without payloads."""
    return read_archives(write_archives(pages, new_folder(spark, "warc"), min_bytes), payloads=False)
