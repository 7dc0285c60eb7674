"""WARC archives with a Zstandard dictionary of their own, and their reader.

An archive is one file in the shared folder. It starts with a skippable frame that holds
the dictionary, trained on the archive's own records; every record after it is one frame
compressed with that dictionary, so a reader can start at any record. Files are written
under a new name and listed in a manifest only when their task has ended; the reader takes
listed files alone, so a retried task leaves nothing that is read twice.

Records follow WARC 1.1: a response holds an HTTP response whose body is the payload, a revisit
has no block and names the profile of equal payload digests. All records of a run have one date,
that of the run, as pages come without one.

Defined cases: a payload of any length is one record, held by one task; a null payload counts as empty; a null url leaves the target header out; of
equal payloads the smallest id is a response and the others revisit it, while rows that
repeat that smallest id are responses too; a null id is written as such and is a response
only if its payload has no other id; an empty table gives no archive and no rows; other
columns are neither read nor written.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgaudit.llm.common import as_bytes, written
from imgaudit.session import shared_dir

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
# Fixed value: the standard's name for revisits of an equal payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 16  # parts that a very common payload is looked up in
RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, url string, payload binary")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _from_urn(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def format_record(page_id: int | None, url: str | None, payload: bytes, first: int | None,
                  date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record; ``first`` is the id it revisits, or null for a response."""
    body = HTTP_HEAD % len(payload) + payload if first is None else b""
    head = {"WARC-Type": "response" if first is None else "revisit",
            "WARC-Record-ID": _urn(page_id), "WARC-Date": date,
            "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
            "X-Payload-Length": str(len(payload)), "Content-Length": str(len(body))}
    if first is None:
        head["Content-Type"] = "application/http; msgtype=response"
    else:
        head |= {"WARC-Refers-To": _urn(first), "WARC-Profile": REVISIT_PROFILE}
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple:
    """The values of ``RECORDS``; a response's length and digest come from its body."""
    top, _, rest = record.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    payload = rest[:int(head["Content-Length"])].partition(b"\r\n\r\n")[2]
    response = head["WARC-Type"] == "response"
    length = len(payload) if response else int(head["X-Payload-Length"])
    digest = (payload_digest(payload) if response
              else head["WARC-Payload-Digest"].removeprefix("sha1:"))
    return (_from_urn(head["WARC-Record-ID"]), length, digest, head["WARC-Type"],
            _from_urn(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"),
            payload if response else None)


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from evenly spaced whole records, at most some megabytes of them."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = records[::step]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:  # too few records to train on: their bytes are the dictionary
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:],
                                             dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack_archive(records: list[bytes]) -> bytes:
    dictionary = train(records)
    raw = dictionary.as_bytes()
    compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
    frames = [struct.pack("<II", SKIPPABLE, len(raw)), raw]
    return b"".join(frames + [compressor.compress(record) for record in records])


def unpack_archive(archive: bytes) -> Iterator[bytes]:
    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the start of the archive")
    dictionary = zstandard.ZstdCompressionDict(archive[8:8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = memoryview(archive)[8 + size:]
    while len(rest):
        one = reader.decompressobj()
        yield one.decompress(rest)
        rest = rest[len(rest) - len(one.unused_data):]


def decided(pages: DataFrame, page_id: str = "page_id", url: str = "url",
            payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Add to every page the id it revisits; the first of equal payloads has none."""
    body = as_bytes(payload)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        body.alias("payload"), F.sha2(body, 256).alias("_key"))
    # decided on hashes and ids alone; pages of a very common payload meet its first in several parts
    firsts = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("_key").agg(
        F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        "_key", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    revisits = ~F.col("_first").eqNullSafe(F.col("page_id"))
    return salted.join(firsts, ["_key", "_salt"], "left").select(
        "page_id", "url", "payload", F.when(revisits, F.col("_first")).alias("first"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the decided pages as archives into ``folder``; returns the manifest."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)

        def flush(records: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(f"{root}/{name}.part") as out:
                out.write(pack_archive(records))
            system.move(f"{root}/{name}.part", f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"name": [name], "records": [len(records)]})

        held, size = [], 0
        for batch in batches:
            for row in zip(*(column for column in batch.columns)):
                held.append(format_record(*(value.as_py() for value in row), date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    manifest = rows.select("page_id", "url", "payload", "first").mapInArrow(
        write, "name string, records long")
    return written(manifest, "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of all listed archives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for record in unpack_archive(content.as_py()):
                    held.append(parse_record(record))
                    size += len(record)
                    if size >= ARCHIVE_BYTES:
                        yield _record_batch(names, held)
                        held, size = [], 0
                if held:
                    yield _record_batch(names, held)

    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    listed = files.withColumn("name", F.substring_index("path", "/", -1)).join(
        manifest.select("name"), "name", "left_semi")
    return listed.select("content").mapInArrow(read, RECORDS)


def _record_batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)], names)


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url",
                       payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write all pages as archives in the shared folder and read their records back."""
    folder = shared_dir(pages.sparkSession, "warc")
    manifest = write_archives(decided(pages, page_id, url, payload, min_bytes), folder)
    return read_archives(manifest, folder)
