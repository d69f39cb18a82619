"""WARC archives, each compressed record by record with a Zstandard dictionary of its own.

An archive is a skippable frame (magic 0x184D2A5D) that embeds the dictionary, then one frame per record. The dictionary is
trained on the archive's own records; where they are too few or too unlike to train on, it is their beginnings. Archives are rows (name, data)
of a written table, so that any file system Spark reaches will do and an executor's loss costs no more than its tasks;
`parse` reads one, whether it comes from the table or from a file.

Of records with equal payloads that with the largest page_id is a response and the others are revisits of it, which store
no payload. Only (page_id, digest) is grouped; the html of responses moves once, by the unique page_id.

Defined results: a null html is an empty payload. A null page_id is smaller than any other. Rows that share both the
largest page_id and the payload are all responses. Payloads below `least` bytes are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lookup_by_hot_key, release, text_rows, written

DICTIONARY_MAGIC = 0x184D2A5D
#: Raw bytes of the records of one archive, about.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(text: str) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or without payload a revisit record, with its HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    name = "" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Of the records: trained, or where the trainer finds too few of them or too little in common, their beginnings."""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, records)) // 8))
    try:
        return zstandard.train_dictionary(size, records, k=512, d=8)
    except zstandard.ZstdError:
        share = max(256, size // len(records))
        content = b"\n" + b"".join(r[:share] for r in records[: size // 256])  # never taken for a trained one
        return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """The records, one at least, as one archive."""
    own = dictionary(records)
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(own.as_bytes())
    out = [struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed]
    one = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True)
    out += [one.compress(r) for r in records]
    return b"".join(out)


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + size]
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == b"\x28\xb5\x2f\xfd" else raw)
        at = 8 + size
    one = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        out, run = [], one.decompressobj()
        while not run.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            part = data[at : at + 8192]
            out.append(run.decompress(part))
            at += len(part)
        at -= len(run.unused_data)
        yield b"".join(out)


def parse_record(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header fields, the payload's length by the HTTP header, and the payload (empty in a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    n = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    return fields, n, payload


def _page(field: str) -> int | None:
    return int(name) if (name := field.removeprefix("<urn:page:").removesuffix(">")) else None


def parse(data: bytes) -> Iterator[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of each record, digests checked."""
    for raw in frames(data):
        fields, n, payload = parse_record(raw)
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (n != len(payload) or base32_sha1(payload) != digest):
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what was archived")
        yield _page(fields["WARC-Record-ID"]), n, digest, kind, _page(fields["WARC-Refers-To"]) if kind == "revisit" else None, payload


ARCHIVES = pa.schema([("name", pa.string()), ("data", pa.binary()), ("n_records", pa.int64())])


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html (responses only), n_bytes, sha1 (hex) and refers_to of every page."""
    html = F.coalesce("html", F.lit(""))
    wide = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("n_bytes"), F.sha1(html.cast("binary")).alias("sha1"))
    narrow = wide.where(F.col("n_bytes") >= least).select("page_id", "url", "n_bytes", "sha1")
    best = narrow.groupBy("sha1").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = written(lookup_by_hot_key(narrow, best, "sha1").where("page_id < top OR (page_id IS NULL AND top IS NOT NULL)").select("page_id", "url", "n_bytes", "sha1", F.col("top").alias("refers_to")), "revisits")
    gone = revisits.select(F.col("page_id").alias("gone_id"), F.col("sha1").alias("gone_sha1"))
    responses = wide.join(gone, F.col("page_id").eqNullSafe(F.col("gone_id")) & (F.col("sha1") == F.col("gone_sha1")), "left_anti")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits, allowMissingColumns=True)


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """The pages as a written table of archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"name": f"{uuid.uuid4().hex}.warc.zst", "data": archive(held), "n_records": len(held)}], schema=ARCHIVES)

        for page_id, url, html, n_bytes, sha1, refers_to in text_rows(batches):
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            payload = None if html is None else html.encode("utf-8", "surrogatepass")
            held.append(record(page_id, url, payload, n_bytes, digest, refers_to))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    rows = plan_records(pages, least).select("page_id", "url", "html", "n_bytes", "sha1", "refers_to")
    return written(rows.mapInArrow(run, "name string, data binary, n_records long"), "warc")


RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for data in batch.column(0):
                rows = [r[:5] for r in parse(data.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORDS, strict=True)], schema=RECORDS)

    return archives.select("data").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
