"""WARC archives compressed record by record under a dictionary that travels in the file.

A file starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary, itself compressed, trained on
records of the same file; each record is a frame of its own, so a reader can start at any record. Pages of equal payload
(``least_bytes`` at least) are archived once: the page of smallest id as response, the others as revisits that name it.

Contract for odd input: a null html is an empty payload; payloads shorter than ``least_bytes`` are always responses; rows
of equal page_id that hold the group's smallest id are all responses; a null page_id is never the smallest unless a group
has no other (all its rows are then responses); a null url leaves out the target; an empty table writes no file; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.runtime import materialize, read_file, scratch_dir, shuffle_partitions, write_file

MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file's dictionary is trained on its first records, up to so many bytes; it is no larger than DICTIONARY.
TRAIN_BYTES, DICTIONARY = 2 << 20, 64 << 10


def _line(name: str, value: str) -> str:
    return f"{name}: {value.replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One WARC record; ``payload`` None makes a revisit."""
    kind = "revisit" if payload is None else "response"
    head = "WARC/1.1\r\n" + _line("WARC-Type", kind) + _line("WARC-Record-ID", f"<urn:page:{page_id}>") + _line("WARC-Date", date)
    if url is not None:
        head += _line("WARC-Target-URI", url)
    head += _line("WARC-Payload-Digest", f"sha256:{digest}") + _line("Content-Type", "application/http; msgtype=response") + _line("X-Payload-Length", str(size))
    if page_id is not None:
        head += _line("X-Page-ID", str(page_id))
    if payload is None:
        head += _line("WARC-Profile", PROFILE) + _line("WARC-Refers-To", f"<urn:page:{refers_to}>")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    return (head + _line("Content-Length", str(len(block))) + "\r\n").encode() + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the records themselves where there are too few to train on; empty for none."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def pack_file(records: list[bytes], level: int = 3) -> bytes:
    """The bytes of one archive file."""
    samples, size = [], 0
    for r in records:
        if size >= TRAIN_BYTES:
            break
        samples.append(r[: DICTIONARY // 2])  # training looks at the start of long records only; all is written whole
        size += len(samples[-1])
    held = _dictionary(samples)
    packed = zstandard.ZstdCompressor(level=19).compress(held)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(held)) if held else zstandard.ZstdCompressor(level=level)
    return struct.pack("<II", MAGIC, len(packed)) + packed + b"".join(compressor.compress(r) for r in records)


def unpack_file(data: bytes) -> Iterator[bytes]:
    """The records of an archive file, one frame at a time."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("the file does not start with a dictionary frame")
    held = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)) if held else zstandard.ZstdDecompressor()
    at = 8 + size
    while at < len(data):
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            piece = data[at : at + (64 << 10)]
            if not piece:
                raise ValueError("the last record is cut off")
            out.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _decided(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with digest, size and, for revisits, refers_to; html is null where it is not to be written."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html").cast("bigint"))
    first = own.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).filter("n > 1").select("digest", "first")
    # small payloads never meet another, so they are dealt by page and not all empty ones to one task
    key = F.when(F.col("size") >= least_bytes, F.col("digest")).otherwise(F.xxhash64("page_id", "url").cast("string"))
    joined = own.withColumn("key", key).join(first.withColumnRenamed("digest", "key"), "key", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "size", F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 100, date: str = "2000-01-01T00:00:00Z", file_bytes: int = 32 << 20) -> DataFrame:
    """Write the pages as archive files of about ``file_bytes`` before compression; return their manifest (path, records)."""
    folder = folder or scratch_dir(pages.sparkSession, "warc")

    def run(batches):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal number, held, size
            path = write_file(folder, f"pages-{part:06d}-{number:06d}.warc.zst", pack_file(held))
            row = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64())], names=["path", "records"])
            number, held, size = number + 1, [], 0
            return row

        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(i)[at].as_py() for i, name in enumerate(batch.schema.names)}
                payload = None if row["html"] is None else row["html"].encode()
                held.append(record(row["page_id"], row["url"], payload, row["digest"], row["size"], row["refers_to"], date))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    return materialize(_decided(pages, least_bytes).mapInArrow(run, "path string, records bigint"), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record.

    A response's digest and size are taken from the payload as read and checked against the header; a revisit's from its header.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for data in unpack_file(read_file(path)):
                    head, payload = parse(data)
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                        raise ValueError(f"{path}: the payload of {head['WARC-Record-ID']} does not match its digest")
                    refers = head.get("WARC-Refers-To")
                    rows.append((int(head["X-Page-ID"]) if "X-Page-ID" in head else None, head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], int(refers[len("<urn:page:") : -1]) if refers else None, payload if with_payload else None))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                width = 7 if with_payload else 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:width], types[:width], strict=True)], names=names[:width])

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    dealt = manifest.select("path").repartition(shuffle_partitions(manifest.sparkSession), "path")
    return dealt.mapInArrow(run, schema + (", payload binary" if with_payload else ""))


READ_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM {pages}),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
