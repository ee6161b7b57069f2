"""WARC archives with a dictionary: a Zstandard dictionary is built from an archive's own records and leads the
file in a skippable frame; each record is a frame of its own behind it.

Tasks write files under fresh names into the shared folder and return a manifest row for each; only files of
the manifest are ever read, so what a lost or repeated task left behind does not count.

Defined cases: a null html is an empty payload; equal payloads (empty ones too) from min_bytes on are revisits of the
one with the smallest page_id; rows that repeat a page_id with the same payload are alike (all responses, or all
revisits); a null page_id is never the one referred to unless all are null; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, staged, table

#: Raw bytes of records in an archive, bytes of it that train its dictionary in windows of so many, and the dictionary's
#: size; archives that a task reads back.
ARCHIVE_BYTES, SAMPLE_BYTES, WINDOW_BYTES, DICTIONARY_BYTES, ARCHIVES_A_TASK = 8_000_000, 1_500_000, 4096, 32_768, 2
#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url or '')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on windows that are spread evenly over all the archive's records; raw content where too few to train on."""
    size = sum(map(len, records))
    every = max(1, -(-size // SAMPLE_BYTES))
    # The archive's bytes in windows; each `every`-th is taken, wherever its record begins.
    sample, at = [], 0
    for r in records:
        first = -(at // WINDOW_BYTES) % every
        sample += [w for k in range(first * WINDOW_BYTES, len(r), every * WINDOW_BYTES) if (w := r[k : k + WINDOW_BYTES])]
        at += -(-len(r) // WINDOW_BYTES) * WINDOW_BYTES
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    words = dictionary(records)
    packed = zstandard.ZstdCompressor(level=3).compress(words.as_bytes())
    writer = zstandard.ZstdCompressor(level=6, dict_data=words)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(packed)), packed, *map(writer.compress, records)])


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame after another."""
    mark, size = struct.unpack_from("<II", data)
    if mark != DICTIONARY_FRAME:
        raise ValueError("no dictionary in front")
    words = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    trained = words[:4] == b"\x37\xa4\x30\xec"
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT))
    rest = memoryview(data)[8 + size :]
    while rest:
        one = reader.decompressobj()
        parts = [one.decompress(rest[:65536])]
        used = min(65536, len(rest))
        while not one.eof:
            if used >= len(rest):
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(rest[used : used + 65536]))
            used = min(used + 65536, len(rest))
        yield b"".join(parts)
        rest = rest[used - len(one.unused_data) :]


def parse(data: bytes) -> dict:
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {"fields": fields, "payload": payload, "length": length}


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that repeat an earlier payload of min_bytes or more. Narrow rows only."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    ids = pages.filter(F.octet_length(payload) >= min_bytes).select("page_id", F.sha1(payload.cast("binary")).alias("digest"))
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return ids.join(first, "digest").filter("page_id is null or page_id <> refers_to").filter("refers_to is not null").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives below a folder; returns the manifest (path, n_records, n_bytes) as a stored table."""
    # A stored table of narrow rows: where its files are small, Spark sends it to the tasks and no page is shuffled.
    known = staged(revisits(pages, min_bytes).withColumnsRenamed({"page_id": "_p", "digest": "_d"}), "warc-revisits")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    joined = rows.join(known, F.col("page_id").eqNullSafe(F.col("_p")) & (F.sha1(F.col("html").cast("binary")) == F.col("_d")), "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        kept: list[bytes] = []

        def close() -> pa.RecordBatch:
            name = f"{root}/{uuid.uuid4().hex}.warc.zst"
            data = archive(kept)
            with where.open_output_stream(name, compression=None) as out:
                out.write(data)
            n = len(kept)
            kept.clear()
            return pa.RecordBatch.from_pydict({"path": [name], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([len(data)], pa.int64())})

        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(start, 500).columns), strict=True):
                    kept.append(record(page_id, url, html.encode(), refers_to))
                    size += len(kept[-1])
                    if size >= archive_bytes:
                        yield close()
                        size = 0
        if kept:
            yield close()

    return staged(joined.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of all records; payload null for revisits.

    A response whose payload does not fit its digest and length is an error.
    """
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(folder)

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with where.open_input_stream(path, compression=None) as f:
                    data = f.read()
                rows = []
                for one in map(parse, read_archive(data)):
                    h, digest = one["fields"], one["fields"]["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = h["WARC-Type"] == "response"
                    if response and (len(one["payload"]) != one["length"] or base64.b32encode(hashlib.sha1(one["payload"]).digest()).decode() != digest):
                        raise ValueError(f"{path}: a payload does not fit its digest")
                    number = lambda x: int(x) if x else None
                    rows.append((number(h.get("X-Page-Id")), h["WARC-Target-URI"], one["payload"] if response else None, one["length"], digest, h["WARC-Type"], number(h.get("X-Refers-To-Page"))))
                    if len(rows) == 500:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    tasks = max(1, -(-manifest.count() // ARCHIVES_A_TASK))
    return manifest.select("path").repartition(tasks, "path").mapInArrow(run, schema)


def op9(spark, sf_dir):
    folder = fresh_dir(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Five hex digits of the SHA-1 are four letters of base 32.
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {k}, 5) AS BIGINT) >> {b}) & 31 AS INT) + 1, 1)" for k in range(1, 41, 5) for b in (15, 10, 5, 0))
OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f
"""
