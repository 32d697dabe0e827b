"""WARC archives with a Zstandard dictionary of their own.

Each file starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; every record after it is a frame compressed with it, so one record
can be read by its offset. Every file has a dictionary from its own records:
trained, or, where they are too few to train on, records as they are. Payloads of
at least ``min_revisit_bytes`` that occur before (by page_id) are revisit records
that name the first page; digests and first pages come from one grouping by
digest. A record's id is made of its page and digest; rows that agree in both
carry a number after it, but for one of them.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, batch_of, id_array, materialise, read_file, shared_dir, task, write_file

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = pa.schema([("folder", pa.string()), ("name", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("dictionary_bytes", pa.int64())])
FILE_COLUMNS = "folder string, name string, n_records long, n_bytes long, dictionary_bytes long"
RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
RECORD_COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(page_id: int, digest: str, number: int | None = None) -> str:
    return f"<urn:page:{'null' if page_id == NULL_ID else page_id}:{digest[:32]}{'' if number is None else f':{number}'}>"


def _page_id(urn: str) -> int:
    value = urn.strip("<>").split(":")[2]
    return NULL_ID if value == "null" else int(value)


#: Compressed bytes that a reader takes at once.
WINDOW = 1 << 12


def record_bytes(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None, date: str, number: int | None = None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, digest, number)}", f"WARC-Date: {date}", f"WARC-Target-URI: {''.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def train_dictionary(records: list[bytes], dictionary_bytes: int = 32_768, sample_bytes: int = 1_500_000) -> bytes:
    """A dictionary of at most ``dictionary_bytes`` and a tenth of the records, from whole records spread over the file, about ``sample_bytes`` of them.

    What is too little to train on becomes a dictionary of plain content. Empty
    without records.
    """
    total = sum(map(len, records))
    samples = records[:: max(1, -(-total // sample_bytes))]
    size = min(dictionary_bytes, max(1024, total // 10))
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def archive_bytes(records: list[bytes], dictionary: bytes, level: int = 3) -> bytes:
    given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compressor = zstandard.ZstdCompressor(level=level, dict_data=given)
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary + b"".join(map(compressor.compress, records))


def read_archive(data: bytes):
    """Yields the records of an archive, one after the other; each is fed ``WINDOW`` bytes at a time, so nothing after it is copied."""
    magic, n = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    given = zstandard.ZstdCompressionDict(data[8 : 8 + n]) if n else None
    reader = zstandard.ZstdDecompressor(dict_data=given)
    view, at = memoryview(data), 8 + n
    while at < len(view):
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            piece = view[at : at + WINDOW]
            if not piece:
                raise ValueError("the last record is cut off")
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def write_archives(pages: DataFrame, min_revisit_bytes: int = 100, bytes_per_file: int = 16_000_000, date: str = "2024-01-01T00:00:00Z", folder: str | None = None) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns one row a file.

    A null html is an empty payload, a null page_id comes after all others. Of
    equal payloads of at least ``min_revisit_bytes`` bytes, rows with the
    smallest page_id are responses, the rest revisits of it; shorter ones are
    all responses. Orphans of repeated tasks are in no manifest row.
    """
    folder = folder or shared_dir(pages.sparkSession)
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("page_id"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    seen = materialise(rows.select("page_id", "digest", (F.octet_length("html") >= min_revisit_bytes).alias("long")).groupBy("page_id", "digest", "long").agg(F.count("*").alias("times")))
    first = seen.where("long").groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    revisit = seen.where("long").join(first, "digest").where("page_id <> refers_to").select(F.col("page_id").alias("again"), F.col("digest").alias("again_digest"), "refers_to")
    many = materialise(seen.where("times > 1").select(F.col("page_id").alias("many"), F.col("digest").alias("many_digest")))
    number = F.lit(None).cast("long")
    if many.head(1):
        # Rows that agree in page and digest are written once more, numbered; the smallest number gives its place to the plain id.
        twin = (F.col("page_id") == F.col("many")) & (F.col("digest") == F.col("many_digest"))
        numbered = materialise(rows.join(many, twin, "left_semi").withColumn("number", F.monotonically_increasing_id()))
        plain = numbered.groupBy("page_id", "digest").agg(F.min("number").alias("number")).select("number")
        numbered = numbered.join(plain.select(F.col("number").alias("plain")), F.col("number") == F.col("plain"), "left").select("page_id", "url", "html", "digest", F.when(F.col("plain").isNull(), F.col("number")).alias("number"))
        rows = rows.join(many, twin, "left_anti").withColumn("number", number).unionByName(numbered)
    else:
        rows = rows.withColumn("number", number)
    known = rows.join(revisit, (F.col("page_id") == F.col("again")) & (F.col("digest") == F.col("again_digest")), "left").select("page_id", "url", "html", "digest", "refers_to", "number")

    def write(batches):
        records, size = [], 0
        part = TaskContext.get().partitionId()

        def flush():
            nonlocal records, size
            dictionary = train_dictionary(records)
            data = archive_bytes(records, dictionary)
            name = f"{part:06d}-{uuid.uuid4().hex}.warc.zst"
            write_file(folder, name, data)
            row = batch_of(FILES, [folder], [name], [len(records)], [len(data)], [len(dictionary)])
            records, size = [], 0
            return row

        for batch in batches:
            page, url, html, sha, refers, number = (batch.column(i) for i in range(6))
            html = html.cast(pa.large_binary())
            for i, p in enumerate(page.to_pylist()):
                records.append(record_bytes(p, url[i].as_py(), html[i].as_py(), sha[i].as_py(), refers[i].as_py(), date, number[i].as_py()))
                size += len(records[-1])
                if size >= bytes_per_file:
                    yield flush()
        if records:
            yield flush()

    return materialise(known.mapInArrow(task(write), FILE_COLUMNS))


def read_archives(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, from the archives alone.

    A response's size and digest are computed from its payload and must be
    those of its header; a revisit has them from its header.
    """
    n_files, least = files.count(), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(n_files, least), n_files // 8)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for record in read_archive(read_file(row["folder"], row["name"])):
                    fields, http, payload = parse_record(record)
                    said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (said, int(http["Content-Length"])):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {row['name']}")
                    refers = fields.get("WARC-Refers-To")
                    out.append((_page_id(fields["WARC-Record-ID"]), int(http["Content-Length"]), said, fields["WARC-Type"], None if refers is None else _page_id(refers)))
                page, size, sha, kind, refers = zip(*out, strict=True)
                yield batch_of(RECORDS, id_array(np.array(page, np.int64)), size, sha, kind, refers)

    return files.select("folder", "name").repartition(n).mapInArrow(task(read), RECORD_COLUMNS)
