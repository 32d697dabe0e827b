"""Token files of patched frame-of-reference blocks, in ascending document order.

A file holds, one section after the other and little-endian:

* the magic bytes ``LFPFOR1`` and a zero, then four uint64: documents, tokens,
  blocks, exceptions;
* for each document its id (int64, null as the largest) and token count (uint32);
* for each block of 128 tokens its minimum (uint32), the bit width of its packed
  differences (uint8), the first word of its packed part (uint64) and its first
  exception (uint64): any block can be read by itself;
* the packed words (uint64), 2 x width of them to a block;
* for each exception its position in the block (uint8) and whole difference (uint32).

The width holds the ``percentile`` of a block's differences from its minimum;
larger differences are exceptions, whose packed value is zero.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, id_array, id_values, materialise, read_file, shared_dir, task, write_file
from .tokens import encoder, rules

BLOCK = 128
_MAGIC = b"LFPFOR1\x00"
MANIFEST = pa.schema([("part", pa.int32()), ("file_no", pa.int32()), ("folder", pa.string()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
MANIFEST_COLUMNS = "part int, file_no int, folder string, name string, n_docs long, n_tokens long, n_bytes long"
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _bit_width(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def _lanes(width: int):
    """For each of 64 values of a half block: its word, its shift, and whether it runs on into the next word."""
    for k in range(64):
        word, shift = divmod(k * width, 64)
        yield k, word, np.uint64(shift), shift + width > 64, np.uint64(64 - shift if shift else 0)


def pack_blocks(ids: np.ndarray, percentile: float = 0.9) -> tuple[np.ndarray, ...]:
    """(minimum, width, packed words, exceptions' block, position, difference) of ``ids`` in blocks of 128, the last filled up."""
    n = -(-len(ids) // BLOCK)
    v = np.empty(n * BLOCK, np.uint32)
    v[: len(ids)] = ids
    v[len(ids) :] = ids[-1] if len(ids) else 0
    v = v.reshape(n, BLOCK)
    low = v.min(axis=1) if n else np.zeros(0, np.uint32)
    v -= low[:, None]
    k = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = _bit_width(np.partition(v, k, axis=1)[:, k]) if n else np.zeros(0, np.uint8)
    limit = (np.uint64(1) << width.astype(np.uint64)).astype(np.uint64)
    block, position = np.nonzero(v >= limit[:, None])
    difference = v[block, position]
    v[block, position] = 0
    first = np.concatenate([[0], np.cumsum(2 * width.astype(np.int64))])
    words = np.zeros(first[-1], np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        values = np.ascontiguousarray(v[own].reshape(-1, 64).T).astype(np.uint64)
        out = np.zeros((w, 2 * len(own)), np.uint64)
        for k, word, shift, over, back in _lanes(w):
            out[word] |= values[k] << shift
            if over:
                out[word + 1] |= values[k] >> back
        words[first[own][:, None] + np.arange(2 * w)] = out.T.reshape(len(own), 2 * w)
    return low, width, words, block, position.astype(np.uint8), difference


def unpack_blocks(low, width, words, block, position, difference, n: int) -> np.ndarray:
    """The ids that ``pack_blocks`` was given; ``n`` of them."""
    v = np.zeros((len(low), BLOCK), np.uint32)
    first = np.concatenate([[0], np.cumsum(2 * width.astype(np.int64))])
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        packed = np.ascontiguousarray(words[first[own][:, None] + np.arange(2 * w)].reshape(-1, w).T)
        mask = np.uint64((1 << w) - 1)
        out = np.empty((64, 2 * len(own)), np.uint32)
        for k, word, shift, over, back in _lanes(w):
            x = packed[word] >> shift
            if over:
                x |= packed[word + 1] << back
            out[k] = x & mask
        v[own] = out.T.reshape(len(own), BLOCK)
    v[block, position] = difference
    v += low[:, None]
    return v.reshape(-1)[:n]


def file_bytes(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, percentile: float = 0.9) -> bytes:
    low, width, words, block, position, difference = pack_blocks(ids, percentile)
    first_word = (np.cumsum(2 * width.astype(np.int64)) - 2 * width).astype("<u8")
    first_exception = np.searchsorted(block, np.arange(len(low))).astype("<u8")
    head = np.array([len(doc_ids), len(ids), len(low), len(block)], "<u8")
    parts = [head, doc_ids.astype("<i8"), counts.astype("<u4"), low.astype("<u4"), width, first_word, first_exception, words.astype("<u8"), position, difference.astype("<u4")]
    return _MAGIC + b"".join(p.tobytes() for p in parts)


def read_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, token counts, ids) of a file."""
    if data[:8] != _MAGIC:
        raise ValueError("not a token file")
    at = 8

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    n_docs, n_tokens, n_blocks, n_exceptions = map(int, take("<u8", 4))
    docs, counts = take("<i8", n_docs), take("<u4", n_docs)
    low, width = take("<u4", n_blocks), take("u1", n_blocks)
    take("<u8", n_blocks)
    starts = take("<u8", n_blocks)
    words = take("<u8", int(2 * width.astype(np.int64).sum()))
    position, difference = take("u1", n_exceptions), take("<u4", n_exceptions)
    block = np.repeat(np.arange(n_blocks), np.diff(np.concatenate([starts, [n_exceptions]]).astype(np.int64)))
    return docs, counts, unpack_blocks(low, width, words, block, position, difference, n_tokens)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, tokens_per_file: int = 4_000_000, percentile: float = 0.9, folder: str | None = None) -> DataFrame:
    """Encode and write ``docs`` (doc_id, text); returns the manifest, one row a file, in order of (part, file_no).

    Documents are dealt out by ranges of doc_id, nulls last; ties (repeated ids)
    by their texts. A text is never cut; null and empty texts are an end id. A
    repeated task writes files under new names, and only the names that the
    committed task reported are in the manifest. An empty table gives no file.
    """
    folder = folder or shared_dir(docs.sparkSession)
    known = rules(tokenizer)

    def write(batches):
        enc, ids, docs_ids, counts, size, number = encoder(tokenizer, known), [], [], [], 0, 0
        part = TaskContext.get().partitionId()

        def flush():
            nonlocal ids, docs_ids, counts, size, number
            data = file_bytes(np.concatenate(docs_ids), np.concatenate(counts), np.concatenate(ids), percentile)
            name = f"{part:06d}-{number:04d}-{uuid.uuid4().hex}.lfp"
            write_file(folder, name, data)
            row = batch_of(MANIFEST, [part], [number], [folder], [name], [sum(map(len, counts))], [size], [len(data)])
            ids, docs_ids, counts, size, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            names = id_values(batch.column(0))
            for first, found, bounds in enc.encode(batch.column(1), end_id):
                n = np.diff(bounds)
                ids.append(found)
                docs_ids.append(names[first : first + len(n)])
                counts.append(n)
                size += len(found)
                if size >= tokens_per_file:
                    yield flush()
        if size:
            yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id"), F.col("text").cast("string"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    return materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(task(write, keep_caches=True), MANIFEST_COLUMNS))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of a manifest, each file read and unpacked in one task."""
    # Tokens ahead of a file: those of the parts before (a row a part reaches the driver), then those of its part's files.
    parts = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    ahead = np.cumsum([0, *(n for _, n in parts)]).tolist()
    starts = manifest.sparkSession.createDataFrame([(p, a) for (p, _), a in zip(parts, ahead, strict=False)], "of int, ahead long")
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("within", within).join(starts, F.col("part") == F.col("of")).select("folder", "name", (F.col("ahead") + F.col("within")).alias("base"))
    n_files, least = manifest.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(n_files, least), n_files // 8)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                names, counts, ids = read_bytes(read_file(row["folder"], row["name"]))
                bounds = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield batch_of(READ, id_array(names), row["base"] + bounds[:-1], counts.astype(np.int64), crc)

    return files.repartition(n).mapInArrow(task(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
