"""Best-fit-decreasing packing of token pieces into fixed-length sequences.

Token lengths are integers up to the capacity, so the packing is decided on how
many pieces there are of each length: at most ``capacity`` counts reach the
driver, whatever the size of the table. Open bins are kept by their remaining
capacity, in runs of bins that are alike; a segment tree over the capacities
finds the tightest one that fits in logarithmic time. What it decides for a run
of pieces of one length is one row of a plan (some ten thousand rows at most);
each piece finds its row by its length and its rank among pieces of that
length. The result is that of best-fit decreasing over the whole table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, id_array, id_values, materialise, task
from .tokens import encoder, rules

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Encode whole texts and cut only what is longer than ``capacity``.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty
    text is a document of the end id alone. ``with_ids`` adds the ids
    themselves (column ids). Repeated rows give repeated pieces.
    """
    schema = PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECES

    known = rules(tokenizer)

    def cut(batches):
        enc = encoder(tokenizer, known)
        for batch in batches:
            docs_ids = id_values(batch.column(0))
            for first, ids, bounds in enc.encode(batch.column(1), end_id):
                n = np.diff(bounds)
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                at = bounds[row] + start
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                out = [id_array(docs_ids[first : first + len(n)][row]), piece, start, length, crc]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([at, bounds[-1:]]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield batch_of(schema, *out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task(cut, keep_caches=True), PIECE_COLUMNS + (", ids array<int>" if with_ids else ""))


class CapacityTree:
    """Segment tree over remaining capacities 0..n: which of them have an open bin."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = bytearray(2 * self.size)

    def mark(self, capacity: int, is_open: bool) -> None:
        i = self.size + capacity
        self.open[i] = is_open
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, need: int) -> int:
        """The smallest open capacity of at least ``need``, or -1."""
        i = self.size + need
        if self.open[i]:
            return need
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over ``counts`` pieces of each length.

    Rows (length, first rank, first bin, pieces to a bin, offset in the bin),
    by falling length and rising rank. A run of ``m`` bins of one capacity
    takes ``capacity // length`` pieces each before the next run is touched,
    which is what one piece after the other would do: a bin just used stays
    the tightest while it fits.
    """
    tree = CapacityTree(capacity)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    plan, bins = [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if not runs[left]:
                tree.mark(left, True)
            runs[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.tightest(length)
            if left < 0:
                left, first, n = capacity, bins, -(-todo // (capacity // length))
                bins += n
            else:
                first, n = runs[left].pop()
                if not runs[left]:
                    tree.mark(left, False)
            each = left // length
            plan.append((length, rank, first, each, capacity - left))
            placed = min(todo, n * each)
            full, rest = divmod(placed, each)
            put(left - each * length, first, full)
            if rest:
                put(left - rest * length, first + full, 1)
            put(left, first + full + bool(rest), n - full - bool(rest))
            rank, todo = rank + placed, todo - placed
    return np.array(plan, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 2048, rows_per_bucket: int = 100_000) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, start, length, ids_crc32).

    Each piece keeps its length (1 to ``capacity``; others raise an error) and
    is placed whole; offsets of a sequence are gapless from 0. Ranks within a
    length come from counts by (bucket, length) and a row number within each,
    so a length that a third of the pieces share is spread over all buckets.
    An empty table gives an empty result; ties keep any order among equals.
    """
    spark = pieces.sparkSession
    pieces = materialise(pieces)
    buckets = max(64, pieces.count() // rows_per_bucket)
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = placed.groupBy("bucket", "length").count()
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    if any(not 0 < n <= capacity for n in totals):
        raise ValueError(f"piece lengths must be from 1 to {capacity}")
    plan = best_fit_plan(totals, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast((plan[:, 0] << 44 | plan[:, 1], plan))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")
    starts = counts.select(F.col("bucket").alias("b"), F.col("length").alias("l"), before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = placed.withColumn("rank", rank).join(starts, (F.col("bucket") == F.col("b")) & (F.col("length") == F.col("l")))
    columns = [f.name for f in pieces.schema.fields]
    ranked = ranked.select(*columns, (F.col("rank") + F.col("before")).alias("rank"))

    def assign(batches):
        keys, rows = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = rows[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            order = rank - row[:, 1]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(row[:, 2] + order // row[:, 3]), pa.array(row[:, 4] + order % row[:, 3] * length)], names=[*columns, "sequence_id", "offset"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(task(assign, keep_caches=True), f"{types}, sequence_id long, offset long")
