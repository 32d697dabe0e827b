"""Removal of byte strings that earlier documents hold: content-chosen cells and two rounds in which Spark brings equal names together.

This is not prefix doubling of all positions' ranks (see the README for what
that costs). What is left of it is inside a task: a position is named for
growing lengths, 16 bytes from the names at offsets 0 and 8, 24 from two of 16,
32 from two of 16 at offset 16, 50 from two of 32 at offset 18. Names are mixes
of the pair and stand in for ranks, so no position is named by a shuffle, and
none has a dense rank.

To have fewer rows than bytes, positions are handled in cells: all windows of
``LENGTH`` bytes whose smallest 24-byte name is at the same place (equal windows
have it at the same offset, so they are in cells that meet).

* Round 1 brings together the cells with equal 24-byte names. A cell is also
  named with all around it that its windows can reach; where a smaller document
  has that whole context, all windows of the cell are repeats. Cells whose name
  is in one document only are unique and drop out. Names that a sample of blocks
  shows to be frequent are dealt out by name and context, and none of their
  contexts drops out: that costs round 2 some rows, and changes no result.
* Round 2 takes the windows of what is left (the first cell of each context
  whose 24-byte name occurs in other contexts: the ends of repeated passages)
  and ranks their names of the full length.

Texts are written once in blocks, bucketed by run of blocks, so no round shuffles text.
Each block sends a name once, with its smallest document: a passage that a third
of the documents share is one entry a block. Windows compare by 96 bits; cells by
the 64 bits of their context and 32 of their name. Buckets are as many as the
bytes of the texts call for, so a task's share does not grow with the table.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, batch_of, id_array, id_values, materialise, mix64, random_words, shared_dir, task, utf8_arrays

LENGTH = 50
GRAM = 24
_AROUND = LENGTH - GRAM
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Offsets of the words of eight bytes that cover a window, and fixed odd factors of its second name.
_COVER = [*range(0, LENGTH - 7, 8), LENGTH - 8]
_FACTORS = random_words(len(_COVER), 23) | np.uint64(1)
#: Text that one bucket of names and one part of the text table stand for, and the sample of blocks that shows frequent names.
BUCKET_BYTES, PART_BYTES, SAMPLE_BLOCKS = 32 << 20, 64 << 20, 64

SENT = pa.schema([("bucket", pa.int32()), ("run", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K1
    x ^= x >> np.uint64(29)
    x += b
    x *= _K2
    x ^= x >> np.uint64(32)
    return x


class Names:
    """Names of positions of a byte array; ``at`` must leave room for the length."""

    def __init__(self, raw: np.ndarray):
        self.words = np.ndarray((max(0, len(raw) - 7),), "<u8", buffer=np.ascontiguousarray(raw), strides=(1,)) if len(raw) > 7 else np.zeros(0, np.uint64)

    def all_grams(self, first: int, last: int) -> np.ndarray:
        """Names of ``GRAM`` bytes at first..last-1."""
        x8 = np.array(self.words[first : last + GRAM - 8])
        x16 = _pair(x8[:-8], x8[8:])
        return _pair(x16[:-8], x16[8:])

    def _n16(self, at):
        return _pair(self.words[at], self.words[at + 8])

    def _n32(self, at):
        return _pair(self._n16(at), self._n16(at + 16))

    def windows(self, at: np.ndarray) -> np.ndarray:
        """Names of ``LENGTH`` bytes."""
        return _pair(self._n32(at), self._n32(at + LENGTH - 32))

    def second(self, at: np.ndarray) -> np.ndarray:
        """Another name of ``LENGTH`` bytes, in 32 bits: a sum of products."""
        x = np.zeros(len(at), np.uint64)
        for offset, factor in zip(_COVER, _FACTORS, strict=True):
            x += self.words[at + offset] * factor
        return mix64(x) >> np.uint64(32)


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    span, out = 1, x
    while 2 * span <= n:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - span : n - span + len(x) - n + 1])


class Cells:
    """The cells of a block: first window, number of windows, document, gram name, context name; and the distinct (gram, context) pairs."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, slice_bytes: int = 1 << 19):
        self.names = Names(raw)
        first, count, place, gram = [], [], [], []
        n_windows = len(raw) - LENGTH + 1
        for low in range(0, max(0, n_windows), slice_bytes):
            high = min(n_windows, low + slice_bytes)
            names = self.names.all_grams(low, high + _AROUND)
            key = (names & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(names), dtype=np.uint64)
            least = (_sliding_least(key, _AROUND + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
            window = np.ones(high - low, bool)
            for end in offsets[np.searchsorted(offsets, low, side="right") :].tolist():
                if end - LENGTH + 1 >= high:
                    break
                window[max(0, end - LENGTH + 1 - low) : max(0, end - low)] = False
            own = np.flatnonzero(window)
            if not len(own):
                continue
            at = least[own]
            edge = np.flatnonzero(np.diff(at, prepend=-1))
            first.append(own[edge] + low)
            count.append(np.diff(np.append(edge, len(own))))
            place.append(at[edge] + low)
            gram.append(names[at[edge]])
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.first, self.count, self.place, self.gram = join(first, np.int64), join(count, np.int64), join(place, np.int64), join(gram, np.uint64)
        self.doc = np.searchsorted(offsets, self.first, side="right") - 1
        start = np.maximum(offsets[self.doc], self.place - _AROUND)
        end = np.minimum(offsets[self.doc + 1], self.place + LENGTH)
        shape = ((self.place - start) * 128 + end - self.place).astype(np.uint64)
        context = _pair(_pair(self.names.windows(start), self.names.windows(end - LENGTH)), shape) if len(start) else np.zeros(0, np.uint64)
        self.context = context
        _, self.pick, self.pair = np.unique(_pair(self.gram, context), return_index=True, return_inverse=True)


def _smallest(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, NULL_ID, np.int64)
    np.minimum.at(out, group, value)
    return out


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    # The names of cells are the smallest around: mixed again they fill all buckets alike.
    return ((mix64(names) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _cut(x: np.ndarray, n: int) -> np.ndarray:
    """The low ``n`` bytes of each value."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n]


def _whole(data: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = data.reshape(-1, n)
    return out.view("<u8").reshape(-1)


def _by_bucket(bucket: np.ndarray, doc: np.ndarray):
    """Yields (bucket, indices) with each bucket's entries by document: the order in which answers come back."""
    order = np.lexsort((doc, bucket))
    edge = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    ends = [*edge[1:].tolist(), len(order)]
    for a, b in zip(edge.tolist(), ends, strict=False):
        yield int(bucket[order[a]]), order[a:b]


def _width(most: int) -> int:
    return next(n for n in (1, 2, 4, 8) if n == 8 or most < 1 << 8 * n)


def _payload(doc: np.ndarray, *parts: tuple[np.ndarray, int]) -> bytes:
    """Documents once each, as distances from the smallest, with how many entries they have, then the entries."""
    ids, counts = np.unique(doc, return_counts=True)
    far = ids.view(np.uint64) - ids[:1].view(np.uint64)
    wide = _width(int(far[-1])), _width(int(counts.max()))
    head = np.array([len(ids), len(doc), *wide], "<u4").tobytes() + ids[:1].astype("<i8").tobytes() + _cut(far, wide[0]).tobytes() + _cut(counts, wide[1]).tobytes()
    return head + b"".join(_cut(x, n).tobytes() for x, n in parts)


def _open(payload: bytes, sizes: list[int]) -> list[np.ndarray]:
    m, n, *wide = np.frombuffer(payload, "<u4", 4).tolist()
    low, at = np.frombuffer(payload, "<i8", 1, 16).view(np.uint64), 24
    out = []
    for many, size in ((m, wide[0]), (m, wide[1]), *((n, size) for size in sizes)):
        out.append(_whole(np.frombuffer(payload, np.uint8, many * size, at), size))
        at += many * size
    return [np.repeat((out[0] + low).view(np.int64), out[1].astype(np.int64)), *out[2:]]


def rank_cells(gram: np.ndarray, context: np.ndarray, doc: np.ndarray, frequent: bool = False) -> np.ndarray:
    """Round 1: 1 where a smaller document has the context, 2 for the first of a context whose gram occurs elsewhere too (or is ``frequent``), else 0."""
    state = np.zeros(len(gram), np.uint8)
    order = np.argsort(gram)
    new = np.diff(gram[order], prepend=~gram[order[:1]]) != 0 if len(order) else np.zeros(0, bool)
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    own = order if frequent else order[np.repeat(size > 1, size)]
    own = own[np.lexsort((doc[own], context[own], gram[own]))]
    if not len(own):
        return state
    g, c, d = gram[own], context[own], doc[own]
    new_gram = np.append(True, g[1:] != g[:-1])
    new_context = new_gram | np.append(True, c[1:] != c[:-1])
    least = d[np.flatnonzero(new_context)][np.cumsum(new_context) - 1]
    group = np.cumsum(new_gram) - 1
    heads = np.flatnonzero(new_context)
    low = np.full(group[-1] + 1, NULL_ID, np.int64)
    high = np.full(group[-1] + 1, -(2**63), np.int64)
    np.minimum.at(low, group[heads], d[heads])
    np.maximum.at(high, group[heads], d[heads])
    state[own] = np.where(d > least, 1, np.where(frequent | (low < high)[group], 2, 0))
    return state


def rank_windows(name: np.ndarray, second: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Round 2: 1 where a smaller document has the window."""
    state = np.zeros(len(name), np.uint8)
    order = np.lexsort((doc, second, name))
    if len(order):
        a, b, d = name[order], second[order], doc[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        state[order] = d > d[new][np.cumsum(new) - 1]
    return state


def _answer(sent: DataFrame, buckets: int, sizes: list[int], rank) -> DataFrame:
    """Bring the entries of a bucket together, rank them, and hand each block what it asked for: (run, block, answers)."""

    def run(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        # Hashing puts several buckets in some partitions: they are ranked one after the other.
        for bucket, own in groupby(rows, key=lambda row: row[0]):
            own = list(own)
            parts = [_open(row[3], sizes) for row in own]
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            counts = [len(part[0]) for part in parts]
            del parts
            state = rank(bucket, *columns[1:], columns[0])
            at = 0
            for (_, run_, block, _), n in zip(own, counts, strict=True):
                yield batch_of(SENT, [bucket], [run_], [block], [zlib.compress(state[at : at + n].tobytes(), 1)])
                at += n

    told = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(task(run), "bucket int, run long, block long, payload binary")
    return materialise(told.groupBy("run", "block").agg(F.collect_list(F.struct("bucket", "payload")).alias("answers")))


def text_blocks(docs: DataFrame, parts: int, block_bytes: int = 2_000_000, blocks_per_run: int = 32) -> DataFrame:
    """Texts in blocks of whole documents of about ``block_bytes``, written once in the shared folder, bucketed by run of blocks.

    A run is one file, so files number a few for each task that reads the input.
    The other columns of ``docs`` go along as they are, as structs (carry). The
    table's name is taken back at once; its files stay until the caller clears
    the shared folder.
    """
    spark = docs.sparkSession

    def gather(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, sizes, carry, raw, size = [], [], [], [], 0

        def flush():
            nonlocal ids, sizes, carry, raw, size, number
            lists = [np.concatenate(ids), np.concatenate(sizes), pa.concat_arrays(carry)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x)) for x in lists]
            row = [pa.array([part << 24 | number // blocks_per_run]), pa.array([part << 32 | number]), *lists, pa.array([b"".join(raw)], pa.large_binary())]
            ids, sizes, carry, raw, size, number = [], [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays(row, names=["run", "block", "ids", "sizes", "carry", "raw"])

        for batch in batches:
            names = id_values(batch.column(0))
            data, offsets = utf8_arrays(batch.column(1))
            first = 0
            while first < len(names):
                last = int(np.searchsorted(offsets, offsets[first] + block_bytes - size, side="right")) - 1
                last = min(max(last, first + 1), len(names))
                ids.append(names[first:last])
                sizes.append(np.diff(offsets[first : last + 1]))
                carry.append(batch.column(2).slice(first, last - first))
                raw.append(data[offsets[first] : offsets[last]].tobytes())
                size += len(raw[-1])
                first = last
                if size >= 0.9 * block_bytes or len(ids) > 10_000:
                    yield flush()
        if ids:
            yield flush()

    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (F.struct(*others) if others else F.lit(None).cast("string")).alias("carry"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("run", T.LongType()), T.StructField("block", T.LongType()), T.StructField("ids", longs), T.StructField("sizes", longs), T.StructField("carry", T.ArrayType(rows.schema["carry"].dataType)), T.StructField("raw", T.BinaryType())])
    name = f"levelforge_{uuid.uuid4().hex}"
    rows.mapInArrow(task(gather), schema).write.format("parquet").option("compression", "zstd").option("path", shared_dir(spark)).bucketBy(parts, "run").saveAsTable(name)
    blocks = spark.table(name)
    blocks.schema  # resolved: from here on the files are what counts
    spark.sql(f"DROP TABLE {name}")
    return blocks


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def drop_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Remove each byte of a string of ``LENGTH`` bytes that also starts in a document with a smaller doc_id.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256); ``with_text``
    adds the kept text, cut at whole characters (a character of which a byte
    stays, stays), and the other columns of ``docs`` as a struct (carry). Matches
    never cross documents and are judged on the texts as given. A null text is
    empty; a null doc_id is larger than any other; rows with the same doc_id
    never remove from each other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    least = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts, buckets = max(least, n_bytes // PART_BYTES), max(least, n_bytes // BUCKET_BYTES)
    blocks = text_blocks(docs if with_text else docs.select("doc_id", "text"), parts)

    def cells_of(row):
        offsets = np.concatenate([[0], np.cumsum(np.array(row["sizes"], np.int64))])
        raw = np.frombuffer(row["raw"], np.uint8)
        return np.array(row["ids"], np.int64), raw, offsets, Cells(raw, offsets)

    def rows_of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield {name: batch.column(j)[i].values if name == "carry" else batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}

    def count_grams(batches):
        schema = pa.schema([("gram", pa.int64()), ("n", pa.int64()), ("entries", pa.int64())])
        for row in rows_of(batches):
            _, _, _, cells = cells_of(row)
            gram, n = np.unique(cells.gram[cells.pick], return_counts=True)
            many = n > 1
            yield batch_of(schema, gram[many].view(np.int64), n[many], np.full(int(many.sum()), len(cells.pick)))

    def frequent_grams() -> np.ndarray:
        """Names that would be over an eighth of a bucket, by a sample of blocks; how entries are dealt, not what is found, depends on it."""
        n_blocks = blocks.count()
        some = blocks.where(F.pmod(F.xxhash64("block"), F.lit(1 << 20)) * n_blocks < SAMPLE_BLOCKS << 20).select("ids", "sizes", "raw").mapInArrow(task(count_grams), "gram long, n long, entries long")
        n = some.groupBy("gram").agg(F.sum("n").alias("n"), F.max("entries").alias("entries"))
        share = F.col("n") * 8 * buckets > F.col("entries") * min(n_blocks, SAMPLE_BLOCKS)
        return np.sort(n.where((F.col("n") >= 8) & share).select("gram").toArrow()["gram"].to_numpy().view(np.uint64))

    frequent = spark.sparkContext.broadcast(frequent_grams())

    def cell_entries(ids, cells):
        doc = _smallest(cells.pair, ids[cells.doc], len(cells.pick))
        gram, known = cells.gram[cells.pick], frequent.value
        at = np.minimum(np.searchsorted(known, gram), max(0, len(known) - 1))
        spread = known[at] == gram if len(known) else np.zeros(len(gram), bool)
        # Buckets from ``buckets`` on hold frequent names, dealt by context.
        bucket = np.where(spread, buckets + _bucket(_pair(gram, cells.context[cells.pick]), buckets), _bucket(gram, buckets))
        return doc, gram, list(_by_bucket(bucket, doc))

    def send_cells(batches):
        for row in rows_of(batches):
            ids, _, _, cells = cells_of(row)
            doc, gram, dealt = cell_entries(ids, cells)
            context = cells.context[cells.pick]
            for bucket, own in dealt:
                yield batch_of(SENT, [bucket], [row["run"]], [row["block"]], [_payload(doc[own], (gram[own], 4), (context[own], 8))])

    def told(dealt, answers, n):
        state = np.zeros(n, np.uint8)
        given = {a["bucket"]: a["payload"] for a in answers or []}
        for bucket, own in dealt:
            if bucket in given:
                state[own] = np.frombuffer(zlib.decompress(given[bucket]), np.uint8)
        return state

    def open_windows(row, ids, cells):
        """Windows of cells that are repeats as a whole, and those that round 2 decides."""
        doc, _, dealt = cell_entries(ids, cells)
        state = told(dealt, row["answers"], len(cells.pick))[cells.pair]
        # A context that is new in the block's smallest document repeats in the block's others.
        state = np.where(ids[cells.doc] > doc[cells.pair], 1, state)
        spread = lambda own: np.repeat(cells.first[own] - np.cumsum(cells.count[own]) + cells.count[own], cells.count[own]) + np.arange(int(cells.count[own].sum()))
        sure, asked = spread(np.flatnonzero(state == 1)), np.flatnonzero(state == 2)
        open_ = spread(asked)
        owner = ids[np.repeat(cells.doc[asked], cells.count[asked])]
        name, second = (cells.names.windows(open_), cells.names.second(open_)) if len(open_) else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        order = np.lexsort((second, name))
        new = np.append(True, (name[order][1:] != name[order][:-1]) | (second[order][1:] != second[order][:-1]))[: len(order)]
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        name, second = name[order][new], second[order][new]
        least = _smallest(pair, owner, len(name))
        return sure, open_, owner, (name, second), pair, least, list(_by_bucket(_bucket(name, buckets), least))

    def send_windows(batches):
        for row in rows_of(batches):
            ids, _, _, cells = cells_of(row)
            _, _, _, (name, second), _, least, dealt = open_windows(row, ids, cells)
            for bucket, own in dealt:
                yield batch_of(SENT, [bucket], [row["run"]], [row["block"]], [_payload(least[own], (name[own], 8), (second[own], 4))])

    def finish(batches):
        for row in rows_of(batches):
            ids, raw, offsets, cells = cells_of(row)
            sure, open_, owner, _, pair, least, dealt = open_windows(row, ids, cells)
            state = told(dealt, row["more"], len(least))
            repeats = np.concatenate([sure, open_[(state[pair] == 1) | (owner > least[pair])]]) if len(open_) else sure
            depth = np.zeros(len(raw) + 1, np.int32)
            np.add.at(depth, repeats, 1)
            np.add.at(depth, repeats + LENGTH, -1)
            gone = np.cumsum(depth[:-1]) > 0
            yield from results(row, ids, raw, offsets, gone)

    def results(row, ids, raw, offsets, gone):
        total = np.concatenate([[0], np.cumsum(gone)])
        before = np.append(False, gone[:-1])
        before[offsets[:-1][offsets[:-1] < len(gone)]] = False
        begun = np.concatenate([[0], np.cumsum(gone & ~before)])
        kept = raw[~gone].tobytes()
        at = offsets - total[offsets]
        sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        columns = [id_array(ids), np.diff(offsets), np.diff(total[offsets]), np.diff(begun[offsets]), sha]
        if not with_text:
            yield batch_of(KEPT, *columns)
            return
        # A character goes only with all its bytes.
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        if len(lead):
            whole = np.minimum.reduceat(gone, lead)
            gone = np.repeat(whole, np.diff(np.append(lead, len(raw))))
        total = np.concatenate([[0], np.cumsum(gone)])
        text = raw[~gone].tobytes()
        at = offsets - total[offsets]
        texts = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
        schema = KEPT.append(pa.field("text", pa.string())).append(pa.field("carry", row["carry"].type))
        yield batch_of(schema, *columns, texts, row["carry"])

    def with_answers(rows, answers, name):
        """Left join by run and block. The table is bucketed by run alone: the block is compared beside the key, so no text moves."""
        told = answers.select(F.col("run").alias("told_run"), F.col("block").alias("told_block"), F.col("answers").alias(name)).hint("shuffle_hash")
        return rows.join(told, (F.col("run") == F.col("told_run")) & (F.col("block") - F.col("told_block") == 0), "left").drop("told_run", "told_block")

    columns = ["run", "block", "ids", "sizes", "raw"]
    sent = "bucket int, run long, block long, payload binary"
    first = _answer(blocks.select(*columns).mapInArrow(task(send_cells), sent), buckets, [4, 8], lambda bucket, *x: rank_cells(*x, frequent=bucket >= buckets))
    joined = with_answers(blocks, first, "answers")
    second = _answer(joined.select(*columns, "answers").mapInArrow(task(send_windows), sent), buckets, [8, 4], lambda _, *x: rank_windows(*x))
    joined = with_answers(joined, second, "more")
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.type == pa.string() else T.LongType()) for f in KEPT])
    if with_text:
        schema = schema.add("text", "string").add("carry", blocks.schema["carry"].dataType.elementType)
    return joined.select(*columns, "answers", "more", *(["carry"] if with_text else [])).mapInArrow(task(finish), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeats cut from the texts (n_chars follows); every row stays, other columns as they are. A null text comes back empty."""
    out = drop_repeats(docs, with_text=True)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    at = {c: F.col(f"carry.c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")} | columns
    return out.select(*(at[f.name].cast(f.dataType).alias(f.name) for f in docs.schema.fields))
