r"""Quality rules: statistics of each text, and lines that too many documents of a host share.

Words are runs without ASCII white space. A line's normal form is its words,
A-Z lower-cased and digits as 0, joined by single spaces; its hash goes with the
document's host (source). Documents with the same text count once for a line's
frequency. Distinct (host, line, text) rows are combined before each shuffle, so
a line of a third of all documents is a handful of rows a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, fresh, materialise, task, text_slices, utf8_arrays
from .spans import SpanHasher, byte_hasher, line_spans, repeated, word_spans

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line goes from a host when at least MIN_LINE_DOCS of its documents have it, and more than LINE_SHARE_PERCENT % of them or MAX_LINE_DOCS: in a large host too.
MIN_LINE_DOCS = 10
LINE_SHARE_PERCENT = 5
MAX_LINE_DOCS = 1000
#: A document that loses lines is depleted if less than this share of its words, or fewer than MIN_WORDS, stay.
KEEP_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[48:58] = 48
_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def normal_lines(raw: np.ndarray, offsets: np.ndarray, words):
    """(line starts, ends, documents, words, hashes of normal forms) of every line."""
    starts, ends, doc = line_spans(raw, offsets)
    by_word = SpanHasher(byte_hasher(_NORMAL[raw]).of(words[0], words[1]))
    first, last = np.searchsorted(words[0], starts), np.searchsorted(words[0], ends)
    return starts, ends, doc, last - first, by_word.of(first, last)


def measure(raw: np.ndarray, offsets: np.ndarray):
    """The measures of each text (in the order n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and its lines."""
    n = len(offsets) - 1
    words = word_spans(raw, offsets)
    starts, ends, doc = words
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    np.add.at(inside, ends, -1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8) > 0
    n_words = np.bincount(doc, minlength=n)
    by_byte = byte_hasher(raw)
    by_word = SpanHasher(by_byte.of(starts, ends))
    first = np.cumsum(n_words) - n_words
    window = np.flatnonzero(np.arange(len(starts)) + REPEAT_WINDOW <= (first + n_words)[doc])
    twice, _ = repeated(doc[window], by_word.of(window, window + REPEAT_WINDOW))
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, window[twice], 1)
    np.add.at(depth, window[twice] + REPEAT_WINDOW, -1)
    repeats = np.bincount(doc, weights=np.cumsum(depth[:-1]) > 0, minlength=n).astype(np.int64)
    lines = normal_lines(raw, offsets, words)
    real = np.flatnonzero(lines[3] > 0)
    _, later = repeated(lines[2][real], by_byte.of(lines[0][real], lines[1][real]))
    dup = np.bincount(lines[2][real], weights=later, minlength=n).astype(np.int64)
    return [n_words, count(in_word & ((raw & 0xC0) != 0x80)), count(_SYMBOL[raw]), dup, repeats], lines


def _measured(docs: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """A row for each document: doc_id, source, text hash, measures, and its distinct lines with their words in all."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("text_hash", pa.int64()), *((m, pa.int64()) for m in _MEASURES), ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            raw, offsets = utf8_arrays(batch.column(3))
            for a, b in text_slices(offsets, most_bytes):
                own = offsets[a : b + 1] - offsets[a]
                measures, (_, _, doc, words, key) = measure(raw[offsets[a] : offsets[b]], own)
                order = np.lexsort((key, doc))
                order = order[words[order] > 0]
                d, k = doc[order], key[order]
                new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]))) if len(order) else order
                sums = np.add.reduceat(words[order], new) if len(order) else order
                at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(d[new], minlength=b - a))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (k[new].view(np.int64), sums.astype(np.int64))]
                yield batch_of(schema, *(batch.column(i).slice(a, b - a) for i in range(3)), *measures, *lists)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64("text"), F.col("text").cast("string"))
    return rows.mapInArrow(task(run), "doc_id long, source string, text_hash long, " + ", ".join(f"{m} long" for m in _MEASURES) + ", lines array<long>, line_words array<long>")


def frequent_lines(measured: DataFrame, min_docs: int = MIN_LINE_DOCS, share_percent: int = LINE_SHARE_PERCENT, max_docs: int = MAX_LINE_DOCS) -> DataFrame:
    """(host, line): lines above the limits; a null host is a host of its own."""
    texts = measured.groupBy("source", "text_hash").agg(F.first("lines").alias("lines"))
    hosts = texts.groupBy("source").agg(F.count("*").alias("docs"))
    seen = texts.select("source", F.explode("lines").alias("line")).groupBy("source", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    over = seen.alias("s").join(hosts.alias("h"), F.expr("s.source <=> h.source")).where((100 * F.col("n") > share_percent * F.col("docs")) | (F.col("n") >= max_docs))
    return over.select(F.col("s.source").alias("host"), "line")


def quality(docs: DataFrame, most_broadcast_lines: int = 100_000, with_lines: bool = False) -> DataFrame:
    """(doc_id, measures, base_failed, removed_words, kept) of each row of ``docs`` (doc_id, text, source).

    Null texts have no words and fail the base rules. Rows with the same doc_id
    are judged each by its own text. ``with_lines`` adds source, text_hash and
    the lines to remove (gone). The frequent lines are broadcast only if there
    are at most ``most_broadcast_lines``; otherwise the join shuffles.
    """
    measured = materialise(_measured(docs).withColumn("row", F.monotonically_increasing_id()))
    over = materialise(frequent_lines(measured))
    if over.count() <= most_broadcast_lines:
        over = F.broadcast(over)
    lines = measured.select("row", F.col("source"), F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("row", "source", "l.lines", "l.line_words")
    hit = lines.alias("a").join(over.alias("b"), F.expr("a.lines = b.line AND a.source <=> b.host"))
    gone = hit.groupBy("row").agg(F.sum("line_words").alias("removed_words"), F.collect_list("line").alias("gone")).withColumnRenamed("row", "of")
    out = measured.join(gone, F.col("row") == F.col("of"), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    removed = F.coalesce("removed_words", F.lit(0).cast("long"))
    left = F.col("n_words") - removed
    depleted = (removed > 0) & ((left < MIN_WORDS) | (100 * left < KEEP_PERCENT * F.col("n_words")))
    more = ["source", "text_hash", "gone"] if with_lines else []
    return out.select("doc_id", *_MEASURES, failed.alias("base_failed"), removed.alias("removed_words"), (~failed & ~depleted).alias("kept"), *more)


#: Bytes of verdicts up to which they are broadcast; beyond, the texts are shuffled to them.
MOST_BROADCAST = 32 << 20


def apply_quality(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents and without the lines above the limits (n_chars follows the text)."""
    verdict = quality(docs, with_lines=True).where("NOT kept OR gone IS NOT NULL").select("doc_id", "source", "text_hash", "kept", "gone").dropDuplicates(["doc_id", "source", "text_hash"])
    own = {c: fresh(c) for c in verdict.columns}
    verdict = materialise(verdict.withColumnsRenamed(own))
    size = verdict.agg(F.sum(64 + 8 * F.coalesce(F.size(own["gone"]), F.lit(0)) + F.coalesce(F.octet_length(own["source"]), F.lit(0)))).first()[0] or 0
    if size <= MOST_BROADCAST:
        verdict = F.broadcast(verdict)
    of = {c: F.col(x) for c, x in own.items()}
    same = F.col("doc_id").cast("long").eqNullSafe(of["doc_id"]) & F.col("source").cast("string").eqNullSafe(of["source"]) & (F.xxhash64("text") == of["text_hash"])
    names, mark = docs.columns, own["gone"]
    rows = docs.join(verdict, same, "left").where(F.coalesce(of["kept"], F.lit(True))).select(*(F.col(f"`{c}`") for c in names), of["gone"])
    schema = docs.schema

    def cut(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if batch.column(mark).null_count < batch.num_rows:
                texts = batch.column("text").to_pylist()
                for i, gone in enumerate(batch.column(mark).to_pylist()):
                    if gone:
                        raw = np.frombuffer(texts[i].encode(), np.uint8)
                        offsets = np.array([0, len(raw)])
                        _, _, _, words, key = normal_lines(raw, offsets, word_spans(raw, offsets))
                        out = (words > 0) & np.isin(key.view(np.int64), np.array(gone, np.int64))
                        texts[i] = "\n".join(x for x, drop in zip(texts[i].split("\n"), out.tolist(), strict=True) if not drop)
                table = table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, batch.column("text").type))
                if "n_chars" in names:
                    at = table.schema.get_field_index("n_chars")
                    count = pc.utf8_length(table["text"]).cast(table.schema.field("n_chars").type)
                    table = table.set_column(at, "n_chars", pc.if_else(pc.is_valid(table[mark]), count, table["n_chars"]))
            yield from table.drop_columns([mark]).to_batches()

    return rows.mapInArrow(task(cut), schema)
