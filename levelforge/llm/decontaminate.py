"""Benchmark decontamination through templates.

Words lose their punctuation and case; numbers, units after numbers, and
capitalised words inside a sentence become typed placeholders. Windows of
``WINDOW`` template tokens of all documents are hash-joined with those of the
benchmark; where the benchmark's windows are few (their number is checked) the
join's filter runs where the documents are read. A window with the item's own
values is matched as it is, wherever it stands. Windows with other values, on one
diagonal of a document and an item, must fill the placeholders consistently: one
value of the item always the same value of the document. That finds questions
that were given other numbers or names.

Placeholders alone say nothing: only a window with ``DISTINCT`` different words
beside its placeholders may hold other values; windows of numbers match word for
word, and not at all with fewer than ``DISTINCT`` different values. An item with
fewer than ``WINDOW`` tokens is one window that matches word for word, if it has
``DISTINCT`` different words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, fresh, materialise, task, text_slices, utf8_arrays
from .spans import SpanHasher, byte_hasher, word_spans

WINDOW = 8
#: Share of an item's windows that a document must hold.
COVERAGE_PERCENT = 50
#: Different words that a window needs.
DISTINCT = 3
#: Units that may follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg lb lbs oz t ml cl l gal s sec secs min mins h hr hrs hour hours day days week weeks month months year years ms hz khz mhz ghz w kw mw v a k c f pa kpa bar j kj cal kcal percent dollars dollar cents cent euros euro pounds pound meters meter metres metre miles mile inches inch feet foot liters liter litres litre grams gram kilograms kilogram minutes minute seconds second degrees degree".split()
#: Fixed hashes of the placeholders.
NUMBER, UNIT, NAME = np.uint64(1), np.uint64(2), np.uint64(3)

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in "!\"#$&'()*,-./:;<=>?@[\\]^_`{|}~"]] = True
_NUMERIC = np.zeros(256, bool)
_NUMERIC[[ord(c) for c in "0123456789.,%+-/:"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def templates(raw: np.ndarray, offsets: np.ndarray):
    """(document, template hash, value hash, is a placeholder) of every token; A-Z and Latin-1 capitals are capitals."""
    starts, ends, doc = word_spans(raw, offsets)
    if not len(starts):
        z = np.zeros(0, np.uint64)
        return doc, z, z, np.zeros(0, bool)
    line = np.concatenate([[0], np.cumsum(raw == 0x0A)])
    begins = np.append(True, (doc[1:] != doc[:-1]) | (line[starts[1:]] != line[starts[:-1]]))
    begins[1:] |= _STOP[raw[ends[:-1] - 1]]
    low = _LOWER[raw]
    if len(raw) > 1:
        latin = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        low[latin] += 0x20
    a, b = starts.copy(), ends.copy()
    for _ in range(8):
        a += (a < b) & _PUNCTUATION[raw[np.minimum(a, len(raw) - 1)]]
    for _ in range(8):
        b -= (a < b) & _PUNCTUATION[raw[b - 1]]
    real = np.flatnonzero(a < b)
    a, b, doc = a[real], b[real], doc[real]
    # A word of punctuation alone is no token; what it begins, the next token begins.
    begun = np.concatenate([[0], np.cumsum(begins)])
    opens = np.diff(np.concatenate([[0], begun[real + 1]])) > 0 if len(real) else np.zeros(0, bool)
    value = byte_hasher(low).of(a, b)
    numeric, digit = np.concatenate([[0], np.cumsum(_NUMERIC[raw])]), np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    number = (numeric[b] - numeric[a] == b - a) & (digit[b] > digit[a])
    after = np.append(False, number[:-1]) & ~opens
    units = np.frombuffer("".join(UNITS).encode(), np.uint8)
    at = np.cumsum([0, *map(len, UNITS)])
    unit = after & np.isin(value, byte_hasher(units).of(at[:-1], at[1:]))
    second = raw[np.minimum(a + 1, len(raw) - 1)]
    capital = _UPPER[raw[a]] | ((raw[a] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    name = capital & ~opens & ~number & ~unit
    token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    return doc, token, value, number | unit | name


def windows(raw: np.ndarray, offsets: np.ndarray, lengths: list[int]):
    """Yields (document, first token in the document, length, template hash, own hash, first token, values, placeholders) for each length."""
    doc, token, value, slot = templates(raw, offsets)
    n = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    by_token, by_value = SpanHasher(token), SpanHasher(value)
    for length in lengths:
        own = np.flatnonzero(np.arange(len(doc)) + length <= (first + n)[doc])
        yield doc[own], own - first[doc[own]], length, by_token.of(own, own + length), by_value, own, value, slot


def _slots(own: np.ndarray, length: int, value: np.ndarray, slot: np.ndarray) -> pa.Array:
    """The placeholder values of windows, in order."""
    at = own[:, None] + np.arange(length)
    mask = slot[at]
    offsets = np.concatenate([[0], np.cumsum(mask.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[at][mask].view(np.int64)))


def _different(rows: np.ndarray) -> np.ndarray:
    """How many different values each row has."""
    rows = np.sort(rows, axis=1)
    return 1 + (rows[:, 1:] != rows[:, :-1]).sum(axis=1)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, at, length, h, own_h, slots, may_change, n_windows) of the windows of every item (item_id, text) that say something; n_windows is their number."""
    schema = pa.schema([("item_id", pa.int64()), ("at", pa.int64()), ("length", pa.int32()), ("h", pa.int64()), ("own_h", pa.int64()), ("slots", pa.list_(pa.int64())), ("may_change", pa.bool_()), ("n_windows", pa.int64())])

    def run(batches):
        for batch in batches:
            raw, offsets = utf8_arrays(batch.column(1))
            tokens = np.bincount(templates(raw, offsets)[0], minlength=batch.num_rows)
            for doc, at, length, h, by_value, own, value, slot in windows(raw, offsets, sorted({min(window, n) for n in tokens.tolist() if n})):
                place = own[:, None] + np.arange(length)
                masked = np.where(slot[place], np.uint64(0), value[place])
                words = _different(masked) - slot[place].any(axis=1)
                says = (words >= DISTINCT) | ((length == window) & (_different(value[place]) >= DISTINCT))
                mine = (np.minimum(window, tokens[doc]) == length) & says
                doc, at, h, own, words = doc[mine], at[mine], h[mine], own[mine], words[mine]
                n = np.bincount(doc, minlength=batch.num_rows)[doc]
                own_h = by_value.of(own, own + length).view(np.int64)
                yield batch_of(schema, batch.column(0).take(pa.array(doc)), at, np.full(len(doc), length), h.view(np.int64), own_h, _slots(own, length, value, slot), (words >= DISTINCT) & (length == window), n)

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(task(run), "item_id long, at long, length int, h long, own_h long, slots array<long>, may_change boolean, n_windows long")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage_percent: int = COVERAGE_PERCENT, most_broadcast_windows: int = 4_000_000, most_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, kind) of every document that holds an item.

    n_matched counts the item's windows that the document holds word for word, or
    with other values that are consistent over the changed windows of their
    diagonal; it must reach ``coverage_percent`` of n_windows. kind is
    ``verbatim`` if all of them are there with the item's own values, else
    ``reparameterised``. Null and empty texts hold nothing; rows with one doc_id
    count as one document. Repeated items are items each; without items, or
    without documents, nothing is found.
    """
    spark = docs.sparkSession
    items = materialise(benchmark_windows(benchmark, window))
    lengths = [r["length"] for r in items.select("length").distinct().orderBy("length").collect()]
    few = items.count() <= most_broadcast_windows
    known = spark.sparkContext.broadcast(np.sort(items.select("h").distinct().toArrow()["h"].to_numpy()) if few else None)
    schema = pa.schema([("doc_id", pa.int64()), ("doc_at", pa.int64()), ("length", pa.int32()), ("h", pa.int64()), ("doc_own_h", pa.int64()), ("doc_slots", pa.list_(pa.int64()))])

    def run(batches):
        hashes = known.value
        for batch in batches:
            raw, offsets = utf8_arrays(batch.column(1))
            for a, b in text_slices(offsets, most_bytes):
                for doc, at, length, h, by_value, own, value, slot in windows(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lengths):
                    h = h.view(np.int64)
                    if hashes is not None:
                        place = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                        hit = np.flatnonzero(hashes[place] == h) if len(hashes) else place[:0]
                        doc, at, h, own = doc[hit], at[hit], h[hit], own[hit]
                    for k in range(0, len(doc), 500_000):
                        part = slice(k, k + 500_000)
                        own_h = by_value.of(own[part], own[part] + length).view(np.int64)
                        yield batch_of(schema, batch.column(0).take(pa.array(doc[part] + a)), at[part], np.full(len(doc[part]), length), h[part], own_h, _slots(own[part], length, value, slot))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = materialise(rows.mapInArrow(task(run), "doc_id long, doc_at long, length int, h long, doc_own_h long, doc_slots array<long>"))
    pair = ["doc_id", "item_id", "n_windows"]
    own = items.groupBy("h", "own_h", "length", "item_id", "n_windows").agg(F.collect_list("at").alias("ats"))
    same = found.select("doc_id", "length", "h", F.col("doc_own_h").alias("own_h")).distinct().join(own, ["h", "own_h", "length"])
    same = same.select(*pair, F.explode("ats").alias("at"), F.lit(True).alias("same"))
    # Which slots of a window hold one value: all that decides whether other values are consistent in it.
    equal = lambda slots: F.transform(slots, lambda x: F.array_position(slots, x))
    fits = F.forall(F.zip_with("equal", "doc_equal", lambda i, d: F.get("doc_equal", i.cast("int") - 1) == d), lambda ok: F.coalesce(ok, F.lit(False))) & (F.size("equal") == F.size("doc_equal"))
    changing = items.where("may_change").withColumn("equal", equal(F.col("slots")))
    kinds = found.select("doc_id", "h", "length", equal(F.col("doc_slots")).alias("doc_equal")).distinct()
    # An item of one window is there if any window of the document fits it: a document's lines of one template count once for each pattern.
    alone = kinds.join(changing.where("n_windows = 1").select("h", "length", "item_id", "n_windows", "at", "equal"), ["h", "length"]).where(fits)
    alone = alone.select(*pair, "at", F.lit(False).alias("same")).distinct()
    # Items of several windows: only where enough of their templates are in the document, whatever the values.
    several = items.where("n_windows > 1").select("h", "length", "item_id", "n_windows", "at")
    enough = found.select("doc_id", "h", "length").distinct().join(several, ["h", "length"]).groupBy(*pair).agg(F.countDistinct("at").alias("n")).where(100 * F.col("n") >= coverage_percent * F.col("n_windows"))
    changed = found.withColumn("doc_equal", equal(F.col("doc_slots"))).join(changing.where("n_windows > 1"), ["h", "length"]).where(F.col("own_h") != F.col("doc_own_h"))
    changed = changed.join(enough.select(*pair), pair, "left_semi").where(F.size("slots") == F.size("doc_slots"))
    changed = changed.select(*pair, "at", (F.col("doc_at") - F.col("at")).alias("diagonal"), F.explode(F.arrays_zip("slots", "doc_slots")).alias("s"))
    value = changed.groupBy(*pair, "diagonal", "s.slots").agg(F.min("s.doc_slots").alias("low"), F.max("s.doc_slots").alias("high"), F.collect_set("at").alias("ats"))
    whole = value.groupBy(*pair, "diagonal").agg(F.min(F.col("low") == F.col("high")).alias("one"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats")).where("one")
    both = same.unionByName(alone).unionByName(whole.select(*pair, F.explode("ats").alias("at"), F.lit(False).alias("same")))
    out = both.groupBy(*pair, "at").agg(F.max("same").alias("same")).groupBy(*pair).agg(F.count("*").alias("n_matched"), F.min("same").alias("same"))
    return out.where(100 * F.col("n_matched") >= coverage_percent * F.col("n_windows")).select(*pair, "n_matched", F.when(F.col("same"), "verbatim").otherwise("reparameterised").alias("kind"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    key, name = F.xxhash64("doc_id", "text"), fresh("key")
    bad = materialise(contaminated(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(bad, key == F.col(name), "left_anti")
