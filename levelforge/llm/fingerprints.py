"""SimHash document fingerprints and permuted block tables, in DataFrame functions only.

A term is a word with the two after it; each occurrence is a vote, so a term
weighs what it is counted. The 128 bits of a term's hash vote at once: bits j
and j + 32 of a 64-bit word are added up as the two halves of one long, so 64
sums hold all votes, and map-side aggregation leaves one row for each text.

Search: two fingerprints that differ in at most ``radius`` bits agree in
``blocks - radius`` of ``blocks`` blocks at least, whichever they are. There is a
table for each such choice; fingerprints that meet in one are compared, in the
first table that they share only.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelforge.operators.scans import numbered

from .common import fresh, materialise

BITS = 128
#: Words of a term.
TERM = 3
RADIUS, BLOCKS = 3, 4
#: Every such document asks for its neighbours.
ASKS = 20
_PAIR = (1 << 32) | 1
_LOW = (1 << 32) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def _tree(columns: list[Column], join) -> Column:
    while len(columns) > 1:
        columns = [join(*columns[i : i + 2]) if len(columns) > i + 1 else columns[i] for i in range(0, len(columns), 2)]
    return columns[0]


def simhash(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, f1, f2, n_terms): the two words of the fingerprint of the text of each key.

    A bit is set if over half the votes have it; a text without words (null,
    empty, white space) has fingerprint zero. Rows of one key vote together.
    """
    w = fresh("w")
    term, h = fresh("term"), fresh("h")
    following = [F.slice(w, k + 1, F.greatest(F.size(w), F.lit(1))).alias(f"t{k}") for k in range(TERM)]
    terms = texts.select(*keys, words(F.col(text)).alias(w)).select(*keys, F.explode_outer(F.arrays_zip(*following)).alias(term))
    hashed = terms.select(*keys, F.when(F.col(term).isNotNull(), F.xxhash64(*(F.col(term)[f"t{k}"] for k in range(TERM)))).alias(h))
    first, second = F.col(h), F.xxhash64(F.lit(1), h)
    lanes = [F.sum(F.when(F.col(h).isNotNull(), F.shiftrightunsigned(word, j).bitwiseAND(F.lit(_PAIR)))).alias(f"{h}_{k}_{j}") for k, word in enumerate((first, second)) for j in range(32)]
    votes = hashed.groupBy(*keys).agg(F.count(h).alias(h), *lanes)

    def word(k: int) -> Column:
        bits = []
        for j in range(32):
            lane = F.col(f"{h}_{k}_{j}")
            for at, ones in ((j, lane.bitwiseAND(F.lit(_LOW))), (j + 32, F.shiftrightunsigned(lane, 32))):
                bits.append(F.when(2 * ones > F.col(h), F.lit(_signed(1 << at))).otherwise(F.lit(0).cast("long")))
        return _tree(bits, lambda a, b: a.bitwiseOR(b))

    return votes.select(*keys, word(0).alias("f1"), word(1).alias("f2"), F.col(h).alias("n_terms"))


def hexadecimal(f1: Column, f2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def likeness(*words: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones, about 0.5 for texts that share no term."""
    return 1 - distance(*words) / F.lit(float(BITS))


def block_masks(radius: int, blocks: int) -> list[tuple[int, int]]:
    """The two words of the mask of every table: ``blocks - radius`` whole blocks."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("more blocks than differing bits are needed")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    own = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(blocks)]
    masks = [sum(own[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [(_signed(m & ((1 << 64) - 1)), _signed(m >> 64)) for m in masks]


def _tables(points: DataFrame, masks: list[tuple[int, int]], names: list[str]) -> DataFrame:
    t, k1, k2 = names
    rows = [F.struct(F.lit(i).alias(t), F.col("f1").bitwiseAND(F.lit(a)).alias(k1), F.col("f2").bitwiseAND(F.lit(b)).alias(k2)) for i, (a, b) in enumerate(masks)]
    at = fresh("at")
    return points.withColumn(at, F.explode(F.array(*rows))).select(*points.columns, f"{at}.*")


def neighbours(points: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(q1, q2, f1, f2, weight): every point (f1, f2, weight) within ``radius`` bits of a query (f1, f2).

    Both sides hold each fingerprint once, so copies cost nothing. Exact: no
    pair is missed, and each comes once.
    """
    masks = block_masks(radius, blocks)
    names = ["t", "k1", "k2"]
    p = _tables(points.select("f1", "f2", "weight"), masks, names)
    q = _tables(queries.select("f1", "f2"), masks, [f"q_{n}" for n in names]).withColumnsRenamed({"f1": "q1", "f2": "q2"})
    x1, x2 = F.col("f1").bitwiseXOR(F.col("q1")), F.col("f2").bitwiseXOR(F.col("q2"))
    shared = F.coalesce(*(F.when((x1.bitwiseAND(F.lit(a)) == 0) & (x2.bitwiseAND(F.lit(b)) == 0), F.lit(i)) for i, (a, b) in enumerate(masks)))
    met = reduce(lambda a, b: a & b, [F.col(n) == F.col(f"q_{n}") for n in names])
    near = (F.bit_count(x1) + F.bit_count(x2) <= radius) & (shared == F.col("t"))
    return p.join(q, met & near).select("q1", "q2", "f1", "f2", "weight")


def document_fingerprints(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text; other columns don't matter; null text: empty).

    ``edited_sha256``, ``edited_fingerprint``: of the text whose last half
    (rounded down) gives way to the start of the next document in descending
    doc_id (null ids last, texts of one id by their hash; the last one's next is
    the first). ``near_edited``, ``near_next``: likeness of fingerprints.
    ``n_near``: for ids divisible by 20, the other documents within ``radius``
    bits, found through block tables; else null.

    Repeated rows (same id, same text) are one text with a count: each is
    followed by its copy, the last of them by the next text. They are combined
    before the shuffle. A text is shuffled once by its key, and its first half
    at most once more, to the document before it; all else are digests.
    """
    key = ["d", "null_id", "h"]
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("null_id"), F.coalesce("text", F.lit("")).alias("text"),
    ).select("d", "null_id", F.xxhash64("text").alias("h"), "text")
    ids = keyed.select(*key, F.char_length("text").cast("long").alias("n")).groupBy(*key, "n").agg(F.count("*").alias("copies"))
    order = materialise(numbered(ids, [], [F.col("null_id"), F.col("d").desc(), F.col("h")], "at", "total"))
    follow = F.col("at") % F.col("total") + 1
    before = order.select(follow.alias("to"), *(F.col(k).alias(f"before_{k}") for k in key), F.expr("n div 2").alias("wanted"))
    after = order.select(F.col("at").alias("to"), *(F.col(k).alias(f"next_{k}") for k in key))
    links = materialise(order.join(before, F.col("at") == F.col("to")).drop("to").join(after, follow == F.col("to")).select(*key, "n", "copies", "wanted", *(f"before_{k}" for k in key), *(f"next_{k}" for k in key)))

    texts = keyed.groupBy(*key).agg(F.first("text").alias("text")).join(links, key)
    start = texts.select(*(F.col(f"before_{k}").alias(k) for k in key), F.left("text", F.col("wanted").cast("int")).alias("start"))
    half = F.expr("n div 2").cast("int")
    kept = F.left("text", F.col("n").cast("int") - half)
    both = texts.select(*key, "n", "copies", "text").join(start, key)
    forms = [F.struct(F.lit(k).alias("form"), text.alias("text")) for k, text in enumerate((F.col("text"), F.concat(kept, "start"), F.concat(kept, F.left("text", half))))]
    each = both.select(*key, F.explode(F.when(F.col("copies") > 1, F.array(*forms)).otherwise(F.array(*forms[:2]))).alias("x"))
    each = each.select(*key, "x.form", "x.text", F.when(F.col("x.form") > 0, F.sha2("x.text", 256)).otherwise(F.lit("")).alias("sha"))
    prints = simhash(each, [*key, "form", "sha"], "text")
    pick = lambda name, form: F.max(F.when(F.col("form") == form, F.col(name))).alias(f"{name}_{form}")
    known = prints.groupBy(*key).agg(*(pick(n, k) for n in ("f1", "f2") for k in range(3)), pick("sha", 1), pick("sha", 2))
    known = materialise(known.join(links.select(*key, "n", "copies", *(f"next_{k}" for k in key)), key))

    points = known.groupBy(F.col("f1_0").alias("f1"), F.col("f2_0").alias("f2")).agg(F.sum("copies").alias("weight"))
    asks = ~F.col("null_id") & (F.col("d") % ASKS == 0)
    queries = known.where(asks).select(F.col("f1_0").alias("f1"), F.col("f2_0").alias("f2")).distinct()
    counts = neighbours(points, queries, radius, blocks).groupBy("q1", "q2").agg((F.sum("weight") - 1).alias("n_near"))
    counted = known.where(asks).join(counts, (F.col("f1_0") == F.col("q1")) & (F.col("f2_0") == F.col("q2"))).select(*key, "n_near")

    following = known.select(*(F.col(k).alias(f"next_{k}") for k in key), F.col("f1_0").alias("n1"), F.col("f2_0").alias("n2"))
    out = known.join(following, [f"next_{k}" for k in key]).join(counted, key, "left")
    out = out.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div 4096"))))
    out = out.withColumn("copy", F.explode(F.sequence(F.col("block") * 4096 + 1, F.least("copies", F.col("block") * 4096 + 4096))))
    last = F.col("copy") == F.col("copies")
    e1, e2 = (F.when(last, F.col(f"{f}_1")).otherwise(F.col(f"{f}_2")) for f in ("f1", "f2"))
    own = (F.col("f1_0"), F.col("f2_0"))
    return out.select(
        F.when(~F.col("null_id"), F.col("d")).alias("doc_id"), F.col("n").alias("n_chars"), F.when(last, F.col("sha_1")).otherwise(F.col("sha_2")).alias("edited_sha256"),
        hexadecimal(*own).alias("fingerprint"), hexadecimal(e1, e2).alias("edited_fingerprint"), likeness(*own, e1, e2).alias("near_edited"),
        F.when(last, likeness(*own, F.col("n1"), F.col("n2"))).otherwise(F.lit(1.0)).alias("near_next"), "n_near",
    )
