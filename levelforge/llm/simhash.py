"""SimHash fingerprints, and links between them through vantage-point trees.

Equal fingerprints are one point, so copies cost nothing beyond a grouping. A
vantage-point tree fitted on a bounded sample deals the points out to shards: at
each node a point goes to the inner or the outer side by its distance from the
vantage point, and an inner point whose ball of the search radius crosses the
node's boundary goes to the outer side as well. By the triangle inequality two
points within the radius then meet in at least one shard. Shards that are still
too large get a tree of their own and are dealt out again, until each fits.
Inside a shard the same splitting goes on in memory down to leaves that are
compared exactly. A shard reports a spanning forest of its links, never all its
pairs.
"""

from __future__ import annotations

import logging
import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_of, connected_components, fresh, if_small, materialise, mix64, task, text_slices, utf8_arrays

FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_DEALT_COLUMNS = "shard long, was long, fp long"
_DEALT = pa.schema([("shard", pa.int64()), ("was", pa.int64()), ("fp", pa.int64())])
_LOG = logging.getLogger(__name__)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word: a run without ASCII white space; words never cross documents."""
    word = ~_SPACE[raw]
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = word
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = word
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, shingle_words: int = 3, most_shingles: int = 1 << 17) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is 1 if it is set in over half the shingles' XXH64 (seed 42)."""
    n = len(offsets) - 1
    raw = _LOWER[raw]
    starts, ends, doc = word_spans(raw, offsets)
    size = ends - starts
    # The words joined by single spaces: a shingle is then one slice.
    at = np.cumsum(size + 1) - size - 1
    joined = np.full(int(at[-1] + size[-1] + 1) if len(at) else 0, 0x20, np.uint8)
    joined[np.repeat(at - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] = raw[~_SPACE[raw]]
    words = np.bincount(doc, minlength=n)
    first = np.cumsum(words) - words
    shingles = np.where(words > 0, np.maximum(1, words - shingle_words + 1), 0)
    base = np.cumsum(shingles) - shingles
    owner = np.repeat(np.arange(n), shingles)
    head = first[owner] + np.arange(len(owner)) - base[owner]
    tail = np.minimum(head + shingle_words, first[owner] + words[owner]) - 1
    low, high = at[head], at[tail] + size[tail]
    counts = np.zeros((n, 64), np.int64)
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    for k in range(0, len(owner), most_shingles):
        part = slice(k, k + most_shingles)
        h = np.array([digest(text[a:b], 42) for a, b in zip(low[part].tolist(), high[part].tolist(), strict=True)], np.uint64)
        own = owner[part]
        edge = np.flatnonzero(np.diff(own, prepend=-1))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > shingles[:, None], axis=1).view(">u8").reshape(n).astype(np.uint64)


def fingerprints(docs: DataFrame, shingle_words: int = 3, most_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, text_hash, fp) of whole texts; A-Z are lower-cased, a text with fewer words is one shingle, without words it is 0.

    Null texts are empty; null and repeated doc_ids stay rows of their own.
    """

    def run(batches):
        for batch in batches:
            raw, offsets = utf8_arrays(batch.column(2))
            for first, last in text_slices(offsets, most_bytes):
                fp = fingerprints_of(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], shingle_words)
                yield batch_of(FINGERPRINTS, *(batch.column(i).slice(first, last - first) for i in range(2)), fp.view(np.int64))

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("string")).mapInArrow(task(run), "doc_id long, text_hash long, fp long")


def _distance(x: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(x ^ v)


def best_cut(points: np.ndarray, radius: int, tries: int = 8) -> tuple[np.uint64, int, int]:
    """(vantage point, boundary, points of the larger side): of the first ``tries`` points and all boundaries that with the smallest larger side, copies counted."""
    best = None
    for v in points[:tries]:
        upto = np.concatenate([np.zeros(radius, np.int64), np.cumsum(np.bincount(_distance(points, v), minlength=65))])
        inner, outer = upto[radius:], len(points) - upto[:65]
        cost = np.where(outer > 0, np.maximum(inner, outer), len(points))
        bound = int(cost.argmin())
        if best is None or cost[bound] < best[2]:
            best = v, bound, int(cost[bound])
    return best


def fit_router(sample: np.ndarray, shards: int, radius: int = 2) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, boundary, inner, outer) of a tree with up to ``shards`` leaves; a child below 0 is shard -1 - child."""
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0

    def build(points: np.ndarray, want: int) -> int:
        nonlocal leaves
        if want > 1 and len(points) >= 8:
            v, bound, most = best_cut(points, radius)
            if most < 0.95 * len(points):
                d = _distance(points, v)
                inner, outer = points[d <= bound], points[d > bound - radius]
                k, part = len(nodes), min(want - 1, max(1, round(want * len(inner) / (len(inner) + len(outer)))))
                nodes.append((0, 0, 0, 0))
                nodes[k] = (int(v), bound, build(inner, part), build(outer, want - part))
                return k
        leaves += 1
        return -leaves

    build(sample, shards)
    return nodes


def route(points: np.ndarray, nodes, radius: int):
    """Yields (shard, indices of points) for the home shard of each point and the outer shards that its ball reaches."""
    todo = [(0 if nodes else -1, np.arange(len(points)))]
    while todo:
        k, own = todo.pop()
        if not len(own):
            continue
        if k < 0:
            yield -1 - k, own
            continue
        v, bound, inner, outer = nodes[k]
        d = _distance(points[own], np.uint64(v))
        todo.append((inner, own[d <= bound]))
        todo.append((outer, own[d > bound - radius]))


class Forest:
    """Union-find over 0..n-1 in an array: smaller roots win."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while len(a):
            a, b = p[a], p[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = p[p]
                if np.array_equal(up, p):
                    break
                p[:] = up


def _neighbour_masks(radius: int) -> np.ndarray:
    from itertools import combinations

    return np.array([sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(64), r)], np.uint64)


def link_within(points: np.ndarray, radius: int, leaf: int = 256) -> np.ndarray:
    """The root of each of the distinct ``points``: the smallest index that it reaches over links of at most ``radius`` bits.

    Splits around vantage points while that makes the work smaller. Where it
    does not (a ball of points that all lie near each other), leaves up to
    ``leaf`` squared comparisons for each point of their neighbourhood are
    compared in blocks, larger ones by looking up every fingerprint within the
    radius, so no leaf is quadratic.
    """
    forest = Forest(len(points))
    masks = _neighbour_masks(radius) if radius <= 3 else None
    todo = [(np.arange(len(points)), 0)]
    while todo:
        own, tries = todo.pop()
        x = points[own]
        if len(own) > leaf and tries < 4:
            v, bound, most = best_cut(np.concatenate([x[(len(x) * (2 * tries + 1)) // 8 :], x[: (len(x) * (2 * tries + 1)) // 8]]), radius, 1)
            d = _distance(x, v)
            if most < 0.9 * len(own):
                todo += [(own[d <= bound], 0), (own[d > bound - radius], 0)]
            else:
                todo.append((own, tries + 1))
        elif len(own) > 8 * leaf and masks is not None:
            order = np.argsort(x)
            s = x[order]
            for m in masks:
                y = x ^ m
                at = np.minimum(np.searchsorted(s, y), len(s) - 1)
                hit = np.flatnonzero(s[at] == y)
                forest.link(own[hit], own[order[at[hit]]])
        else:
            for k in range(0, len(own), 1024):
                a, b = np.nonzero(_distance(x[k : k + 1024, None], x[None, :]) <= radius)
                later = a + k < b
                forest.link(own[a[later] + k], own[b[later]])
    return forest.parent


#: Sample points that a router needs for each shard it makes.
ENOUGH = 64
#: Points of a large shard that one task deals out.
DEALT = 200_000


def wanted(n: int, points_per_shard: int, seen: int) -> int:
    """Shards that a router over ``seen`` sample points makes of ``n`` points."""
    return max(2, min(-(-2 * n // points_per_shard), seen // ENOUGH))


def near_links(points: DataFrame, radius: int = 2, sample: int = 20_000, points_per_shard: int = 50_000) -> DataFrame:
    """(a, b): links of a spanning forest over the distinct fingerprints ``points`` (fp) within ``radius`` bits.

    Routers are fitted on samples, all points are routed and searched. The first
    router comes from one sample (at most ``2 * sample`` fingerprints, the only
    ones that reach the driver) and deals points where they are read. A shard of
    over four times ``points_per_shard`` points is dealt out again by a router of
    its own, fitted in a task on at most ``sample`` points of that shard, until
    each fits; left as it is only if that makes it hardly smaller (points all
    near each other).
    """
    spark, total = points.sparkSession, points.count()
    share = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) * total < 2 * sample * (1 << 30)
    some = points.select("fp").where(share).orderBy(F.xxhash64("fp")).limit(2 * sample).toArrow()["fp"].to_numpy()

    def router(fps: np.ndarray, n: int):
        x = np.random.default_rng(7).permutation(np.sort(fps.astype(np.int64).view(np.uint64)))
        return fit_router(x, max(wanted(n, points_per_shard, len(x)), min(8, len(x) // 16)), radius)

    shared = spark.sparkContext.broadcast(router(some, total) if len(some) else [])

    def dealt_out(x: np.ndarray, shard: int, n: int, nodes):
        """(shard, points of its parent, fingerprint): a shard's name mixes its parent's with its number; names that clash share a task, no more."""
        for new, own in route(x.view(np.uint64), nodes, radius):
            name = int(mix64(np.array([shard ^ (new + 1)], np.int64).view(np.uint64)).view(np.int64)[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), name, np.int64)), pa.array(np.full(len(own), n, np.int64)), pa.array(x[own])], schema=_DEALT)

    def first(batches):
        for batch in batches:
            yield from dealt_out(batch.column(0).to_numpy(zero_copy_only=False), 0, total, shared.value)

    def fit(pdf):
        nodes = np.array(router(pdf["fp"].to_numpy(), int(pdf["n"].iloc[0])), dtype=object)
        flat = [v - (1 << 64) if v >= 1 << 63 else v for v in nodes.ravel().tolist()]
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "nodes": [flat]})

    def again(rows, routers):
        if not rows.num_rows:
            return pa.Table.from_batches([], schema=_DEALT)
        flat = np.array(routers["nodes"][0].as_py(), np.int64).reshape(-1, 4)
        nodes = [(v & (1 << 64) - 1, b, i, o) for v, b, i, o in flat.tolist()]
        out = dealt_out(rows["fp"].to_numpy(), rows["shard"][0].as_py(), rows["n"][0].as_py(), nodes)
        return pa.Table.from_batches(list(out), schema=_DEALT)

    dealt = materialise(points.select("fp").mapInArrow(task(first), _DEALT_COLUMNS))
    parts, sizes = [], []
    while True:
        size = materialise(dealt.groupBy("shard").agg(F.count("*").alias("n"), F.max("was").alias("was")))
        large = materialise(size.where((F.col("n") > 4 * points_per_shard) & (F.col("n") < 0.9 * F.col("was"))).select("shard", "n"))
        sizes.append(size.join(large.select("shard"), "shard", "left_anti").select("n"))
        if not large.head(1):
            parts.append(dealt)
            break
        parts.append(dealt.join(large.select("shard"), "shard", "left_anti"))
        rows = dealt.drop("was").join(large, "shard")
        enough = F.least(F.lit(sample), ENOUGH * F.ceil(2 * F.col("n") / points_per_shard))
        routers = rows.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) * F.col("n") < enough * (1 << 30)).groupBy("shard").applyInPandas(fit, "shard long, nodes array<long>")
        salts = F.ceil(F.col("n") / DEALT).cast("int")
        routers = materialise(large.join(routers, "shard").select("shard", "nodes", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(1)), salts).cast("int"))
        dealt = materialise(salted.groupBy("shard", "salt").cogroup(routers.groupBy("shard", "salt")).applyInArrow(lambda a, b: again(a, b), _DEALT_COLUMNS))
    copies, largest = reduce(DataFrame.union, sizes).agg(F.sum("n"), F.max("n")).first()
    _LOG.info("%d copies of points in shards, largest %d", copies or 0, largest or 0)

    def search(_key, table):
        x = np.unique(table["fp"].to_numpy().view(np.uint64))
        root = link_within(x, radius)
        own = np.flatnonzero(root != np.arange(len(x)))
        return pa.table([x[own].view(np.int64), x[root[own]].view(np.int64)], schema=EDGES)

    return reduce(DataFrame.union, parts).groupBy("shard").applyInArrow(search, "a long, b long").distinct()


def simhash_components(docs: DataFrame, shingle_words: int = 3, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id, group, text_hash): documents linked at ``radius`` or fewer differing bits.

    component_id is the smallest doc_id reachable; a component of null ids only
    has null. group is the component's smallest fingerprint (as a signed
    integer). ``similarity`` adds the links of ``similar_links``. An empty table
    gives an empty result.
    """
    fp = materialise(fingerprints(docs, shingle_words))
    points = materialise(fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = near_links(points, radius)
    if similarity is not None:
        links = similar_links(docs, fp, materialise(links), similarity=similarity)
    component = materialise(connected_components(links))
    # Both sides are written, so that the join of a large component is a plain one, which the adaptive planner can split.
    group = materialise(points.join(component, points.fp == component.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("group")))
    least = materialise(group.groupBy("group").agg(F.min("least").alias("component_id")))
    found = group.join(least, "group").select(F.col("fp").alias("point"), "component_id", "group")
    return fp.join(found, F.col("fp") == F.col("point")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group", "text_hash")


BANDS, BAND_SHINGLES = 12, 3
_SKETCH = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64()))])


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle, A-Z lower-cased; a shorter text is one shingle, one without words none."""
    from .spans import SpanHasher, byte_hasher

    starts, ends, doc = word_spans(raw, offsets)
    n = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    last = (first + n)[doc]
    head = np.flatnonzero((np.arange(len(doc)) + shingle_words <= last) | (np.arange(len(doc)) == first[doc]))
    return doc[head], SpanHasher(byte_hasher(_LOWER[raw]).of(starts, ends)).of(head, np.minimum(head + shingle_words, last[head]))


def bands_of(raw: np.ndarray, offsets: np.ndarray, shingle_words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles of each text, text, fingerprint) with a fingerprint for each band of a text that has a shingle.

    A shingle's hash puts it in one of ``BANDS`` bands; the fingerprint is the
    SimHash of the ``BAND_SHINGLES`` smallest of the band, so texts with most
    shingles in common have some of them equal.
    """
    from .common import mix64

    doc, h = shingle_hashes(raw, offsets, shingle_words)
    band = (h >> np.uint64(32)) % np.uint64(BANDS)
    key = np.unique(doc.astype(np.uint64) << np.uint64(44) | band << np.uint64(40) | h & np.uint64(0xFFFFFFFFFF))
    n = np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=len(offsets) - 1)
    group = key >> np.uint64(40)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    value = mix64(key & np.uint64(0xFFFFFFFFFFF))
    a, b, c = (value[np.minimum(first + k, len(key) - 1)] if len(key) else value for k in range(BAND_SHINGLES))
    fp = np.where(size == 1, a, np.where(size == 2, a & b, a & b | b & c | a & c))
    return n, (group[first] >> np.uint64(4)).astype(np.int64), mix64(fp ^ (group[first] & np.uint64(15)))


#: Counters of the table of shingle frequencies (4 bytes each); more would tell smaller frequencies apart in a larger corpus.
COUNTERS = 1 << 21
#: Counters to a row on the way to the table, and rows of a counter's part that are added up before the last sum.
_SLICE, _FAN = 1 << 17, 64


def counter_of(h: np.ndarray) -> np.ndarray:
    return (mix64(h) & np.uint64(COUNTERS - 1)).astype(np.int64)


def frequencies(texts: DataFrame, scratch: Scratch, shingle_words: int, most_bytes: int) -> np.ndarray:
    """Counters of the texts that have a shingle, over all of ``texts`` (text_hash, text): shingles share ``COUNTERS`` counters by hash.

    A counter is no less than the frequency of each of its shingles, so what
    very many texts share stands out from the mean, whatever the size of the
    corpus. Tasks count what they read; their counters, compressed, are added up
    in two steps as streams. The result has a fixed size.
    """
    sent = pa.schema([("part", pa.int32()), ("lane", pa.int32()), ("counts", pa.binary())])
    columns = "part int, lane int, counts binary"

    def rows(counts: np.ndarray, lane: int):
        for k in range(0, len(counts), _SLICE):
            yield batch_of(sent, [k // _SLICE], [lane], [zlib.compress(counts[k : k + _SLICE].tobytes(), 1)])

    def count(batches):
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            raw, offsets = utf8_arrays(batch.column(1))
            for first, last in text_slices(offsets, most_bytes):
                doc, h = shingle_hashes(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], shingle_words)
                order = np.lexsort((doc, h))
                doc, h = doc[order], h[order]
                once = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))[: len(h)]
                counts += np.bincount(counter_of(h[once]), minlength=COUNTERS).astype(np.uint32)
        yield from rows(counts, TaskContext.get().partitionId() % _FAN)

    def add(batches):
        at, total = None, None
        for batch in batches:
            for part, lane, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (part, lane) != at:
                    if at:
                        yield batch_of(sent, [at[0]], [at[1]], [zlib.compress(total.tobytes(), 1)])
                    at, total = (part, lane), np.zeros(_SLICE, np.uint32)
                total += np.frombuffer(zlib.decompress(counts), np.uint32)
        if at:
            yield batch_of(sent, [at[0]], [at[1]], [zlib.compress(total.tobytes(), 1)])

    def added(df: DataFrame) -> DataFrame:
        return df.repartition("part", "lane").sortWithinPartitions("part", "lane").mapInArrow(task(add), columns)

    each = added(texts.mapInArrow(task(count), columns)).withColumn("lane", F.lit(0))
    out = np.zeros(COUNTERS, np.uint32)
    for row in scratch.write(added(each)).toArrow().to_pylist():
        out[row["part"] * _SLICE : (row["part"] + 1) * _SLICE] += np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return out


def prefixes(raw: np.ndarray, offsets: np.ndarray, counts: np.ndarray, similarity: float, shingle_words: int = 5) -> tuple[np.ndarray, ...]:
    """(text, shingle, place, distinct shingles of the text) of the shingles that two texts at ``similarity`` can't all differ in.

    A text's shingles are put in one order for all texts: by the counters that
    ``counts`` has for them, then by hash. The first common shingle of two
    similar texts is among the first n - ceil(similarity * n) + 1 of both.
    """
    doc, h = shingle_hashes(raw, offsets, shingle_words)
    order = np.lexsort((h, counts[counter_of(h)], doc))
    doc, h = doc[order], h[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))[: len(doc)]
    doc, h = doc[new], h[new]
    n = np.bincount(doc, minlength=len(offsets) - 1)
    place = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    own = np.flatnonzero(place <= n[doc] - np.ceil(similarity * n[doc] - 1e-9))
    return doc[own], h[own], place[own], n[doc[own]]


def parity_bits(h: np.ndarray) -> bytes:
    """Of a set of hashes: a bit for each of at least four times as many places (a power of two), 1 where an odd number of them fall."""
    places = 1 << max(6, (4 * len(h) - 1).bit_length())
    from .common import mix64

    odd = np.bincount((mix64(h) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """No more than the number of hashes that are in one of two sets alone: places whose parities differ, the finer bits folded to the coarser."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def shared_shingles(texts: DataFrame, heads, buckets: int) -> DataFrame:
    """(shingle) of those that ``heads`` gives for texts of more than one group; ``texts`` is (text_hash, text, fp, group).

    Each batch sends a shingle once for each group, 14 bytes, packed by bucket: a
    row for each would be several times that. Groups compare by 48 mixed bits.
    """
    from itertools import groupby

    from .common import mix64
    from .suffix_dedup import _by_bucket, _cut, _whole

    sent, found = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())]), pa.schema([("shingle", pa.int64())])

    def pack(batches):
        for batch in batches:
            groups = mix64(batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64))
            for row, h, _, _ in heads(batch):
                g = groups[row] & np.uint64(0xFFFFFFFFFFFF)
                order = np.lexsort((g, h))
                h, g = h[order], g[order]
                new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))[: len(h)]
                h, g = h[new], g[new]
                bucket = ((mix64(h) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                for k, own in _by_bucket(bucket, np.arange(len(h))):
                    yield batch_of(sent, [k], [_cut(h[own], 8).tobytes() + _cut(g[own], 6).tobytes()])

    def meet(batches):
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for _, own in groupby(rows, key=lambda row: row[0]):
            raw = [np.frombuffer(payload, np.uint8) for _, payload in own]
            h = np.concatenate([_whole(x[: len(x) // 14 * 8], 8) for x in raw])
            g = np.concatenate([_whole(x[len(x) // 14 * 8 :], 6) for x in raw])
            order = np.lexsort((g, h))
            h, g = h[order], g[order]
            several = (h[1:] == h[:-1]) & (g[1:] != g[:-1])
            yield batch_of(found, np.unique(h[1:][several]).view(np.int64))

    packed = texts.mapInArrow(task(pack), "bucket int, payload binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(task(meet), "shingle long")


def similar_links(docs: DataFrame, rows: DataFrame, links: DataFrame, shingle_words: int = 5, similarity: float = 0.8, most_bytes: int = 1 << 20, rows_per_salt: int = 256, most_shared: int = 4_000_000) -> DataFrame:
    """(a, b): links that join the fingerprints, from ``rows`` (doc_id, text_hash, fp), joined by ``links``, and those of texts with Jaccard similarity of shingle sets of at least ``similarity``.

    Not all pairs are given, but all components. Two passes, each verified on
    the whole shingle sets; exact copies are one text. The first makes large
    groups of near copies one component: texts whose band fingerprints agree are
    candidates of three of their group, each text's nearest candidate first, then
    those still in different components. The second is exact: it looks for links
    between different components by prefix filtering (``prefixes``), where the
    shorter text of a pair needs fewer shingles still, over the shingles that
    more than one component has (``shared_shingles``; where there are at most
    ``most_shared``, they are filtered as texts are read, else joined). Shingles
    that many texts have come last (``frequencies``), so a shared passage is no
    join key. The component with most texts of a shingle is not compared with
    itself, and shingles of many texts are dealt out by salts. The texts are
    shuffled and written once more, without exact copies (which are combined
    before the shuffle), in buckets of their hash, so that later joins move only
    ids. All intermediate tables are deleted at the end.
    """

    spark = docs.sparkSession
    scratch = Scratch(spark)
    keep = scratch.write

    def sketch(batches):
        for batch in batches:
            raw, offsets = utf8_arrays(batch.column(2))
            for first, last in text_slices(offsets, most_bytes):
                n, doc, fp = bands_of(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], shingle_words)
                at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=last - first))]).astype(np.int32))
                yield batch_of(_SKETCH, *(batch.column(i).slice(first, last - first) for i in range(2)), n, pa.ListArray.from_arrays(at, pa.array(fp.view(np.int64))))

    def sets(batches):
        schema = pa.schema([("text_hash", pa.int64()), ("shingles", pa.list_(pa.int64()))])
        for batch in batches:
            raw, offsets = utf8_arrays(batch.column(1))
            for i in range(batch.num_rows):
                text = raw[offsets[i] : offsets[i + 1]]
                _, h = shingle_hashes(text, np.array([0, len(text)]), shingle_words)
                yield batch_of(schema, batch.column(0).slice(i, 1), [np.unique(h).view(np.int64)])

    def heads(batch):
        """(row in the batch, shingle, place, shingles of the text) of the prefixes, a slice at a time."""
        raw, offsets = utf8_arrays(batch.column(1))
        for first, last in text_slices(offsets, most_bytes):
            doc, h, place, n = prefixes(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], common.value, similarity, shingle_words)
            yield doc + first, h, place, n

    def head_rows(batches):
        schema = pa.schema([("text_hash", pa.int64()), ("fp", pa.int64()), ("group", pa.int64()), ("shingle", pa.int64()), ("place", pa.int32()), ("n", pa.int32())])
        known = shared.value
        for batch in batches:
            for row, h, place, n in heads(batch):
                if known is not None:
                    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                    hit = np.flatnonzero(known[at] == h) if len(known) else at[:0]
                    row, h, place, n = row[hit], h[hit], place[hit], n[hit]
                own = pa.array(row)
                yield batch_of(schema, *(batch.column(i).take(own) for i in (0, 2, 3)), h.view(np.int64), place.astype(np.int32), n.astype(np.int32))

    def bitmaps(batches):
        schema = pa.schema([("text_hash", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
        for batch in batches:
            raw, offsets = utf8_arrays(batch.column(1))
            for i in range(batch.num_rows):
                text = raw[offsets[i] : offsets[i + 1]]
                h = np.unique(shingle_hashes(text, np.array([0, len(text)]), shingle_words)[1])
                yield batch_of(schema, batch.column(0).slice(i, 1), [len(h)], [parity_bits(h)])

    def close(batches):
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4, 8)]
            most = (1 - similarity) / (1 + similarity)
            keep = [least_difference(a, b) <= most * (n + m) + 1e-6 for a, b, n, m in zip(*columns, strict=True)]
            yield batch.select(["x", "y", "fp_x", "fp_y"]).filter(pa.array(keep, pa.bool_()))

    def possible(pairs):
        """The pairs without those that parity bits, half a byte for a shingle in place of eight, show to differ too much: none at ``similarity`` goes."""
        ends = keep(pairs.select(F.col("x").alias("end")).union(pairs.select("y")).distinct())
        bits = keep(distinct.join(if_small(ends, 16), F.col("text_hash") == F.col("end"), "left_semi").mapInArrow(task(bitmaps), "text_hash long, n long, bits binary"))
        side = lambda t: bits.select(F.col("text_hash").alias(t), F.col("n").alias(f"n_{t}"), F.col("bits").alias(f"bits_{t}"))
        both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "fp_x", "fp_y", "bits_x", "bits_y", "n_x", "n_y")
        return keep(both.mapInArrow(task(close), "x long, y long, fp_x long, fp_y long"))

    def verified(pairs):
        """The pairs at ``similarity``. The set of the text with fewer pairs goes with the pair; the other's is sent once for each salt."""
        pairs = possible(pairs)
        ends = pairs.select(F.col("x").alias("end")).union(pairs.select("y"))
        many = keep(ends.groupBy("end").agg(F.count("*").alias("many")))
        of_x, of_y = (many.select(F.col("end").alias(f"end_{t}"), F.col("many").alias(f"many_{t}")) for t in "xy")
        known = pairs.join(of_x, F.col("x") == F.col("end_x")).join(of_y, F.col("y") == F.col("end_y"))
        swap = F.struct("many_x", "x") > F.struct("many_y", "y")
        turned = known.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("few"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("hub"), F.greatest("many_x", "many_y").alias("many"), "fp_x", "fp_y")
        salts = (1 + F.floor(F.col("many") / rows_per_salt)).cast("int")
        turned = keep(turned.withColumn("salt", F.pmod(F.xxhash64("few"), salts).cast("int")))
        some = distinct.join(if_small(many, 24), F.col("text_hash") == F.col("end"), "left_semi")
        shingles = keep(some.mapInArrow(task(sets), "text_hash long, shingles array<long>"))
        hubs = turned.select("hub", "salt").distinct().join(shingles.select(F.col("text_hash").alias("hub"), F.col("shingles").alias("sy")), "hub")
        both = turned.join(shingles.select(F.col("text_hash").alias("few"), F.col("shingles").alias("sx")), "few").join(hubs, ["hub", "salt"])
        shared = F.size(F.array_intersect("sx", "sy"))
        return both.where(shared >= similarity * (F.size("sx") + F.size("sy") - shared)).select(F.col("fp_x").alias("a"), F.col("fp_y").alias("b"))

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    sketches = plain.mapInArrow(task(sketch), "doc_id long, text_hash long, n_shingles long, bands array<long>")
    texts = keep(sketches.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    n_texts = texts.count()
    distinct = scratch.bucketed(plain.groupBy("text_hash").agg(F.first("text").alias("text")), "text_hash")
    each = texts.select("text_hash", "doc_id", "n", F.explode("bands").alias("band"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))["text_hash"]
    ends = each.groupBy("band").agg(first.alias("first"), F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low < high")
    met = each.join(ends, "band").select("text_hash", "n", F.explode(F.array_distinct(F.array("first", "low", "high"))).alias("other"), "band").where("text_hash <> other")
    pairs = met.groupBy(F.least("text_hash", "other").alias("x"), F.greatest("text_hash", "other").alias("y")).agg(F.countDistinct("band").alias("bands"), F.min("n").alias("n"))
    # Of twelve bands two texts at the threshold share about half; one alone is chance, but for very short texts.
    known = keep(rows.groupBy("text_hash").agg(F.min("fp").alias("fp")))
    of = lambda t: known.select(F.col("text_hash").alias(t), F.col("fp").alias(f"fp_{t}"))
    pairs = keep(pairs.where("bands >= 2 OR n < 24").join(of("x"), "x").join(of("y"), "y").where("fp_x <> fp_y").select("x", "y", "fp_x", "fp_y", "bands"))
    ends = [pairs.select(F.col(t).alias("t"), F.struct("bands", F.col(o).alias("o"), F.col(f"fp_{t}").alias("fp_t"), F.col(f"fp_{o}").alias("fp_o")).alias("b")) for t, o in ("xy", "yx")]
    nearest = ends[0].union(ends[1]).groupBy("t").agg(F.max("b").alias("b"))
    turn = F.col("t") > F.col("b.o")
    pick = lambda yes, no: F.when(turn, yes).otherwise(no)
    nearest = nearest.select(F.least("t", "b.o").alias("x"), F.greatest("t", "b.o").alias("y"), pick(F.col("b.fp_o"), F.col("b.fp_t")).alias("fp_x"), pick(F.col("b.fp_t"), F.col("b.fp_o")).alias("fp_y")).distinct()
    component = keep(connected_components(links.union(verified(keep(nearest)))))
    in_ = lambda t: component.select(F.col("node").alias(f"node_{t}"), F.col("component").alias(f"in_{t}"))
    rest = pairs.join(in_("x"), F.col("fp_x") == F.col("node_x"), "left").join(in_("y"), F.col("fp_y") == F.col("node_y"), "left")
    rest = keep(rest.where(F.coalesce("in_x", "fp_x") != F.coalesce("in_y", "fp_y")).select("x", "y", "fp_x", "fp_y"))
    stars = component.select(F.col("node").alias("a"), F.col("component").alias("b"))
    if rest.head(1):
        component = keep(connected_components(stars.union(verified(rest))))

    common = spark.sparkContext.broadcast(frequencies(distinct, scratch, shingle_words, most_bytes))
    group = keep(known.join(component, F.col("fp") == F.col("node"), "left").select(F.col("text_hash").alias("of"), "fp", F.coalesce("component", "fp").alias("group")))
    grouped = distinct.join(if_small(group, 32), F.col("text_hash") == F.col("of")).select("text_hash", "text", "fp", "group")
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), n_texts // 20_000)
    between = keep(shared_shingles(grouped, heads, buckets))
    few = between.count() <= most_shared
    shared = spark.sparkContext.broadcast(np.sort(between.toArrow()["shingle"].to_numpy().view(np.uint64)) if few else None)
    head = grouped.mapInArrow(task(head_rows), "text_hash long, fp long, group long, shingle long, place int, n int")
    some = keep(head if few else head.join(between, "shingle", "left_semi"))
    of_shingle = some.groupBy("shingle", "group").count().groupBy("shingle").agg(F.max_by("group", F.struct("count", "group")).alias("main"), F.sum("count").alias("rows"), F.count("*").alias("groups"))
    salts = (1 + F.floor(F.col("rows") / rows_per_salt)).cast("int").alias("salts")
    some = keep(some.join(of_shingle.where("groups > 1").select("shingle", "main", salts), "shingle"))
    index = some.where(F.col("place") <= F.col("n") - F.ceil(2 * similarity / (1 + similarity) * F.col("n") - 1e-9)).withColumn("salt", F.pmod(F.xxhash64("text_hash"), F.col("salts")).cast("int"))
    probe = some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    side = lambda df, t: df.select("shingle", "salt", F.col("text_hash").alias(t), F.col("fp").alias(f"fp_{t}"), F.col("group").alias(f"g_{t}"), F.col("n").alias(f"n_{t}"), (F.col("n") - F.col("place")).alias(f"left_{t}"))
    # x is the shorter; what is left from the first common shingle on must hold the overlap.
    fits = (F.col("g_x") != F.col("g_y")) & (F.struct("n_x", "x") < F.struct("n_y", "y")) & (F.col("n_x") >= similarity * F.col("n_y") - 1e-9) & (F.least("left_x", "left_y") >= similarity / (1 + similarity) * (F.col("n_x") + F.col("n_y")) - 1e-6)
    meet = lambda i, p: side(i, "x").join(side(p, "y"), ["shingle", "salt"]).where(fits).select("x", "y", "fp_x", "fp_y")
    across = keep(meet(index.where("group <> main"), probe).union(meet(index.where("group = main"), probe.where("group <> main"))).distinct())
    out = materialise(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(verified(across)))
    for known in (common, shared):
        known.unpersist()
    scratch.drop()
    return out


def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id, nulls last, ties by text.

    Linked are fingerprints of 3-word shingles within 2 bits, and texts whose
    sets of 5-word shingles are similar to at least ``similarity``.
    """
    rows = materialise(simhash_components(docs, similarity=similarity))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    best = materialise(rows.groupBy("group").agg(F.min(key).alias("best")).select(F.col("best.doc_id").alias("best_id"), F.col("best.text_hash").alias("best_hash")))
    # No join on the group, which may hold a third of all rows: what is not a best row goes.
    name, hashed = fresh("id"), fresh("hash")
    out = rows.join(best, F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_hash") == F.col("best_hash")), "left_anti")
    drop = materialise(out.select(F.col("doc_id").alias(name), F.col("text_hash").alias(hashed)).distinct())
    twice = materialise(rows.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias(name), F.col("text_hash").alias(hashed)))
    same = F.col("doc_id").eqNullSafe(F.col(name)) & (F.xxhash64("text") == F.col(hashed))
    kept = docs.join(if_small(drop, 32), same, "left_anti")
    if not twice.head(1):
        return kept
    # Only rows that are there more than once are grouped.
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
