"""Fingerprints, edited texts and neighbours against plain Python; no Python in the plan."""

import random
import struct
from collections import Counter
from hashlib import sha256

import pytest
import xxhash
from pyspark.sql import functions as F

from levelforge.llm.fingerprints import block_masks, document_fingerprints, neighbours

SCHEMA = "doc_id long, text string, h long, form string, copies int"


def hashed(parts, seed=42):
    for p in parts:
        seed = xxhash.xxh64_intdigest(p, seed)
    return seed


def fingerprint(text):
    words = [w for w in "".join(c if c not in "\t\n\v\f\r" else " " for c in text.lower()).split(" ") if w]
    votes, n = [0] * 128, len(words)
    for i in range(n):
        h = hashed([w.encode() for w in words[i : i + 3]])
        both = h | hashed([struct.pack("<i", 1), struct.pack("<Q", h)]) << 64
        for b in range(128):
            votes[b] += both >> b & 1
    value = sum(1 << b for b in range(128) if 2 * votes[b] > n)
    return value & (1 << 64) - 1, value >> 64


def brute(rows, radius=3):
    def signed(text):
        h = hashed([text.encode()])
        return h - (1 << 64) if h >> 63 else h

    docs = sorted(((i, t or "") for i, t, *_ in rows), key=lambda d: (d[0] is None, -(d[0] or 0), signed(d[1])))
    prints = {t: fingerprint(t) for _, t in docs}
    far = lambda a, b: (a[0] ^ b[0]).bit_count() + (a[1] ^ b[1]).bit_count()
    out = []
    for k, (i, t) in enumerate(docs):
        follow = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        e = fingerprint(edited)
        near = sum(far(prints[t], prints[u]) <= radius for _, u in docs) - 1 if i is not None and i % 20 == 0 else None
        text = lambda f: f"{f[0]:016x}{f[1]:016x}"
        out.append((i, len(t), sha256(edited.encode()).hexdigest(), text(prints[t]), text(e), 1 - far(prints[t], e) / 128, 1 - far(prints[t], prints[follow]) / 128, near))
    return out


def texts(n, seed):
    rnd = random.Random(seed)
    base = " ".join(rnd.choice("alpha beta gamma delta Ünder eps\tzeta eta theta iota".split(" ")) for _ in range(400))
    rows = []
    for i in rnd.sample(range(-n, 3 * n), n):
        kind = rnd.randrange(4)
        words = base.split(" ")
        if kind < 2:
            words[rnd.randrange(400)] = str(rnd.randrange(9))
        elif kind == 2:
            words = [str(rnd.randrange(10**6)) for _ in range(rnd.randrange(60))]
        rows.append((i, " ".join(words), 1, "x", 7))
    return rows


REPEATS = [(5, "one two three four", 0, "", 0)] * 3 + [(5, "other text", 0, "", 0), (5, None, 0, "", 0), (None, "lost", 0, "", 0), (None, "lost", 0, "", 0), (None, None, 0, "", 0), (0, "", 0, "", 0), (-3, " \n ", 0, "", 0), (20, "𝄞é", None, None, None), (40, "x" * 99 + " y" * 5000, 0, "", 0)]


@pytest.mark.parametrize("rows", [texts(150, 1), REPEATS, [(1, "alone in the table", 0, "", 0)], [(2, None, 0, "", 0)] * 2], ids=["near copies", "repeats and nulls", "one", "two empty"])
def test_same_as_plain_python(spark, rows):
    got = document_fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_empty(spark):
    assert document_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("radius", "blocks"), [(0, 1), (1, 3), (3, 4), (4, 6), (6, 8)])
def test_block_tables_find_all(spark, radius, blocks):
    rnd = random.Random(radius)
    points = {rnd.getrandbits(128) for _ in range(60)}
    for p in list(points):
        for _ in range(6):
            points.add(p ^ sum(1 << b for b in rnd.sample(range(128), rnd.randrange(1, radius + 3))))
    points = sorted(points)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    split = lambda x: (signed(x & (1 << 64) - 1), signed(x >> 64))
    df = spark.createDataFrame([(*split(p), 1) for p in points], "f1 long, f2 long, weight long")
    queries = points[::3]
    found = neighbours(df, spark.createDataFrame([split(p) for p in queries], "f1 long, f2 long"), radius, blocks).collect()
    expected = Counter((*split(q), *split(p)) for q in queries for p in points if (p ^ q).bit_count() <= radius)
    assert Counter(tuple(r)[:4] for r in found) == expected and max(expected.values()) == 1
    assert len(block_masks(radius, blocks)) >= 1


def test_dataframe_functions_only(spark, sf_dir):
    from levelforge.llm.queries import op11_document_fingerprints

    out = op11_document_fingerprints(spark, sf_dir)
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "BroadcastNestedLoop"))
    likeness = out.where("n_chars > 400").agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert likeness[0] > likeness[1] + 0.1
