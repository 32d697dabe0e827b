"""Shards of fingerprints: every close pair meets in one, and none is too large however many points there are."""

import numpy as np

from levelforge.llm import simhash


def points(n, seed=3):
    rnd = np.random.default_rng(seed)
    x = rnd.integers(0, 1 << 63, n).astype(np.uint64)
    flip = lambda v: v ^ np.uint64(1) << rnd.integers(0, 64, len(v)).astype(np.uint64)
    return np.unique(np.concatenate([x, flip(flip(x[: n // 10])), flip(x[n // 10 : n // 5])]))


def test_close_points_meet():
    x = points(4000)
    nodes = simhash.fit_router(x[::4], 40, 2)
    shards = [set() for _ in x]
    for k, own in simhash.route(x, nodes, 2):
        for i in own.tolist():
            shards[i].add(k)
    for i in range(0, len(x), 500):
        for a, b in np.argwhere(np.bitwise_count(x[i : i + 500, None] ^ x[None]) <= 2):
            assert shards[a + i] & shards[b]


def test_large_shards_are_dealt_out_again(spark, caplog):
    x = points(30_000)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    with caplog.at_level("INFO", logger="levelforge.llm.simhash"):
        got = {tuple(r) for r in simhash.near_links(df, 2, sample=1000, points_per_shard=500).collect()}
    copies, largest = (int(w.strip(",")) for w in (caplog.records[-1].getMessage().split()[0], caplog.records[-1].getMessage().split()[-1]))
    assert largest <= 2000 and copies < 40 * len(x)
    forest, expected = simhash.Forest(len(x)), simhash.link_within(x, 2)
    at = {v: i for i, v in enumerate(x.view(np.int64).tolist())}
    forest.link(np.array([at[a] for a, _ in got]), np.array([at[b] for _, b in got]))
    assert np.array_equal(forest.parent, expected)


def test_small_samples_still_make_shards_that_fit(spark, caplog):
    x = np.unique(np.random.default_rng(9).integers(0, 1 << 63, 80_000).astype(np.uint64))
    x = np.unique(np.concatenate([x, x[:500] ^ np.uint64(5)]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    with caplog.at_level("INFO", logger="levelforge.llm.simhash"):
        got = {frozenset(np.array(r, np.int64).view(np.uint64).tolist()) for r in simhash.near_links(df, 2, sample=200, points_per_shard=2000).collect()}
    assert int(caplog.records[-1].getMessage().split()[-1]) <= 8000
    assert got == {frozenset((int(v), int(v) ^ 5)) for v in x[np.isin(x ^ np.uint64(5), x)]}


def test_keep_one_leaves_other_columns(spark):
    rows = [(1, "a b c d", 1, 2, 3), (2, "a b c d", 4, 5, 6), (None, "x y z", 7, 8, 9), (None, "x y z", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash__ long, id__ long, text_hash long")
    assert sorted(map(str, simhash.keep_one(docs).collect())) == sorted(map(str, spark.createDataFrame([rows[0], rows[2]], docs.schema).collect()))
