"""Two-level scans against plain Python: hot keys, null keys, blocks with neighbours."""

import random

from pyspark.sql import functions as F

from levelforge.operators.scans import framed, numbered, placed, running


def rows(n=500):
    rnd = random.Random(5)
    return [(rnd.choice(["hot", "hot", "a", "b", None]), i, rnd.randrange(100)) for i in rnd.sample(range(n), n)]


def test_numbers_and_running_totals(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, t long, v long").repartition(7)
    got = running(numbered(df, ["k"], ["t"], "i", "n"), ["k"], "i", {"s": F.col("v")}, size=16)
    xor = running(numbered(df, ["k"], ["t"], "i"), ["k"], "i", {"x": F.col("v")}, F.bit_xor, size=16)
    expected, xors = [], []
    for k in {r[0] for r in data}:
        own, s, x = sorted(r for r in data if r[0] == k) if k else sorted((r for r in data if r[0] is None), key=lambda r: r[1]), 0, 0
        for i, r in enumerate(own, 1):
            s, x = s + r[2], x ^ r[2]
            expected.append((*r, i, len(own), s))
            xors.append((*r, i, x))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    assert sorted(map(str, map(tuple, xor.collect()))) == sorted(map(str, xors))


def test_frames_cross_blocks(spark):
    df = spark.createDataFrame([(1, i, float(i * i % 17)) for i in range(1, 101)], "k long, i long, v double")
    out = framed(df, ["k"], "i", 3, 2, {"back": lambda w: F.lag("v", 3).over(w), "mean": lambda w: F.avg("v").over(w.rowsBetween(-1, 2))}, size=8).orderBy("i").collect()
    v = [r.v for r in out]
    assert [r.i for r in out] == list(range(1, 101))
    assert [r.back for r in out] == [None] * 3 + v[:-3]
    assert all(abs(r.mean - sum(v[max(0, j - 1) : j + 3]) / len(v[max(0, j - 1) : j + 3])) < 1e-9 for j, r in enumerate(out))


def test_empty(spark):
    df = spark.createDataFrame([], "k string, t long")
    assert numbered(df, ["k"], ["t"], "i", "n").count() == 0
    assert numbered(df, [], ["t"], "i").count() == 0


def test_large_keys_are_numbered_across_tasks(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, t long, v long").repartition(7)
    one, two = (sorted(map(str, map(tuple, placed(df, ["k"], ["t"], "i", "n", most).collect()))) for most in (10, 1000))
    assert one == two and len(one) == len(data)


def test_a_hot_series_is_dealt_out(spark):
    """A key with all rows: no task of the frames gets more than a block and its neighbours."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("i") + 1, F.col("id").alias("v")).toDF("k", "i", "v")
    out = framed(df, ["k"], "i", 1, 0, {"before": lambda w: F.lag("v").over(w)}, size=500)
    assert out.where("before = v - 1 OR (i = 1 AND before IS NULL)").count() == 20_000
    assert out.withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0] < 20_000
