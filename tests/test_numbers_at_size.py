"""Numbers as printf writes them, by one expression for each."""

from pyspark.sql import functions as F

from levelforge.functions.levels import fixed


def test_the_value_is_used_a_few_times_only(spark):
    """The text of a long expression must not repeat it in every step of the rounding."""
    text = fixed(F.col("id") / 7 - 3000, 2, sign=True).alias("t")
    assert spark.range(1).select(text)._jdf.queryExecution().analyzed().toString().count("3000") < 16


def test_zeros_and_ties(spark):
    halves = [k * 5 * 10.0**-d for d in range(8) for k in (1, -1, 3, 1.1)]
    for digits in range(7):
        got = spark.createDataFrame([(x,) for x in halves], "x double").select("x", fixed(F.col("x"), digits).alias("t")).collect()
        assert [r.t for r in got] == [f"{x:.{digits}f}" for x in halves]
    xs = [-0.0, 0.0, 2.675, 1.005, 0.125, -0.375, 1e15, -4e-5, 123456789012.345]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", fixed(F.col("x"), 2).alias("t"), fixed(F.col("x"), 2, sign=True).alias("s")).collect()
    assert [(r.t, r.s) for r in got] == [(f"{x:.2f}", f"{x:+.2f}") for x in xs]
