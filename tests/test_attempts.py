"""Alignment with roll-back, and ladders that render only what failed before."""

import numpy as np
from pyspark.sql import functions as F

from levelforge.operators import kernels
from levelforge.operators.attempts import align, ladder
from levelforge.plans import attempts

RATE = 1000


def signal(n=1500, seed=1):
    x = np.random.default_rng(seed).standard_normal(n) * 0.1
    x[-200:] = 0
    return x


def moved(x, d):
    y = np.zeros_like(x)
    if d >= 0:
        y[d:] = x[: len(x) - d]
    else:
        y[:d] = x[-d:]
    return y


def test_alignment_keeps_what_helps(spark):
    x = signal()
    loud = x.copy()
    loud[-260:] = 0.5
    made = {"late": moved(x, 60), "early": moved(x, -70), "small": moved(x, 20), "echo": 0.6 * moved(x, 70) + moved(x, 130), "silent": 0 * x, "loud end": moved(loud, 60)}
    rows = [(k, RATE, (loud if k == "loud end" else x).tolist(), [v.tolist(), (0.5 * v).tolist()]) for k, v in made.items()]
    tracks = spark.createDataFrame(rows, "track_id string, sample_rate int, reference array<double>, channels array<array<double>>")

    def judge(t, delays):
        d = t.select("track_id").join(delays.select("track_id", "kind"), "track_id", "left")
        return d.select("track_id", F.when(F.col("kind") == "FAIL", F.array(F.lit("delay"))).otherwise(F.array().cast("array<string>")).alias("issues"), F.array(F.lit("warned")).alias("warnings"))

    out = {r.track_id: r for r in align(tracks, judge, max_delay_ms=100.0, window_count=3, window_seconds=0.4).collect()}
    assert {k for k, r in out.items() if r.aligned} == {"late", "early", "loud end"}
    assert (out["late"].first_delay, out["late"].delay, out["late"].status, out["late"].warnings[-1]) == (60, 0, "PASS", "automatic sample alignment applied: +60 → +0 samples")
    assert np.allclose(out["early"].channels[0][70:], x[70:]) and out["early"].first_delay == -70
    assert (out["small"].status, out["small"].delay) == ("WARN", 20)
    assert (out["echo"].status, out["echo"].delay) == ("FAIL", 70) and np.allclose(out["echo"].channels[0], made["echo"])
    assert out["silent"].delay is None and out["silent"].status == "WARN"
    assert out["loud end"].mode != "none" and abs(out["loud end"].channels[0][-1]) < 1e-3


def test_rounds_render_what_failed_before(spark, sf_dir):
    t = attempts.frames(spark, sf_dir).select(F.col("vec_id").cast("string").alias("track_id"), F.lit(48_000).alias("sample_rate"), F.array("l", "r").alias("channels"))
    out, rendered = ladder(t, attempts.STRENGTHS, attempts.densified, attempts.within_peak)
    n = {r.strength: r["count"] for r in out.groupBy("strength").count().collect()}
    assert rendered == [500, 500 - n[100], 500 - n[100] - n[75], 500 - n[100] - n[75] - n[50]] and sum(n.values()) == 500 and len(set(rendered)) > 2


def test_ladder_with_the_fullness_chain(spark):
    rate = 8000
    t = np.arange(rate) / rate
    rows = [(str(k), rate, [(a * np.sin(2 * np.pi * 150 * t)).tolist()] * 2) for k, a in enumerate((0.1, 0.55, 0.9))]
    tracks = spark.createDataFrame(rows, "track_id string, sample_rate int, channels array<array<double>>")

    def render(df):
        share = F.col("strength") / 100.0
        return kernels.render_fullness(df.withColumns({"warmth": 0.8 * share, "body": 0.5 * share, "saturation": 6.0 * share, "density": 5.0 * share}))

    def judge(both):
        peak = F.array_max(F.transform("channels", lambda c: F.array_max(F.transform(c, F.abs))))
        first = F.array_max(F.transform("original", lambda c: F.array_max(F.transform(c, F.abs))))
        return both.select("track_id", F.when(F.abs(peak - first) > 0.004 * F.col("track_id").cast("int"), F.array(F.lit("crest"))).otherwise(F.array().cast("array<string>")).alias("reasons"))

    out, rendered = ladder(tracks, [100, 50, 25, 0], render, judge)
    got = {r.track_id: (r.strength, r.reasons) for r in out.collect()}
    assert got["0"] == (0, ["crest"]) and rendered[0] == 3 and all(s in (0, 25, 50, 100) for s, _ in got.values())


def test_empty(spark):
    tracks = spark.createDataFrame([], "track_id string, sample_rate int, reference array<double>, channels array<array<double>>")
    assert align(tracks, attempts.judged).count() == 0
    out, rendered = ladder(tracks.drop("reference"), [100, 0], attempts.densified, attempts.within_peak)
    assert out.count() == 0 and rendered == [0]
