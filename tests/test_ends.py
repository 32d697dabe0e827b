"""Ends of tracks, guarded renders and budgets: golden points, nulls and empty tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from levelforge.operators import tails

SCHEMA = "track_id string, sample_rate int, channels array<array<double>>"


def track(level, end=0.0, seconds=2.0, rate=8000):
    t = np.arange(int(seconds * rate)) / rate
    x = level * np.sin(2 * np.pi * 440 * t + 0.3)
    n = int(end * rate)
    x[-1] = level
    if n:
        x[-n:] *= np.linspace(1, 0, n)
    return x.tolist()


def test_modes(spark):
    rows = [("loud", track(0.3)), ("cut", track(0.01)), ("micro", track(0.002)), ("quiet", track(1e-5)), ("soft", track(0.3, 1.5))]
    df = spark.createDataFrame([(k, 8000, [x, x]) for k, x in rows] + [("one", 8000, [[0.5]])], SCHEMA)
    out = {r.track_id: r for r in tails.repair_tail(df).collect()}
    assert {k: r.mode for k, r in out.items()} == {"loud": "musical_tail_fade", "cut": "click_safe_fade", "micro": "micro_fade", "quiet": "none", "soft": "none", "one": "musical_tail_fade"}
    assert (out["cut"].fade_ms, out["micro"].fade_ms, out["quiet"].fade_ms, list(out["quiet"].attempted)) == (25.0, 5.0, 0.0, [])
    x = np.array(out["loud"].channels[0])
    n = round(8 * out["loud"].fade_ms)
    ramp = np.linspace(1, 0, n)
    assert x[-1] == 0.0 and np.allclose(x[-n:], np.array(rows[0][1])[-n:] * ramp) and list(out["loud"].attempted) == [f for f in (400.0, 600.0, 800.0, 1200.0) if f <= out["loud"].fade_ms]
    assert tails.repair_tail(df.limit(0)).count() == 0


def test_candidates(spark):
    ladder = lambda *x: list(spark.range(1).select(tails.fade_candidates(*x)).first()[0])
    assert ladder() == [400.0, 600.0, 800.0, 1200.0] and ladder(3.0, [1.0, 7.00049, float("nan"), -5.0, 9999.0, 7.0004], 50.0) == [5.0, 7.0, 50.0] and ladder(400.0, []) == [400.0]


def test_guards(spark):
    rows = [("a", 8, [[0.5, -0.5]]), ("b", 8, [[float("nan"), 0.1]]), ("c", 8, []), ("d", 8, [[0.1], [0.1, 0.2]]), ("e", 8, None), ("f", 8, [[None, 0.1]]), ("g", 8, [[0.9, 0.9, 0.9, -1.0]])]
    df = spark.createDataFrame(rows, SCHEMA).select("track_id", tails.audio_error(F.col("channels")).alias("error"), tails.gain_only(F.col("channels"), F.lit(7.0)).alias("g"), tails.dc_removed(F.col("channels")).alias("d"))
    out = {r.track_id: r for r in df.collect()}
    assert {k: r.error for k, r in out.items()} == {"a": None, "b": "Audio contains NaN or infinity.", "c": "Audio is empty.", "d": "Audio must have shape (frames,) or (frames, channels).", "e": "Audio is empty.", "f": "Audio contains NaN or infinity.", "g": None}
    assert out["a"].g.error == "gain-only render would clip" and out["b"].g.error == "gain-only render produced non-finite samples" and out["g"].d.error == "DC cleanup would produce clipped samples"
    assert out["a"].d.channels == [[0.5, -0.5]] and not out["a"].d.applied and math.isclose(out["g"].d.before, 0.425)


def test_budgets(spark):
    df = spark.createDataFrame([("t", "gate", 1), ("t", "gate", 2), ("t", "x", 3), ("u", None, 1)], "track string, kind string, k int")
    assert sorted((r.track, r.k, r.done, r.left) for r in tails.within_budgets(df, "track", "kind", "k", {"gate": 1}).collect()) == [("t", 1, True, 0), ("t", 2, False, 0), ("t", 3, False, 0), ("u", 1, False, 0)]
