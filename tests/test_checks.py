"""Golden points of gate texts, alignment, settings and queue; nulls, ties and empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelforge.functions.levels import fixed, to_float, to_int
from levelforge.operators import alignment, reports, settings
from levelforge.operators import rules as R
from levelforge.plans import tracks
from levelforge.streaming import queue


@pytest.fixture
def value(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first()["x"]


def lit(*xs):
    return [F.lit(x) for x in xs]


def test_numbers_as_printf_writes_them(spark):
    rnd = random.Random(2)
    xs = [0.125, 0.375, 1.005, 1.015, 1.115, 2.675, -0.001, 0.0, -0.125, 0.5, 1e-9, 123456.785] + [rnd.uniform(-500, 500) for _ in range(3000)] + [round(rnd.uniform(-9, 9), 3) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (0, 1, 2, 3):
        got = [tuple(r) for r in df.select("x", fixed(F.col("x"), digits).alias("t"), fixed(F.col("x"), digits, sign=True).alias("s")).collect()]
        assert [(t, s) for _, t, s in got] == [(f"{x:.{digits}f}", f"{x:+.{digits}f}") for x, _, _ in got]
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (None,)], "x double")
    assert [r[0] for r in odd.select(fixed(F.col("x"), 2)).collect()] == ["nan", "inf", "-inf", None]


def test_texts_as_numbers(value):
    assert [value(to_float(F.lit(t), 0.5)) for t in ("1.5", "nan", "inf", "x", "", None)] == [1.5, 0.5, 0.5, 0.5, 0.5, 0.5]
    assert [value(to_int(F.lit(t), 3)) for t in (" 7 ", "-2", "2.5", "", None, "99999999999")] == [7, -2, 3, 3, 3, 3]


def test_peak_trim_starts_above_the_ceiling(value):
    assert [value(R.peak_trim(F.lit(x))) for x in (-1.25, -1.22, -1.2, -1.19, -1.0, -0.76, -0.74, math.inf)] == [0.0, 0.0, 0.0, -0.06, -0.25, -0.49, 0.0, 0.0]


def test_static_is_judged_by_the_middle(value):
    found = lambda high, flat: value(R.noise_decision(*lit(-30.0, 0.5, 0.2, 0.0, 0.3, 0.0, 0.0, high, flat, 0.0)))["found"]
    assert found(0.1, 0.07) == ["HISS", "STATIC"] and found(0.05, 0.07) == ["HISS"] and found(0.1, 0.05) == ["HISS"]


def test_integrity_is_judged_by_the_peak_itself(value):
    issues = lambda peak, after=0.1: value(R.integrity_issues(*lit(0.0, 0, 0, peak, 0.0, 0.1, after)))
    assert issues(-3.0) == [] and issues(0.02) == ["new clipping"] and issues(-3.0, 0.07) == ["high-frequency loss exceeds 2.5 dB"]


def test_lra_is_warned_of_only_without_a_limit(value):
    m = {"lra_reduction": F.lit(1.75)}
    assert value(R.gate_warnings(m)) == ["LRA reduced by 1.75 LU"] and value(R.gate_warnings(m, 0.6)) == []


def test_gate_texts(value):
    m = {"lufs": F.lit(-15.0), "true_peak": F.lit(-0.5), "clipped": F.lit(3), "n_channels": F.lit(1), "correlation": F.lit(-1.0), "duration_delta_ms": F.lit(-5.0), "energetic": F.lit(True), "dc": F.lit(float("nan"))}
    assert value(R.gate_issues(m)) == ["LUFS target miss: -15.00 LUFS (target -14.00 ±0.20)", "true peak exceeded: -0.50 dBTP > -1.00 dBTP", "clipped samples: 3", "unexpected duration loss: -5.00 ms"]
    assert value(R.gate_issues({"rate": F.lit(44100), "correlation": F.lit(-0.5)}, duration_loss=False)) == ["unexpected output sample rate: 44100 Hz (expected 48000 Hz)", "stereo correlation too low: -0.500"]
    note = lambda *x: value(R.delay_note(*lit(*x), F.array(F.lit(240), F.lit(241))))
    assert note(240, True, 0.9) == "confirmed residual processing delay: 240 samples (5.000 ms, confidence 0.90, windows [240,241])"
    assert note(-4, True, 0.9) == "minor delay estimate -4 samples (0.083 ms); below correction threshold" and note(1, True, 0.9) == ""


def test_dynamics_origin(value):
    stats = lambda lra, crest: R.dynamics_stats(*lit(6.0, lra, 12.0, crest))
    origin = lambda base, final: value(R.dynamics_origin(stats(*base), stats(*final)))
    assert [origin((3.0, 12.0), (6.0, 12.0)), origin((6.0, 12.0), (3.0, 12.0)), origin((6.0, 12.0), (6.0, 12.0)), origin((float("nan"), 12.0), (6.0, 12.0))] == ["base", "fullness", "none", "none"]


def shifted(n, delay, seed=1, rate=8000):
    x = np.random.default_rng(seed).normal(size=n + 400)
    return rate, x[200 : 200 + n].tolist(), x[200 - delay : 200 - delay + n].tolist()


def test_delays(spark):
    rows = [("a", *shifted(8000, 37)), ("b", *shifted(8000, -5)), ("c", *shifted(10, 0)), ("d", 8000, [0.0] * 4000, [1.0] * 4000), ("e", 8000, [], [])]
    pairs = spark.createDataFrame(rows, "track_id string, sample_rate int, reference array<double>, processed array<double>")
    out = {r.track_id: r for r in alignment.delay_diagnostics(pairs, 20.0, 5, 0.2).collect()}
    assert (out["a"].delay, out["a"].consistent, out["b"].delay) == (37, True, -5) and out["a"].confidence > 0.95 and list(out["a"].estimates) == [37] * 5
    assert all(out[k].error == alignment.NOTHING and out[k].delay is None for k in "cde")
    assert alignment.delay_diagnostics(pairs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        alignment.delay_diagnostics(pairs, window_count=0)


def test_delays_that_disagree(value):
    windows = lambda *x: F.array(*(F.struct(F.lit(i).alias("start"), F.lit(lag).alias("lag"), F.lit(peak).alias("peak")) for i, (lag, peak) in enumerate(x)))
    d = value(alignment.delay_summary(windows((100, 0.9), (101, 0.8), (400, 0.2), (99, 1.2)), 3))
    assert (d["delay"], d["spread"], d["consistent"]) == (100, 2, True) and abs(d["confidence"] - (0.7 * 0.75 + 0.3 * 0.9)) < 1e-12
    assert not value(alignment.delay_summary(windows((0, 0.9), (100, 0.8)), 3))["consistent"]
    starts = lambda total, window, n: value(alignment.window_starts(F.lit(total), F.lit(window), n))
    assert starts(100, 16, 5) == [0, 21, 42, 63, 84] == np.linspace(0, 84, 5, dtype=int).tolist() and starts(16, 16, 5) == [0] and starts(40, 32, 5) == [0, 8] and starts(40, 40, 5) == [0]


def test_alignment(value):
    tried = lambda *x: value(alignment.should_align(*lit(*x)))
    assert [tried("FAIL", -100, True, 0.8), tried("FAIL", 47, True, 0.8), tried("FAIL", 4801, True, 0.8), tried("FAIL", 100, True, 0.6), tried("WARN", 100, True, 0.9)] == [True, False, False, False, False]
    assert value(alignment.alignment_note(*lit(100, -2))) == "automatic sample alignment applied: +100 → -2 samples"
    assert not value(alignment.aligned(F.lit(100), F.lit(None).cast("int"), F.lit("PASS")))


def test_one_pass_over_tracks(spark):
    t = np.arange(48_000) / 48_000
    x = (0.1 * np.sin(2 * np.pi * 440 * t)).tolist()
    df = spark.createDataFrame([("a", 48_000, [x, x]), ("b", 48_000, [x]), ("bad", 48_000, [x, x[:5]])], "track_id string, sample_rate int, channels array<array<double>>")
    out = {r.track_id: r for r in tracks.analyze(df).collect()}
    assert out["a"].n_channels == 2 and out["b"].n_channels == 1 and abs(out["a"].peak_db + 20) < 0.01 and out["bad"].error and out["bad"].lufs is None
    assert abs(out["a"].end_rms_db - 20 * math.log10(0.1 / math.sqrt(2))) < 0.02
    assert tracks.compare(tracks.analyze(df), tracks.analyze(df)).count() == 3


def test_profiles_and_keys(spark, value):
    rows = [(n, k, "1") for n in ("good", "lacks", "odd") for k in settings.REQUIRED if not (n == "lacks" and k == "outputBitDepth")]
    rows = [(n, k, "16" if k == "outputBitDepth" else "-1" if k == "truePeakCeilingDbtp" else "x" if n == "odd" and k == "targetLufsI" else v) for n, k, v in rows] + [("good", "other", "y")]
    out = {r.name: r.error for r in settings.profile_errors(spark.createDataFrame(rows, "name string, key string, value string")).collect()}
    assert out == {"good": None, "lacks": "Profile 'lacks' is missing fields: outputBitDepth", "odd": "Profile 'odd' field 'targetLufsI' must be numeric."}
    assert value(settings.scaled_compressor(F.array(*lit(0.2, 3.0, 30.0, 300.0, 1.5)), F.lit(0.35))) == [0.2, 1.7, 30.0, 300.0, 1.175]
    assert [value(settings.known_key(F.lit(k), ["A", "B"], "A", "B")) for k in (" b", "x", "", None)] == ["B", "B", "A", "A"]
    assert value(settings.pre_chain(F.array(F.lit("eq")), F.array(*lit(0.2, 3.0, 30.0, 300.0, 1.5)), F.lit(0.1))) == "eq,acompressor=threshold=0.2:ratio=1.600:attack=30.0:release=300.0:makeup=1.5"


def test_queue_of_nulls(spark):
    jobs = spark.createDataFrame([("q", 1, 1, "RUNNING"), ("q", 2, 2, "WAITING"), ("q", 3, 3, "WAITING"), ("p", 4, 4, "WAITING"), ("r", 5, 5, "WAITING"), ("r", 6, 5, "WAITING"), (None, 7, 7, "WAITING"), ("r", 8, 0, None)], "queue string, job_id long, seq long, status string")
    queues = spark.createDataFrame([("q", 2, None, None), ("p", 1, True, None), ("r", 9, False, False)], "queue string, asked int, paused boolean, stop_after_current boolean")
    assert {tuple(r) for r in queue.launch(jobs, queues).collect()} == {("q", 2), ("r", 5)}
    actions = spark.createDataFrame([(1, "remove"), (2, "cancel"), (2, "remove"), (3, "cancel"), (8, "cancel")], "job_id long, action string")
    assert {(r.job_id, r.status) for r in queue.act(jobs, actions).collect()} == {(1, "RUNNING"), (3, "CANCELLED"), (4, "WAITING"), (5, "WAITING"), (6, "WAITING"), (7, "WAITING"), (8, None)}
    assert queue.without_waiting(jobs).count() == 2 and queue.stale(jobs, jobs.where("job_id < 3")).count() == 6


def test_reports_of_nulls(spark):
    gate = spark.createDataFrame([("a", " n1 ", 1), ("a", "n2", 2), ("a", "", 3), (None, "x", 1), (" ", "x", 1), ("b", None, 1)], "track string, tail_note string, k int")
    assert [tuple(r) for r in reports.tail_notes(gate, "k").collect()] == [("a", "n2")]
    assert sorted(tuple(r) for r in reports.noise_summary(spark.createDataFrame([("CLEAN",), (None,), ("x",)], "result string")).collect()) == [("CLEAN", 1), ("NEEDS_REVIEW", 2), ("REPAIRED_LIGHT", 0), ("REPAIRED_MEDIUM", 0)]
    jobs = spark.createDataFrame([(1, None, "PASS"), (1, "READY", "WARN"), (2, "READY_WITH_WARNING", None)], "job int, disposition string, status string")
    assert sorted(tuple(r) for r in reports.job_results(jobs, "job").collect()) == [(1, "COMPLETED_WITH_REVIEW", 2, 1, 1, 1, 1, 0), (2, "COMPLETED", 1, 1, 0, 0, 0, 0)]
    assert [tuple(r) for r in reports.last_by(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z")], "k string, n int, v string"), "k", "n").collect()] == [("a", 2, "z")]
    assert spark.range(1).select(reports.with_text(F.array(F.lit("a")), F.lit("a")), reports.with_text(F.array(F.lit("a")), F.lit(None).cast("string")), reports.has_issue(F.array(F.lit("LUFS x")), "LUFS")).first()[:] == (["a"], ["a"], True)
