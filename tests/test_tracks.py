"""Kernels, WAV files, whole-track plans, profiles and the queue."""

import numpy as np
import pytest

from levelforge.operators import kernels as K
from levelforge.operators import profiles
from levelforge.plans import tracks
from levelforge.sources import wav
from levelforge.streaming import queue

RATE = 48_000


def tone(f=440.0, seconds=2.0, level=0.1, rate=RATE):
    t = np.arange(int(seconds * rate)) / rate
    x = level * np.sin(2 * np.pi * f * t)
    return np.array([x, x])


def test_loudness():
    # Full-scale 997 Hz in one channel reads -3.01 LUFS by definition of the weighting.
    x = tone(997.0, 5.0, 1.0)[:1]
    assert abs(K.integrated_loudness(x, RATE) + 3.01) < 0.05
    y = tone(level=0.1)
    assert abs(K.integrated_loudness(y * 10 ** (1 / 20), RATE) - K.integrated_loudness(y, RATE) - 1) < 0.01
    assert K.integrated_loudness(np.zeros((1, RATE)), RATE) == float("-inf")
    assert K.loudness_range(tone(seconds=1.0), RATE) is None
    assert K.loudness_range(tone(seconds=8.0), RATE) < 0.2


def test_peaks_and_bands():

    x = 0.5 * np.sin(2 * np.pi * np.arange(RATE) / 4 + np.pi / 4)[None]
    assert abs(np.abs(x).max() - 0.3535) < 1e-3 and abs(K.true_peak(x, RATE) - 0.5) < 0.01
    assert max(K.band_levels(tone(100.0)[0], RATE).items(), key=lambda kv: kv[1])[0] == "60-120Hz"
    assert abs(K.resample(tone(rate=44_100), 44_100, RATE).shape[1] - 2 * RATE) <= 1
    assert K.low_band_correlation(tone(60.0), RATE) > 0.999
    y = K.fullness(tone(150.0), RATE, 0.5, 0.2, 3.0, 2.0)
    assert abs(K.integrated_loudness(y, RATE) - K.integrated_loudness(tone(150.0), RATE)) < 0.2


def test_wav_round_trip_and_gate(spark, tmp_path):
    good, cut = tone(seconds=4.0), tone(seconds=4.0)
    good[:, -9600:] *= np.linspace(1, 0, 9600)
    (tmp_path / "a.wav").write_bytes(wav.encode(good, RATE))
    (tmp_path / "B.wav").write_bytes(wav.encode(cut, RATE))
    (tmp_path / "c.wav").write_bytes(b"not audio")
    read = wav.read_wav(spark, f"file://{tmp_path}")
    by = {r.track_id.rpartition("/")[2]: r for r in read.collect()}
    assert by["c.wav"].error and not by["a.wav"].error
    assert np.allclose(np.array(by["a.wav"].channels), good, atol=2**-22)
    assert [r.name for r in wav.by_name(wav.scan(spark, f"file://{tmp_path}")).collect()] == ["a.wav", "B.wav", "c.wav"]
    seen = tracks.analyze(read.where("error IS NULL")).cache()
    m = {r.track_id.rpartition("/")[2]: r for r in seen.collect()}
    assert -20.2 < m["a.wav"].peak_db < -19.8 and m["a.wav"].correlation > 0.999 and m["a.wav"].clipped == 0
    verdict = {r.track_id.rpartition("/")[2]: r for r in tracks.compare(seen, seen, target_lufs=m["B.wav"].lufs).collect()}
    assert any(i.startswith("TAIL HARD CUT: end RMS ") for i in verdict["B.wav"].issues) and verdict["B.wav"].status == "FAIL"
    assert not [i for i in verdict["a.wav"].issues if "TAIL" in i]


def test_profiles(spark):
    schema = "name string, inherits string, key string, value double"
    rows = [("base", None, "n.a", 1.0), ("base", None, "n.b", 2.0), ("child", "base", "n.b", 9.0)]
    got = {(r.name, r.key): r.value for r in profiles.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert got["child", "n.a"] == 1.0 and got["child", "n.b"] == 9.0
    rows = [("base", None, "limits.a", 1.0), ("base", None, "limits.b", 2.0), ("base", None, "limits.c.d", 3.0), ("base", None, "limitsx.y", 4.0), ("child", "base", "limits", 9.0), ("grand", "child", "limits.b", 5.0), ("grand", "child", "limitsx.y.z", 6.0)]
    got = sorted(tuple(r) for r in profiles.resolve(spark.createDataFrame(rows, schema)).where("name <> 'base'").collect())
    assert got == [("child", "limits", 9.0), ("child", "limitsx.y", 4.0), ("grand", "limits.b", 5.0), ("grand", "limitsx.y.z", 6.0)]
    chain = [(f"p{i}", f"p{i - 1}" if i else None, f"k{i}", float(i)) for i in range(70)]
    assert profiles.resolve(spark.createDataFrame(chain, schema)).where("name = 'p69'").count() == 70
    with pytest.raises(profiles.ProfileError, match="circle"):
        profiles.resolve(spark.createDataFrame([("tail", "x", "k", 1.0), ("x", "y", "k", 1.0), ("y", "x", "k", 1.0)], schema))
    with pytest.raises(profiles.ProfileError):
        profiles.resolve(spark.createDataFrame([("x", "gone", "k", 1.0)], schema))
    with pytest.raises(profiles.ProfileError):
        profiles.resolve(spark.createDataFrame([("x", "y", "k", 1.0), ("y", "x", "k", 1.0)], schema))


def test_queue_stream(spark, tmp_path):
    events = [(1, 1, "submit"), (2, 2, "submit"), (3, 3, "submit")], [(1, 4, "finish")], [(2, 5, "fail")]
    source = tmp_path / "in"
    source.mkdir()
    schema = "job_id long, seq long, kind string"
    seen = []
    for i, rows in enumerate(events):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{source}/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{source}")
        queue.follow(stream, f"file://{tmp_path}/jobs", f"file://{tmp_path}/cp", 1).trigger(availableNow=True).start().awaitTermination()
        seen.append({r.job_id: r.status for r in spark.read.parquet(f"file://{tmp_path}/jobs/{i}").collect()})
    assert seen == [{1: "RUNNING", 2: "WAITING", 3: "WAITING"}, {1: "COMPLETED", 2: "RUNNING", 3: "WAITING"}, {1: "COMPLETED", 2: "FAILED", 3: "RUNNING"}]
