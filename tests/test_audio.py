"""WAV files in chunks, their commit, filters against a recursion, loudness however a track is cut."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelforge.operators import filters, kernels
from levelforge.operators.loudness import loudness
from levelforge.sources import audio, wav

RATE = 8000


def noise(seconds, seed=0, channels=2):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * RATE)) / RATE
    return 0.2 * rng.standard_normal((channels, len(t))) * (0.05 + np.abs(np.sin(t)))


def recursion(sections, x):
    for b0, b1, b2, _, a1, a2 in sections:
        s1, s2, out = 0.0, 0.0, np.zeros_like(x)
        for t in range(x.shape[1]):
            y = b0 * x[:, t] + s1
            s1, s2 = b1 * x[:, t] - a1 * y + s2, b2 * x[:, t] - a2 * y
            out[:, t] = y
        x = out
    return x


@pytest.mark.parametrize("sections", [filters.k_weighting(RATE), filters.butterworth(2, RATE, 90, 220), filters.butterworth(4, RATE, high=110)], ids=["weighting", "band", "low"])
def test_blocks_are_the_recursion(sections):
    x, system = noise(0.3), filters.Cascade(sections)
    y = recursion(sections, x)
    assert np.abs(system.run(x)[0] - y).max() < 1e-11
    state, parts = None, []
    for cut in np.split(x, [1, 255, 256, 257, 1000], axis=1):
        out, state = system.run(cut, state)
        parts.append(out)
    assert np.abs(np.concatenate(parts, axis=1) - y).max() < 1e-11


def test_butterworth_edges():
    def gain(sections, f):
        z = np.exp(-2j * np.pi * f / RATE)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sections]))

    low, band = filters.butterworth(4, RATE, high=110), filters.butterworth(2, RATE, 90, 220)
    assert abs(gain(low, 0) - 1) < 1e-9 and abs(gain(low, 110) - 0.5**0.5) < 1e-9
    assert abs(gain(band, 90) - 0.5**0.5) < 1e-9 and abs(gain(band, 220) - 0.5**0.5) < 1e-9 and gain(band, 0) < 1e-9
    assert abs(gain(filters.butterworth(2, RATE, low=300), 300) - 0.5**0.5) < 1e-9
    x = noise(0.0015)
    assert np.allclose(filters.Cascade(low).both_ways(x), recursion(low, x))


def chunked(spark, tracks, sizes):
    rows = []
    for name, x in tracks.items():
        at, k = 0, 0
        while at < x.shape[1]:
            n = sizes[k % len(sizes)]
            rows.append((name, at, RATE, x[:, at : at + n].tolist()))
            at, k = at + n, k + 1
    return spark.createDataFrame(rows, "track_id string, start long, sample_rate int, channels array<array<double>>")


@pytest.mark.parametrize("sizes", [[10**9], [999], [801, 3, 7000]])
def test_loudness_of_any_chunks(spark, sizes):
    tracks = {"a": noise(4.0), "mono": noise(6.0, 1, 1), "short": noise(0.3, 2), "silent": np.zeros((2, 3 * RATE))}
    got = {r.track_id: r for r in loudness(chunked(spark, tracks, sizes)).collect()}
    for name, x in tracks.items():
        assert got[name].lufs == pytest.approx(kernels.integrated_loudness(x, RATE), abs=1e-6)
        expected = kernels.loudness_range(x, RATE)
        assert (got[name].lra is None) == (expected is None) and (expected is None or got[name].lra == pytest.approx(expected, abs=1e-6))
    assert got["mono"].lra > 0.1


def test_scan_of_blocks(spark):
    from levelforge.operators import loudness as L

    x = noise(4.0)
    parts = chunked(spark, {"a": x}, [500]).mapInPandas(L.weigh, L.PARTS)
    one, many = (sorted(map(tuple, L.states(parts, n).collect())) for n in (1 << 26, 2000))
    assert len(one) == 64 and all(a[:2] == b[:2] and np.allclose(a[2], b[2], atol=1e-14) for a, b in zip(one, many, strict=True))


def test_unmeasurable(spark):
    rows = [("a", 0, RATE, [[0.1, float("nan")]]), ("b", 0, RATE, [[0.1], [0.1, 0.2]]), ("c", 0, RATE, None), ("d", 0, RATE, [[], []])]
    got = {r.track_id: r for r in loudness(spark.createDataFrame(rows, "track_id string, start long, sample_rate int, channels array<array<double>>")).collect()}
    assert all(got[k].error and got[k].lufs is None for k in "abc") and got["d"].lufs == float("-inf") and got["d"].lra is None


def test_long_file_is_read_by_many_tasks(spark, tmp_path):
    x = noise(3.0)
    (tmp_path / "long.wav").write_bytes(wav.encode(x, RATE))
    (tmp_path / "bad.wav").write_bytes(b"RIFF....")
    (tmp_path / "none.wav").write_bytes(wav.encode(x[:, :0], RATE))
    (tmp_path / "_hidden.wav").write_bytes(b"")
    (tmp_path / "cut.wav").write_bytes(wav.encode(x, RATE)[:10_001])
    rows = audio.read_chunks(spark, f"file://{tmp_path}", chunk_frames=1000, split_bytes=10_000)
    by = {}
    for r in rows.withColumn("task", F.spark_partition_id()).collect():
        by.setdefault(r.track_id.rpartition("/")[2], []).append(r)
    assert set(by) == {"long.wav", "bad.wav", "none.wav", "cut.wav"} and by["bad.wav"][0].error and by["none.wav"][0].n_frames == 0
    own = sorted(by["long.wav"], key=lambda r: r.chunk)
    assert [r.start for r in own] == list(range(0, 24_000, 1000)) and len({r.task for r in own}) > 5
    assert np.allclose(np.concatenate([np.array(r.channels) for r in own], axis=1), x, atol=2**-22)
    assert sum(len(r.channels[0]) for r in by["cut.wav"]) == (10_001 - 44) // 6


def test_large_and_float_headers(tmp_path):
    class Bytes:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            return self.data[at : at + n]

    head = audio.header(2_000_000_000, 2, RATE, 3)
    h = audio.read_header(Bytes(head), len(head) + 12_000_000_000)
    assert head[:4] == b"RF64" and (h.n_frames, h.channels, h.width, h.first) == (2_000_000_000, 2, 3, len(head))
    x = np.array([[0.5, -0.25], [1.5, 0.0]])
    raw = x.T.astype("<f4").tobytes()
    data = b"RIFF\0\0\0\0WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<IHHIIHH", 16, 3, 2, RATE, 8 * RATE, 8, 32) + b"data" + struct.pack("<I", len(raw)) + raw
    h = audio.read_header(Bytes(data), len(data))
    assert np.allclose(audio.samples(data[h.first :], h.tag, h.width, h.channels), x)
    for width in (1, 2, 3, 4):
        assert np.abs(audio.samples(audio.pcm(x.clip(-1, 0.9), width), audio.PCM, width, 2) - x.clip(-1, 0.9)).max() <= 2.0 ** (1 - 8 * width)


def tracks(spark, names, n=500):
    rows = [(name, 0, n, RATE, noise(1.0, k)[:, :n].tolist()) for k, name in enumerate(names)]
    return spark.createDataFrame(rows, "track_id string, start long, n_frames long, sample_rate int, channels array<array<double>>")


def test_commit_is_all_or_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    audio.write_chunks(tracks(spark, ["a", "b"]), f"file://{folder}")
    assert sorted(os.listdir(folder)) == ["a.wav", "b.wav"]
    before = (folder / "a.wav").read_bytes()
    for bad in (tracks(spark, ["c", "a"]), tracks(spark, ["x/d", "y/d"]), tracks(spark, ["e", "f"]).withColumn("n_frames", F.when(F.col("track_id") == "f", 501).otherwise(500)), tracks(spark, ["g"]).withColumn("start", F.lit(3))):
        with pytest.raises(Exception, match="there already|one file name|frames came|was due"):
            audio.write_chunks(bad, f"file://{folder}")
        assert sorted(os.listdir(folder)) == ["a.wav", "b.wav"] and (folder / "a.wav").read_bytes() == before
    audio.write_chunks(tracks(spark, ["a", "h"], 7), f"file://{folder}", sample_bytes=1, mode="overwrite")
    assert sorted(os.listdir(folder)) == ["a.wav", "h.wav"]
    assert [(r.n_frames, r.sample_bytes) for r in audio.read_chunks(spark, f"file://{folder}").collect()] == [(7, 1)] * 2
    whole = wav.read_wav(spark, f"file://{folder}")
    assert {len(r.channels[0]) for r in whole.collect()} == {7}
    audio.write_chunks(audio.whole(whole.withColumn("track_id", F.concat(F.lit("new-"), F.element_at(F.split("track_id", "/"), -1)))), f"file://{folder}")
    assert sorted(os.listdir(folder)) == ["a.wav", "h.wav", "new-a.wav", "new-h.wav"]
