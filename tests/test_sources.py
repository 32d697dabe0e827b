"""Files in and out: WAV formats, JSON with defaults, reports, pages, and texts."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelforge.operators import profiles
from levelforge.sources import tables, wav


def wave(tag, bits, x, rate=8000, extensible=False, junk=b""):
    raw = x.T.astype(f"<f{bits // 8}").tobytes() if tag == wav.FLOAT else x
    channels = len(x) if tag == wav.FLOAT else 1
    fmt = struct.pack("<HHIIHH", wav.EXTENSIBLE if extensible else tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    fmt += struct.pack("<HHIH14s", 22, bits, 0, tag, b"") if extensible else b""
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + junk + b"data" + struct.pack("<I", len(raw)) + raw
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav_formats():
    x = np.array([[0.5, -0.25, 1.5], [0.0, 0.125, -1.0]])
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    for bits in (32, 64):
        for extensible in (False, True):
            rate, width, got = wav.decode(wave(wav.FLOAT, bits, x, extensible=extensible, junk=odd))
            assert (rate, width) == (8000, bits // 8) and np.array_equal(got, x)
    for width in (1, 2, 3, 4):
        rate, got_width, got = wav.decode(wav.encode(np.clip(x, -1, 1), 8000, width))
        assert got_width == width and np.allclose(got, np.clip(x, -1, 1), atol=2.0 ** (2 - 8 * width))
    for bad in (b"", b"not audio at all", wave(wav.FLOAT, 32, x)[:20], wave(2, 16, b"\0\0"), wave(wav.PCM, 12, b"\0\0")):
        with pytest.raises(ValueError):
            wav.decode(bad)


def test_wav_files(spark, tmp_path):
    x = [[0.5, -0.25], [0.0, 0.125]]
    out = wav.write_wav(spark.createDataFrame([("in/a.wav", 8000, x), ("b", 8000, x)], "track_id string, sample_rate int, channels array<array<double>>"), f"file://{tmp_path}/out").collect()
    assert sorted(r.track_id for r in out) == ["b", "in/a.wav"] and all(wav.decode(open(r.path.removeprefix("file://"), "rb").read())[2].shape == (2, 2) for r in out)
    (tmp_path / "more").mkdir()
    for n in ("x.wav", "y.FLAC", "z.txt"):
        (tmp_path / "more" / n).write_bytes(b"1")
    seen = wav.scan(spark, f"file://{tmp_path}", recursive=True)
    assert {r.folder.rpartition("/")[2]: (r.n, r.warning) for r in wav.folders(seen, 2).collect()} == {"out": (2, None), "more": (2, None)}
    assert {r.warning for r in wav.folders(seen).collect()} == {"2 files instead of 15"}


def test_json(spark, tmp_path):
    for name, text in (("a", '{"x": 1, "y": "s"}'), ("b", "{broken"), ("c", '{"y": null}'), ("d", "[1]")):
        (tmp_path / f"{name}.json").write_text(text)
    path = f"file://{tmp_path}"
    got = {r.path.rpartition("/")[2]: (r.x, r.y) for r in tables.read_json(spark, path, "x int, y string", defaults={"x": 7}).collect()}
    assert got == {"a.json": (1, "s"), "b.json": (7, None), "c.json": (7, None), "d.json": (7, None)}
    assert {(r.x, r.y) for r in tables.read_json(spark, f"{path}/a.json", "x int, y string", strict=True).collect()} == {(1, "s")}
    (tmp_path / "a.json").write_text('{"profiles": {}, "global": 3}')
    errors = {r.path.rpartition("/")[2]: r.error for r in tables.check_json(spark, path, ["profiles", "global"]).collect()}
    assert errors["a.json"] == "missing objects: global" and errors["d.json"] == "missing objects: profiles, global" and errors["b.json"].endswith("line 1 column 2")


def test_reports(spark, tmp_path):
    rows = [("b1", 2, "<x> & 'y'", "PASS", float("nan")), ("b1", 1, None, "FAIL", 1.5), ("b2", 1, "z", "WARN", float("-inf"))]
    df = spark.createDataFrame(rows, "batch string, track int, name string, status string, lufs double")
    out = {r.batch: json.loads(r.value) for r in tables.quality_json(df, "batch", "track").collect()}
    assert out["b1"] == [{"track": 1, "name": None, "status": "FAIL", "lufs": 1.5}, {"track": 2, "name": "<x> & 'y'", "status": "PASS", "lufs": None}]
    page = {r.batch: r.value for r in tables.quality_pages(df, "batch", "status", ["track", "name"], "A & B").collect()}["b1"]
    assert "<h1>A &amp; B</h1><p>PASS 1 / WARN 0 / FAIL 1</p>" in page and page.index("<td>1</td><td></td>") < page.index("<td>&lt;x&gt; &amp; &#x27;y&#x27;</td>")
    assert tables.quality_pages(df.limit(0), "batch", "status", ["track"], "t").count() == 0
    tables.write_report(df, f"file://{tmp_path}/csv", ["track", "name", "more"])
    back = tables.read_report(spark, f"file://{tmp_path}/csv")
    assert back.columns == ["track", "name", "more"] and {r.name for r in back.collect()} == {"<x> & 'y'", None, "z"}
    tables.write_release(df.withColumn("release_bucket", F.lit("ready")), f"file://{tmp_path}/release")
    assert spark.read.parquet(f"file://{tmp_path}/release").count() == 3
    assert [r.value for r in tables.error_traces(spark.createDataFrame([(1, "abc"), (2, None)], "t int, e string"), "t", "e", 2).collect()] == ["bc"]
    (tmp_path / "t.txt").write_text("made by v3.8.1\nand v2, not vat1 or v1x")
    assert tables.renew_version(spark, f"file://{tmp_path}/t.txt", "v3.9").first().value == "made by v3.9\nand v3.9, not vat1 or v1x"


def test_compose(spark):
    c = spark.createDataFrame([("A", "a", -14.0, 2.0, 6.0, 3.0, 4.0, 0.8, 0.5)], "key string, label string, target double, concession double, lra double, max_wet double, max_dense double, max_lra_reduction double, scale double")
    g = spark.createDataFrame([("X", "x", 8.0, 2.0, 5.0, 0.6, 3.0), ("Y", None, 8.0, 9.0, 1.0, 0.9, 2.0)], "key string, label string, lra double, max_wet double, max_dense double, max_lra_reduction double, ratio double")
    out = {r.key: r for r in profiles.compose(c, g).collect()}
    assert (out["CG_A__X"].target_lra, out["CG_A__X"].max_wet, out["CG_A__X"].max_dense, out["CG_A__X"].max_lra_reduction, out["CG_A__X"].ratio) == (6.9, 2.0, 4.0, 0.6, 2.0)
    assert out["CG_A__Y"].label is None and profiles.compose(c, g.limit(0)).count() == 0
    with pytest.raises(profiles.ProfileError):
        profiles.compose(c, g, most_genres=1)
