"""Audio files through Spark's binary reader: scan, decode (PCM and float WAV), write."""

from __future__ import annotations

import io
import struct
import uuid
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed suffixes that a folder scan keeps.
SUFFIXES = ["wav", "mp3", "flac", "m4a", "aac", "ogg"]


def scan(spark: SparkSession, folder: str, suffixes: list[str] | None = None, recursive: bool = False) -> DataFrame:
    """(path, name, folder, length) of audio files; the contents are not read. Sort with ``by_name``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(suffixes or SUFFIXES))
    return kept.select("path", name.alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "length")


def by_name(files: DataFrame) -> DataFrame:
    return files.orderBy(F.lower("name"))


def folders(files: DataFrame, expected: int = 15) -> DataFrame:
    """(folder, n, warning): folders with audio files, with a warning unless they hold the expected number."""
    n = files.groupBy("folder").agg(F.count("*").alias("n"))
    return n.withColumn("warning", F.when(F.col("n") != expected, F.format_string("%d files instead of %d", F.col("n"), F.lit(expected))))


#: Fixed format tags of WAV files: whole numbers, floats, and the one whose real tag comes later in the header.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def chunks(data: bytes) -> dict[bytes, bytes]:
    """The first chunk of each name of a WAV file; ValueError where it is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    out, at = {}, 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        out.setdefault(name, data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    if b"fmt " not in out or b"data" not in out or len(out[b"fmt "]) < 16:
        raise ValueError("no format or no samples")
    return out


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, sample bytes, channels x samples) of WAV bytes: PCM of 8 to 32 bits in -1..1, floats of 32 and 64 bits as they are."""
    parts = chunks(data)
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", parts[b"fmt "])
    if tag == EXTENSIBLE and len(parts[b"fmt "]) >= 26:
        tag = struct.unpack_from("<H", parts[b"fmt "], 24)[0]
    width = bits // 8
    if not channels or not rate or bits % 8 or (tag, width) not in {*((PCM, w) for w in (1, 2, 3, 4)), (FLOAT, 4), (FLOAT, 8)}:
        raise ValueError(f"format {tag} with {bits} bits is not read")
    raw = np.frombuffer(parts[b"data"], np.uint8)
    raw = raw[: len(raw) // (width * channels) * (width * channels)].reshape(-1, width)
    if tag == FLOAT:
        x = np.ascontiguousarray(raw).view(f"<f{width}")[:, 0].astype(np.float64)
    elif width == 1:
        x = (raw[:, 0].astype(np.float64) - 128) / 128
    else:
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, 4 - width :] = raw
        x = wide.view("<i4")[:, 0] / 2.0**31
    return rate, width, x.reshape(-1, channels).T


def encode(x: np.ndarray, rate: int, width: int = 3) -> bytes:
    """PCM WAV bytes of channels x samples, 24 bits unless asked otherwise."""
    top = 2 ** (8 * width - 1)
    whole = np.clip(np.round(x.T * top), -top, top - 1).astype("<i4")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(x))
        w.setsampwidth(width)
        w.setframerate(rate)
        raw = np.ascontiguousarray(whole).view(np.uint8).reshape(-1, 4)[:, :width]
        w.writeframes((raw ^ (0x80 if width == 1 else 0)).tobytes())
    return out.getvalue()


def read_wav(spark: SparkSession, folder: str) -> DataFrame:
    """Tracks (track_id, sample_rate, sample_bytes, channels, error); a file that is no WAV of ``decode``'s formats has its reason in error."""

    def run(frames):
        for frame in frames:
            out = []
            for path, content in frame.itertuples(index=False):
                try:
                    rate, width, x = decode(content)
                    out.append((path, rate, width, list(x), None))
                except (wave.Error, EOFError, ValueError) as e:
                    out.append((path, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["track_id", "sample_rate", "sample_bytes", "channels", "error"]).astype({"sample_rate": "Int32", "sample_bytes": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{wav,WAV,wave}").load(folder).select("path", "content")
    return files.mapInPandas(run, "track_id string, sample_rate int, sample_bytes int, channels array<array<double>>, error string")


def to_wav(tracks: DataFrame, width: int = 3) -> DataFrame:
    """(track_id, content): WAV bytes of each track, for a binary sink or a table."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"track_id": frame["track_id"], "content": [encode(np.array([np.asarray(c) for c in r.channels]), int(r.sample_rate), width) for r in frame.itertuples(index=False)]})

    return tracks.select("track_id", "sample_rate", "channels").mapInPandas(run, "track_id string, content binary")


def write_wav(tracks: DataFrame, folder: str, width: int = 3) -> DataFrame:
    """Write a file for each track in ``folder`` (which driver and executors share); returns (track_id, path).

    A name is the track's own with a random part, so a repeated task never
    writes over a file: paths that are in no returned row are orphans of it.
    Evaluate the result once (write it), as each evaluation writes anew.
    """

    def run(frames):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for frame in frames:
            out = []
            for track, content in frame.itertuples(index=False):
                name = f"{str(track).rpartition('/')[2].removesuffix('.wav')}-{uuid.uuid4().hex}.wav"
                with system.open_output_stream(f"{root}/{name}") as f:
                    f.write(content)
                out.append((track, f"{folder.rstrip('/')}/{name}"))
            yield pd.DataFrame(out, columns=["track_id", "path"])

    kind = tracks.schema["track_id"].dataType.simpleString()
    return to_wav(tracks, width).mapInPandas(run, f"track_id {kind}, path string")
