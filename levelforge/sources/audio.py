"""``wavfiles``: a data source for WAV files of any length, in chunks of frames, and a sink that commits whole files.

Reading: a partition is a byte range of a file (or several small files), planned
from sizes alone, as Spark plans any file. A task reads the header of its file
and then only the chunks that begin in its range, so one long file is read by
many tasks and no row holds more than ``chunk_frames`` frames.

Writing: the chunks of a track come to one task in order and go through it as a
stream. Files are written under temporary names; the commit on the driver gives
them their own, and removes what failed or lost tasks have left. A job that
fails leaves no file under a track's name.
"""

from __future__ import annotations

import struct
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .wav import EXTENSIBLE, FLOAT, PCM, SUFFIXES

CHUNK_FRAMES = 1 << 16
#: Bytes of files to a reading task.
SPLIT_BYTES = 64 << 20
CHUNKS = "track_id string, chunk long, start long, n_frames long, sample_rate int, sample_bytes int, channels array<array<double>>, error string"
_CHUNKS = pa.schema([("track_id", pa.string()), ("chunk", pa.int64()), ("start", pa.int64()), ("n_frames", pa.int64()), ("sample_rate", pa.int32()), ("sample_bytes", pa.int32()), ("channels", pa.list_(pa.list_(pa.float64()))), ("error", pa.string())])


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Header(NamedTuple):
    tag: int
    channels: int
    rate: int
    width: int
    first: int
    n_frames: int


def read_header(f, size: int) -> Header:
    """Where the samples of an open WAV file lie; RIFF and RF64, chunks in any order, sizes that were never filled in."""
    head = f.read_at(12, 0)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, long_size = 12, None, None
    while at + 8 <= size:
        name, n = struct.unpack("<4sI", f.read_at(8, at))
        if name == b"ds64":
            long_size = struct.unpack_from("<Q", f.read_at(24, at + 8), 8)[0]
        elif name == b"fmt ":
            form = f.read_at(min(n, 40), at + 8)
        elif name == b"data":
            if form is None or len(form) < 16:
                raise ValueError("no format or no samples")
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", form)
            if tag == EXTENSIBLE and len(form) >= 26:
                tag = struct.unpack_from("<H", form, 24)[0]
            width = bits // 8
            if not channels or not rate or bits % 8 or (tag, width) not in {*((PCM, w) for w in (1, 2, 3, 4)), (FLOAT, 4), (FLOAT, 8)}:
                raise ValueError(f"format {tag} with {bits} bits is not read")
            there = size - at - 8
            n = min(there, long_size if n == 0xFFFFFFFF and long_size is not None else n)
            return Header(tag, channels, rate, width, at + 8, n // (width * channels))
        at += 8 + n + n % 2
    raise ValueError("no format or no samples")


def samples(raw: bytes, tag: int, width: int, channels: int) -> np.ndarray:
    """Channels x frames of raw samples: whole numbers in -1..1, floats as they are."""
    b = np.frombuffer(raw, np.uint8).reshape(-1, width)
    if tag == FLOAT:
        x = np.ascontiguousarray(b).view(f"<f{width}")[:, 0].astype(np.float64)
    elif width == 1:
        x = (b[:, 0].astype(np.float64) - 128) / 128
    else:
        wide = np.zeros((len(b), 4), np.uint8)
        wide[:, 4 - width :] = b
        x = wide.view("<i4")[:, 0] / 2.0**31
    return x.reshape(-1, channels).T


def nested(x: np.ndarray) -> pa.Array:
    """One row of array<array<double>>."""
    inner = pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(np.ascontiguousarray(x).ravel()))
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), inner)


class Range(InputPartition):
    """Pieces (uri, size, from byte, to byte) for one task."""

    def __init__(self, pieces: list[tuple[str, int, int, int]]):
        self.pieces = pieces


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.frames = int(options.get("chunk_frames", CHUNK_FRAMES))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.suffixes = tuple(f".{s}" for s in options.get("suffixes", "wav,wave").lower().split(","))

    def partitions(self):
        from pyarrow import fs

        system, root = _opened(self.folder)
        prefix = self.folder.removesuffix("/").removesuffix(root.removesuffix("/"))
        found = sorted((i for i in system.get_file_info(fs.FileSelector(root)) if i.is_file and i.base_name.lower().endswith(self.suffixes) and i.base_name[0] not in "._"), key=lambda i: i.path)
        out, now, room = [], [], self.split
        for i in found:
            for low in range(0, max(i.size, 1), self.split):
                piece = (prefix + i.path, i.size, low, min(low + self.split, max(i.size, 1)))
                if piece[3] - low > room and now:
                    out.append(Range(now))
                    now, room = [], self.split
                now.append(piece)
                room -= piece[3] - low
        return [*out, Range(now)] if now else out or [Range([])]

    def read(self, partition):
        for uri, size, low, high in partition.pieces:
            system, path = _opened(uri)
            with system.open_input_file(path) as f:
                try:
                    h = read_header(f, size)
                except ValueError as e:
                    if low == 0:
                        yield self._row(uri, None, None, None, None, None, pa.nulls(1, _CHUNKS.field("channels").type), str(e))
                    continue
                step = h.width * h.channels * self.frames
                # Chunks whose first byte lies in the range; the first range of a file also has an empty file's only chunk.
                n_chunks = -(-h.n_frames // self.frames)
                first = max(0, -(-(low - h.first) // step))
                last = min(n_chunks, max(0, -(-(high - h.first) // step)))
                if low == 0 and not h.n_frames:
                    yield self._row(uri, 0, 0, 0, h.rate, h.width, nested(np.zeros((h.channels, 0))), None)
                for k in range(first, last):
                    n = min(self.frames, h.n_frames - k * self.frames)
                    x = samples(f.read_at(n * h.width * h.channels, h.first + k * step), h.tag, h.width, h.channels)
                    yield self._row(uri, k, k * self.frames, h.n_frames, h.rate, h.width, nested(x), None)

    @staticmethod
    def _row(*values):
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array([v], f.type) for v, f in zip(values, _CHUNKS, strict=True)], schema=_CHUNKS)


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


def header(n_frames: int, channels: int, rate: int, width: int) -> bytes:
    """A PCM header; RF64 where 32 bits can't hold the size."""
    n = n_frames * channels * width
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, PCM, channels, rate, rate * channels * width, channels * width, 8 * width)
    if n + 100 < 1 << 32:
        return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + n + n % 2, b"WAVE") + form + struct.pack("<4sI", b"data", n)
    sizes = struct.pack("<4sIQQQI", b"ds64", 28, 4 + 36 + len(form) + 8 + n + n % 2, n, n_frames, 0)
    return struct.pack("<4sI4s", b"RF64", 0xFFFFFFFF, b"WAVE") + sizes + form + struct.pack("<4sI", b"data", 0xFFFFFFFF)


def pcm(x: np.ndarray, width: int) -> bytes:
    top = 2 ** (8 * width - 1)
    raw = np.clip(np.round(x.T * top), -top, top - 1).astype("<i4")
    raw = np.ascontiguousarray(raw).view(np.uint8).reshape(-1, 4)[:, :width]
    return (raw ^ (0x80 if width == 1 else 0)).astype(np.uint8).tobytes()


def file_name(track: str) -> str:
    return f"{track.rpartition('/')[2].removesuffix('.wav')}.wav"


class WavWriter(DataSourceWriter):
    """Rows (track_id, start, n_frames, sample_rate, channels), each track's together and in order."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder = options["path"].rstrip("/")
        self.width, self.overwrite = int(options.get("sample_bytes", 3)), overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator):
        system, root = _opened(self.folder)
        system.create_dir(f"{root}/{self.job}", recursive=True)
        files, track, out, at, total = [], None, None, 0, 0

        def close():
            if out is not None:
                if at != total:
                    raise ValueError(f"{track}: {at} frames came, {total} were announced")
                if total * self.width * n_channels % 2:
                    out.write(b"\0")
                out.close()

        try:
            for r in iterator:
                if out is None or r["track_id"] != track:
                    close()
                    out, track, at, total, n_channels = None, r["track_id"], 0, int(r["n_frames"]), len(r["channels"])
                    temporary = f"{root}/{self.job}/{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary)
                    files.append((temporary, f"{root}/{file_name(str(track))}"))
                    out.write(header(total, n_channels, int(r["sample_rate"]), self.width))
                x = np.array([np.asarray(c, float) for c in r["channels"]]).reshape(len(r["channels"]), -1)
                if int(r["start"]) != at or len(x) != n_channels or not np.isfinite(x).all():
                    raise ValueError(f"{track}: a chunk at {at} was due, or its channels or samples are not in order")
                out.write(pcm(x, self.width))
                at += x.shape[1]
            close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            raise
        return Written(files)

    def commit(self, messages):
        from pyarrow import fs

        system, root = _opened(self.folder)
        system.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        names = [to for _, to in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tracks would have one file name")
        there = {i.path: i for i in system.get_file_info(fs.FileSelector(root)) if i.is_file}
        if not self.overwrite and (taken := [n for n in names if n in there]):
            self.abort(messages)
            raise ValueError(f"{taken[0]} is there already")
        for temporary, to in files:
            system.move(temporary, to)
        if self.overwrite:
            for path in there.keys() - set(names):
                if path.lower().endswith(".wav"):
                    system.delete_file(path)
        self._clear(system, root)

    def abort(self, messages):
        self._clear(*_opened(self.folder))

    def _clear(self, system, root):
        from pyarrow import fs

        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class WavFiles(DataSource):
    """Options: path; chunk_frames, split_bytes, suffixes (reading); sample_bytes (writing, 1 to 4)."""

    @classmethod
    def name(cls) -> str:
        return "wavfiles"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(self.options, overwrite)


def read_chunks(spark: SparkSession, folder: str, chunk_frames: int = CHUNK_FRAMES, split_bytes: int = SPLIT_BYTES, suffixes: str = "wav,wave") -> DataFrame:
    """The columns of ``CHUNKS`` for every chunk of every WAV file of ``folder``; a file that can't be read is one row with its reason in error."""
    spark.dataSource.register(WavFiles)
    return spark.read.format("wavfiles").option("chunk_frames", chunk_frames).option("split_bytes", split_bytes).option("suffixes", suffixes).load(folder)


def write_chunks(chunks: DataFrame, folder: str, sample_bytes: int = 3, mode: str = "append") -> None:
    """Write (track_id, start, n_frames, sample_rate, channels) as a WAV file a track, named after it, all of them or none.

    ``append``: a name that is taken fails the job. ``overwrite``: the files of
    the folder are these afterwards. A track whose chunks do not cover
    ``n_frames`` without gap or overlap fails the job.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError("mode is append or overwrite")
    chunks.sparkSession.dataSource.register(WavFiles)
    rows = chunks.select(F.col("track_id").cast("string").alias("track_id"), F.col("start").cast("long").alias("start"), F.col("n_frames").cast("long").alias("n_frames"), F.col("sample_rate").cast("int").alias("sample_rate"), F.col("channels").cast("array<array<double>>").alias("channels"))
    rows.repartition("track_id").sortWithinPartitions("track_id", "start").write.format("wavfiles").option("sample_bytes", sample_bytes).mode(mode).save(folder)


def whole(tracks: DataFrame) -> DataFrame:
    """Tracks (track_id, sample_rate, channels) as one chunk each, for ``write_chunks``."""
    n = F.size(F.get("channels", F.lit(0)))
    return tracks.select("track_id", F.lit(0).cast("long").alias("start"), n.cast("long").alias("n_frames"), "sample_rate", "channels")


__all__ = ["CHUNKS", "SUFFIXES", "WavFiles", "read_chunks", "whole", "write_chunks"]
