"""Shared folder, materialised tables and the small array helpers of the subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Document ids that are null take this place in orders: after every other id.
NULL_ID = np.iinfo(np.int64).max


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under the session's ``spark.checkpoint.dir``.

    Where that is not set, a session that runs in one process gets a temporary
    folder; on a cluster each executor would write to its own disk, so it is an
    error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext._jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-levelforge-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, never the work before it.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one step, deleted together when what was made of them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def write(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        self.folders.append(path := shared_dir(self.spark))
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str, compression: str = "zstd") -> DataFrame:
        """``df`` written in buckets of ``key``, as many as the session has shuffle partitions: joins on ``key`` move only their other side."""
        self.folders.append(path := shared_dir(self.spark))
        name = f"levelforge_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("compression", compression).option("path", path).bucketBy(n, key).saveAsTable(name)
        out = self.spark.table(name)
        out.schema  # resolved: from here on the files are what counts
        self.spark.sql(f"DROP TABLE {name}")
        return out

    def drop(self) -> None:
        jvm = self.spark._jvm
        for folder in self.folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.folders = []


def if_small(df: DataFrame, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """``df`` (written before) to be broadcast if its rows, ``row_bytes`` each, take at most ``most`` bytes; else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() * row_bytes <= most else df


def fresh(name: str) -> str:
    """A column name that no table of the user has."""
    return f"{name}_{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and the n + 1 offsets. Null: empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(offsets: np.ndarray, most_bytes: int):
    """Row ranges (first, last) of at most ``most_bytes`` bytes each, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hash values: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed))


#: What a worker keeps between the tasks of one stage: tokenizers and what they have learned.
CACHES: dict[str, object] = {}


def task(run, keep_caches: bool = False):
    """``run`` (batches to batches) for an Arrow map: workers live on, so memory goes back when a task ends, caches when another kind begins."""

    def wrapped(batches):
        if not keep_caches:
            CACHES.clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def file_system(uri: str):
    """The file system and path behind a folder that ``shared_dir`` gave; opened inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, data: bytes) -> None:
    """Write one file under its own name. Names are never reused, so a repeated task leaves an orphan, no clash."""
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as f:
        f.write(data)


def read_file(folder: str, name: str) -> bytes:
    system, path = file_system(folder)
    with system.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def id_values(column: pa.Array) -> np.ndarray:
    """Ids as int64; null takes ``NULL_ID``."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def id_array(values: np.ndarray) -> pa.Array:
    """The inverse of ``id_values``."""
    return pa.array(values, pa.int64(), mask=values == NULL_ID)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b), both long: the smallest node reachable.

    Alternates two steps, each one grouping and one join: every node hands its
    smallest known neighbour to its larger neighbours, then to its smaller ones.
    Edges become stars around the smallest node in a logarithmic number of
    rounds; the written edges are the only state, so lost executors cost a
    reread. Minima are combined before the shuffle, and the join on a hub is
    one the adaptive planner can split.
    """
    from pyspark.sql import functions as F

    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    nodes = e.select("a").union(e.select("b")).distinct()
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        big = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = big.where("a <> b").distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = e.join(low, F.col("a") == F.col("n"))
        e = materialise(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    low = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return nodes.withColumnRenamed("a", "node").join(low, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
