"""The job queue as state on the stream: a state a job with timers, admission of new jobs, and polls as a join of streams.

The state store is RocksDB, so states live on disk beside the executors and in
the checkpoint. What is late by more than the watermark is dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .queue import _KINDS, _MAPS, STATES

#: Fixed: milliseconds that a terminated worker has before it is killed, and then before it is given up.
GRACE_MS = 5000
_EXITS = [_KINDS.index(k) for k in ("finish", "review", "fail")]
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store; set before a stream starts."""
    spark.conf.set(STORE, ROCKS)


class JobStates(StatefulProcessor):
    """Folds a job's events (at, seq, kind) onto its state; a running job that is cancelled is terminated, killed after five seconds, given up after ten.

    Events of a micro-batch are taken in order of (at, seq); across micro-batches
    as they come. Final states take no more events, so a batch of any size is
    three searches for the next event that changes the state.
    """

    def __init__(self, key: str):
        self.key = key

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status int, n long, phase int, due long")

    def _row(self, key, n: int, status: int, action: str | None) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "n": [n], "status": [STATES[status]], "action": [action]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k: i for i, k in enumerate(_KINDS)}
        parts = [(f["at"].to_numpy("datetime64[us]").astype(np.int64), f["seq"].to_numpy(np.int64), f["kind"].map(known).fillna(len(_KINDS)).to_numpy(np.int8)) for f in rows]
        at, seq, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((seq, at))
        at, kind = at[order], kind[order]
        status, n, phase, due = self.state.get() if self.state.exists() else (STATES.index("WAITING"), 0, 0, 0)
        n += len(kind)
        first = 0
        while len(moves := np.flatnonzero(_MAPS[kind[first:], status] != status)):
            first += int(moves[0])
            before, status = status, int(_MAPS[kind[first], status])
            if STATES[before] == "RUNNING" and STATES[status] == "CANCELLED":
                phase, due = 1, int(at[first]) // 1000 + GRACE_MS
                self.handle.registerTimer(due)
                yield self._row(key, n, status, "terminate")
            first += 1
        if phase and np.isin(kind[first:], _EXITS).any():
            self.handle.deleteTimer(due)
            phase = 0
        self.state.update((status, n, phase, due))
        yield self._row(key, n, status, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, n, phase, due = self.state.get()
        if not phase:
            return
        if phase == 1:
            self.handle.registerTimer(due + GRACE_MS)
            self.state.update((status, n, 2, due + GRACE_MS))
        else:
            self.state.update((status, n, 0, due))
        yield self._row(key, n, status, "kill" if phase == 1 else "give up")

    def close(self) -> None:
        pass


def job_states(events: DataFrame, key: str = "job_id", late: str = "10 seconds") -> DataFrame:
    """A stream of (key, n, status, action): after each micro-batch the state of every job that had events (action null), and what is to be done to its worker.

    ``events``: a stream of (key, at timestamp, seq, kind). The last state of a
    job is that with the largest n.
    """
    use_rocksdb(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "at", F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("")).alias("kind")).withWatermark("at", late)
    return rows.groupBy(key).transformWithStateInPandas(JobStates(key), f"`{key}` {kind}, n long, status string, action string", "Append", "EventTime")


def new_jobs(asked: DataFrame, jobs: DataFrame, late: str = "1 hour", expected: int = 15) -> DataFrame:
    """A stream of (folder, at, total_tracks, status, warning): the folders asked for on the stream (folder, n_files, at) that have no waiting or running job in ``jobs``, each once.

    ``jobs`` is a table (folder, status), read anew for each micro-batch where
    its source allows. A folder that is asked for again within ``late`` is the
    same request.
    """
    open_ = jobs.where(F.col("status").isin("WAITING", "RUNNING")).select(F.col("folder").alias("open")).distinct()
    one = asked.select("folder", "n_files", "at").withWatermark("at", late).dropDuplicatesWithinWatermark(["folder"])
    fresh = one.join(open_, F.col("folder") == F.col("open"), "left_anti")
    warning = F.when(F.col("n_files") != expected, F.format_string(f"expected {expected} WAV files, found %d", "n_files"))
    return fresh.select("folder", "at", F.col("n_files").alias("total_tracks"), F.lit("WAITING").alias("status"), warning.alias("warning"))


def polls(progress: DataFrame, results: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream of (job_id, status, current_track, total_tracks, error, at): what each look at a running job shows.

    ``progress``: a stream of looks (job_id, at, current_track, total_tracks),
    ``results``: a stream of ends (job_id, ended, code, status, error). A look
    whose job has ended by then (or up to ``within`` before) shows the end by the
    rules of ``queue.poll``; others show the job running, once the watermark
    says that no end can come any more.
    """
    p = progress.select("job_id", "at", "current_track", "total_tracks").withWatermark("at", late)
    r = results.select(F.col("job_id").alias("r_id"), "ended", "code", F.col("status").alias("r_status"), F.col("error").alias("r_error")).withWatermark("ended", late)
    ends = (F.col("job_id") == F.col("r_id")) & (F.col("ended") <= F.col("at")) & (F.col("ended") >= F.col("at") - F.expr(f"INTERVAL {within}"))
    both = p.join(r, ends, "left_outer")
    ended = F.col("r_id").isNotNull()
    good = F.coalesce((F.col("code") == 0) & F.col("r_status").isin("COMPLETED", "COMPLETED_WITH_REVIEW"), F.lit(False))
    status = F.when(~ended, "RUNNING").when(good, F.col("r_status")).otherwise("FAILED")
    error = F.when(ended & ~good, F.coalesce("r_error", F.format_string("worker exited with code %d", "code")))
    return both.select("job_id", status.alias("status"), F.when(ended & good, F.col("total_tracks")).otherwise(F.col("current_track")).alias("current_track"), "total_tracks", error.alias("error"), "at")


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What ``stream`` gives until its sources are read up, written to a file sink in ``folder`` and read back."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
