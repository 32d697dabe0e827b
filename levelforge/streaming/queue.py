"""A job queue: states, recovery, admission; replayed in batch or kept up by a stream.

Waiting jobs start, running ones finish, fail or are cancelled; anything else
leaves the state as it is.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed transitions: (state, event) to state.
TRANSITIONS = {("WAITING", "start"): "RUNNING", ("RUNNING", "finish"): "COMPLETED", ("RUNNING", "review"): "COMPLETED_WITH_REVIEW", ("RUNNING", "fail"): "FAILED", ("WAITING", "cancel"): "CANCELLED", ("RUNNING", "cancel"): "CANCELLED"}


def step(state: Column, kind: Column) -> Column:
    out = None
    for (before, event), after in TRANSITIONS.items():
        c = (state == before) & (kind == event)
        out = F.when(c, after) if out is None else out.when(c, after)
    return out.otherwise(state)


def recover(jobs: DataFrame) -> DataFrame:
    """After a restart, running jobs wait again from the start."""
    lost = F.col("status") == "RUNNING"
    return jobs.withColumns({"status": F.when(lost, "WAITING").otherwise(F.col("status")), "recovered": lost})


def slots(asked: Column) -> Column:
    """Jobs that may run at once: two if two are asked for, else one."""
    return F.when(asked == 2, 2).otherwise(1)


def launch(jobs: DataFrame, queues: DataFrame) -> DataFrame:
    """(queue, job_id) of the waiting jobs to start: the first by seq, as many as slots are free.

    ``jobs`` has queue, job_id, seq and status, ``queues`` has queue, asked,
    paused and stop_after_current. A queue that is paused, or stops after its
    current jobs, starts none; null flags are no. A row a job of one queue meets
    in a window, after jobs that neither wait nor run are gone.
    """
    running = jobs.where("status = 'RUNNING'").groupBy("queue").agg(F.count("*").alias("running"))
    on = queues.where(~(F.coalesce("paused", F.lit(False)) | F.coalesce("stop_after_current", F.lit(False))))
    free = on.join(running, "queue", "left").select("queue", F.greatest(F.lit(0), slots(F.col("asked")) - F.coalesce("running", F.lit(0))).alias("free")).where("free > 0")
    w = Window.partitionBy("queue").orderBy("seq", "job_id")
    waiting = jobs.where("status = 'WAITING'").withColumn("place", F.row_number().over(w)).where("place <= 2")
    return waiting.join(free, "queue").where("place <= free").select("queue", "job_id")


def act(jobs: DataFrame, actions: DataFrame) -> DataFrame:
    """``jobs`` after ``actions`` (job_id, action): remove takes a job that isn't running, cancel ends one that waits or runs; others stay.

    Several actions on one job are taken together, remove first.
    """
    asked = actions.groupBy("job_id").agg(F.max(F.col("action") == "remove").alias("remove"), F.max(F.col("action") == "cancel").alias("cancel"))
    both = jobs.join(asked, "job_id", "left")
    kept = both.where(~(F.coalesce("remove", F.lit(False)) & (F.col("status") != "RUNNING")))
    ended = F.coalesce("cancel", F.lit(False)) & F.col("status").isin("WAITING", "RUNNING")
    return kept.withColumn("status", F.when(ended, "CANCELLED").otherwise(F.col("status"))).select(jobs.columns)


def without_waiting(jobs: DataFrame) -> DataFrame:
    return jobs.where("status IS NULL OR status <> 'WAITING'")


def stale(shown: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """Ids that are shown but are no jobs any more."""
    return shown.select(key).join(jobs.select(key), key, "left_anti")


def poll(jobs: DataFrame, progress: DataFrame, results: DataFrame) -> DataFrame:
    """``jobs`` (job_id, status, current_track, total_tracks, error) after a look at the running ones.

    ``results`` (job_id, code, status, error) has those that ended: code 0 with a
    completed status completes, anything else fails. ``progress`` (job_id,
    current_track, total_tracks) moves the others on. Jobs that don't run stay.
    """
    p = progress.select(F.col("job_id").alias("p_id"), F.col("current_track").alias("p_current"), F.col("total_tracks").alias("p_total"))
    r = results.select(F.col("job_id").alias("r_id"), "code", F.col("status").alias("r_status"), F.col("error").alias("r_error"))
    both = jobs.join(p, F.col("job_id") == F.col("p_id"), "left").join(r, F.col("job_id") == F.col("r_id"), "left")
    runs, ended = F.col("status") == "RUNNING", F.col("r_id").isNotNull()
    good = (F.col("code") == 0) & F.col("r_status").isin("COMPLETED", "COMPLETED_WITH_REVIEW")
    good = F.coalesce(good, F.lit(False))
    status = F.when(runs & ended, F.when(good, F.col("r_status")).otherwise("FAILED")).otherwise(F.col("status"))
    error = F.when(runs & ended & ~good, F.coalesce("r_error", F.format_string("worker exited with code %d", "code"))).otherwise(F.col("error"))
    current = F.when(runs & ended & good, F.col("total_tracks")).when(runs & ~ended, F.coalesce("p_current", "current_track")).otherwise(F.col("current_track"))
    total = F.when(runs & ~ended, F.coalesce("p_total", "total_tracks")).otherwise(F.col("total_tracks"))
    return both.select("job_id", status.alias("status"), current.alias("current_track"), total.alias("total_tracks"), error.alias("error"))


def add_jobs(jobs: DataFrame, new: DataFrame, now: Column, expected: int = 15) -> tuple[DataFrame, DataFrame]:
    """(jobs to add, refused folders) of ``new`` (folder, n_files): a folder with a waiting or running job is refused.

    A job's id is its time and a random part; a folder without the expected
    number of files carries a warning. Of repeated new folders one is added.
    """
    open_ = jobs.where(F.col("status").isin("WAITING", "RUNNING")).select("folder")
    one = new.groupBy("folder").agg(F.min("n_files").alias("n_files"))
    fresh = one.join(open_, "folder", "left_anti")
    name = F.concat_ws("_", F.date_format(now, "yyyyMMdd_HHmmss_SSSSSS"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 6))
    warning = F.when(F.col("n_files") != expected, F.format_string(f"expected {expected} WAV files, found %d", "n_files"))
    return fresh.select(name.alias("job_id"), "folder", F.lit("WAITING").alias("status"), F.lit(0).alias("current_track"), F.col("n_files").alias("total_tracks"), warning.alias("warning")), one.join(open_, "folder", "left_semi").select("folder")


def queue_row(jobs: DataFrame) -> DataFrame:
    """What a list of jobs shows: (job_id, status, folder, progress, result); the result is its end, else its warning, else the start of its error."""
    c = F.col
    result = F.coalesce(F.when(c("status") == "COMPLETED", "done").when(c("status") == "COMPLETED_WITH_REVIEW", "to review"), F.nullif("warning", F.lit("")), F.left("error", F.lit(32)), F.lit(""))
    return jobs.select("job_id", "status", F.element_at(F.split("folder", "/"), -1).alias("folder"), F.format_string("%d/%d", "current_track", "total_tracks").alias("progress"), result.alias("result"))


STATES = sorted({x for (before, _), after in TRANSITIONS.items() for x in (before, after)})
#: What each event makes of each state, by number; the last row is any other event.
_KINDS = sorted({event for _, event in TRANSITIONS})
_MAPS = np.array([[STATES.index(TRANSITIONS.get((s, e), s)) for s in STATES] for e in [*_KINDS, None]], np.int8)


def folded(events: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, n, maps): the number of each job's events (kind), and what they make of each state, as a few maps in order.

    Events are cut by range of (key, order), and each batch of a job's events is
    folded to one map of the six states, so a job with very many events is spread
    over tasks and only its maps meet.
    """

    def fold(batches):
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            kinds = batch.column(1).cast(pa.string()).to_pylist()
            maps = _MAPS[[_KINDS.index(k) if k in _KINDS else len(_KINDS) for k in kinds]]
            ids = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            n = np.diff(np.append(first, len(ids)))
            run = np.repeat(np.arange(len(first)), n)
            while len(run) > len(first):
                # Every second map of a job is taken after the one before it.
                place = np.arange(len(run)) - np.searchsorted(run, run)
                later = np.flatnonzero(place % 2 == 1)
                maps[later - 1] = np.take_along_axis(maps[later], maps[later - 1].astype(np.intp), axis=1)
                keep = place % 2 == 0
                run, maps = run[keep], maps[keep]
            at = pa.array(np.arange(len(first) + 1, dtype=np.int32) * len(STATES))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), pa.array(np.full(len(first), part, np.int32)), pa.array(np.full(len(first), number, np.int32)), pa.array(n), pa.ListArray.from_arrays(at, pa.array(maps.astype(np.int32).ravel()))], names=[key, "part", "number", "n", "map"])

    kind = events.schema[key].dataType.simpleString()
    cut = events.select(key, "kind", *order).repartitionByRange(key, *order).sortWithinPartitions(key, *order, "kind")
    each = cut.mapInArrow(fold, f"`{key}` {kind}, part int, number int, n long, map array<int>")
    return each.groupBy(key).agg(F.sum("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("part", "number", "map"))), lambda x: x["map"]).alias("maps"))


def state_after(state: Column, maps: Column) -> Column:
    """``state`` after all ``maps``, in order; null maps leave it."""
    names = F.array(*map(F.lit, STATES))
    number = F.aggregate(F.coalesce(maps, F.array().cast("array<array<int>>")), F.array_position(names, state).cast("int") - 1, lambda s, m: F.get(m, s))
    return F.get(names, number)


def replay(events: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, n, status): each job's state after its events (kind) in order."""
    return folded(events, key, *order).select(key, F.col("n").cast("int").alias("n"), state_after(F.lit("WAITING"), F.col("maps")).alias("status"))


def follow(events: DataFrame, jobs_path: str, checkpoint: str, slots: int = 1, keep: int = 3):
    """Keep the table of jobs at ``jobs_path`` up to date from a stream of events (job_id, seq, kind); returns the query's writer.

    Kinds are submit, start, finish, review, fail and cancel. Each micro-batch
    folds its events onto the jobs' states, then admits the waiting jobs with
    the smallest seq into the free slots: admission looks across jobs, so it is
    a batch operation and not a per-key state. A micro-batch writes the table of
    its own number and nothing else, so one that is repeated gives the same; of
    the tables before it the last ``keep`` stay (one at least, which it reads).
    """
    schema = "job_id long, seq long, status string"

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(schema).parquet(f"{jobs_path}/{number - 1}") if number else spark.createDataFrame([], schema)
        told = folded(batch, "job_id", "seq").join(batch.groupBy("job_id").agg(F.min("seq").alias("new_seq")), "job_id")
        both = before.join(told, "job_id", "full")
        start = F.coalesce("status", F.lit("WAITING"))
        now = state_after(start, F.col("maps"))
        jobs = both.select("job_id", F.coalesce("seq", "new_seq").alias("seq"), now.alias("status"))
        running = jobs.where("status = 'RUNNING'").count()
        chosen = jobs.where("status = 'WAITING'").orderBy("seq", "job_id").limit(max(0, slots - running)).select("job_id", F.lit(True).alias("go"))
        after = jobs.join(chosen, "job_id", "left").select("job_id", "seq", F.when(F.col("go"), "RUNNING").otherwise(F.col("status")).alias("status"))
        after.write.mode("overwrite").parquet(f"{jobs_path}/{number}")
        old = number - max(1, keep) - 1
        if old >= 0:
            system, path = fs.FileSystem.from_uri(f"{jobs_path}/{old}")
            with contextlib.suppress(FileNotFoundError):
                system.delete_dir(path)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)


RECORD = "job_id long, seq long, status string, batch long"


def recorded(spark: SparkSession, path: str, number: int, every: int) -> DataFrame:
    """(job_id, seq, status, batch) of all jobs after micro-batch ``number``: the last compacted table, and the changes since."""
    last = (number + 1) // every * every - 1
    paths = [f"{path}/jobs/{last}"] * (last >= 0) + [f"{path}/changes/{k}" for k in range(last + 1, number + 1)]
    if not paths:
        return spark.createDataFrame([], RECORD)
    rows = spark.read.schema(RECORD).parquet(*paths)
    return rows.groupBy("job_id").agg(F.max_by(F.struct("seq", "status", "batch"), "batch").alias("r")).select("job_id", "r.*")


def record(events: DataFrame, path: str, checkpoint: str, slots: int = 1, every: int = 20):
    """As ``follow``, but what a micro-batch writes is a record for each job that changed; returns the query's writer.

    ``path``/changes/<number> has those records (job_id, seq, status, batch).
    Each ``every`` micro-batches all jobs are written to ``path``/jobs/<number>,
    and the changes before that table's predecessor go, so a look (``recorded``)
    reads one table and fewer than ``every`` small ones. Names depend on the
    micro-batch alone: one that is repeated, or a restart, writes the same.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = recorded(spark, path, number - 1, every)
        told = folded(batch, "job_id", "seq").join(batch.groupBy("job_id").agg(F.min("seq").alias("new_seq")), "job_id")
        both = before.join(told, "job_id", "full")
        jobs = both.select("job_id", F.col("status").alias("was"), F.coalesce("seq", "new_seq").alias("seq"), state_after(F.coalesce("status", F.lit("WAITING")), F.col("maps")).alias("status"))
        running = jobs.where("status = 'RUNNING'").count()
        chosen = jobs.where("status = 'WAITING'").orderBy("seq", "job_id").limit(max(0, slots - running)).select("job_id", F.lit(True).alias("go"))
        after = jobs.join(chosen, "job_id", "left").withColumn("status", F.when(F.col("go"), "RUNNING").otherwise(F.col("status")))
        changed = after.where(~F.col("status").eqNullSafe(F.col("was"))).select("job_id", "seq", "status", F.lit(number).cast("long").alias("batch"))
        changed.write.mode("overwrite").parquet(f"{path}/changes/{number}")
        if (number + 1) % every:
            return
        all_ = recorded(spark, path, number - 1, every).unionByName(spark.read.schema(RECORD).parquet(f"{path}/changes/{number}"))
        all_.groupBy("job_id").agg(F.max_by(F.struct("seq", "status", "batch"), "batch").alias("r")).select("job_id", "r.*").write.mode("overwrite").parquet(f"{path}/jobs/{number}")
        system, root = fs.FileSystem.from_uri(path)
        old = [f"{root}/changes/{k}" for k in range(number - 2 * every + 1, number - every + 1) if k >= 0] + [f"{root}/jobs/{number - 2 * every}"] * (number >= 2 * every)
        for folder in old:
            with contextlib.suppress(FileNotFoundError):
                system.delete_dir(folder)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
