"""State on the stream: timers of cancelled jobs, restarts, late and repeated requests, looks and ends."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from levelforge.streaming import jobs, queue

START = datetime(2024, 5, 1, 12, 0, 0)


def at(seconds):
    return START + timedelta(seconds=seconds)


def batches(spark, folder, rows, schema):
    """A stream that takes each list of ``rows`` as one micro-batch."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        for f in folder.glob("part-*"):
            f.rename(folder / f"{i:03d}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"file://{folder}")


EVENTS = "job_id long, at timestamp, seq long, kind string"


def test_cancelled_jobs_are_terminated_then_killed(spark, tmp_path):
    rows = [
        [(1, at(0), 1, "start"), (2, at(0), 2, "start"), (3, at(0), 3, "cancel"), (4, at(0), 4, "start"), (5, at(1), 6, "cancel"), (5, at(1), 5, "start")],
        [(1, at(10), 7, "cancel"), (2, at(10), 8, "cancel"), (4, at(10), 9, "finish"), (None, at(10), 10, None)],
        [(2, at(12), 11, "finish"), (9, at(13), 12, "start")],
        [(9, at(17), 13, "start")],
        [(9, at(40), 14, "start")],
        [(9, at(60), 15, "start")],
    ]
    stream = jobs.job_states(batches(spark, tmp_path / "in", rows, EVENTS), late="0 seconds")
    out = jobs.drained(stream, f"file://{tmp_path}/out").collect()
    did = {}
    for r in out:
        if r.action:
            did.setdefault(r.job_id, []).append(r.action)
    assert {k: sorted(v) for k, v in did.items()} == {1: ["give up", "kill", "terminate"], 2: ["terminate"], 5: ["give up", "kill", "terminate"]}
    last = {}
    for r in sorted(out, key=lambda r: r.n):
        last[r.job_id] = (r.n, r.status)
    assert last == {1: (2, "CANCELLED"), 2: (3, "CANCELLED"), 3: (1, "CANCELLED"), 4: (2, "COMPLETED"), 5: (2, "CANCELLED"), 9: (4, "RUNNING"), None: (1, "WAITING")}


def test_stream_replays_like_the_batch_and_goes_on_after_a_restart(spark, tmp_path):
    kinds = ["start", "finish", "cancel", "fail", "review", "odd"]
    events = [(k % 7, at(k), k, kinds[(k * k + k // 5) % 6]) for k in range(200)]
    expected = {r.job_id: (r.n, r.status) for r in queue.replay(spark.createDataFrame(events, EVENTS), "job_id", "at", "seq").collect()}
    folder = tmp_path / "in"
    last = {}
    for stop in (80, 200):
        rows = [events[k : k + 40] for k in range(0 if stop == 80 else 80, stop, 40)]
        for i, part in enumerate(rows):
            spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
        for r in sorted(jobs.drained(jobs.job_states(stream, late="1 day"), f"file://{tmp_path}/out").where("action IS NULL").collect(), key=lambda r: r.n):
            last[r.job_id] = (r.n, r.status)
    assert last == expected


def test_new_jobs_once_and_not_where_one_is_open(spark, tmp_path):
    open_ = spark.createDataFrame([("a", "RUNNING"), ("a", "FAILED"), ("b", "COMPLETED"), (None, "WAITING")], "folder string, status string")
    asked = [[("a", 15, at(0)), ("b", 15, at(1)), ("c", 3, at(2))], [("c", 3, at(5)), ("b", 15, at(7200)), ("d", 15, at(7300))], [("e", 15, at(7301))], [("late", 15, at(10)), ("e", 15, at(7302))]]
    stream = jobs.new_jobs(batches(spark, tmp_path / "in", asked, "folder string, n_files int, at timestamp"), open_, late="10 minutes")
    got = sorted((r.folder, r.at, r.warning) for r in jobs.drained(stream, f"file://{tmp_path}/out").collect())
    warned = "expected 15 WAV files, found 3"
    assert [g for g in got if g[0] != "b"] == [("c", at(2), warned), ("d", at(7300), None), ("e", at(7301), None)]
    assert ("b", at(1), None) in got and "late" not in {g[0] for g in got}


def test_looks_meet_ends(spark, tmp_path):
    looks = [[(1, at(0), 2, 15), (2, at(0), 3, 15), (3, at(1), 4, 15)], [(1, at(60), 5, 15), (2, at(61), 6, 15), (3, at(62), 7, 15)], [(-1, at(99_999), 0, 0)]]
    ends = [[(1, at(30), 0, "COMPLETED", None), (2, at(40), 1, None, None)], [(3, at(50), 0, "BROKEN", "no disk")], [(-1, at(99_999), 0, None, None)]]
    p = batches(spark, tmp_path / "p", looks, "job_id long, at timestamp, current_track int, total_tracks int")
    r = batches(spark, tmp_path / "r", ends, "job_id long, ended timestamp, code int, status string, error string")
    out = jobs.drained(jobs.polls(p, r), f"file://{tmp_path}/out").where("job_id > 0").orderBy("at", "job_id").collect()
    assert [(x.job_id, x.status, x.current_track, x.error) for x in out] == [(1, "RUNNING", 2, None), (2, "RUNNING", 3, None), (3, "RUNNING", 4, None), (1, "COMPLETED", 15, None), (2, "FAILED", 6, "worker exited with code 1"), (3, "FAILED", 7, "no disk")]


def test_records_follow_the_changes(spark, tmp_path):
    """What is written is what changed, tables are compacted and old ones go, and a restart goes on from the records."""
    schema = "job_id long, seq long, kind string"
    parts = [[(k, k, "submit") for k in range(1, 6)], [(1, 10, "finish")], [(9, 11, "submit")], [(2, 12, "fail")], [(3, 13, "cancel"), (4, 14, "odd")]]
    path, folder = f"file://{tmp_path}/jobs", tmp_path / "in"
    changed = []
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        stream = spark.readStream.schema(schema).parquet(f"file://{folder}")
        queue.record(stream, path, f"file://{tmp_path}/cp", 1, every=2).trigger(availableNow=True).start().awaitTermination()
        changed.append({r.job_id: r.status for r in spark.read.parquet(f"{path}/changes/{i}").collect()})
    assert changed == [{1: "RUNNING", 2: "WAITING", 3: "WAITING", 4: "WAITING", 5: "WAITING"}, {1: "COMPLETED", 2: "RUNNING"}, {9: "WAITING"}, {2: "FAILED", 3: "RUNNING"}, {3: "CANCELLED", 4: "RUNNING"}]
    now = {r.job_id: r.status for r in queue.recorded(spark, path, 4, 2).collect()}
    assert now == {1: "COMPLETED", 2: "FAILED", 3: "CANCELLED", 4: "RUNNING", 5: "WAITING", 9: "WAITING"}
    assert sorted(p.name for p in (tmp_path / "jobs/jobs").iterdir()) == ["1", "3"] and sorted(p.name for p in (tmp_path / "jobs/changes").iterdir()) == ["2", "3", "4"]


@pytest.mark.parametrize("kind", ["start"])
def test_output_has_a_row_for_each_batch_with_events(spark, tmp_path, kind):
    rows = [[("x", at(0), 1, kind)], [("x", at(1), 2, kind), ("y", at(1), 3, "odd")]]
    out = jobs.drained(jobs.job_states(batches(spark, tmp_path / "in", rows, "name string, at timestamp, seq long, kind string"), "name"), f"file://{tmp_path}/out")
    assert sorted(map(tuple, out.select("name", "n", "status").where(F.col("action").isNull()).collect())) == [("x", 1, "RUNNING"), ("x", 2, "RUNNING"), ("y", 1, "WAITING")]
