"""Queries that run a stream over the driver's tables until it is read up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..streaming.jobs import drained, job_states, new_jobs, polls
from .registry import ORACLES, query, table
from .relations import queue_replay  # noqa: F401  registers its SQL


def event_stream(spark, sf_dir):
    """``events`` as a stream of its file; the pattern lets the table be a file or a folder, and watermarks need timestamps with a time zone."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def closing(stream: DataFrame, key: str, time: str) -> DataFrame:
    """``stream`` and one row more, of job -1, in a year after all: it pushes the watermark past every other row. Its key isn't null, as joins drop null keys before the watermark sees them."""
    folder = f"{shared_folder(stream.sparkSession)}/closing"
    stream.sparkSession.range(1).select(*(F.lit("2200-01-01" if f.name == time else -1 if f.name == key else None).cast(f.dataType).alias(f.name) for f in stream.schema)).write.parquet(folder)
    return stream.union(stream.sparkSession.readStream.schema(stream.schema).parquet(folder))


@query(ORACLES["queue_replay"])
def queue_stream(spark, sf_dir):
    """The states of ``queue_replay``, kept on the stream: a job a user, its last state."""
    kind = F.when(F.col("event_type") == "purchase", "finish").when(F.col("event_type").isin("click", "view"), "start").when(F.col("event_type") == "signup", "cancel").otherwise("fail")
    events = event_stream(spark, sf_dir).select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"))
    seen = drained(job_states(events, "user_id"), shared_folder(spark))
    last = seen.where("action IS NULL").groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("status", "n").alias("status"))
    return last.select("user_id", F.col("n").cast("int").alias("n"), "status")


@query("""WITH j AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P'),
a AS (SELECT user_id, arg_min(event_id, event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS folder, 'WAITING' AS status FROM a WHERE user_id NOT IN (SELECT id FROM j)""")
def queue_add_stream(spark, sf_dir):
    """Signups as requests for a folder a user; those with an order under way are refused, repeated ones are one."""
    asked = event_stream(spark, sf_dir).where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("folder"), (F.col("event_id") % 20).cast("int").alias("n_files"), F.col("ts").alias("at"))
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("CANCELLED")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("folder"), status.alias("status"))
    return drained(new_jobs(asked, jobs, late="3650 days"), shared_folder(spark)).select("folder", "status")


@query("""WITH p AS (SELECT user_id AS job_id, event_id, ts AS t, CAST(event_id % 15 AS INTEGER) AS c FROM events WHERE event_type <> 'purchase'),
r AS (SELECT user_id AS r_id, event_id AS e, ts AS ended, CAST(event_id % 3 AS INTEGER) AS code FROM events WHERE event_type = 'purchase')
SELECT job_id, t AS "at", CASE WHEN r_id IS NULL THEN 'RUNNING' WHEN code = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status, CASE WHEN r_id IS NOT NULL AND code = 0 THEN 15 ELSE c END AS current_track, CASE WHEN code > 0 THEN 'worker exited with code ' || code END AS error
FROM p LEFT JOIN r ON job_id = r_id AND ended <= t AND ended >= t - INTERVAL 2 DAY""")
def queue_poll_stream(spark, sf_dir):
    """Every event but a purchase is a look at the user's job, every purchase its end; looks see the ends of the last two days."""
    e = event_stream(spark, sf_dir)
    looks = e.where("event_type <> 'purchase'").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), (F.col("event_id") % 15).cast("int").alias("current_track"), F.lit(15).alias("total_tracks"))
    ends = event_stream(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("job_id"), F.col("ts").alias("ended"), (F.col("event_id") % 3).cast("int").alias("code"), F.when(F.col("event_id") % 3 == 0, "COMPLETED").alias("status"), F.lit(None).cast("string").alias("error"))
    seen = drained(polls(closing(looks, "job_id", "at"), closing(ends, "job_id", "ended"), "2 days"), shared_folder(spark))
    return seen.where("job_id <> -1").select("job_id", F.col("at").cast("timestamp_ntz").alias("at"), "status", "current_track", "error")
