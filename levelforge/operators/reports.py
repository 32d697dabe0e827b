"""Report tables: patching rows from later measurements, unions with error rows, picks by priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import finite, fixed, texts
from ..sources.shared import fresh


def blank(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def patch(report: DataFrame, found: DataFrame, key: str, always: dict[str, Column] | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Left-join ``found`` onto ``report``: a hit overwrites, a miss fills only blank cells from ``defaults``; ``always`` is written anyway."""
    names, of = [c for c in found.columns if c != key], fresh("of")
    new = {c: fresh("new") for c in names}
    joined = report.join(found.select(F.col(key).alias(of), *(F.col(c).alias(x) for c, x in new.items())), F.col(key) == F.col(of), "left")
    hit = F.col(of).isNotNull()
    columns = {}
    for c in dict.fromkeys([*report.columns, *names]):
        old = blank(F.col(c).cast("string")) if c in report.columns else F.lit(None).cast("string")
        kept = F.coalesce(old, (defaults or {}).get(c, F.lit(None)).cast("string"))
        columns[c] = F.when(hit, F.col(new[c]).cast("string")).otherwise(kept) if c in names else (F.col(c) if c in report.columns else kept)
    columns.update(always or {})
    return joined.select(*(x.alias(c) for c, x in columns.items()))


def with_errors(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """All rows and all error rows; what an error row lacks is blank."""
    both = rows.unionByName(errors, allowMissingColumns=True)
    return both.fillna("", [f.name for f in both.schema.fields if f.dataType.simpleString() == "string"])


def first_existing(candidates: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value, priority) from the first of ``candidates`` that has the key."""
    each = [c.select(key, F.col(value), F.lit(i).alias("priority")) for i, c in enumerate(candidates)]
    return reduce(DataFrame.unionByName, each).groupBy(key).agg(F.min_by(value, "priority").alias(value), F.min("priority").alias("priority"))


#: Results that a noise summary counts, and the columns of a noise report.
NOISE_RESULTS = ["CLEAN", "REPAIRED_LIGHT", "REPAIRED_MEDIUM", "NEEDS_REVIEW"]
NOISE_COLUMNS = ["Track", "Filename", "IntroNoiseScore", "DetectedType", "RepairMode", "ReductionStrength", "BeforeRMS", "AfterRMS", "HighFreqDelta", "Result", "Recommendation", "Warnings"]


def noise_summary(results: DataFrame, result: str = "result") -> DataFrame:
    """(result, n) of the four results, zeros included; any other result, and null, is for review."""
    spark = results.sparkSession
    known = F.when(F.col(result).isin(NOISE_RESULTS), F.col(result)).otherwise(NOISE_RESULTS[-1])
    n = results.groupBy(known.alias("result")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(x,) for x in NOISE_RESULTS], "result string").join(n, "result", "left").select("result", F.coalesce("n", F.lit(0)).alias("n"))


def noise_report(results: DataFrame, batch: str, *order: str) -> DataFrame:
    """The noise report as texts, a row a track, numbered from 1 in each batch; a batch is one release, some dozen tracks.

    ``results`` has source, score, found, applied, reduction_db, before_rms,
    after_rms, high_delta_db, result, recommendation and warnings.
    """
    c = F.col
    level = lambda x: F.when(finite(c(x)), fixed(c(x), 2)).otherwise("")
    place = F.row_number().over(Window.partitionBy(batch).orderBy(*order)).cast("string")
    strength = F.when(F.coalesce(c("reduction_db"), F.lit(0.0)) != 0, F.concat(fixed(c("reduction_db"), 1), F.lit(" dB"))).otherwise("BYPASS")
    kinds = F.when(F.size("found") > 0, F.array_join("found", "/")).otherwise("NONE")
    values = [place, F.element_at(F.split("source", "/"), -1), fixed(c("score"), 1), kinds, c("applied"), strength, level("before_rms"), level("after_rms")]
    values += [F.concat(fixed(c("high_delta_db"), 2), F.lit(" dB")), c("result"), c("recommendation"), F.array_join("warnings", " | ")]
    return results.select(batch, *(F.coalesce(v, F.lit("")).alias(n) for n, v in zip(NOISE_COLUMNS, values, strict=True)))


def tail_notes(gate: DataFrame, order: str) -> DataFrame:
    """(track, note) of gate records whose trimmed track and note aren't blank; of several the last by ``order``."""
    own = gate.select(blank(F.col("track")).alias("track"), blank(F.col("tail_note")).alias("note"), order).where("track IS NOT NULL AND note IS NOT NULL")
    return own.groupBy("track").agg(F.max_by("note", F.struct(order, "note")).alias("note"))


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the last by ``order``; ties fall to the largest row."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r")).select(key, "r.*")


def refresh(stale: DataFrame, measured: DataFrame, key: str) -> DataFrame:
    """``stale`` with the columns of ``measured`` where its final file was measured (a warning is added where it came out softer), else as it was.

    ``stale`` has lufs and warnings (an array) beside others, ``measured`` has
    lufs and any of the others.
    """
    names, of = [c for c in measured.columns if c != key], fresh("of")
    new = {c: fresh("new") for c in names}
    now = measured.select(F.col(key).alias(of), *(F.col(c).alias(x) for c, x in new.items()))
    softer = F.col("lufs") - F.col(new["lufs"])
    text = F.concat(F.lit("codec safety attenuation applied: -"), fixed(softer, 2), F.lit(" dB"))
    warned = F.when(softer > 0.03, F.array_union("warnings", F.array(text))).otherwise(F.col("warnings"))
    joined = stale.join(now, F.col(key) == F.col(of), "left")
    pick = lambda c: F.when(F.col(of).isNotNull(), F.col(new[c])).otherwise(F.col(c))
    return joined.select(*((warned if c == "warnings" else pick(c) if c in names else F.col(c)).alias(c) for c in stale.columns))


def codec_peaks(previews: DataFrame, key: str, ceiling: float = -1.5, tolerance: float = 0.05) -> DataFrame:
    """(key, max_peak, safe) of codec previews (peak; null where one was not measured); minus infinity where none was."""
    n = previews.groupBy(key).agg(F.coalesce(F.max("peak"), F.lit(float("-inf"))).alias("max_peak"))
    return n.withColumn("safe", F.col("max_peak") <= ceiling + tolerance)


def fixed_count(report: DataFrame, batch: str, column: str) -> DataFrame:
    """(batch, fixed): rows whose ``column`` isn't blank."""
    return report.groupBy(batch).agg(F.count_if(blank(F.col(column)).isNotNull()).alias("fixed"))


def stage_seconds(events: DataFrame, track: str, stages: list[str]) -> DataFrame:
    """(track, a column a stage, total) from (stage, seconds): seconds by stage, and those of all stages."""
    sums = [F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("seconds"))), F.lit(0.0)).alias(s) for s in stages]
    return events.groupBy(track).agg(*sums, F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total"))


def job_results(report: DataFrame, job: str) -> DataFrame:
    """(job, status, total, ready, review, passed, warned, failed); a track without a disposition is for review."""
    d = F.coalesce(blank(F.col("disposition")), F.lit("NEEDS_REVIEW"))
    n = report.groupBy(job).agg(F.count("*").alias("total"), F.count_if(d == "NEEDS_REVIEW").alias("review"), *(F.count_if(F.col("status") == s).alias(c) for s, c in (("PASS", "passed"), ("WARN", "warned"), ("FAIL", "failed"))))
    return n.select(job, F.when(F.col("review") > 0, "COMPLETED_WITH_REVIEW").otherwise("COMPLETED").alias("status"), "total", (F.col("total") - F.col("review")).alias("ready"), "review", "passed", "warned", "failed")


def loudness_flags(final: Column, target: Column, tolerance: float = 0.20) -> tuple[Column, Column]:
    """(signed difference from the target, whether it is within the tolerance), both as texts, blank where there is no finite loudness."""
    off = final - target
    return F.when(finite(final), fixed(off, 2, sign=True)).otherwise(""), F.when(finite(final), F.when(F.abs(off) <= tolerance + 1e-9, "true").otherwise("false")).otherwise("")


def source_warnings(true_peak: Column, lra: Column, final: Column, final_peak: Column, target: Column, ceiling: Column | None = None) -> Column:
    """Warnings of a finished track in their fixed order; with a ceiling the stricter limits hold. Nulls and NaN warn of nothing."""
    over = F.abs(final - target) > (0.35 if ceiling is not None else 0.8)
    peak = final_peak > (ceiling + 0.10 if ceiling is not None else -0.5)
    ok = lambda x, c: finite(x) & c
    return texts(
        (ok(true_peak, true_peak > 0), "source true peak above 0 dBTP"), (ok(lra, lra >= 18), "very wide source dynamics"), (ok(lra, lra <= 2), "source is strongly compressed already"),
        (ok(final, over), "final loudness misses its target"), (ok(final_peak, peak), "final true peak leaves too little room"),
    )


def has_issue(issues: Column, prefix: str) -> Column:
    return F.exists(issues, lambda x: x.startswith(prefix))


def with_text(items: Column, text: Column) -> Column:
    """``items`` and ``text``, unless it is blank or there already."""
    return F.when(F.coalesce(text, F.lit("")) == "", items).otherwise(F.array_union(items, F.array(text)))


def admit(jobs: DataFrame, slots: int, queue: str, *order: str) -> DataFrame:
    """The first ``slots`` waiting jobs of each queue."""
    w = Window.partitionBy(queue).orderBy(*order)
    return jobs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= slots)
