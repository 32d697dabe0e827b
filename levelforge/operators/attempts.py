"""Try, judge, choose: a changed version of a track beside the one it was, both judged, one kept.

Only the tracks that a step is for are changed and judged again; what was
decided is written between the steps, so a lost task costs that step alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import arrays as A
from . import rules as R
from .alignment import aligned, alignment_note, delay_diagnostics, should_align
from .tails import repair_tail


def mono(channels: Column) -> Column:
    """The mean of all channels."""
    added = F.aggregate(F.slice(channels, 2, F.greatest(F.size(channels), F.lit(1))), F.get(channels, F.lit(0)), lambda s, c: F.zip_with(s, c, lambda a, b: a + b))
    return F.transform(added, lambda v: v / F.size(channels))


def delays(tracks: DataFrame, **diagnostics) -> DataFrame:
    """(track_id, delay, consistent, confidence, estimates, error, kind) of tracks (track_id, sample_rate, reference: mono samples, channels)."""
    pairs = tracks.select("track_id", "sample_rate", "reference", mono(F.col("channels")).alias("processed"))
    found = delay_diagnostics(pairs, **diagnostics)
    kind = F.when(F.col("delay").isNotNull(), R.delay_class(F.col("delay"), F.col("consistent"), F.col("confidence")))
    return found.select("track_id", "delay", "consistent", "confidence", "estimates", "error", kind.alias("kind"))


def align(tracks: DataFrame, judge: Callable[[DataFrame, DataFrame], DataFrame], least: int = 48, most: int = 4800, min_confidence: float = 0.70, **diagnostics) -> DataFrame:
    """``tracks`` (track_id, sample_rate, reference, channels) after automatic alignment, with what decided it.

    A track with a confirmed delay of ``least`` to ``most`` samples is shifted
    and its end repaired, then measured and judged anew. The shifted version
    stays if its delay is smaller and not confirmed as a failure; else the track
    is as it was, with its first verdict. ``judge(tracks, delays)`` gives
    (track_id, issues, warnings). Columns: channels, aligned, delay (of what is
    kept), first_delay, kind, issues, warnings, status: an aligned track is FAIL
    with issues and PASS without, never WARN; its note is the last warning.
    """
    first = written(delays(tracks, **diagnostics))
    verdict = written(judge(tracks, first).select("track_id", "issues", "warnings"))
    tried = first.where(should_align(F.col("kind"), F.col("delay"), F.col("consistent"), F.col("confidence"), least, most, min_confidence)).select("track_id", F.col("delay").alias("first_delay"))
    moved = tracks.join(tried, "track_id").withColumn("channels", F.transform("channels", lambda c: A.delay(c, F.col("first_delay"))))
    moved = written(repair_tail(moved).drop("fade_ms", "attempted"))
    second = written(delays(moved, **diagnostics))
    better = second.join(tried, "track_id").where(aligned(F.col("first_delay"), F.col("delay"), F.col("kind"))).select("track_id", "first_delay", "delay", "kind")
    again = judge(moved.join(better.select("track_id"), "track_id", "left_semi"), second).select("track_id", "issues", "warnings")
    note = alignment_note(F.col("first_delay"), F.col("delay"))
    fixed = moved.drop("first_delay").join(better, "track_id").join(again, "track_id")
    fixed = fixed.withColumns({"aligned": F.lit(True), "warnings": F.array_union("warnings", F.array(note)), "status": F.when(F.size("issues") > 0, "FAIL").otherwise("PASS")})
    rest = tracks.join(better.select("track_id"), "track_id", "left_anti").join(first.select("track_id", "delay", "kind"), "track_id", "left").join(verdict, "track_id")
    rest = rest.withColumns({"aligned": F.lit(False), "first_delay": F.col("delay"), "mode": F.lit("none"), "status": R.gate_status(F.col("issues"), F.col("warnings"))})
    columns = ["track_id", "channels", "aligned", "delay", "first_delay", "kind", "mode", "issues", "warnings", "status"]
    return fixed.select(columns).unionByName(rest.select(columns))


def ladder(tracks: DataFrame, strengths: list[int], render: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[int]]:
    """((track_id, strength, channels, reasons), tracks rendered in each round): the first strength at which a track passes.

    ``tracks`` has track_id, sample_rate and channels. ``render`` takes them with
    a column strength and gives (track_id, sample_rate, channels); ``judge`` takes
    the renders beside the originals (original: channels) and gives (track_id,
    reasons), empty where one passes. Each round takes only the tracks that have
    failed all before it; strength 0 keeps the original and always passes, with
    the reasons of the last failure.
    """
    left, done, rendered = tracks, [], []
    why = None
    for strength in strengths:
        if strength <= 0:
            break
        tried = render(left.withColumn("strength", F.lit(strength))).select("track_id", "channels")
        both = written(left.select("track_id", "sample_rate", F.col("channels").alias("original")).join(tried, "track_id"))
        rendered.append(both.count())
        seen = written(judge(both).select("track_id", "reasons"))
        passed = seen.where(F.size("reasons") == 0)
        done.append(both.join(passed, "track_id").select("track_id", F.lit(strength).alias("strength"), "channels", "reasons"))
        why = seen.where(F.size("reasons") > 0)
        left = tracks.join(why.select("track_id"), "track_id", "left_semi")
        if not why.head(1):
            break
    none = F.array().cast("array<string>")
    rest = left.join(why, "track_id", "left") if why is not None else left.withColumn("reasons", none)
    done.append(rest.select("track_id", F.lit(0).alias("strength"), "channels", F.coalesce("reasons", none).alias("reasons")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, rendered
