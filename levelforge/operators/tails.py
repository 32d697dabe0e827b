"""What is done to whole tracks (arrays of channels): checks, constant gain, offsets, and repair of their ends."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import INF, db, lit
from ..sources.shared import fresh
from . import arrays as A

#: The end of a track in ms, and the levels in dB that judge and mend it.
END_MS, END_RMS, LAST_SAMPLE, ENERGETIC, MICRO = 100.0, -50.0, -60.0, -35.0, -80.0
HARD_FADE_MS, MICRO_FADE_MS, ENERGETIC_FADE_MS, LONGEST_FADE_MS, MARGIN = 25.0, 5.0, 400.0, 1200.0, 0.5


def samples(rate: Column, ms, least: int = 1) -> Column:
    return F.greatest(F.lit(least), F.round(rate * lit(ms) / 1000.0).cast("int"))


def audio_error(channels: Column) -> Column:
    """Why an array of channels is no audio, null where it is: no channels or samples, unequal channels, or samples that are not finite."""
    sizes = F.transform(channels, F.size)
    strange = F.exists(channels, lambda c: F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == INF)))
    return (
        F.when(channels.isNull() | (F.size(channels) == 0) | F.exists(channels, lambda c: c.isNull() | (F.size(c) == 0)), "Audio is empty.")
        .when(F.array_min(sizes) != F.array_max(sizes), "Audio must have shape (frames,) or (frames, channels).").when(strange, "Audio contains NaN or infinity.")
    )


def largest(channels: Column) -> Column:
    return F.array_max(F.transform(channels, A.peak))


def gain_only(channels: Column, gain_db: Column) -> Column:
    """Struct(channels, error): a constant gain, refused where it gives samples that are not finite, or clips."""
    scaled = F.transform(channels, lambda c: A.gain(c, gain_db))
    error = F.when(F.exists(scaled, lambda c: F.exists(c, lambda v: F.isnan(v) | (F.abs(v) == INF))), "gain-only render produced non-finite samples")
    error = error.when(largest(scaled) > 1.0, "gain-only render would clip")
    return F.struct(F.when(error.isNull(), scaled).alias("channels"), error.alias("error"))


def dc_removed(channels: Column, most: float = 1e-4) -> Column:
    """Struct(channels, applied, before, error): every channel less its mean, refused where that clips; applied says whether there was more than ``most``."""
    before = F.array_max(F.transform(channels, lambda c: F.abs(A.mean(c))))
    clean = F.transform(channels, A.remove_dc)
    error = F.when(largest(clean) > 1.0, "DC cleanup would produce clipped samples")
    return F.struct(F.when(error.isNull(), clean).alias("channels"), (before > most).alias("applied"), before.alias("before"), error.alias("error"))


def end_levels(channels: Column, rate: Column, ms: float = END_MS) -> tuple[Column, Column]:
    """(RMS of the last ``ms`` of all channels, largest last sample), in dB."""
    n = samples(rate, ms)
    last = F.array_max(F.transform(channels, lambda c: F.abs(F.element_at(c, -1))))
    return db(A.rms(F.flatten(F.transform(channels, lambda c: A.tail(c, n))))), db(last)


def fade_candidates(base: float = ENERGETIC_FADE_MS, tried: Iterable[float] | None = None, most: float = LONGEST_FADE_MS) -> Column:
    """The fades in ms to try, rising: ``tried`` (else 1, 1.5, 2 and 3 times the base) and the base, from 5 to ``most``, each once."""
    base = max(5.0, base)
    each = F.array(*map(F.lit, [float(x) for x in (tried if tried is not None else [base, 1.5 * base, 2 * base, 3 * base])] + [base]))
    real = F.filter(each, lambda v: ~F.isnan(v) & (F.abs(v) != INF) & (v > 0))
    return F.array_sort(F.array_distinct(F.transform(real, lambda v: F.bround(F.least(F.lit(max(base, most)), F.greatest(F.lit(5.0), v)), 3))))


def faded(channels: Column, rate: Column, ms) -> Column:
    return F.transform(channels, lambda c: A.fade_out(c, samples(rate, ms, 2)))


def repair_tail(tracks: DataFrame, candidates: Column | None = None) -> DataFrame:
    """``tracks`` (sample_rate, channels and others) with channels mended at the end, and mode, fade_ms and attempted.

    An energetic end takes the shortest fade after which it is ``MARGIN`` under
    the limit and no hard cut, else the longest; a hard cut and a last sample
    that is not silent take a short fade, anything else none. All fades start
    from the track as it was.
    """
    ladder = candidates if candidates is not None else fade_candidates()
    rms, last = end_levels(F.col("channels"), F.col("sample_rate"))
    end, final = fresh("end"), fresh("last")
    df = tracks.withColumns({end: rms, final: last})

    def passes(ms):
        after, sample = end_levels(faded(F.col("channels"), F.col("sample_rate"), ms), F.col("sample_rate"))
        return (after <= ENERGETIC - MARGIN) & ~((after > END_RMS) & (sample > LAST_SAMPLE))

    first = F.array_min(F.filter(ladder, passes))
    chosen = F.coalesce(first, F.array_max(ladder))
    mode = F.when(F.col(end) > ENERGETIC, "musical_tail_fade").when((F.col(end) > END_RMS) & (F.col(final) > LAST_SAMPLE), "click_safe_fade").when(F.col(final) > MICRO, "micro_fade").otherwise("none")
    df = df.withColumn("mode", mode)
    by = {"musical_tail_fade": chosen, "click_safe_fade": F.lit(HARD_FADE_MS), "micro_fade": F.lit(MICRO_FADE_MS)}
    df = df.withColumn("fade_ms", F.coalesce(*(F.when(F.col("mode") == m, x) for m, x in by.items()), F.lit(0.0)))
    tried = F.when(F.col("mode") == "musical_tail_fade", F.filter(ladder, lambda x: x <= F.col("fade_ms"))).when(F.col("mode") == "none", F.array().cast("array<double>")).otherwise(F.array("fade_ms"))
    mended = F.when(F.col("fade_ms") > 0, faded(F.col("channels"), F.col("sample_rate"), F.col("fade_ms"))).otherwise(F.col("channels"))
    return df.withColumns({"attempted": tried, "channels": mended}).drop(end, final)


def within_budgets(attempts: DataFrame, track: str, kind: str, order: str, budgets: dict[str, int]) -> DataFrame:
    """``attempts`` with done and left: whether each is within its track's budget for its kind, and what then remains of it.

    Kinds without a budget have none left. A track's attempts are a handful, so
    its window is small; ties in ``order`` count in any order.
    """
    limit = F.coalesce(F.create_map(*(F.lit(x) for kv in budgets.items() for x in kv))[F.col(kind)], F.lit(0))
    place = F.row_number().over(Window.partitionBy(track, kind).orderBy(order))
    return attempts.withColumns({"done": place <= limit, "left": F.greatest(F.lit(0), limit - place)})
