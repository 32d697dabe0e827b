"""Delay between a source and its processed counterpart: windows, cross-correlation, agreement, and what follows from it.

Windows are rows, so a long track's windows are correlated in parallel; only the
few estimates of a track meet in one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import clamp

#: Least samples of a window, and the norm under which it is silent.
LEAST_SAMPLES, SILENCE = 16, 1e-15
TOO_SHORT, SILENT = "Audio window is too short to estimate delay.", "Delay cannot be estimated from a silent window."
NOTHING = "Delay could not be estimated from any analysis window."


def window_lag(reference: np.ndarray, processed: np.ndarray, most: int) -> tuple[int, float]:
    """(lag, correlation) of the best lag within ``most`` samples either way, the smallest of equals; ValueError for a short or silent window."""
    n = min(len(reference), len(processed))
    if n < LEAST_SAMPLES:
        raise ValueError(TOO_SHORT)
    a, b = reference[:n] - reference[:n].mean(), processed[:n] - processed[:n].mean()
    norms = np.linalg.norm(a), np.linalg.norm(b)
    if min(norms) <= SILENCE:
        raise ValueError(SILENT)
    most = min(most, n - 1)
    size = 1 << (n + most).bit_length()
    around = np.fft.irfft(np.fft.rfft(b / norms[1], size) * np.conj(np.fft.rfft(a / norms[0], size)), size)
    found = np.concatenate([around[size - most :], around[: most + 1]])
    best = int(found.argmax())
    return best - most, float(found[best])


def window_starts(total: Column, window: Column, count: int) -> Column:
    """Evenly spaced starts (from 0) of at most ``count`` windows, one where there is no room for more."""
    n = F.least(F.lit(count), F.greatest(F.lit(1), F.floor(total / F.greatest(F.lit(LEAST_SAMPLES), F.floor(window / 2))))).cast("int")
    room = F.greatest(F.lit(0), total - window)
    spaced = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == n - 1, room).otherwise(F.floor(i * (room / F.greatest(n - 1, F.lit(1)))).cast("int")))
    return F.when((room == 0) | (n == 1), F.array(F.lit(0))).otherwise(spaced)


def median(x: Column) -> Column:
    """Of a numeric array; null where it is empty."""
    s, n = F.array_sort(x), F.size(x)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)


def delay_summary(found: Column, tolerance: int) -> Column:
    """Struct(delay, estimates, confidence, consistent, spread) of an array of struct(start, lag, peak) in order of start."""
    lags = F.transform(found, lambda w: w["lag"])
    delay = F.bround(median(lags.cast("array<double>"))).cast("int")
    inner = F.filter(found, lambda w: F.abs(w["lag"] - delay) <= tolerance)
    agreement = F.size(inner) / F.size(found)
    inside = F.transform(inner, lambda w: w["lag"])
    spread = F.when(F.size(inner) > 1, F.array_max(inside) - F.array_min(inside)).otherwise(F.lit(0))
    quality = F.coalesce(median(F.transform(inner, lambda w: clamp(w["peak"], 0.0, 1.0))), F.lit(0.0))
    confidence = clamp(0.70 * agreement + 0.30 * quality, 0.0, 1.0)
    enough = agreement >= F.when(F.size(found) >= 3, 0.60).otherwise(1.0)
    consistent = enough & (spread <= max(1, 2 * tolerance))
    return F.struct(delay.alias("delay"), lags.alias("estimates"), confidence.alias("confidence"), consistent.alias("consistent"), spread.alias("spread"))


def delay_diagnostics(pairs: DataFrame, max_delay_ms: float = 100.0, window_count: int = 5, window_seconds: float = 6.0, tolerance: int = 3) -> DataFrame:
    """(track_id, delay, estimates, confidence, consistent, spread, error) of ``pairs`` (track_id, sample_rate, reference, processed: mono samples).

    Short and silent windows are left out; a track without any other has the
    reason in error and nulls elsewhere. A row each, also for repeated tracks'
    ids, which are taken together.
    """
    if window_count <= 0 or window_seconds <= 0 or tolerance < 0:
        raise ValueError("window_count and window_seconds must be positive, tolerance not negative")
    total = F.least(F.size("reference"), F.size("processed"))
    window = F.least(total, F.greatest(F.lit(LEAST_SAMPLES), F.round(F.col("sample_rate") * window_seconds).cast("int")))
    cut = pairs.withColumns({"total": total, "window": window}).withColumn("start", F.explode(window_starts(F.col("total"), F.col("window"), window_count)))
    part = lambda x: F.slice(x, F.col("start") + 1, F.greatest(F.lit(0), F.col("window"))).cast("array<double>").alias(x)
    most = F.round(F.col("sample_rate") * max_delay_ms / 1000.0).cast("int").alias("most")
    rows = cut.select("track_id", "start", most, part("reference"), part("processed"))

    def correlate(frames):
        for frame in frames:
            out = []
            for track, start, far, a, b in frame.itertuples(index=False):
                try:
                    out.append((track, start, *window_lag(np.asarray(a, float), np.asarray(b, float), int(far)), None))
                except (TypeError, ValueError) as e:
                    out.append((track, start, None, None, str(e)))
            yield pd.DataFrame(out, columns=["track_id", "start", "lag", "peak", "error"]).astype({"lag": "Int32"})

    kind = pairs.schema["track_id"].dataType.simpleString()
    seen = rows.mapInPandas(correlate, f"track_id {kind}, start int, lag int, peak double, error string")
    good = F.array_sort(F.collect_list(F.when(F.col("lag").isNotNull(), F.struct("start", "lag", "peak"))))
    of = seen.groupBy("track_id").agg(good.alias("found")).withColumn("d", F.when(F.size("found") > 0, delay_summary(F.col("found"), tolerance)))
    return of.select("track_id", "d.*", F.when(F.size("found") == 0, NOTHING).alias("error"))


def should_align(kind: Column, delay: Column, consistent: Column, confidence: Column, least: int = 48, most: int = 4800, min_confidence: float = 0.70) -> Column:
    """Whether a confirmed delay is of a size that is shifted automatically; nulls are no."""
    return F.coalesce((kind == "FAIL") & F.abs(delay).between(least, most) & consistent & (confidence >= min_confidence), F.lit(False))


def aligned(before: Column, after: Column, after_kind: Column) -> Column:
    """Whether the shift helped: less delay than before, and none that is confirmed."""
    return F.coalesce((F.abs(after) < F.abs(before)) & (after_kind != "FAIL"), F.lit(False))


def alignment_note(before: Column, after: Column) -> Column:
    return F.format_string("automatic sample alignment applied: %+d \u2192 %+d samples", before, after)
