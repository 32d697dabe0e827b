"""Metrics and transforms of sample arrays as higher-order functions: no shuffle, all in one pass of the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.levels import INF, amplitude, correlation, db, lit


def total(x: Column, of=lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + of(v))


def mean(x: Column, of=lambda v: v) -> Column:
    return total(x, of) / F.size(x)


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def rms(x: Column) -> Column:
    return F.sqrt(mean(x, lambda v: v * v))


def crest_db(x: Column) -> Column:
    return F.when(rms(x) == 0, F.lit(0.0)).otherwise(db(peak(x)) - db(rms(x)))


def clipped(x: Column) -> Column:
    return F.size(F.filter(x, lambda v: F.abs(v) >= 1.0))


def left(frame: Column) -> Column:
    """Every other sample of interleaved stereo, from the first."""
    return F.filter(frame, lambda v, i: i % 2 == 0)


def right(frame: Column) -> Column:
    return F.filter(frame, lambda v, i: i % 2 == 1)


def mono(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: (a + b) / 2)


def stereo_correlation(x: Column, y: Column) -> Column:
    return correlation(F.size(x), total(x), total(y), total(x, lambda v: v * v), total(y, lambda v: v * v), total(F.zip_with(x, y, lambda a, b: a * b)))


def side_to_mid_db(x: Column, y: Column) -> Column:
    side, mid = rms(F.zip_with(x, y, lambda a, b: (a - b) / 2)), rms(mono(x, y))
    return db(side / F.greatest(mid, F.lit(2.2250738585072014e-308)))


def edge_silence_ms(envelope: Column, sample_rate: int, threshold_db: float = -75.0) -> tuple[Column, Column]:
    """(leading, trailing) milliseconds under the threshold; the whole length twice if nothing is above."""
    loud = F.transform(F.filter(F.transform(envelope, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda s: s["v"] > 10 ** (threshold_db / 20)), lambda s: s["i"])
    n = F.size(envelope)
    none = F.size(loud) == 0
    full = n * 1000.0 / sample_rate
    return F.when(none, full).otherwise(F.array_min(loud) * 1000.0 / sample_rate), F.when(none, full).otherwise((n - 1 - F.array_max(loud)) * 1000.0 / sample_rate)


def tail(x: Column, n) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.slice(x, F.greatest(F.lit(1), F.size(x) - n + 1), n)


def gain(x: Column, gain_db) -> Column:
    k = amplitude(lit(gain_db))
    return F.transform(x, lambda v: v * k)


def remove_dc(x: Column) -> Column:
    m = mean(x)
    return F.transform(x, lambda v: v - m)


def fade_out(x: Column, n) -> Column:
    """Linear weights over the last ``n`` samples; the last one is 0."""
    n = F.least(n if isinstance(n, Column) else F.lit(n), F.size(x))
    return F.transform(x, lambda v, i: F.when(i < F.size(x) - n, v).when(i == F.size(x) - 1, F.lit(0.0)).otherwise(v * (F.size(x) - 1 - i) / F.greatest(n - 1, F.lit(1))))


def matched_mix(x: Column, wet: Column, wet_percent: float) -> Column:
    """``wet`` brought to the RMS of ``x`` and mixed in."""
    k = F.when(rms(wet) <= 1e-15, F.lit(1.0)).otherwise(rms(x) / F.greatest(rms(wet), F.lit(1e-15)))
    share = wet_percent / 100.0
    return F.zip_with(x, wet, lambda d, w: d * (1 - share) + w * k * share)


def saturate(x: Column, wet_percent: float, drive: float = 1.35) -> Column:
    return matched_mix(x, F.transform(x, lambda v: F.tanh(v * drive) / F.tanh(F.lit(drive))), wet_percent)


def densify(x: Column, wet_percent: float, threshold_db: float = -18.0, ratio: float = 1.25) -> Column:
    t = 10 ** (threshold_db / 20)
    return matched_mix(x, F.transform(x, lambda v: F.when(F.abs(v) > t, F.signum(v) * (t + (F.abs(v) - t) / ratio)).otherwise(v)), wet_percent)


def delay(x: Column, samples: Column) -> Column:
    """Take out a delay: positive drops leading samples, negative puts zeros first; the length stays."""
    n = F.size(x)
    d = F.least(F.abs(samples), n)
    zeros = F.array_repeat(F.lit(0.0), d)
    ahead = F.concat(F.slice(x, d + 1, n - d), zeros)
    return F.when(samples >= 0, ahead).otherwise(F.concat(zeros, F.slice(x, F.lit(1), n - d)))


def pad_tail(x: Column, n: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0.0), n))


def trim_tail(x: Column, keep_after: int, threshold: float) -> Column:
    """Cut what follows the last sample above the threshold, but for ``keep_after`` samples."""
    last = F.coalesce(F.array_max(F.transform(F.filter(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda s: F.abs(s["v"]) > threshold), lambda s: s["i"])), F.lit(-1))
    return F.slice(x, F.lit(1), F.least(F.size(x), last + 1 + keep_after))


def finite_mean(x: Column) -> Column:
    own = F.filter(x, lambda v: ~F.isnan(v) & (F.abs(v) != INF))
    return F.when(F.size(own) == 0, F.lit(-INF)).otherwise(total(own) / F.greatest(F.size(own), F.lit(1)))


def finite_max(x: Column) -> Column:
    return F.coalesce(F.array_max(F.filter(x, lambda v: ~F.isnan(v) & (F.abs(v) != INF))), F.lit(-INF))


def smooth_three(x: Column) -> Column:
    """.25, .5, .25 with the ends repeated."""
    at = lambda i: F.element_at(x, F.greatest(F.lit(1), F.least(F.size(x), i)).cast("int"))
    return F.transform(x, lambda v, i: 0.25 * at(i) + 0.5 * v + 0.25 * at(i + 2))


def middle(x: Column) -> Column:
    """The median of an array; null where it is empty."""
    s, n = F.array_sort(x), F.size(x)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)


def once(value: Column, of) -> Column:
    """``of(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def transient_rate(x: Column, rate: Column, times: float = 12.0, least: float = 0.025) -> Column:
    """Jumps a second: first differences beyond ``times`` their robust scale (1.4826 of the median deviation), and beyond ``least``."""
    steps = F.zip_with(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), lambda b, a: b - a)

    def beyond(d: Column) -> Column:
        off = once(middle(d), lambda m: F.transform(d, lambda v: F.abs(v - m)))
        limit = F.greatest(F.lit(least), F.greatest(once(off, middle) * 1.4826, F.lit(1e-8)) * times)
        return once(limit, lambda most: F.size(F.filter(d, lambda v: F.abs(v) > most)) / F.greatest(F.size(d), F.lit(1)))

    return once(steps, beyond) * rate
