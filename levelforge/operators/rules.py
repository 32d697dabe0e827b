"""Decision tables as columns: quality gate, loudness preflight, fullness, retries, dispositions.

Every function takes columns and returns columns, so a table of any size is
decided in one projection. Comparisons with NaN do not hold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.levels import clamp, db_floored, finite, finite_or, fixed, half_even, joined, lit, texts, valid_metric

# Fixed values of the rules.
SAFE_WARNING_PREFIXES = ["minor trailing-silence", "silent trailing-silence", "sub-millisecond delay"]
RICH_GENRES = ["OLD POP", "SENIOR KR", "SENIOR JP", "SHOWA JP", "BALLAD", "J-BALLAD", "SOUL", "K-POP", "KIDS POP"]
SATURATION_LIMITS = {"OLD POP": 6.0, "SENIOR KR": 5.0, "SENIOR JP": 4.0, "SHOWA JP": 4.0, "ENKA JP": 4.0, "BALLAD": 5.0, "J-BALLAD": 5.0, "SOUL": 6.0, "R&B": 5.0, "K-POP": 3.0, "KIDS POP": 2.0, "JAZZ": 2.0, "ACOUSTIC": 2.0, "INSTRUMENTAL": 2.0, "GENERAL": 3.0}
DENSITY_LIMITS = {"OLD POP": 5.0, "SENIOR KR": 4.0, "SENIOR JP": 3.0, "SHOWA JP": 3.0, "ENKA JP": 3.0, "SOUL": 5.0, "BALLAD": 4.0, "J-BALLAD": 4.0, "K-POP": 2.0, "KIDS POP": 1.5, "JAZZ": 1.0, "ACOUSTIC": 1.0, "INSTRUMENTAL": 1.0, "GENERAL": 2.0}


def number(x: Column) -> Column:
    """NaN as null: comparisons with it then do not hold."""
    return F.when(~F.isnan(x), x)


def dynamics_risk(reduction: Column, final_lra: Column, crest_loss: Column, max_reduction=0.60, min_lra=3.5, max_crest_loss=0.75) -> Column:
    ok = finite(reduction) & finite(final_lra) & finite(crest_loss)
    return F.coalesce(ok & (reduction > lit(max_reduction) + 0.05) & ((final_lra < lit(min_lra)) | (crest_loss > lit(max_crest_loss))), F.lit(False))


def delay_class(samples: Column, consistent: Column, confidence: Column) -> Column:
    size = F.abs(samples)
    return F.when(size <= 1, "PASS").when(size <= 8, "INFO").when(size <= 47, "WARN").when(~consistent | (confidence < 0.70), "UNCERTAIN").otherwise("FAIL")


def tail_class(difference_ms: Column, duration_delta_ms: Column, hard_cut: Column, energetic: Column, last_sample_db: Column, end_rms_db: Column) -> Column:
    last_ok = ~finite(last_sample_db) | (last_sample_db <= -60.0)
    safe = ~hard_cut & ~energetic & last_ok
    quiet = end_rms_db.isNotNull() & (~finite(end_rms_db) | (end_rms_db <= -80.0))
    return F.when((duration_delta_ms > 0) | (difference_ms <= 20.0), "PASS").when(safe & (difference_ms <= 50.0), "INFO").when(safe & quiet & (difference_ms <= 100.0), "INFO").otherwise("WARN")


def delay_note(samples: Column, consistent: Column, confidence: Column, estimates: Column) -> Column:
    """What ``delay_class`` says in words; empty where it passes. Milliseconds are at 48 samples each, whatever the rate."""
    ms = fixed(F.abs(samples) / 48.0, 3)
    windows = F.concat(F.lit("windows ["), F.array_join(estimates.cast("array<string>"), ","), F.lit("]"))
    sure = fixed(confidence, 2)
    texts_of = {
        "PASS": F.lit(""),
        "INFO": F.format_string("minor delay estimate %d samples (%s ms); below correction threshold", samples, ms),
        "WARN": F.format_string("sub-millisecond delay estimate %d samples (%s ms); %s, no audio shift applied", samples, ms, windows),
        "UNCERTAIN": F.format_string("large delay estimate is inconsistent: median %d samples, confidence %s, %s", samples, sure, windows),
        "FAIL": F.format_string("confirmed residual processing delay: %d samples (%s ms, confidence %s, %s)", samples, ms, sure, windows),
    }
    kind = delay_class(samples, consistent, confidence)
    return F.coalesce(*(F.when(kind == k, t) for k, t in texts_of.items()))


def tail_note(difference_ms: Column, kind: Column) -> Column:
    """What ``tail_class`` says in words; empty where it passes. Differences over 50 ms that are INFO owe it to a fully quiet end."""
    ms = fixed(difference_ms, 1)
    minor = F.format_string("minor trailing-silence difference %s ms; final tail is silent and safe", ms)
    silent = F.format_string("silent trailing-silence difference %s ms; final tail is fully quiet and safe", ms)
    short = F.format_string("output tail is shorter than source tail by %s ms; listen for reverb cutoff", ms)
    return F.when(kind == "INFO", F.when(difference_ms <= 50.0, minor).otherwise(silent)).when(kind == "WARN", short).otherwise("")


#: Limits of the gate; a None is not judged.
GATE_LIMITS = {
    "rate": 48_000, "lufs_tolerance": 0.20, "peak_tolerance": 0.05, "clipped": 0, "dc": 1e-4, "correlation": -0.05, "low_correlation": 0.70, "low_cutoff": 110.0,
    "lra_reduction": None, "energetic_rms": None, "duration_loss": True, "tail_cut": True,
}


def gate_issues(m: dict[str, Column], target_lufs: float = -14.0, ceiling: float = -1.0, **limits) -> Column:
    """Issues with their measured values, in their fixed order; ``m`` has the metrics by name, absent ones are not judged.

    ``limits`` override ``GATE_LIMITS``. A comparison with NaN does not hold. The
    correlations are judged with two channels and more (``n_channels``, if given).
    """
    k = GATE_LIMITS | limits
    at = lambda name: m.get(name, F.lit(None).cast("double"))
    stereo = m["n_channels"] >= 2 if "n_channels" in m else F.lit(True)
    text = lambda form, *x: F.format_string(form, *(fixed(number_, d) for number_, d in x))
    num = lambda x, d: f"%.{d}f" % x
    rules = [
        ("rate", k["rate"] is not None, lambda x: x != k["rate"], lambda x: F.format_string(f"unexpected output sample rate: %d Hz (expected {k['rate']} Hz)", x)),
        ("valid", True, lambda x: ~x, lambda x: F.lit("processed metrics contain invalid numeric values")),
        ("lufs", True, lambda x: F.abs(number(x) - target_lufs) > k["lufs_tolerance"], lambda x: text(f"LUFS target miss: %s LUFS (target {num(target_lufs, 2)} ±{num(k['lufs_tolerance'], 2)})", (x, 2))),
        ("true_peak", True, lambda x: number(x) > ceiling + k["peak_tolerance"], lambda x: text(f"true peak exceeded: %s dBTP > {num(ceiling, 2)} dBTP", (x, 2))),
        ("clipped", True, lambda x: x > k["clipped"], lambda x: F.format_string("clipped samples: %d", x)),
        ("dc", True, lambda x: number(x) > k["dc"], lambda x: text("DC offset too high: %s", (x, 6))),
        ("correlation", True, lambda x: stereo & (number(x) < k["correlation"]), lambda x: text("stereo correlation too low: %s", (x, 3))),
        ("low_correlation", True, lambda x: stereo & (number(x) < k["low_correlation"]), lambda x: text(f"low-band stereo correlation too low: %s below {num(k['low_cutoff'], 0)} Hz", (x, 3))),
        ("delay", True, lambda x: x == "FAIL", lambda x: m.get("delay_note", F.lit("confirmed residual processing delay"))),
        ("duration_delta_ms", k["duration_loss"], lambda x: number(x) < -1.0, lambda x: text("unexpected duration loss: %s ms", (x, 2))),
        ("risk", True, lambda x: x, lambda x: text(f"DYNAMICS RISK: LRA reduced %s LU (preferred limit {num(k['lra_reduction'] or 0.60, 2)}), final LRA %s LU, crest loss %s dB", (at("lra_reduction"), 2), (at("lra"), 2), (at("crest_loss"), 2))),
        ("hard_cut", k["tail_cut"], lambda x: x, lambda x: text("TAIL HARD CUT: end RMS %s dBFS / last sample %s dBFS", (at("end_rms"), 1), (at("last"), 1))),
        ("energetic", k["tail_cut"] and k["energetic_rms"] is not None, lambda x: x, lambda x: text(f"ENERGETIC TAIL END: end RMS %s dBFS > {num(k['energetic_rms'], 1)} dBFS", (at("end_rms"), 1))),
    ]
    return texts(*((test(m[name]), say(m[name])) for name, judged, test, say in rules if judged and name in m))


def gate_warnings(m: dict[str, Column], max_lra_reduction: float | None = None) -> Column:
    """Warnings in their fixed order; the LRA is warned of only where no limit of its reduction makes it an issue."""
    rules = [
        ("source_rate", lambda x: x != m["rate"], lambda x: F.format_string("source %d Hz was resampled to %d Hz for delay measurement", x, m["rate"])),
        ("delay_error", lambda x: x.isNotNull(), lambda x: F.concat(F.lit("delay measurement unavailable: "), x)),
        ("delay", lambda x: x == "UNCERTAIN", lambda x: m.get("delay_note", F.lit("large delay estimate is inconsistent"))),
        ("lra_reduction", lambda x: number(x) > 1.5, lambda x: F.format_string("LRA reduced by %s LU", fixed(x, 2))),
        ("tail", lambda x: x == "WARN", lambda x: m.get("tail_note", F.lit("output tail is shorter than source tail"))),
    ]
    return texts(*((test(m[name]), say(m[name])) for name, test, say in rules if name in m and not (name == "lra_reduction" and max_lra_reduction is not None)))


def gate_status(issues: Column, warnings: Column) -> Column:
    return F.when(F.size(issues) > 0, "FAIL").when(F.size(warnings) > 0, "WARN").otherwise("PASS")


def safe_warning(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike("^(" + "|".join(SAFE_WARNING_PREFIXES) + ")")


def disposition(issues: Column, warnings: Column, codec_safe: Column) -> Column:
    """Nulls count as review."""
    bad = ~F.coalesce(codec_safe, F.lit(False)) | issues.isNull() | (F.size(issues) > 0) | ~F.forall(warnings, safe_warning)
    return F.when(bad | warnings.isNull(), "NEEDS_REVIEW").when(F.size(warnings) > 0, "READY_WITH_WARNING").otherwise("READY")


def release_bucket(status: Column) -> Column:
    return F.when(F.upper(F.trim(status)).isin("READY", "READY_WITH_WARNING", "PASS"), "ready").otherwise("review")


def preflight(lufs: Column, true_peak: Column, lra: Column, clipped: Column, target=-14.0, ceiling=-1.2, min_target=-16.0, budget=1.5, stressed_budget=0.8, min_lra=3.5, floor=-18.0, margin=0.05) -> Column:
    """Struct of the track's loudness target and compression, with its reasons in order."""
    lufs, true_peak, lra = finite_or(lufs, target), finite_or(true_peak, ceiling), finite_or(lra, min_lra)
    stressed = (clipped > 0) | (true_peak >= 0)
    projected = true_peak + (target - lufs)
    reduction = F.greatest(F.lit(0.0), projected - ceiling)
    allowed = F.when(stressed, F.lit(stressed_budget)).otherwise(F.lit(budget))
    adaptive = F.when(reduction > allowed, F.greatest(F.lit(min_target), target - (reduction - allowed))).otherwise(F.lit(target))
    dynamic = lra - min_lra
    mode = F.when(dynamic <= 0.5, "TRANSPARENT").when(dynamic <= 1.0, "REDUCED").otherwise("PROFILE")
    scale = F.when(dynamic <= 0.5, 0.0).when(dynamic <= 1.0, 0.35).otherwise(1.0)
    gain_only = (mode == "TRANSPARENT") | stressed
    safe = F.least(adaptive, lufs + (ceiling - margin - true_peak))
    review = stressed & (safe < floor - 1e-9)
    effective = F.when(~gain_only, adaptive).when(stressed, F.greatest(F.lit(floor), safe)).otherwise(safe)
    reasons = texts(
        (stressed, "source peak pressure"), ((reduction > allowed) & (adaptive < target - 0.01), "projected peak reduction budget"), (mode == "TRANSPARENT", "low source LRA"),
        (mode == "REDUCED", "narrow source dynamics"), (stressed & (effective < adaptive - 0.01), "gain-only peak safety"), (review, "safety floor requires review"),
    )
    return F.struct(
        half_even(adaptive).alias("adaptive"), half_even(projected).alias("projected_true_peak"), half_even(reduction).alias("reduction"), mode.alias("mode"), scale.alias("scale"), half_even(dynamic).alias("margin"),
        stressed.alias("stressed"), half_even(effective).alias("effective"), gain_only.alias("gain_only"), review.alias("review"), F.array_distinct(reasons).alias("reasons"),
    )


def gain_only(lufs: Column, true_peak: Column, target=-14.0, ceiling=-1.2, margin=0.05) -> Column:
    """The wanted gain, at most what the peak allows."""
    return F.least(target - lufs, ceiling - margin - true_peak)


def retry_policy(mode: Column, rerenders: Column, passes: Column) -> Column:
    quality = F.upper(F.coalesce(mode, F.lit(""))) == "QUALITY+"
    resolved = F.greatest(F.lit(0), rerenders)
    pick = lambda yes, no: F.when(quality, yes).otherwise(no)
    return F.struct(resolved.alias("rerenders"), F.lit(0).alias("base"), pick(F.least(F.lit(2), resolved), F.lit(0)).alias("codec"), F.least(pick(F.lit(2), F.lit(1)), passes).alias("fullness"), F.lit(1).alias("normal_gates"), pick(F.lit(2), F.lit(1)).alias("fullness_gates"), pick(F.lit(3), F.lit(1)).alias("transparent_gates"))


def _of(table: dict[str, float], key: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key], F.lit(table["GENERAL"]))


def default_mode(genre: Column) -> Column:
    """RICH for the genres it suits, else NATURAL."""
    return F.when(F.upper(F.trim(F.coalesce(genre, F.lit("GENERAL")))).isin(RICH_GENRES), "RICH").otherwise("NATURAL")


def dynamics_stats(source_lra: Column, lra: Column, source_crest: Column, crest: Column, max_reduction: float | None = 0.60, min_lra=3.5, max_crest_loss=0.75) -> Column:
    """Struct(lra_reduction, crest_loss, risky); what can't be measured is 0, and nothing is risky without a limit."""
    less = lambda a, b: F.when(finite(a) & finite(b), a - b).otherwise(F.lit(0.0))
    lra_less, crest_less = less(source_lra, lra), less(source_crest, crest)
    risky = F.lit(False) if max_reduction is None else dynamics_risk(lra_less, lra, crest_less, max_reduction, min_lra, max_crest_loss)
    return F.struct(lra_less.alias("lra_reduction"), crest_less.alias("crest_loss"), risky.alias("risky"))


def dynamics_origin(base: Column, final: Column) -> Column:
    """Which render first made the dynamics risky, from two ``dynamics_stats``."""
    return F.when(base["risky"], "base").when(final["risky"], "fullness").otherwise("none")


def fullness(warmth: Column, body: Column, presence: Column, genre: Column, mode: Column, strength: Column, caps: tuple[Column, Column] | None = None, saturation_enabled: Column | None = None, scales: tuple[Column, Column] | None = None) -> Column:
    """Struct of gains and wet limits; warmth, body and presence are band levels in dB.

    ``caps`` are the profile's saturation and density limits, ``scales`` its
    factors of warmth and body; a profile that disables saturation has none.
    """
    genre = F.upper(F.trim(F.coalesce(genre, F.lit("GENERAL"))))
    strength = clamp(strength.cast("double"), 0, 100)
    off = (F.upper(F.coalesce(mode, F.lit(""))) != "RICH") | (strength <= 0)
    gap_w, gap_b = presence - warmth, presence - body
    known = lambda x: finite(x) & finite(presence)
    warm = F.when(known(warmth) & (gap_w > 2.5), clamp((gap_w - 2.5) * 0.20, 0.0, 0.8)).when(known(warmth) & (gap_w < -5.0), clamp((gap_w + 5.0) * 0.12, -0.5, 0.0)).otherwise(F.lit(0.0))
    full = F.when(known(body) & (gap_b > 3.0), clamp((gap_b - 3.0) * 0.16, 0.0, 0.5)).when(known(body) & (gap_b < -4.0), clamp((gap_b + 4.0) * 0.10, -0.5, 0.0)).otherwise(F.lit(0.0))
    wet, dense = _of(SATURATION_LIMITS, genre), _of(DENSITY_LIMITS, genre)
    if saturation_enabled is not None:
        wet = F.when(F.coalesce(saturation_enabled, F.lit(True)), wet).otherwise(F.lit(0.0))
    if caps:
        wet, dense = F.least(wet, caps[0]), F.least(dense, caps[1])
    if scales:
        warm, full = warm * scales[0], full * scales[1]
    share = strength / 100.0
    part = lambda x: F.when(off, F.lit(0.0)).otherwise(half_even(x * share))
    return F.struct(F.when(off, "NATURAL").otherwise("RICH").alias("mode"), F.when(off, F.lit(0)).otherwise(strength.cast("int")).alias("strength"), part(warm).alias("warmth"), part(full).alias("body"), part(wet).alias("saturation"), part(dense).alias("density"))


def retry_strength(reasons: Column) -> Column:
    """The first of these that the reasons speak of decides."""
    text = joined(reasons)
    return F.when(text.contains("codec"), 100).when(text.contains("lra") & text.contains("risk"), 60).when(text.contains("crest"), 50).when(text.contains("low-band stereo correlation"), 60).otherwise(50)


def reduction_factors(reasons: Column) -> tuple[Column, Column, Column]:
    """(warmth and body, saturation, density) factors; all that apply multiply."""
    text = joined(reasons)
    when = lambda c, k: F.when(c, F.lit(k)).otherwise(F.lit(1.0))
    clip, peak = text.contains("clipped") | text.contains("clipping"), text.contains("true peak")
    wet = when(clip, 0.5) * when(peak, 0.7)
    return when(text.contains("low-band stereo correlation"), 0.35), wet, wet * when(text.contains("lra") | text.contains("crest"), 0.65)


def peak_only(reasons: Column) -> Column:
    return (F.size(reasons) > 0) & F.forall(reasons, lambda x: F.lower(F.btrim(x, F.lit(" \t\n\r\x0b\x0c"))).startswith("true peak exceeded"))


def peak_trim(true_peak: Column, ceiling=-1.2, margin=0.05, most=0.50) -> Column:
    """Negative trim in dB of what is over the ceiling, and the margin; 0 for a peak at or under the ceiling, and where the trim would be too much."""
    over = true_peak - ceiling
    return F.when(finite(over) & (over > 0) & (over + margin <= most), half_even(-(over + margin))).otherwise(F.lit(0.0))


def codec_step(measured: Column, ceiling=-1.5, margin=0.10, least=0.05, most=1.50) -> Column:
    need = measured - (ceiling - margin)
    return F.when(~finite(measured) | (need <= 0), F.lit(0.0)).otherwise(F.least(F.lit(most), F.greatest(F.lit(least), need)))


def codec_loop(measured: Column, ceiling=-1.5, tolerance=0.05, passes=3, most_total=2.0) -> Column:
    """Attenuation until the peak is safe, at most ``passes`` times: struct(total, passes, safe)."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("passes"))
    peak = lambda s: measured - s["total"]
    safe = lambda s: peak(s) <= ceiling + tolerance
    step = lambda s: F.least(codec_step(peak(s), ceiling), most_total - s["total"])
    stop = lambda s: safe(s) | (s["total"] >= most_total - 1e-9) | (step(s) <= 1e-9)
    end = F.aggregate(F.array_repeat(F.lit(0), passes), start, lambda s, _: F.when(stop(s), s).otherwise(F.struct((s["total"] + step(s)).alias("total"), (s["passes"] + 1).alias("passes"))))
    return F.struct(end["total"].alias("total"), end["passes"].alias("passes"), safe(end).alias("safe"))


def noise_decision(intro_rms: Column, quiet: Column, high: Column, very_high: Column, flatness: Column, clicks: Column, hum: Column, middle_high: Column, middle_flatness: Column, body_very_high: Column) -> Column:
    """Struct(found, score, decision) of a track's segments: those of the intro, of the middle, and the larger very high share of middle and tail."""
    strength = F.greatest(F.lit(0.0), (high - 0.055) * 180) + F.greatest(F.lit(0.0), (flatness - 0.08) * 45)
    hiss = (intro_rms < -21) & (quiet > 0.08) & (high > 0.06) & (flatness > 0.07) & (strength >= 8)
    static = hiss & (middle_high > 0.09) & (middle_flatness > 0.06)
    click = (clicks >= 0.8) & (intro_rms < -18)
    humming = (intro_rms < -16) & (hum >= 18)
    artifact = (very_high > 0.18) & (flatness > 0.12) & (body_very_high > 0.12)
    part = lambda c, x: F.when(c, x).otherwise(F.lit(0.0))
    score = clamp(part(hiss, F.least(F.lit(42.0), strength)) + part(static, F.lit(8.0)) + part(click, F.least(F.lit(32.0), 8 + 4 * clicks)) + part(humming, F.least(F.lit(35.0), 0.9 * hum)) + part(artifact, F.lit(26.0)), 0, 100)
    found = texts((hiss, "HISS"), (static, "STATIC"), (click, "CLICK_CRACKLE"), (humming, "HUM"), (artifact, "HIGH_FREQ_ARTIFACT"))
    return F.struct(found.alias("found"), score.alias("score"), F.when(artifact, "NEEDS_REVIEW").when(score >= 52, "MEDIUM_REPAIR").when(score >= 12, "LIGHT_REPAIR").otherwise("CLEAN").alias("decision"))


def integrity_issues(seconds_delta: Column, channels_delta: Column, new_clips: Column, peak_after: Column, rms_change_db: Column, high_before: Column, high_after: Column) -> Column:
    """What a repair must not do; ``peak_after`` in dBFS is the repaired peak itself, the high shares are taken in dB."""
    return texts(
        (F.abs(seconds_delta) > 0.01, "duration changed"), (channels_delta != 0, "channel count changed"), ((new_clips > 0) | (peak_after > 0.01), "new clipping"),
        (F.abs(rms_change_db) > 4.5, "RMS change exceeds 4.5 dB"), (db_floored(high_after) - db_floored(high_before) < -2.5, "high-frequency loss exceeds 2.5 dB"),
    )


def adaptive_factor(lra: Column) -> Column:
    return F.when(lra >= 16, 1.15).when(lra >= 12, 1.08).when(lra <= 3, 0.65).when(lra <= 5, 0.78).otherwise(1.0)


def performance_level(seconds: Column) -> Column:
    return F.when(seconds > 240.0, "error").when(seconds > 120.0, "warning").otherwise("")


def all_valid(*metrics: Column) -> Column:
    out = F.lit(True)
    for m in metrics:
        out = out & valid_metric(m)
    return out
