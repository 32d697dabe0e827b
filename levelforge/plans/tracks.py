"""Whole tracks: analyse, compare a source with its processed counterpart, and batch verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import db
from ..operators import arrays as A
from ..operators import rules as R
from ..operators.kernels import render_levels, spectral_metrics
from .frames import BASE, _peak, frames
from .registry import query


def analyze(tracks: DataFrame, tail_ms: float = 100.0) -> DataFrame:
    """All metrics of tracks (track_id, sample_rate, channels) in one pass over the samples: native ones from the arrays, whole-track ones in Arrow.

    The end is the last ``tail_ms`` of every channel. A track that can't be
    measured keeps its row, with the reason in error.
    """
    first = F.transform(F.get("channels", F.lit(0)), lambda v: v)
    second = F.coalesce(F.get("channels", F.lit(1)), first)
    flat = F.flatten("channels")
    envelope = F.zip_with(first, second, lambda a, b: F.greatest(F.abs(a), F.abs(b)))
    head, tail = A.edge_silence_ms(envelope, 1)
    n = F.greatest(F.lit(1), F.round(F.col("sample_rate") * tail_ms / 1000.0).cast("int"))
    end = F.flatten(F.transform("channels", lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - n + 1), n)))
    native = {
        "n_channels": F.size("channels"), "n_frames": F.size(first), "peak_db": db(A.peak(flat)), "rms_db": db(A.rms(flat)), "crest_db": A.crest_db(flat),
        "max_dc": F.array_max(F.transform("channels", lambda c: F.abs(A.mean(c)))), "clipped": A.clipped(flat), "correlation": A.stereo_correlation(first, second), "side_to_mid_db": A.side_to_mid_db(first, second),
        "leading_ms": head / F.col("sample_rate"), "trailing_ms": tail / F.col("sample_rate"), "end_rms_db": db(A.rms(end)), "last_db": db(F.array_max(F.transform("channels", lambda c: F.abs(F.element_at(c, -1))))),
    }
    return spectral_metrics(tracks.select("track_id", "sample_rate", "channels").withColumns(native), ["sample_rate", *native])


def compare(sources: DataFrame, processed: DataFrame, delays: DataFrame | None = None, target_lufs: float = -14.0, ceiling: float = -1.0, energetic_rms: float | None = None, max_lra_reduction: float | None = None, **limits) -> DataFrame:
    """(track_id, issues, warnings, notes, status, disposition) of the analysed pairs.

    ``delays`` are those of ``operators.alignment.delay_diagnostics``. A tail is
    cut hard where its end is over -50 dB and its last sample over -60 dB. The
    reduction of the LRA is an issue only with a limit, a warning only without.
    """
    s = sources.select("track_id", *(F.col(c).alias(f"s_{c}") for c in ("n_frames", "sample_rate", "lra", "crest_db", "trailing_ms")))
    p = processed.join(s, "track_id")
    if delays is not None:
        p = p.join(delays.select("track_id", "delay", "consistent", "confidence", "estimates", F.col("error").alias("delay_error")), "track_id", "left")
    c = F.col
    kind, note = F.lit("PASS"), F.lit("")
    if delays is not None:
        measured = c("delay"), c("consistent"), c("confidence")
        kind, note = F.when(c("delay").isNotNull(), R.delay_class(*measured)), F.when(c("delay").isNotNull(), R.delay_note(*measured, c("estimates")))
    seconds = lambda t: c(f"{t}n_frames") * 1000.0 / c(f"{t}sample_rate")
    p = p.withColumns({"delay_class": kind, "delay_note": note, "hard_cut": (c("end_rms_db") > -50) & (c("last_db") > -60), "delta_ms": seconds("") - seconds("s_"), "shorter_ms": c("s_trailing_ms") - c("trailing_ms")})
    p = p.withColumn("stats", R.dynamics_stats(c("s_lra"), c("lra"), c("s_crest_db"), c("crest_db"), max_lra_reduction))
    p = p.withColumn("energetic", c("end_rms_db") > energetic_rms if energetic_rms is not None else F.lit(False))
    p = p.withColumn("tail", R.tail_class(c("shorter_ms"), c("delta_ms"), c("hard_cut"), c("energetic"), c("last_db"), c("end_rms_db")))
    p = p.withColumn("tail_note", R.tail_note(c("shorter_ms"), c("tail")))
    valid = R.all_valid(c("lufs"), c("true_peak_db"), c("peak_db"), c("rms_db"))
    seen = {"rate": c("sample_rate"), "n_channels": c("n_channels"), "valid": valid, "lufs": c("lufs"), "true_peak": c("true_peak_db"), "clipped": c("clipped"), "dc": c("max_dc"), "correlation": c("correlation"), "low_correlation": c("low_band_correlation"), "delay": c("delay_class"), "delay_note": c("delay_note"), "duration_delta_ms": c("delta_ms"), "risk": c("stats.risky"), "lra_reduction": c("stats.lra_reduction"), "lra": c("lra"), "crest_loss": c("stats.crest_loss"), "hard_cut": c("hard_cut"), "energetic": c("energetic"), "end_rms": c("end_rms_db"), "last": c("last_db")}
    warned = {"source_rate": c("s_sample_rate"), "rate": c("sample_rate"), "delay": c("delay_class"), "delay_note": c("delay_note"), "lra_reduction": c("stats.lra_reduction"), "tail": c("tail"), "tail_note": c("tail_note")}
    if delays is not None:
        warned["delay_error"] = c("delay_error")
    issues = R.gate_issues(seen, target_lufs, ceiling, lra_reduction=max_lra_reduction, energetic_rms=energetic_rms, **limits)
    out = p.withColumns({"issues": issues, "warnings": R.gate_warnings(warned, max_lra_reduction), "notes": F.when(c("tail") == "INFO", c("tail_note")).otherwise("")})
    return out.select("track_id", "issues", "warnings", "notes", R.gate_status(c("issues"), c("warnings")).alias("status"), R.disposition(c("issues"), c("warnings"), F.lit(True)).alias("disposition"))


#: Frames that one task measures: each is half a second of samples there.
TASK_FRAMES = 256


def _tiled(spark, sf_dir) -> DataFrame:
    """Frames as tracks: both sides, looped to half a second at 48 kHz. Tasks by the number of frames, as bytes say nothing of the work."""
    f = frames(spark, sf_dir)
    tasks = max(spark.sparkContext.defaultParallelism, -(-f.count() // TASK_FRAMES))
    return f.select("vec_id", "l", "r").repartition(tasks, "vec_id").select(F.col("vec_id").cast("string").alias("track_id"), F.lit(48_000).alias("sample_rate"), F.array("l", "r").alias("channels"), F.lit(750).alias("loops"))


def _rendered(spark, sf_dir) -> DataFrame:
    return _tiled(spark, sf_dir).withColumns({"warmth": F.lit(0.4), "body": F.lit(0.2), "saturation": F.lit(3.0), "density": F.lit(2.0)})


@query()
def spectral_and_loudness(spark, sf_dir):
    names = ["lufs", "true_peak_db", "low_band_correlation", "high_ratio", "very_high_ratio", "flatness", "hum"]
    m = spectral_metrics(_tiled(spark, sf_dir), measures=[*names, "bands"])
    return m.select("track_id", *(F.round(c, 3).alias(c) for c in names), F.round(F.col("bands")["500-1000Hz"], 3).alias("mid_band_db"), "error")


@query()
def fullness_chain(spark, sf_dir):
    made = render_levels(_rendered(spark, sf_dir), loudness=False)
    return made.select("track_id", F.round(db(F.col("peak")), 3).alias("peak_db"), F.round(db(F.col("rms")), 3).alias("rms_db"))


@query(f"""{BASE}g AS (SELECT CAST(vec_id AS VARCHAR) AS track_id, greatest({_peak('l')}, {_peak('r')}) AS p FROM f)
SELECT track_id, 6.021::DOUBLE AS loudness_step, 6.021::DOUBLE AS peak_step, 0.0::DOUBLE AS flatness_step, 0.0::DOUBLE AS high_step, 0.0::DOUBLE AS hum_step, 6.021::DOUBLE AS band_step, TRUE AS over_sample_peak, round(p, 6) AS sample_peak FROM g""")
def spectral_invariants(spark, sf_dir):
    """What halving a track must do to its measures: levels fall by 6.021 dB, shares and shapes stay; its true peak is no less than its peak."""
    t = _tiled(spark, sf_dir)
    half = t.withColumn("channels", F.transform("channels", lambda x: F.transform(x, lambda v: v * 0.5)))
    names = ["lufs", "true_peak_db", "flatness", "high_ratio", "hum"]
    peak = F.array_max(F.transform("channels", A.peak))
    a = spectral_metrics(t.withColumn("sample_peak", peak), ["sample_peak"], [*names, "bands"])
    b = spectral_metrics(half, measures=[*names, "bands"]).select(F.col("track_id").alias("half_id"), *(F.col(n).alias(f"half_{n}") for n in names), F.col("bands").alias("half_bands"))
    step = {n: F.round(F.col(n) - F.col(f"half_{n}"), 3) + 0.0 for n in names}
    band = F.round(F.col("bands")["500-1000Hz"] - F.col("half_bands")["500-1000Hz"], 3)
    over = F.col("true_peak_db") >= db(F.col("sample_peak")) - 1e-9
    return a.join(b, F.col("track_id") == F.col("half_id")).select("track_id", step["lufs"].alias("loudness_step"), step["true_peak_db"].alias("peak_step"), step["flatness"].alias("flatness_step"), step["high_ratio"].alias("high_step"), step["hum"].alias("hum_step"), band.alias("band_step"), over.alias("over_sample_peak"), F.round("sample_peak", 6).alias("sample_peak"))


@query(BASE + "SELECT CAST(vec_id AS VARCHAR) AS track_id, 2 AS n_channels, 24000 AS n_frames, TRUE AS peak_held, TRUE AS loudness_held, TRUE AS finite FROM f")
def fullness_invariants(spark, sf_dir):
    """What the fullness chain must keep: shape, a peak of at most 0.998, and the loudness, unless the peak held it down."""
    made = render_levels(_rendered(spark, sf_dir))
    held = (F.abs(F.col("lufs") - F.col("lufs_before")) < 0.01) | (F.col("peak") > 0.9979)
    return made.select("track_id", "n_channels", "n_frames", (F.col("peak") <= 0.998 + 1e-9).alias("peak_held"), held.alias("loudness_held"), F.col("error").isNull().alias("finite"))
