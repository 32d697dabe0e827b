"""Keys, settings and profiles: normalisation, assembly with overrides, validation, targets at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import clamp, half_even

#: Numeric settings that a profile must have, and the bit depths it may name.
REQUIRED = [
    "workingSampleRateHz", "outputBitDepth", "targetLufsI", "truePeakCeilingDbtp", "maxAutomaticEqDb",
    "maxBroadbandGainReductionDb", "maxLraReductionLu", "maxStereoWidthChangePercent",
]
BIT_DEPTHS = [16, 24, 32]


def known_key(key: Column, known: list[str], default: str, otherwise: str | None = None) -> Column:
    """Trimmed and upper-cased; ``default`` for nulls and empty keys, ``otherwise`` (the default, unless given) for unknown ones."""
    clean = F.upper(F.trim(F.coalesce(F.nullif(key, F.lit("")), F.lit(default))))
    return F.when(clean.isin(known), clean).otherwise(otherwise or default)


def composite_key(channel: Column, genre: Column) -> Column:
    return F.concat(F.lit("CG_"), channel, F.lit("__"), genre)


def scaled_compressor(comp: Column, scale: Column) -> Column:
    """Array of threshold, ratio, attack, release, make-up with ratio and make-up drawn towards 1 by ``scale`` (0 to 1)."""
    k = clamp(scale.cast("double"), 0.0, 1.0)
    at = lambda i: F.get(comp, F.lit(i)).cast("double")
    towards = lambda x: half_even(1.0 + (x - 1.0) * k)
    return F.array(at(0), towards(at(1)), at(2), at(3), towards(at(4)))


def pre_chain(filters: Column, comp: Column, factor: Column) -> Column:
    """The filter string before loudness: the equaliser's filters, then the compressor with its ratio drawn towards 1 (factor 0.30 to 1.08)."""
    at = lambda i: F.get(comp, F.lit(i)).cast("string")
    ratio = 1.0 + (F.get(comp, F.lit(1)) - 1.0) * clamp(factor, 0.30, 1.08)
    text = F.format_string("acompressor=threshold=%s:ratio=%.3f:attack=%s:release=%s:makeup=%s", at(0), ratio, at(2), at(3), at(4))
    return F.array_join(F.concat(filters, F.array(text)), ",")


def limiter(ceiling_db: Column) -> Column:
    return F.format_string("alimiter=limit=%.6f:attack=5:release=50:level=false:latency=true", F.pow(F.lit(10.0), ceiling_db / 20.0))


def equaliser_chain(corrections: Column) -> Column:
    """The filter string of an array of struct(center_hz, gain_db); empty for none."""
    return F.array_join(F.transform(corrections, lambda x: F.format_string("equalizer=f=%.1f:t=q:w=1.0:g=%.2f", x["center_hz"], x["gain_db"])), ",")


def setting(chain: list[Column], key: str, default: float | None = None) -> Column:
    """The first map of ``chain`` that has ``key`` decides."""
    return F.coalesce(*(F.try_element_at(m, F.lit(key)) for m in chain), F.lit(default).cast("double"))


def gate_settings(profile: Column, gate: Column, overrides: Column, genre: Column) -> Column:
    """Struct of what the gate is run with: a genre's own LRA limit goes before the profile's, which goes before 0.8."""
    limit = F.coalesce(F.try_element_at(overrides, genre), setting([profile], "maxLraReductionLu", 0.8))
    return F.struct(
        setting([profile], "targetLufsI").alias("target_lufs"), setting([profile], "truePeakCeilingDbtp").alias("ceiling"), setting([gate], "lufsToleranceLu", 0.20).alias("lufs_tolerance"),
        setting([gate], "truePeakToleranceDb", 0.05).alias("peak_tolerance"), limit.alias("max_lra_reduction"), setting([gate], "minimumFinalLraLu", 3.5).alias("min_lra"),
    )


def runtime_target(configured: Column, adaptive: Column, effective: Column) -> Column:
    """The loudness target that holds: the effective one, else the adaptive one, else the configured one."""
    return F.coalesce(effective, adaptive, configured)


def profile_errors(profiles: DataFrame) -> DataFrame:
    """(name, error) of resolved ``profiles`` (name, key, value as text): the first rule that each breaks, null where it is sound.

    One grouping: missing settings come first (all named, in order), then those
    that are no numbers, then bounds.
    """
    have = F.map_from_entries(F.collect_list(F.when(F.col("key").isin(REQUIRED), F.struct("key", "value"))))
    own = profiles.select("name", "key", F.col("value").cast("string").alias("value")).dropDuplicates(["name", "key"]).groupBy("name").agg(have.alias("have"))
    text = lambda k: F.try_element_at("have", F.lit(k))
    number = lambda k: text(k).try_cast("double")
    missing = F.filter(F.array(*map(F.lit, REQUIRED)), lambda k: ~F.map_contains_key("have", k))
    rules = [(F.size(missing) > 0, F.concat(F.lit("Profile '"), "name", F.lit("' is missing fields: "), F.array_join(missing, ", ")))]
    rules += [(number(k).isNull(), F.format_string(f"Profile '%s' field '{k}' must be numeric.", "name")) for k in REQUIRED]
    rules += [(number("workingSampleRateHz") <= 0, F.lit("workingSampleRateHz must be positive."))]
    rules += [(~number("outputBitDepth").isin(BIT_DEPTHS), F.lit("outputBitDepth must be 16, 24, or 32."))]
    rules += [(number("truePeakCeilingDbtp") > 0, F.lit("truePeakCeilingDbtp must not be above 0 dBTP."))]
    rules += [(number("maxAutomaticEqDb") < 0, F.lit("maxAutomaticEqDb must be non-negative."))]
    return own.select("name", F.coalesce(*(F.when(bad, say) for bad, say in rules)).alias("error"))


def missing_names(have: Column, required: list[str]) -> Column:
    """Those of ``required`` that the array lacks, in order."""
    return F.array_except(F.array(*map(F.lit, required)), have)
