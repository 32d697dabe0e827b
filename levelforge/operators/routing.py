"""Noise-repair routing, the strength ladder, and the texts of a batch, as columns and groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import clamp, texts

# Repair modes, decibels of broadband reduction and hum harmonics by strength, strengths tried, filter settings.
MODES = ["OFF", "AUTO", "LIGHT", "MEDIUM"]
REDUCTION_DB = {"LIGHT": 3.5, "MEDIUM": 6.0}
HARMONICS = {"LIGHT": 2, "MEDIUM": 3}
STRENGTHS = [100, 75, 50, 25, 0]
CLICK_FILTER = "adeclick=window=55:overlap=75:threshold=2.5:burst=2:method=a"
HISS_FILTER = "afftdn=nr=%.1f:nf=-50:tn=1:gs=5"
HUM_FILTER = "bandreject=f=%.1f:width_type=h:width=3"
#: What a count above zero says was done, in report order.
STEPS = [
    ("gain_only_render_count", "gain-only mastering"), ("transparent_render_count", "transparent mastering"), ("dc_correction_count", "DC offset correction"), ("fullness_render_count", "Fullness adjustment"),
    ("peak_trim_count", "Fullness peak trim"), ("tail_fix_mode", "Tail repair"), ("codec_check_count", "Codec safety check"), ("codec_ceiling_rerender_count", "Codec ceiling rerender"),
]
NO_STEPS = "basic mastering and quality validation"


def repair_mode(mode: Column) -> Column:
    """Upper-cased; null and unknown modes are AUTO."""
    known = F.upper(mode)
    return F.when(known.isin(MODES), known).otherwise("AUTO")


def intro_seconds(x: Column) -> Column:
    """5 to 30 seconds; null and zero are 15."""
    return clamp(F.coalesce(F.nullif(x.cast("double"), F.lit(0.0)), F.lit(15.0)), 5.0, 30.0)


def merge_settings(old: Column, new: Column) -> Column:
    """Maps: keys of ``new`` win, other keys of ``old`` stay; a null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def repair_chain(found: Column, strength: Column, hum_50: Column, hum_60: Column, filters: Column) -> Column:
    """Struct(chain, warnings) for the found noise types; a step whose filter is not among ``filters`` becomes a warning; null found and null filters are empty."""
    empty = F.array().cast("array<string>")
    found, filters = F.coalesce(found, empty), F.coalesce(filters, empty)
    light = strength == "LIGHT"
    pick = lambda values: F.when(light, values["LIGHT"]).otherwise(values["MEDIUM"])
    has = lambda name: F.array_contains(filters, name)
    click, hum = F.array_contains(found, "CLICK_CRACKLE"), F.array_contains(found, "HUM")
    hiss = F.array_contains(found, "HISS") | F.array_contains(found, "STATIC")
    base = F.when(hum_60 >= hum_50, 60.0).otherwise(50.0)
    hums = F.transform(F.sequence(F.lit(1), pick(HARMONICS)), lambda n: F.format_string(HUM_FILTER, base * n))
    part = lambda c, x: F.when(c, x).otherwise(empty)
    chain = F.concat(part(click & has("adeclick"), F.array(F.lit(CLICK_FILTER))), part(hiss & has("afftdn"), F.array(F.format_string(HISS_FILTER, pick(REDUCTION_DB)))), part(hum & has("bandreject"), hums))
    warnings = texts((click & ~has("adeclick"), "adeclick unavailable; click repair skipped"), (hiss & ~has("afftdn"), "afftdn unavailable; broadband repair skipped"), (hum & ~has("bandreject"), "bandreject unavailable; hum repair skipped"))
    return F.struct(chain.alias("chain"), warnings.alias("warnings"))


def route_repair(mode: Column, decision: Column, found: Column, steps: Column, has_tool: Column, medium_guard: Column, light_guard: Column) -> Column:
    """Struct(applied, result) of a track.

    ``steps`` is the number of filters of its chain; the guards are the integrity
    issues measured after a repair of that strength. A medium repair with issues
    is tried again as a light one. A null decision is for review, null found is
    nothing, null steps none, a null has_tool no; a null guard counts as issues.
    """
    mode, decision = repair_mode(mode), F.coalesce(decision, F.lit("NEEDS_REVIEW"))
    found, steps, has_tool = F.coalesce(found, F.array().cast("array<string>")), F.coalesce(steps, F.lit(0)), F.coalesce(has_tool, F.lit(False))
    bad = lambda guard: F.coalesce(F.size(guard) > 0, F.lit(True))
    wanted = F.when(mode.isin("LIGHT", "MEDIUM"), mode).otherwise(F.regexp_replace(decision, "_REPAIR$", ""))
    applied = F.when((wanted == "MEDIUM") & bad(medium_guard), "LIGHT").otherwise(wanted)
    unsafe = bad(F.when(applied == "MEDIUM", medium_guard).otherwise(light_guard))
    off = lambda result: F.struct(F.lit("OFF").alias("applied"), result.alias("result"))
    review = F.lit("NEEDS_REVIEW")
    return (
        F.when(mode == "OFF", off(F.lit("CLEAN"))).when((mode == "AUTO") & decision.isin("CLEAN", "NEEDS_REVIEW"), off(decision)).when(~has_tool, off(review))
        .when(steps == 0, off(F.when(F.size(found) > 0, review).otherwise("CLEAN"))).when(unsafe, off(review)).otherwise(F.struct(applied.alias("applied"), F.concat(F.lit("REPAIRED_"), applied).alias("result")))
    )


def strength_ladder(tried: DataFrame, key: str) -> DataFrame:
    """(key, strength, retries, reasons): the strongest candidate without issues, off (0) where none is.

    ``tried`` has key, strength and issues, a row a candidate. reasons are those
    of the weakest candidate where all failed, else empty. A null issue list is
    a failure. One grouping with partial aggregates.
    """
    ok = F.col("strength") > 0
    good = ok & F.coalesce(F.size("issues") == 0, F.lit(False))
    found = tried.groupBy(key).agg(F.coalesce(F.max(F.when(good, F.col("strength"))), F.lit(0)).alias("strength"), F.collect_set(F.when(ok, F.col("strength"))).alias("all"), F.min_by("issues", F.when(ok, F.col("strength"))).alias("last"))
    retries = F.size(F.filter("all", lambda s: s > F.col("strength")))
    return found.select(key, "strength", retries.alias("retries"), F.when(F.col("strength") == 0, F.array_join("last", " / ")).otherwise("").alias("reasons"))


def attempted_steps(df: DataFrame) -> Column:
    """Array of the steps that really ran, from the columns of ``STEPS`` that ``df`` has."""
    ran = []
    for name, text in STEPS:
        if name in df.columns:
            mode = F.trim(F.col(name).cast("string"))
            ran.append((~mode.isin("", "none") if name == "tail_fix_mode" else F.expr(f"try_cast(`{name}` AS double)") >= 1, text))
    steps = texts(*ran) if ran else F.array().cast("array<string>")
    return F.when(F.size(steps) > 0, steps).otherwise(F.array(F.lit(NO_STEPS)))


def unresolved_text(track: Column, profile: Column, steps: Column, issues: Column) -> Column:
    """The text for a track that automatic steps could not mend."""
    bullets = lambda x: F.array_join(F.transform(x, lambda t: F.concat(F.lit("- "), t)), "\n")
    return F.concat_ws("\n", F.concat(F.lit("Unresolved: "), track), F.concat(F.lit("Profile: "), profile), F.lit("Steps done:"), bullets(steps), F.lit("Issues left:"), bullets(issues))


def batch_verdict(rows: DataFrame, batch: str) -> DataFrame:
    """(batch, ready, text) from batch, status, fixed and codec_safe of each track: one grouping, a row a batch."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    passed = F.col("status").isin("READY", "READY_WITH_WARNING", "PASS")
    n = rows.groupBy(batch).agg(F.count("*").alias("total"), count(passed).alias("passed"), count(F.col("fixed")).alias("fixed"), count(F.col("codec_safe")).alias("safe"))
    ready = F.col("passed") == F.col("total")
    text = F.format_string("%s\nTracks: %d\nPASS: %d\nFixed: %d\nReview: %d\nCodec safe: %d/%d", F.when(ready, "Ready for release").otherwise("Some tracks on hold"), "total", "passed", "fixed", F.col("total") - F.col("passed"), "safe", "total")
    return n.select(batch, ready.alias("ready"), text.alias("text"))


def bounded_loop(start: Column, ok, step, retries: int) -> Column:
    """Struct(value, retries, ok): ``step`` is taken while ``ok`` (of the value) does not hold, at most ``retries`` times and while it changes the value by over 0.01.

    A null test does not hold; null values stay null.
    """
    good = lambda v: F.coalesce(ok(v), F.lit(False))
    first = F.struct(start.cast("double").alias("value"), F.lit(0).alias("retries"))

    def again(s, _):
        after = step(s["value"])
        stay = good(s["value"]) | ~F.coalesce(F.abs(after - s["value"]) > 0.01, F.lit(False))
        return F.when(stay, s).otherwise(F.struct(after.alias("value"), (s["retries"] + 1).alias("retries")))

    end = F.aggregate(F.array_repeat(F.lit(0), retries), first, again)
    return F.struct(end["value"].alias("value"), end["retries"].alias("retries"), good(end["value"]).alias("ok"))


def compression_ladder(start: Column, safe, retries: int = 2, keep: float = 0.65, floor: float = 0.30) -> Column:
    """Struct(factor, retries, mode): the compression factor is reduced until dynamics are ``safe`` at it; beyond the last retry compression is bypassed."""
    end = bounded_loop(start, safe, lambda f: F.greatest(F.lit(floor), f * keep), retries)
    return F.struct(end["value"].alias("factor"), end["retries"].alias("retries"), F.when(end["ok"], "compressed").otherwise("transparent").alias("mode"))


def ceiling_ladder(ceiling: Column, safe, retries: int = 2, step: float = 0.20) -> Column:
    """Struct(value, retries, ok): the true-peak ceiling is lowered until the codec peak is ``safe`` at it."""
    return bounded_loop(ceiling, safe, lambda c: c - step, retries)
