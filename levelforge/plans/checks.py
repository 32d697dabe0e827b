"""Gate texts, alignment, settings, refreshed reports and the queue's actions over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.levels import fixed, metric_text, to_float, to_int
from ..operators import alignment, reports, settings
from ..operators import rules as R
from ..streaming import queue
from .frames import BASE, frames
from .registry import query, table

c = F.col


def pick(x, *values):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(x, F.lit(len(values))) + 1).cast("int"))


@query(BASE + """w AS (SELECT vec_id, start, list_slice(l, start + 1, start + 16) AS a, list_slice(r, start + 1, start + 16) AS b FROM f, (SELECT unnest([0, 16]) AS start)),
n AS (SELECT vec_id, start, list_transform(a, lambda v: v - list_sum(a) / 16) AS a, list_transform(b, lambda v: v - list_sum(b) / 16) AS b FROM w),
k AS (SELECT *, sqrt(list_sum(list_transform(a, lambda v: v * v))) * sqrt(list_sum(list_transform(b, lambda v: v * v))) AS norm FROM n),
s AS (SELECT vec_id, start, lag, list_sum(list_transform(generate_series(1, 16), lambda i: CASE WHEN i + lag BETWEEN 1 AND 16 THEN a[i] * b[i + lag] ELSE 0 END)) / norm AS peak FROM k, (SELECT unnest(generate_series(-5, 5)) AS lag)),
e AS (SELECT vec_id, start, lag, peak FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, start ORDER BY round(peak, 12) DESC, lag) AS place FROM s) WHERE place = 1),
m AS (SELECT vec_id, list(lag ORDER BY start) AS lags, list(peak ORDER BY start) AS peaks, CAST(round_even(avg(lag), 0) AS INTEGER) AS delay FROM e GROUP BY vec_id),
i AS (SELECT *, list_filter(lags, lambda x: abs(x - delay) <= 2) AS inner_lags, list_filter(list_transform(peaks, lambda p, i: CASE WHEN abs(lags[i] - delay) <= 2 THEN greatest(0, least(1, p)) END), lambda p: p IS NOT NULL) AS good FROM m)
SELECT vec_id, delay, array_to_string(lags, ',') AS estimates, round(0.7 * len(inner_lags) / 2.0::DOUBLE + 0.3 * coalesce(list_aggregate(good, 'median'), 0), 5) AS confidence,
len(inner_lags) = 2 AND list_max(inner_lags) - list_min(inner_lags) <= 4 AS consistent, CAST(CASE WHEN len(inner_lags) > 1 THEN list_max(inner_lags) - list_min(inner_lags) ELSE 0 END AS INTEGER) AS spread FROM i""")
def delay_diagnostics(spark, sf_dir):
    """The right side against the left: two windows of 16 samples, lags of at most 5."""
    f = frames(spark, sf_dir).select(c("vec_id").alias("track_id"), F.lit(48_000).alias("sample_rate"), c("l").alias("reference"), c("r").alias("processed"))
    d = alignment.delay_diagnostics(f, 5 / 48, 3, 16 / 48_000, 2)
    return d.select(c("track_id").alias("vec_id"), "delay", F.array_join(c("estimates").cast("array<string>"), ",").alias("estimates"), F.round("confidence", 5).alias("confidence"), "consistent", "spread")


_ALIGN = """WITH d AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 6000 - 700 AS INTEGER) AS before, CAST(l_suppkey % 90 - 30 AS INTEGER) AS after, l_linenumber % 3 > 0 AS consistent, 0.6 + l_discount * 4 AS confidence FROM lineitem),
k AS (SELECT *, CASE WHEN abs(before) <= 1 THEN 'PASS' WHEN abs(before) <= 8 THEN 'INFO' WHEN abs(before) <= 47 THEN 'WARN' WHEN NOT consistent OR confidence < 0.7 THEN 'UNCERTAIN' ELSE 'FAIL' END AS kind,
CASE WHEN abs(after) <= 1 THEN 'PASS' WHEN abs(after) <= 8 THEN 'INFO' WHEN abs(after) <= 47 THEN 'WARN' WHEN NOT consistent OR confidence < 0.7 THEN 'UNCERTAIN' ELSE 'FAIL' END AS after_kind FROM d)
"""


@query(_ALIGN + """SELECT l_orderkey, l_linenumber, kind, kind = 'FAIL' AND abs(before) BETWEEN 48 AND 4800 AND consistent AND confidence >= 0.7 AS tried, abs(after) < abs(before) AND after_kind <> 'FAIL' AS helped,
printf('automatic sample alignment applied: %+d', before) || ' → ' || printf('%+d samples', after) AS note FROM k""")
def auto_align(spark, sf_dir):
    """Which confirmed delays are shifted, and whether the shift helped."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_partkey") % 6000 - 700).cast("int").alias("before"), (c("l_suppkey") % 90 - 30).cast("int").alias("after"), (c("l_linenumber") % 3 > 0).alias("consistent"), (0.6 + c("l_discount") * 4).alias("confidence"))
    sure = c("consistent"), c("confidence")
    d = d.withColumns({"kind": R.delay_class(c("before"), *sure), "after_kind": R.delay_class(c("after"), *sure)})
    return d.select("l_orderkey", "l_linenumber", "kind", alignment.should_align(c("kind"), c("before"), *sure).alias("tried"), alignment.aligned(c("before"), c("after"), c("after_kind")).alias("helped"), alignment.alignment_note(c("before"), c("after")).alias("note"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 44100 ELSE 48000 END AS rate, CASE WHEN l_linenumber = 5 THEN 44100 ELSE 48000 END AS source_rate, l_partkey % 2 + 1 AS channels, l_discount > 0 AS ok, l_discount * 20 - 0.9 AS corr, l_tax * 15 AS low, l_quantity - 20 AS delta, l_suppkey % 7 = 0 AS cut,
l_suppkey % 5 = 0 AS loud, -round(l_quantity, 3) AS end_rms, l_tax * 50 AS less, CASE WHEN l_linenumber = 6 THEN 'too short' END AS why, (l_extendedprice % 130)::DOUBLE AS shorter, -l_quantity - 40 AS last FROM lineitem),
t AS (SELECT *, CASE WHEN delta > 0 OR shorter <= 20 THEN 'PASS' WHEN NOT cut AND NOT loud AND last <= -60 AND shorter <= 50 THEN 'INFO' WHEN NOT cut AND NOT loud AND last <= -60 AND end_rms <= -80 AND shorter <= 100 THEN 'INFO' ELSE 'WARN' END AS tail FROM m)
SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN rate <> 48000 THEN printf('unexpected output sample rate: %d Hz (expected 48000 Hz)', rate) END, CASE WHEN NOT ok THEN 'processed metrics contain invalid numeric values' END,
CASE WHEN channels >= 2 AND corr < -0.05 THEN printf('stereo correlation too low: %.3f', corr) END, CASE WHEN channels >= 2 AND low < 0.7 THEN printf('low-band stereo correlation too low: %.3f below 110 Hz', low) END,
CASE WHEN delta < -1 THEN printf('unexpected duration loss: %.2f ms', delta) END, CASE WHEN cut THEN printf('TAIL HARD CUT: end RMS %.1f dBFS / last sample %.1f dBFS', end_rms, last) END,
CASE WHEN loud THEN printf('ENERGETIC TAIL END: end RMS %.1f dBFS > -35.0 dBFS', end_rms) END], lambda x: x IS NOT NULL), ' / ') AS issues,
array_to_string(list_filter([CASE WHEN source_rate <> rate THEN printf('source %d Hz was resampled to %d Hz for delay measurement', source_rate, rate) END, 'delay measurement unavailable: ' || why, CASE WHEN less > 1.5 THEN printf('LRA reduced by %.2f LU', less) END,
CASE WHEN tail = 'WARN' THEN printf('output tail is shorter than source tail by %.1f ms; listen for reverb cutoff', shorter) END], lambda x: x IS NOT NULL), ' / ') AS warnings,
CASE WHEN tail = 'INFO' THEN printf('minor trailing-silence difference %.1f ms; final tail is silent and safe', shorter) ELSE '' END AS note FROM t""")
def gate_battery(spark, sf_dir):
    """The rules of the gate that ``quality_gate`` has no metrics for, with texts and values."""
    double = lambda x: x.cast("double")
    k, part, q = c("l_linenumber"), c("l_partkey"), double(c("l_quantity"))
    m = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(k == 3, 44_100).otherwise(48_000).alias("rate"), F.when(k == 5, 44_100).otherwise(48_000).alias("source_rate"), (part % 2 + 1).alias("n_channels"), F.when(c("l_discount") > 0, 0.0).otherwise(float("nan")).alias("x"),
        (c("l_discount") * 20 - 0.9).alias("correlation"), (c("l_tax") * 15).alias("low_correlation"), (q - 20).alias("duration_delta_ms"), (c("l_suppkey") % 7 == 0).alias("hard_cut"), (c("l_suppkey") % 5 == 0).alias("energetic"),
        (-F.round(q, 3)).alias("end_rms"), (c("l_tax") * 50).alias("lra_reduction"), F.when(k == 6, "too short").alias("delay_error"), double(c("l_extendedprice") % 130).alias("shorter"), (-q - 40).alias("last"),
    )
    m = m.withColumn("valid", R.all_valid(c("x"), c("end_rms")))
    m = m.withColumn("tail", R.tail_class(c("shorter"), c("duration_delta_ms"), c("hard_cut"), c("energetic"), c("last"), c("end_rms")))
    note = R.tail_note(c("shorter"), c("tail"))
    seen = {n: c(n) for n in m.columns if n not in ("tail", "lra_reduction", "delay_error")}
    issues = R.gate_issues(seen, energetic_rms=-35.0)
    warnings = R.gate_warnings({n: c(n) for n in ("source_rate", "rate", "delay_error", "lra_reduction", "tail")} | {"tail_note": note})
    return m.select("l_orderkey", "l_linenumber", F.array_join(issues, " / ").alias("issues"), F.array_join(warnings, " / ").alias("warnings"), F.when(c("tail") == "INFO", note).otherwise("").alias("note"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 7 - 3000 AS x, (l_partkey % 1000) / 8 AS tie, l_discount * 4 - 14.2 AS final FROM lineitem)
SELECT l_orderkey, l_linenumber, printf('%.2f', x) AS two, printf('%.3f', x / 1000) AS three, printf('%.1f', x) AS one, printf('%+.2f', final + 14) AS off, CASE WHEN abs(final + 14) <= 0.2 + 1e-9 THEN 'true' ELSE 'false' END AS within,
CASE WHEN l_linenumber = 1 THEN '-inf' ELSE printf('%.2f', x) END AS metric, CASE WHEN l_linenumber = 2 THEN -1.5 ELSE tie END::DOUBLE AS parsed, CASE WHEN l_linenumber = 2 THEN 7 ELSE l_linenumber END AS whole FROM m""")
def metric_texts(spark, sf_dir):
    """Numbers as printf writes them, the loudness flag, and texts read back with defaults."""
    k = c("l_linenumber")
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_extendedprice") / 7 - 3000).alias("x"), (c("l_partkey") % 1000 / 8).alias("tie"), (c("l_discount") * 4 - 14.2).alias("final"))
    off, within = reports.loudness_flags(c("final"), F.lit(-14.0))
    parsed = to_float(F.when(k == 2, "n/a").otherwise(c("tie").cast("string")), -1.5)
    whole = to_int(F.when(k == 2, "2.5").otherwise(F.format_string(" %d ", k)), 7)
    metric = metric_text(F.when(k == 1, float("inf")).otherwise(c("x")))
    return m.select("l_orderkey", "l_linenumber", fixed(c("x"), 2).alias("two"), fixed(c("x") / 1000, 3).alias("three"), fixed(c("x"), 1).alias("one"), off.alias("off"), within.alias("within"), metric.alias("metric"), parsed.alias("parsed"), whole.alias("whole"))


@query("""WITH m AS (SELECT o_orderkey, o_totalprice % 9 AS s, o_totalprice % 7 AS b, o_totalprice % 5 AS f, o_custkey % 3 / 2.0 AS sc, o_custkey % 5 / 2.0 AS bc, o_custkey % 7 / 3.0 AS fc, (['OLD POP', ' soul', 'JAZZ', 'k-pop', NULL])[o_orderkey % 5 + 1] AS genre FROM orders),
r AS (SELECT *, s - b > 0.65 AND (b < 3.5 OR 2 - bc > 0.75) AS base_risk, s - f > 0.65 AND (f < 3.5 OR 2 - fc > 0.75) AS final_risk FROM m)
SELECT o_orderkey, CASE WHEN base_risk THEN 'base' WHEN final_risk THEN 'fullness' ELSE 'none' END AS origin, round((s - f)::DOUBLE, 4) AS lra_reduction, round((2 - fc)::DOUBLE, 4) AS crest_loss, CASE WHEN upper(trim(genre)) IN ('OLD POP', 'SOUL', 'K-POP') THEN 'RICH' ELSE 'NATURAL' END AS mode FROM r""")
def dynamics_origin(spark, sf_dir):
    o, total, cust = table(spark, sf_dir, "orders"), c("o_totalprice").cast("double"), c("o_custkey")
    stats = lambda lra, crest: R.dynamics_stats(total % 9, lra, F.lit(2.0), crest)
    genre = F.when(c("o_orderkey") % 5 < 4, pick(c("o_orderkey") % 5, "OLD POP", " soul", "JAZZ", "k-pop"))
    m = o.select("o_orderkey", stats(total % 7, cust % 5 / 2.0).alias("base"), stats(total % 5, cust % 7 / 3.0).alias("final"), R.default_mode(genre).alias("mode"))
    return m.select("o_orderkey", R.dynamics_origin(c("base"), c("final")).alias("origin"), F.round("final.lra_reduction", 4).alias("lra_reduction"), F.round("final.crest_loss", 4).alias("crest_loss"), "mode")


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size / 10.0 END AS own_limit, CASE WHEN p_brand LIKE '%1' THEN 1.1 END AS genre_limit, p_size % 5 / 4.0 AS scale, p_retailprice / 1000 AS ratio, CASE WHEN p_size % 2 = 0 THEN -15.5 END AS effective, CASE WHEN p_size % 3 = 0 THEN -14.5 END AS adaptive, p_size FROM part)
SELECT p_partkey, coalesce(genre_limit, own_limit, 0.8)::DOUBLE AS lra_limit, 0.3::DOUBLE AS lufs_tolerance, coalesce(effective, adaptive, -14.0)::DOUBLE AS target, round(round_even(1 + (ratio - 1) * least(1, scale), 3), 3)::DOUBLE AS ratio, round(round_even(1 + (1.5 - 1) * least(1, scale), 3), 3)::DOUBLE AS makeup,
CASE WHEN p_size % 4 = 1 THEN 'CG_DEEP__JAZZ' WHEN p_size % 4 = 2 THEN 'CG_MAIN__GENERAL' WHEN p_size % 4 = 3 THEN 'CG_MAIN__POP' ELSE 'CG_MAIN__POP' END AS profile, CASE WHEN p_size % 2 = 0 THEN 'b' ELSE '' END AS lacking,
printf('equalizer=f=100.0:t=q:w=1.0:g=%.2f,equalizer=f=250.5:t=q:w=1.0:g=-1.25', p_size::DOUBLE) AS chain, printf('alimiter=limit=%.6f:attack=5:release=50:level=false:latency=true', pow(10, -p_size / 20.0)) AS limiter FROM p""")
def settings_assembly(spark, sf_dir):
    """Limits by override, the target that holds, compressors rescaled, keys with defaults, missing names, filter strings."""
    size = c("p_size")
    pairs = lambda cond, key, value: F.when(cond, F.create_map(F.lit(key), value)).otherwise(F.create_map().cast("map<string,double>"))
    profile = pairs(size % 3 == 0, "maxLraReductionLu", size / 10.0)
    own = settings.gate_settings(profile, F.create_map(F.lit("lufsToleranceLu"), F.lit(0.3)), pairs(c("p_brand").endswith("1"), "JAZZ", F.lit(1.1)), F.lit("JAZZ"))
    comp = settings.scaled_compressor(F.array(F.lit(0.2), c("p_retailprice") / 1000, F.lit(30.0), F.lit(300.0), F.lit(1.5)), size % 5 / 4.0)
    channel = settings.known_key(F.when(size % 4 == 1, " deep").when(size % 4 == 2, "other"), ["MAIN", "DEEP"], "MAIN")
    genre = settings.known_key(F.when(size % 4 == 1, "jazz ").when(size % 4 == 2, "polka").when(size % 4 == 3, ""), ["POP", "JAZZ", "GENERAL"], "POP", "GENERAL")
    target = settings.runtime_target(F.lit(-14.0), F.when(size % 3 == 0, -14.5), F.when(size % 2 == 0, -15.5))
    lacking = settings.missing_names(F.when(size % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"))), ["a", "b"])
    plan = F.array(*(F.struct(F.lit(hz).alias("center_hz"), g.alias("gain_db")) for hz, g in ((100.0, size.cast("double")), (250.5, F.lit(-1.25)))))
    return table(spark, sf_dir, "part").select(
        "p_partkey", own["max_lra_reduction"].alias("lra_limit"), own["lufs_tolerance"].alias("lufs_tolerance"), target.alias("target"), F.round(F.get(comp, F.lit(1)), 3).alias("ratio"), F.round(F.get(comp, F.lit(4)), 3).alias("makeup"),
        settings.composite_key(channel, genre).alias("profile"), F.array_join(lacking, ",").alias("lacking"), settings.equaliser_chain(plan).alias("chain"), settings.limiter(-size.cast("double")).alias("limiter"),
    )


@query("""SELECT n_name AS name, CASE n_nationkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Profile ''' || n_name || ''' is missing fields: targetLufsI, maxLraReductionLu' WHEN 2 THEN 'Profile ''' || n_name || ''' field ''outputBitDepth'' must be numeric.'
WHEN 3 THEN 'outputBitDepth must be 16, 24, or 32.' WHEN 4 THEN 'truePeakCeilingDbtp must not be above 0 dBTP.' ELSE 'workingSampleRateHz must be positive.' END AS error FROM nation""")
def profile_validation(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), c("n_nationkey") % 6
    value = {"workingSampleRateHz": F.when(k == 5, "0").otherwise("48000"), "outputBitDepth": F.when(k == 2, "many").when(k == 3, "20").otherwise("24"), "truePeakCeilingDbtp": F.when(k == 4, "0.5").otherwise("-1")}
    rows = F.array(*(F.struct(F.lit(name).alias("key"), value.get(name, F.lit("1")).alias("value")) for name in settings.REQUIRED))
    own = n.select(c("n_name").alias("name"), k.alias("k"), F.explode(rows).alias("r")).select("name", "k", "r.*")
    return settings.profile_errors(own.where(~((c("k") == 1) & c("key").isin("targetLufsI", "maxLraReductionLu"))).select("name", "key", "value"))


_NOISE = """WITH p AS (SELECT *, (['CLEAN', 'REPAIRED_LIGHT', 'REPAIRED_MEDIUM', 'ODD'])[p_size % 4 + 1] AS result, p_retailprice / 100 AS score FROM part)
"""


def _noise(spark, sf_dir):
    size = c("p_size")
    return table(spark, sf_dir, "part").select(
        "p_brand", "p_partkey", F.concat(F.lit("/in/x/"), "p_name").alias("source"), (c("p_retailprice") / 100).alias("score"), F.when(size % 2 == 0, F.array(F.lit("HISS"), F.lit("HUM"))).otherwise(F.array().cast("array<string>")).alias("found"),
        F.lit("LIGHT").alias("applied"), F.when(size % 3 == 0, 3.5).otherwise(0.0).alias("reduction_db"), F.when(size > 40, float("-inf")).otherwise(-size / 7.0).alias("before_rms"), (-size / 3.0).alias("after_rms"), (size / 16.0).alias("high_delta_db"),
        pick(size, "CLEAN", "REPAIRED_LIGHT", "REPAIRED_MEDIUM", "ODD").alias("result"), F.lit("").alias("recommendation"), F.array(F.lit("a"), F.lit("b")).alias("warnings"),
    )


@query(_NOISE + """SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS VARCHAR) AS "Track", p_name AS "Filename", printf('%.1f', score) AS "IntroNoiseScore", CASE WHEN p_size % 2 = 0 THEN 'HISS/HUM' ELSE 'NONE' END AS "DetectedType", 'LIGHT' AS "RepairMode", CASE WHEN p_size % 3 = 0 THEN '3.5 dB' ELSE 'BYPASS' END AS "ReductionStrength",
CASE WHEN p_size > 40 THEN '' ELSE printf('%.2f', -p_size / 7.0::DOUBLE) END AS "BeforeRMS", printf('%.2f', -p_size / 3.0::DOUBLE) AS "AfterRMS", printf('%.2f dB', p_size / 16.0::DOUBLE) AS "HighFreqDelta", result AS "Result", '' AS "Recommendation", 'a | b' AS "Warnings" FROM p""")
def noise_report(spark, sf_dir):
    return reports.noise_report(_noise(spark, sf_dir), "p_brand", "p_partkey")


@query(_NOISE + "SELECT r AS result, count(p_partkey) AS n FROM (SELECT unnest(['CLEAN', 'REPAIRED_LIGHT', 'REPAIRED_MEDIUM', 'NEEDS_REVIEW']) AS r) LEFT JOIN p ON CASE WHEN result = 'ODD' THEN 'NEEDS_REVIEW' ELSE result END = r AND p_size <> 1 GROUP BY r")
def noise_summary(spark, sf_dir):
    return reports.noise_summary(_noise(spark, sf_dir).where("before_rms <> -1 / 7D"))


@query("""WITH n AS (SELECT l_orderkey AS k, max({'n': l_linenumber, 'note': l_comment}).note AS note FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE l_returnflag || l_linenumber END AS l_comment FROM lineitem WHERE l_quantity > 25) WHERE trim(l_comment) <> '' GROUP BY l_orderkey),
o AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice / 10000 - 14.02 END AS measured, o_totalprice / 10000 - 14 AS lufs FROM orders)
SELECT o_orderkey, coalesce(note, '') AS tail_note, round(CAST(coalesce(measured, lufs) + CASE WHEN o_orderkey % 5 = 0 AND measured IS NOT NULL THEN -1 ELSE 0 END AS DOUBLE), 6) AS lufs,
CASE WHEN o_orderkey % 5 = 0 AND measured IS NOT NULL THEN 'old / ' || printf('codec safety attenuation applied: -%.2f dB', lufs - (measured - 1)) ELSE 'old' END AS warnings FROM o LEFT JOIN n ON k = o_orderkey""")
def report_refresh(spark, sf_dir):
    """Results taken anew from the final file, with notes of the gate joined on; every fifth came out a decibel softer."""
    key, total = c("o_orderkey"), c("o_totalprice").cast("double")
    o = table(spark, sf_dir, "orders")
    stale = o.select("o_orderkey", (total / 10000 - 14).alias("lufs"), F.array(F.lit("old")).alias("warnings"))
    measured = o.where(key % 4 != 0).select("o_orderkey", (total / 10000 - 14.02 - F.when(key % 5 == 0, 1.0).otherwise(0.0)).alias("lufs"))
    note = F.when(c("l_linenumber") % 3 == 0, " ").otherwise(F.concat("l_returnflag", c("l_linenumber").cast("string")))
    gate = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(c("l_orderkey").cast("string").alias("track"), note.alias("tail_note"), "l_linenumber")
    notes = reports.tail_notes(gate, "l_linenumber").select(c("track").cast("long").alias("o_orderkey"), "note")
    done = reports.refresh(stale, measured, "o_orderkey")
    return done.join(notes, "o_orderkey", "left").select("o_orderkey", F.coalesce("note", F.lit("")).alias("tail_note"), F.round("lufs", 6).alias("lufs"), F.array_join("warnings", " / ").alias("warnings"))


@query("""SELECT l_orderkey, coalesce(max(CASE WHEN l_linenumber % 2 = 0 THEN -l_quantity / 10 END), CAST('-infinity' AS DOUBLE)) AS max_peak, coalesce(max(CASE WHEN l_linenumber % 2 = 0 THEN -l_quantity / 10 END), CAST('-infinity' AS DOUBLE)) <= -1.45 AS safe FROM lineitem GROUP BY l_orderkey""")
def codec_peaks(spark, sf_dir):
    """The larger codec peak of each order, minus infinity where none was measured."""
    peak = F.when(c("l_linenumber") % 2 == 0, -c("l_quantity").cast("double") / 10)
    return reports.codec_peaks(table(spark, sf_dir, "lineitem").select("l_orderkey", peak.alias("peak")), "l_orderkey")


@query("""SELECT l_orderkey, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0)::DOUBLE AS analysis, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0)::DOUBLE AS render, sum(l_quantity)::DOUBLE AS total FROM lineitem GROUP BY l_orderkey""")
def stage_timings(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(c("l_returnflag") == "A", "analysis").when(c("l_returnflag") == "N", "render").otherwise("other").alias("stage"), c("l_quantity").cast("double").alias("seconds"))
    return reports.stage_seconds(rows, "l_orderkey", ["analysis", "render"])


@query("""WITH r AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'O' THEN 'NEEDS_REVIEW' ELSE ' ' END AS d, CASE o_orderkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' ELSE 'FAIL' END AS s FROM orders),
n AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (d <> 'READY') AS review, count(*) FILTER (s = 'PASS') AS passed, count(*) FILTER (s = 'WARN') AS warned, count(*) FILTER (s = 'FAIL') AS failed, count(*) FILTER (trim(d) <> '') AS fixed FROM r GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN review > 0 THEN 'COMPLETED_WITH_REVIEW' ELSE 'COMPLETED' END AS status, total, total - review AS ready, review, passed, warned, failed, fixed FROM n""")
def job_results(spark, sf_dir):
    """Each customer's orders as the report of a job."""
    d = F.when(c("o_orderstatus") == "F", "READY").when(c("o_orderstatus") == "O", "NEEDS_REVIEW").otherwise(" ")
    r = table(spark, sf_dir, "orders").select("o_custkey", d.alias("disposition"), pick(c("o_orderkey"), "PASS", "WARN", "FAIL").alias("status"))
    return reports.job_results(r, "o_custkey").join(reports.fixed_count(r, "o_custkey", "disposition"), "o_custkey")


@query("""WITH w AS (SELECT l_orderkey, l_tax * 100 - 3 AS tp, l_quantity / 2.5 AS lra, -14 + l_discount * 12 - 0.5 AS final, l_tax * 10 - 1.6 AS final_peak, l_linenumber FROM lineitem)
SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN tp > 0 THEN 'source true peak above 0 dBTP' END, CASE WHEN lra >= 18 THEN 'very wide source dynamics' END, CASE WHEN lra <= 2 THEN 'source is strongly compressed already' END, CASE WHEN abs(final + 14) > 0.35 THEN 'final loudness misses its target' END,
CASE WHEN final_peak > -1.1 THEN 'final true peak leaves too little room' END], lambda x: x IS NOT NULL), ', ') AS strict, len(list_filter([tp > 0, lra >= 18, lra <= 2, abs(final + 14) > 0.8, final_peak > -0.5], lambda x: x))::INTEGER AS n_loose FROM w""")
def warning_lists(spark, sf_dir):
    values = (c("l_tax") * 100 - 3, c("l_quantity").cast("double") / 2.5, -14 + c("l_discount") * 12 - 0.5, c("l_tax") * 10 - 1.6, F.lit(-14.0))
    strict, loose = reports.source_warnings(*values, F.lit(-1.2)), reports.source_warnings(*values)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(strict, ", ").alias("strict"), F.size(loose).alias("n_loose"))


_JOBS = """WITH j AS (SELECT o_orderkey AS job_id, o_custkey AS queue, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'RUNNING' ELSE 'WAITING' END AS status FROM orders),
q AS (SELECT c_custkey AS queue, c_custkey % 4 AS asked, c_custkey % 7 = 0 AS paused, c_custkey % 11 = 0 AS stop FROM customer)
"""


def _jobs(spark, sf_dir):
    status = F.when(c("o_orderstatus") == "F", "COMPLETED").when(c("o_orderstatus") == "P", "RUNNING").otherwise("WAITING")
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("job_id"), c("o_custkey").alias("queue"), c("o_orderkey").alias("seq"), status.alias("status"))


@query(_JOBS + """, r AS (SELECT queue, count(*) AS n FROM j WHERE status = 'RUNNING' GROUP BY queue), f AS (SELECT q.queue, CASE WHEN asked = 2 THEN 2 ELSE 1 END - coalesce(n, 0) AS free FROM q LEFT JOIN r USING (queue) WHERE NOT paused AND NOT stop)
SELECT queue, job_id FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY seq) AS place FROM j WHERE status = 'WAITING') JOIN f USING (queue) WHERE place <= free""")
def queue_launch(spark, sf_dir):
    """Jobs to start in each customer's queue: none where it is paused or stops after its current jobs."""
    q = table(spark, sf_dir, "customer").select(c("c_custkey").alias("queue"), (c("c_custkey") % 4).alias("asked"), (c("c_custkey") % 7 == 0).alias("paused"), (c("c_custkey") % 11 == 0).alias("stop_after_current"))
    return queue.launch(_jobs(spark, sf_dir), q)


@query(_JOBS + """SELECT job_id, CASE WHEN job_id % 5 = 2 AND status IN ('WAITING', 'RUNNING') THEN 'CANCELLED' ELSE status END AS status, FALSE AS gone FROM j WHERE NOT (job_id % 5 = 1 AND status <> 'RUNNING')
UNION ALL SELECT job_id, 'shown', TRUE FROM j WHERE job_id % 5 = 1 AND status <> 'RUNNING'""")
def queue_actions(spark, sf_dir):
    """Jobs removed and cancelled, running ones never removed, and the ids that a list still shows."""
    jobs, n = _jobs(spark, sf_dir), c("job_id") % 5
    after = queue.act(jobs, jobs.where(n.isin(1, 2)).select("job_id", F.when(n == 1, "remove").otherwise("cancel").alias("action")))
    gone = queue.stale(jobs, after).select("job_id", F.lit("shown").alias("status"), F.lit(True).alias("gone"))
    return after.select("job_id", "status", F.lit(False).alias("gone")).unionByName(gone)


@query("""WITH j AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 3 THEN 'RUNNING' ELSE 'WAITING' END AS s, o_orderkey % 3 AS code, (o_orderkey % 15)::INTEGER AS n FROM orders), e AS (SELECT *, id % 2 = 0 AS ended FROM j)
SELECT id AS job_id, CASE WHEN s = 'RUNNING' AND ended THEN CASE WHEN code = 0 THEN 'COMPLETED' ELSE 'FAILED' END ELSE s END AS status, CASE WHEN s = 'RUNNING' AND ended AND code = 0 THEN 15 WHEN s = 'RUNNING' AND NOT ended THEN n ELSE 0 END AS current_track, 15 AS total_tracks,
CASE WHEN s = 'RUNNING' AND ended AND code = 1 THEN 'worker exited with code 1' WHEN s = 'RUNNING' AND ended AND code = 2 THEN 'no report' END AS error FROM e""")
def queue_poll(spark, sf_dir):
    """Running jobs joined with their progress and results."""
    o, key = table(spark, sf_dir, "orders"), c("o_orderkey")
    jobs = o.select(key.alias("job_id"), F.when(key % 4 < 3, "RUNNING").otherwise("WAITING").alias("status"), F.lit(0).alias("current_track"), F.lit(15).alias("total_tracks"), F.lit(None).cast("string").alias("error"))
    progress = o.select(key.alias("job_id"), (key % 15).cast("int").alias("current_track"), F.lit(15).alias("total_tracks"))
    results = o.where(key % 2 == 0).select(key.alias("job_id"), (key % 3).cast("int").alias("code"), F.when(key % 3 == 0, "COMPLETED").alias("status"), F.when(key % 3 == 2, "no report").alias("error"))
    return queue.poll(jobs, progress, results)


@query("""WITH j AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 4 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'COMPLETED_WITH_REVIEW' ELSE 'FAILED' END AS s, o_orderkey % 3 = 0 AS warned FROM orders)
SELECT o_orderkey AS job_id, s AS status, 'in-' || o_orderkey AS folder, (o_orderkey % 16) || '/15' AS progress, CASE WHEN s = 'COMPLETED' THEN 'done' WHEN s = 'COMPLETED_WITH_REVIEW' THEN 'to review' WHEN warned THEN 'expected 15 WAV files, found 3' ELSE left('worker exited with code 1 and nothing more', 32) END AS result,
strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp FROM j""")
def queue_rows(spark, sf_dir):
    """What a list of jobs shows, and the time stamp of its files."""
    key = c("o_orderkey")
    status = F.when(key % 4 == 0, "COMPLETED").when(key % 4 == 1, "COMPLETED_WITH_REVIEW").otherwise("FAILED")
    jobs = table(spark, sf_dir, "orders").select(
        key.alias("job_id"), status.alias("status"), F.concat(F.lit("/music/in-"), key.cast("string")).alias("folder"), (key % 16).alias("current_track"), F.lit(15).alias("total_tracks"),
        F.when(key % 3 == 0, "expected 15 WAV files, found 3").alias("warning"), F.lit("worker exited with code 1 and nothing more").alias("error"),
    )
    stamps = table(spark, sf_dir, "orders").select(key.alias("job_id"), F.date_format("o_orderdate", "yyyyMMdd_HHmmss").alias("stamp"))
    return queue.queue_row(jobs).join(stamps, "job_id")


@query("""WITH n AS (SELECT c_custkey % 200 AS folder, min(c_custkey % 20)::INTEGER AS n FROM customer GROUP BY ALL), o AS (SELECT DISTINCT o_custkey % 200 AS folder FROM orders WHERE o_orderstatus = 'P')
SELECT folder, n AS total_tracks, CASE WHEN folder IN (SELECT folder FROM o) THEN 'refused' ELSE 'WAITING' END AS status, CASE WHEN folder IN (SELECT folder FROM o) OR n = 15 THEN NULL ELSE 'expected 15 WAV files, found ' || n END AS warning FROM n""")
def queue_add(spark, sf_dir):
    """Folders added as jobs, those with an open job refused."""
    jobs = table(spark, sf_dir, "orders").select((c("o_custkey") % 200).alias("folder"), F.when(c("o_orderstatus") == "P", "RUNNING").otherwise("COMPLETED").alias("status"))
    new = table(spark, sf_dir, "customer").select((c("c_custkey") % 200).alias("folder"), (c("c_custkey") % 20).cast("int").alias("n_files"))
    added, refused = queue.add_jobs(jobs, new, F.lit("2024-01-02 03:04:05").cast("timestamp"))
    size = new.groupBy("folder").agg(F.min("n_files").alias("total_tracks"))
    no = refused.join(size, "folder").select("folder", "total_tracks", F.lit("refused").alias("status"), F.lit(None).cast("string").alias("warning"))
    return added.select("folder", "total_tracks", "status", "warning").unionByName(no)
