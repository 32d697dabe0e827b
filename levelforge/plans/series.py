"""Windows over ordered series: ``events`` by user in order of (ts, event_id), ``lineitem`` by supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import correlation
from ..operators import rules as R
from ..operators.scans import framed, placed
from .registry import query, table

ORDER = "(PARTITION BY user_id ORDER BY ts, event_id)"


def series(spark, sf_dir) -> DataFrame:
    """(user_id, i, n, v, event_type): each user's values in order, from 1; a user with very many is numbered across tasks."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("v"), "event_type")
    return placed(e, ["user_id"], ["ts", "event_id"], "i", "n").drop("ts", "event_id")


BASE = f"WITH s AS (SELECT user_id, row_number() OVER {ORDER} AS i, count(*) OVER (PARTITION BY user_id) AS n, value AS v, event_type FROM events)\n"


@query("""SELECT l_suppkey, count(*) AS n, round(CASE WHEN vx <= 1e-12 OR vy <= 1e-12 THEN 1 ELSE c / sqrt(vx * vy) END, 4) AS correlation FROM (
SELECT l_suppkey, count(*) AS k, sum(l_quantity * l_extendedprice) - sum(l_quantity) * sum(l_extendedprice) / count(*) AS c, sum(l_quantity * l_quantity) - sum(l_quantity) * sum(l_quantity) / count(*) AS vx,
sum(l_extendedprice * l_extendedprice) - sum(l_extendedprice) * sum(l_extendedprice) / count(*) AS vy FROM lineitem GROUP BY l_suppkey) JOIN lineitem USING (l_suppkey) GROUP BY l_suppkey, c, vx, vy""")
def pair_correlation(spark, sf_dir):
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    r = correlation(F.count("*"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(r, 4).alias("correlation"))


@query("""SELECT event_type, b AS band, count(*) AS n, round(10 * log10(avg(value * value)), 4) AS level_db FROM (SELECT *, CASE WHEN value < 20 THEN '0-20' WHEN value < 60 THEN '20-60' WHEN value < 120 THEN '60-120' WHEN value < 250 THEN '120-250' ELSE '250-500' END AS b FROM events) GROUP BY ALL""")
def band_energy_buckets(spark, sf_dir):
    v = F.col("value")
    band = F.when(v < 20, "0-20").when(v < 60, "20-60").when(v < 120, "60-120").when(v < 250, "120-250").otherwise("250-500")
    return table(spark, sf_dir, "events").groupBy("event_type", band.alias("band")).agg(F.count("*").alias("n"), F.round(10 * F.log10(F.avg(v * v)), 4).alias("level_db"))


@query(BASE + """SELECT user_id, part, count(*) AS n, round(max(v), 4) AS peak, round(sqrt(avg(v * v)), 4) AS rms FROM (SELECT *, CASE WHEN i <= least(15, n) THEN 'intro' END AS a, CASE WHEN i > greatest(0, n // 2 - 4) AND i <= greatest(0, n // 2 - 4) + 8 THEN 'middle' END AS b, CASE WHEN i > n - 8 THEN 'tail' END AS c FROM s),
LATERAL (SELECT unnest([a, b, c]) AS part) WHERE part IS NOT NULL GROUP BY user_id, part""")
def segment_features(spark, sf_dir):
    """Intro, middle and tail of a series; they may overlap."""
    start = F.greatest(F.lit(0), F.expr("n div 2") - 4)
    i, n = F.col("i"), F.col("n")
    parts = F.array_compact(F.array(F.when(i <= 15, "intro"), F.when((i > start) & (i <= start + 8), "middle"), F.when(i > n - 8, "tail")))
    v = F.col("v")
    return series(spark, sf_dir).select("user_id", "v", F.explode(parts).alias("part")).groupBy("user_id", "part").agg(F.count("*").alias("n"), F.round(F.max(v), 4).alias("peak"), F.round(F.sqrt(F.avg(v * v)), 4).alias("rms"))


@query(BASE + """SELECT user_id, count(*) AS frames, round(avg(CASE WHEN q < 40 THEN 1.0 ELSE 0.0 END)::DOUBLE, 4) AS quiet_ratio FROM (SELECT user_id, (i - 1) // 4 AS f, round(sqrt(avg(v * v)), 6) AS q FROM s GROUP BY ALL HAVING count(*) = 4) GROUP BY user_id""")
def frame_quiet_ratio(spark, sf_dir):
    """Tumbling frames of four values, an incomplete last one dropped; quiet below 40."""
    f = series(spark, sf_dir).groupBy("user_id", F.expr("(i - 1) div 4").alias("f")).agg(F.count("*").alias("k"), F.round(F.sqrt(F.avg(F.col("v") * F.col("v"))), 6).alias("q")).where("k = 4")
    return f.groupBy("user_id").agg(F.count("*").alias("frames"), F.round(F.avg(F.when(F.col("q") < 40, 1.0).otherwise(0.0)), 4).alias("quiet_ratio"))


@query("""WITH d AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, round(avg(value), 6) AS a FROM events GROUP BY ALL)
SELECT event_type, CAST(day AS VARCHAR) AS day, round(0.25 * coalesce(lag(a) OVER w, a) + 0.5 * a + 0.25 * coalesce(lead(a) OVER w, a), 4) AS smooth FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)""")
def smooth_three_tap(spark, sf_dir):
    """Over daily means: the window sees a row a day, whatever the number of events."""
    w = Window.partitionBy("event_type").orderBy("day")
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("a"))
    a = F.col("a")
    return d.select("event_type", F.col("day").cast("string").alias("day"), F.round(0.25 * F.coalesce(F.lag(a).over(w), a) + 0.5 * a + 0.25 * F.coalesce(F.lead(a).over(w), a), 4).alias("smooth"))


@query(BASE + """, d AS (SELECT user_id, round(v - lag(v) OVER (PARTITION BY user_id ORDER BY i), 6) AS d FROM s), m AS (SELECT user_id, quantile_cont(d, 0.5) AS m FROM d WHERE d IS NOT NULL GROUP BY user_id),
a AS (SELECT d.user_id, d, m, quantile_cont(abs(d - m), 0.5) OVER (PARTITION BY d.user_id) AS mad FROM d JOIN m USING (user_id) WHERE d IS NOT NULL)
SELECT user_id, count(*) AS n, round(greatest(1.4826 * max(mad), 1e-8), 4) AS scale, count(*) FILTER (abs(d - m) > greatest(0.025, 2 * 1.4826 * mad)) AS spikes FROM a GROUP BY user_id""")
def diff_spikes_mad(spark, sf_dir):
    """First differences, their robust scale, and those over twice it."""
    before = framed(series(spark, sf_dir), ["user_id"], "i", 1, 0, {"before": lambda w: F.lag("v").over(w)})
    d = before.select("user_id", F.round(F.col("v") - F.col("before"), 6).alias("d")).where("d IS NOT NULL").groupBy("user_id", "d").agg(F.count("*").alias("times"))
    # Percentiles over counted values, joined back: no window holds a whole user.
    d = d.join(d.groupBy("user_id").agg(F.percentile("d", F.lit(0.5), F.col("times")).alias("m")), "user_id").withColumn("off", F.abs(F.col("d") - F.col("m")))
    d = d.join(d.groupBy("user_id").agg(F.percentile("off", F.lit(0.5), F.col("times")).alias("mad")), "user_id")
    over = F.col("off") > F.greatest(F.lit(0.025), 2 * 1.4826 * F.col("mad"))
    return d.groupBy("user_id").agg(F.sum("times").alias("n"), F.round(F.greatest(1.4826 * F.max("mad"), F.lit(1e-8)), 4).alias("scale"), F.sum(F.when(over, F.col("times")).otherwise(0)).alias("spikes"))


@query("SELECT user_id, round(exp(avg(ln(value))) / avg(value), 4) AS flatness FROM events WHERE value > 0 GROUP BY user_id")
def flatness(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value > 0").groupBy("user_id").agg(F.round(F.exp(F.avg(F.ln("value"))) / F.avg("value"), 4).alias("flatness"))


@query(BASE + """, k AS (SELECT user_id, n, greatest(1, least(3, n // 16)) AS c FROM (SELECT DISTINCT user_id, n FROM s)),
w AS (SELECT user_id, n, c, unnest(generate_series(0, c - 1)) AS j FROM k), p AS (SELECT *, CASE WHEN c = 1 THEN 0 ELSE CAST(floor(j * (greatest(0, n - 16)) / (c - 1)::DOUBLE) AS BIGINT) END AS a FROM w),
e AS (SELECT p.user_id, j, CAST(round(avg(v)) AS BIGINT) AS est FROM p JOIN s ON s.user_id = p.user_id AND s.i > a AND s.i <= a + 16 GROUP BY ALL),
m AS (SELECT user_id, CAST(round(quantile_cont(est, 0.5)) AS BIGINT) AS med FROM e GROUP BY user_id)
SELECT user_id, med AS median, round(avg(CASE WHEN abs(est - med) <= 10 THEN 1.0 ELSE 0.0 END)::DOUBLE, 4) AS agreement, coalesce(max(est) FILTER (abs(est - med) <= 10) - min(est) FILTER (abs(est - med) <= 10), 0) AS spread FROM e JOIN m USING (user_id) GROUP BY user_id, med""")
def spaced_window_median(spark, sf_dir):
    """Up to three evenly spaced windows of 16 values: the median of their estimates, agreement and spread."""
    s = series(spark, sf_dir)
    count = F.greatest(F.lit(1), F.least(F.lit(3), F.expr("n div 16")))
    step = F.when(F.col("c") == 1, F.lit(0)).otherwise(F.floor(F.col("j") * F.greatest(F.lit(0), F.col("n") - 16) / (F.col("c") - 1)))
    s = s.withColumn("c", count).select("*", F.explode(F.sequence(F.lit(0), F.col("c").cast("int") - 1)).alias("j")).withColumn("a", step).where("i > a AND i <= a + 16")
    e = s.groupBy("user_id", "j").agg(F.round(F.avg("v")).cast("long").alias("est"))
    # Three windows of a user at most: the window holds three rows.
    e = e.withColumn("med", F.round(F.percentile("est", F.lit(0.5)).over(Window.partitionBy("user_id"))).cast("long"))
    close = F.abs(F.col("est") - F.col("med")) <= 10
    inner = F.when(close, F.col("est"))
    return e.groupBy("user_id", F.col("med").alias("median")).agg(F.round(F.avg(F.when(close, 1.0).otherwise(0.0)), 4).alias("agreement"), F.coalesce(F.max(inner) - F.min(inner), F.lit(0)).cast("long").alias("spread"))


@query("""WITH u AS (SELECT user_id, round(avg(value) / 10 - 20, 6) AS lufs, round(max(value) / 100 - 4, 6) AS tp, round(stddev_samp(value) / 12, 6) AS lra, count(*) FILTER (value > 400) AS clipped FROM events GROUP BY user_id HAVING count(*) > 1),
a AS (SELECT *, clipped > 0 OR tp >= 0 AS stressed, greatest(0, tp + (-14 - lufs) + 1.2) AS red, lra - 3.5 AS dyn FROM u), b AS (SELECT *, CASE WHEN stressed THEN 0.8 ELSE 1.5 END::DOUBLE AS allowed FROM a),
c AS (SELECT *, CASE WHEN red > allowed THEN greatest(-16.0, -14 - (red - allowed)) ELSE -14.0 END::DOUBLE AS adaptive, CASE WHEN dyn <= 0.5 THEN 'TRANSPARENT' WHEN dyn <= 1 THEN 'REDUCED' ELSE 'PROFILE' END AS mode FROM b),
d AS (SELECT *, mode = 'TRANSPARENT' OR stressed AS gain_only, least(adaptive, lufs + (-1.2 - 0.05 - tp)) AS safe FROM c),
e AS (SELECT *, CASE WHEN NOT gain_only THEN adaptive WHEN stressed THEN greatest(-18.0, safe) ELSE safe END AS eff, stressed AND safe < -18 - 1e-9 AS review FROM d)
SELECT user_id, round(adaptive, 3) AS adaptive, round(red, 3) AS reduction, mode, stressed, gain_only, round(eff, 3) AS effective, review, round(least(-14 - lufs, -1.25 - tp), 3) AS gain_db,
array_to_string(list_filter([CASE WHEN stressed THEN 'source peak pressure' END, CASE WHEN red > allowed AND adaptive < -14.01 THEN 'projected peak reduction budget' END, CASE WHEN mode = 'TRANSPARENT' THEN 'low source LRA' END, CASE WHEN mode = 'REDUCED' THEN 'narrow source dynamics' END, CASE WHEN stressed AND eff < adaptive - 0.01 THEN 'gain-only peak safety' END, CASE WHEN review THEN 'safety floor requires review' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM e""")
def preflight_and_gain(spark, sf_dir):
    v = F.col("value")
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg(v) / 10 - 20, 6).alias("lufs"), F.round(F.max(v) / 100 - 4, 6).alias("tp"), F.round(F.stddev_samp(v) / 12, 6).alias("lra"), F.count_if(v > 400).alias("clipped"), F.count("*").alias("k")).where("k > 1")
    made = u.select("user_id", R.preflight(F.col("lufs"), F.col("tp"), F.col("lra"), F.col("clipped")).alias("p"), F.round(R.gain_only(F.col("lufs"), F.col("tp")), 3).alias("gain_db"))
    return made.select("user_id", F.round("p.adaptive", 3).alias("adaptive"), F.round("p.reduction", 3).alias("reduction"), "p.mode", "p.stressed", "p.gain_only", F.round("p.effective", 3).alias("effective"), "p.review", "gain_db", F.array_join("p.reasons", "; ").alias("reasons"))


@query(BASE + """, u AS (SELECT user_id, round(-30 + avg(v) FILTER (i <= 15) / 10, 6) AS rms, round(avg(CASE WHEN v < 30 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS quiet, round(avg(CASE WHEN v > 200 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS high, round(avg(CASE WHEN v > 250 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS very, round(exp(avg(ln(v))) / avg(v) - 0.4, 6) AS flat, round(count(*) FILTER (v > 300) / 10.0::DOUBLE, 6) AS clicks, round(max(v) / 20, 6) AS hum,
round(avg(CASE WHEN v > 200 THEN 1.0 ELSE 0.0 END) FILTER (mid)::DOUBLE, 6) AS mid_high, round(exp(avg(ln(v)) FILTER (mid)) / avg(v) FILTER (mid) - 0.4, 6) AS mid_flat,
round(greatest(avg(CASE WHEN v > 250 THEN 1.0 ELSE 0.0 END) FILTER (mid), avg(CASE WHEN v > 250 THEN 1.0 ELSE 0.0 END) FILTER (i > n - 8))::DOUBLE, 6) AS body_very
FROM (SELECT *, i > greatest(0, n // 2 - 4) AND i <= greatest(0, n // 2 - 4) + 8 AS mid FROM s) GROUP BY user_id),
a AS (SELECT *, greatest(0, (high - 0.055) * 180) + greatest(0, (flat - 0.08) * 45) AS st FROM u), b AS (SELECT *, rms < -21 AND quiet > 0.08 AND high > 0.06 AND flat > 0.07 AND st >= 8 AS hiss, clicks >= 0.8 AND rms < -18 AS click, rms < -16 AND hum >= 18 AS hum_, very > 0.18 AND flat > 0.12 AND body_very > 0.12 AS art FROM a),
c AS (SELECT *, hiss AND mid_high > 0.09 AND mid_flat > 0.06 AS stat FROM b), d AS (SELECT *, greatest(0, least(100, CASE WHEN hiss THEN least(42, st) ELSE 0 END + CASE WHEN stat THEN 8 ELSE 0 END + CASE WHEN click THEN least(32, 8 + 4 * clicks) ELSE 0 END + CASE WHEN hum_ THEN least(35, 0.9 * hum) ELSE 0 END + CASE WHEN art THEN 26 ELSE 0 END)) AS score FROM c)
SELECT user_id, round(score, 3)::DOUBLE AS score, array_to_string(list_filter([CASE WHEN hiss THEN 'HISS' END, CASE WHEN stat THEN 'STATIC' END, CASE WHEN click THEN 'CLICK_CRACKLE' END, CASE WHEN hum_ THEN 'HUM' END, CASE WHEN art THEN 'HIGH_FREQ_ARTIFACT' END], lambda x: x IS NOT NULL), ' / ') AS found,
CASE WHEN art THEN 'NEEDS_REVIEW' WHEN score >= 52 THEN 'MEDIUM_REPAIR' WHEN score >= 12 THEN 'LIGHT_REPAIR' ELSE 'CLEAN' END AS decision FROM d""")
def noise_decision(spark, sf_dir):
    v = F.col("v")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    # Zero has a logarithm of minus infinity, as in SQL; Spark's is null. A mean of zero gives NaN.
    log = F.when(v == 0, float("-inf")).when(v < 0, float("nan")).otherwise(F.ln(v))
    flatness = lambda w, x: F.when(F.avg(x) == 0, float("nan")).otherwise(F.exp(F.avg(w)) / F.avg(x)) - 0.4
    start = F.greatest(F.lit(0), F.expr("n div 2") - 4)
    middle = (F.col("i") > start) & (F.col("i") <= start + 8)
    part = lambda own, c: F.avg(F.when(own, F.when(c, 1.0).otherwise(0.0)))
    flat = flatness(F.when(middle, log), F.when(middle, v))
    body = [F.round(part(middle, v > 200), 6).alias("mid_high"), F.round(flat, 6).alias("mid_flat"), F.round(F.greatest(part(middle, v > 250), part(F.col("i") > F.col("n") - 8, v > 250)), 6).alias("body_very")]
    u = series(spark, sf_dir).groupBy("user_id").agg(F.round(-30 + F.avg(F.when(F.col("i") <= 15, v)) / 10, 6).alias("rms"), share(v < 30).alias("quiet"), share(v > 200).alias("high"), share(v > 250).alias("very"), F.round(flatness(log, v), 6).alias("flat"), F.round(F.count_if(v > 300) / 10.0, 6).alias("clicks"), F.round(F.max(v) / 20, 6).alias("hum"), *body)
    d = u.select("user_id", R.noise_decision(*(F.col(x) for x in ("rms", "quiet", "high", "very", "flat", "clicks", "hum", "mid_high", "mid_flat", "body_very"))).alias("d"))
    return d.select("user_id", F.round("d.score", 3).alias("score"), F.array_join("d.found", " / ").alias("found"), "d.decision")


@query("""WITH o AS (SELECT l_orderkey, sum(l_quantity) AS q, max(l_extendedprice) / 200 AS seconds, arg_max(l_linenumber, l_extendedprice * 1000 - l_linenumber) AS slow FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN q / 10 >= 16 THEN 1.15 WHEN q / 10 >= 12 THEN 1.08 WHEN q / 10 <= 3 THEN 0.65 WHEN q / 10 <= 5 THEN 0.78 ELSE 1.0 END::DOUBLE AS factor, CASE WHEN seconds > 240 THEN 'error' WHEN seconds > 120 THEN 'warning' ELSE '' END AS level, slow AS slowest FROM o""")
def factor_level_slowest(spark, sf_dir):
    """Adaptive factor, performance level and slowest stage of each order, its lines as stages; ties to the first."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), (F.max("l_extendedprice") / 200).alias("s"), F.max_by("l_linenumber", F.struct(F.col("l_extendedprice"), -F.col("l_linenumber"))).alias("slowest"))
    return o.select("l_orderkey", R.adaptive_factor(F.col("q") / 10).alias("factor"), R.performance_level(F.col("s")).alias("level"), "slowest")


@query("""WITH h AS (SELECT event_type, hour(ts) AS h, round(10 * log10(avg(value * value)), 6) AS e FROM events GROUP BY ALL), o AS (SELECT hour(ts) AS h, round(10 * log10(avg(value * value)), 6) AS e FROM events GROUP BY ALL),
d AS (SELECT event_type, h.h, o.e - h.e AS d FROM h JOIN o ON h.h = o.h), c AS (SELECT event_type, h, d - avg(d) OVER (PARTITION BY event_type) AS c FROM d),
s AS (SELECT event_type, h, 0.25 * coalesce(lag(c) OVER w, c) + 0.5 * c + 0.25 * coalesce(lead(c) OVER w, c) AS s FROM c WINDOW w AS (PARTITION BY event_type ORDER BY h))
SELECT event_type, CAST(h AS INTEGER) AS hour, round(greatest(-0.8, least(0.8, s)), 4) AS gain FROM s WHERE abs(round(greatest(-0.8, least(0.8, s)), 4)) >= 0.1""")
def band_diff_plan(spark, sf_dir):
    """Corrections of each type's hourly level towards the overall one: centred, smoothed, clipped, small ones dropped."""
    level = F.round(10 * F.log10(F.avg(F.col("value") * F.col("value"))), 6).alias("e")
    e = table(spark, sf_dir, "events")
    h = e.groupBy("event_type", F.hour("ts").alias("hour")).agg(level)
    o = e.groupBy(F.hour("ts").alias("hour")).agg(level.alias("o"))
    by, w = Window.partitionBy("event_type"), Window.partitionBy("event_type").orderBy("hour")
    d = h.join(o, "hour").withColumn("d", F.col("o") - F.col("e")).withColumn("c", F.col("d") - F.avg("d").over(by))
    s = 0.25 * F.coalesce(F.lag("c").over(w), "c") + 0.5 * F.col("c") + 0.25 * F.coalesce(F.lead("c").over(w), "c")
    return d.select("event_type", "hour", F.round(F.greatest(F.lit(-0.8), F.least(F.lit(0.8), s)), 4).alias("gain")).where("abs(gain) >= 0.1")
