"""Alignment and the fullness ladder over ``embeddings``, with renders, beside SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import arrays as A
from ..operators.attempts import align, ladder
from .frames import BASE, frames
from .registry import query

#: A delayed take: fifty vectors' left sides and 160 silent samples, delayed in one of four ways.
DELAYS = "CASE take % 4 WHEN 0 THEN 60 + take % 30 WHEN 1 THEN -50 - take % 30 WHEN 2 THEN 70 ELSE 20 END"
_AT = "coalesce({x}[{i}], 0)"


def delayed_takes(spark, sf_dir) -> DataFrame:
    """(track_id, sample_rate, reference, channels); every fourth take has a stronger copy at 130 samples, out of the search until it is shifted by 70."""
    f = frames(spark, sf_dir).withColumn("take", F.expr("vec_id div 50"))
    pieces = f.groupBy("take").agg(F.array_sort(F.collect_list(F.struct("vec_id", "l"))).alias("p"))
    whole = F.concat(F.flatten(F.transform("p", lambda s: s["l"])), F.array_repeat(F.lit(0.0), 160))
    t = pieces.select("take", whole.alias("reference"), F.expr(DELAYS).cast("int").alias("d"))

    def late(x: Column, d: Column) -> Column:
        return A.delay(x, -d)

    echo = F.zip_with(late(F.col("reference"), F.lit(70)), late(F.col("reference"), F.lit(130)), lambda a, b: 0.6 * a + b)
    made = F.when(F.col("take") % 4 == 2, echo).otherwise(late(F.col("reference"), F.col("d")))
    return t.select("take", F.col("take").cast("string").alias("track_id"), F.lit(1000).alias("sample_rate"), "reference", F.array(made, F.transform(made, lambda v: v * 0.5)).alias("channels"))


def judged(tracks: DataFrame, delays: DataFrame) -> DataFrame:
    """A failed delay is an issue, a larger one than 8 samples a warning, and so is a track whose number divides by three."""
    d = tracks.select("track_id").join(delays.select("track_id", "kind"), "track_id", "left")
    issues = F.when(F.col("kind") == "FAIL", F.array(F.lit("delay"))).otherwise(F.array().cast("array<string>"))
    warnings = F.array_compact(F.array(F.when(F.col("kind") == "WARN", F.lit("delay")), F.when(F.col("track_id").cast("long") % 3 == 0, F.lit("third"))))
    return d.select("track_id", issues.alias("issues"), warnings.alias("warnings"))


def _lags(name: str, source: str) -> str:
    """``{name}``: the delay of ``source`` (take, ref, pro) by three windows of 400 samples, its agreement and confidence."""
    return f"""{name}w AS (SELECT take, k, list_slice(ref, s + 1, s + 400) AS a, list_slice(pro, s + 1, s + 400) AS b FROM (SELECT *, unnest([0, 1, 2]) AS k FROM {source}), LATERAL (SELECT CAST(CASE WHEN k = 2 THEN len(ref) - 400 ELSE floor(k * ((len(ref) - 400) / 2.0)) END AS BIGINT) AS s)),
{name}n AS (SELECT take, k, list_transform(a, lambda v: v - list_avg(a)) AS a, list_transform(b, lambda v: v - list_avg(b)) AS b FROM {name}w),
{name}m AS (SELECT *, sqrt(list_sum(list_transform(a, lambda v: v * v))) AS na, sqrt(list_sum(list_transform(b, lambda v: v * v))) AS nb FROM {name}n),
{name}c AS (SELECT take, k, lag, list_sum(list_transform(generate_series(greatest(1, 1 - lag), least(400, 400 - lag)), lambda i: a[i] * b[i + lag])) / (na * nb) AS peak FROM {name}m, (SELECT unnest(generate_series(-100, 100)) AS lag) WHERE na > 1e-15 AND nb > 1e-15),
{name}b AS (SELECT take, k, lag, peak FROM (SELECT *, row_number() OVER (PARTITION BY take, k ORDER BY round(peak, 12) DESC, lag) AS place FROM {name}c) WHERE place = 1),
{name}d AS (SELECT take, list(lag ORDER BY k) AS lags, list(peak ORDER BY k) AS peaks, CAST(round_even(median(lag), 0) AS INTEGER) AS delay FROM {name}b GROUP BY take),
{name} AS (SELECT take, delay, len(inner_) AS n_in, len(lags) AS n, n_in >= CASE WHEN n >= 3 THEN 0.6 ELSE 1.0 END * n AND list_max(inner_) - list_min(inner_) <= 6 AS consistent, 0.7 * n_in / n + 0.3 * coalesce(list_median(good), 0) AS confidence,
CASE WHEN abs(delay) <= 1 THEN 'PASS' WHEN abs(delay) <= 8 THEN 'INFO' WHEN abs(delay) <= 47 THEN 'WARN' WHEN NOT consistent OR confidence < 0.7 THEN 'UNCERTAIN' ELSE 'FAIL' END AS kind
FROM (SELECT *, list_filter(lags, lambda x: abs(x - delay) <= 3) AS inner_, list_filter(list_transform(peaks, lambda p, i: CASE WHEN abs(lags[i] - delay) <= 3 THEN greatest(0, least(1, p)) END), lambda p: p IS NOT NULL) AS good FROM {name}d))"""


def _shifted(x: str, d: str) -> str:
    """``x`` with a delay of ``d`` samples taken out."""
    return f"list_transform(generate_series(1, len({x})), lambda i: CASE WHEN i + {d} BETWEEN 1 AND len({x}) THEN {x}[i + {d}] ELSE 0 END)"


@query(BASE + f"""t AS (SELECT vec_id // 50 AS take, list_concat(flatten(list(l ORDER BY vec_id)), list_transform(range(160), lambda i: 0.0::DOUBLE)) AS ref FROM f GROUP BY vec_id // 50),
p AS (SELECT take, ref, CASE WHEN take % 4 = 2 THEN list_transform({_shifted('ref', '(-70)')}, lambda v, i: 0.6 * v + CASE WHEN i > 130 THEN ref[i - 130] ELSE 0 END) ELSE {_shifted('ref', f'(-({DELAYS}))')} END AS raw FROM t),
q AS (SELECT take, ref, raw, list_transform(raw, lambda v: (v + v * 0.5) / 2) AS pro FROM p),
{_lags('one', 'q')},
tried AS (SELECT q.take, ref, delay, {_shifted('raw', 'delay')} AS raw FROM q JOIN one USING (take) WHERE kind = 'FAIL' AND abs(delay) BETWEEN 48 AND 4800 AND consistent AND confidence >= 0.7),
moved AS (SELECT *, list_transform(raw, lambda v: (v + v * 0.5) / 2) AS pro FROM tried),
{_lags('two', 'moved')},
better AS (SELECT take, moved.delay AS first_delay, two.delay, two.kind, raw FROM moved JOIN two USING (take) WHERE abs(two.delay) < abs(moved.delay) AND two.kind <> 'FAIL'),
r AS (SELECT take, TRUE AS aligned, delay, first_delay, kind, raw FROM better UNION ALL SELECT take, FALSE, delay, delay, kind, raw FROM q JOIN one USING (take) WHERE take NOT IN (SELECT take FROM better)),
v AS (SELECT *, kind = 'FAIL' AS bad, kind = 'WARN' OR take % 3 = 0 AS warned FROM r)
SELECT CAST(take AS VARCHAR) AS track_id, aligned, delay, first_delay, kind, CASE WHEN bad THEN 'FAIL' WHEN aligned THEN 'PASS' WHEN warned THEN 'WARN' ELSE 'PASS' END AS status,
array_to_string(list_filter([CASE WHEN kind = 'WARN' THEN 'delay' END, CASE WHEN take % 3 = 0 THEN 'third' END, CASE WHEN aligned THEN printf('automatic sample alignment applied: %+d', first_delay) || ' → ' || printf('%+d samples', delay) END], lambda x: x IS NOT NULL), ' / ') AS warnings,
round(list_sum(list_transform(raw, lambda x, i: x * x * (i % 97))), 6) AS weighed FROM v""")
def alignment_whole(spark, sf_dir):
    """Takes with delays: shifted, mended and measured again where one is confirmed, and as they were where that does not help."""
    out = align(delayed_takes(spark, sf_dir), judged, max_delay_ms=100.0, window_count=3, window_seconds=0.4, tolerance=3)
    weighed = A.total(F.transform(F.col("channels")[0], lambda x, i: x * x * ((i + 1) % 97)))
    return out.select("track_id", "aligned", "delay", "first_delay", "kind", "status", F.array_join("warnings", " / ").alias("warnings"), F.round(weighed, 6).alias("weighed"))


#: Rising limits of the peak for vectors by their number; what no strength meets is off.
STRENGTHS = [100, 75, 50, 25, 0]


def densified(tracks: DataFrame) -> DataFrame:
    """Both sides raised by a share (the strength) of 6 dB and saturated, level for level."""
    share = F.col("strength") / 100.0
    louder = F.transform("channels", lambda x: F.transform(x, lambda v: F.tanh(v * (1 + share)) * (1 + share)))
    return tracks.select("track_id", "sample_rate", louder.alias("channels"))


def within_peak(both: DataFrame) -> DataFrame:
    """A render fails where its peak is over its track's limit, or its energy over a multiple of the original's."""
    peak = F.array_max(F.transform("channels", A.peak))
    energy = lambda c: A.total(F.flatten(c), lambda v: v * v)
    limit = 0.2 + (F.col("track_id").cast("long") % 10) * 0.1
    ratio = 3 + F.col("track_id").cast("long") % 4 * 5
    reasons = F.array_compact(F.array(F.when(peak > limit, F.lit("true peak exceeded")), F.when(energy(F.col("channels")) > ratio * energy(F.col("original")), F.lit("crest loss too high"))))
    return both.select("track_id", reasons.alias("reasons"))


_RENDER = "list_transform(x, lambda v: tanh(v * (1 + s / 100.0::DOUBLE)) * (1 + s / 100.0::DOUBLE))"


@query(BASE + f"""s AS (SELECT vec_id, x, unnest([100, 75, 50, 25]) AS s FROM f),
r AS (SELECT vec_id, s, x, {_RENDER} AS y FROM s),
j AS (SELECT vec_id, s, y, list_max(list_transform(y, lambda v: abs(v))) > 0.2::DOUBLE + (vec_id % 10) * 0.1::DOUBLE AS high, list_sum(list_transform(y, lambda v: v * v)) > (3 + vec_id % 4 * 5) * list_sum(list_transform(x, lambda v: v * v)) AS dense FROM r),
c AS (SELECT f.vec_id, f.x, coalesce((SELECT max(s) FROM j WHERE j.vec_id = f.vec_id AND NOT high AND NOT dense), 0) AS strength FROM f)
SELECT CAST(c.vec_id AS VARCHAR) AS track_id, c.strength, round(sqrt(list_sum(list_transform(coalesce(j.y, c.x), lambda v: v * v)) / 64), 6) AS rms, CASE WHEN c.strength = 0 THEN (SELECT array_to_string(list_filter([CASE WHEN high THEN 'true peak exceeded' END, CASE WHEN dense THEN 'crest loss too high' END], lambda x: x IS NOT NULL), ' / ') FROM j AS k WHERE k.vec_id = c.vec_id AND k.s = 25) ELSE '' END AS reasons
FROM c LEFT JOIN j ON j.vec_id = c.vec_id AND j.s = c.strength""")
def fullness_ladder(spark, sf_dir):
    """Vectors rendered at falling strengths until one passes; each round renders only what failed before."""
    tracks = frames(spark, sf_dir).select(F.col("vec_id").cast("string").alias("track_id"), F.lit(48_000).alias("sample_rate"), F.array("l", "r").alias("channels"))
    out, _ = ladder(tracks, STRENGTHS, densified, within_peak)
    return out.select("track_id", "strength", F.round(A.rms(F.flatten("channels")), 6).alias("rms"), F.array_join("reasons", " / ").alias("reasons"))
