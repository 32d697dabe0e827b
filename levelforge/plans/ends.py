"""Whole-track repairs and budgets, with SQL: frames as short two-channel tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.levels import db
from ..operators import arrays as A
from ..operators import reports, tails
from .frames import BASE, _db, _rms, frames
from .registry import query, table

c = F.col
#: A sample rate at which the last 100 ms of a side of 32 samples are 8, and fades of 25 to 400 ms are 2 to 32.
RATE = 80
LADDER = [100.0, 200.0, 400.0]


def _tracks(spark, sf_dir):
    scale = F.pow(F.lit(10.0), -(c("vec_id") % 8) / 2.0)
    side = lambda x: F.transform(x, lambda v: v * scale)
    return frames(spark, sf_dir).select("vec_id", F.lit(RATE).alias("sample_rate"), F.array(side("l"), side("r")).alias("channels"))


_FADE = "list_transform({x}, lambda v, i: CASE WHEN i <= len({x}) - {n} THEN v WHEN i = len({x}) THEN 0.0 ELSE v * (len({x}) - i) / ({n} - 1) END)"
_END = lambda x, y: f"list_concat(list_slice({x}, 25, 32), list_slice({y}, 25, 32))"
_MENDED = {n: (_FADE.format(x="l", n=n), _FADE.format(x="r", n=n)) for n in (2, 8, 16, 32)}
_TAIL = BASE + f"""s AS (SELECT vec_id, list_transform(l, lambda v: v * pow(10.0::DOUBLE, -(vec_id % 8) / 2.0)) AS l, list_transform(r, lambda v: v * pow(10.0::DOUBLE, -(vec_id % 8) / 2.0)) AS r FROM f),
m AS (SELECT *, {_db(_rms(_END('l', 'r')))} AS e, {_db('greatest(abs(l[32]), abs(r[32]))')} AS z, {', '.join(f"{_db(_rms(_END(*_MENDED[n])))} <= -35.5 AS p{n}" for n in (8, 16, 32))} FROM s),
d AS (SELECT *, CASE WHEN e > -35 THEN 'musical_tail_fade' WHEN e > -50 AND z > -60 THEN 'click_safe_fade' WHEN z > -80 THEN 'micro_fade' ELSE 'none' END AS mode FROM m),
k AS (SELECT *, CASE mode WHEN 'musical_tail_fade' THEN CASE WHEN p8 THEN 100 WHEN p16 THEN 200 ELSE 400 END WHEN 'click_safe_fade' THEN 25 WHEN 'micro_fade' THEN 5 ELSE 0 END AS fade FROM d),
o AS (SELECT *, CASE fade WHEN 100 THEN {_MENDED[8][0]} WHEN 200 THEN {_MENDED[16][0]} WHEN 400 THEN {_MENDED[32][0]} WHEN 0 THEN l ELSE {_MENDED[2][0]} END AS y FROM k)
SELECT vec_id, mode, fade::DOUBLE AS fade_ms, CAST(CASE mode WHEN 'musical_tail_fade' THEN CASE fade WHEN 100 THEN 1 WHEN 200 THEN 2 ELSE 3 END WHEN 'none' THEN 0 ELSE 1 END AS INTEGER) AS attempts, round(1e6 * list_sum(list_transform(y, lambda v: v * v)), 4) AS energy, round(y[32], 9) AS last_sample FROM o"""


@query(_TAIL)
def tail_repair(spark, sf_dir):
    """Ends mended by their kind: a ladder of fades, a short fade, or none."""
    out = tails.repair_tail(_tracks(spark, sf_dir), F.array(*map(F.lit, LADDER)))
    left = F.get("channels", F.lit(0))
    return out.select("vec_id", "mode", "fade_ms", F.size("attempted").alias("attempts"), F.round(1e6 * A.total(left, lambda v: v * v), 4).alias("energy"), F.round(F.element_at(left, -1), 9).alias("last_sample"))


@query(BASE + f"""g AS (SELECT *, CAST(vec_id % 40 AS DOUBLE) AS g, list_sum(l) / 32 AS a, list_sum(r) / 32 AS b FROM f),
h AS (SELECT *, list_max(list_transform(x, lambda v: abs(v))) * pow(10, g / 20) AS p, greatest(list_max(list_transform(l, lambda v: abs(v - a))), list_max(list_transform(r, lambda v: abs(v - b)))) AS q FROM g)
SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN 'gain-only render produced non-finite samples' WHEN p > 1 THEN 'gain-only render would clip' END AS gain_error, CASE WHEN vec_id % 50 <> 0 AND p <= 1 THEN round({_db('p')}, 5) END AS gain_peak_db,
greatest(abs(a), abs(b)) > 0.02 AS dc_applied, round(greatest(abs(a), abs(b)), 6) AS dc_before, CASE WHEN q > 0.4 THEN 'clips' END AS dc_error, CASE vec_id % 50 WHEN 0 THEN 'Audio contains NaN or infinity.' WHEN 1 THEN 'Audio is empty.' WHEN 2 THEN 'Audio must have shape (frames,) or (frames, channels).' END AS audio_error FROM h""")
def guarded_renders(spark, sf_dir):
    """Constant gain, offsets and shapes, each refused for its reason; offsets are taken at 2.5 times the samples, so that some clip."""
    x, k = F.array("l", "r"), c("vec_id") % 50
    odd = F.when(k == 0, F.array("l", F.transform("r", lambda v, i: F.when(i == 3, float("inf")).otherwise(v)))).when(k == 1, F.array().cast("array<array<double>>")).when(k == 2, F.array("l", F.slice("r", 1, 5))).otherwise(x)
    gained = F.when(k == 0, odd).otherwise(x)
    more = F.transform(x, lambda s: F.transform(s, lambda v: v * 2.5))
    f = frames(spark, sf_dir).select("vec_id", tails.gain_only(gained, (c("vec_id") % 40).cast("double")).alias("g"), tails.dc_removed(more, 0.05).alias("d"), tails.audio_error(odd).alias("audio_error"))
    return f.select("vec_id", c("g.error").alias("gain_error"), F.round(db(tails.largest(c("g.channels"))), 5).alias("gain_peak_db"), c("d.applied").alias("dc_applied"), F.round(c("d.before") / 2.5, 6).alias("dc_before"), F.when(c("d.error").isNotNull(), "clips").alias("dc_error"), "audio_error")


@query("""WITH a AS (SELECT o_custkey, o_orderkey, (['fullness', 'gate', 'codec', 'other'])[o_orderkey % 4 + 1] AS kind FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, kind ORDER BY o_orderkey) AS place, CASE kind WHEN 'fullness' THEN 2 WHEN 'gate' THEN 3 WHEN 'codec' THEN 1 ELSE 0 END AS most FROM a)
SELECT o_custkey, o_orderkey, kind, place <= most AS done, CAST(greatest(0, most - place) AS INTEGER) AS "left" FROM p""")
def retry_budgets(spark, sf_dir):
    """Each customer's orders as attempts of a kind, done while the kind's budget lasts."""
    kind = F.get(F.array(*map(F.lit, ["fullness", "gate", "codec", "other"])), (c("o_orderkey") % 4).cast("int"))
    return tails.within_budgets(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", kind.alias("kind")), "o_custkey", "kind", "o_orderkey", {"fullness": 2, "gate": 3, "codec": 1})


@query("""WITH d AS (SELECT l_orderkey, max(l_linenumber)::VARCHAR AS delay FROM lineitem WHERE l_quantity > 40 GROUP BY l_orderkey), a AS (SELECT l_orderkey, min(l_linenumber)::VARCHAR AS shift FROM lineitem WHERE l_quantity > 48 GROUP BY l_orderkey)
SELECT o_orderkey, o_orderpriority, d.delay, coalesce(a.shift, 'none') AS shift FROM orders LEFT JOIN d ON o_orderkey = d.l_orderkey LEFT JOIN a ON o_orderkey = a.l_orderkey""")
def report_chain(spark, sf_dir):
    """Two patches one after the other: delays, then alignments where there were any."""
    r = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    d = lines.where("l_quantity > 40").groupBy("o_orderkey").agg(F.max("l_linenumber").alias("delay"))
    a = lines.where("l_quantity > 48").groupBy("o_orderkey").agg(F.min("l_linenumber").alias("shift"))
    return reports.patch(reports.patch(r, d, "o_orderkey"), a, "o_orderkey", defaults={"shift": F.lit("none")})
