"""Noise-repair routing, strength ladder and batch texts over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing as N
from .registry import query, table

_FOUND = "list_filter([CASE WHEN p_size % 2 = 0 THEN 'HISS' END, CASE WHEN p_size % 3 = 0 THEN 'CLICK_CRACKLE' END, CASE WHEN p_size % 5 = 0 THEN 'HUM' END], lambda v: v IS NOT NULL)"


def _parts(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda x, *names: F.element_at(F.array(*map(F.lit, names)), (F.pmod(x, F.lit(len(names))) + 1).cast("int"))
    found = F.array_compact(F.array(*(F.when(size % n == 0, F.lit(t)) for n, t in ((2, "HISS"), (3, "CLICK_CRACKLE"), (5, "HUM")))))
    return table(spark, sf_dir, "part").select(k, size, pick(k, "off", "auto", "light", "medium", "other").alias("mode"), pick(size, "CLEAN", "LIGHT_REPAIR", "MEDIUM_REPAIR", "NEEDS_REVIEW").alias("decision"), found.alias("found"))


@query(f"""WITH p AS (SELECT p_partkey, p_size, {_FOUND} AS found, p_partkey % 2 = 0 AS light FROM part)
SELECT p_partkey, array_to_string(list_concat(list_concat(CASE WHEN list_contains(found, 'CLICK_CRACKLE') THEN ['{N.CLICK_FILTER}'] ELSE [] END, CASE WHEN list_contains(found, 'HISS') THEN ['afftdn=nr=' || CASE WHEN light THEN '3.5' ELSE '6.0' END || ':nf=-50:tn=1:gs=5'] ELSE [] END),
CASE WHEN list_contains(found, 'HUM') AND p_size > 10 THEN list_transform(generate_series(1, CASE WHEN light THEN 2 ELSE 3 END), lambda n: 'bandreject=f=' || CASE WHEN p_size % 4 = 0 THEN 50 * n ELSE 60 * n END || '.0:width_type=h:width=3') ELSE [] END), ',') AS chain,
CASE WHEN list_contains(found, 'HUM') AND p_size <= 10 THEN 1 ELSE 0 END AS n_warnings FROM p""")
def noise_repair_chain(spark, sf_dir):
    size = F.col("p_size")
    filters = F.when(size > 10, F.array(F.lit("adeclick"), F.lit("afftdn"), F.lit("bandreject"))).otherwise(F.array(F.lit("adeclick"), F.lit("afftdn")))
    strength = F.when(F.col("p_partkey") % 2 == 0, "LIGHT").otherwise("MEDIUM")
    c = _parts(spark, sf_dir).select("p_partkey", N.repair_chain(F.col("found"), strength, F.lit(20.0), F.when(size % 4 == 0, 10.0).otherwise(30.0), filters).alias("c"))
    return c.select("p_partkey", F.array_join("c.chain", ",").alias("chain"), F.size("c.warnings").alias("n_warnings"))


@query(f"""WITH p AS (SELECT *, {_FOUND} AS found, ['OFF', 'AUTO', 'LIGHT', 'MEDIUM', 'AUTO'][CAST(p_partkey % 5 + 1 AS INTEGER)] AS mode, ['CLEAN', 'LIGHT_REPAIR', 'MEDIUM_REPAIR', 'NEEDS_REVIEW'][CAST(p_size % 4 + 1 AS INTEGER)] AS decision FROM part),
w AS (SELECT *, CASE WHEN mode IN ('LIGHT', 'MEDIUM') THEN mode ELSE replace(decision, '_REPAIR', '') END AS wanted FROM p),
a AS (SELECT *, CASE WHEN wanted = 'MEDIUM' AND p_size % 7 = 0 THEN 'LIGHT' ELSE wanted END AS used FROM w),
r AS (SELECT *, CASE WHEN mode = 'OFF' THEN 'CLEAN' WHEN mode = 'AUTO' AND decision IN ('CLEAN', 'NEEDS_REVIEW') THEN decision WHEN p_size = 1 THEN 'NEEDS_REVIEW' WHEN len(found) = 0 THEN 'CLEAN'
WHEN (used = 'MEDIUM' AND p_size % 7 = 0) OR (used <> 'MEDIUM' AND p_size % 11 = 0) THEN 'NEEDS_REVIEW' ELSE 'REPAIRED_' || used END AS result FROM a)
SELECT p_partkey, CASE WHEN starts_with(result, 'REPAIRED_') THEN used ELSE 'OFF' END AS applied, result FROM r""")
def noise_routing(spark, sf_dir):
    size, found = F.col("p_size"), F.col("found")
    guard = lambda n: F.when(size % n == 0, F.array(F.lit("level"))).otherwise(F.array().cast("array<string>"))
    r = N.route_repair(F.col("mode"), F.col("decision"), found, F.size(found), size != 1, guard(7), guard(11))
    return _parts(spark, sf_dir).select("p_partkey", r.alias("r")).select("p_partkey", "r.applied", "r.result")


@query("""WITH t AS (SELECT o_orderkey, s, (o_orderkey + s) % 4 = 0 OR (o_orderkey % 9 <> 0 AND s = 25) AS ok FROM orders, (SELECT unnest([100, 75, 50, 25, 0]) AS s)),
c AS (SELECT o_orderkey, coalesce(max(s) FILTER (ok AND s > 0), 0) AS strength FROM t GROUP BY o_orderkey)
SELECT o_orderkey, CAST(strength AS INTEGER) AS strength, CAST(CASE WHEN strength = 0 THEN 4 ELSE 4 - strength / 25 END AS INTEGER) AS retries, CASE WHEN strength = 0 THEN 'crest / 25' ELSE '' END AS reasons FROM c""")
def strength_ladder(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*map(F.lit, N.STRENGTHS))).alias("strength"))
    ok = ((F.col("o_orderkey") + F.col("strength")) % 4 == 0) | ((F.col("o_orderkey") % 9 != 0) & (F.col("strength") == 25))
    issues = F.when(ok, F.array().cast("array<string>")).otherwise(F.array(F.lit("crest"), F.col("strength").cast("string")))
    return N.strength_ladder(o.select("o_orderkey", "strength", issues.alias("issues")), "o_orderkey")


@query("""WITH n AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS passed, count(*) FILTER (o_orderpriority = '1-URGENT') AS fixed, count(*) FILTER (o_orderkey % 3 > 0) AS safe FROM orders GROUP BY o_custkey)
SELECT o_custkey, passed = total AS ready, CASE WHEN passed = total THEN 'Ready for release' ELSE 'Some tracks on hold' END || chr(10) || 'Tracks: ' || total || chr(10) || 'PASS: ' || passed || chr(10) || 'Fixed: ' || fixed || chr(10) || 'Review: ' || (total - passed) || chr(10) || 'Codec safe: ' || safe || '/' || total AS text FROM n""")
def batch_verdict(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "P", "NEEDS_REVIEW").otherwise("READY")
    rows = table(spark, sf_dir, "orders").select("o_custkey", status.alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("fixed"), (F.col("o_orderkey") % 3 > 0).alias("codec_safe"))
    return N.batch_verdict(rows, "o_custkey")


@query("""WITH s AS (SELECT p_partkey, p_brand, p_size, list_filter([CASE WHEN p_size % 2 > 0 THEN 'transparent mastering' END, CASE WHEN p_size % 3 = 0 THEN 'Tail repair' END, CASE WHEN p_size % 5 > 0 THEN 'Codec safety check' END], lambda v: v IS NOT NULL) AS t FROM part)
SELECT p_partkey, 'Unresolved: ' || p_partkey || chr(10) || 'Profile: ' || p_brand || chr(10) || 'Steps done:' || chr(10) || CASE WHEN len(t) = 0 THEN '- basic mastering and quality validation' ELSE array_to_string(list_transform(t, lambda v: '- ' || v), chr(10)) END || chr(10) || 'Issues left:' || chr(10) || '- clipped' AS text FROM s""")
def unresolved_text(spark, sf_dir):
    size = F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (size % 2).alias("transparent_render_count"), F.when(size % 3 == 0, "fade").otherwise(" none ").alias("tail_fix_mode"), (size % 5).alias("codec_check_count"))
    return p.select("p_partkey", N.unresolved_text(F.col("p_partkey").cast("string"), F.col("p_brand"), N.attempted_steps(p), F.array(F.lit("clipped"))).alias("text"))


@query("SELECT c_custkey, coalesce(nullif(greatest(5.0, least(30.0, CASE WHEN c_nationkey = 0 THEN 15 ELSE c_nationkey * 2 END)), 0), 15)::DOUBLE AS seconds, CASE WHEN c_custkey % 2 = 0 THEN 'kept=1,mode=LIGHT' ELSE 'kept=1,mode=OFF' END AS merged FROM customer")
def settings_merge(spark, sf_dir):
    m = F.create_map(F.lit("kept"), F.lit("1"), F.lit("mode"), F.lit("OFF"))
    new = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("mode"), N.repair_mode(F.lit("light"))))
    merged = F.array_join(F.transform(F.array_sort(F.map_entries(N.merge_settings(m, new))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return table(spark, sf_dir, "customer").select("c_custkey", N.intro_seconds(F.col("c_nationkey") * 2).alias("seconds"), merged.alias("merged"))


@query("""WITH p AS (SELECT p_partkey, p_size, [1.15, 1.08, 1.0, 0.78, 0.4][CAST(p_size % 5 + 1 AS INTEGER)]::DOUBLE AS f0, (p_partkey % 10 + 1) / 10.0::DOUBLE AS lim, -1.0 - (p_partkey % 7) / 10.0::DOUBLE AS most FROM part),
f AS (SELECT *, greatest(0.3::DOUBLE, f0 * 0.65) AS f1, greatest(0.3::DOUBLE, greatest(0.3::DOUBLE, f0 * 0.65) * 0.65) AS f2 FROM p),
n AS (SELECT *, CASE WHEN f0 <= lim THEN 0 WHEN f1 <= lim OR abs(f2 - f1) <= 0.01 THEN 1 ELSE 2 END AS k FROM f),
v AS (SELECT *, CASE k WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END AS v FROM n)
SELECT p_partkey, round(v, 6) AS factor, CAST(k AS INTEGER) AS retries, CASE WHEN v <= lim THEN 'compressed' ELSE 'transparent' END AS mode,
round(CASE WHEN -1.0 <= most + 0.05 THEN -1.0 WHEN -1.2 <= most + 0.05 THEN -1.2 ELSE -1.4 END::DOUBLE, 6) AS ceiling, -1.4 <= most + 0.05 AS codec_safe FROM v""")
def compression_ladder(spark, sf_dir):
    start = F.element_at(F.array(*map(F.lit, (1.15, 1.08, 1.0, 0.78, 0.4))), (F.col("p_size") % 5 + 1).cast("int"))
    limit, most = (F.col("p_partkey") % 10 + 1) / 10.0, -1.0 - (F.col("p_partkey") % 7) / 10.0
    p = table(spark, sf_dir, "part").select("p_partkey", N.compression_ladder(start, lambda f: f <= limit).alias("f"), N.ceiling_ladder(F.lit(-1.0), lambda c: c <= most + 0.05).alias("c"))
    return p.select("p_partkey", F.round("f.factor", 6).alias("factor"), "f.retries", "f.mode", F.round("c.value", 6).alias("ceiling"), F.col("c.ok").alias("codec_safe"))
