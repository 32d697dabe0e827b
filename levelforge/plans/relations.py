"""Joins, set operations, reports, profiles, queue and text over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.levels import html_escape, json_number
from ..operators import profiles, reports
from ..operators import rules as R
from .registry import query, table

#: ``part`` as profiles: each inherits from the part of half its key; some say "limits" as a value, some as a map, some a map within it.
_PROFILES = """own AS (SELECT CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_partkey > 1 THEN CAST(p_partkey // 2 AS VARCHAR) END AS inherits,
  CASE p_size % 5 WHEN 0 THEN 'limits' WHEN 1 THEN 'limits.a' WHEN 2 THEN 'limits.b' WHEN 3 THEN 'limits.a.x' ELSE 'target' END AS key, CAST(p_size AS DOUBLE) AS value FROM part),
p AS (SELECT name, CASE WHEN inherits IN (SELECT name FROM own) THEN inherits END AS inherits, key, value FROM own)"""


@query(f"""WITH RECURSIVE {_PROFILES},
up AS (SELECT name, name AS at, 0 AS depth FROM p UNION ALL SELECT up.name, p.inherits, depth + 1 FROM up JOIN p ON up.at = p.name WHERE p.inherits IS NOT NULL),
l AS (SELECT up.name, key, depth, value FROM up JOIN p ON up.at = p.name),
near AS (SELECT name, key, min(depth) AS depth, arg_min(value, depth) AS value FROM l GROUP BY name, key)
SELECT name, key, value FROM near WHERE NOT EXISTS (SELECT 1 FROM near AS o WHERE o.name = near.name AND o.depth < near.depth AND (starts_with(near.key, o.key || '.') OR starts_with(o.key, near.key || '.')))""")
def profile_inheritance(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    names = ["limits", "limits.a", "limits.b", "limits.a.x", "target"]
    part = table(spark, sf_dir, "part").select(key.cast("string").alias("name"), F.when(key > 1, F.expr("p_partkey div 2").cast("string")).alias("inherits"), F.get(F.array(*map(F.lit, names)), size % 5).alias("key"), size.cast("double").alias("value"))
    there = part.select(F.col("name").alias("inherits"), F.lit(True).alias("there")).distinct()
    known = part.join(there, "inherits", "left").withColumn("inherits", F.when(F.col("there"), F.col("inherits")))
    return profiles.resolve(known)


@query("""WITH c AS (SELECT upper(trim(r_name)) AS key, r_name AS label, -14.0 - r_regionkey AS target, 2.0 AS concession, 6.0 + r_regionkey AS lra, 3.0 + r_regionkey AS w, r_regionkey / 4.0 AS scale FROM region),
g AS (SELECT DISTINCT upper(trim(c_mktsegment)) AS key, c_mktsegment AS label, CAST(length(c_mktsegment) AS DOUBLE) AS lra, length(c_mktsegment) / 2.0 AS w, 1 + length(c_mktsegment) / 10.0 AS ratio FROM customer)
SELECT 'CG_' || c.key || '__' || g.key AS key, c.label || ' + ' || g.label AS label, c.target::DOUBLE AS target, (c.target - c.concession)::DOUBLE AS min_target, round(0.55 * c.lra::DOUBLE + 0.45 * g.lra::DOUBLE, 1) AS target_lra, least(c.w, g.w)::DOUBLE AS max_wet,
least(c.w + 1, g.w)::DOUBLE AS max_dense, least(c.w / 4, g.w / 3)::DOUBLE AS max_lra_reduction, round(CAST(1 + (g.ratio - 1) * c.scale AS DOUBLE), 3) AS ratio FROM c, g""")
def catalog_cross(spark, sf_dir):
    """Every region as a channel with every segment as a genre."""
    k, s = F.col("r_regionkey").cast("double"), F.col("c_mktsegment")
    channel = {"key": F.upper(F.trim("r_name")), "label": F.col("r_name"), "target": -14.0 - k, "concession": F.lit(2.0), "lra": 6.0 + k, "max_wet": 3.0 + k, "max_dense": 4.0 + k, "max_lra_reduction": (3.0 + k) / 4, "scale": k / 4.0}
    size = F.length(s)
    genre = {"key": F.upper(F.trim(s)), "label": s, "lra": size.cast("double"), "max_wet": size / 2.0, "max_dense": size / 2.0, "max_lra_reduction": size / 6.0, "ratio": 1 + size / 10.0}
    named = lambda d: [x.alias(n) for n, x in d.items()]
    return profiles.compose(table(spark, sf_dir, "region").select(named(channel)), table(spark, sf_dir, "customer").select(s).distinct().select(named(genre)))


@query("SELECT c_custkey, coalesce(n_name, 'DEFAULT') AS profile FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def default_profile_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey < 3")
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("DEFAULT")).alias("profile"))


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderpriority END AS lra, 'v1' AS version FROM orders), m AS (SELECT l_orderkey, CAST(count(*) AS VARCHAR) AS lra, CAST(max(l_linenumber) AS VARCHAR) AS codec FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN l_orderkey IS NOT NULL THEN m.lra ELSE coalesce(nullif(trim(r.lra), ''), '0') END AS lra, CASE WHEN l_orderkey IS NOT NULL THEN codec ELSE 'none' END AS codec, 'v2' AS version FROM r LEFT JOIN m ON o_orderkey = l_orderkey""")
def patch_report(spark, sf_dir):
    lra = F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority"))
    r = table(spark, sf_dir, "orders").select("o_orderkey", lra.alias("lra"), F.lit("v1").alias("version"))
    m = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lra"), F.max("l_linenumber").alias("codec"))
    return reports.patch(r, m, "o_orderkey", {"version": F.lit("v2")}, {"lra": F.lit("0"), "codec": F.lit("none")})


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'final' WHEN p_size > 20 THEN 'review' ELSE 'draft' END AS found, CASE WHEN p_size > 40 THEN 0 WHEN p_size > 20 THEN 1 ELSE 2 END AS priority FROM part")
def first_existing(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    places = [p.where(c).select("p_partkey", F.lit(n).alias("found")) for c, n in (("p_size > 40", "final"), ("p_size > 20", "review"), ("true", "draft"))]
    return reports.first_existing(places, "p_partkey", "found")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus IN ('O', 'P')) AS busy FROM customer""")
def duplicate_guard(spark, sf_dir):
    """Customers with a waiting or running job may not be added again: semi join and anti join."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    open_ = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).select(F.col("o_custkey").alias("c_custkey"))
    return c.join(open_, "c_custkey", "left_semi").withColumn("busy", F.lit(True)).unionByName(c.join(open_, "c_custkey", "left_anti").withColumn("busy", F.lit(False)))


@query("SELECT event_id, event_type, CASE WHEN value > 300 THEN 'too loud' ELSE '' END AS error, CASE WHEN value > 300 THEN '' ELSE 'READY' END AS disposition FROM events")
def union_error_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ok = e.where("NOT value > 300").select("event_id", "event_type", F.lit("READY").alias("disposition"))
    return reports.with_errors(ok, e.where("value > 300").select("event_id", "event_type", F.lit("too loud").alias("error")))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def created_files_except(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id, CAST((quality = 1)::INT + (toxic = 1)::INT AS INTEGER) AS n_found, list_contains([CASE WHEN quality = 1 THEN 'HISS' END, CASE WHEN toxic = 1 THEN 'HUM' END], 'HISS') AS any_of FROM labels")
def detected_intersect(spark, sf_dir):
    found = F.array_compact(F.array(F.when(F.col("quality") == 1, "HISS"), F.when(F.col("toxic") == 1, "HUM")))
    return table(spark, sf_dir, "labels").select("doc_id", F.size(found).alias("n_found"), F.arrays_overlap(found, F.array(F.lit("HISS"), F.lit("STATIC"))).alias("any_of"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other FROM orders GROUP BY o_orderpriority")
def status_counts(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(s == "F").alias("finished"), F.count_if(s == "O").alias("open"), F.count_if(~s.isin("F", "O")).alias("other"))


@query("SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O') WHERE place <= 2")
def fifo_admission(spark, sf_dir):
    return reports.admit(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), 2, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


_STATE = "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'RUNNING' ELSE 'WAITING' END"


@query(f"SELECT o_orderkey, CASE WHEN {_STATE} = 'RUNNING' THEN 'WAITING' ELSE {_STATE} END AS status, {_STATE} = 'RUNNING' AS recovered FROM orders")
def orphan_recovery(spark, sf_dir):
    s = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("WAITING")
    from ..streaming.queue import recover

    return recover(table(spark, sf_dir, "orders").select("o_orderkey", s.alias("status"))).select("o_orderkey", "status", "recovered")


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id FROM events), f AS (SELECT user_id, list(CASE event_type WHEN 'purchase' THEN 'finish' WHEN 'click' THEN 'start' WHEN 'view' THEN 'start' WHEN 'signup' THEN 'cancel' ELSE 'fail' END ORDER BY ts, event_id) AS ks FROM e GROUP BY user_id)
SELECT user_id, CAST(len(ks) AS INTEGER) AS n, list_reduce(list_prepend('WAITING', ks), lambda s, k: CASE WHEN s = 'WAITING' AND k = 'start' THEN 'RUNNING' WHEN s = 'RUNNING' AND k = 'finish' THEN 'COMPLETED' WHEN s = 'RUNNING' AND k = 'fail' THEN 'FAILED' WHEN s IN ('WAITING', 'RUNNING') AND k = 'cancel' THEN 'CANCELLED' ELSE s END) AS status FROM f""")
def queue_replay(spark, sf_dir):
    """Each user's events as a job's: start, finish, fail, cancel; the state after all of them."""
    from ..streaming.queue import replay

    kind = F.when(F.col("event_type") == "purchase", "finish").when(F.col("event_type").isin("click", "view"), "start").when(F.col("event_type") == "signup", "cancel").otherwise("fail")
    return replay(table(spark, sf_dir, "events").select(F.col("user_id"), kind.alias("kind"), "ts", "event_id"), "user_id", "ts", "event_id")


@query("SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey) AS track FROM part")
def sorted_names(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.lower("p_name"), "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.row_number().over(w).cast("long").alias("track"))


@query("SELECT r_name, CASE r_name WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 3 END AS place FROM region")
def display_order(spark, sf_dir):
    """Fixed order first, the rest after it."""
    at = F.array_position(F.array(F.lit("EUROPE"), F.lit("ASIA")), F.col("r_name"))
    return table(spark, sf_dir, "region").select("r_name", F.when(at == 0, 3).otherwise(at).cast("int").alias("place")).orderBy("place", "r_name")


_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(rf"""SELECT doc_id, lower(split_part('track ' || doc_id || '.WAV', '.', -1)) AS suffix, {_ESCAPED} AS html, regexp_replace('made by v3.8.1 on v2.0', 'v[0-9]+(\.[0-9]+)*', 'v3.9', 'g') AS version,
right(text, 20) AS ending, lang || ' / ' || source AS joined FROM documents""")
def report_text(spark, sf_dir):
    """Suffix, escaped text, renewed version, end and joined labels of every document."""
    name = F.concat(F.lit("track "), F.col("doc_id").cast("string"), F.lit(".WAV"))
    suffix, version = F.lower(F.element_at(F.split(name, r"\."), -1)), F.regexp_replace(F.lit("made by v3.8.1 on v2.0"), r"v[0-9]+(\.[0-9]+)*", "v3.9")
    joined = F.concat("lang", F.lit(" / "), "source")
    return table(spark, sf_dir, "documents").select("doc_id", suffix.alias("suffix"), html_escape(F.col("text")).alias("html"), version.alias("version"), F.right("text", F.lit(20)).alias("ending"), joined.alias("joined"))


@query(f"""SELECT doc_id, {_ESCAPED} AS html, left(text, 40) AS beginning, right(text, 20) AS ending FROM documents""")
def report_text_whole(spark, sf_dir):
    """The whole text of every document escaped, and its two ends: what ``report_text`` leaves out."""
    return table(spark, sf_dir, "documents").select("doc_id", html_escape(F.col("text")).alias("html"), F.left("text", F.lit(40)).alias("beginning"), F.right("text", F.lit(20)).alias("ending"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN value > 400 THEN NULL ELSE round(value, 4) END AS safe, CASE WHEN value > 400 THEN NULL ELSE CAST(json_extract('{\"input_i\": ' || round(value, 2) || '}', '$.input_i') AS DOUBLE) END AS last_block FROM events")
def json_fields(spark, sf_dir):
    """A JSON field, a number made safe for JSON, and the last block of its kind in a text."""
    infinite = F.when(F.col("value") > 400, float("inf")).otherwise(F.round("value", 4))
    text = F.concat(F.lit('x {"input_i": 1.5} y '), F.when(F.col("value") <= 400, F.concat(F.lit('{"input_i": '), F.round("value", 2).cast("string"), F.lit("}"))).otherwise(F.lit('{"input_i": null}')))
    block = F.from_json(F.element_at(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\"input_i\"[^{}]*\})"), F.lit(1)), -1), "input_i double")
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), json_number(infinite).alias("safe"), block["input_i"].alias("last_block"))


@query("""SELECT event_id, CASE WHEN value <= 400 THEN round(value, 4) END AS in_map, CASE WHEN event_id % 5 > 0 AND value <= 300 THEN round(value, 3) END AS in_struct, event_id % 5 = 0 AS no_struct, event_type AS beside FROM events""")
def json_nested(spark, sf_dir):
    """Numbers made safe for JSON three levels down: in a list of structs with a map of lists, and in a struct that may be null."""
    from ..sources.tables import json_safe

    v = F.col("value")
    deep = F.array(F.struct(F.create_map(F.lit("k"), F.array(F.when(v > 400, float("nan")).otherwise(F.round(v, 4)))).alias("m"), F.col("event_type").alias("t")))
    inner = F.when(F.col("event_id") % 5 > 0, F.struct(F.struct(F.when(v > 300, float("-inf")).otherwise(F.round(v, 3)).alias("x")).alias("s")))
    safe = json_safe(table(spark, sf_dir, "events").select("event_id", deep.alias("deep"), inner.alias("inner")))
    return safe.select("event_id", F.col("deep")[0]["m"]["k"][0].alias("in_map"), F.col("inner.s.x").alias("in_struct"), F.col("inner").isNull().alias("no_struct"), F.col("deep")[0]["t"].alias("beside"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 0 END AS codec, CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 1 END AS fullness, CASE WHEN o_orderpriority LIKE '1%' THEN 3 ELSE 1 END AS gates FROM orders")
def retry_policy(spark, sf_dir):
    mode = F.when(F.col("o_orderpriority").startswith("1"), "QUALITY+").otherwise("FAST")
    p = table(spark, sf_dir, "orders").select("o_orderkey", R.retry_policy(mode, F.lit(4), F.lit(2)).alias("p"))
    return p.select("o_orderkey", "p.codec", "p.fullness", F.col("p.transparent_gates").alias("gates"))


@query("""WITH s AS (SELECT l_suppkey, count(*) AS n, round(max(l_extendedprice) / 1000, 6) AS p, round(avg(l_discount) * 100, 6) AS d FROM lineitem GROUP BY l_suppkey)
SELECT a.l_suppkey, array_to_string(list_filter([CASE WHEN abs(b.n - a.n) > 20 THEN 'duration changed' END, CASE WHEN b.p - 95 > 0.01 THEN 'new clipping' END, CASE WHEN abs(b.d - a.d) > 4.5 THEN 'RMS change exceeds 4.5 dB' END,
CASE WHEN 20 * log10(b.d / 10) - 20 * log10(a.d / 10) < -2.5 THEN 'high-frequency loss exceeds 2.5 dB' END], lambda x: x IS NOT NULL), ', ') AS issues FROM s a JOIN s b ON b.l_suppkey = a.l_suppkey + 1""")
def integrity_guard(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.max("l_extendedprice") / 1000, 6).alias("p"), F.round(F.avg("l_discount") * 100, 6).alias("d"))
    b = s.select((F.col("l_suppkey") - 1).alias("l_suppkey"), *(F.col(c).alias(f"{c}2") for c in "npd"))
    c = F.col
    issues = R.integrity_issues((c("n2") - c("n")) / 2000.0, F.lit(0), F.lit(0), c("p2") - 95, c("d2") - c("d"), c("d") / 10, c("d2") / 10)
    return s.join(b, "l_suppkey").select("l_suppkey", F.array_join(issues, ", ").alias("issues"))
