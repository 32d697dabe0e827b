"""Signal metrics and transforms of frames: ``embeddings`` as 64 samples, even places left, odd right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import db
from ..operators import arrays as A
from ..operators import rules as R
from .registry import query, table

X = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"
#: Frames as the SQL sees them: x all samples, l and r the sides, m the mean of both.
BASE = f"""WITH x AS (SELECT vec_id, label, {X} AS x FROM embeddings),
f AS (SELECT *, list_filter(x, lambda v, i: i % 2 = 1) AS l, list_filter(x, lambda v, i: i % 2 = 0) AS r FROM x),
"""


def _db(e: str) -> str:
    return f"(CASE WHEN ({e}) <= 0 THEN CAST('-infinity' AS DOUBLE) ELSE 20 * log10({e}) END)"


def _rms(e: str) -> str:
    return f"sqrt(list_sum(list_transform({e}, lambda v: v * v)) / len({e}))"


def _peak(e: str) -> str:
    return f"list_max(list_transform({e}, lambda v: abs(v)))"


def frames(spark, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return x.withColumns({"l": A.left(F.col("x")), "r": A.right(F.col("x"))})


def r6(x: Column, name: str) -> Column:
    return F.round(x, 6).alias(name)


@query(BASE + f"""g AS (SELECT *, {_peak('x')} AS p, {_rms('x')} AS q FROM f)
SELECT vec_id, round({_db('p')}, 6) AS peak_dbfs, round({_db('q')}, 6) AS rms_dbfs, round(CASE WHEN q = 0 THEN 0 ELSE {_db('p')} - {_db('q')} END, 6) AS crest_db,
CAST(len(list_filter(x, lambda v: abs(v) >= 1.0)) AS INTEGER) AS clipped FROM g""")
def level_metrics(spark, sf_dir):
    x = F.col("x")
    return frames(spark, sf_dir).select("vec_id", r6(db(A.peak(x)), "peak_dbfs"), r6(db(A.rms(x)), "rms_dbfs"), r6(A.crest_db(x), "crest_db"), A.clipped(x).alias("clipped"))


@query(BASE + """g AS (SELECT *, list_sum(l) / len(l) AS dl, list_sum(r) / len(r) AS dr FROM f)
SELECT vec_id, round(dl, 6) AS dc_left, round(dr, 6) AS dc_right, round(greatest(abs(dl), abs(dr)), 6) AS max_dc, greatest(abs(dl), abs(dr)) > 0.0001 AS applied,
round(list_sum(list_transform(l, lambda v: (v - dl) * (v - dl))), 6) AS left_energy FROM g""")
def dc_offset_removed(spark, sf_dir):
    f = frames(spark, sf_dir).withColumns({"dl": A.mean(F.col("l")), "dr": A.mean(F.col("r"))})
    most = F.greatest(F.abs("dl"), F.abs("dr"))
    return f.select("vec_id", r6(F.col("dl"), "dc_left"), r6(F.col("dr"), "dc_right"), r6(most, "max_dc"), (most > 1e-4).alias("applied"), r6(A.total(A.remove_dc(F.col("l")), lambda v: v * v), "left_energy"))


@query(BASE + f"""g AS (SELECT *, CAST(len(l) AS DOUBLE) AS n, list_sum(l) AS sx, list_sum(r) AS sy, list_sum(list_transform(l, lambda v: v * v)) AS sxx, list_sum(list_transform(r, lambda v: v * v)) AS syy,
list_sum(list_transform(l, lambda v, i: v * r[i])) AS sxy, list_transform(l, lambda v, i: (v - r[i]) / 2) AS s, list_transform(l, lambda v, i: (v + r[i]) / 2) AS m FROM f)
SELECT vec_id, round(CASE WHEN sxx - sx * sx / n <= 1e-12 OR syy - sy * sy / n <= 1e-12 THEN 1 ELSE (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END, 6) AS correlation,
round({_db(f"{_rms('s')} / greatest({_rms('m')}, 2.2250738585072014e-308)")}, 6) AS side_to_mid_db FROM g""")
def stereo_correlation(spark, sf_dir):
    return frames(spark, sf_dir).select("vec_id", r6(A.stereo_correlation(F.col("l"), F.col("r")), "correlation"), r6(A.side_to_mid_db(F.col("l"), F.col("r")), "side_to_mid_db"))


@query(BASE + """g AS (SELECT *, list_transform(l, lambda v, i: greatest(abs(v), abs(r[i]))) AS e FROM f),
h AS (SELECT vec_id, len(e) AS n, list_filter(list_transform(e, lambda v, i: CASE WHEN v > 0.2 THEN i - 1 END), lambda i: i IS NOT NULL) AS on_ FROM g)
SELECT vec_id, CASE WHEN len(on_) = 0 THEN n * 1000.0 / 48000 ELSE round(list_min(on_) * 1000.0 / 48000, 6) END::DOUBLE AS leading_ms, CASE WHEN len(on_) = 0 THEN n * 1000.0 / 48000 ELSE round((n - 1 - list_max(on_)) * 1000.0 / 48000, 6) END::DOUBLE AS trailing_ms FROM h""")
def silence_edges(spark, sf_dir):
    """Edges below an amplitude of 0.2: the frames hold no silence under the default threshold."""
    envelope = F.zip_with("l", "r", lambda a, b: F.greatest(F.abs(a), F.abs(b)))
    first, last = A.edge_silence_ms(envelope, 48_000, -13.979400086720375)
    return frames(spark, sf_dir).select("vec_id", r6(first.cast("double"), "leading_ms"), r6(last.cast("double"), "trailing_ms"))


@query(BASE + f"""g AS (SELECT *, list_slice(x, len(x) - 15, len(x)) AS t FROM f),
h AS (SELECT vec_id, {_db(_rms('t'))} AS e, {_db('abs(x[len(x)])')} AS s FROM g)
SELECT vec_id, round(e, 6) AS end_rms_db, round(s, 6) AS last_db, s > -60 AND e > -60 AS hard_cut, e > -17 AS energetic FROM h""")
def tail_metrics(spark, sf_dir):
    t = A.tail(F.col("x"), 16)
    f = frames(spark, sf_dir).select("vec_id", db(A.rms(t)).alias("e"), db(F.abs(F.element_at("x", -1))).alias("s"))
    return f.select("vec_id", r6(F.col("e"), "end_rms_db"), r6(F.col("s"), "last_db"), ((F.col("s") > -60) & (F.col("e") > -60)).alias("hard_cut"), (F.col("e") > -17).alias("energetic"))


@query(BASE + """p AS (SELECT vec_id, i, v FROM (SELECT vec_id, unnest(generate_series(1, len(l))) AS i, unnest(l) AS v FROM f)),
q AS (SELECT vec_id, i, v FROM (SELECT vec_id, unnest(generate_series(1, len(r))) AS i, unnest(r) AS v FROM f)),
c AS (SELECT p.vec_id, CAST(q.i - p.i AS INTEGER) AS lag, round(sum(p.v * q.v), 9) AS s FROM p JOIN q ON p.vec_id = q.vec_id AND q.i - p.i BETWEEN -8 AND 8 GROUP BY ALL)
SELECT vec_id, lag, round(s, 6) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, lag) AS k FROM c) WHERE k = 1""")
def lag_correlation(spark, sf_dir):
    """The lag within 8 samples at which the right side follows the left best; ties to the smaller lag."""
    span = F.sequence(F.lit(-8), F.lit(8))

    def at(lag):
        moved = F.transform("l", lambda v, i: F.when((i + lag >= 0) & (i + lag < F.size("r")), v * F.get("r", (i + lag).cast("int"))).otherwise(F.lit(0.0)))
        return F.struct(F.round(A.total(moved), 9).alias("s"), (-lag).alias("back"))

    best = F.array_max(F.transform(span, at))
    return frames(spark, sf_dir).select("vec_id", best.alias("b")).select("vec_id", (-F.col("b.back")).alias("lag"), r6(F.col("b.s"), "strength"))


@query(BASE + """d AS (SELECT *, CAST(vec_id % 7 - 3 AS INTEGER) AS d FROM f),
g AS (SELECT vec_id, d, CASE WHEN d >= 0 THEN list_concat(list_slice(x, d + 1, len(x)), list_transform(generate_series(1, d), lambda i: 0.0::DOUBLE)) ELSE list_concat(list_transform(generate_series(1, -d), lambda i: 0.0::DOUBLE), list_slice(x, 1, len(x) + d)) END AS y FROM d)
SELECT vec_id, d AS delay, CAST(len(y) AS INTEGER) AS n, round(y[1], 6) AS first_sample, round(y[len(y)], 6) AS last_sample, round(list_sum(y), 6) AS total FROM g""")
def delay_shift(spark, sf_dir):
    d = (F.col("vec_id") % 7 - 3).cast("int")
    f = frames(spark, sf_dir).select("vec_id", d.alias("delay"), A.delay(F.col("x"), d).alias("y"))
    return f.select("vec_id", "delay", F.size("y").alias("n"), r6(F.get("y", F.lit(0)), "first_sample"), r6(F.element_at("y", -1), "last_sample"), r6(A.total(F.col("y")), "total"))


@query(BASE + """g AS (SELECT vec_id, list_transform(x, lambda v, i: CASE WHEN i <= len(x) - 16 THEN v WHEN i = len(x) THEN 0.0 ELSE v * (len(x) - i) / 15 END) AS y FROM f)
SELECT vec_id, round(y[len(y)], 6) AS last_sample, round(y[len(y) - 8], 6) AS inner_sample, round(list_sum(list_transform(y, lambda v: v * v)), 6) AS energy FROM g""")
def fade_tail(spark, sf_dir):
    f = frames(spark, sf_dir).select("vec_id", A.fade_out(F.col("x"), 16).alias("y"))
    return f.select("vec_id", r6(F.element_at("y", -1), "last_sample"), r6(F.element_at("y", -9), "inner_sample"), r6(A.total(F.col("y"), lambda v: v * v), "energy"))


@query(BASE + """g AS (SELECT vec_id, list_concat(x, list_transform(generate_series(1, 20), lambda i: 0.0::DOUBLE)) AS y FROM f),
h AS (SELECT vec_id, y, coalesce(list_max(list_filter(list_transform(y, lambda v, i: CASE WHEN abs(v) > 0.05 THEN i END), lambda i: i IS NOT NULL)), 0) AS last FROM g)
SELECT vec_id, CAST(len(y) AS INTEGER) AS padded, CAST(least(len(y), last + 4) AS INTEGER) AS trimmed FROM h""")
def tail_pad_trim(spark, sf_dir):
    f = frames(spark, sf_dir).select("vec_id", A.pad_tail(F.col("x"), 20).alias("y"))
    return f.select("vec_id", F.size("y").alias("padded"), F.size(A.trim_tail(F.col("y"), 4, 0.05)).alias("trimmed"))


_FADED = "list_transform(x, lambda v, i: CASE WHEN i <= len(x) - n THEN v WHEN i = len(x) THEN 0.0 ELSE v * (len(x) - i) / (n - 1) END)"


@query(BASE + f"""c AS (SELECT vec_id, x, unnest([8, 16, 32, 64]) AS n FROM f),
t AS (SELECT vec_id, n, list_slice({_FADED}, len(x) - 15, len(x)) AS t FROM c),
e AS (SELECT vec_id, n, {_db(_rms('t'))} <= -22 AS pass FROM t)
SELECT vec_id, CAST(coalesce(min(n) FILTER (pass), max(n)) AS INTEGER) AS fade, CAST(count(*) FILTER (n <= coalesce(f, 64)) AS INTEGER) AS attempts FROM (SELECT *, min(n) FILTER (pass) OVER (PARTITION BY vec_id) AS f FROM e) GROUP BY vec_id""")
def fade_ladder_choice(spark, sf_dir):
    """The shortest fade after which the last 16 samples are under -22 dB, else the longest."""
    ladder = [8, 16, 32, 64]
    passes = F.array(*(F.when(db(A.rms(A.tail(A.fade_out(F.col("x"), n), 16))) <= -22, F.lit(n)) for n in ladder))
    fade = F.coalesce(F.array_min(passes), F.lit(ladder[-1]))
    f = frames(spark, sf_dir).select("vec_id", fade.alias("fade"))
    return f.select("vec_id", "fade", F.size(F.filter(F.array(*map(F.lit, ladder)), lambda n: n <= F.col("fade"))).alias("attempts"))


@query(BASE + f"""g AS (SELECT vec_id, x, list_transform(x, lambda v: v * pow(10.0::DOUBLE, -3.0 / 20)) AS g, list_transform(x, lambda v: tanh(v * 1.35) / tanh(1.35)) AS s,
list_transform(x, lambda v: CASE WHEN abs(v) > pow(10.0::DOUBLE, -18.0 / 20) THEN sign(v) * (pow(10.0::DOUBLE, -18.0 / 20) + (abs(v) - pow(10.0::DOUBLE, -18.0 / 20)) / 1.25) ELSE v END) AS d FROM f),
h AS (SELECT *, {_rms('x')} AS q, {_rms('s')} AS qs, {_rms('d')} AS qd FROM g),
k AS (SELECT vec_id, g, list_transform(x, lambda v, i: v * 0.8 + s[i] * (q / qs) * 0.2) AS s, list_transform(x, lambda v, i: v * 0.9 + d[i] * (q / qd) * 0.1) AS d FROM h)
SELECT vec_id, round({_db(_peak('g'))}, 5) AS gain_peak_db, round({_db(_peak('s'))}, 5) AS saturated_peak_db, round({_db(_rms('s'))}, 5) AS saturated_rms_db, round({_db(_peak('d'))}, 5) AS dense_peak_db FROM k""")
def gain_saturation_density(spark, sf_dir):
    x = F.col("x")
    f = frames(spark, sf_dir).select("vec_id", A.gain(x, -3.0).alias("g"), A.saturate(x, 20.0).alias("s"), A.densify(x, 10.0).alias("d"))
    level = lambda v, name: F.round(db(v), 5).alias(name)
    return f.select("vec_id", level(A.peak(F.col("g")), "gain_peak_db"), level(A.peak(F.col("s")), "saturated_peak_db"), level(A.rms(F.col("s")), "saturated_rms_db"), level(A.peak(F.col("d")), "dense_peak_db"))


#: A frame's metrics for the gate, beside those of the next frame as its processed counterpart.
PAIRS = BASE + f"""m AS (SELECT vec_id, round({_db(_rms('x'))}, 9) AS lufs, round({_db(_peak('x'))}, 9) AS tp, round(list_sum(x) / len(x), 9) AS dc,
round(20 * log10(list_max(list_transform(x, lambda v: abs(v))) / {_rms('x')}), 9) AS crest, round({_db(_rms('list_slice(x, 49, 64)'))}, 9) AS tail, CAST(len(list_filter(x, lambda v: abs(v) >= 0.35)) AS INTEGER) AS clipped FROM f),
p AS (SELECT s.vec_id, o.lufs, o.tp, o.dc, o.clipped, o.tail, s.crest - o.crest AS crest_loss, s.tail - o.tail AS reduction, CAST(o.vec_id % 60 - 5 AS INTEGER) AS delay, o.vec_id % 2 = 0 AS consistent,
coalesce(s.tail - o.tail > 0.65 AND (o.tail < -20 OR s.crest - o.crest > 0.75), FALSE) AS risk FROM m s JOIN m o ON o.vec_id = s.vec_id + 1),
"""
_DELAY = "CASE WHEN abs(delay) <= 1 THEN 'PASS' WHEN abs(delay) <= 8 THEN 'INFO' WHEN abs(delay) <= 47 THEN 'WARN' WHEN NOT consistent THEN 'UNCERTAIN' ELSE 'FAIL' END"
GATE = PAIRS + f"""d AS (SELECT *, {_DELAY} AS delay_class FROM p),
i AS (SELECT *, list_filter([CASE WHEN abs(lufs + 18) > 0.6 THEN printf('LUFS target miss: %.2f LUFS (target -18.00 ±0.60)', lufs) END, CASE WHEN tp > -8.95 THEN printf('true peak exceeded: %.2f dBTP > -9.00 dBTP', tp) END,
CASE WHEN clipped > 0 THEN printf('clipped samples: %d', clipped) END, CASE WHEN abs(dc) > 0.04 THEN printf('DC offset too high: %.6f', abs(dc)) END, CASE WHEN delay_class = 'FAIL' THEN
printf('confirmed residual processing delay: %d samples (%.3f ms, confidence 1.00, windows [%d])', delay, abs(delay) / 48.0::DOUBLE, delay) END,
CASE WHEN risk THEN printf('DYNAMICS RISK: LRA reduced %.2f LU (preferred limit 0.60), final LRA %.2f LU, crest loss %.2f dB', reduction, tail, crest_loss) END], lambda x: x IS NOT NULL) AS issues,
list_filter([CASE WHEN delay_class = 'UNCERTAIN' THEN printf('large delay estimate is inconsistent: median %d samples, confidence 1.00, windows [%d]', delay, delay) END, CASE WHEN reduction > 1.5 THEN printf('LRA reduced by %.2f LU', reduction) END,
CASE WHEN delay_class = 'WARN' THEN printf('sub-millisecond delay estimate %d samples (%.3f ms); windows [%d], no audio shift applied', delay, abs(delay) / 48.0::DOUBLE, delay) END], lambda x: x IS NOT NULL) AS warnings FROM d),
g AS (SELECT *, CASE WHEN len(issues) > 0 THEN 'FAIL' WHEN len(warnings) > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM i),
z AS (SELECT *, CASE WHEN len(issues) > 0 OR len(list_filter(warnings, lambda w: NOT starts_with(w, 'sub-millisecond'))) > 0 THEN 'NEEDS_REVIEW' WHEN len(warnings) > 0 THEN 'READY_WITH_WARNING' ELSE 'READY' END AS disposition FROM g)
"""


def gated(spark, sf_dir) -> DataFrame:
    """Each frame as source, the next as its processed counterpart: issues, warnings, status and disposition."""
    x = F.col("x")
    r9 = lambda v: F.round(v, 9)
    m = frames(spark, sf_dir).select("vec_id", r9(db(A.rms(x))).alias("lufs"), r9(db(A.peak(x))).alias("tp"), r9(A.mean(x)).alias("dc"), r9(A.crest_db(x)).alias("crest"), r9(db(A.rms(A.tail(x, 16)))).alias("tail"), F.size(F.filter(x, lambda v: F.abs(v) >= 0.35)).alias("clipped"))
    o = m.select((F.col("vec_id") - 1).alias("vec_id"), *(F.col(c).alias(f"o_{c}") for c in m.columns[1:]), (F.col("vec_id") % 60 - 5).cast("int").alias("delay"), (F.col("vec_id") % 2 == 0).alias("consistent"))
    p = m.join(o, "vec_id")
    reduction, crest_loss = F.col("tail") - F.col("o_tail"), F.col("crest") - F.col("o_crest")
    delay = R.delay_class(F.col("delay"), F.col("consistent"), F.lit(1.0))
    p = p.withColumns({"delay_class": delay, "reduction": reduction, "crest_loss": crest_loss, "risk": R.dynamics_risk(reduction, F.col("o_tail"), crest_loss, min_lra=-20)})
    note = R.delay_note(F.col("delay"), F.col("consistent"), F.lit(1.0), F.array("delay"))
    seen = {"lufs": F.col("o_lufs"), "true_peak": F.col("o_tp"), "clipped": F.col("o_clipped"), "dc": F.abs(F.col("o_dc")), "delay": F.col("delay_class"), "delay_note": note}
    seen |= {"risk": F.col("risk"), "lra_reduction": F.col("reduction"), "lra": F.col("o_tail"), "crest_loss": F.col("crest_loss")}
    warnings = F.concat(R.gate_warnings({"delay": F.col("delay_class"), "delay_note": note, "lra_reduction": F.col("reduction")}), R.texts((F.col("delay_class") == "WARN", note)))
    p = p.withColumns({"issues": R.gate_issues(seen, -18.0, -9.0, lufs_tolerance=0.6, dc=0.04), "warnings": warnings})
    return p.withColumns({"status": R.gate_status(F.col("issues"), F.col("warnings")), "disposition": R.disposition(F.col("issues"), F.col("warnings"), F.lit(True))})


@query(GATE + "SELECT vec_id, array_to_string(issues, ' / ') AS issues, array_to_string(warnings, ' / ') AS warnings, status, disposition FROM z")
def quality_gate(spark, sf_dir):
    return gated(spark, sf_dir).select("vec_id", F.array_join("issues", " / ").alias("issues"), F.array_join("warnings", " / ").alias("warnings"), "status", "disposition")


@query(GATE + "SELECT disposition, count(*) AS n, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'WARN') AS warned, count(*) FILTER (status = 'FAIL') AS failed FROM z GROUP BY disposition")
def release_disposition(spark, sf_dir):
    return gated(spark, sf_dir).groupBy("disposition").agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("WARN", "warned"), ("FAIL", "failed"))))


@query(GATE + "SELECT count(*) AS total, count(*) FILTER (disposition = 'READY') AS ready, count(*) FILTER (disposition = 'READY_WITH_WARNING') AS ready_with_warning, count(*) - count(*) FILTER (disposition LIKE 'READY%') AS review, CASE WHEN disposition_bucket THEN 'ready' ELSE 'review' END AS bucket FROM (SELECT *, disposition LIKE 'READY%' AS disposition_bucket FROM z) GROUP BY disposition_bucket")
def batch_totals(spark, sf_dir):
    d = F.col("disposition")
    ready, safe = F.count_if(d == "READY"), F.count_if(d == "READY_WITH_WARNING")
    return gated(spark, sf_dir).groupBy(R.release_bucket(d).alias("bucket")).agg(F.count("*").alias("total"), ready.alias("ready"), safe.alias("ready_with_warning"), (F.count("*") - ready - safe).alias("review"))


@query(PAIRS + f"SELECT vec_id, {_DELAY} AS delay_class, risk FROM p".replace("),\nSELECT", ")\nSELECT").replace("+ 1),\n", "+ 1)\n"))
def delay_class_and_risk(spark, sf_dir):
    return gated(spark, sf_dir).select("vec_id", "delay_class", "risk")


_TAIL = """t AS (SELECT vec_id, round(CAST(vec_id % 150 AS DOUBLE), 3) AS diff, 0.0 AS delta, abs(x[64]) > 0.2 AS hard, FALSE AS energetic, round({last}, 9) AS last, round({rms} - 60, 9) AS end_rms FROM f)
SELECT vec_id, CASE WHEN delta > 0 OR diff <= 20 THEN 'PASS' WHEN NOT hard AND last <= -10 AND diff <= 50 THEN 'INFO' WHEN NOT hard AND last <= -10 AND end_rms <= -80 AND diff <= 100 THEN 'INFO' ELSE 'WARN' END AS tail_class FROM t"""


@query(BASE + _TAIL.format(last=_db("abs(x[64])"), rms=_db(_rms("list_slice(x, 49, 64)"))))
def tail_class(spark, sf_dir):
    x = F.col("x")
    last, end = F.round(db(F.abs(F.element_at(x, -1))), 9), F.round(db(A.rms(A.tail(x, 16))) - 60, 9)
    kind = R.tail_class((F.col("vec_id") % 150).cast("double"), F.lit(0.0), F.abs(F.element_at(x, -1)) > 0.2, F.lit(False), last - 50, end)
    return frames(spark, sf_dir).select("vec_id", kind.alias("tail_class"))


_REASONS = "[['codec preview unsafe'], ['DYNAMICS RISK: LRA reduced'], ['crest loss too high'], ['low-band stereo correlation too low'], ['true peak exceeded'], ['clipped samples: 4', 'true peak exceeded'], [], ['true peak margin'], [' True peak exceeded', 'true peak exceeded: -0.2']]"


@query(BASE + f"""b AS (SELECT vec_id, round({_db(_rms('list_slice(x, 1, 16)'))}, 9) AS w, round({_db(_rms('list_slice(x, 9, 24)'))}, 9) AS b, round(greatest({_db(_rms('list_slice(x, 25, 40)'))}, {_db(_rms('list_slice(x, 41, 64)'))}), 9) + 3 AS p,
(['OLD POP', 'JAZZ', 'K-POP', 'UNKNOWN'])[vec_id % 4 + 1] AS genre, CAST(60 + vec_id % 5 * 10 AS INTEGER) AS strength, ({_REASONS})[vec_id % 9 + 1] AS reasons FROM f),
g AS (SELECT *, p - w AS gw, p - b AS gb, CASE genre WHEN 'OLD POP' THEN 6.0 WHEN 'JAZZ' THEN 2.0 ELSE 3.0 END AS sat, CASE genre WHEN 'OLD POP' THEN 5.0 WHEN 'JAZZ' THEN 1.0 ELSE 2.0 END AS den, lower(array_to_string(reasons, ' / ')) AS t FROM b),
h AS (SELECT *, round_even(CASE WHEN gw > 2.5 THEN greatest(0.0, least(0.8, (gw - 2.5) * 0.2)) WHEN gw < -5 THEN greatest(-0.5, least(0.0, (gw + 5) * 0.12)) ELSE 0 END * (strength / 100.0::DOUBLE), 3) AS warmth,
round_even(CASE WHEN gb > 3 THEN greatest(0.0, least(0.5, (gb - 3) * 0.16)) WHEN gb < -4 THEN greatest(-0.5, least(0.0, (gb + 4) * 0.1)) ELSE 0 END * (strength / 100.0::DOUBLE), 3) AS body FROM g)
SELECT vec_id, round(warmth, 3) AS warmth, round(body, 3) AS body, round(sat * strength / 100.0::DOUBLE, 3) AS saturation, round(den * strength / 100.0::DOUBLE, 3) AS density,
CASE WHEN contains(t, 'codec') THEN 100 WHEN contains(t, 'lra') AND contains(t, 'risk') THEN 60 WHEN contains(t, 'crest') THEN 50 WHEN contains(t, 'low-band stereo correlation') THEN 60 ELSE 50 END AS retry_strength,
round(CASE WHEN contains(t, 'low-band stereo correlation') THEN 0.35 ELSE 1.0 END, 3)::DOUBLE AS warmth_factor, round((CASE WHEN contains(t, 'clipped') THEN 0.5 ELSE 1.0 END) * (CASE WHEN contains(t, 'true peak') THEN 0.7 ELSE 1.0 END), 3)::DOUBLE AS wet_factor,
len(reasons) > 0 AND len(list_filter(reasons, lambda x: NOT starts_with(lower(trim(x)), 'true peak exceeded'))) = 0 AS peak_only FROM h""")
def fullness_and_retry(spark, sf_dir):
    x = F.col("x")
    level = lambda a, n: db(A.rms(F.slice(x, a, n)))
    cases = [["codec preview unsafe"], ["DYNAMICS RISK: LRA reduced"], ["crest loss too high"], ["low-band stereo correlation too low"], ["true peak exceeded"], ["clipped samples: 4", "true peak exceeded"], [], ["true peak margin"], [" True peak exceeded", "true peak exceeded: -0.2"]]
    reasons = F.get(F.array(*(F.array(*map(F.lit, c)).cast("array<string>") for c in cases)), (F.col("vec_id") % 9).cast("int"))
    genre = F.get(F.array(*map(F.lit, ["OLD POP", "JAZZ", "K-POP", "UNKNOWN"])), (F.col("vec_id") % 4).cast("int"))
    made = R.fullness(F.round(level(1, 16), 9), F.round(level(9, 16), 9), F.round(F.greatest(level(25, 16), level(41, 24)), 9) + 3, genre, F.lit("RICH"), 60 + F.col("vec_id") % 5 * 10)
    f = frames(spark, sf_dir).select("vec_id", made.alias("d"), reasons.alias("reasons"))
    warm, wet, _ = R.reduction_factors(F.col("reasons"))
    return f.select("vec_id", *(F.round(f"d.{c}", 3).alias(c) for c in ("warmth", "body", "saturation", "density")), R.retry_strength(F.col("reasons")).alias("retry_strength"), F.round(warm, 3).alias("warmth_factor"), F.round(wet, 3).alias("wet_factor"), R.peak_only(F.col("reasons")).alias("peak_only"))


_STEP = "(CASE WHEN {n} <= 0 THEN 0 ELSE least(1.5, greatest(0.05, {n})) END)"


@query(BASE + f"""m AS (SELECT vec_id, round({_db(_peak('x'))} + 8, 9) AS tp, round({_db(_peak('x'))} + 10, 9) AS c FROM f),
a AS (SELECT *, CASE WHEN c <= -1.45 THEN 0 ELSE least(2.0, {_STEP.format(n='(c + 1.6)')}) END AS s1 FROM m),
b AS (SELECT *, CASE WHEN c - s1 <= -1.45 OR s1 >= 2 - 1e-9 THEN 0 ELSE least(2.0 - s1, {_STEP.format(n='(c - s1 + 1.6)')}) END AS s2 FROM a),
d AS (SELECT *, CASE WHEN c - s1 - s2 <= -1.45 OR s1 + s2 >= 2 - 1e-9 THEN 0 ELSE least(2.0 - s1 - s2, {_STEP.format(n='(c - s1 - s2 + 1.6)')}) END AS s3 FROM b)
SELECT vec_id, CAST(CASE WHEN tp + 1.2 > 0 AND tp + 1.2 + 0.05 <= 0.5 THEN round(-(tp + 1.2 + 0.05), 3) ELSE 0 END AS DOUBLE) + 0.0::DOUBLE AS trim_db, round(CAST({_STEP.format(n='(c + 1.6)')} AS DOUBLE), 6) AS codec_step_db,
round(CAST(s1 + s2 + s3 AS DOUBLE), 6) AS codec_total_db, CAST((s1 > 1e-9)::INT + (s2 > 1e-9)::INT + (s3 > 1e-9)::INT AS INTEGER) AS passes, c - s1 - s2 - s3 <= -1.45 AS safe FROM d""")
def peak_trim_and_codec_loop(spark, sf_dir):
    tp = F.round(db(A.peak(F.col("x"))) + 8, 9)
    c = F.round(db(A.peak(F.col("x"))) + 10, 9)
    f = frames(spark, sf_dir).select("vec_id", tp.alias("tp"), c.alias("c"))
    loop = f.select("vec_id", R.peak_trim(F.col("tp")).alias("trim_db"), R.codec_step(F.col("c")).alias("step"), R.codec_loop(F.col("c")).alias("l"))
    return loop.select("vec_id", (F.round("trim_db", 3) + 0.0).alias("trim_db"), r6(F.col("step"), "codec_step_db"), r6(F.col("l.total"), "codec_total_db"), F.col("l.passes").alias("passes"), F.col("l.safe").alias("safe"))


def flagship(spark, sf_dir):
    """Frames to levels, tails and gate, counted by label and disposition."""
    seen = gated(spark, sf_dir).select("vec_id", "status", "disposition", F.size("issues").alias("n_issues"))
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return seen.join(labels, "vec_id").groupBy("label", "disposition").agg(F.count("*").alias("n"), F.sum("n_issues").alias("issues"))


