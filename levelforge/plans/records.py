"""What is recorded of a file, by values: spectra of frames, jumps a second, and the integrity record; SQL goes bin by bin."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.levels import db
from ..operators import arrays as A
from ..operators.kernels import spectrum_features
from .frames import BASE, _db, _peak, _rms, frames
from .registry import query

RATE = 48_000

#: Power of each of the 33 bins of a frame of 64 samples, Hann window, mean taken out; interior bins count twice.
_BINS = f"""w AS (SELECT vec_id, list_transform(x, lambda v, i: (v - list_avg(x)) * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 64))) AS y FROM f),
p AS (SELECT vec_id, k, k * {RATE} / 64.0 AS hz, (power(list_sum(list_transform(y, lambda v, i: v * cos(2 * pi() * k * (i - 1) / 64))), 2) + power(list_sum(list_transform(y, lambda v, i: v * sin(2 * pi() * k * (i - 1) / 64))), 2)) * CASE WHEN k BETWEEN 1 AND 31 THEN 2 ELSE 1 END AS power FROM w, (SELECT unnest(range(33)) AS k)),
s AS (SELECT vec_id, sum(power) FILTER (hz >= 7000 AND hz < 16000) / sum(power) AS high, sum(power) FILTER (hz >= 11000 AND hz < 19000) / sum(power) AS very_high, exp(avg(ln(power)) FILTER (power > 0)) / avg(power) FILTER (power > 0) AS flatness FROM p GROUP BY vec_id)"""


def _spectra(batches):
    for frame in batches:
        found = [spectrum_features(np.asarray(x, float), RATE) for x in frame["x"]]
        yield pd.DataFrame({"vec_id": frame["vec_id"]} | {k: [f[k] for f in found] for k in ("high_ratio", "very_high_ratio", "flatness")})


@query(BASE + f"{_BINS}\nSELECT vec_id, round(high, 6) AS high_ratio, round(very_high, 6) AS very_high_ratio, CASE WHEN flatness < 1e-6 THEN 0 ELSE round(flatness, 4) END AS flatness FROM s")
def spectrum_values(spark, sf_dir):
    """Shares of high and very high frequencies and flatness of every frame, by value."""
    seen = frames(spark, sf_dir).select("vec_id", "x").mapInPandas(_spectra, "vec_id long, high_ratio double, very_high_ratio double, flatness double")
    return seen.select("vec_id", F.round("high_ratio", 6).alias("high_ratio"), F.round("very_high_ratio", 6).alias("very_high_ratio"), F.when(F.col("flatness") < 1e-6, 0.0).otherwise(F.round("flatness", 4)).alias("flatness"))


@query(BASE + f"""j AS (SELECT vec_id, list_transform(x, lambda v, i: CASE WHEN i = 30 AND vec_id % 3 = 0 THEN v * 40 ELSE v END) AS x FROM f),
d AS (SELECT vec_id, list_transform(x[2:], lambda v, i: v - x[i]) AS d FROM j), m AS (SELECT *, list_median(d) AS m FROM d),
q AS (SELECT *, greatest(0.025, 12 * greatest(1.4826 * list_median(list_transform(d, lambda v: abs(v - m))), 1e-8)) AS most FROM m)
SELECT vec_id, round(len(list_filter(d, lambda v: abs(v) > most)) / 63.0::DOUBLE * {RATE}, 4) AS transient_rate FROM q""")
def transients(spark, sf_dir):
    """Jumps a second at twelve times the robust scale; every third frame has a click put in."""
    click = F.transform("x", lambda v, i: F.when((i == 29) & (F.col("vec_id") % 3 == 0), v * 40).otherwise(v))
    f = frames(spark, sf_dir).select("vec_id", click.alias("x"))
    return f.select("vec_id", F.round(A.transient_rate(F.col("x"), F.lit(float(RATE))), 4).alias("transient_rate"))


@query(BASE + f"""{_BINS}, m AS (SELECT vec_id, list_transform(l, lambda v, i: (v + r[i]) / 2) AS m, l, r FROM f), c AS (SELECT vec_id, l, r, list_transform(m, lambda v: v - list_avg(m)) AS m FROM m)
SELECT c.vec_id, round({_db(_rms('m'))}, 6) AS rms_dbfs, round({_db(_peak('m'))}, 6) AS peak_dbfs, round(s.high, 6) AS high_ratio, round(32 / {RATE}.0, 8)::DOUBLE AS seconds, 2 AS n_channels, CAST(len(list_filter(list_concat(l, r), lambda v: abs(v) >= 0.3)) AS INTEGER) AS clipped FROM c JOIN s USING (vec_id)""")
def integrity_record(spark, sf_dir):
    """The record of a file before and after a repair: levels of the mono mean, high share, length, channels, samples at the limit (0.3 here)."""
    high = frames(spark, sf_dir).select("vec_id", "x").mapInPandas(_spectra, "vec_id long, high_ratio double, very_high_ratio double, flatness double").select("vec_id", "high_ratio")
    f = frames(spark, sf_dir).select("vec_id", "l", "r", A.remove_dc(A.mono(F.col("l"), F.col("r"))).alias("m"))
    limit = F.size(F.filter(F.concat("l", "r"), lambda v: F.abs(v) >= 0.3))
    seen = f.select("vec_id", F.round(db(A.rms(F.col("m"))), 6).alias("rms_dbfs"), F.round(db(A.peak(F.col("m"))), 6).alias("peak_dbfs"), F.round(F.size("l") / float(RATE), 8).alias("seconds"), F.lit(2).alias("n_channels"), limit.alias("clipped"))
    return seen.join(high, "vec_id").withColumn("high_ratio", F.round("high_ratio", 6))
