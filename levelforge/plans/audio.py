"""Long audio: WAV files written and read in chunks, loudness of chunks, recursive filters, each beside SQL that goes sample by sample.

A take is fifty vectors of ``embeddings`` one after the other, even places left,
odd right.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters
from ..operators.loudness import loudness
from ..operators.scans import numbered
from ..sources.audio import read_chunks, write_chunks
from ..sources.shared import shared_folder
from .frames import BASE, frames
from .registry import query

TAKE, FRAMES = 50, 32


def takes(spark, sf_dir, repeats: int = 1) -> DataFrame:
    """(track_id, start, n_frames, sample_rate, channels): a chunk a vector, its frames ``repeats`` times, at 8 kHz."""
    f = frames(spark, sf_dir).withColumn("take", F.expr(f"vec_id div {TAKE}"))
    side = lambda x: F.flatten(F.array_repeat(x, repeats))
    placed = numbered(f.select("take", "vec_id", "l", "r"), ["take"], ["vec_id"], "i", "n")
    return placed.select(F.concat(F.lit("take-"), F.col("take")).alias("track_id"), ((F.col("i") - 1) * FRAMES * repeats).alias("start"), (F.col("n") * FRAMES * repeats).alias("n_frames"), F.lit(8000).alias("sample_rate"), F.array(side("l"), side("r")).alias("channels"))


@query(BASE + f"""s AS (SELECT vec_id // {TAKE} AS take, (row_number() OVER (PARTITION BY vec_id // {TAKE} ORDER BY vec_id) - 1) * {FRAMES} AS first, count(*) OVER (PARTITION BY vec_id // {TAKE}) * {FRAMES} AS n_frames, l, r FROM f),
u AS (SELECT take, n_frames, first + unnest(range({FRAMES})) AS i, unnest(l) AS l, unnest(r) AS r FROM s),
q AS (SELECT take, n_frames, i, greatest(-8388608, least(8388607, round_even(l * 8388608, 0))) / 8388608 AS l, greatest(-8388608, least(8388607, round_even(r * 8388608, 0))) / 8388608 AS r FROM u)
SELECT 'take-' || take || '.wav' AS name, i // 100 AS chunk, i // 100 * 100 AS start, n_frames, count(*) AS frames, round(sum(l), 6) AS left_sum, round(sum(r * r), 6) AS right_energy, round(max(abs(l)), 6) AS left_peak
FROM q GROUP BY take, n_frames, i // 100""")
def wav_round_trip(spark, sf_dir):
    """Takes written as 24-bit WAV files, a commit for all, and read back in chunks of 100 frames, 64 KiB of files to a task."""
    folder = shared_folder(spark)
    write_chunks(takes(spark, sf_dir), folder)
    x, y = F.col("channels")[0], F.col("channels")[1]
    add = lambda v, of: F.aggregate(v, F.lit(0.0), lambda s, a: s + of(a))
    rows = read_chunks(spark, folder, chunk_frames=100, split_bytes=1 << 16)
    return rows.select(F.element_at(F.split("track_id", "/"), -1).alias("name"), "chunk", "start", "n_frames", F.size(x).cast("long").alias("frames"), F.round(add(x, lambda a: a), 6).alias("left_sum"), F.round(add(y, lambda a: a * a), 6).alias("right_energy"), F.round(F.array_max(F.transform(x, F.abs)), 6).alias("left_peak"))


#: Repeats of a vector's frames for loudness: chunks of 736 frames, which no hop of 800 frames ends with.
REPEATS = 23


def _two_sections(sections: np.ndarray) -> str:
    """The states after a sample, for list_reduce: ``a`` holds four states, ``e[1]`` is the sample, ``{y}`` stands for the output."""
    (b0, b1, b2, _, a1, a2), (c0, c1, c2, _, d1, d2) = ([repr(float(v)) for v in s] for s in sections)
    first = f"({b0} * e[1] + a[1])"
    y = f"({c0} * {first} + a[3])"
    return f"{b1} * e[1] - {a1} * {first} + a[2], {b2} * e[1] - {a2} * {first}, {c1} * {first} - {d1} * {y} + a[4], {c2} * {first} - {d2} * {y}", y


_STATES, _Y = _two_sections(filters.k_weighting(8000))
_LU = "(-0.691 + 10 * log10({}))"


@query(BASE + f"""t AS (SELECT vec_id // {TAKE} AS take, flatten(list(flatten(list_transform(range({REPEATS}), lambda k: l)) ORDER BY vec_id)) AS l, flatten(list(flatten(list_transform(range({REPEATS}), lambda k: r)) ORDER BY vec_id)) AS r FROM f GROUP BY vec_id // {TAKE}),
c AS (SELECT take, l AS x FROM t UNION ALL SELECT take, r FROM t),
h AS (SELECT take, x, unnest(range(len(x) // 800)) AS hop FROM c),
w AS (SELECT take, hop, x[greatest(0, 800 * (hop - 2)) + 1:800 * (hop + 1)] AS x, 800 * hop - greatest(0, 800 * (hop - 2)) AS run_in FROM h),
e AS (SELECT take, hop, list_reduce(list_prepend([0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[], list_transform(x, lambda v, i: [v, CASE WHEN i > run_in THEN 1.0 ELSE 0.0 END]::DOUBLE[])), lambda a, e: [{_STATES}, a[5] + e[2] * {_Y} * {_Y}])[5] / 800 AS power FROM w),
p AS (SELECT take, hop, sum(power) AS power FROM e GROUP BY take, hop),
b4 AS (SELECT take, avg(power) OVER n AS power, count(*) OVER n AS k FROM p WINDOW n AS (PARTITION BY take ORDER BY hop ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
g4 AS (SELECT take, power FROM b4 WHERE k = 4 AND power > 0 AND {_LU.format('power')} >= -70),
i4 AS (SELECT take, avg(power) AS power FROM g4 JOIN (SELECT take, avg(power) AS m FROM g4 GROUP BY take) USING (take) WHERE {_LU.format('power')} >= {_LU.format('m')} - 10 GROUP BY take),
b30 AS (SELECT take, hop, avg(power) OVER n AS power, count(*) OVER n AS k FROM p WINDOW n AS (PARTITION BY take ORDER BY hop ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
g30 AS (SELECT take, power FROM b30 WHERE k = 30 AND hop % 10 = 0 AND power > 0 AND {_LU.format('power')} >= -70),
r30 AS (SELECT take, quantile_cont({_LU.format('power')}, 0.95) - quantile_cont({_LU.format('power')}, 0.1) AS lra FROM g30 JOIN (SELECT take, avg(power) AS m FROM g30 GROUP BY take) USING (take) WHERE {_LU.format('power')} >= {_LU.format('m')} - 20 GROUP BY take)
SELECT 'take-' || t.take AS track_id, round({_LU.format('power')}, 5) AS lufs, round(lra, 5) AS lra FROM t LEFT JOIN i4 USING (take) LEFT JOIN r30 USING (take)""")
def chunked_loudness(spark, sf_dir):
    """Integrated loudness and range of takes that come in chunks, beside a recursion over samples (each hop from two hops before)."""
    return loudness(takes(spark, sf_dir, REPEATS)).select("track_id", F.round("lufs", 5).alias("lufs"), F.round("lra", 5).alias("lra"))


def _zero_phase(source: str, cascade: filters.Cascade) -> str:
    """CTEs ``zl``, ``zr``: (vec_id, z) of the lists l and r of ``source`` through two sections in both directions: mirrored ends, each run from the rest of its first sample."""
    states, y = _two_sections(cascade.sections)
    edge = 3 * (cascade.order + 1)
    rest = ", ".join(f"{float(v)!r} * x[1]" for v in cascade.rest())
    once = f"list_reverse(list_reduce(list_prepend([{rest}]::DOUBLE[], list_transform(x, lambda v: [v]::DOUBLE[])), lambda a, e: list_concat([{states}], list_append(a[5:], {y})))[5:])"
    out = []
    for s in "lr":
        longer = f"list_concat(list_transform(list_reverse({s}[2:{edge + 1}]), lambda v: 2 * {s}[1] - v), {s}, list_transform(list_reverse({s}[-{edge + 1}:-2]), lambda v: 2 * {s}[-1] - v))"
        out += [f"{s}0 AS (SELECT vec_id, {longer} AS x FROM {source})", f"{s}1 AS (SELECT vec_id, {once} AS x FROM {s}0)", f"{s}2 AS (SELECT vec_id, {once} AS x FROM {s}1)", f"z{s} AS (SELECT vec_id, x[{edge + 1}:len(x) - {edge}] AS z FROM {s}2)"]
    return ",\n".join(out)


#: Frames of a vector ten times at 1 kHz, so that the bands hold something.
SLOW = 1000


def _slow(spark, sf_dir) -> DataFrame:
    tile = lambda x: F.flatten(F.array_repeat(x, 10))
    return frames(spark, sf_dir).select("vec_id", tile("l").alias("l"), tile("r").alias("r"))


_TILED = "tiled AS (SELECT vec_id, flatten(list_transform(range(10), lambda k: l)) AS l, flatten(list_transform(range(10), lambda k: r)) AS r FROM f)"


@query(BASE + f"""{_TILED},
{_zero_phase('tiled', filters.low_pass(SLOW, 110.0))}
SELECT vec_id, round(list_aggregate(list_transform(zl.z, lambda v, i: v * zr.z[i]), 'sum'), 6) AS product, round(CASE WHEN list_stddev_pop(zl.z) < 1e-12 OR list_stddev_pop(zr.z) < 1e-12 THEN 1 ELSE
(list_avg(list_transform(zl.z, lambda v, i: v * zr.z[i])) - list_avg(zl.z) * list_avg(zr.z)) / (list_stddev_pop(zl.z) * list_stddev_pop(zr.z)) END, 6) AS low_band_correlation FROM zl JOIN zr USING (vec_id)""")
def low_band_stereo(spark, sf_dir):
    """Correlation of both sides below 110 Hz after a fourth-order low-pass in both directions."""
    system = filters.low_pass(SLOW, 110.0)

    def measure(batches):
        from ..operators.kernels import low_band_correlation

        for frame in batches:
            out = []
            for vec_id, left, right in frame.itertuples(index=False):
                x = np.array([left, right])
                z = system.both_ways(x)
                out.append((vec_id, round(float((z[0] * z[1]).sum()), 6), round(low_band_correlation(x, SLOW), 6)))
            yield pd.DataFrame(out, columns=["vec_id", "product", "low_band_correlation"])

    return _slow(spark, sf_dir).mapInPandas(measure, "vec_id long, product double, low_band_correlation double")


@query(BASE + f"""{_TILED},
{_zero_phase('tiled', filters.band_pass(SLOW, 90.0, 220.0))}
SELECT vec_id, round(list_aggregate(list_transform(zl.z, lambda v: v * v), 'sum'), 6) AS left_energy, round(list_max(list_transform(zr.z, lambda v: abs(v))), 6) AS right_peak FROM zl JOIN zr USING (vec_id)""")
def warmth_band(spark, sf_dir):
    """What a second-order band-pass of 90 to 220 Hz in both directions leaves of either side."""
    system = filters.band_pass(SLOW, 90.0, 220.0)

    def measure(batches):
        for frame in batches:
            z = [system.both_ways(np.array([a, b])) for a, b in zip(frame["l"], frame["r"], strict=True)]
            yield pd.DataFrame({"vec_id": frame["vec_id"], "left_energy": [round(float((v[0] ** 2).sum()), 6) for v in z], "right_peak": [round(float(np.abs(v[1]).max()), 6) for v in z]})

    return _slow(spark, sf_dir).mapInPandas(measure, "vec_id long, left_energy double, right_peak double")
