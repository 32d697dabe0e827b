"""Loudness of tracks in chunks: one pass over samples, each chunk alone, exact however a track is cut.

A chunk is weighted from rest. What the true state before it adds to the energy
of a hop is a quadratic form of that state: the pass gives its coefficients with
the energies, and the affine map of the state over the chunk. The maps are
scanned in order (a row a chunk), and energies corrected; samples are never
shuffled, joined or read twice. Gates and percentiles are grouped sums over
100 ms hops.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .filters import weighting

#: Frames of a track whose chunks one task of the scan composes.
SCAN_FRAMES = 1 << 26
#: Weights of channels by place: left, right, centre, then surround.
GAINS = (1.0, 1.0, 1.0, 1.41, 1.41)
PARTS = "track_id string, start long, sample_rate int, n long, hop long, frames long, energy array<double>, crossed array<double>, formed array<double>, ends array<double>, error string"
STATES = "track_id string, start long, state array<double>"


def hop_frames(rate: int) -> int:
    return max(1, round(rate * 0.1))


def weigh(chunk_rows):
    """Batches of (track_id, start, sample_rate, channels) to ``PARTS``: hops of each chunk; the first also has the chunk's length and end state from rest."""
    for frame in chunk_rows:
        out = []
        for track, start, rate, channels in frame[["track_id", "start", "sample_rate", "channels"]].itertuples(index=False):
            try:
                x = np.array([np.asarray(c, float) for c in channels])
                if x.ndim != 2 or not np.isfinite(x).all():
                    raise ValueError("samples must be finite, and the channels of one length")
                if not x.shape[1]:
                    continue
                rate, start, n = int(rate), int(start), x.shape[1]
                system, step = weighting(rate), hop_frames(rate)
                y, ends = system.run(x)
                # After a second nothing is left of the state before.
                ring = system.ringing(min(n, rate))
                cuts = np.unique(np.concatenate([[0], np.arange(step - start % step, n, step), [n]]))
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    o = ring[a:b]
                    part = y[:, a : a + len(o)]
                    cross, form = (list((part @ o).ravel()), list((o.T @ o).ravel())) if len(o) else (None, None)
                    out.append((track, start, rate, n if k == 0 else None, (start + a) // step, b - a, list((y[:, a:b] ** 2).sum(axis=1)), cross, form, list(ends.ravel()) if k == 0 else None, None))
            except (TypeError, ValueError) as e:
                out.append((track, start, rate, None, None, None, None, None, None, None, str(e)[:300]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PARTS.split(", ")]).astype({c: "Int64" for c in ("start", "n", "hop", "frames")} | {"sample_rate": "Int32"})


def _maps(pdf: pd.DataFrame) -> list[tuple[int, int, np.ndarray]]:
    """(start, frames, end state from rest, a row a channel) in order; a gap between chunks is silence of the state, so it is an error upstream."""
    pdf = pdf.sort_values("start")
    order = weighting(int(pdf["sample_rate"].iloc[0])).order
    return [(int(s), int(n), np.asarray(e, float).reshape(-1, order)) for s, n, e in zip(pdf["start"], pdf["n"], pdf["ends"], strict=True)]


def composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The one map of all chunks of a group."""
    system, total, state = weighting(int(pdf["sample_rate"].iloc[0])), 0, None
    for _, n, ends in _maps(pdf):
        state = ends if state is None else state @ system.after(n).T + ends
        total += n
    return pd.DataFrame({"track_id": pdf["track_id"].iloc[:1], "block": pdf["block"].iloc[0], "start": pdf["start"].min(), "sample_rate": pdf["sample_rate"].iloc[0], "n": total, "ends": [list(state.ravel())]})


def entered(pdf: pd.DataFrame, state: np.ndarray | None = None) -> pd.DataFrame:
    """The state before each row."""
    system, out = weighting(int(pdf["sample_rate"].iloc[0])), []
    for start, n, ends in _maps(pdf):
        state = np.zeros_like(ends) if state is None else state
        out.append((pdf["track_id"].iloc[0], start, list(state.ravel())))
        state = state @ system.after(n).T + ends
    return pd.DataFrame(out, columns=["track_id", "start", "state"])


def states(parts: DataFrame, scan_frames: int = SCAN_FRAMES) -> DataFrame:
    """The state before every chunk, by a scan of two levels: blocks of ``scan_frames`` frames, then the chunks of a block."""
    chunks = parts.where("ends IS NOT NULL").select("track_id", F.floor(F.col("start") / scan_frames).cast("long").alias("block"), "start", "sample_rate", "n", "ends")
    blocks = chunks.groupBy("track_id", "block").applyInPandas(composed, "track_id string, block long, start long, sample_rate int, n long, ends array<double>")
    first = blocks.groupBy("track_id").applyInPandas(lambda pdf: entered(pdf), STATES).select("track_id", F.floor(F.col("start") / scan_frames).cast("long").alias("block"), "state")

    def inside(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        order = weighting(int(rows["sample_rate"].iloc[0])).order
        return entered(rows, np.asarray(before["state"].iloc[0], float).reshape(-1, order))

    return chunks.groupBy("track_id", "block").cogroup(first.groupBy("track_id", "block")).applyInPandas(inside, STATES)


def corrected(frames):
    """Batches of parts with the state before their chunk to (track_id, sample_rate, hop, frames, energy over all channels)."""
    for frame in frames:
        energy = []
        for e, cross, form, state in frame[["energy", "crossed", "formed", "state"]].itertuples(index=False):
            e = np.asarray(e, float)
            if cross is not None:
                s, g = np.asarray(state, float).reshape(len(e), -1), np.asarray(form, float)
                c, order = np.asarray(cross, float).reshape(len(e), -1), s.shape[1]
                e = e + 2 * (s * c).sum(axis=1) + ((s @ g.reshape(order, order)) * s).sum(axis=1)
            gains = np.array([GAINS[min(k, len(GAINS) - 1)] for k in range(len(e))])
            energy.append(float((np.maximum(e, 0) * gains).sum()))
        yield pd.DataFrame({"track_id": frame["track_id"], "sample_rate": frame["sample_rate"], "hop": frame["hop"], "frames": frame["frames"], "energy": energy})


def hops(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((track_id, sample_rate, hop, power) of whole hops of 100 ms, (track_id, error) of tracks that can't be measured).

    ``chunks``: (track_id, start, sample_rate, channels) as ``read_chunks`` gives
    them; whole tracks are one chunk from 0. The power is the sum over channels.
    """
    rows = chunks.select(F.col("track_id").cast("string").alias("track_id"), F.col("start").cast("long").alias("start"), F.col("sample_rate").cast("int").alias("sample_rate"), F.col("channels").cast("array<array<double>>").alias("channels"))
    parts = written(rows.mapInPandas(weigh, PARTS))
    entry = states(parts)
    both = parts.where("error IS NULL").join(entry, ["track_id", "start"]).mapInPandas(corrected, "track_id string, sample_rate int, hop long, frames long, energy double")
    step = F.greatest(F.lit(1), F.rint(F.col("sample_rate") * 0.1).cast("long"))
    summed = both.groupBy("track_id", "sample_rate", "hop").agg(F.sum("frames").alias("frames"), F.sum("energy").alias("energy"))
    errors = parts.where("error IS NOT NULL").groupBy("track_id").agg(F.max("error").alias("error"))
    return summed.where(F.col("frames") == step).select("track_id", "sample_rate", "hop", (F.col("energy") / step).alias("power")), errors


def level(power):
    """LU of a mean power."""
    return -0.691 + 10 * F.log10(power)


def blocks(hop_powers: DataFrame, n_hops: int, every: int = 1) -> DataFrame:
    """(track_id, block, power): means over ``n_hops`` hops, a block each ``every`` hops; only whole ones."""
    first = F.greatest(F.lit(0), F.ceil((F.col("hop") - n_hops + 1) / every)).cast("long")
    last = F.floor(F.col("hop") / every).cast("long")
    spread = hop_powers.select("track_id", F.explode(F.sequence(first, last)).alias("block"), "power")
    return spread.groupBy("track_id", "block").agg(F.avg("power").alias("power"), F.count("*").alias("n")).where(F.col("n") == n_hops).drop("n")


def gated(powers: DataFrame, below_mean: float) -> DataFrame:
    """Blocks that pass the gate at -70 LUFS and that ``below_mean`` LU under the mean of those."""
    loud = powers.where((F.col("power") > 0) & (level(F.col("power")) >= -70.0))
    mean = loud.groupBy("track_id").agg(F.avg("power").alias("mean"))
    return loud.join(mean, "track_id").where(level(F.col("power")) >= level(F.col("mean")) - below_mean).select("track_id", "power")


def loudness(chunks: DataFrame) -> DataFrame:
    """(track_id, lufs, lra, error) of tracks in chunks.

    Integrated loudness by ITU-R BS.1770-4 (400 ms blocks each 100 ms), minus
    infinity for silence and under 400 ms; range by EBU Tech 3342 (3 s blocks
    each second, 95th less 10th percentile), null where no block passes. A track
    with a chunk that can't be measured has its reason and nulls.
    """
    of_hops, errors = hops(chunks)
    of_hops = written(of_hops)
    tracks = chunks.select(F.col("track_id").cast("string").alias("track_id")).distinct()
    whole = gated(blocks(of_hops, 4), 10.0).groupBy("track_id").agg(level(F.avg("power")).alias("lufs"))
    far = gated(blocks(of_hops, 30, 10), 20.0).select("track_id", level(F.col("power")).alias("v"))
    spread = far.groupBy("track_id").agg((F.percentile("v", F.lit(0.95)) - F.percentile("v", F.lit(0.10))).alias("lra"))
    out = tracks.join(whole, "track_id", "left").join(spread, "track_id", "left").join(errors, "track_id", "left")
    fine = F.col("error").isNull()
    return out.select("track_id", F.when(fine, F.coalesce("lufs", F.lit(float("-inf")))).alias("lufs"), F.when(fine, F.col("lra")).alias("lra"), "error")
