"""Channels of a recording: which are bad, a reference without them, their restoration by spherical splines, and scalp maps.

Signals come in blocks (recording, channel, block, start, signal); a task holds the channels of one block of one recording.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import kept

# Places of electrodes on the sphere in degrees, inclination from the vertex (negative to the left) and azimuth.
PLACES = {
    "Fp1": (-92, -72), "Fp2": (92, 72), "Fpz": (92, 90), "F3": (-60, -51), "F4": (60, 51), "F7": (-92, -36), "F8": (92, 36), "Fz": (46, 90),
    "C3": (-46, 0), "C4": (46, 0), "Cz": (0, 0), "T3": (-92, 0), "T4": (92, 0), "T5": (-92, 36), "T6": (92, -36), "A1": (-115, 0), "A2": (115, 0),
    "P3": (-60, 51), "P4": (60, -51), "Pz": (46, -90), "O1": (-92, 72), "O2": (92, -72), "Oz": (92, -90),
}
#: Inclination at the rim of a scalp map; terms and stiffness of the spline; smoothing of its solve.
RIM, TERMS, STIFFNESS, SMOOTHING = 92.0, 50, 4, 1e-5


def on_sphere(inclination: np.ndarray, azimuth: np.ndarray) -> np.ndarray:
    t, p = np.radians(inclination), np.radians(azimuth)
    return np.stack([np.sin(t) * np.cos(p), np.sin(t) * np.sin(p), np.cos(t)], axis=-1)


def _kernel(cosines: np.ndarray) -> np.ndarray:
    """The spline kernel: Legendre polynomials of the cosine between two places, summed with falling weights."""
    n = np.arange(1, TERMS + 1, dtype=float)
    weights = np.concatenate([[0.0], (2 * n + 1) / (n * (n + 1)) ** STIFFNESS / (4 * np.pi)])
    return np.polynomial.legendre.legval(np.clip(cosines, -1, 1), weights)


def spline_weights(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The matrix that takes values at the known places to those of their spherical spline at the wanted ones; rows sum to 1."""
    n = len(known)
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = _kernel(known @ known.T) + SMOOTHING * np.eye(n)
    system[n, n] = 0
    return np.column_stack([_kernel(wanted @ known.T), np.ones(len(wanted))]) @ np.linalg.pinv(system)[:, :n]


@lru_cache(maxsize=256)
def _restoring(good: tuple[str, ...], bad: tuple[str, ...]) -> np.ndarray:
    place = lambda names: on_sphere(*np.array([PLACES[c] for c in names], float).T)
    return spline_weights(place(good), place(bad))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Signals of one block as rows; a signal that is null or shorter goes on with zeros."""
    rows = [np.array(v or [], float) for v in column.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _referenced(x: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Rows less the mean of those that are not bad; of all, if all are."""
    return x - x[~bad if not bad.all() else slice(None)].mean(axis=0)


def _by_block(blocks: DataFrame, bad: DataFrame | None, recording: str, channel: str, work, schema: str) -> DataFrame:
    """work(table) for the channels of each block of each recording, with the boolean bad; channels in bad (recording, channel) are."""
    rows = blocks.withColumn("bad", F.lit(False))
    if bad is not None:
        flags = bad.select(F.struct(recording, channel).alias("named__"), F.lit(True).alias("flag__")).distinct()
        rows = blocks.withColumn("named__", F.struct(recording, channel)).join(flags, "named__", "left").withColumn("bad", F.coalesce("flag__", F.lit(False))).drop("named__", "flag__")
    return rows.groupBy(recording, "block").applyInArrow(lambda table: work(table.sort_by(channel)), schema)


def _kinds(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def noisy_channels(blocks: DataFrame, recording: str, channel: str, window: int, limit: float = 5.0, least: float | None = 0.4, share: float = 0.01, rounds: int = 4) -> DataFrame:
    """recording, channel, deviation, z, low_share and bad of every channel.

    Signals are referenced to the mean of the good channels. A channel is bad if its deviation is 0, or further from the median
    of the recording's channels than ``limit`` robust deviations (1.4826 times the median absolute distance), or if in more
    than ``share`` of the windows its highest absolute correlation with another channel is under ``least`` (None: not looked
    at). The reference changes with what is found, so it is done again until nothing is, ``rounds`` times at most; what was
    bad stays so. The measures are those of the last round.
    """

    def measure(table: pa.Table) -> pa.Table:
        bad = np.array(table.column("bad").to_pylist(), bool)
        x = _referenced(_matrix(table.column("signal")), bad)
        many, low = x.shape[1] // window, np.zeros(len(x), np.int64)
        if least is not None and many:
            for w in range(many):
                part = x[:, w * window : (w + 1) * window]
                part = part - part.mean(axis=1, keepdims=True)
                size = np.sqrt((part * part).sum(axis=1))
                near = np.abs(part @ part.T) / np.where(size > 0, size, np.inf)[:, None] / np.where(size > 0, size, np.inf)[None, :]
                np.fill_diagonal(near, 0)
                low += near.max(axis=1) < least
        found = {"n": np.full(len(x), x.shape[1]), "s": x.sum(axis=1), "q": (x * x).sum(axis=1), "windows": np.full(len(x), many if least is not None else 0), "low": low}
        return pa.table({recording: table.column(recording), channel: table.column(channel)} | {k: pa.array(v, pa.float64() if k in "sq" else pa.int64()) for k, v in found.items()})

    flagged, seen = None, 0
    for _ in range(rounds):
        parts = _by_block(blocks, flagged, recording, channel, measure, f"{_kinds(blocks, recording, channel)}, n long, s double, q double, windows long, low long")
        mean = F.sum("s") / F.sum("n")
        own = parts.groupBy(recording, channel).agg(F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0))).alias("deviation"), (F.sum("low") / F.nullif(F.sum("windows"), F.lit(0))).alias("low_share"))
        own = kept(own)
        names = own.select(F.struct(recording).alias("rec__"), channel, "deviation", "low_share")
        middle = names.groupBy("rec__").agg(F.median("deviation").alias("middle"))  # one value a channel
        spread = names.join(middle, "rec__").withColumn("far", F.abs(F.col("deviation") - F.col("middle")))
        mad = spread.groupBy("rec__").agg(F.median("far").alias("mad"))
        judged = spread.join(mad, "rec__").withColumn("z", (F.col("deviation") - F.col("middle")) / F.nullif(F.col("mad") * 1.4826, F.lit(0.0)))
        bad = (F.col("deviation") == 0) | F.coalesce(F.abs("z") > limit, F.lit(False)) | F.coalesce(F.col("low_share") > share, F.lit(False))
        judged = judged.select(F.col("rec__")[recording].alias(recording), channel, "deviation", "z", "low_share", bad.alias("bad"))
        if flagged is not None:
            before = flagged.select(F.struct(recording, channel).alias("named__"), F.lit(True).alias("before__"))
            judged = judged.withColumn("named__", F.struct(recording, channel)).join(before, "named__", "left").withColumn("bad", F.col("bad") | F.coalesce("before__", F.lit(False))).drop("named__", "before__")
        judged = kept(judged)
        flagged = judged.filter("bad").select(recording, channel)
        now = flagged.count()
        if now == seen:
            break
        seen = now
    return judged


def robust_reference(blocks: DataFrame, bad: DataFrame, recording: str, channel: str) -> DataFrame:
    """blocks with signals less the mean, sample by sample, of the recording's channels that are not in bad (recording, channel)."""
    names = [recording, channel, "block", "start", "signal"]

    def work(table: pa.Table) -> pa.Table:
        x = _referenced(_matrix(table.column("signal")), np.array(table.column("bad").to_pylist(), bool))
        return table.select(names[:4]).append_column("signal", pa.array(list(x), pa.list_(pa.float64())))

    return _by_block(blocks, bad, recording, channel, work, f"{_kinds(blocks, *names[:4])}, signal array<double>")


def restored(blocks: DataFrame, bad: DataFrame, recording: str, channel: str) -> DataFrame:
    """blocks with the signals of the channels in bad (recording, channel) made from the others' by a spherical spline.

    Channels without a known place, and all of a block without a good channel, stay as they are. The spline is solved once
    for each set of good and bad channels that a task meets.
    """
    names = [recording, channel, "block", "start", "signal"]

    def work(table: pa.Table) -> pa.Table:
        x, named, bad = _matrix(table.column("signal")), table.column(channel).to_pylist(), table.column("bad").to_pylist()
        good = [k for k, c in enumerate(named) if c in PLACES and not bad[k]]
        wrong = [k for k, c in enumerate(named) if c in PLACES and bad[k]]
        if good and wrong:
            x[wrong] = _restoring(tuple(named[k] for k in good), tuple(named[k] for k in wrong)) @ x[good]
        return table.select(names[:4]).append_column("signal", pa.array(list(x), pa.list_(pa.float64())))

    return _by_block(blocks, bad, recording, channel, work, f"{_kinds(blocks, *names[:4])}, signal array<double>")


def scalp_map(values: DataFrame, keys: list[str], channel: str, value: str, size: int = 32) -> DataFrame:
    """keys, x, y and value on a grid of size by size points over the head seen from above (x to the right, y to the front, rim at 1).

    values holds one row a channel and group; channels without a place and null values are left out, groups without any have no
    row. Distance from the centre is the inclination, so the map keeps directions from the vertex.
    """
    line = (np.arange(size) + 0.5) / size * 2 - 1
    x, y = (g.reshape(-1) for g in np.meshgrid(line, line))
    inside = np.hypot(x, y) <= 1
    x, y = x[inside], y[inside]
    grid = on_sphere(np.hypot(x, y) * RIM, np.degrees(np.arctan2(y, x)))

    def work(table: pa.Table) -> pa.Table:
        found = {c: v for c, v in zip(table.column(channel).to_pylist(), table.column(value).to_pylist(), strict=True) if c in PLACES and v is not None}
        if not found:
            return pa.table({k: table.column(k)[:0] for k in keys} | {c: pa.array([], pa.float64()) for c in ("x", "y", "value")})
        known = on_sphere(*np.array([PLACES[c] for c in found], float).T)
        made = spline_weights(known, grid) @ np.array(list(found.values()))
        return pa.table({k: pa.repeat(table.column(k)[0], len(x)) for k in keys} | {"x": x, "y": y, "value": made})

    return values.groupBy(*keys).applyInArrow(work, f"{_kinds(values, *keys)}, x double, y double, value double")


def rejection_thresholds(epochs: DataFrame, keys: list[str], epoch: str, fold: str, signal: str, candidates: int = 10) -> DataFrame:
    """keys, threshold and error: for each channel the peak-to-peak limit of least cross-validated error.

    Candidates are equal steps from the least to the largest peak-to-peak value of the channel's epochs. For each fold, the mean
    of the other folds' epochs within a candidate is held against the median of all epochs of the fold, sample by sample; the
    error is the root mean square over samples, averaged over folds. A candidate that leaves a fold without a training epoch is
    out; the smaller of equal ones is taken. Epochs are summed up once, by the first candidate that holds them.
    """
    key = F.struct(*keys).alias("key")
    rows = epochs.filter(F.size(signal) > 0).select(key, F.col(fold).alias("fold"), F.col(signal).alias("x"), (F.array_max(signal) - F.array_min(signal)).alias("ptp"))
    ends = rows.groupBy("key").agg(F.min("ptp").alias("low"), F.max("ptp").alias("high"))
    limit = lambda j: F.col("low") + (F.col("high") - F.col("low")) * j / F.lit(float(candidates))
    limits = F.transform(F.sequence(F.lit(1), F.lit(candidates)), lambda j: F.when(j == candidates, F.col("high")).otherwise(limit(j)))
    limits = ends.select("key", limits.alias("limits"))
    first = F.size(F.filter("limits", lambda t: t < F.col("ptp"))) + 1
    samples = rows.join(limits, "key").select("key", "fold", first.alias("c"), F.posexplode("x").alias("pos", "x"))
    medians = samples.groupBy("key", "fold", "pos").agg(F.median("x").alias("middle"))  # as many values as a channel's fold has epochs
    sums = samples.groupBy("key", "fold", "pos", "c").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    upto = lambda part, j: F.aggregate("parts", F.lit(0.0), lambda t, p: t + F.when(p["c"] <= j, p[part].cast("double")).otherwise(0.0)).alias(part)
    steps = F.transform(F.sequence(F.lit(1), F.lit(candidates)), lambda j: F.struct(j.alias("c"), upto("s", j), upto("n", j)))
    within = sums.groupBy("key", "fold", "pos").agg(F.collect_list(F.struct("c", "s", "n")).alias("parts"))  # one a candidate at most
    within = within.select("key", "fold", "pos", F.inline(steps))
    total = within.groupBy("key", "pos", "c").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    train = within.join(total, ["key", "pos", "c"]).join(medians, ["key", "fold", "pos"])
    mean = (F.col("all_s") - F.col("s")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0.0))
    square = train.groupBy("key", "fold", "c").agg(F.when(F.count(mean) == F.count(F.lit(1)), F.sqrt(F.avg((mean - F.col("middle")) * (mean - F.col("middle"))))).alias("error"))
    errors = square.groupBy("key", "c").agg(F.when(F.count("error") == F.count(F.lit(1)), F.avg("error")).alias("error")).filter("error IS NOT NULL")
    best = errors.groupBy("key").agg(F.min(F.struct(F.round("error", 12).alias("rounded"), "c", "error")).alias("best"))
    return best.join(limits, "key").select(*[F.col("key")[k].alias(k) for k in keys], F.element_at("limits", F.col("best.c")).alias("threshold"), F.col("best.error").alias("error"))
