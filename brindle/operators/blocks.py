"""Filters and resampling of long recordings in blocks of samples.

A recording of any length is rows of (keys, block, start, signal): block counts from 0, start is the place of the block's first
sample, and every block but the last holds more samples than a filter reaches. A block meets the ends of its neighbours in one
join on the block's number, so no task holds more than a block and two halos, and a long recording is worked on by many tasks.
What leaves equals the filter over the whole signal. Beyond its ends a signal goes on as its odd reflection about the last
sample, as far as it has samples, and with zeros after that.
"""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sinc(cut: float, rate: float, taps: int) -> np.ndarray:
    """A low-pass kernel of an odd number of taps with a Hamming taper, of gain 1 at 0 Hz."""
    n = np.arange(taps) - taps // 2
    h = 2 * cut / rate * np.sinc(2 * cut / rate * n) * np.hamming(taps)
    return h / h.sum()


def taps_for(rate: float, transition: float) -> int:
    """The odd number of Hamming taps whose transition is as wide, in hertz."""
    return int(np.ceil(3.3 * rate / transition)) | 1


def band_pass(rate: float, low: float | None = 1.0, high: float | None = None, low_width: float | None = None, high_width: float | None = None) -> np.ndarray:
    """A zero-phase kernel that passes low..high hertz; the transitions lie outside of the band.

    The usual widths: a quarter of low, 2 Hz at least and low at most; a quarter of high, 2 Hz at least and what is left to half the rate.
    """
    kernels = []
    if low is not None:
        width = low_width or min(max(low / 4, 2.0), low)
        h = -windowed_sinc(low - width / 2, rate, taps_for(rate, width))
        h[len(h) // 2] += 1
        kernels.append(h)
    if high is not None:
        width = high_width or min(max(high / 4, 2.0), rate / 2 - high)
        kernels.append(windowed_sinc(high + width / 2, rate, taps_for(rate, width)))
    out = np.ones(1)
    for h in kernels:
        out = np.convolve(out, h)
    return out


def notches(rate: float, base: float = 50.0, transition: float = 1.0) -> np.ndarray:
    """A zero-phase kernel without base, twice base ... under half the rate; each notch is a two-hundredth of its frequency wide."""
    taps = taps_for(rate, transition)
    out = np.zeros(taps)
    out[taps // 2] = 1
    for f in np.arange(base, rate / 2, base):
        half = f / 400 + transition / 2
        upper = windowed_sinc(f + half, rate, taps) if f + half < rate / 2 else np.eye(1, taps, taps // 2)[0]
        out -= upper - windowed_sinc(f - half, rate, taps)
    return out


def blocked(samples: DataFrame, keys: list[str], position: str, value: str, size: int) -> DataFrame:
    """keys, block, start and signal from one row a sample, with positions from 0 without gaps."""
    at = F.floor(F.col(position) / size)
    rows = samples.select(*keys, at.alias("block"), F.struct(F.col(position).alias("n"), F.col(value).cast("double").alias("x")).alias("sample"))
    made = rows.groupBy(*keys, "block").agg(F.sort_array(F.collect_list("sample")).alias("samples"))  # size at most
    return made.select(*keys, "block", F.col("samples")[0]["n"].cast("long").alias("start"), F.transform("samples", lambda s: s["x"]).alias("signal"))


def with_halos(blocks: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """blocks with before and after: up to ``reach`` samples of the neighbours, null at the ends of a recording."""
    here = [F.struct(*keys, "block").alias("at__"), F.col("signal")]
    moved = lambda step: F.struct(*keys, (F.col("block") + step).alias("block")).alias("at__")
    tail = F.slice("signal", F.greatest(F.size("signal") - reach + 1, F.lit(1)), F.lit(reach))
    before = blocks.select(moved(1), tail.alias("before"))
    after = blocks.select(moved(-1), F.slice("signal", 1, reach).alias("after"))
    rows = blocks.select(*here, "start").join(before, "at__", "left").join(after, "at__", "left")
    return rows.select(*[F.col("at__")[k].alias(k) for k in (*keys, "block")], "start", "signal", "before", "after")


def _extended(before: np.ndarray | None, own: np.ndarray, after: np.ndarray | None, reach: int) -> np.ndarray:
    """own with reach samples on either side: the neighbours' or, beyond an end of the recording, the odd reflection and zeros."""
    if before is not None and len(before) < reach:
        raise ValueError("a block that is not the last holds fewer samples than the filter reaches")
    real = np.concatenate([p for p in (before, own, after) if p is not None])
    parts = [real]
    if before is None:
        mirror = (2 * real[0] - real[1 : reach + 1])[::-1]
        parts = [np.zeros(reach - len(mirror)), mirror, real]
    missing = reach - (0 if after is None else len(after))  # a short neighbour is the last block
    mirror = (2 * real[-1] - real[:-1][::-1])[:missing]
    return np.concatenate([*parts, mirror, np.zeros(missing - len(mirror))])


def _in_blocks(blocks: DataFrame, keys: list[str], reach: int, work: Callable[[np.ndarray, int, int], tuple[int, np.ndarray]]) -> DataFrame:
    """blocks with work(extended samples, start, own samples) -> (start, samples) for each."""
    haloed = with_halos(blocks, keys, reach)
    names = [*keys, "block", "start", "signal"]
    kinds = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in (*keys, "block"))

    def run(batches):
        for batch in batches:
            part = lambda c, i: None if not batch.column(c)[i].is_valid else batch.column(c)[i].values.to_numpy(zero_copy_only=False).astype(float)
            starts, signals = [], []
            for i, start in enumerate(batch.column("start").to_pylist()):
                own = part("signal", i)
                if own is None or not len(own):
                    starts.append(start)
                    signals.append(own)
                    continue
                at, done = work(_extended(part("before", i), own, part("after", i), reach), start, len(own))
                starts.append(at)
                signals.append(done)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], pa.array(starts, pa.int64()), pa.array(signals, pa.list_(pa.float64()))], names=names)

    return haloed.mapInArrow(run, f"{kinds}, start long, signal array<double>")


def filtered(blocks: DataFrame, keys: list[str], kernel: np.ndarray) -> DataFrame:
    """The signals convolved with a kernel of an odd number of taps, in place of themselves; by the Fourier transform of each block (overlap-save)."""
    taps = np.asarray(kernel, float)
    reach = len(taps) // 2

    def work(x: np.ndarray, start: int, own: int) -> tuple[int, np.ndarray]:
        size = 1 << (len(x) + len(taps) - 2).bit_length()
        whole = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)
        return start, whole[2 * reach : 2 * reach + own]

    return _in_blocks(blocks, keys, reach, work)


def resampling_kernel(up: int, down: int, zeros: int = 10) -> np.ndarray:
    """A low-pass kernel at ``up`` times the rate, of ``zeros`` zero crossings on either side, of gain up."""
    wide = max(up, down)
    return up * windowed_sinc(0.5, wide, 2 * zeros * wide + 1)


def resampled(blocks: DataFrame, keys: list[str], rate: int, target: int, zeros: int = 10) -> DataFrame:
    """The signals at ``target`` samples a second instead of ``rate``, by polyphase filtering; start counts new samples.

    New sample k stands at the time of old sample k * rate / target; a block keeps those within its own span of time.
    """
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    kernel = resampling_kernel(up, down, zeros)
    half = len(kernel) // 2
    reach = -(-half // up)

    def work(x: np.ndarray, start: int, own: int) -> tuple[int, np.ndarray]:
        first, stop = -(-start * up // down), -(-(start + own) * up // down)
        at = np.arange(first, stop) * down  # on the grid of both rates
        base = at // up - start + reach  # the old sample at or before, in x
        taps = np.arange(-reach, reach + 1)
        place = (at % up)[:, None] - taps[None, :] * up + half
        weights = np.where((place >= 0) & (place < len(kernel)), kernel[np.clip(place, 0, len(kernel) - 1)], 0.0)
        return first, (x[base[:, None] + taps[None, :]] * weights).sum(axis=1)

    return _in_blocks(blocks, keys, reach, work)


def samples_of(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and x: one row a sample."""
    return blocks.select(*keys, "start", F.posexplode("signal").alias("i", "x")).select(*keys, (F.col("start") + F.col("i")).alias("n"), "x")


def cleaned(blocks: DataFrame, keys: list[str], rate: int, low: float = 1.0, notch: float = 50.0, target: int = 256) -> DataFrame:
    """The signals without what is under low or above half the rate less 0.1 Hz, without the mains and its multiples, at target hertz."""
    kernel = np.convolve(band_pass(float(rate), low, rate / 2 - 0.1), notches(float(rate), notch))
    return resampled(filtered(blocks, keys, kernel), keys, rate, target)
