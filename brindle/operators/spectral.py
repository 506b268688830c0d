"""Spectra of fixed-length signals kept as arrays: each row stays in place, with no shuffle and no exploded samples."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _constant(rows: list) -> Column:
    """Nested arrays of doubles as one literal: the JSON text is folded when the plan is made."""
    return F.from_json(F.lit(json.dumps(rows)), "array<array<double>>")


def _let(value: Column, body) -> Column:
    """body of value, which is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)


def hamming(size: int) -> list[float]:
    """Periodic Hamming taper."""
    return [0.54 - 0.46 * math.cos(2 * math.pi * i / size) for i in range(size)]


def hann(size: int) -> list[float]:
    """Periodic Hann taper."""
    return [0.5 - 0.5 * math.cos(2 * math.pi * i / size) for i in range(size)]


def dft_power(signal: Column, size: int, bins: list[int], taper: list[float] | None = None, centred: bool = False) -> Column:
    """Squared magnitudes of the chosen bins of the discrete Fourier transform of ``size`` samples, as an array."""
    t = taper or [1.0] * size
    waves = [_constant([[wave(2 * math.pi * k * i / size) * t[i] for i in range(size)] for k in bins]) for wave in (math.cos, math.sin)]
    x = F.transform(signal, lambda v: v.cast("double"))
    if centred:
        mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / size
        x = _let(x, lambda v: _let(mean(v), lambda m: F.transform(v, lambda u: u - m)))
    parts = lambda v: [F.transform(w, lambda row: _dot(v, row)) for w in waves]
    return _let(x, lambda v: F.zip_with(*parts(v), lambda a, b: a * a + b * b))


def mean_power_frequency(power: Column, frequencies: list[float]) -> Column:
    """Sum of power * frequency by the sum of power."""
    f = F.element_at(_constant([list(map(float, frequencies))]), 1)
    return _dot(power, f) / F.aggregate(power, F.lit(0.0), lambda a, v: a + v)


def dominant_frequency(power: Column, frequencies: list[float]) -> Column:
    """The frequency of the largest power, the lowest among equals."""
    f = F.element_at(_constant([list(map(float, frequencies))]), 1)
    return F.element_at(f, F.array_position(power, F.array_max(power)).cast("int"))


def trapezoid(power: Column, width: float) -> Column:
    """Integral of equally spaced values."""
    pairs = F.zip_with(F.slice(power, F.lit(1), F.size(power) - 1), F.slice(power, F.lit(2), F.size(power) - 1), lambda a, b: (a + b) / 2)
    return F.aggregate(pairs, F.lit(0.0), lambda t, v: t + v) * width


#: Bands in hertz, both ends inclusive.
BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 12), "beta": (12, 30), "gamma": (30, 100)}


def welch_power(signal: Column, total: int, segment: int, rate: float, low: float, high: float) -> tuple[Column, list[float]]:
    """Mean Hann periodogram density over half-overlapping segments for the bins from low to high hertz, and their frequencies."""
    bins = [k for k in range(segment // 2 + 1) if low <= k * rate / segment <= high]
    taper = hann(segment)
    norm = rate * sum(v * v for v in taper)
    starts = list(range(0, total - segment + 1, segment - segment // 2))
    parts = [dft_power(F.slice(signal, s + 1, segment), segment, bins, taper, centred=True) for s in starts]
    doubled = F.element_at(_constant([[(1.0 if k == 0 or 2 * k == segment else 2.0) / norm / len(starts) for k in bins]]), 1)
    total_power = parts[0]
    for p in parts[1:]:
        total_power = F.zip_with(total_power, p, lambda a, b: a + b)
    return F.zip_with(total_power, doubled, lambda a, b: a * b), [k * rate / segment for k in bins]


def band_power(signal: Column, total: int, rate: float, low: float, high: float) -> Column:
    """Power in a band: segments hold two cycles of the lowest frequency (the whole signal if it is shorter)."""
    segment = min(total, int(2 / low * rate))
    power, _ = welch_power(signal, total, segment, rate, low, high)
    return trapezoid(power, rate / segment)


def band_powers(rows: DataFrame, keys: list[str], signal: str, rate: float, bands: dict[str, tuple[float, float]], relative: bool = False, window: float | None = None) -> DataFrame:
    """keys and one column of power a band, for signals of any length: the form of ``band_power`` for many bands and long rows.

    Segments hold two cycles of the band's lowest frequency, or ``window`` seconds. relative: as a share of the power over all
    bins of these segments, null where that is 0. Arrow batches, the segments of a signal as one matrix; null where the signal
    is null or empty.
    """
    import numpy as np
    import pyarrow as pa

    tapers: dict[int, np.ndarray] = {}

    def one(x: np.ndarray, low: float, high: float) -> float | None:
        n = min(len(x), int((window or 2 / low) * rate))
        if not n:
            return None
        cut = np.lib.stride_tricks.sliding_window_view(x, n)[:: n - n // 2]
        taper = tapers.setdefault(n, np.array(hann(n)))
        power = (np.abs(np.fft.rfft((cut - cut.mean(axis=1, keepdims=True)) * taper, axis=1)) ** 2).mean(axis=0) / (rate * (taper**2).sum() or 1)
        power[1 : (n + 1) // 2] *= 2
        k = np.arange(len(power)) * rate / n
        inside = power[(k >= low) & (k <= high)]
        own = float(np.trapezoid(inside, dx=rate / n)) if len(inside) else 0.0
        if not relative:
            return own
        whole = float(np.trapezoid(power, dx=rate / n))
        return own / whole if whole else None

    def run(batches):
        for batch in batches:
            signals = [x.values.to_numpy(zero_copy_only=False).astype(float) if x.is_valid else np.empty(0) for x in batch.column(len(keys))]
            found = [pa.array([one(x, *band) for x in signals], pa.float64()) for band in bands.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *found], names=[*keys, *bands])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, signal).mapInArrow(run, f"{kinds}, " + ", ".join(f"`{b}` double" for b in bands))


def peak_to_peak(signal: Column) -> Column:
    return F.array_max(signal) - F.array_min(signal)


def average_reference(df: DataFrame, at: list[str], value: str) -> DataFrame:
    """value less the mean over channels at the same position; the mean is joined back, so one position may hold many channels."""
    mean = df.groupBy(*at).agg(F.avg(value).alias("reference__"))
    return df.join(mean, at).withColumn("referenced", F.col(value) - F.col("reference__")).drop("reference__")


def spectrogram(rows: DataFrame, keys: list[str], signal: str, rate: float, size: int = 256, overlap: int = 128) -> DataFrame:
    """keys, time (the middle of a segment), frequency and power: the Hann density of overlapping segments of each row's signal.

    A signal that is null or shorter than a segment has no row.
    """
    import numpy as np
    import pyarrow as pa

    taper = np.array(hann(size))
    times = lambda n: (np.arange(n) * (size - overlap) + size / 2) / rate
    frequencies = np.arange(size // 2 + 1) * rate / size
    doubled = np.where((np.arange(len(frequencies)) > 0) & (np.arange(len(frequencies)) * 2 < size), 2.0, 1.0) / (rate * (taper**2).sum())

    def run(batches):
        for batch in batches:
            for i, v in enumerate(batch.column(len(keys))):
                x = v.values.to_numpy(zero_copy_only=False).astype(float) if v.is_valid else np.empty(0)
                if len(x) < size:
                    continue
                cut = np.lib.stride_tricks.sliding_window_view(x, size)[:: size - overlap]
                power = np.abs(np.fft.rfft(cut * taper, axis=1)) ** 2 * doubled
                own = [pa.repeat(batch.column(k)[i], power.size) for k in range(len(keys))]
                found = [np.repeat(times(len(cut)), len(frequencies)), np.tile(frequencies, len(cut)), power.reshape(-1)]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, found)], names=[*keys, "time", "frequency", "power"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, signal).mapInArrow(run, f"{kinds}, time double, frequency double, power double")
