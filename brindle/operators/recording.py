"""The features of a recording: levels, one-second spectra, slow-wave runs and band powers for each channel and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import spectral, windows
from brindle.operators.aggregates import with_quantiles
from brindle.session import kept

# The channels of the 10-20 montage that are kept, and the electrode that stands for each bipolar pair.
LEGAL_CHANNELS = ["Fp1", "Fp2", "F3", "F4", "C3", "C4", "P3", "P4", "O1", "O2", "F7", "F8", "T3", "T4", "T5", "T6", "Fz", "Cz", "Pz", "A1", "A2", "Fpz", "Oz"]
BIPOLAR = {
    "Fp2-F4": "Fp2", "F4-C4": "F4", "C4-P4": "C4", "P4-O2": "P4", "Fp2-F8": "Oz", "F8-T4": "F8", "T4-T6": "T4", "T6-O2": "T6", "Fz-Cz": "Fz", "Cz-Pz": "Cz",
    "Fp1-F3": "Fp1", "F3-C3": "F3", "C3-P3": "C3", "P3-O1": "P3", "Fp1-F7": "Fpz", "F7-T3": "F7", "T3-T5": "T3", "T5-O1": "T5",
}


def legal_channel(name: Column, strict: bool = True) -> Column:
    """The electrode that a recorded name means, null for all others.

    strict: names without "EEG" mean none; without it and blanks at the ends, a name is an electrode or a bipolar pair, letter
    for letter ("EEG F3", "EEG F4-C4", but not "EEG FP1"). Otherwise any case goes, and bare names and names with a reference
    ("fp1", "EEG F3-Ref") do too.
    """
    pairs = F.create_map(*[F.lit(x) for kv in BIPOLAR.items() for x in kv])
    if strict:
        bare = F.trim(F.replace(name, F.lit("EEG"), F.lit("")))
        electrode = F.coalesce(F.try_element_at(pairs, bare), bare)
        return F.when(name.contains("EEG") & electrode.isin(LEGAL_CHANNELS), electrode)
    bare = F.upper(F.regexp_replace(F.trim(name), r"(?i)^EEG\s+|-(REF|LE|AVG)$", ""))
    known = {c.upper(): c for c in LEGAL_CHANNELS} | {k.upper(): v for k, v in BIPOLAR.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), bare)


def _samples(column, i: int):
    """The samples of row i of an Arrow list column as doubles, or an empty array."""
    import numpy as np

    x = column[i]
    return x.values.to_numpy(zero_copy_only=False).astype(float) if x.is_valid else np.empty(0)


def second_spectra(rows: DataFrame, keys: list[str], signal: str, rate: int, low: int, high: int, together: int = 1 << 16) -> DataFrame:
    """One row for each whole second of each row's signal: win, mpf, dominant, and power and spread (mean and deviation over bins).

    A second is one Welch segment with a Hamming taper and its mean removed, bins of one hertz from low to high. Arrow batches;
    all seconds of a signal are one matrix, and about ``together`` seconds leave in one batch. A signal that is null or shorter
    than a second has no row; a second without power has a null mpf.
    """
    import numpy as np
    import pyarrow as pa

    taper, bins = np.array(spectral.hamming(rate)), np.arange(low, high + 1)

    def run(batches):
        for batch in batches:
            held: list = []

            def done():
                owner = pa.array(np.repeat([i for i, *_ in held], [len(f[0]) for _, *f in held]))
                found = [np.concatenate([f[c] for _, *f in held]) for c in range(5)]
                values = [pa.array(found[0], pa.int32()), pa.array(found[1], from_pandas=True), *map(pa.array, found[2:])]
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(owner) for k in range(len(keys))), *values], names=[*keys, "win", "mpf", "dominant", "power", "spread"])

            for i in range(batch.num_rows):
                values = _samples(batch.column(len(keys)), i)
                n = len(values) // rate
                if not n:
                    continue
                cut = values[: n * rate].reshape(n, rate)
                power = np.abs(np.fft.rfft((cut - cut.mean(axis=1, keepdims=True)) * taper, axis=1)[:, bins]) ** 2 * 2 / (rate * (taper**2).sum())
                power[:, 2 * bins == rate] /= 2  # the bin at half the rate stands for itself
                whole = power.sum(axis=1)
                mpf = np.divide(power @ bins, whole, out=np.full(n, np.nan), where=whole > 0)
                held.append((i, np.arange(n), mpf, bins[power.argmax(axis=1)].astype(float), power.mean(axis=1), power.std(axis=1)))
                if sum(len(f[1]) for f in held) >= together:
                    yield done()
                    held = []
            if held:
                yield done()

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, signal).mapInArrow(run, f"{kinds}, win int, mpf double, dominant double, power double, spread double")


#: What a signal has as a whole: levels, moments, the magnitudes of its Fourier transform.
WHOLE = ("min", "max", "mean", "median", "std", "skewness", "kurtosis", "fft_mean", "fft_std")


def signal_statistics(rows: DataFrame, keys: list[str], signal: str) -> DataFrame:
    """keys, samples and the statistics WHOLE of each row's signal; deviations are those of the population, skewness and kurtosis
    corrected for bias (null without spread, or under three and four samples). All null for a signal that is null or empty."""
    import numpy as np
    import pyarrow as pa

    def one(x: np.ndarray) -> list[float | None]:
        n = len(x)
        if not n:
            return [None] * len(WHOLE)
        mean, d = x.mean(), x - x.mean()
        m2, m3, m4 = (float((d**k).mean()) for k in (2, 3, 4))
        skew = m3 / m2**1.5 * np.sqrt(n * (n - 1)) / (n - 2) if n > 2 and m2 > 0 else None
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6) if n > 3 and m2 > 0 else None
        size = np.abs(np.fft.fft(x))
        return [x.min(), x.max(), mean, np.median(x), np.sqrt(m2), skew, kurt, size.mean(), size.std()]

    def run(batches):
        for batch in batches:
            signals = [_samples(batch.column(len(keys)), i) for i in range(batch.num_rows)]
            found = list(zip(*map(one, signals), strict=True)) or [()] * len(WHOLE)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(list(map(len, signals)), pa.int64()), *(pa.array(f, pa.float64()) for f in found)], names=[*keys, "samples", *WHOLE])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, signal).mapInArrow(run, f"{kinds}, samples long, " + ", ".join(f"{c} double" for c in WHOLE))


def _pooled(mean: str, deviation: str, weight: str) -> list[Column]:
    """Mean and population deviation over all values of groups of which these and the sizes are known."""
    w, m, s = (F.col(c) for c in (weight, mean, deviation))
    whole = F.sum(w * m) / F.sum(F.when(m.isNotNull(), w))
    square = F.sum(w * (s * s + m * m)) / F.sum(F.when(m.isNotNull(), w))
    return [whole, F.sqrt(F.greatest(square - whole * whole, F.lit(0.0)))]


def feature_long(rows: DataFrame, recording: str, channel: str, signal: str, rate: int, low: int = 1, high: int = 40, slow: float = 6.0, least: int = 5) -> DataFrame:
    """The feature row in long form: recording, scope (channel or overall), channel (null overall), metric and value; 23 metrics of either scope.

    rows holds one signal (array of doubles) a channel. A second is slow if its mean power frequency is under ``slow``; at least
    ``least`` slow seconds in a row are an event (pswe). Overall, levels and their deviation, the spectra's powers and the
    magnitudes of the Fourier transform are over all values of all channels, medians exact; band powers, skewness, kurtosis and
    the variability of the dominant frequency (dfv) are means of the channels'. A recording without an event has a null
    pswe_median_percentage. Channels of one recording are of one length.
    """
    keys = [recording, channel]
    bands = {f"{b}_power": limits for b, limits in spectral.BANDS.items()}
    seconds = kept(second_spectra(rows, keys, signal, rate, low, high))  # one row a second, which several sums read
    spectra = seconds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seconds"), F.avg("power").alias("psd_mean"), F.avg("spread").alias("psd_std"), F.avg("mpf").alias("mean_mpf"),
        F.median("mpf").alias("median_mpf"), F.avg("dominant").alias("dfv_mean"), F.stddev_pop("dominant").alias("dfv_std"),
    )
    whole = signal_statistics(rows, keys, signal).withColumn("duration", F.col("samples") / F.lit(float(rate)))
    events = windows.islands(seconds.filter(F.col("mpf") < slow).select(*keys, "win"), keys, "win", least)
    named = {"percentage": "pswe_percentage", "per_minute": "pswe_events_per_minute", "average_length": "pswe_avg_length"}
    runs = windows.run_statistics(whole.filter("samples > 0").select(*keys, "duration"), events, keys, "duration").withColumnsRenamed(named)
    powers = spectral.band_powers(rows, keys, signal, float(rate), bands)
    wide = whole.join(powers, keys, "left").join(spectra, keys, "left").join(runs, keys, "left")
    each = [*WHOLE[:5], "psd_mean", "psd_std", "fft_mean", "fft_std", *bands, "skewness", "kurtosis", "mean_mpf", "median_mpf", *named.values(), "dfv_mean", "dfv_std"]

    mean, std = _pooled("mean", "std", "samples")
    fft_mean, fft_std = _pooled("fft_mean", "fft_std", "samples")
    levels = wide.groupBy(recording).agg(
        F.min("min").alias("min"), F.max("max").alias("max"), mean.alias("mean"), std.alias("std"), fft_mean.alias("fft_mean"), fft_std.alias("fft_std"),
        *[F.avg(c).alias(c) for c in (*bands, "skewness", "kurtosis")], F.avg("dfv_std").alias("dfv_std"), F.max("duration").alias("duration"), F.count(F.lit(1)).alias("channels"),
    )
    psd_mean, psd_std = _pooled("power", "spread", "one")
    spectrum = seconds.withColumn("one", F.lit(1)).groupBy(recording).agg(psd_mean.alias("psd_mean"), psd_std.alias("psd_std"), F.avg("mpf").alias("mpf_mean"), F.avg("dominant").alias("df_mean"))
    own = events.groupBy(recording).agg(F.count(F.lit(1)).alias("events"), F.avg("length").alias("average"))
    medians = with_quantiles(with_quantiles(with_quantiles(
        levels, rows.select(recording, F.explode(signal).alias("x__")), [recording], F.col("x__"), {"median": 0.5}),
        seconds, [recording], F.col("mpf"), {"mpf_median": 0.5}), events, [recording], F.col("length"), {"middle": 0.5})
    total = medians.join(spectrum, recording, "left").join(own, recording, "left")
    minutes = F.nullif(F.col("duration") * F.col("channels") / 60, F.lit(0.0))
    overall = total.withColumns({
        "pswe_median_percentage": F.col("middle") / F.nullif(F.col("duration"), F.lit(0.0)) * 100, "pswe_events_per_minute": F.coalesce("events", F.lit(0)) / minutes, "pswe_avg_length": F.coalesce("average", F.lit(0.0)),
    }).withColumn(channel, F.lit(None).cast(rows.schema[channel].dataType))
    totals = ["pswe_median_percentage", "pswe_events_per_minute", "pswe_avg_length", *WHOLE[:5], "psd_mean", "psd_std", "fft_mean", "fft_std", *bands, "skewness", "kurtosis", "mpf_mean", "mpf_median", "df_mean", "dfv_std"]
    long = lambda df, scope, names: df.select(*keys, *names).unpivot(keys, names, "metric", "value").select(recording, F.lit(scope).alias("scope"), channel, "metric", "value")
    return long(wide, "channel", each).unionByName(long(overall, "overall", totals))


def shared_channels(rows: DataFrame, group: str, channel: str) -> DataFrame:
    """rows of the channels that every group has; group and channel pairs are counted once, not the rows."""
    pairs = rows.select(group, channel).distinct()
    groups = pairs.agg(F.count_distinct(group).alias("groups"))
    names = pairs.groupBy(channel).agg(F.count(group).alias("in")).join(F.broadcast(groups)).filter(F.col("in") == F.col("groups"))  # one row
    return rows.join(names.select(channel), channel, "left_semi")
