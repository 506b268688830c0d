"""Queries of windows, runs and spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import blocks, channels, recording, spectral, windows
from brindle.operators.aggregates import kurtosis_g2, skewness_g1
from brindle.plans.catalog import query
from brindle.session import table

_N, _BINS = 64, list(range(1, 33))
_BASIS = "b AS (SELECT k, list_transform(range(64), lambda i: cos(2 * pi() * k * i / 64)) AS c, list_transform(range(64), lambda i: sin(2 * pi() * k * i / 64)) AS s FROM range(1, 33) AS t(k))"
_POWER = f"WITH {_BASIS}, p AS (SELECT vec_id, label, k, list_inner_product(embedding::DOUBLE[], c)^2 + list_inner_product(embedding::DOUBLE[], s)^2 AS power FROM embeddings, b)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.positioned(table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value"), ["event_type"], "ts", "event_id", bucket=F.date_trunc("hour", "ts"))


_SAMPLES = "WITH samples AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n FROM events)"
_FLAGGED = _SAMPLES + """, win AS (SELECT event_type, n // 8 AS win, avg(value) AS mean FROM samples GROUP BY ALL HAVING count(*) = 8), flagged AS (SELECT event_type, win FROM win WHERE mean > 0.9 * (SELECT avg(value) FROM events)),
runs AS (SELECT event_type, count(*) AS length FROM (SELECT event_type, win, win - row_number() OVER (PARTITION BY event_type ORDER BY win) AS island FROM flagged) GROUP BY event_type, island HAVING count(*) >= 3),
total AS (SELECT event_type, count(*) AS windows FROM win GROUP BY event_type)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return windows.count_windows(_samples(spark, sf_dir), ["event_type"], 8, F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), skewness_g1(v).alias("g1"), kurtosis_g2(v).alias("g2"))


@query("fixed_windows", _SAMPLES + " SELECT event_type, n // 8 AS win, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, round(skewness(value), 4) AS g1, round(kurtosis(value), 4) AS g2 FROM samples GROUP BY ALL HAVING count(*) = 8")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c, n=6: F.round(c, n).alias(c)
    return _windows(spark, sf_dir).select("event_type", "win", r("mean"), r("median"), r("std"), r("g1", 4), r("g2", 4))


@query("tumbling_hour", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def tumbling_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("islands_runs", _FLAGGED + """ SELECT t.event_type, round(COALESCE(sum(length) / any_value(windows) * 100, 0), 6) AS percentage, round(COALESCE(count(length) / (any_value(windows) / 60), 0), 6) AS per_minute, round(COALESCE(avg(length), 0), 6) AS average_length
FROM total t LEFT JOIN runs USING (event_type) GROUP BY t.event_type""")
def islands_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least three windows whose mean is over nine tenths of the overall one, as statistics for each type."""
    wins = _windows(spark, sf_dir)
    level = table(spark, sf_dir, "events").agg((F.avg("value") * 0.9).alias("level"))
    flagged = wins.join(F.broadcast(level)).filter("mean > level").select("event_type", "win")  # level is one row
    totals = wins.groupBy("event_type").agg(F.count(F.lit(1)).alias("windows"))
    out = windows.run_statistics(totals, windows.islands(flagged, ["event_type"], "win", 3), ["event_type"], "windows")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("percentage", "per_minute", "average_length")])


_EPOCHS = "WITH x AS (SELECT vec_id, i - 1 AS n, embedding[i]::DOUBLE AS x FROM embeddings, generate_series(1, 64) AS t(i)), e AS (SELECT vec_id, g.e AS epoch, n - g.e * 12 AS place, x FROM x, generate_series(0, 4) AS g(e) WHERE n BETWEEN g.e * 12 AND g.e * 12 + 15)"


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("n", "x"))
    return windows.overlapping_epochs(x, 16, 12, F.lit(_N))


@query("overlap_epochs", _EPOCHS + " SELECT vec_id, epoch, count(*)::BIGINT AS samples, round(max(x) - min(x), 6) AS peak_to_peak FROM e GROUP BY ALL")
def overlap_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(spark, sf_dir).groupBy("vec_id", "epoch").agg(F.count(F.lit(1)).alias("samples"), F.round(F.max("x") - F.min("x"), 6).alias("peak_to_peak"))


@query("concat_epochs", _EPOCHS + ", ok AS (SELECT vec_id, epoch FROM e GROUP BY ALL HAVING max(x) - min(x) <= 0.5) SELECT vec_id, (dense_rank() OVER (PARTITION BY vec_id ORDER BY epoch) - 1) * 16 + place AS new_n, x FROM e JOIN ok USING (vec_id, epoch)")
def concat_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs within the peak-to-peak limit, laid end to end."""
    epochs = _epochs(spark, sf_dir)
    accepted = epochs.groupBy("vec_id", "epoch").agg((F.max("x") - F.min("x")).alias("range")).filter("range <= 0.5").select("vec_id", "epoch")
    return windows.concatenated(epochs.join(accepted, ["vec_id", "epoch"]), ["vec_id"], 16).select("vec_id", "new_n", "x")


def _powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", spectral.dft_power(F.col("embedding"), _N, _BINS).alias("power"))


@query("dft_power", _POWER + " SELECT vec_id, k::INT AS k, round(power, 5) AS power FROM p")
def dft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _powers(spark, sf_dir).select("vec_id", F.posexplode("power").alias("i", "power"))
    return rows.select("vec_id", (F.col("i") + 1).alias("k"), F.round("power", 5).alias("power"))


@query("mpf_dominant_frequency", _POWER + " SELECT vec_id, round(sum(power * k) / sum(power), 6) AS mpf, arg_max(k, power)::DOUBLE AS dominant FROM p GROUP BY vec_id")
def mpf_dominant_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = [float(k) for k in _BINS]
    p = F.col("power")
    return _powers(spark, sf_dir).select("vec_id", F.round(spectral.mean_power_frequency(p, f), 6).alias("mpf"), spectral.dominant_frequency(p, f).alias("dominant"))


@query("df_variability", _POWER + ", d AS (SELECT vec_id, any_value(label) AS label, arg_max(k, power)::DOUBLE AS df FROM p GROUP BY vec_id) SELECT label, round(stddev_pop(df), 6) AS variability, round(avg(df), 6) AS mean FROM d GROUP BY label")
def df_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _powers(spark, sf_dir).select("label", spectral.dominant_frequency(F.col("power"), [float(k) for k in _BINS]).alias("df"))
    return df.groupBy("label").agg(F.round(F.stddev_pop("df"), 6).alias("variability"), F.round(F.avg("df"), 6).alias("mean"))


@query("band_power_trapz", _POWER + ", t AS (SELECT vec_id, k, power, lag(power) OVER (PARTITION BY vec_id ORDER BY k) AS before FROM p WHERE k BETWEEN 4 AND 8) SELECT vec_id, round(sum((power + before) / 2), 5) AS theta FROM t GROUP BY vec_id")
def band_power_trapz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _powers(spark, sf_dir).select("vec_id", F.round(spectral.trapezoid(F.slice("power", 4, 5), 1.0), 5).alias("theta"))


_WELCH = """WITH bands AS (SELECT * FROM (VALUES ('delta', 1, 4, 64), ('theta', 4, 8, 32), ('alpha', 8, 12, 16), ('beta', 12, 30, 10), ('gamma', 30, 32, 4)) AS t(band, low, high, n)),
seg AS (SELECT vec_id, label, embedding, band, low, high, n, unnest(range(0, 65 - n, n - n // 2)) AS s FROM embeddings, bands),
cut AS (SELECT * EXCLUDE (embedding), list_transform(range(1, n + 1), lambda i: embedding[s + i]::DOUBLE) AS x FROM seg),
tap AS (SELECT * EXCLUDE (x), list_transform(range(1, n + 1), lambda i: (x[i] - list_avg(x)) * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / n))) AS y FROM cut),
bin AS (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM tap),
density AS (SELECT vec_id, any_value(label) AS label, band, any_value(low) AS low, any_value(high) AS high, any_value(n) AS n, k, avg((list_sum(list_transform(range(1, n + 1), lambda i: y[i] * cos(2 * pi() * k * (i - 1) / n)))^2
  + list_sum(list_transform(range(1, n + 1), lambda i: y[i] * sin(2 * pi() * k * (i - 1) / n)))^2) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END / (64 * n * 0.375)) AS power FROM bin GROUP BY vec_id, band, k),
steps AS (SELECT *, (power + lag(power) OVER (PARTITION BY vec_id, band ORDER BY k)) / 2 * 64 / n AS area, (k - 1) * 64 / n >= low AND k * 64 / n <= high AS inside FROM density),
power AS (SELECT vec_id, any_value(label) AS label, band, COALESCE(sum(area) FILTER (inside), 0) AS power, sum(area) AS whole FROM steps GROUP BY vec_id, band)"""


def _bands(spark: SparkSession, sf_dir: str, relative: bool = False, window: float | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"), (F.col("embedding")[0] > 0.1).alias("high"))
    bands = {name: (low, min(high, 32)) for name, (low, high) in spectral.BANDS.items()}
    return spectral.band_powers(rows, ["vec_id", "label", "high"], "x", 64.0, bands, relative, window)


@query("welch_band_powers", _WELCH + " SELECT vec_id, " + ", ".join(f"round(max(power) FILTER (band = '{b}'), 8) AS {b}_power" for b in spectral.BANDS) + " FROM power GROUP BY vec_id")
def welch_band_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power in each band of 64 samples taken as one second at 64 Hz; half-overlapping Hann segments."""
    return _bands(spark, sf_dir).select("vec_id", *[F.round(b, 8).alias(f"{b}_power") for b in spectral.BANDS])


@query("relative_band_powers", _WELCH + " SELECT vec_id, " + ", ".join(f"round(max(power / whole) FILTER (band = '{b}'), 6) AS {b}_share" for b in spectral.BANDS) + " FROM power GROUP BY vec_id")
def relative_band_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as shares of the power over all bins of the band's own segments."""
    return _bands(spark, sf_dir, relative=True).select("vec_id", *[F.round(b, 6).alias(f"{b}_share") for b in spectral.BANDS])


_HALF = _WELCH.replace("('delta', 1, 4, 64), ('theta', 4, 8, 32), ('alpha', 8, 12, 16), ('beta', 12, 30, 10), ('gamma', 30, 32, 4)", "('delta', 1, 4, 32), ('theta', 4, 8, 32), ('alpha', 8, 12, 32), ('beta', 12, 30, 32), ('gamma', 30, 32, 32)")


@query("fixed_window_powers", _HALF + " SELECT vec_id, " + ", ".join(f"round(max(power) FILTER (band = '{b}'), 8) AS {b}_power" for b in spectral.BANDS) + " FROM power GROUP BY vec_id")
def fixed_window_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power in each band from segments of half a second, whatever the band."""
    return _bands(spark, sf_dir, window=0.5).select("vec_id", *[F.round(b, 8).alias(f"{b}_power") for b in spectral.BANDS])


@query("band_channel_matrix", _WELCH + """, g AS (SELECT p.*, CASE WHEN e.embedding[1] > 0.1 THEN 'case' ELSE 'control' END AS side FROM power p JOIN embeddings e USING (vec_id))
SELECT side, band, label, round(avg(power), 8) AS mean, count(*)::BIGINT AS n FROM g WHERE label IN (SELECT label FROM g GROUP BY label HAVING count(DISTINCT side) = 2) GROUP BY ALL""")
def band_channel_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean power of each group, band and channel, over the channels that both groups have; labels are the channels."""
    side = F.when(F.col("high"), "case").otherwise("control")
    long = _bands(spark, sf_dir).select("label", side.alias("side"), *spectral.BANDS).unpivot(["label", "side"], list(spectral.BANDS), "band", "power")
    kept = recording.shared_channels(long, "side", "label")
    return kept.groupBy("side", "band", "label").agg(F.round(F.avg("power"), 8).alias("mean"), F.count(F.lit(1)).alias("n"))


# Labels are recordings and vectors their channels, of 64 samples at 16 Hz. Written from the definitions of the feature row: matrices of channels by samples, of channels by seconds by bins.
_SPECTRA = """WITH x AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings), sample AS (SELECT label, vec_id, unnest(e) AS v FROM x),
cut AS (SELECT label, vec_id, w, list_transform(range(1, 17), lambda i: e[w * 16 + i]) AS y FROM x, range(4) AS t(w)),
tap AS (SELECT label, vec_id, w, list_transform(range(1, 17), lambda i: (y[i] - list_avg(y)) * (0.54 - 0.46 * cos(2 * pi() * (i - 1) / 16))) AS y FROM cut),
p AS (SELECT label, vec_id, w, k, (list_sum(list_transform(range(1, 17), lambda i: y[i] * cos(2 * pi() * k * (i - 1) / 16)))^2 + list_sum(list_transform(range(1, 17), lambda i: y[i] * sin(2 * pi() * k * (i - 1) / 16)))^2) * 2
  / (16 * 16 * (0.54^2 + 0.46^2 / 2)) AS power FROM tap, range(1, 8) AS b(k)),
sec AS (SELECT label, vec_id, w, sum(power * k) / sum(power) AS mpf, arg_max(k, power)::DOUBLE AS df, stddev_pop(power) AS sd, avg(power) AS mean FROM p GROUP BY label, vec_id, w),
runs AS (SELECT label, vec_id, count(*) AS length FROM (SELECT label, vec_id, w - row_number() OVER (PARTITION BY vec_id ORDER BY w) AS island FROM sec WHERE mpf < 3.8) GROUP BY label, vec_id, island HAVING count(*) >= 2),
bin AS (SELECT label, vec_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: e[i] * cos(2 * pi() * k * (i - 1) / 64)))^2 + list_sum(list_transform(range(1, 65), lambda i: e[i] * sin(2 * pi() * k * (i - 1) / 64)))^2) AS size FROM x, range(64) AS b(k)),
bands AS (SELECT * FROM (VALUES ('delta', 1, 4, 32), ('theta', 4, 8, 8), ('alpha', 8, 12, 4)) AS t(band, low, high, n)),
seg AS (SELECT vec_id, e, band, low, high, n, unnest(range(0, 65 - n, n // 2)) AS s FROM x, bands),
part AS (SELECT * EXCLUDE (e), list_transform(range(1, n + 1), lambda i: e[s + i]) AS c FROM seg),
soft AS (SELECT * EXCLUDE (c), list_transform(range(1, n + 1), lambda i: (c[i] - list_avg(c)) * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / n))) AS y FROM part),
dense AS (SELECT vec_id, band, any_value(low) AS low, any_value(high) AS high, any_value(n) AS n, k, avg((list_sum(list_transform(range(1, n + 1), lambda i: y[i] * cos(2 * pi() * k * (i - 1) / n)))^2
  + list_sum(list_transform(range(1, n + 1), lambda i: y[i] * sin(2 * pi() * k * (i - 1) / n)))^2) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END / (16 * n * 0.375)) AS power FROM soft, range(0, 17) AS b(k) WHERE 2 * k <= n GROUP BY vec_id, band, k),
area AS (SELECT vec_id, band, (power + lag(power) OVER (PARTITION BY vec_id, band ORDER BY k)) / 2 * 16 / n AS step, (k - 1) * 16 / n >= low AND k * 16 / n <= high AS inside FROM dense),
pow AS (SELECT vec_id, COALESCE(sum(step) FILTER (inside AND band = 'delta'), 0) AS delta_power, COALESCE(sum(step) FILTER (inside AND band = 'theta'), 0) AS theta_power, COALESCE(sum(step) FILTER (inside AND band = 'alpha'), 0) AS alpha_power,
  0.0::DOUBLE AS beta_power, 0.0::DOUBLE AS gamma_power FROM area GROUP BY vec_id),
lev AS (SELECT label, vec_id, min(v) AS min, max(v) AS max, avg(v) AS mean, median(v) AS median, stddev_pop(v) AS std, skewness(v) AS skewness, kurtosis(v) AS kurtosis FROM sample GROUP BY label, vec_id),
fft AS (SELECT vec_id, avg(size) AS fft_mean, stddev_pop(size) AS fft_std FROM bin GROUP BY vec_id),
ch AS (SELECT vec_id, avg(mean) AS psd_mean, avg(sd) AS psd_std, avg(mpf) AS mean_mpf, median(mpf) AS median_mpf, avg(df) AS dfv_mean, stddev_pop(df) AS dfv_std FROM sec GROUP BY vec_id),
ev AS (SELECT vec_id, sum(length) / 4 * 100 AS pswe_percentage, count(*) / (4 / 60) AS pswe_events_per_minute, avg(length) AS pswe_avg_length FROM runs GROUP BY vec_id),
wide AS (SELECT lev.*, fft.* EXCLUDE (vec_id), pow.* EXCLUDE (vec_id), ch.* EXCLUDE (vec_id), COALESCE(pswe_percentage, 0) AS pswe_percentage, COALESCE(pswe_events_per_minute, 0) AS pswe_events_per_minute, COALESCE(pswe_avg_length, 0) AS pswe_avg_length
  FROM lev JOIN fft USING (vec_id) JOIN pow USING (vec_id) JOIN ch USING (vec_id) LEFT JOIN ev USING (vec_id)),
overall AS (SELECT label, COALESCE(m.middle, 'nan'::DOUBLE) AS pswe_median_percentage, COALESCE(m.n, 0) / (4 * channels / 60) AS pswe_events_per_minute, COALESCE(m.average, 0)::DOUBLE AS pswe_avg_length, s.* EXCLUDE (label), psd.* EXCLUDE (label), f.* EXCLUDE (label), w.* EXCLUDE (label, channels), mp.* EXCLUDE (label)
  FROM (SELECT label, min(v) AS min, max(v) AS max, avg(v) AS mean, median(v) AS median, stddev_pop(v) AS std FROM sample GROUP BY label) s
  JOIN (SELECT label, avg(power) AS psd_mean, stddev_pop(power) AS psd_std FROM p GROUP BY label) psd USING (label) JOIN (SELECT label, avg(size) AS fft_mean, stddev_pop(size) AS fft_std FROM bin GROUP BY label) f USING (label)
  JOIN (SELECT label, avg(delta_power) AS delta_power, avg(theta_power) AS theta_power, avg(alpha_power) AS alpha_power, avg(beta_power) AS beta_power, avg(gamma_power) AS gamma_power, avg(skewness) AS skewness, avg(kurtosis) AS kurtosis, avg(dfv_std) AS dfv_std, count(*) AS channels FROM wide GROUP BY label) w USING (label)
  JOIN (SELECT label, avg(mpf) AS mpf_mean, median(mpf) AS mpf_median, avg(df) AS df_mean FROM sec GROUP BY label) mp USING (label)
  LEFT JOIN (SELECT label, median(length) / 4 * 100 AS middle, count(*) AS n, avg(length) AS average FROM runs GROUP BY label) m USING (label)),
long AS (SELECT label, 'channel' AS scope, vec_id, metric, value FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE (label, vec_id)) INTO NAME metric VALUE value)
  UNION ALL SELECT label, 'overall', NULL, metric, value FROM (UNPIVOT overall ON COLUMNS(* EXCLUDE (label)) INTO NAME metric VALUE value))
SELECT label, scope, vec_id, metric, CASE WHEN NOT isnan(value) THEN round(value, 6) END AS value FROM long"""


@query("feature_long", _SPECTRA)
def feature_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 23 metrics of every channel and of every recording; labels are recordings and vectors their channels, of four seconds at 16 Hz."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    out = recording.feature_long(rows, "label", "vec_id", "x", 16, 1, 7, slow=3.8, least=2)
    return out.withColumn("value", F.round("value", 6))


@query("legal_channels", """
SELECT c_custkey, CASE c_nationkey % 7 WHEN 0 THEN 'F4' WHEN 1 THEN 'T5' END AS electrode, CASE c_nationkey % 7 WHEN 0 THEN 'F4' WHEN 1 THEN 'T5' WHEN 2 THEN 'Fp1' WHEN 3 THEN 'F3' WHEN 4 THEN 'Cz' END AS loose FROM customer
""")
def legal_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded names of seven notations and the electrode of each, by the strict rule and by the loose one."""
    n = F.col("c_nationkey") % 7
    name = F.when(n == 0, "EEG F4").when(n == 1, " EEG T5-O1").when(n == 2, "EEG FP1").when(n == 3, "EEG F3-Ref").when(n == 4, "Cz").when(n == 5, "ECG").otherwise("EEG F4-X1")
    return table(spark, sf_dir, "customer").select("c_custkey", recording.legal_channel(name).alias("electrode"), recording.legal_channel(name, strict=False).alias("loose"))


@query("spectrogram", """
WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, generate_series(1, 64) AS t(i) GROUP BY label, i),
c AS (SELECT label, w, i - w * 8 - 1 AS j, x * (0.5 - 0.5 * cos(2 * pi() * (i - w * 8 - 1) / 16)) AS y FROM m, range(7) AS t(w) WHERE i BETWEEN w * 8 + 1 AND w * 8 + 16),
p AS (SELECT label, w, k, (sum(y * cos(2 * pi() * k * j / 16))^2 + sum(y * sin(2 * pi() * k * j / 16))^2) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / (16 * 16 * 0.375) AS power FROM c, range(9) AS b(k) GROUP BY label, w, k)
SELECT label, (w * 8 + 8) / 16.0::DOUBLE AS time, k::DOUBLE AS frequency, round(power, 9) AS power FROM p
""")
def spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power by time and frequency of the mean vector of each label, as four seconds at 16 Hz."""
    x = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    signals = x.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).select("label", F.transform("s", lambda s: s["x"]).alias("x"))  # 64 values
    return spectral.spectrogram(signals, ["label"], "x", 16.0, 16, 8).withColumn("power", F.round("power", 9))


@query("fft_magnitudes", """
WITH bin AS (SELECT vec_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * cos(2 * pi() * k * (i - 1) / 64)))^2 + list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * sin(2 * pi() * k * (i - 1) / 64)))^2) AS size FROM embeddings, range(64) AS b(k))
SELECT vec_id, round(avg(size), 8) AS fft_mean, round(stddev_pop(size), 8) AS fft_std FROM bin GROUP BY vec_id
""")
def fft_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return recording.signal_statistics(rows, ["vec_id"], "x").select("vec_id", F.round("fft_mean", 8).alias("fft_mean"), F.round("fft_std", 8).alias("fft_std"))


@query("p2p_reject", "SELECT vec_id, list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE > 0.55 AS rejected FROM embeddings")
def p2p_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", (spectral.peak_to_peak(F.col("embedding").cast("array<double>")) > 0.55).alias("rejected"))


@query("average_reference", "WITH s AS (SELECT label, vec_id, i - 1 AS n, embedding[i]::DOUBLE AS x FROM embeddings, generate_series(1, 64) AS t(i)) SELECT vec_id, n::INT AS n, round(x - avg(x) OVER (PARTITION BY label, n), 6) AS referenced FROM s")
def average_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label are channels, their components positions: each less the mean over channels at its position."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("n", "x"))
    return spectral.average_reference(rows, ["label", "n"], "x").select("vec_id", "n", F.round("referenced", 6).alias("referenced"))


# A series goes on beyond its ends as its odd reflection.
_REFLECTED = _SAMPLES + """, ends AS (SELECT event_type, max(n) AS last, arg_min(value, n) AS x0, arg_max(value, n) AS x1 FROM samples GROUP BY event_type),
series AS (SELECT event_type, n, value AS x FROM samples UNION ALL SELECT s.event_type, -n, 2 * x0 - value FROM samples s JOIN ends USING (event_type) WHERE n BETWEEN 1 AND 40 UNION ALL SELECT s.event_type, 2 * last - n, 2 * x1 - value FROM samples s JOIN ends USING (event_type) WHERE n BETWEEN last - 40 AND last - 1)"""


def _event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each event type in the order of time, in blocks of 512."""
    return blocks.blocked(_samples(spark, sf_dir), ["event_type"], "n", "value", 512)


@query("block_filter", _REFLECTED + """ SELECT event_type, n::BIGINT AS n, round(y, 6) AS x FROM (SELECT event_type, n, (lead(x, 2) OVER w + 2 * lead(x, 1) OVER w + 4 * x - lag(x, 1) OVER w + 0.5 * lag(x, 2) OVER w) / 6 AS y FROM series WINDOW w AS (PARTITION BY event_type ORDER BY n)) JOIN ends USING (event_type) WHERE n BETWEEN 0 AND last""")
def block_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter of five taps, which are not symmetric, over series of any length in blocks with halos."""
    made = blocks.filtered(_event_blocks(spark, sf_dir), ["event_type"], np.array([1, 2, 4, -1, 0.5]) / 6)
    return blocks.samples_of(made, ["event_type"]).select("event_type", "n", F.round("x", 6).alias("x"))


@query("block_resample", _REFLECTED + """, tap AS (SELECT m, CASE WHEN m = 0 THEN 1.0 ELSE sin(pi() * m / 3) / (pi() * m / 3) END / 3 * (0.54 + 0.46 * cos(pi() * m / 12)) AS h FROM (SELECT unnest(range(-12, 13)) AS m)),
kernel AS (SELECT m, 2 * h / sum(h) OVER () AS h FROM tap), grid AS (SELECT event_type, unnest(range(0, (2 * (last + 1) + 2) // 3)) AS k FROM ends)
SELECT g.event_type, k::BIGINT AS n, round(sum(x * h), 6) AS x FROM grid g JOIN kernel ON (3 * k - m) % 2 = 0 JOIN series s ON s.event_type = g.event_type AND s.n = (3 * k - m) // 2 GROUP BY ALL""")
def block_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same series at two samples for every three, by polyphase filtering in blocks."""
    made = blocks.resampled(_event_blocks(spark, sf_dir), ["event_type"], 3, 2, zeros=4)
    return blocks.samples_of(made, ["event_type"]).select("event_type", "n", F.round("x", 6).alias("x"))


@query("cleaned_levels")
def cleaned_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, mean and deviation of each series after the whole cleaning chain, as if taken at 64 Hz; kernels of hundreds of taps, which tests hold against whole convolutions."""
    long_blocks = blocks.blocked(_samples(spark, sf_dir), ["event_type"], "n", "value", 4096)
    made = blocks.samples_of(blocks.cleaned(long_blocks, ["event_type"], 64, low=2.0, notch=20.0, target=48), ["event_type"])
    return made.groupBy("event_type").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


_NOISY = """WITH x AS (SELECT label, vec_id, i - 1 AS n, embedding[i]::DOUBLE AS x FROM embeddings, generate_series(1, 64) AS t(i)),
r1 AS (SELECT label, vec_id, n, x - avg(x) OVER (PARTITION BY label, n) AS y FROM x), d1 AS (SELECT label, vec_id, stddev_pop(y) AS d FROM r1 GROUP BY ALL), m1 AS (SELECT *, abs(d - median(d) OVER (PARTITION BY label)) AS far FROM d1),
b1 AS (SELECT label, vec_id, (d - median(d) OVER (PARTITION BY label)) / (1.4826 * median(far) OVER (PARTITION BY label)) AS z FROM m1), good AS (SELECT label, vec_id FROM b1 WHERE abs(z) <= 2),
r2 AS (SELECT label, vec_id, n, x - (SELECT avg(y.x) FROM x y JOIN good USING (label, vec_id) WHERE y.label = x.label AND y.n = x.n) AS y FROM x), d2 AS (SELECT label, vec_id, stddev_pop(y) AS d FROM r2 GROUP BY ALL),
m2 AS (SELECT *, abs(d - median(d) OVER (PARTITION BY label)) AS far FROM d2), b2 AS (SELECT label, vec_id, d, (d - median(d) OVER (PARTITION BY label)) / (1.4826 * median(far) OVER (PARTITION BY label)) AS z FROM m2),
flags AS (SELECT b2.label, b2.vec_id, b2.d, b2.z, abs(b1.z) > 2 OR abs(b2.z) > 2 AS bad FROM b1 JOIN b2 USING (label, vec_id))"""


def _channel_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as recordings of one block, vectors as channels."""
    zero = F.lit(0).cast("long")
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", zero.alias("block"), zero.alias("start"), F.col("embedding").cast("array<double>").alias("signal"))


@query("noisy_channels", _NOISY + " SELECT label, vec_id, round(d, 8) AS deviation, round(z, 5) AS z, bad FROM flags")
def noisy_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of an unusual deviation in two rounds of reference; the limit is 2, so that some of these tables' are."""
    found = channels.noisy_channels(_channel_blocks(spark, sf_dir), "label", "vec_id", 64, limit=2.0, least=None, rounds=2)
    return found.select("label", "vec_id", F.round("deviation", 8).alias("deviation"), F.round("z", 5).alias("z"), "bad")


@query("robust_reference", _NOISY + ", mean AS (SELECT x.label, n, avg(x) AS m FROM x JOIN flags USING (label, vec_id) WHERE NOT bad GROUP BY ALL) SELECT x.vec_id, x.n::BIGINT AS n, round(x - m, 7) AS x FROM x JOIN mean USING (label, n)")
def robust_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each channel less the mean of the recording's good channels."""
    rows = _channel_blocks(spark, sf_dir)
    bad = channels.noisy_channels(rows, "label", "vec_id", 64, limit=2.0, least=None, rounds=2).filter("bad")
    done = channels.robust_reference(rows, bad, "label", "vec_id")
    return blocks.samples_of(done, ["vec_id"]).select("vec_id", "n", F.round("x", 7).alias("x"))


def _head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as channels of a montage, as many to a recording as it has electrodes."""
    names = F.array(*map(F.lit, channels.PLACES))
    n = F.lit(len(channels.PLACES))
    rows = _channel_blocks(spark, sf_dir)
    return rows.select(F.floor(F.col("vec_id") / n).alias("recording"), F.element_at(names, (F.col("vec_id") % n + 1).cast("int")).alias("channel"), "block", "start", "signal")


@query("restored_channels")
def restored_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the channels whose range is too wide, as the others of the recording make them by spherical splines; a test holds them against a direct solve."""
    rows = _head(spark, sf_dir)
    bad = rows.filter(spectral.peak_to_peak(F.col("signal")) > 0.62).select("recording", "channel")
    done = channels.restored(rows, bad, "recording", "channel").join(bad, ["recording", "channel"], "left_semi")
    return blocks.samples_of(done, ["recording", "channel"]).withColumn("x", F.round("x", 6))


@query("scalp_map")
def scalp_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of the channels' ranges over the head for every recording."""
    values = _head(spark, sf_dir).select("recording", "channel", spectral.peak_to_peak(F.col("signal")).alias("range"))
    return channels.scalp_map(values, ["recording"], "channel", "range", 16).select("recording", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("value", 6).alias("value"))


@query("rejection_thresholds", """
WITH e AS (SELECT label, vec_id, vec_id % 5 AS fold, embedding::DOUBLE[] AS x, list_max(embedding::DOUBLE[]) - list_min(embedding::DOUBLE[]) AS ptp FROM embeddings),
ends AS (SELECT label, min(ptp) AS low, max(ptp) AS high FROM e GROUP BY label),
cand AS (SELECT label, j, CASE WHEN j = 10 THEN high ELSE low + (high - low) * j / 10.0::DOUBLE END AS thr FROM ends, generate_series(1, 10) AS t(j)),
s AS (SELECT label, fold, vec_id, ptp, i AS pos, x[i] AS x FROM e, generate_series(1, 64) AS t(i)),
med AS (SELECT label, fold, pos, median(x) AS m FROM s GROUP BY ALL),
mean AS (SELECT m.label, m.fold, m.pos, c.j, c.thr, any_value(m.m) AS m, avg(s.x) AS t FROM med m JOIN cand c ON c.label = m.label JOIN s ON s.label = m.label AND s.pos = m.pos AND s.fold <> m.fold AND s.ptp <= c.thr GROUP BY ALL),
err AS (SELECT label, fold, j, thr, sqrt(avg((t - m)^2)) AS e FROM mean GROUP BY ALL),
tot AS (SELECT label, j, thr, avg(e) AS e, count(*) AS folds FROM err GROUP BY ALL)
SELECT label, round(thr, 8) AS threshold, round(e, 8) AS error FROM tot JOIN (SELECT label, count(DISTINCT fold) AS want FROM e GROUP BY label) w USING (label) WHERE folds = want QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(e, 12), j) = 1
""")
def rejection_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are channels and their vectors epochs, in five folds: the peak-to-peak limit of least cross-validated error."""
    epochs = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("vec_id") % 5).alias("fold"), F.col("embedding").cast("array<double>").alias("x"))
    found = channels.rejection_thresholds(epochs, ["label"], "vec_id", "fold", "x")
    return found.select("label", F.round("threshold", 8).alias("threshold"), F.round("error", 8).alias("error"))
