import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.operators import aggregates as A
from brindle.operators import cohort, ml, spectral, stats, windows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_weighted_means_and_first_row(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0, None, None, 2), (1, 30.0, None, None, "b", 1), (2, 5.0, 4.0, 7.0, "c", 1)], "id long, w double, x double, y double, t string, o int")
    loose = {r.id: r for r in A.collapse(df, "id", "w", ["w"]).collect()}
    assert loose[1].x == 10.0 / 40 and loose[1].y == 0.0 and loose[1].w == 25.0 and loose[1].t is None
    strict = {r.id: r for r in A.collapse(df, "id", "w", ["o"], strict=True).collect()}
    assert strict[1].x is None and strict[2].x == 4.0 and strict[1].t == "b"


def test_moments_match_their_formulas(spark):
    x = [1.0, 2.0, 2.5, 7.0, 11.0, 4.0]
    n, m = len(x), sum(x) / len(x)
    m2, m3, m4 = (sum((v - m) ** k for v in x) / n for k in (2, 3, 4))
    got = spark.createDataFrame([(v,) for v in x], "x double").agg(A.skewness_g1(F.col("x")), A.kurtosis_g2(F.col("x"))).first()
    assert got[0] == pytest.approx(math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5)
    assert got[1] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6))
    flat = spark.createDataFrame([(1.0,)] * 5, "x double").agg(A.skewness_g1(F.col("x")), A.kurtosis_g2(F.col("x"))).first()
    assert tuple(flat) == (None, None)


def test_islands_and_statistics(spark):
    flagged = spark.createDataFrame([("a", p) for p in (0, 1, 2, 3, 5, 6, 7, 8, 9, 20, 21, 22, 23, 24, 25)], "k string, win long")
    runs = windows.islands(flagged, ["k"], "win", 5)
    assert rows(runs.select("k", "first", "last", "length")) == [("a", 20, 25, 6), ("a", 5, 9, 5)]
    totals = spark.createDataFrame([("a", 60), ("b", 60)], "k string, t long")
    assert rows(windows.run_statistics(totals, runs, ["k"], "t")) == [("a", 11 / 60 * 100, 2.0, 5.5), ("b", 0.0, 0.0, 0.0)]


def test_epochs_segments_and_partial_windows(spark):
    x = spark.range(10).select(F.lit("a").alias("k"), F.col("id").alias("n"), F.col("id").cast("double").alias("x"))
    epochs = windows.overlapping_epochs(x, 4, 3, F.lit(10))
    assert rows(epochs.groupBy("epoch").agg(F.count("x"), F.min("n"))) == [(0, 4, 0), (1, 4, 3), (2, 4, 6)]
    laid = windows.concatenated(epochs.filter("epoch <> 1"), ["k"], 4)
    assert [r.n for r in laid.orderBy("new_n").collect()] == [0, 1, 2, 3, 6, 7, 8, 9]
    assert windows.count_windows(x, ["k"], 4, F.sum("x").alias("s")).count() == 2
    durations = spark.createDataFrame([(599.0,), (600.0,), (3600.0,), (3601.0,)], "d double")
    got = rows(windows.segments(durations, "d", 3600, least=600).select("d", "segment", "start_time", "end_time"))
    assert got == [(3600.0, 0, 0.0, 3600.0), (3601.0, 0, 0.0, 3600.0), (3601.0, 1, 3600.0, 3601.0), (600.0, 0, 0.0, 600.0)]


def test_adaptive_segments_shrink_fail_and_resume(spark):
    """One recording fails at full length, one never works, one is short, two have no duration; then a run goes on from its first rows."""
    rec = spark.createDataFrame([("a", 7000.0), ("never", 4000.0), ("short", 100.0), ("none", None), ("zero", 0.0)], "r string, d double")
    works = {("a", 0.0, 3000.0), ("a", 3000.0, 6600.0), ("short", 0.0, 100.0)}
    seen = []

    def attempt(df):
        ok = F.lit(None).cast("boolean")
        for r, s, e in works:
            ok = F.when((F.col("r") == r) & (F.col("start_time") == s) & (F.col("end_time") == e), True).otherwise(ok)
        seen.append(df.count())
        return df.withColumn("ok", ok)

    full = windows.adaptive_segments(rec, ["r"], "d", attempt, shrink=600)
    rows = sorted(map(tuple, full.collect()))
    assert rows == [("a", 0, 0.0, 3000.0, True), ("a", 1, 3000.0, 6600.0, True), ("a", 2, 6600.0, 7000.0, False), ("never", 0, 0.0, 3600.0, False), ("never", 1, 3600.0, 4000.0, False), ("short", 0, 0.0, 100.0, True)]
    assert seen[0] == 3 and seen[1] == 2
    again = windows.adaptive_segments(rec, ["r"], "d", attempt, shrink=600, done=full.filter("segment = 0"))
    assert sorted(map(tuple, again.collect())) == rows
    assert windows.adaptive_segments(rec, ["r"], "d", attempt, done=full).count() == len(rows) and windows.adaptive_segments(rec.limit(0), ["r"], "d", attempt).count() == 0


def test_containment_by_grams(spark):
    from brindle.operators import cohort

    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for i in range(80)] + [(90, None), (91, "abcabc"), (92, "abcabc"), (93, "a\U0001f600b")]
    needles = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 5))), k) for k in range(40)] + [(None, 50), ("abcabc", 51), ("a", 52), ("\U0001f600", 53), ("zzz", 54)]
    left, right = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(needles, "needle string, k int")
    out = cohort.containing(left, "text", right, "needle")
    assert sorted((r.id, r.k) for r in out.collect()) == sorted((i, k) for i, t in texts for n, k in needles if t is not None and n and n in t)
    assert sorted(out.columns) == ["id", "k", "needle", "text"] and "NestedLoop" not in out._jdf.queryExecution().toString()


def test_matching_takes_each_person_once(spark):
    cases = spark.createDataFrame([("x",)] * 2 + [("y",)], "s string")
    controls = spark.createDataFrame([(f"p{i % 11}", "x" if i % 2 else "y", f"f{i:02d}") for i in range(40)], "person string, s string, file string")
    got = cohort.match_controls(cases, controls, ["s"], "person", "file", 4).collect()
    assert len({r.person for r in got}) == len(got)
    by = {s: sum(r.s == s for r in got) for s in "xy"}
    assert by["x"] <= 8 and by["y"] <= 4


def test_provenance_and_unmatched(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, y string")
    assert rows(cohort.with_provenance(a, b, "id").select("id", "provenance")) == [(1, "left_only"), (2, "both"), (3, "right_only")]
    assert rows(cohort.unmatched(a, b, "id")) == [(1, "a")] and rows(cohort.matched(a, b, "id")) == [(2, "b")]


def test_coercion_and_missing_values(spark):
    df = spark.createDataFrame([("1", "x", "NaN"), ("2.5", "3", "banana"), (None, None, None)], "`a.b` string, m string, t string")
    out = C.coerce_numeric(df, ["a.b", "m"])
    assert dict(out.dtypes) == {"a.b": "double", "m": "string", "t": "string"}
    assert [r[0] for r in df.select(C.text_to_null(F.col("t"))).collect()] == [None, "banana", None]
    assert [r[0] for r in df.select(C.text_to_null(F.col("t"), exact=False)).collect()] == [None, None, None]
    assert C.tidy_names(df.withColumnRenamed("m", "<m>")).columns == ["a_b", "m", "t"]
    nums = spark.createDataFrame([(1.0, None, 5.0, None), (2.0, None, 5.0, 1.0), (9.0, 3.0, 5.0, None), (4.0, None, None, 2.0)], "a double, b double, c double, d double")
    assert C.dense_columns(nums, nums.columns) == ["a", "c", "d"] and C.varying_columns(nums, ["a", "b", "c"]) == ["a"]
    assert [r.d for r in C.median_filled(nums, ["d"]).collect()] == [1.5, 1.0, 1.5, 2.0]


def test_names(spark):
    df = spark.createDataFrame([("EEG FP1", 17), ("FZ", 31), ("Fp2-F4", 91)], "c string, age int")
    assert [r[0] for r in df.select(C.last_token_capitalised(F.col("c"))).collect()] == ["EEG Fp1", "Fz", "Fp2-f4"]
    assert [r[0] for r in df.select(C.renamed(F.col("c"), {"FZ": "Fz"})).collect()] == ["EEG FP1", "Fz", "Fp2-F4"]
    assert [r[0] for r in df.select(C.age_band(F.col("age"))).collect()] == [None, "31-40", "90+"]
    assert C.discover_column(df, ["FZ"]) == "c" and C.discover_column(df, ["absent"]) is None
    assert C.prefixed(df, "s_", "c").columns == ["c", "s_age"] and C.to_front(df, "age").columns == ["age", "c"]


@settings(max_examples=40, deadline=None)
@given(st.floats(-40, 40), st.integers(1, 400))
def test_student_tail_against_integration(t, df):
    k = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    steps = 4000
    # substitution t = sqrt(df) * tan(u)
    a, b = math.atan(abs(t) / math.sqrt(df)), math.pi / 2
    f = lambda u: math.exp(k + 0.5 * math.log(df)) * math.cos(u) ** (df - 1) if u < b else float(df == 1) * math.exp(k)
    h = (b - a) / steps
    area = h / 3 * sum((1 if i in (0, steps) else 4 if i % 2 else 2) * f(a + i * h) for i in range(steps + 1))
    assert stats.beta_tail(t, df) == pytest.approx(2 * area, abs=2e-5)


def test_exact_u_counts_arrangements():
    import itertools

    n1, n2 = 3, 4
    us = [sum(a > b for a in one for b in set(range(7)) - set(one)) for one in itertools.combinations(range(7), n1)]
    for u in range(n1 * n2 + 1):
        low = min(u, n1 * n2 - u)
        assert stats.exact_mann_whitney(u, n1, n2) == pytest.approx(min(1, 2 * sum(v <= low for v in us) / len(us)))


def test_correction_is_monotone_and_at_least_p(spark):
    random.seed(3)
    p = [(i, random.random() ** 2) for i in range(40)]
    out = sorted((r.p, r.adj_p_value) for r in stats.adjusted(spark.createDataFrame(p, "i int, p double"), "p", [], ["i"]).collect())
    assert all(b >= a for a, b in out) and all(x[1] <= y[1] + 1e-15 for x, y in zip(out, out[1:], strict=False)) and out[-1][1] <= 1


def test_auc_is_u_over_pairs(spark):
    random.seed(5)
    data = [(random.randint(0, 1), random.randint(0, 9) / 10) for _ in range(80)]
    pos, neg = ([s for y, s in data if y == v] for v in (1, 0))
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert ml.auc(spark.createDataFrame(data, "y int, s double"), [], "y", "s").first().auc == pytest.approx(want)


def plain_band_power(x, rate, low, high):
    """Welch's density by numpy's transform, integrated by trapezoids."""
    size = min(len(x), int(2 / low * rate))
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    found = []
    for start in range(0, len(x) - size + 1, size - size // 2):
        part = x[start : start + size]
        power = np.abs(np.fft.rfft((part - part.mean()) * taper)) ** 2 / (rate * (taper**2).sum())
        power[1 : len(power) - (size % 2 == 0)] *= 2
        found.append(power)
    at = np.fft.rfftfreq(size, 1 / rate)
    density, at = np.mean(found, axis=0)[(at >= low) & (at <= high)], at[(at >= low) & (at <= high)]
    return float(((density[1:] + density[:-1]) / 2 * np.diff(at)).sum())


def test_a_null_p_is_not_a_test(spark):
    rows = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.9), (4, None)], "id int, p double")
    got = {r.id: (r.adj_p_value, r.significant) for r in stats.adjusted(rows, "p", [], ["id"]).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == pytest.approx([0.03, 0.03, 0.9])
    assert got[1][1] and not got[3][1] and got[4] == (None, False)


def test_comparison_of_small_groups_is_exact_and_gated(spark):
    random.seed(9)
    skewed = [("skewed", g, math.exp(3 * random.random()) if g == "b" else math.exp(random.gauss(0, 2))) for g in "ab" for _ in range(8)] + [("skewed", "a", 10_000.0)]
    even = [("even", g, random.gauss(0 if g == "a" else 1, 1)) for g in "ab" for _ in range(9)]
    flat = [("flat", g, 1.0) for g in "ab" for _ in range(5)] + [("flat", "c", 1.0), ("even", "a", None), ("even", None, 1.0)]
    rows = stats.compare_groups(spark.createDataFrame(skewed + even + flat, "variable string, side string, value double"), "variable", "side", "value")
    got = {r.variable: r for r in rows.collect()}
    assert set(got) == {"skewed", "even", "flat"} and got["flat"].p_value is None and not got["flat"].significant
    a, b = ([v for _, g, v in skewed if g == s] for s in "ab")
    u = sum(x > y for x in a for y in b)
    assert got["skewed"].test == "Mann-Whitney U" and got["skewed"].statistic == u
    every = list(itertools.combinations(range(17), 9))
    centre = 9 * 8 / 2
    us = [sum(c) - 9 * 8 / 2 for c in every]
    assert got["skewed"].p_value == pytest.approx(min(1, sum(abs(v - centre) >= abs(u - centre) for v in us) / len(us)))
    assert got["even"].test == "T-test" and got["even"].p_value < 0.2
    t, df = abs(got["even"].statistic), 16
    x = np.linspace(0, t, 200_001)
    density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
    assert got["even"].p_value == pytest.approx(1 - 2 * float(((density[1:] + density[:-1]) / 2).sum() * (x[1] - x[0])), abs=1e-7)


def test_sine_has_its_frequency_and_parseval(spark):
    x = [math.sin(2 * math.pi * 5 * i / 64) + 0.1 * math.cos(2 * math.pi * 9 * i / 64) for i in range(64)]
    df = spark.createDataFrame([(1, x)], "id int, x array<double>")
    bins = list(range(64))
    p = spectral.dft_power(F.col("x"), 64, bins)
    half = [float(k) for k in range(1, 33)]
    q = spectral.dft_power(F.col("x"), 64, list(range(1, 33)))
    got = df.select(p.alias("p"), spectral.dominant_frequency(q, half).alias("df"), spectral.mean_power_frequency(q, half).alias("mpf"), *[spectral.band_power(F.col("x"), 64, 64.0, low, min(high, 32)).alias(n) for n, (low, high) in spectral.BANDS.items()]).first()
    assert sum(got.p) / 64 == pytest.approx(sum(v * v for v in x))
    assert got.df == 5.0 and 5 < got.mpf < 5.1
    for name, (low, high) in spectral.BANDS.items():
        assert got[name] == pytest.approx(plain_band_power(np.array(x), 64.0, low, min(high, 32)), rel=1e-9), name


def test_trim_regression_and_dispatch(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 2, 1, 2, 3, 100]] + [("b", 5.0)], "g string, x double")
    assert rows(stats.trimmed_outliers(df, "g", "x", 2)) == sorted(("a", float(v)) for v in [1, 2, 3, 2, 1, 2, 3])
    line = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0), (None, 1.0), (4.0, 9.5)], "x double, y double")
    fit = stats.simple_regression(line, [], "y", "x").first()
    assert fit.n == 4 and fit.df == 2 and fit.slope == pytest.approx(2.15) and 0.99 < fit.r2 < 1
    wide = spark.createDataFrame([(i % 2, i % 2 + 1, float(i), i % 3, 1) for i in range(8)], "b int, c int, n double, `o (x)` int, k int")
    assert stats.classified_columns(wide, wide.columns) == {"b": "binary", "n": "numeric", "o (x)": "ordinal"}  # two values that are not 0 and 1 are skipped


def test_resized_mean_and_sampling(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0, 5.0]), (3, [1.0, 1.0, 1.0, 1.0])], "id int, x array<double>")
    assert rows(A.resized_mean(df, "id", "x")) == [(0, 5 / 3), (1, 7 / 3), (2, 7 / 3)]
    many = spark.range(100).select((F.col("id") % 4).alias("g"), "id")
    picked = cohort.sample_per_group(many, ["g"], ["id"], 5)
    assert rows(picked) == rows(cohort.sample_per_group(many.repartition(7), ["g"], ["id"], 5)) and picked.count() == 20
    share = cohort.hash_split(spark.range(5000), ["id"]).filter("test").count() / 5000
    assert 0.15 < share < 0.25


def test_recorded_names_and_odd_signals(spark):
    from brindle.operators import recording

    names = spark.createDataFrame([("EEG F4-Ref",), (" Fp1 ",), ("T5-O1",), ("ECG",), (None,)], "n string")
    assert [r[0] for r in names.select(recording.legal_channel(F.col("n"), strict=False)).collect()] == ["F4", "Fp1", "T5", None, None]
    strict = spark.createDataFrame([("EEG F4",), ("EEG F3-Ref",), ("Fp1",), ("EEG FP1",), (" F4-C4 EEG",), (None,)], "n string")
    assert [r[0] for r in strict.select(recording.legal_channel(F.col("n"))).collect()] == ["F4", None, None, None, "F4", None]
    odd = spark.createDataFrame([("r", "flat", [1.0] * 40), ("r", "short", [1.0, 2.0]), ("r", "none", None), ("r", "empty", [])], "rec string, ch string, x array<double>")
    got = {(r.ch, r.metric): r.value for r in recording.feature_long(odd, "rec", "ch", "x", 16, 1, 7).collect()}
    assert got["flat", "mean_mpf"] is None and got["flat", "psd_std"] == 0 and got["flat", "pswe_percentage"] == 0 and got["flat", "median"] == 1
    assert got["short", "median"] == 1.5 and got["short", "mean_mpf"] is None and got["none", "mean"] is None and got["empty", "mean"] is None
    assert got[None, "pswe_median_percentage"] is None and got[None, "pswe_events_per_minute"] == 0
    assert (got[None, "min"], got[None, "max"], got[None, "median"]) == (1.0, 2.0, 1.0) and got[None, "mean"] == pytest.approx(43 / 42)
    assert sum(ch is None for ch, _ in got) == 23 and sum(ch == "flat" for ch, _ in got) == 23
    powers = spectral.band_powers(odd, ["ch"], "x", 16.0, {"theta": (4, 8)}).collect()
    assert {r.ch for r in powers if r.theta is None} == {"none", "empty"}
    assert recording.feature_long(odd.limit(0), "rec", "ch", "x", 16, 1, 7).count() == 0


def test_positions_by_bucket_are_those_of_one_window(spark):
    import datetime

    at = lambda i: None if i % 13 == 0 else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=37 * (i % 50))
    df = spark.createDataFrame([("a" if i % 3 else None, at(i), i) for i in range(200)], "k string, ts timestamp, id long")
    plain = windows.positioned(df, ["k"], "ts", "id")
    split = windows.positioned(df, ["k"], "ts", "id", bucket=F.date_trunc("hour", "ts"))
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, split.collect()), key=repr)
    assert windows.positioned(df.limit(0), ["k"], "ts", bucket=F.date_trunc("hour", "ts")).count() == 0


def test_columns_of_one_name_and_a_fixed_window(spark):
    twice = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a.x", "b date", "a.x")
    assert C.first_of_each_name(twice).columns == ["a.x", "b date"] and rows(C.first_of_each_name(twice)) == [(1, 2)]
    assert C.without_columns(twice, ["DATE"]).columns == ["a.x", "a.x"]
    tone = spark.createDataFrame([(1, [math.sin(2 * math.pi * 6 * i / 64) for i in range(256)])], "id int, x array<double>")
    got = spectral.band_powers(tone, ["id"], "x", 64.0, {"theta": (4, 8)}, window=2.0).first().theta
    assert got == pytest.approx(0.5, rel=0.01)  # the power of a sine of amplitude one
    # half-second segments: a Hann taper spreads the tone 1 : 4 : 1 over 4, 6 and 8 Hz, and the band's ends count half
    assert spectral.band_powers(tone, ["id"], "x", 64.0, {"theta": (4, 8)}, relative=True).first().theta == pytest.approx(5 / 6)
