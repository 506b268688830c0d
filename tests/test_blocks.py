"""Filters in blocks against the same filters over the whole signal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import blocks


def reflected(x, reach):
    """x with its odd reflection about either end, as far as it has samples, and zeros beyond."""
    left, right = (2 * x[0] - x[1 : reach + 1])[::-1], (2 * x[-1] - x[:-1][::-1])[:reach]
    return np.concatenate([np.zeros(reach - len(left)), left, x, right, np.zeros(reach - len(right))])


def cut(spark, signals, size):
    rows = [(name, k // size, k, x[k : k + size].tolist()) for name, x in signals.items() for k in range(0, len(x), size)]
    return spark.createDataFrame(rows, "rec string, block long, start long, signal array<double>").repartition(3)


def whole(df):
    out = {}
    for r in df.orderBy("rec", "block").collect():
        at = out.setdefault(r.rec, [])
        assert r.start == len(at)
        at += r.signal
    return {k: np.array(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(6)
    return {f"n{n}": rng.standard_normal(n).cumsum() for n in (1, 2, 9, 64, 65, 100, 127, 640)}


@pytest.mark.parametrize("taps", [1, 5, 31])
def test_filter_equals_the_whole_convolution(spark, signals, taps):
    kernel = np.random.default_rng(taps).standard_normal(taps)
    got = whole(blocks.filtered(cut(spark, signals, 32), ["rec"], kernel))
    for name, x in signals.items():
        assert np.allclose(got[name], np.convolve(reflected(x, taps // 2), kernel, "valid"), atol=1e-9)


@pytest.mark.parametrize("rate, target", [(3, 2), (2, 3), (4, 1), (5, 5)])
def test_resampling_equals_the_whole_one(spark, signals, rate, target):
    got = whole(blocks.resampled(cut(spark, signals, 48), ["rec"], rate, target, zeros=3))
    up, down = target // np.gcd(rate, target), rate // np.gcd(rate, target)
    kernel = blocks.resampling_kernel(up, down, 3)
    reach = -(-(len(kernel) // 2) // up)
    for name, x in signals.items():
        padded = reflected(x, reach)
        dense = np.zeros(len(padded) * up)
        dense[::up] = padded
        want = np.convolve(dense, kernel, "same")[reach * up : (reach + len(x)) * up : down]
        assert np.allclose(got[name], want, atol=1e-9)


def test_cleaning_keeps_the_band_and_drops_the_rest(spark):
    rate, n = 200, 200 * 90
    t = np.arange(n) / rate
    wave = {f: np.sin(2 * np.pi * f * t) for f in (0.02, 10.0, 50.0)}
    got = whole(blocks.cleaned(cut(spark, {"r": sum(wave.values()) + 3}, 8192), ["rec"], rate))["r"]
    want = np.sin(2 * np.pi * 10 * np.arange(len(got)) / 256)
    middle = slice(len(got) // 4, 3 * len(got) // 4)
    assert len(got) == round(n * 256 / rate) and np.abs(got - want)[middle].max() < 0.01


def test_kernels_have_their_gains():
    gain = lambda h, f, rate: abs(np.sum(h * np.exp(-2j * np.pi * f / rate * (np.arange(len(h)) - len(h) // 2))))
    h = blocks.band_pass(256.0, 1.0, 100.0)
    assert gain(h, 0, 256) < 0.01 and gain(h, 1.2, 256) > 0.98 and gain(h, 50, 256) == pytest.approx(1, abs=0.01) and gain(h, 127, 256) < 0.01
    h = blocks.notches(256.0)
    assert gain(h, 50, 256) < 0.01 and gain(h, 100, 256) < 0.01 and gain(h, 45, 256) == pytest.approx(1, abs=0.01) and gain(h, 0, 256) == pytest.approx(1, abs=0.01)


def test_a_block_too_short_for_the_kernel_is_refused(spark, signals):
    with pytest.raises(Exception, match="fewer samples than the filter reaches"):
        blocks.filtered(cut(spark, {"r": signals["n640"]}, 8), ["rec"], np.ones(31)).collect()


def test_null_keys_empty_blocks_and_samples_again(spark):
    df = spark.createDataFrame([(None, i, float(i)) for i in range(10)] + [("a", 0, 1.0)], "rec string, n long, x double")
    made = blocks.blocked(df, ["rec"], "n", "x", 4)
    assert sorted((str(r.rec), r.block, r.start, len(r.signal)) for r in made.collect()) == [("None", 0, 0, 4), ("None", 1, 4, 4), ("None", 2, 8, 2), ("a", 0, 0, 1)]
    line = {(str(r.rec), r.n): r.x for r in blocks.samples_of(blocks.filtered(made, ["rec"], np.ones(3) / 3), ["rec"]).collect()}
    assert [line["None", i] for i in range(10)] == pytest.approx(range(10)) and line["a", 0] == pytest.approx(1 / 3)
    assert blocks.filtered(made.limit(0), ["rec"], np.ones(3)).count() == 0
    holes = spark.createDataFrame([("a", 0, 0, None), ("b", 0, 0, [])], "rec string, block long, start long, signal array<double>")
    assert blocks.filtered(holes, ["rec"], np.ones(3)).filter(F.size("signal") > 0).count() == 0
