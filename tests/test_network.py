"""Dense networks: gradients against differences, learning on planted data, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import ml, network


@pytest.mark.parametrize("binary", [False, True])
def test_gradients_against_differences(binary):
    rng = np.random.default_rng(2)
    made = network.Network.start([5, 7, 4, 1 if binary else 5], binary)
    x = rng.standard_normal((6, 5))
    y = rng.integers(0, 2, (6, 1)).astype(float) if binary else x
    ws, bs = made.gradients(x, y)
    for p, g in zip([*made.weights, *made.biases], [*ws, *bs], strict=True):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(6)]:
            was, e = p[at], 1e-6
            p[at] = was + e
            up = made.loss(x, y)
            p[at] = was - e
            down = made.loss(x, y)
            p[at] = was
            assert g[at] == pytest.approx((up - down) / (2 * e), abs=1e-6)


def ring(spark, n=1500):
    """Points inside of a circle and outside; no line parts them. A column with a dot and a blank in its name."""
    rng = np.random.default_rng(8)
    xy = rng.uniform(-1, 1, (n, 2))
    rows = [(i, float(a), float(b), int(a * a + b * b < 0.6)) for i, (a, b) in enumerate(xy)]
    return spark.createDataFrame(rows, "id int, `x. 1` double, x2 double, y int")


def test_classifier_learns_what_no_line_parts(spark):
    df = ring(spark).repartition(3)
    names = ["x. 1", "x2"]
    made = network.trained(df.filter("id % 5 != 0"), names, "y", [64, 32], epochs=20)
    assert made.losses[-1] < 0.25 < made.losses[0]
    tested = network.applied(df.filter("id % 5 = 0"), made, names, "p").withColumn("score", F.col("p")[0])
    assert ml.auc(tested, [], "y", "score").first().auc > 0.97
    again = network.trained(df.filter("id % 5 != 0").repartition(5), names, "y", [64, 32], epochs=20)
    assert all(np.array_equal(a, b) for a, b in zip(made.weights, again.weights, strict=True))


def test_autoencoder_finds_the_plane(spark):
    """Ten features that two numbers make: two units in the middle lose little."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 2)) @ rng.standard_normal((2, 10))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, " + ", ".join(f"f{k} double" for k in range(10)))
    names = [f"f{k}" for k in range(10)]
    made = network.trained(df, names, None, [32, 4, 32], epochs=60)
    assert made.losses[-1] < 0.1 * float((x**2).mean())
    assert network.coded(df, made, names).select(F.size("code")).distinct().first()[0] == 4


def test_gaps_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1.0, None, 1), (2, 1.0, 2.0, 0)], "id int, a double, b double, y int").coalesce(1)
    made = network.trained(df, ["a", "b"], "y", [3], epochs=1)
    got = {r.id: r.p for r in network.applied(df, made, ["a", "b"], "p").collect()}
    assert got[1] is None and 0 < got[2][0] < 1
    assert network.trained(df.limit(0), ["a", "b"], "y", [3]).losses == []
    assert network.applied(df.limit(0), made, ["a", "b"], "p").count() == 0


def test_sample_is_bounded_and_the_same_however_dealt(spark):
    df = ring(spark)
    a, b = (network.trained(d, ["x. 1", "x2"], "y", [4], epochs=2, sample=100) for d in (df, df.repartition(7)))
    assert all(np.array_equal(x, y) for x, y in zip(a.weights, b.weights, strict=True))
