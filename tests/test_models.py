"""Models learn a planted rule: the label follows one feature of four, with a little noise."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from brindle.operators import ml

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((400, 4))
    y = (x[:, 1] + 0.2 * rng.standard_normal(400) > 0).astype(int)
    data = [(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id int, a double, b double, c double, d double, y int").coalesce(2).cache()


@pytest.mark.parametrize("fit", [ml.logistic, lambda *a: ml.boosted_trees(*a, rounds=5), lambda *a: ml.perceptron(*a, rounds=30)], ids=["logistic", "trees", "perceptron"])
def test_models_find_the_rule(rows, fit):
    model = fit(rows.filter("id % 4 != 0"), NAMES, "y")
    tested = model.transform(rows.filter("id % 4 = 0")).select("y", vector_to_array("probability")[1].alias("score"))
    assert ml.auc(tested, [], "y", "score").first().auc > 0.9


def test_importances_name_the_feature(rows):
    for model in (ml.boosted_trees(rows, NAMES, "y", rounds=3), ml.logistic(rows, NAMES, "y")):
        found = ml.importances(model, NAMES, k=2)
        assert len(found) == 2 and found[0][0] == "b" and found[0][1] > found[1][1]


def test_components_explain_the_share(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 1)) @ np.array([[3.0, 1.0, -2.0, 0.5]]) + 0.05 * rng.standard_normal((200, 4))
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double, d double")
    model, k = ml.components(df, NAMES)
    assert k == 1 and len(model.transform(df).first().pca) == 1
