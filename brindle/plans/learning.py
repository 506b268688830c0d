"""Queries of feature preparation, models and their measures."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import cohort, ml, network
from brindle.plans.catalog import query
from brindle.session import table

_SIZE = 64
#: The components and one constant column.
_NAMES = [f"x{i}" for i in range(1, _SIZE + 2)]


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of the vectors, the second with gaps, a constant, and a binary target."""
    x = [F.element_at("embedding", i).cast("double").alias(f"x{i}") for i in range(1, _SIZE + 1)]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") >= 5).cast("int").alias("y"), *x)
    return rows.withColumn("x2", F.when(F.col("vec_id") % 4 != 0, F.col("x2"))).withColumn(_NAMES[-1], F.lit(1.0))


_COMPONENTS = ", ".join(f"round(embedding[{i}]::DOUBLE, 6) AS x{i}" for i in range(1, _SIZE + 1) if i != 2)


@query("ml_feature_prep", f"WITH m AS (SELECT *, CASE WHEN vec_id % 4 <> 0 THEN embedding[2]::DOUBLE END AS second FROM embeddings) SELECT vec_id, round(COALESCE(second, (SELECT median(second) FROM m)), 6) AS x2, {_COMPONENTS} FROM m")
def ml_feature_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, kept = ml.prepared(_matrix(spark, sf_dir).select("vec_id", *_NAMES), _NAMES)
    return done.select("vec_id", *[F.round(c, 6).alias(c) for c in kept])


_SCALED = ", ".join(f"round((embedding[{i}]::DOUBLE - avg(embedding[{i}]::DOUBLE) OVER ()) / stddev_pop(embedding[{i}]::DOUBLE) OVER (), 6) AS x{i}" for i in range(1, _SIZE + 1) if i != 2)


@query("ml_scaler", f"SELECT vec_id, {_SCALED} FROM embeddings")
def ml_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components without gaps at mean 0 and deviation 1."""
    whole = [c for c in _NAMES[:-1] if c != "x2"]
    return ml.scaled(_matrix(spark, sf_dir), whole).select("vec_id", *[F.round(c, 6).alias(c) for c in whole])


_SCORED = "WITH s AS (SELECT (label >= 5)::INT AS y, round(list_sum(embedding::DOUBLE[]), 2) AS score FROM embeddings)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target, and the sum of all components as its score."""
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda t, v: t + v)
    return table(spark, sf_dir, "embeddings").select((F.col("label") >= 5).cast("int").alias("y"), F.round(total, 2).alias("score"))


@query("roc_auc", _SCORED + """, c AS (SELECT score, sum(y) AS p, count(*) AS n FROM s GROUP BY score), r AS (SELECT *, sum(n) OVER (ORDER BY score) - (n - 1) / 2 AS rank FROM c),
t AS (SELECT sum(p)::DOUBLE AS n1, sum(n)::DOUBLE AS n, sum(rank * p)::DOUBLE AS r1 FROM r) SELECT round((r1 - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 6) AS auc, (r1 - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) > 0.8 AS publishable FROM t""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.publishable(ml.auc(_scored(spark, sf_dir), [], "y", "score"), "auc").withColumn("auc", F.round("auc", 6))


@query("roc_points", _SCORED + ", c AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS q FROM s GROUP BY score) SELECT score AS threshold, round(sum(q) OVER (ORDER BY score DESC) / sum(q) OVER (), 6) AS fpr, round(sum(p) OVER (ORDER BY score DESC) / sum(p) OVER (), 6) AS tpr FROM c")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.roc_points(_scored(spark, sf_dir), [], "y", "score").select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("confusion_matrix", _SCORED + " SELECT y AS label, (score > 0)::INT AS predicted, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.confusion(_scored(spark, sf_dir).withColumn("predicted", (F.col("score") > 0).cast("int")), "y", "predicted")


def _evaluated(spark: SparkSession, sf_dir: str, fit) -> DataFrame:
    """Split, prepare, scale on the training part, fit; AUC and accuracy on the test part."""
    rows, kept = ml.prepared(_matrix(spark, sf_dir), _NAMES)
    split = cohort.hash_split(rows, ["vec_id"]).withColumn("train", ~F.col("test"))
    ready = ml.scaled(split, kept, "train")
    model = fit(ready.filter("train"), kept, "y")
    tested = model.transform(ready.filter("test")).select("y", "prediction", vector_to_array("probability")[1].alias("score"))
    area = ml.auc(tested, [], "y", "score")
    right = tested.agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy"))
    return ml.publishable(area.join(right), "auc")  # one row by one row


@query("ml_lr_fit")
def ml_lr_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, ml.logistic)


@query("ml_gbt_fit")
def ml_gbt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, ml.boosted_trees)


@query("ml_mlp_fit")
def ml_mlp_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, ml.perceptron)


@query("ml_importances")
def ml_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, kept = ml.prepared(_matrix(spark, sf_dir), _NAMES)
    return spark.createDataFrame(ml.importances(ml.boosted_trees(rows, kept, "y"), kept), "feature string, importance double")


@query("pca95")
def pca95(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, kept = ml.prepared(_matrix(spark, sf_dir), _NAMES)
    model, _ = ml.components(rows, kept)
    return model.transform(rows).select("vec_id", vector_to_array("pca").alias("components"))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The prepared and scaled features with the boolean train."""
    rows, kept = ml.prepared(_matrix(spark, sf_dir), _NAMES)
    split = cohort.hash_split(rows, ["vec_id"]).withColumn("train", ~F.col("test"))
    return ml.scaled(split, kept, "train"), kept


@query("ml_autoencoder")
def ml_autoencoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every row by an autoencoder d-128-32-128-d that learned from the training part, and the error of its reconstruction; tests check gradients and losses."""
    ready, kept = _split(spark, sf_dir)
    made = network.trained(ready.filter("train"), kept, None, [128, 32, 128], epochs=20)
    rows = network.coded(network.applied(ready, made, kept, "again"), made, kept)
    far = F.zip_with(F.array(*[F.col(c) for c in kept]), "again", lambda a, b: (a - b) * (a - b))
    return rows.select("vec_id", "train", "code", (F.aggregate(far, F.lit(0.0), lambda t, v: t + v) / len(kept)).alias("error"))


@query("ml_relu_fit")
def ml_relu_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier of 64 and 32 ReLU units and a sigmoid on the codes of an autoencoder: AUC and accuracy on the test part."""
    ready, kept = _split(spark, sf_dir)
    encoder = network.trained(ready.filter("train"), kept, None, [128, 32, 128], epochs=20)
    size = min(w.shape[1] for w in encoder.weights)
    codes = [f"code{i}" for i in range(size)]
    rows = network.coded(ready, encoder, kept).select("vec_id", "y", "train", *[F.col("code")[i].alias(c) for i, c in enumerate(codes)])
    made = network.trained(rows.filter("train"), codes, "y", [64, 32], epochs=20)
    tested = network.applied(rows.filter("NOT train"), made, codes, "p").select("y", F.col("p")[0].alias("score"))
    right = tested.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"))
    return ml.publishable(ml.auc(tested, [], "y", "score").join(right), "auc")  # one row by one row
