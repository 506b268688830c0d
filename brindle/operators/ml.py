"""Features, models and their measures on top of pyspark.ml."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.columns import dense_columns, median_filled, quoted, varying_columns
from brindle.operators.prefix import running_totals
from brindle.operators.stats import average_ranks


def prepared(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Sparse columns dropped, gaps filled with medians, constant columns dropped."""
    kept = dense_columns(df, features)
    filled = median_filled(df, kept)
    return filled, varying_columns(filled, kept)


def scaled(df: DataFrame, features: list[str], train: str | None = None) -> DataFrame:
    """Features less their mean, by their population deviation, both of the rows where the column ``train`` is true (all without it)."""
    x = lambda c: F.when(F.col(train), quoted(c)) if train else quoted(c)
    row = df.agg(*[F.struct(F.avg(x(c)).alias("m"), F.stddev_pop(x(c)).alias("s")) for c in features]).first()
    return df.withColumns({c: (quoted(c) - F.lit(r["m"])) / F.lit(r["s"] or 1.0) for c, r in zip(features, row, strict=True)})


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def logistic(train: DataFrame, features: list[str], label: str, max_iter: int = 1000) -> PipelineModel:
    """Ridge-penalised logistic regression with the usual unit penalty, which per row is 1 / rows."""
    ready = assembled(train, features).cache()
    n = ready.count()
    model = LogisticRegression(labelCol=label, maxIter=max_iter, regParam=1.0 / max(1, n), standardization=False).fit(ready)
    ready.unpersist()
    return PipelineModel([VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), model])


def boosted_trees(train: DataFrame, features: list[str], label: str, seed: int = 42, rounds: int = 20) -> PipelineModel:
    model = GBTClassifier(labelCol=label, seed=seed, maxIter=rounds).fit(assembled(train, features))
    return PipelineModel([VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), model])


def perceptron(train: DataFrame, features: list[str], label: str, seed: int = 42, rounds: int = 50) -> PipelineModel:
    """Two hidden layers of 64 and 32 units; their activation is the sigmoid, the only one pyspark.ml has."""
    model = MultilayerPerceptronClassifier(labelCol=label, layers=[len(features), 64, 32, 2], seed=seed, maxIter=rounds, blockSize=32).fit(assembled(train, features))
    return PipelineModel([VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), model])


def components(df: DataFrame, features: list[str], share: float = 0.95) -> tuple[PipelineModel, int]:
    """A principal component model with as many components as explain the share of variance."""
    ready = assembled(df, features)
    explained = PCA(k=len(features), inputCol="features", outputCol="pca").fit(ready).explainedVariance
    total, k = 0.0, 0
    for v in explained:
        total, k = total + float(v), k + 1
        if total >= share:
            break
    model = PCA(k=k, inputCol="features", outputCol="pca").fit(ready)
    return PipelineModel([VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), model]), k


def importances(model: PipelineModel, features: list[str], k: int = 10) -> list[tuple[str, float]]:
    """The k most important features of a tree model, or the largest coefficients of a linear one; names break ties."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return sorted(zip(features, map(float, values), strict=True), key=lambda kv: (-kv[1], kv[0]))[:k]


def roc_points(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """False and true positive rates at each distinct score, from the highest down."""
    counts = df.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("q", F.col("n") - F.col("p"))
    totals = counts.groupBy(*keys).agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_n"))
    summed = running_totals(counts, keys, F.col(score).desc(), tp="p", fp="q")
    rates = summed.join(totals, keys) if keys else summed.join(F.broadcast(totals))  # one row
    share = lambda part, whole: F.col(part) / F.nullif(F.col(whole), F.lit(0))
    return rates.select(*keys, F.col(score).alias("threshold"), share("fp", "all_n").alias("fpr"), share("tp", "all_p").alias("tpr"))


def auc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Area under the curve by average ranks of distinct scores."""
    counts = df.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    ranked = average_ranks(counts, keys, score, "n")
    sums = ranked.groupBy(*keys).agg(F.sum("p").alias("n1"), F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("p")).alias("r1"))
    n1, n0 = F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double")
    return sums.select(*keys, ((F.col("r1") - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0))).alias("auc"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def publishable(measures: DataFrame, name: str, least: float = 0.8) -> DataFrame:
    return measures.withColumn("publishable", F.col(name) > least)
