"""Aggregates with the definitions that matter here: bias-corrected moments, weighted means, profiles."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brindle.functions.columns import numeric_columns, quoted
from brindle.operators.quantiles import MOST, quantiles
from brindle.session import kept


def skewness_g1(x: Column) -> Column:
    """Bias-corrected sample skewness; null under three values or without spread."""
    n = F.count(x).cast("double")
    return F.when((n > 2) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_g2(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null under four values or without spread."""
    n = F.count(x).cast("double")
    return F.when((n > 3) & (F.stddev_pop(x) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum of x*w over values of x, by the sum of all weights; 0 if x has no value."""
    return F.coalesce(F.sum(x * w), F.lit(0.0)) / F.sum(w)


def weighted_mean_strict(x: Column, w: Column) -> Column:
    """Null if any x is null."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x * w) / F.sum(w))


def collapse(df: DataFrame, key: str, weight: str, order: list[str], strict: bool = False) -> DataFrame:
    """One row a key: weighted means of numeric columns (the weight's own included), the first row's value of the others.

    The first row is that of the least ``order``; its nulls stay.
    """
    mean = weighted_mean_strict if strict else weighted_mean
    numbers = [c for c in numeric_columns(df) if c != key]
    others = [c for c in df.columns if c != key and c not in numbers]
    means = [mean(quoted(c), quoted(weight)).alias(c) for c in numbers]
    if not others:
        return df.groupBy(key).agg(*means)
    first = F.min_by(F.struct(*[quoted(c).alias(c) for c in others]), F.struct(*order)).alias("first__")
    return df.groupBy(key).agg(*means, first).select(key, *numbers, *[F.col("first__")[c].alias(c) for c in others])


def unpivoted(df: DataFrame, ids: list[str], names: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    """Long form of columns, as doubles."""
    return df.select(*ids, *[quoted(c).cast("double").alias(c) for c in names]).unpivot(ids, names, name, value)


def unique_counts(long: DataFrame, plain: DataFrame) -> DataFrame:
    """variable and unique: how many distinct values each has, from the long form and, in plain, count and about (estimated distinct values).

    Rows of a variable of about MOST values or more are dealt by value, MOST to a task at most on average, before any task collects
    distinct ones: a task that read a large file would hold nearly all of its values. A frequent value is dealt to 16 tasks. The estimate
    only chooses between two exact ways.
    """
    large = plain.filter(F.col("about") > MOST)
    n = large.agg(F.sum("count")).first()[0]
    if n:
        parts = max(math.ceil(n / MOST), int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        named = F.broadcast(large.select("variable"))
        dealt = long.filter("value IS NOT NULL").join(named, "variable").withColumn("turn", F.monotonically_increasing_id() % 16).repartition(parts, "value", "turn")
        long = long.join(named, "variable", "left_anti").unionByName(dealt.drop("turn"))
    return long.groupBy("variable").agg(F.count_distinct("value").alias("unique"))


def profile(df: DataFrame, names: list[str]) -> DataFrame:
    """count, mean, std, median, unique, min, max and iqr of columns, from their long form. Quartiles are exact at any size."""
    v = F.col("value")
    long = unpivoted(df, [], names)
    plain = kept(long.groupBy("variable").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.approx_count_distinct(v).alias("about"), F.min(v).alias("min"), F.max(v).alias("max")
    ))
    q = quantiles(long, ["variable"], "value", [0.25, 0.5, 0.75]).select("variable", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))
    return plain.join(unique_counts(long, plain), "variable").join(q, "variable", "left").select("variable", "count", "mean", "std", "median", "unique", "min", "max", "iqr")


def six_numbers(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """N, mean, median, max, min and sample standard deviation; the median is exact at any size, and null keys are a group."""
    x = quoted(name)
    plain = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.max(x).alias("max"), F.min(x).alias("min"), F.stddev_samp(x).alias("std"))
    return with_quantiles(plain, df, keys, x, {"median": 0.5}).select(*keys, "n", "mean", "median", "max", "min", "std")


def with_quantiles(groups: DataFrame, df: DataFrame, keys: list[str], x: Column, shares: dict[str, float]) -> DataFrame:
    """groups (one row for each of the keys) with a column for each named share of df's values x; null without a value."""
    q = quantiles(df, keys, x, list(shares.values()))
    named = q.select(*[F.col(k).alias(f"{k}__q") for k in keys], *[F.col("q")[i].alias(c) for i, c in enumerate(shares)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__q")) for k in keys], F.lit(True))
    return groups.join(named, same, "left").drop(*[f"{k}__q" for k in keys])


def proportions(df: DataFrame, *keys: str) -> DataFrame:
    """Counts of each key and their share of all rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def first_per_key(df: DataFrame, keys: list[str], *order: Column, k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place__", place).filter(F.col("place__") <= k).drop("place__")


def resized_mean(df: DataFrame, key: str, values: str) -> DataFrame:
    """Arrays brought to their median length by repeating or cutting, then averaged by position: pos and mean."""
    median = quantiles(df, [], F.size(values), [0.5]).first()
    size = F.lit(median["q"][0] if median else 0).cast("int")
    spread = df.filter(F.size(values) > 0).withColumn("pos", F.explode(F.sequence(F.lit(0), size - 1)))
    x = F.element_at(values, (F.col("pos") % F.size(values) + 1).cast("int"))
    return spread.select("pos", x.alias("x")).groupBy("pos").agg(F.avg("x").alias("mean"))


def typed_profile(df: DataFrame) -> DataFrame:
    """variable, count, unique and, for numbers, mean, std, median, min, max and iqr; halves are rounded to even, at two places.

    Texts and dates have nulls there. No task holds all values of a column.
    """
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    others = [c for c in df.columns if c not in numbers]
    shown = ["mean", "std", "median", "min", "max", "iqr"]
    out = None
    if numbers:
        out = profile(df, numbers).select("variable", "count", "unique", *[F.bround(c, 2).alias(c) for c in shown])
    if others:
        long = df.select(*[quoted(c).cast("string").alias(c) for c in others]).unpivot([], others, "variable", "value")
        plain = kept(long.groupBy("variable").agg(F.count("value").alias("count"), F.approx_count_distinct("value").alias("about")))
        texts = plain.join(unique_counts(long, plain), "variable").select("variable", "count", "unique", *[F.lit(None).cast("double").alias(c) for c in shown])
        out = texts if out is None else out.unionByName(texts)
    return out


def case_control_matrix(cases: DataFrame, controls: DataFrame) -> DataFrame:
    """is_case and the numeric columns, as doubles, that both tables have; rows with a gap in any of them go."""
    numbers = lambda df: [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    shared = [c for c in numbers(cases) if c in set(numbers(controls))]
    side = lambda df, k: df.select(F.lit(k).alias("is_case"), *[quoted(c).cast("double").alias(c) for c in shared])
    return side(cases, 1).unionByName(side(controls, 0)).dropna()


def pair_correlations(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """a, b, r and n of every pair of columns by keys, over rows that lack none of the columns; one aggregate."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    found = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(quoted(a), quoted(b)).alias("r"), F.count(F.lit(1)).alias("n")) for a, b in pairs]
    return df.dropna(subset=names).groupBy(*keys).agg(F.array(*found).alias("pairs")).select(*keys, F.inline("pairs"))


def histogram(df: DataFrame, name: str, bins: int, keys: list[str]) -> DataFrame:
    """bin and n by keys, over bins equal parts of the range of all values; the last bin is closed, and values without spread are in bin 0."""
    x = quoted(name)
    ends = df.agg(F.min(x).alias("low__"), F.max(x).alias("high__"))
    place = F.coalesce((x - F.col("low__")) / F.nullif(F.col("high__") - F.col("low__"), F.lit(0.0)) * bins, F.lit(0.0))
    rows = df.filter(x.isNotNull()).join(F.broadcast(ends))  # one row
    return rows.groupBy(*keys, F.least(F.floor(place), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, name: str, keys: list[str], points: int = 64) -> DataFrame:
    """x and density by keys on points equal steps from the least to the largest value of all: Gaussian kernels of Scott's width.

    Different values are counted before they meet the points. Groups of fewer than two values, or without spread, have no row.
    """
    x = quoted(name).cast("double")
    rows = df.filter(x.isNotNull()).select(F.struct(*keys or [F.lit(0).alias("all")]).alias("key__"), x.alias("x__"))
    ends = rows.agg(F.min("x__").alias("low__"), F.max("x__").alias("high__"))
    widths = rows.groupBy("key__").agg(F.count(F.lit(1)).alias("n__"), F.stddev_samp("x__").alias("sd__")).filter("n__ > 1 AND sd__ > 0")
    widths = widths.withColumn("h__", F.col("sd__") * F.pow(F.col("n__").cast("double"), F.lit(-0.2)))
    counts = rows.groupBy("key__", "x__").agg(F.count(F.lit(1)).alias("c__")).join(widths, "key__").join(F.broadcast(ends))  # one row
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.col("low__") + (F.col("high__") - F.col("low__")) * k / (points - 1))
    near = counts.withColumn("x", F.explode(at)).withColumn("z__", (F.col("x") - F.col("x__")) / F.col("h__"))
    part = F.col("c__") * F.exp(-F.col("z__") * F.col("z__") / 2) / (F.col("n__") * F.col("h__") * math.sqrt(2 * math.pi))
    return near.groupBy("key__", "x").agg(F.sum(part).alias("density")).select(*[F.col("key__")[k].alias(k) for k in keys], "x", "density")


def box_plot(df: DataFrame, name: str, keys: list[str], reach: float = 1.5) -> DataFrame:
    """Quartiles, the whiskers' ends (the outermost values within reach times the quartiles' distance) and how many lie beyond."""
    x = quoted(name)
    q = quantiles(df, keys, x, [0.25, 0.5, 0.75]).select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    far = (F.col("q3") - F.col("q1")) * reach
    inside = (x >= F.col("q1") - far) & (x <= F.col("q3") + far)
    return df.join(q, keys).groupBy(*keys).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"), F.min(F.when(inside, x)).alias("low"), F.max(F.when(inside, x)).alias("high"), F.count_if(~inside).alias("outliers")
    )
