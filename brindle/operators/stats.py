"""Tests of two groups, corrections, regressions; every variable in one grouped plan over the long form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.operators.prefix import running_totals


def normality_k2(x: Column) -> Column:
    """D'Agostino and Pearson's K-squared statistic; null under eight values or without spread."""
    n = F.count(x).cast("double")
    g1, g2 = F.skewness(x), F.kurtosis(x)
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(F.sqrt(w2)))
    mean = -6 / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    skew = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / skew * (2 / skew + F.sqrt(1 + 4 / (skew * skew)))
    part = (1 - 2 / a) / (1 + (g2 - mean) / F.sqrt(var) * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(part) * F.pow(F.abs(part), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    return F.when((n >= 8) & (F.stddev_pop(x) > 0), z1 * z1 + z2 * z2)


def chi2_2_tail(k2: Column) -> Column:
    """Upper tail of a chi-squared value with two degrees of freedom."""
    return F.exp(-k2 / 2)


def average_ranks(counts: DataFrame, keys: list[str], value: str, tie: str = "tie") -> DataFrame:
    """counts (one line for each distinct value of a key, with how many rows share it) with the average rank of the value.

    Rows are counted before, so ties, however many, cost one line; the lines are summed up over ranges, so no task sees a key whole.
    """
    return running_totals(counts, keys, F.col(value), rank=tie).withColumn("rank", F.col("rank") - (F.col(tie) - 1) / 2)


def mann_whitney(df: DataFrame, keys: list[str], group: str, value: str, first: object, second: object) -> DataFrame:
    """U of the first group, and z with tie and continuity correction. One line of counts for each distinct value is ranked, not the rows."""
    kept = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull())
    counts = kept.groupBy(*keys, value).agg(F.count_if(F.col(group) == F.lit(first)).alias("one"), F.count(F.lit(1)).alias("tie"))
    ranked = average_ranks(counts, keys, value)
    t = F.col("tie").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum("one").alias("n1"), F.sum("tie").alias("n"), F.sum(F.col("rank") * F.col("one")).alias("r1"), F.sum(t * t * t - t).alias("ties"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / F.nullif(sd, F.lit(0.0))
    return sums.filter((F.col("n1") >= 2) & (F.col("n") - F.col("n1") >= 2)).select(*keys, F.col("n1"), (F.col("n") - F.col("n1")).alias("n2"), u.alias("u"), z.alias("z"))


def normal_two_sided(z: Column) -> Column:
    """Two-sided tail of the normal distribution; for few rows, as a pandas function."""
    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return pd.Series([math.erfc(abs(v) / math.sqrt(2)) if v == v else None for v in values], dtype="float64")

    return tail(z)


def student_two_sided(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's distribution, by the continued fraction of the incomplete beta function; for few rows."""
    @F.pandas_udf("double")
    def tail(values: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series([beta_tail(v, d) for v, d in zip(values, freedom, strict=True)], dtype="float64")

    return tail(t, df)


def beta_tail(t: float, df: float) -> float | None:
    if t != t or df != df or df <= 0:
        return None
    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 400):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + step * d or tiny)
                c = 1 + step / c or tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def exact_mann_whitney(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of U without ties. The ways to get each U are the coefficients of the Gaussian binomial, up to u only.

    Takes memory of 16 bytes for every value under u, which is n1 * n2 / 2 at most.
    """
    few, many = sorted((n1, n2))
    low = int(min(u, n1 * n2 - u))
    ways = np.zeros(low + 1)
    ways[0] = 1.0
    for k in range(1, few + 1):
        if many + k <= low:
            ways[many + k :] -= ways[: low + 1 - many - k].copy()  # times 1 - q^(many + k)
        for first in range(k):  # by 1 - q^k
            ways[first::k] = np.cumsum(ways[first::k])
    return min(1.0, 2 * float(ways.sum() / math.comb(n1 + n2, few)))


def t_and_cohen(df: DataFrame, keys: list[str], group: str, value: str, first: object, second: object) -> DataFrame:
    """Pooled t (first less second), its degrees of freedom, and Cohen's d (second less first)."""
    x = F.col(value)
    one, two = F.col(group) == F.lit(first), F.col(group) == F.lit(second)
    part = lambda f, c: f(F.when(c, x))
    s = df.groupBy(*keys).agg(
        part(F.count, one).cast("double").alias("n1"), part(F.count, two).cast("double").alias("n2"), part(F.avg, one).alias("m1"), part(F.avg, two).alias("m2"),
        part(F.var_samp, one).alias("v1"), part(F.var_samp, two).alias("v2"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = F.sqrt(((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2))
    return s.filter((n1 >= 2) & (n2 >= 2)).select(
        *keys, ((F.col("m1") - F.col("m2")) / F.nullif(pooled * F.sqrt(1 / n1 + 1 / n2), F.lit(0.0))).alias("t"), (n1 + n2 - 2).cast("long").alias("df"),
        ((F.col("m2") - F.col("m1")) / F.nullif(pooled, F.lit(0.0))).alias("cohen_d"),
    )


def t_of_pairs(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """keys, group1, group2, t, df and cohen_d for every pair of groups in name order; one aggregate, whose few rows are paired."""
    own = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*keys, group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).filter("n >= 2")
    side = lambda k: own.select(*keys, F.col(group).alias(f"group{k}"), *[F.col(c).alias(f"{c}{k}") for c in "nmv"])
    n1, n2, diff = F.col("n1"), F.col("n2"), F.col("m1") - F.col("m2")
    pooled = F.sqrt(((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2))
    t = diff / F.nullif(pooled * F.sqrt(1 / n1 + 1 / n2), F.lit(0.0))
    pairs = side(1).join(side(2), keys).filter("group1 < group2")
    return pairs.select(*keys, "group1", "group2", t.alias("t"), (n1 + n2 - 2).cast("long").alias("df"), (-diff / F.nullif(pooled, F.lit(0.0))).alias("cohen_d"))


def fitted_points(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """df's complete pairs with fit and residual by the regression of their group: what a scatter plot with its line draws. Null keys go."""
    lines = simple_regression(df, keys, y, x).select(*keys, "slope", "intercept")
    fit = F.col("intercept") + F.col("slope") * F.col(x)
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).join(lines, keys)
    return points.withColumn("fit", fit).withColumn("residual", F.col(y) - fit).drop("slope", "intercept")


def adjusted(df: DataFrame, p: str, scope: list[str], tiebreak: list[str]) -> DataFrame:
    """Benjamini-Hochberg p-values within each scope (one correction call), and whether they are under 0.05.

    A null p stays null, is not counted among the tests, and is not significant.
    """
    part = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(1))
    rank = F.row_number().over(part.orderBy(F.asc_nulls_last(p), *tiebreak))
    raw = df.withColumn("rank__", rank).withColumn("raw__", F.col(p) * F.count(p).over(part) / F.col("rank__"))
    down = part.orderBy(F.col("rank__").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = raw.withColumn("adj_p_value", F.when(F.col(p).isNotNull(), F.least(F.min("raw__").over(down), F.lit(1.0)))).drop("rank__", "raw__")
    return out.withColumn("significant", F.coalesce(F.col("adj_p_value") < 0.05, F.lit(False)))


#: Exact p-values of U are taken without ties if the smaller group has so many rows at most.
EXACT_SMALL = 8


def exact_two_sided(u: Column, n1: Column, n2: Column) -> Column:
    """Exact p of U in small groups, null elsewhere; for few rows."""
    @F.pandas_udf("double")
    def exact(us: pd.Series, ones: pd.Series, twos: pd.Series) -> pd.Series:
        return pd.Series([exact_mann_whitney(x, int(a), int(b)) if min(a, b) <= EXACT_SMALL else None for x, a, b in zip(us, ones, twos, strict=True)], dtype="float64")

    return exact(u, n1.cast("double"), n2.cast("double"))


def compare_groups(df: DataFrame, variable: str, group: str, value: str, tests_scope: list[str] | None = None) -> DataFrame:
    """Every pair of groups (in name order) on every variable: test, statistic, p, Cohen's d, corrected p and significance.

    The K-squared test over all rows of a variable chooses Mann-Whitney's U (normality rejected at 0.05) or the pooled t. Groups
    of fewer than two values are left out; a variable without spread has a null p. Rows are counted by distinct value before
    pairs are formed, so that a value is copied once for each other group, however many rows have it.
    """
    kept = df.select(F.col(variable).alias("variable"), F.col(group).alias("group"), F.col(value).cast("double").alias("value")).dropna()
    gate = kept.groupBy("variable").agg(chi2_2_tail(normality_k2(F.col("value"))).alias("normal_p"))
    own = kept.groupBy("variable", "group").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")).filter("n >= 2")
    side = lambda k: own.select("variable", *[F.col(c).alias(f"{c}{k}") for c in ("group", "n", "m", "v")])
    pairs = side(1).join(side(2), "variable").filter("group1 < group2")
    counts = kept.groupBy("variable", "group", "value").agg(F.count(F.lit(1)).alias("c"))
    names = pairs.select("variable", "group1", "group2")
    sided = lambda k, one: counts.withColumnRenamed("group", f"group{k}").join(names, ["variable", f"group{k}"]).select("variable", "group1", "group2", "value", one.alias("one"), "c")
    both = sided(1, F.col("c")).unionByName(sided(2, F.lit(0).cast("long")))
    keys = ["variable", "group1", "group2"]
    tied = both.groupBy(*keys, "value").agg(F.sum("one").alias("one"), F.sum("c").alias("tie"))
    ranked = average_ranks(tied, keys, "value")
    t = F.col("tie").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("one")).alias("r1"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    pooled = F.sqrt(((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n - 2))
    rows = pairs.join(sums, keys).join(gate, "variable").withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    rows = rows.withColumn("z", F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0)) / F.nullif(F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))), F.lit(0.0)))
    rows = rows.withColumn("t", (F.col("m1") - F.col("m2")) / F.nullif(pooled * F.sqrt(1 / n1 + 1 / n2), F.lit(0.0)))
    rows = rows.withColumn("cohen_d", (F.col("m2") - F.col("m1")) / F.nullif(pooled, F.lit(0.0))).withColumn("by_rank", F.coalesce(F.col("normal_p") < 0.05, F.lit(False)))
    exact = F.when(F.col("ties") == 0, exact_two_sided(F.col("u"), n1, n2))
    p = F.when(F.col("by_rank"), F.coalesce(exact, normal_two_sided(F.col("z")))).otherwise(student_two_sided(F.col("t"), n - 2))
    tested = rows.select(
        *keys, F.when(F.col("by_rank"), "Mann-Whitney U").otherwise("T-test").alias("test"), F.when(F.col("by_rank"), F.col("u")).otherwise(F.col("t")).alias("statistic"),
        p.alias("p_value"), "cohen_d",
    )
    return adjusted(tested, "p_value", tests_scope or [], keys)


def trimmed_outliers(df: DataFrame, group: str, value: str, deviations: float = 5) -> DataFrame:
    """Rows within so many sample deviations of their group's mean; a group of one row goes. Group sums are joined back, so hot groups split."""
    own = df.groupBy(group).agg(F.avg(value).alias("mean__"), F.stddev_samp(value).alias("sd__"))
    return df.join(own, group).filter(F.abs(F.col(value) - F.col("mean__")) <= deviations * F.col("sd__")).drop("mean__", "sd__")


def simple_regression(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Slope, intercept, R-squared, t of the slope, its degrees of freedom and two-sided p, over complete pairs."""
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    s = df.filter(pair).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.corr(y, x).alias("r"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    return s.withColumn("t", F.when(F.col("n") > 2, t)).withColumn("df", F.col("n") - 2).drop("r").withColumn("p_value", student_two_sided(F.col("t"), F.col("df").cast("double")))


def classified_columns(df: DataFrame, names: list[str]) -> dict[str, str]:
    """binary (two values, 0 and 1 three times each at least), ordinal (brackets in the name) or numeric. One pass.

    Columns of fewer than three values or two different ones are skipped, and so are those of two values that are not 0 and 1.
    """
    from brindle.functions.columns import quoted

    stats = [F.struct(F.count(quoted(c)).alias("n"), F.count_distinct(quoted(c)).alias("u"), F.count_if(quoted(c) == 1).alias("ones"), F.count_if(quoted(c) == 0).alias("zeros")) for c in names]
    out = {}
    for c, s in zip(names, df.agg(*stats).first(), strict=True) if names else []:
        if s["n"] < 3 or s["u"] < 2:
            continue
        if s["u"] == 2:
            if s["ones"] >= 3 and s["zeros"] >= 3:
                out[c] = "binary"
        else:
            out[c] = "ordinal" if "(" in c and ")" in c else "numeric"
    return out


def dispatched(df: DataFrame, names: list[str], y: str) -> dict[str, DataFrame | None]:
    """Each column of names against y, by its class: comparisons of every pair of values of binary and ordinal columns, and regressions of y on numeric ones; None where no column is of these classes."""
    from brindle.functions.columns import quoted

    kinds = classified_columns(df, names)
    long = lambda chosen, value: df.select(quoted(y).cast("double").alias("y__"), *[quoted(c).cast("double").alias(c) for c in chosen]).unpivot(["y__"], chosen, "column_name", value)
    split = [c for c in names if kinds.get(c) in ("binary", "ordinal")]
    numeric = [c for c in names if kinds.get(c) == "numeric"]
    return {
        "comparisons": compare_groups(long(split, "group__"), "column_name", "group__", "y__", ["variable"]) if split else None,
        "regressions": simple_regression(long(numeric, "x__"), ["column_name"], "y__", "x__") if numeric else None,
    }
