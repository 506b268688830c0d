"""Queries of group comparisons, corrections and regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.operators import aggregates as A
from brindle.operators import stats
from brindle.plans.catalog import query
from brindle.session import table

_LONG_SQL = """WITH long AS (SELECT variable, value, l_linestatus AS side, l_returnflag AS flag FROM (
  SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_linestatus, l_returnflag FROM lineitem)
  UNPIVOT (value FOR variable IN (quantity, price, discount, tax)))"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("side"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")
    )
    return A.unpivoted(rows, ["side", "flag"], ["quantity", "price", "discount", "tax"])


_K2_SQL = """, m AS (SELECT variable, count(value)::DOUBLE AS n, avg(value) AS mu FROM long GROUP BY variable),
c AS (SELECT l.variable, any_value(n) AS n, avg((value - mu)^2) AS m2, avg((value - mu)^3) AS m3, avg((value - mu)^4) AS m4 FROM long l JOIN m USING (variable) GROUP BY l.variable),
g AS (SELECT variable, n, m3 / m2^1.5 AS g1, m4 / m2^2 - 3 AS g2, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sk FROM c),
h AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6 + 8 / sk * (2 / sk + sqrt(1 + 4 / (sk * sk))) AS a, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y FROM g),
z AS (SELECT variable, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(sqrt(w2))) AS z1, (1 - 2 / a) / (1 + (g2 + 6 / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) * sqrt(2 / (a - 4))) AS part, a FROM h),
k AS (SELECT variable, z1 * z1 + ((1 - 2 / (9 * a) - sign(part) * abs(part)^(1 / 3.0::DOUBLE)) / sqrt(2 / (9 * a)))^2 AS k2 FROM z)"""


@query("normality_k2", _LONG_SQL + _K2_SQL + " SELECT variable, round(k2, 3) AS k2, round(exp(-k2 / 2), 6) AS p_value FROM k")
def normality_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _long(spark, sf_dir).groupBy("variable").agg(stats.normality_k2(F.col("value")).alias("k2"))
    return k.select("variable", F.round("k2", 3).alias("k2"), F.round(stats.chi2_2_tail(F.col("k2")), 6).alias("p_value"))


_MWU_SQL = """, kept AS (SELECT {keys}, value, count(*) FILTER (side = '{first}') AS one, count(*) AS tie FROM long WHERE side IN ('{first}', '{second}') GROUP BY ALL),
ranked AS (SELECT *, sum(tie) OVER (PARTITION BY {keys} ORDER BY value) - (tie - 1) / 2 AS rank FROM kept),
s AS (SELECT {keys}, sum(one)::DOUBLE AS n1, sum(tie)::DOUBLE AS n, sum(rank * one)::DOUBLE AS r1, sum(tie::DOUBLE^3 - tie)::DOUBLE AS ties FROM ranked GROUP BY ALL),
u AS (SELECT *, n - n1 AS n2, r1 - n1 * (n1 + 1) / 2 AS u FROM s)
SELECT {keys}, n1::BIGINT AS n1, n2::BIGINT AS n2, round(u, 1) AS u, round(greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z FROM u"""


@query("mann_whitney_u", _LONG_SQL + _MWU_SQL.format(keys="variable", first="F", second="O"))
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.mann_whitney(_long(spark, sf_dir), ["variable"], "side", "value", "F", "O")
    return out.select("variable", "n1", "n2", F.round("u", 1).alias("u"), F.round("z", 6).alias("z"))


@query("per_channel_tests", "WITH long AS (SELECT event_type, value, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM events)" + _MWU_SQL.format(keys="event_type", first="a", second="b"))
def per_channel_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "value", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("side"))
    out = stats.mann_whitney(rows, ["event_type"], "side", "value", "a", "b")
    return out.select("event_type", "n1", "n2", F.round("u", 1).alias("u"), F.round("z", 6).alias("z"))


_SIMPSON = "list_sum(list_transform(range(2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f})) * {top} / 6000"
_NORMAL = "1 - 2 / sqrt(2 * pi()) * " + _SIMPSON.format(f="exp(0 - (z * i / 2000)^2 / 2)", top="z")
_STUDENT = "1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * " + _SIMPSON.format(f="(1 + (t * i / 2000)^2 / df)^(-(df + 1) / 2)", top="abs(t)")


@query("per_channel_p_values", "WITH long AS (SELECT event_type, value, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM events)" + _MWU_SQL.format(keys="event_type", first="a", second="b").replace("\nSELECT event_type", ",\nr AS (SELECT event_type") + f"""),
p AS (SELECT *, {_NORMAL} AS p_value FROM r), o AS (SELECT *, row_number() OVER (ORDER BY p_value, event_type) AS j, count(*) OVER () AS tests FROM p), a AS (SELECT *, least(min(p_value * tests / j) OVER (ORDER BY j DESC), 1) AS adj FROM o)
SELECT event_type, n1, n2, u, z, round(p_value, 5) AS p_value, round(adj, 5) AS adj_p_value, adj < 0.05 AS significant, CASE WHEN adj < 0.001 THEN '***' WHEN adj < 0.01 THEN '**' WHEN adj < 0.05 THEN '*' ELSE 'ns' END AS stars FROM a""")
def per_channel_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U tests per channel with corrected p-values and marks; SQL integrates the normal density."""
    rows = table(spark, sf_dir, "events").select("event_type", "value", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("side"))
    tested = stats.mann_whitney(rows, ["event_type"], "side", "value", "a", "b").withColumn("p_value", stats.normal_two_sided(F.col("z")))
    r = lambda c, n: F.round(c, n).alias(c)
    marked = stats.adjusted(tested, "p_value", [], ["event_type"]).withColumn("stars", C.stars(F.col("adj_p_value")))
    return marked.select("event_type", "n1", "n2", r("u", 1), r("z", 6), r("p_value", 5), r("adj_p_value", 5), "significant", "stars")


@query("t_test_cohen_d", _LONG_SQL + """, s AS (SELECT variable, count(*) FILTER (side = 'F')::DOUBLE AS n1, count(*) FILTER (side = 'O')::DOUBLE AS n2, avg(value) FILTER (side = 'F') AS m1, avg(value) FILTER (side = 'O') AS m2,
  var_samp(value) FILTER (side = 'F') AS v1, var_samp(value) FILTER (side = 'O') AS v2 FROM long GROUP BY variable),
p AS (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sd FROM s)
SELECT variable, round((m1 - m2) / (sd * sqrt(1 / n1 + 1 / n2)), 6) AS t, (n1 + n2 - 2)::BIGINT AS df, round((m2 - m1) / sd, 6) AS cohen_d FROM p""")
def t_test_cohen_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.t_and_cohen(_long(spark, sf_dir), ["variable"], "side", "value", "F", "O")
    return out.select("variable", F.round("t", 6).alias("t"), "df", F.round("cohen_d", 6).alias("cohen_d"))


@query("t_test_p_values", _LONG_SQL + f""", g AS (SELECT variable, flag, count(*)::DOUBLE AS n, avg(value) AS m, var_samp(value) AS v FROM long GROUP BY ALL),
s AS (SELECT a.variable, a.flag AS group1, b.flag AS group2, a.m - b.m AS diff, a.n + b.n - 2 AS df, 1 / a.n + 1 / b.n AS w, sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS sd FROM g a JOIN g b ON a.variable = b.variable AND a.flag < b.flag),
y AS (SELECT *, diff / (sd * sqrt(w)) AS t FROM s), p AS (SELECT *, {_STUDENT} AS p_value FROM y),
o AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY p_value, group1, group2) AS j, count(*) OVER (PARTITION BY variable) AS tests FROM p), a AS (SELECT *, least(min(p_value * tests / j) OVER (PARTITION BY variable ORDER BY j DESC), 1) AS adj FROM o)
SELECT variable, group1, group2, round(t, 6) AS t, df::BIGINT AS df, round(-diff / sd, 6) AS cohen_d, round(p_value, 5) AS p_value, round(adj, 5) AS adj_p_value, adj < 0.05 AS significant FROM a""")
def t_test_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of return flags on every variable from one aggregate, with p-values by the incomplete beta function; SQL integrates Student's density."""
    tested = stats.t_of_pairs(_long(spark, sf_dir), ["variable"], "flag", "value")
    tested = tested.withColumn("p_value", stats.student_two_sided(F.col("t"), F.col("df").cast("double")))
    r = lambda c, n: F.round(c, n).alias(c)
    return stats.adjusted(tested, "p_value", ["variable"], ["group1", "group2"]).select("variable", "group1", "group2", r("t", 6), "df", r("cohen_d", 6), r("p_value", 5), r("adj_p_value", 5), "significant")


_COMPARE_SQL = """
WITH long AS (SELECT 'balance' AS variable, c_mktsegment AS grp, c_acctbal AS value FROM customer
  UNION ALL SELECT 'mean order', c_mktsegment, avg(o_totalprice) FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment)""" + _K2_SQL + """,
own AS (SELECT variable, grp, count(*)::DOUBLE AS n, avg(value) AS m, var_samp(value) AS v FROM long GROUP BY ALL),
pairs AS (SELECT a.variable, a.grp AS group1, b.grp AS group2, a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v AS v1, b.v AS v2 FROM own a JOIN own b ON a.variable = b.variable AND a.grp < b.grp),
tied AS (SELECT p.variable, group1, group2, value, count(*) FILTER (grp = group1) AS one, count(*) AS tie FROM pairs p JOIN long l ON l.variable = p.variable AND grp IN (group1, group2) GROUP BY ALL),
ranked AS (SELECT *, sum(tie) OVER (PARTITION BY variable, group1, group2 ORDER BY value) - (tie - 1) / 2 AS rank FROM tied),
r AS (SELECT variable, group1, group2, sum(rank * one)::DOUBLE AS r1, sum(tie::DOUBLE^3 - tie)::DOUBLE AS ties FROM ranked GROUP BY ALL),
x AS (SELECT variable, group1, group2, exp(-k2 / 2) < 0.05 AS by_rank, n1 + n2 - 2 AS df, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sd, m1 - m2 AS diff,
  n1, n2, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS su FROM pairs JOIN r USING (variable, group1, group2) JOIN k USING (variable)),
y AS (SELECT *, diff / (sd * sqrt(1 / n1 + 1 / n2)) AS t, greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / su AS z FROM x),
p AS (SELECT *, CASE WHEN by_rank THEN """ + _NORMAL + " ELSE " + _STUDENT + """ END AS p_value FROM y),
b AS (SELECT *, row_number() OVER (ORDER BY p_value, variable, group1, group2) AS j, count(*) OVER () AS tests FROM p),
a AS (SELECT *, least(min(p_value * tests / j) OVER (ORDER BY j DESC), 1) AS adj FROM b)
SELECT variable, group1, group2, CASE WHEN by_rank THEN 'Mann-Whitney U' ELSE 'T-test' END AS test, round(CASE WHEN by_rank THEN u ELSE t END, 4) AS statistic, round(p_value, 5) AS p_value,
  round(-diff / sd, 6) AS cohen_d, round(adj, 5) AS adj_p_value, adj < 0.05 AS significant FROM a
"""


@query("group_comparison", _COMPARE_SQL)
def group_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of market segments on two variables: the test that normality allows, its p, effect size and correction over the whole table."""
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("value"))
    ordered = customer.join(orders, "c_custkey").select(F.lit("mean order").alias("variable"), "c_mktsegment", "value")
    rows = customer.select(F.lit("balance").alias("variable"), "c_mktsegment", F.col("c_acctbal").alias("value")).unionByName(ordered)
    out = stats.compare_groups(rows, "variable", "c_mktsegment", "value")
    r = lambda c, n: F.round(c, n).alias(c)
    return out.select("variable", "group1", "group2", "test", r("statistic", 4), r("p_value", 5), r("cohen_d", 6), r("adj_p_value", 5), "significant")


@query("bh_fdr", """
WITH p AS (SELECT event_type, user_id % 7 AS bin, exp(-avg(value) / 20) AS p_value FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p_value, bin) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM p)
SELECT event_type, bin, round(least(min(p_value * n / k) OVER (PARTITION BY event_type ORDER BY k DESC), 1.0::DOUBLE), 6) AS adj_p_value FROM r
""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 7).alias("bin")).agg(F.exp(-F.avg("value") / 20).alias("p_value"))
    return stats.adjusted(p, "p_value", ["event_type"], ["bin"]).select("event_type", "bin", F.round("adj_p_value", 6).alias("adj_p_value"))


@query("outlier_trim", "SELECT event_id FROM events QUALIFY abs(value - avg(value) OVER (PARTITION BY event_type)) <= 1.5 * stddev_samp(value) OVER (PARTITION BY event_type)")
def outlier_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.trimmed_outliers(table(spark, sf_dir, "events"), "event_type", "value", 1.5).select("event_id")


@query("ols_slope_r2", """
SELECT l_returnflag, count(*)::BIGINT AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
  round(corr(l_extendedprice, l_quantity) * sqrt((count(*) - 2) / (1 - corr(l_extendedprice, l_quantity)^2)), 3) AS t FROM lineitem GROUP BY 1
""")
def ols_slope_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.simple_regression(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return out.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"), F.round("t", 3).alias("t"))


@query("significance_stars", "SELECT c_custkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM (SELECT c_custkey, exp(-abs(c_acctbal) / 500) AS p FROM customer)")
def significance_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", C.stars(F.exp(-F.abs("c_acctbal") / 500)).alias("stars"))


@query("clinical_dispatch", """
WITH w AS (SELECT (c_acctbal > 0)::INT::DOUBLE AS positive, (c_nationkey % 3)::DOUBLE AS "level (0-2)", c_acctbal AS balance, 1.0::DOUBLE AS constant, (c_nationkey % 2 + 1)::DOUBLE AS one_two,
  CASE WHEN c_mktsegment <> 'MACHINERY' THEN (c_acctbal > 5000)::INT::DOUBLE END AS gaps FROM customer),
long AS (UNPIVOT w ON COLUMNS(*) INTO NAME variable VALUE value),
s AS (SELECT variable, count(*) AS n, count(DISTINCT value) AS u, count(*) FILTER (value = 1) AS ones, count(*) FILTER (value = 0) AS zeros FROM long GROUP BY variable)
SELECT variable, CASE WHEN u = 2 THEN 'binary' WHEN variable LIKE '%(%)%' THEN 'ordinal' ELSE 'numeric' END AS kind FROM s WHERE n >= 3 AND u >= 2 AND (u <> 2 OR (ones >= 3 AND zeros >= 3))
""")
def clinical_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "customer").select(
        (F.col("c_acctbal") > 0).cast("double").alias("positive"), (F.col("c_nationkey") % 3).cast("double").alias("level (0-2)"), F.col("c_acctbal").alias("balance"), F.lit(1.0).alias("constant"), (F.col("c_nationkey") % 2 + 1).cast("double").alias("one_two"),
        F.when(F.col("c_mktsegment") != "MACHINERY", (F.col("c_acctbal") > 5000).cast("double")).alias("gaps"),
    )
    return spark.createDataFrame(list(stats.classified_columns(wide, wide.columns).items()), "variable string, kind string")
