"""Queries of the tables around recordings: typed profiles, cards, cleaned columns, shared columns, what plots draw, and dispatched tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.operators import aggregates as A
from brindle.operators import stats
from brindle.plans.catalog import query
from brindle.session import table


@query("typed_profile", """
WITH n AS (SELECT o_totalprice AS v FROM orders),
t AS (SELECT 'o_orderstatus' AS variable, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM orders)
SELECT 'o_totalprice' AS variable, count(v)::BIGINT AS count, count(DISTINCT v)::BIGINT AS "unique", round_even(avg(v), 2) AS mean, round_even(stddev_samp(v), 2) AS std, round_even(median(v), 2) AS median, round_even(min(v), 2) AS min, round_even(max(v), 2) AS max,
  round_even(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 2) AS iqr FROM n
UNION ALL SELECT variable, count(v), count(DISTINCT v), NULL, NULL, NULL, NULL, NULL, NULL FROM t GROUP BY variable
""")
def typed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.typed_profile(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice"))


@query("summary_cards", """
SELECT p_brand, printf('N=%d mean=%.2e min=%.5e max=%.5e', count(v)::BIGINT, avg(v), min(v), max(v)) AS card
FROM (SELECT p_brand, least(greatest(p_retailprice, -1e20), 1e20) AS v FROM part) GROUP BY p_brand
""")
def summary_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N, mean and extremes as text. Spark formats exact halves away from zero, others to even, so the extremes show all their digits."""
    rows = table(spark, sf_dir, "part").select("p_brand", C.clipped(F.col("p_retailprice")).alias("v"))
    out = A.six_numbers(rows, "v", ["p_brand"])
    return out.select("p_brand", F.format_string("N=%d mean=%.2e min=%.5e max=%.5e", "n", "mean", "min", "max").alias("card"))


@query("coerced_dates", """
WITH raw AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'O' THEN o_custkey::VARCHAR || '.5' ELSE o_orderpriority END AS text FROM orders)
SELECT o_orderkey, try_cast(text AS TIMESTAMP) AS moment, CASE WHEN try_cast(text AS TIMESTAMP) IS NULL THEN try_cast(text AS DOUBLE) END AS number, CASE WHEN try_cast(text AS TIMESTAMP) IS NULL AND try_cast(text AS DOUBLE) IS NULL THEN text END AS rest FROM raw
""")
def coerced_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text column as dates, else numbers, else what it was."""
    text = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderstatus") == "O", F.concat(F.col("o_custkey").cast("string"), F.lit(".5"))).otherwise(F.col("o_orderpriority"))
    raw = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return raw.select("o_orderkey", *C.date_number_or_text(F.col("text")))


@query("dropped_columns", """
SELECT o_orderkey, o_custkey, o_totalprice, mark FROM (SELECT *, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE substr(o_orderpriority, 3) END AS mark FROM orders) WHERE mark IS NOT NULL
""")
def dropped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without the columns that speak of dates, status or priority; the priority's name stays, and rows without one go."""
    mark = F.when(~F.col("o_orderpriority").rlike("^1"), C.stripped(F.col("o_orderpriority"), "[0-9]-", ""))
    return C.without_columns(table(spark, sf_dir, "orders").withColumn("mark", mark), ["date", "status", "priority"]).dropna(subset=["mark"])


@query("threshold_ids", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000")
def threshold_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 250000).select("o_orderkey")


@query("shared_names", """
SELECT 'both' AS side, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'customers', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'suppliers', k FROM (SELECT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal < 0)
""")
def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers in debt and of suppliers: in both and in one only."""
    a = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    sided = lambda df, side: df.select(F.lit(side).alias("side"), "k")
    return sided(a.intersect(b), "both").unionByName(sided(a.subtract(b), "customers")).unionByName(sided(b.subtract(a), "suppliers"))


@query("case_control_matrix", """
SELECT 1 AS is_case, c_acctbal AS acctbal, c_nationkey::DOUBLE AS nationkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 0, s_acctbal, s_nationkey::DOUBLE FROM supplier WHERE s_acctbal > 0
""")
def case_control_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against suppliers on the numeric columns that both have, but for their keys; a balance of nothing or less is a gap."""
    bare = lambda name, prefix, key: table(spark, sf_dir, name).drop(key).toDF(*[c.removeprefix(prefix) for c in table(spark, sf_dir, name).columns if c != key])
    gapped = lambda df: df.withColumn("acctbal", F.when(F.col("acctbal") > 0, F.col("acctbal")))
    return A.case_control_matrix(gapped(bare("customer", "c_", "c_custkey")), gapped(bare("supplier", "s_", "s_suppkey")))


@query("pair_correlations", """
WITH c AS (SELECT l_returnflag, l_quantity AS q, l_extendedprice AS p, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS d FROM lineitem), f AS (SELECT * FROM c WHERE q IS NOT NULL AND p IS NOT NULL AND d IS NOT NULL)
SELECT l_returnflag, 'q' AS a, 'p' AS b, round(corr(q, p), 6) AS r, count(*)::BIGINT AS n FROM f GROUP BY 1 UNION ALL SELECT l_returnflag, 'q', 'd', round(corr(q, d), 6), count(*) FROM f GROUP BY 1 UNION ALL SELECT l_returnflag, 'p', 'd', round(corr(p, d), 6), count(*) FROM f GROUP BY 1
""")
def pair_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of three columns by return flag, over rows that lack none of them."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("d"))
    return A.pair_correlations(rows, ["q", "p", "d"], ["l_returnflag"]).withColumn("r", F.round("r", 6))


@query("histogram_table", """
WITH b AS (SELECT c_mktsegment, c_acctbal AS v, (SELECT min(c_acctbal) FROM customer) AS lo, (SELECT max(c_acctbal) FROM customer) AS hi FROM customer)
SELECT c_mktsegment, least(floor((v - lo) / (hi - lo) * 20), 19)::BIGINT AS bin, count(*)::BIGINT AS n FROM b WHERE v IS NOT NULL GROUP BY ALL
""")
def histogram_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(table(spark, sf_dir, "customer"), "c_acctbal", 20, ["c_mktsegment"])


@query("box_plot_table", """
WITH q AS (SELECT c_mktsegment AS g, quantile_cont(c_acctbal, 0.25) AS q1, median(c_acctbal) AS q2, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1)
SELECT g AS c_mktsegment, round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3,
  min(c_acctbal) FILTER (c_acctbal >= q1 - 0.5 * (q3 - q1)) AS low, max(c_acctbal) FILTER (c_acctbal <= q3 + 0.5 * (q3 - q1)) AS high, count(*) FILTER (c_acctbal < q1 - 0.5 * (q3 - q1) OR c_acctbal > q3 + 0.5 * (q3 - q1))::BIGINT AS outliers
FROM q JOIN customer ON c_mktsegment = g GROUP BY g
""")
def box_plot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.box_plot(table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"], reach=0.5)
    return out.select("c_mktsegment", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "low", "high", "outliers")


@query("dispatched_regressions", """
SELECT 'balance' AS column_name, count(*)::BIGINT AS n, round(regr_slope(y, c_acctbal), 6) AS slope, round(regr_r2(y, c_acctbal), 6) AS r2 FROM (SELECT c_acctbal, avg(o_totalprice) AS y FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal)
""")
def dispatched_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the numeric columns of the dispatch give: slopes of a customer's mean order on them."""
    out = stats.dispatched(_clinical(spark, sf_dir), ["positive", "level (0-2)", "balance"], "y")["regressions"]
    return out.select("column_name", "n", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"))


_DISPATCH_SQL = """
WITH w AS (SELECT (c_acctbal > 0)::INT AS positive, c_nationkey % 3 AS level, avg(o_totalprice) AS y FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal, c_nationkey),
long AS (SELECT 'positive' AS variable, positive::DOUBLE AS grp, y FROM w UNION ALL SELECT 'level (0-2)', level::DOUBLE, y FROM w),
g AS (SELECT variable, grp, count(*)::DOUBLE AS n, avg(y) AS m, var_samp(y) AS v FROM long GROUP BY ALL)
SELECT a.variable, a.grp AS group1, b.grp AS group2, round((b.m - a.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS cohen_d FROM g a JOIN g b ON a.variable = b.variable AND a.grp < b.grp
"""


@query("dispatched_comparisons", _DISPATCH_SQL)
def dispatched_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the binary and ordinal columns of the dispatch give: every pair of their values, compared on a customer's mean order."""
    out = stats.dispatched(_clinical(spark, sf_dir), ["positive", "level (0-2)", "balance"], "y")["comparisons"]
    return out.select("variable", "group1", "group2", F.round("cohen_d", 6).alias("cohen_d"))


def _clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("y"))
    wide = table(spark, sf_dir, "customer").join(y, "c_custkey")
    return wide.select((F.col("c_acctbal") > 0).cast("double").alias("positive"), (F.col("c_nationkey") % 3).cast("double").alias("level (0-2)"), F.col("c_acctbal").alias("balance"), "y")


@query("tidied_columns", """
SELECT c_custkey, trim('  ' || c_name || ' ') AS c_name, c_mktsegment, c_acctbal, 'figures/' || c_mktsegment || '/' || c_nationkey || '.png' AS path FROM customer WHERE c_mktsegment <> 'MACHINERY'
UNION ALL SELECT c_custkey, c_name, c_mktsegment, c_acctbal, NULL FROM customer WHERE c_mktsegment = 'MACHINERY'
""")
def tidied_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with padded names and a name twice: the first of each name, trimmed, those of the columns before the balance that speak of keys, names or segments, the balance, and a path from a template."""
    raw = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"), "c_nationkey", "c_mktsegment", F.lit("again").alias("c_name"), "c_acctbal")
    tidy = C.trimmed(C.first_of_each_name(raw))
    before, after = C.split_at(tidy, "acctbal")
    segment = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))
    path = C.templated("figures/{segment}/{nation}.png", segment=segment, nation=F.col("c_nationkey"))
    return tidy.select(*C.columns_like(tidy.select(*before), "custkey", "name", "segment"), *after, path.alias("path"))


@query("scatter_with_fit", """
WITH r AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1)
SELECT l_returnflag, l_quantity, l_extendedprice, round(b + a * l_quantity, 3) AS fit, round(l_extendedprice - b - a * l_quantity, 3) AS residual FROM lineitem JOIN r USING (l_returnflag) WHERE l_linenumber <> 3
""")
def scatter_with_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices over quantities with the line of their return flag; lines of number 3 lack a quantity."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice")
    return stats.fitted_points(rows, ["l_returnflag"], "l_extendedprice", "l_quantity").withColumns({c: F.round(c, 3) for c in ("fit", "residual")})


@query("density_table", """
WITH e AS (SELECT min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer), g AS (SELECT k, low + (high - low) * k / 31.0::DOUBLE AS x FROM e, generate_series(0, 31) AS t(k)),
w AS (SELECT c_mktsegment, count(*) AS n, stddev_samp(c_acctbal) * pow(count(*), -0.2) AS h FROM customer GROUP BY 1)
SELECT c_mktsegment, round(x, 4) AS x, round(sum(exp(0 - ((x - c_acctbal) / h)^2 / 2)) / any_value(n * h * sqrt(2 * pi())), 9) AS density FROM customer JOIN w USING (c_mktsegment), g GROUP BY c_mktsegment, x
""")
def density_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.density(table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"], 32).select("c_mktsegment", F.round("x", 4).alias("x"), F.round("density", 9).alias("density"))


@query("prefixed_sheets", """
SELECT s_suppkey AS id, n_name AS nation_n_name, r_name AS "region_r.name", CASE WHEN s_acctbal > 0 THEN s_name END AS s_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def prefixed_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the sheets of their nation and region, whose columns bear the sheet's name; one name has a dot."""
    rows = table(spark, sf_dir, "supplier").select(F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("s_name"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    nation = C.prefixed(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name", F.col("n_regionkey").alias("region")), "nation_", "nation")
    region = C.prefixed(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("nation_region"), F.col("r_name").alias("r.name")), "region_", "nation_region")
    joined = rows.join(nation, "nation", "left").join(region, "nation_region", "left").drop("nation", "nation_region")
    return C.to_front(joined.select("s_name", "nation_n_name", C.quoted("region_r.name"), "id"), "id")
