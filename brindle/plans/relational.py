"""Queries of projections, joins, aggregates and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.operators import aggregates as A
from brindle.operators import cohort, windows
from brindle.plans.catalog import query
from brindle.session import table
from brindle.streaming.ingest import unprocessed



@query("inventory_filter_sort", r"""
SELECT page_id, length(html)::BIGINT AS size, regexp_extract(url, 'https?://([^/]+)/', 1) AS host,
       NULLIF(regexp_extract(url, '/(\d+)', 1), '') AS number
FROM pages WHERE length(html) > 1000 AND url LIKE 'http%'
QUALIFY row_number() OVER (PARTITION BY regexp_extract(url, 'https?://([^/]+)/', 1), NULLIF(regexp_extract(url, '/(\d+)', 1), '') ORDER BY page_id) = 1
""")
def inventory_filter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("size"), "url")
    kept = pages.filter((F.col("size") > 1000) & F.col("url").startswith("http"))
    named = kept.select("page_id", "size", F.regexp_extract("url", r"https?://([^/]+)/", 1).alias("host"), F.nullif(F.regexp_extract("url", r"/(\d+)", 1), F.lit("")).alias("number"))
    return A.first_per_key(named, ["host", "number"], F.col("page_id")).orderBy("page_id")


@query("union_by_name_missing", """
SELECT 'customer' AS origin, c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier
""")
def union_by_name_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("column_discovery", """
SELECT CASE WHEN bool_or(trim(c_name) IN ('BUILDING', 'MACHINERY')) THEN 'c_name' WHEN bool_or(trim(c_mktsegment) IN ('BUILDING', 'MACHINERY')) THEN 'c_mktsegment' END AS found FROM customer
""")
def column_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.discover_column(table(spark, sf_dir, "customer"), ["BUILDING", "MACHINERY"])
    return spark.createDataFrame([(found,)], "found string")


@query("coerce_all_or_nothing", """
WITH raw AS (SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 500 = 0 THEN 'NaN' ELSE event_type END AS kind,
             CASE WHEN event_id % 7 = 0 THEN 'none' ELSE user_id::VARCHAR END AS mixed FROM events)
SELECT event_id, CAST(k AS DOUBLE) AS k, CASE WHEN lower(kind) = 'nan' THEN NULL ELSE kind END AS kind, mixed FROM raw
""")
def coerce_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 500 == 0, "NaN").otherwise(F.col("event_type"))
    mixed = F.when(F.col("event_id") % 7 == 0, "none").otherwise(F.col("user_id").cast("string"))
    raw = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), C.text_to_null(kind).alias("kind"), mixed.alias("mixed"))
    return C.coerce_numeric(raw, ["k", "mixed"])


@query("rowwise_sum_sentinel", """
WITH raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, NULLIF(CASE WHEN l_linenumber = 3 THEN -9 ELSE l_quantity END, -9) AS a, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a, round(COALESCE(a, 0) + COALESCE(b, 0), 4) AS total FROM raw
""")
def rowwise_sum_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = C.sentinel_to_null(F.when(F.col("l_linenumber") == 3, F.lit(-9.0)).otherwise(F.col("l_quantity")), -9.0)
    b = F.when(F.col("l_returnflag") != "R", F.col("l_tax"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", a.alias("a"), b.alias("b"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "a", F.round(C.row_sum(F.col("a"), F.col("b")), 4).alias("total"))




def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns of lineitem, one of them sparse and one constant."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        q.alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.when(q > 40, q).alias("sparse"), F.lit(1.0).alias("constant"),
        F.when(F.col("l_returnflag") != "N", F.col("l_tax")).alias("half"),
    )


_WIDE_SQL = """WITH wide AS (SELECT l_quantity AS quantity, l_discount AS discount, l_tax AS tax, CASE WHEN l_quantity > 40 THEN l_quantity END AS sparse, 1.0::DOUBLE AS constant,
  CASE WHEN l_returnflag <> 'N' THEN l_tax END AS half FROM lineitem),
long AS (SELECT variable, value FROM wide UNPIVOT INCLUDE NULLS (value FOR variable IN (quantity, discount, tax, sparse, constant, half)))"""


@query("drop_sparse_constant_columns", _WIDE_SQL + """
SELECT variable FROM long GROUP BY variable HAVING count(value) >= count(*) // 2 AND count(DISTINCT value) <> 1
""")
def drop_sparse_constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir)
    kept = C.varying_columns(wide, C.dense_columns(wide, wide.columns))
    return spark.createDataFrame([(c,) for c in kept], "variable string")


@query("median_impute", """
WITH raw AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS price FROM orders)
SELECT o_orderkey, round(COALESCE(price, (SELECT median(price) FROM raw)), 4) AS price FROM raw
""")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("price"))
    return C.median_filled(raw, ["price"]).select("o_orderkey", F.round("price", 4).alias("price"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers in credit, and the finished orders of each customer."""
    people = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    bought = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n_orders"))
    return people, bought


_HALVES = "WITH people AS (SELECT c_custkey AS id, c_mktsegment FROM customer WHERE c_acctbal >= 0), bought AS (SELECT o_custkey AS id, count(*)::BIGINT AS n_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"


@query("provenance_join", _HALVES + """
SELECT COALESCE(p.id, b.id) AS id, c_mktsegment, n_orders, CASE WHEN p.id IS NOT NULL AND b.id IS NOT NULL THEN 'both' WHEN p.id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS provenance
FROM people p FULL JOIN bought b ON p.id = b.id
""")
def provenance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.with_provenance(*_halves(spark, sf_dir), "id")


@query("anti_semi_report", _HALVES + """
SELECT 'without order' AS report, count(*)::BIGINT AS n FROM people WHERE id NOT IN (SELECT id FROM bought) UNION ALL SELECT 'with order', count(*)::BIGINT FROM people WHERE id IN (SELECT id FROM bought)
""")
def anti_semi_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, bought = _halves(spark, sf_dir)
    report = lambda name, df: df.agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("n"))
    return report("without order", cohort.unmatched(people, bought, "id")).unionByName(report("with order", cohort.matched(people, bought, "id")))


@query("chained_outer_join", """
WITH a AS (SELECT c_custkey AS id, round(c_acctbal, 2) AS balance FROM customer WHERE c_acctbal >= 0), b AS (SELECT o_custkey AS id, count(*)::BIGINT AS n FROM orders GROUP BY 1), c AS (SELECT s_suppkey AS id, s_name FROM supplier)
SELECT id, balance, n, s_name FROM a FULL JOIN b USING (id) FULL JOIN c USING (id)
""")
def chained_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in credit, orders by customer, and suppliers."""
    a = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), F.round("c_acctbal", 2).alias("balance"))
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    return cohort.joined_sheets([a, b, c], "id")


@query("substring_join", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON contains(n_name, substr(r_name, 1, 1))")
def substring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text contained in another: two dimension tables, so a nested loop over a broadcast side whose size Spark checks."""
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_name").contains(F.substring("r_name", 1, 1))).select("n_nationkey", "r_regionkey")


@query("age_band_range_join", """
WITH ages AS (SELECT p_partkey, p_size + 15 + p_partkey % 40 AS age FROM part)
SELECT p_partkey, CASE WHEN age BETWEEN 18 AND 30 THEN '18-30' WHEN age BETWEEN 31 AND 40 THEN '31-40' WHEN age BETWEEN 41 AND 50 THEN '41-50' WHEN age BETWEEN 51 AND 60 THEN '51-60'
  WHEN age BETWEEN 61 AND 70 THEN '61-70' WHEN age BETWEEN 71 AND 80 THEN '71-80' WHEN age BETWEEN 81 AND 90 THEN '81-90' WHEN age > 90 THEN '90+' END AS band FROM ages
""")
def age_band_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.age_band(F.col("p_size") + 15 + F.col("p_partkey") % 40).alias("band"))


@query("cohort_match", """
WITH cases AS (SELECT s_nationkey AS nation, s_suppkey % 2 AS side FROM supplier WHERE s_acctbal < 0),
budget AS (SELECT nation, side, 4 * count(*) AS budget FROM cases GROUP BY ALL),
people AS (SELECT c_custkey AS person, c_nationkey AS nation, c_custkey % 2 AS side FROM customer WHERE c_acctbal > 0)
SELECT person, nation, side FROM people JOIN budget USING (nation, side) QUALIFY row_number() OVER (PARTITION BY nation, side ORDER BY person) <= budget
""")
def cohort_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in debt are the cases, customers in credit of the same nation and side their controls."""
    cases = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 2).alias("side"))
    people = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 2).alias("side"))
    return cohort.match_controls(cases, people, ["nation", "side"], "person", "person", 4).drop("place")


_COLLAPSE = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 97)::DOUBLE END"


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 97).cast("double"))
    status = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_custkey", x.alias("x"), F.col("o_totalprice").alias("w"), status.alias("status"), F.col("o_orderkey").alias("order_id"))


@query("weighted_collapse_skipna", f"""
WITH rows AS (SELECT o_custkey, {_COLLAPSE} AS x, o_totalprice AS w, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS status, o_orderkey FROM orders)
SELECT o_custkey, round(COALESCE(sum(x * w), 0) / sum(w), 6) AS x, round(sum(w * w) / sum(w), 4) AS w, arg_min(struct_pack(s := status), o_orderkey).s AS status FROM rows GROUP BY o_custkey
""")
def weighted_collapse_skipna(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.collapse(_weighted(spark, sf_dir), "o_custkey", "w", ["order_id"])
    return out.select("o_custkey", F.round("x", 6).alias("x"), F.round("w", 4).alias("w"), "status")


@query("weighted_collapse_strict", f"""
WITH rows AS (SELECT o_custkey, {_COLLAPSE} AS x, o_totalprice AS w FROM orders)
SELECT o_custkey, round(CASE WHEN count(x) = count(*) THEN sum(x * w) / sum(w) END, 6) AS x FROM rows GROUP BY o_custkey
""")
def weighted_collapse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.collapse(_weighted(spark, sf_dir), "o_custkey", "w", ["order_id"], strict=True).select("o_custkey", F.round("x", 6).alias("x"))


@query("profile_describe", _WIDE_SQL + """
SELECT variable, count(value)::BIGINT AS count, round(sum(value::DECIMAL(18,2))::DOUBLE / count(value), 4) AS mean, round(stddev_samp(value), 5) AS std, round(median(value), 4) AS median, count(DISTINCT value)::BIGINT AS "unique",
  min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr FROM long GROUP BY variable
""")
def profile_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir)
    r = lambda c, n: F.round(c, n).alias(c)
    return A.profile(wide, wide.columns).select("variable", "count", r("mean", 4), r("std", 5), r("median", 4), "unique", "min", "max", r("iqr", 4))


@query("moments_bias_corrected", """
SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS g1, round(kurtosis(l_extendedprice), 6) AS g2 FROM lineitem GROUP BY l_returnflag
""")
def moments_bias_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(A.skewness_g1(x), 6).alias("g1"), F.round(A.kurtosis_g2(x), 6).alias("g2"))


@query("six_number_summary", """
SELECT o_orderpriority, count(*)::BIGINT AS n, round(avg(o_totalprice), 3) AS mean, round(median(o_totalprice), 3) AS median, max(o_totalprice) AS max, min(o_totalprice) AS min, round(stddev_samp(o_totalprice), 3) AS std FROM orders GROUP BY 1
""")
def six_number_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 3).alias(c)
    return A.six_numbers(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"]).select("o_orderpriority", "n", r("mean"), r("median"), "max", "min", r("std"))


@query("value_proportions", "SELECT c_mktsegment, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1")
def value_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.proportions(table(spark, sf_dir, "customer"), "c_mktsegment").withColumn("share", F.round("share", 6))


@query("resized_mean", """
WITH v AS (SELECT vec_id, list_filter(embedding::DOUBLE[], lambda v: v > 0) AS x FROM embeddings), size AS (SELECT median(len(x))::INT AS n FROM v)
SELECT pos::INT AS pos, round(avg(x[pos % len(x) + 1]), 6) AS mean FROM v, size, generate_series(0, n - 1) AS g(pos) GROUP BY pos
""")
def resized_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positive components of each vector, which are of different number, brought to one length."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.filter(F.col("embedding").cast("array<double>"), lambda v: v > 0).alias("x"))
    return A.resized_mean(x, "vec_id", "x").select(F.col("pos").cast("int").alias("pos"), F.round("mean", 6).alias("mean"))


@query("resume_anti_join", "SELECT event_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.value > 5 * (SELECT avg(value) FROM events))")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users without an event of over five times the mean value."""
    events = table(spark, sf_dir, "events")
    level = events.agg((F.avg("value") * 5).alias("level"))  # one row
    return unprocessed(events, events.join(F.broadcast(level), F.col("value") > F.col("level")), "user_id").select("event_id", "event_type")


@query("segment_plan", """
WITH o AS (SELECT o_orderkey, o_totalprice / 20 AS duration FROM orders WHERE o_totalprice / 20 >= 600)
SELECT o_orderkey, g.s::BIGINT AS segment, round(g.s * 3600.0::DOUBLE, 4) AS start_time, round(least((g.s + 1) * 3600.0::DOUBLE, duration), 4) AS end_time FROM o, generate_series(0, ceil(duration / 3600.0)::BIGINT - 1) AS g(s)
""")
def segment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 20).alias("duration"))
    return windows.segments(orders, "duration", 3600, least=600).select("o_orderkey", "segment", F.round("start_time", 4).alias("start_time"), F.round("end_time", 4).alias("end_time"))


_HASH = "(((42 * 31 + o_custkey * 2654435761) % 2147483647) * 31 + o_orderkey * 2654435761) % 2147483647"


@query("sample_n_per_group", f"SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_HASH}, o_custkey, o_orderkey) <= 3")
def sample_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.sample_per_group(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_custkey", "o_orderkey"], 3)


@query("hash_split", f"SELECT o_orderkey, ({_HASH}) % 100 < 20 AS test FROM orders")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.hash_split(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"]).select("o_orderkey", "test")


@query("topk_per_group", "SELECT p_partkey, p_brand, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 4")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_per_key(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], F.desc("p_retailprice"), F.col("p_partkey"), k=4)


@query("top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query("capitalize_names", """
SELECT p_partkey, concat_ws(' ', CASE WHEN len(string_split(p_name, ' ')) > 1 THEN array_to_string(string_split(p_name, ' ')[1 : len(string_split(p_name, ' ')) - 1], ' ') END,
  upper(substr(string_split(p_name, ' ')[-1], 1, 1)) || lower(substr(string_split(p_name, ' ')[-1], 2))) AS name FROM part
""")
def capitalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.last_token_capitalised(F.col("p_name")).alias("name"))


@query("map_rename", "SELECT n_nationkey, CASE n_regionkey::VARCHAR WHEN '0' THEN 'zero' WHEN '3' THEN 'three' ELSE n_regionkey::VARCHAR END AS region FROM nation")
def map_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", C.renamed(F.col("n_regionkey").cast("string"), {"0": "zero", "3": "three"}).alias("region"))


@query("dictionary_lookup", """
WITH named AS (SELECT unnest(json_keys(props)) AS key, props, event_id FROM events) SELECT event_id, key, json_extract_string(props, '$.' || key) AS value, CASE key WHEN 'k' THEN 'a number' END AS description FROM named
""")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.sources.files import described

    entries = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return described(entries, spark.createDataFrame([("k", "a number")], "column string, description string"), "key")


_NEEDLES = "needles AS (SELECT DISTINCT lang AS needle FROM documents UNION SELECT DISTINCT source FROM documents UNION SELECT DISTINCT lower(n_name) FROM nation UNION SELECT DISTINCT regexp_extract(url, 'https?://[^./]+([.][^/]+)', 1) FROM pages)"


@query("contained_names", "WITH " + _NEEDLES + ", texts AS (SELECT url AS text FROM pages UNION ALL SELECT p_name FROM part UNION ALL SELECT DISTINCT source FROM documents) SELECT text, needle, count(*)::BIGINT AS n FROM texts JOIN needles ON needle <> '' AND contains(text, needle) GROUP BY ALL")
def contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls, part names and sources that hold a language, a source, a nation or the end of a host, and how often each pair occurs."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    texts = pages.select(F.col("url").alias("text")).unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("text"))).unionByName(docs.select(F.col("source").alias("text")).distinct())
    host = F.regexp_extract("url", "https?://[^./]+([.][^/]+)", 1)
    sides = [docs.select(F.col("lang").alias("needle")), docs.select("source"), table(spark, sf_dir, "nation").select(F.lower("n_name")), pages.select(host)]
    needles = reduce(lambda a, b: a.union(b), sides).distinct()
    return cohort.containing(texts, "text", needles, "needle").groupBy("text", "needle").agg(F.count(F.lit(1)).alias("n"))


@query("adaptive_segments", """
WITH RECURSIVE o AS (SELECT o_orderkey, o_totalprice / 64 AS duration, 900.0::DOUBLE * (o_orderkey % 5) AS works FROM orders),
steps AS (SELECT o_orderkey, duration, works, 0.0::DOUBLE AS start_time, 3600.0::DOUBLE AS size, 0::BIGINT AS segment, 0.0::DOUBLE AS from_time, NULL::DOUBLE AS end_time, NULL::BOOLEAN AS ok FROM o
  UNION ALL
  SELECT o_orderkey, duration, works, CASE WHEN fine THEN stop WHEN size <= 900 THEN least(start_time + 3600, duration) ELSE start_time END, CASE WHEN fine OR size <= 900 THEN 3600 ELSE size - 900 END,
    CASE WHEN fine OR size <= 900 THEN segment + 1 ELSE segment END, start_time, CASE WHEN fine THEN stop WHEN size <= 900 THEN least(start_time + 3600, duration) END, CASE WHEN fine THEN true WHEN size <= 900 THEN false END
  FROM (SELECT *, least(start_time + size, duration) AS stop, least(start_time + size, duration) - start_time <= works AS fine FROM steps WHERE start_time < duration))
SELECT o_orderkey, segment - 1 AS segment, from_time AS start_time, end_time, ok FROM steps WHERE ok IS NOT NULL
""")
def adaptive_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of durations made of prices; a segment works if it is no longer than the order's key allows, and for one in five none does."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 64).alias("duration"), (F.lit(900.0) * (F.col("o_orderkey") % 5)).alias("works"))
    attempt = lambda df: df.withColumn("ok", F.col("end_time") - F.col("start_time") <= F.col("works"))
    return windows.adaptive_segments(orders, ["o_orderkey"], "duration", attempt, 3600, 900)
