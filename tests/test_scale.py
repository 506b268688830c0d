"""What must hold however many rows one key has: exact quantiles, running totals, runs over buckets."""

import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import aggregates, ml, prefix, quantiles, stats, windows

SHARES = [0, 0.1, 0.25, 0.5, 0.9, 0.97, 1]


@pytest.mark.parametrize("most, accuracy, edges", [(1_000_000, 10_000, 256), (100, 200, 16), (20, 1000, 64)])
def test_quantiles_against_sorting(spark, most, accuracy, edges):
    """Normal values, few values with many ties, 600 powers of ten, one value with a tail, nulls, NaN and a null key; most = 20 needs several rounds."""
    rng = np.random.default_rng(0)
    rows = [("normal", float(x)) for x in rng.standard_normal(5000)] + [("ties", float(x)) for x in rng.integers(0, 5, 3000)]
    rows += [(None, float(x)) for x in 10.0 ** rng.uniform(-300, 300, 4000)] + [("hot", 0.0 if i < 900 else float(i)) for i in range(1000)]
    rows += [("one", 1.0), ("none", None), ("two", float("nan")), ("two", 2.0), ("two", 4.0)]
    held = defaultdict(list)
    for k, v in rows:
        if v is not None and v == v:
            held[k].append(v)
    got = {r.k: (r.n, r.q) for r in quantiles.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", SHARES, most, accuracy, edges).collect()}
    assert set(got) == set(held)
    for k, v in held.items():
        v.sort()
        assert got[k][0] == len(v)
        for s, q in zip(SHARES, got[k][1], strict=True):
            at = s * (len(v) - 1)
            low, high = v[math.floor(at)], v[math.ceil(at)]
            assert q == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12)


def test_quantiles_without_keys_or_rows(spark):
    df = spark.range(101)
    assert quantiles.quantiles(df, [], "id", [0.5]).first().q == [50.0]
    assert quantiles.quantiles(df.limit(0), [], "id", [0.5]).count() == 0


def test_rows_of_a_large_group_are_not_shuffled_to_their_brackets(spark, monkeypatch):
    """No join of the rows by their key alone is a shuffle, and a group of few different values needs no bracket."""
    plans, kept = [], quantiles.kept
    monkeypatch.setattr(quantiles, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(6000).select((F.col("id") % 2).alias("k"), ((F.col("id") * 7) % 6000).alias("v"))
        got = quantiles.quantiles(rows, ["k"], "v", [0.25, 0.5], 100, 200, 16)
        plans.append(got._jdf.queryExecution().executedPlan().toString())
        assert {r.k: r.q for r in got.collect()} == {0: [1499.5, 2999.0], 1: [1500.5, 3000.0]}
        assert len(plans) > 3 and not [p for p in plans if re.search(r"SortMergeJoin \[key#\d+\]", p)]
        plans.clear()
        few = quantiles.quantiles(rows.withColumn("v", F.col("v") % 5), ["k"], "v", [0.25, 0.5], 100, 200, 16)
        assert {r.k: r.q for r in few.collect()} == {0: [1.0, 2.0], 1: [1.0, 2.0]}
        assert len(plans) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_summaries_of_null_keys_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), ("b", None)], "k string, v double")
    assert {r.k: (r.n, r.median) for r in aggregates.six_numbers(df, "v", ["k"]).collect()} == {"a": (2, 1.5), None: (1, 5.0), "b": (0, None)}
    row = aggregates.profile(df.withColumn("w", F.lit(None).cast("double")), ["v", "w"]).collect()
    assert {r.variable: (r["count"], r["median"], r["iqr"]) for r in row} == {"v": (3, 2.0, 2.0), "w": (0, None, None)}


def test_running_totals_in_ranges(spark):
    rows = [(i % 3 or None, i, 1.5 * i if i % 5 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, o int, x double").repartition(4)
    got = defaultdict(list)
    for r in prefix.running_totals(df, ["k"], F.col("o").desc(), t="x").collect():
        got[r.k].append((-r.o, r.x or 0.0, r.t))
    for own in got.values():
        own.sort()
        assert np.allclose(np.cumsum([x for _, x, _ in own]), [t for *_, t in own])
    assert len(got) == 3


def test_one_key_takes_many_tasks(spark):
    """The window under ranks is by range, so no task gets all values of a variable; nothing is ordered within one partition."""
    df = spark.range(4000).select(F.lit("v").alias("k"), (F.col("id") * 7 % 4001).alias("x"), (F.col("id") % 2).alias("g"))
    spread = prefix.running_totals(df.groupBy("k", "x").agg(F.count(F.lit(1)).alias("c")), ["k"], F.col("x"), t="c")
    sizes = [r["n"] for r in spread.groupBy(F.floor((F.col("t") - 1) / 1000)).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sizes == [1000] * 4
    plan = stats.mann_whitney(df, ["k"], "g", "x", 0, 1)._jdf.queryExecution().toString()
    assert "Window" in plan and "hashpartitioning(range__" in plan and "hashpartitioning(k" in plan
    scored = df.select(F.col("g").alias("y"), "x")
    assert "SinglePartition" not in ml.auc(scored, ["y"], "y", "x")._jdf.queryExecution().executedPlan().toString()


def test_runs_over_bucket_borders(spark):
    flags = [("a", n) for n in [*range(3, 5), *range(8, 27), 29, *range(32, 40), *range(41, 48)]] + [("b", n) for n in range(-9, 12)] + [(None, n) for n in range(16, 24)]
    df = spark.createDataFrame(flags, "k string, n int").repartition(3)
    for bucket in (1, 2, 8, 1 << 16):
        got = sorted(map(tuple, windows.islands(df, ["k"], "n", 2, bucket).collect()), key=repr)
        assert got == sorted([("a", 3, 4, 2), ("a", 8, 26, 19), ("a", 32, 39, 8), ("a", 41, 47, 7), ("b", -9, 11, 21), (None, 16, 23, 8)], key=repr)


@pytest.mark.parametrize("n1, n2", [(2, 3), (8, 4), (3, 9)])
def test_exact_u_of_a_small_group(n1, n2):
    us = [sum(a > b for a in one for b in set(range(n1 + n2)) - set(one)) for one in itertools.combinations(range(n1 + n2), n1)]
    for u in range(n1 * n2 + 1):
        low = min(u, n1 * n2 - u)
        assert stats.exact_mann_whitney(u, n1, n2) == pytest.approx(min(1, 2 * sum(v <= low for v in us) / len(us)))


def test_exact_u_against_a_large_group():
    """Near a sum of uniforms where one group is large, and exact in the first counts."""
    assert stats.exact_mann_whitney(3, 8, 5000) == pytest.approx(2 * 7 / math.comb(5008, 8))
    irwin_hall = sum((-1) ** k * math.comb(8, k) * (3 - k) ** 8 for k in range(4)) / math.factorial(8)  # U / 5000 is nearly a sum of eight uniforms
    assert stats.exact_mann_whitney(15_000, 8, 5000) == pytest.approx(2 * irwin_hall, rel=0.005)


def test_comparison_of_eight_with_many_is_exact(spark):
    rows = [("v", "a", 1000.5 + i) for i in range(8)] + [("v", "b", float(i) ** 3) for i in range(70)]
    got = stats.compare_groups(spark.createDataFrame(rows, "variable string, g string, x double"), "variable", "g", "x").first()
    u = sum(a > b for _, g, a in rows if g == "a" for _, h, b in rows if h == "b")
    assert got.test == "Mann-Whitney U" and got.p_value == pytest.approx(stats.exact_mann_whitney(u, 8, 70))


def test_typed_profile_of_a_large_column_takes_no_task_with_all_rows(spark, monkeypatch):
    plans, kept = [], quantiles.kept
    monkeypatch.setattr(quantiles, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    monkeypatch.setattr(aggregates, "quantiles", lambda *a: quantiles.quantiles(*a, 100, 200, 16))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(4001).select(((F.col("id") * 7) % 4001).alias("a"), (F.col("id") % 3).alias("b"), F.lit("x").alias("t"))
        got = aggregates.typed_profile(df)
        plans.append(got._jdf.queryExecution().executedPlan().toString())
        rows = {r.variable: (r["count"], r.unique, r.median, r.iqr) for r in got.collect()}
        assert rows == {"a": (4001, 4001, 2000.0, 2000.0), "b": (4001, 3, 1.0, 2.0), "t": (4001, 1, None, None)}
        assert not [p for p in plans if re.search(r"SortMergeJoin \[key#\d+\]", p)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_distinct_values_of_a_large_column_are_dealt_before_they_are_counted(spark, monkeypatch):
    """No task that reads a large file collects its distinct values: rows of such a column are dealt by value first, a frequent value to many tasks."""
    monkeypatch.setattr(aggregates, "MOST", 500, raising=False)
    x = F.when(F.col("id") % 2 == 0, -5.0).when(F.col("id") % 7 != 0, (F.col("id") / 2).cast("double"))
    df = spark.range(0, 4000, 1, 1).select(x.alias("x"), (F.col("id") % 3).alias("few"), F.lit(None).cast("double").alias("none"), F.concat(F.lit("t"), F.col("id")).alias("t"), F.lit("u").alias("u"))
    got = aggregates.typed_profile(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RepartitionByExpression \[value#\d+, turn#\d+L\], 8", plan)) == 2
    want = len({i / 2 for i in range(1, 4000, 2) if i % 7}) + 1
    rows = {r.variable: (r["count"], r.unique, r.min, r.max) for r in got.collect()}
    assert rows == {"x": (2000 + want - 1, want, -5.0, 1999.5), "few": (4000, 3, 0.0, 2.0), "none": (0, 0, None, None), "t": (4000, 4000, None, None), "u": (4000, 1, None, None)}
    assert aggregates.profile(df.limit(0), ["x"]).collect() == []


def test_brackets_are_the_ones_that_were_counted(spark, monkeypatch):
    """A sketch gives other marks each time its parts merge in another order (here: at random); medians stay exact."""
    plans, kept, sketch = [], quantiles.kept, F.percentile_approx
    monkeypatch.setattr(quantiles, "kept", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    moved = F.udf(lambda marks: [m + k for k in [random.randint(-40, 40)] for m in marks], "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda *a: moved(sketch(*a)))
    df = spark.range(4001).select(((F.col("id") * 7) % 4001).cast("double").alias("a"))
    for _ in range(3):
        assert quantiles.quantiles(df, [], "a", [0.25, 0.5, 0.75], 100, 200, 16).first()["q"] == [1000.0, 2000.0, 3000.0]
    assert max(p.count("percentile_approx(") for p in plans) == 1
