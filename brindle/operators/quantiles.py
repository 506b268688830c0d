"""Exact order statistics of groups of any size.

A small group (MOST rows or about MOST distinct values at most) is counted by distinct value, and the counts are summed up in
order. For each rank that is asked of a larger group, a mergeable sketch of all rows gives two values that bracket the rank; a
counting pass tells how many rows lie under and within the bracket, and whether the rank does. Brackets of more than MOST rows
are sketched again, from the rows within alone, so that every round leaves a hundredth or less. Then only the rows within are
counted by value. Rows meet brackets where they are: brackets are broadcast, as a group that has some is of more than MOST rows.
No task gets a large group whole, and nothing is approximate: a bracket that misses its rank is not taken, and the estimated
number of distinct values only chooses between two exact ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.session import kept

#: Rows of a group, or within a bracket, whose distinct values one task sums up; inverse error of the sketch; its edges; rounds.
MOST, ACCURACY, EDGES, ROUNDS = 1_000_000, 10_000, 256, 8


def _inside(v: Column) -> Column:
    """Whether a value lies in the bracket lo..hi; a null end is open."""
    return (F.col("lo").isNull() | (v >= F.col("lo"))) & (F.col("hi").isNull() | (v <= F.col("hi")))


def _bracketed(rows: DataFrame, states: DataFrame, most: int, accuracy: int, edges: int) -> DataFrame:
    """states (key, p, rank, n, below, inside, lo, hi) with brackets of ``most`` rows at most, or as narrow as rounds made them."""
    for _ in range(ROUNDS):
        wide = (F.col("inside") > most) & (F.col("lo").isNull() | F.col("hi").isNull() | (F.col("lo") < F.col("hi")))
        open_, closed = states.filter(wide), states.filter(~wide)
        if open_.isEmpty():
            break
        met = rows.join(F.broadcast(open_), "key").filter(_inside(F.col("value")))
        marks = met.groupBy("key", "p").agg(F.percentile_approx("value", [k / edges for k in range(edges + 1)], accuracy).alias("marks"))
        place = (F.col("rank") - F.col("below")) / F.col("inside") * edges
        slack = edges * 2 / accuracy + 1
        low, high = F.floor(place - slack), F.ceil(place + slack)
        narrow = open_.join(marks, ["key", "p"]).withColumns({
            "new_lo": F.when(low >= 1, F.col("marks")[low.cast("int")]).otherwise(F.col("lo")), "new_hi": F.when(high < edges, F.col("marks")[high.cast("int")]).otherwise(F.col("hi")),
        }).drop("marks")
        tried = narrow.withColumnsRenamed({"lo": "old_lo", "hi": "old_hi", "new_lo": "lo", "new_hi": "hi"}).withColumnsRenamed({"below": "old_below", "inside": "old_inside"})
        tried = kept(tried)  # merged in another order, a sketch gives other marks, and what is counted must be what is taken
        counted = rows.join(F.broadcast(tried.select("key", "p", "lo", "hi")), "key").groupBy("key", "p").agg(
            F.count_if(F.col("lo").isNotNull() & (F.col("value") < F.col("lo"))).alias("below"), F.count_if(_inside(F.col("value"))).alias("inside")
        )
        right = (F.col("below") <= F.col("rank")) & (F.least(F.col("rank") + 1, F.col("n") - 1) < F.col("below") + F.col("inside"))
        pick = lambda c, old: F.when(right, F.col(c)).otherwise(F.col(old)).alias(c)
        judged = tried.join(counted, ["key", "p"]).select("key", "p", "rank", "n", *[pick(c, f"old_{c}") for c in ("below", "inside", "lo", "hi")], (right & (F.col("inside") < F.col("old_inside"))).alias("better"))
        judged = kept(judged)
        moved = judged.filter("better").count()
        states = kept(closed.unionByName(judged.drop("better")))
        if not moved:
            break
    return states


def quantiles(df: DataFrame, keys: list[str], value: str | Column, shares: list[float], most: int = MOST, accuracy: int = ACCURACY, edges: int = EDGES) -> DataFrame:
    """keys, n and q: for each share the exact quantile of the values of each group, by linear interpolation.

    Nulls and NaN are no values; a group without a value has no row; null keys are a key.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(F.struct(*keys or [F.lit(0).alias("all")]).alias("key"), F.when(~F.isnan(v), v).alias("value")).filter("value IS NOT NULL")
    spot = lambda n, s: F.lit(float(s)) * (n - 1)

    def named(picked: DataFrame) -> DataFrame:
        """lo0, hi0, lo1 ... as the array q, between the two values by the fraction of the rank."""
        between = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (spot(F.col("n"), s) - F.floor(spot(F.col("n"), s))) for i, s in enumerate(shares)]
        return picked.select(*[F.col("key")[k].alias(k) for k in keys], "n", F.array(*between).alias("q"))

    total = F.sum("c").over(Window.partitionBy("key"))
    ranks = [(f"{end}{i}", f(spot(total, s))) for i, s in enumerate(shares) for end, f in (("lo", F.floor), ("hi", F.ceil))]
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("value").alias("values"))
    large = kept(counts.filter((F.col("n") > most) & (F.col("values") > most)).select("key", "n"))

    def small(chosen: DataFrame) -> DataFrame:
        lines = chosen.groupBy("key", "value").agg(F.count(F.lit(1)).alias("c"))
        upto = Window.partitionBy("key").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        summed = lines.select("key", "value", F.sum("c").over(upto).alias("upto"), total.alias("n"), *[r.alias(name) for name, r in ranks])
        return summed.groupBy("key").agg(F.first("n").alias("n"), *[F.min(F.when(F.col("upto") > F.col(name), F.col("value"))).alias(name) for name, _ in ranks])

    if large.isEmpty():
        return named(small(rows))
    point = F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.lit(float(s)).alias("s")) for i, s in enumerate(shares)])).alias("point")
    states = large.select("key", "n", point).select(
        "key", F.col("point.p").alias("p"), F.floor(F.col("point.s") * (F.col("n") - 1)).alias("rank"), "n", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")
    )
    states = _bracketed(rows, kept(states), most, accuracy, edges)
    met = rows.join(F.broadcast(states.select("key", "p", "lo", "hi")), "key").filter(_inside(F.col("value")))
    lines = met.groupBy("key", "p", "value").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(states.select("key", "p", "rank", "below", F.col("n").alias("all"))), ["key", "p"])
    upto = Window.partitionBy("key", "p").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    reached = lines.withColumn("upto", F.col("below") + F.sum("c").over(upto))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))
    ends = reached.groupBy("key", "p").agg(F.first("all").alias("n"), at(F.col("rank")).alias("lo"), at(F.least(F.col("rank") + 1, F.col("all") - 1)).alias("hi"))
    wide = ends.groupBy("key").agg(F.first("n").alias("n"), *[F.max(F.when(F.col("p") == i, F.col(end))).alias(f"{end}{i}") for i in range(len(shares)) for end in ("lo", "hi")])
    return named(small(rows.join(F.broadcast(large.select("key")), "key", "left_anti")).unionByName(wide))
