"""Joins around cohorts: provenance, unmatched rows, and controls matched to cases without replacement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def joined_sheets(sheets: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of all sheets on the key."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), sheets)


def with_provenance(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join with the column provenance: left_only, right_only or both."""
    a, b = left.withColumn("left__", F.lit(True)), right.withColumn("right__", F.lit(True))
    where = F.when(F.col("left__") & F.col("right__"), "both").when(F.col("left__"), "left_only").otherwise("right_only")
    return a.join(b, key, "full_outer").withColumn("provenance", where).drop("left__", "right__")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def match_controls(cases: DataFrame, controls: DataFrame, strata: list[str], person: str, order: str, ratio: int = 4) -> DataFrame:
    """Controls taken for the cases: per stratum the first ``ratio * cases`` different persons, in order.

    Each person counts once, with the first of its rows over all strata, so the result does not depend on who is matched first.
    Strata are counted before the join; the running number is per stratum.
    """
    once = F.row_number().over(Window.partitionBy(person).orderBy(order))
    people = controls.withColumn("once__", once).filter("once__ = 1").drop("once__")
    budget = cases.groupBy(*strata).agg((F.count(F.lit(1)) * ratio).alias("budget__"))
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(order))
    eligible = people.join(budget, strata).withColumn("place", place)
    return eligible.filter(F.col("place") <= F.col("budget__")).drop("budget__")


def portable_hash(seed: int, *columns: str) -> Column:
    """An arithmetic hash of integer columns that SQL engines agree on."""
    total = F.lit(seed).cast("long")
    for c in columns:
        total = (total * 31 + F.col(c).cast("long") * 2654435761) % 2147483647
    return total


def sample_per_group(df: DataFrame, keys: list[str], ids: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows of each group (all of a smaller one), by the hash of the integer ids."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(portable_hash(seed, *ids), *ids))
    return df.withColumn("place__", place).filter(F.col("place__") <= n).drop("place__")


def hash_split(df: DataFrame, ids: list[str], test_percent: int = 20, seed: int = 42) -> DataFrame:
    """df with the boolean test; a row's side depends on its ids alone."""
    return df.withColumn("test", portable_hash(seed, *ids) % 100 < test_percent)


def grams(text: Column, size: int) -> Column:
    """The different stretches of ``size`` characters in text; none in a shorter or null text."""
    n = F.char_length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(left: DataFrame, text: str, right: DataFrame, needle: str, size: int = 3) -> DataFrame:
    """left joined to right where text holds needle, letter for letter; nulls and empty needles meet nothing.

    Different texts are indexed by their grams of up to ``size`` characters, needles look up their rarest gram alone, and what
    they meet is checked. So there is no nested loop: work follows the rows of the needles' rarest grams.
    """
    texts = left.select(F.col(text).alias("text__")).filter("text__ IS NOT NULL").distinct()
    needles = right.select(F.col(needle).alias("needle__")).filter("needle__ != ''").distinct()
    spans = F.flatten(F.array(*[F.transform(grams(F.col("text__"), k), lambda g: g) for k in range(1, size + 1)]))
    wide = F.least(F.char_length("needle__"), F.lit(size))
    own = F.coalesce(*[F.when(wide == k, grams(F.col("needle__"), k)) for k in range(1, size + 1)])
    asked = needles.select("needle__", F.explode(own).alias("gram"))
    index = texts.select("text__", F.explode(spans).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi")
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("needle__").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    pairs = rarest.join(index, "gram").filter(F.contains("text__", "needle__")).select("text__", "needle__")
    met = left.join(pairs, F.col(text) == F.col("text__")).drop("text__")
    return met.join(right.withColumnRenamed(needle, "needle__"), "needle__").withColumnRenamed("needle__", needle)
