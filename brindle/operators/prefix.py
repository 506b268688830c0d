"""Running totals over an order that no task sees whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.session import kept


def running_totals(df: DataFrame, keys: list[str], order: Column, **sums: str) -> DataFrame:
    """df with columns that hold, for each name=column, the sum of the column over the key's rows up to and with this one.

    Rows are dealt to ranges of (keys, order) and kept. Each range sums its own rows; the sums of the key's earlier ranges, one
    row a key and range, are added. So a key of many rows takes as many tasks as it has ranges. order must be different for
    all rows of a key; nulls in the columns count as 0, and null keys are a key.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], order).withColumn("range__", F.spark_partition_id())
    rows = kept(ranged)
    part = ["range__", *keys]
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({name: F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto) for name, c in sums.items()})
    own = rows.groupBy(*part).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(name) for name, c in sums.items()])
    earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    before = own.select(F.col("range__").alias("at__"), F.struct(F.lit(0), *keys).alias("key__"), *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}__") for name in sums])
    joined = inside.join(before, (F.col("range__") == F.col("at__")) & (F.struct(F.lit(0), *keys) == F.col("key__")))
    return joined.select(*df.columns, *[(F.col(name) + F.col(f"{name}__")).alias(name) for name in sums])
