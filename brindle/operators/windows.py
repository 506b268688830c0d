"""Windows over sample positions: fixed windows, overlapping epochs, runs and segments."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.session import kept


def positioned(df: DataFrame, keys: list[str], *order: str, name: str = "n", bucket: Column | None = None) -> DataFrame:
    """df with 0, 1, 2 ... within each key, in the given order.

    bucket never falls along the order, such as the hour of the time that comes first in it. With it, rows are numbered within
    key and bucket and the sizes of the key's earlier buckets are added, so that a hot key takes as many tasks as it has buckets.
    """
    if bucket is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    part = [*keys, "bucket__"]
    rows = df.withColumn("bucket__", bucket)
    earlier = Window.partitionBy(*keys).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("size__"))
    starts = sizes.select(*[F.col(k).alias(f"{k}__at") for k in part], F.coalesce(F.sum("size__").over(earlier), F.lit(0)).alias("start__"))
    numbered = rows.withColumn("place__", F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}__at")) for k in part])
    return numbered.join(starts, same).select(*df.columns, (F.col("start__") + F.col("place__")).alias(name))


def count_windows(df: DataFrame, keys: list[str], length: int, *aggregates: Column, position: str = "n") -> DataFrame:
    """Aggregates of whole windows of ``length`` samples; a trailing partial window is left out."""
    window = F.floor(F.col(position) / length).alias("win")
    return df.groupBy(*keys, window).agg(F.count(F.lit(1)).alias("samples__"), *aggregates).filter(F.col("samples__") == length).drop("samples__")


def overlapping_epochs(df: DataFrame, length: int, step: int, total: Column, position: str = "n") -> DataFrame:
    """Each sample once for every whole epoch that holds it: columns epoch and offset. total is the number of samples."""
    n = F.col(position)
    first = F.greatest(F.lit(0), F.floor((n - length) / step) + 1)
    last = F.least(F.floor(n / step), F.floor((total - length) / step))
    spread = df.withColumn("epoch", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    return spread.withColumn("offset", n - F.col("epoch") * step)


def concatenated(epochs: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Epochs laid end to end: position new_n on an axis without the gaps of missing epochs; overlaps stay doubled."""
    order = F.dense_rank().over(Window.partitionBy(*keys).orderBy("epoch")) - 1
    return epochs.withColumn("new_n", order * length + F.col("offset"))


def islands(flagged: DataFrame, keys: list[str], position: str, least: int = 5, bucket: int = 1 << 16) -> DataFrame:
    """Runs of consecutive integer positions with at least ``least`` of them: first, last and length.

    Runs are found within buckets of positions, so a key of many rows takes as many tasks as it has buckets. Those that touch a
    bucket's border, two a bucket at most, are joined to their neighbours then; runs inside of a bucket stay as they are.
    """
    n = F.col(position).cast("long")
    part = [*keys, "bucket__"]
    rows = flagged.select(*keys, n.alias("n__"), F.floor(n / bucket).alias("bucket__"))
    island = F.col("n__") - F.row_number().over(Window.partitionBy(*part).orderBy("n__"))
    runs = rows.withColumn("island__", island).groupBy(*part, "island__").agg(F.min("n__").alias("first"), F.max("n__").alias("last"))
    open_left, open_right = F.pmod(F.col("first"), F.lit(bucket)) == 0, F.pmod(F.col("last"), F.lit(bucket)) == bucket - 1
    ordered = Window.partitionBy(*keys).orderBy("first")
    begins = F.coalesce(F.lag("last").over(ordered) + 1 != F.col("first"), F.lit(True))
    chained = runs.filter(open_left | open_right).withColumn("begins__", begins.cast("int"))
    chained = chained.withColumn("chain__", F.sum("begins__").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    joined = chained.groupBy(*keys, "chain__").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    whole = runs.filter(~(open_left | open_right)).select(*keys, "first", "last").unionByName(joined.drop("chain__"))
    return whole.withColumn("length", F.col("last") - F.col("first") + 1).filter(F.col("length") >= least)


def run_statistics(groups: DataFrame, runs: DataFrame, keys: list[str], total: str) -> DataFrame:
    """Share of windows in runs, runs per minute of 60 windows, mean length; groups (keys, total) without a run get zeros."""
    own = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.sum("length").alias("inside"), F.avg("length").alias("mean"))
    t = F.col(total)
    return groups.join(own, keys, "left").select(
        *keys,
        F.coalesce(F.col("inside") / t * 100, F.lit(0.0)).alias("percentage"),
        F.coalesce(F.col("runs") / (t / 60), F.lit(0.0)).alias("per_minute"),
        F.coalesce("mean", F.lit(0.0)).alias("average_length"),
    )


def segments(df: DataFrame, duration: str, length: float, least: float = 0) -> DataFrame:
    """Fixed segments of each row's duration: segment, start_time and end_time, the last one cut short; durations under ``least`` go."""
    d = F.col(duration)
    spread = df.filter((d >= least) & (d > 0)).withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(d / length) - 1)))
    start = F.col("segment") * F.lit(float(length))
    return spread.withColumn("start_time", start).withColumn("end_time", F.least(start + F.lit(float(length)), d.cast("double")))


def adaptive_segments(
    recordings: DataFrame, keys: list[str], duration: str, attempt: Callable[[DataFrame], DataFrame], length: float = 3600.0, shrink: float = 300.0, done: DataFrame | None = None
) -> DataFrame:
    """keys, segment, start_time, end_time and ok: the segments that a resumable job takes over every recording.

    attempt gets segments (the columns of recordings, start_time and end_time) and adds the boolean ok, which tells whether the
    work on a segment succeeded; null is no. A segment that fails is tried again, shorter by ``shrink``, until it works or
    nothing is left of it; then a row with ok = false stands for its full length. The next one begins where it ends, at full
    length, so segments of a recording never overlap. All recordings take a step at once: the frontier is a table, kept after
    each step, and a step is one attempt of every recording that is not at its end. done holds the rows of an earlier run; its
    recordings go on after their last segment. A duration that is null or not above 0 has no segment.
    """
    columns = recordings.columns
    d = F.col(duration).cast("double")
    begun = recordings.filter(d > 0)
    first = [F.lit(0.0).alias("start_time"), F.lit(0).cast("long").alias("segment")]
    if done is not None:
        last = done.groupBy(*keys).agg(F.max("end_time").alias("start__"), F.max("segment").alias("segment__"))
        begun = begun.join(last, keys, "left").filter(F.coalesce("start__", F.lit(0.0)) < d)
        first = [F.coalesce("start__", F.lit(0.0)).alias("start_time"), (F.coalesce("segment__", F.lit(-1)) + 1).cast("long").alias("segment")]
    frontier = kept(begun.select(*columns, *first, F.lit(float(length)).alias("size__")))
    names = [*keys, "segment", "start_time", "end_time", "ok"]
    found = [] if done is None else [done.select(*names)]
    empty = frontier.limit(0).select(*keys, "segment", "start_time", F.col("start_time").alias("end_time"), F.lit(True).alias("ok"))
    while not frontier.isEmpty():
        end = lambda size: F.least(F.col("start_time") + size, d)
        tried = kept(attempt(frontier.withColumn("end_time", end(F.col("size__")))).withColumn("ok", F.coalesce("ok", F.lit(False))))
        shorter = F.col("size__") - F.lit(float(shrink))
        over = F.col("ok") | (shorter <= 0)
        stop = F.when(F.col("ok"), F.col("end_time")).otherwise(end(F.lit(float(length))))
        found.append(tried.filter(over).withColumn("end_time", stop).select(*names))
        ahead = tried.select(  # the next segment of what is over, the shorter one of what is not
            *columns, F.when(over, stop).otherwise(F.col("start_time")).alias("start_time"), (F.col("segment") + over.cast("int")).alias("segment"), F.when(over, float(length)).otherwise(shorter).alias("size__")
        )
        frontier = kept(ahead.filter(F.col("start_time") < d))
    return reduce(lambda a, b: a.unionByName(b), found) if found else empty
