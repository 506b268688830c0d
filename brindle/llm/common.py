"""What the operators of this subpackage share: reading tables, shared checkpoints, word rules, distributed ranks, joins that hot keys do not stall."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and the master is local."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
        known = sc.getCheckpointDir()
    return known


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept_table(df: DataFrame) -> DataFrame:
    """df, written as compressed Parquet below the shared folder and read from there; for wide rows that are read again."""
    folder = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def looked_up(rows: DataFrame, lines: DataFrame, key: str, count: str = "n") -> DataFrame:
    """rows joined to lines (computed before: one row a key that is not null, with its number of rows as count), without count; rows whose key has no line go.

    A key of over a thousandth of the counted rows is hot. There are fewer than a thousand of these, whatever the tables hold:
    they are broadcast, and their rows stay where they are. No task of the shuffle for the other keys gets a large group.
    """
    total = lines.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > F.lit(total / 1000)
    few, many = F.broadcast(lines.filter(hot).drop(count)), lines.filter(~hot).drop(count)
    cold = rows.join(few.select(key), key, "left_anti").join(many, key)
    return rows.join(few, key).unionByName(cold)


def bounded_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Arrow batches for Python workers hold so many bytes at most, however long single texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with 0, 1, 2 ... in the given order, by a range-partitioned sort and the partitions' row counts; no task sees all rows.

    Checkpoints the sorted rows, as the numbering must see the same partitions twice. Ties get adjoining ranks.
    """
    part, place = f"{name}__part", f"{name}__place"
    rows = cut(
        df.orderBy(*order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(part)
        .agg((F.max(place) + 1).alias("n"))
        .select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col("start") + F.col(place)).drop(part, place, "start")


def output_schema(*fields: tuple[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
