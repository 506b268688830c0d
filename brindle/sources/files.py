"""File inventories, CSV files with different headers, dictionaries and sheets."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.columns import coerce_numeric


def inventory(spark: SparkSession, folder: str, suffix: str = "", least_bytes: int = 0) -> DataFrame:
    """path, size and file_name of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    return files.filter(F.col("path").endswith(suffix) & (F.col("size") > least_bytes)).withColumn("file_name", F.element_at(F.split("path", "/"), -1))


def with_patient(files: DataFrame, pattern: str = r"\d{3}-(\d{3})", group: int = 1) -> DataFrame:
    """patient_number from the file name, null where the pattern does not occur; ordered by it."""
    return files.withColumn("patient_number", F.nullif(F.regexp_extract("file_name", pattern, group), F.lit(""))).orderBy("patient_number", "path")


def csv_union(spark: SparkSession, folder: str, typed: bool = False) -> DataFrame:
    """All CSV files below a folder, united by column name, with csv_file_name in front; files without a header line are skipped.

    Spark reads files of one schema by position, so files are read in groups of equal headers. One small job reads the first
    lines; the driver gets one line for each different header. typed: columns whose every value in all files is a number or
    null become doubles; otherwise all are text.
    """
    lines = spark.read.text(folder, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    first = lines.filter((F.col("start") == 0) & (F.trim("value") != "")).groupBy("path").agg(F.first("value").alias("header"))
    groups: dict[str, list[str]] = defaultdict(list)
    for r in first.groupBy("header").agg(F.collect_list("path").alias("paths")).collect():
        groups[r["header"]] += r["paths"]
    if not groups:
        return spark.createDataFrame([], "csv_file_name string")
    parts = []
    for _, paths in sorted(groups.items()):
        part = spark.read.csv(sorted(paths), header=True)
        parts.append(part.select(F.col("_metadata.file_name").alias("csv_file_name"), *[F.col(f"`{c}`") for c in part.columns]))
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return coerce_numeric(united, united.columns[1:]) if typed else united


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """column and description of a flat JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("column", "description"))


def described(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """df with each key's description, null for a key that is not in the dictionary."""
    return df.join(names.withColumnRenamed("column", key), key, "left")


def write_sheets(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table a sheet, only where none is there yet."""
    for name, df in tables.items():
        df.write.mode("ignore").parquet(f"{folder}/sheet={name}")


def read_sheet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/sheet={name}")


def read_excel(spark: SparkSession, path: str, sheets: list[str] | str | None = None, header: int | None = 0) -> dict[str, DataFrame]:
    """Sheets of a workbook as text tables; needs a pandas engine for the format, which may not be installed."""
    import pandas as pd

    found = pd.read_excel(path, sheet_name=sheets, header=header, dtype=str)
    tables = found if isinstance(found, dict) else {str(sheets or 0): found}
    return {k: spark.createDataFrame(t.astype(object).where(t.notna(), None).rename(columns=str)) for k, t in tables.items()}
