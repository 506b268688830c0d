"""Column expressions for names, text, missing values and formats."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns, in order."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def columns_like(df: DataFrame, *fragments: str) -> list[str]:
    """Names that contain any of the fragments, in order."""
    return [c for c in df.columns if any(x in c for x in fragments)]


def quoted(name: str) -> Column:
    """A column whose name may hold dots, blanks or brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


def tidy_names(df: DataFrame) -> DataFrame:
    """Dots in names become underscores; < and > go."""
    return df.toDF(*[c.replace(".", "_").replace("<", "").replace(">", "") for c in df.columns])


def prefixed(df: DataFrame, prefix: str, key: str) -> DataFrame:
    """All names but the key with a prefix."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c != key})


def to_front(df: DataFrame, name: str) -> DataFrame:
    return df.select(quoted(name), *[quoted(c) for c in df.columns if c != name])


def capitalised(text: Column) -> Column:
    """First letter upper, the rest lower case."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def last_token_capitalised(text: Column, separator: str = " ") -> Column:
    """The last part of text, capitalised; the other parts stay."""
    parts = F.split(text, separator)
    last = capitalised(F.element_at(parts, -1))
    return F.array_join(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(last)), separator)


def renamed(text: Column, names: dict[str, str]) -> Column:
    """The name that a map gives, or text itself."""
    if not names:
        return text
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, text), text)


def text_to_null(text: Column, word: str = "nan", exact: bool = True) -> Column:
    """Null where text is the word in any case; exact=False also where it merely contains it."""
    hit = F.lower(text) == word if exact else F.lower(text).contains(word)
    return F.when(hit, None).otherwise(text)


def sentinel_to_null(value: Column, sentinel: float = -9) -> Column:
    return F.nullif(value, F.lit(sentinel))


def to_number(text: Column) -> Column:
    """The number that text spells, else null."""
    return text.try_cast("double")


def row_sum(*values: Column) -> Column:
    """Sum over columns; nulls count as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0)) for v in values])


def trimmed(df: DataFrame) -> DataFrame:
    """Every text column without blanks at its ends."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.trim(quoted(c)) for c in texts})


def coerce_numeric(df: DataFrame, names: list[str]) -> DataFrame:
    """Text columns whose every value is a number or null become doubles; the others stay. One pass decides for all columns."""
    if not names:
        return df
    tests = [F.coalesce(F.bool_and(quoted(c).isNull() | to_number(quoted(c)).isNotNull()), F.lit(True)).alias(str(i)) for i, c in enumerate(names)]
    decided = df.agg(*tests).first()
    return df.withColumns({c: to_number(quoted(c)) for i, c in enumerate(names) if decided[i]})


def dense_columns(df: DataFrame, names: list[str], least_share: float = 0.5) -> list[str]:
    """Names of columns with at least int(rows * share) values that are not null."""
    if not names:
        return []
    row = df.agg(F.count(F.lit(1)), *[F.count(quoted(c)) for c in names]).first()
    return [c for c, n in zip(names, row[1:], strict=True) if n >= int(row[0] * least_share)]


def varying_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Names of columns whose distinct values, nulls left out, are not exactly one."""
    if not names:
        return []
    row = df.agg(*[F.struct(F.min(quoted(c)).alias("a"), F.max(quoted(c)).alias("b")) for c in names]).first()
    return [c for c, r in zip(names, row, strict=True) if r["a"] is None or r["a"] != r["b"]]


def median_filled(df: DataFrame, names: list[str]) -> DataFrame:
    """Nulls of each column become its exact median; all columns in one pass over their long form."""
    from brindle.operators.quantiles import quantiles

    if not names:
        return df
    long = df.select(*[quoted(c).cast("double").alias(str(i)) for i, c in enumerate(names)]).unpivot([], [str(i) for i in range(len(names))], "variable", "value")
    medians = {int(r["variable"]): r["q"][0] for r in quantiles(long, ["variable"], "value", [0.5]).collect()}  # one row a column
    return df.withColumns({c: F.coalesce(quoted(c).cast("double"), F.lit(medians.get(i))) for i, c in enumerate(names)})


def discover_column(df: DataFrame, values: list[str]) -> str | None:
    """The first column that holds any of the values."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if not texts:
        return None
    row = df.agg(*[F.bool_or(F.trim(quoted(c)).isin(values)) for c in texts]).first()
    return next((c for c, hit in zip(texts, row, strict=True) if hit), None)


def stars(p: Column) -> Column:
    """Marks of significance; a null p has ns."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def age_band(age: Column) -> Column:
    """The first of the inclusive bands that holds the age; null outside of all."""
    bands = [(18, 30), (31, 40), (41, 50), (51, 60), (61, 70), (71, 80), (81, 90)]
    out = F
    for low, high in bands:
        out = out.when((age >= low) & (age <= high), f"{low}-{high}")
    return out.when(age > 90, "90+")


def clipped(value: Column, limit: float = 1e20) -> Column:
    """value, no further from 0 than limit; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value.cast("double"), F.lit(-limit)), F.lit(limit)))


def date_number_or_text(text: Column) -> list[Column]:
    """moment, number and rest: text as a timestamp if it spells one, else as a number if it spells one, else as it is."""
    moment = F.when(text.rlike(r"^\d{4}-\d"), text.try_cast("timestamp_ntz"))
    number = F.when(moment.isNull(), to_number(text))
    return [moment.alias("moment"), number.alias("number"), F.when(moment.isNull() & number.isNull(), text).alias("rest")]


def stripped(text: Column, prefix: str, suffix: str) -> Column:
    """text without a prefix and a suffix, both given as patterns."""
    return F.regexp_replace(text, f"^(?:{prefix})|(?:{suffix})$", "")


def without_columns(df: DataFrame, fragments: list[str]) -> DataFrame:
    """df without the columns whose names contain any of the fragments, in any case. Of columns of one name all are judged alike."""
    kept = [i for i, c in enumerate(df.columns) if not any(f.lower() in c.lower() for f in fragments)]
    unique = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return unique.select(*[F.col(f"c{i}").alias(df.columns[i]) for i in kept])


def split_at(df: DataFrame, marker: str) -> tuple[list[str], list[str]]:
    """The names before the first column whose name contains marker, and that one with those after it; all before without one."""
    at = next((i for i, c in enumerate(df.columns) if marker in c), len(df.columns))
    return df.columns[:at], df.columns[at:]


def templated(template: str, **parts: Column) -> Column:
    """A path from a template with {names}; null if a part is."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[parts[p].cast("string") if k % 2 else F.lit(p) for k, p in enumerate(pieces)])


def first_of_each_name(df: DataFrame) -> DataFrame:
    """df with the first of the columns of each name."""
    kept = [i for i, c in enumerate(df.columns) if c not in df.columns[:i]]
    unique = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return unique.select(*[F.col(f"c{i}").alias(df.columns[i]) for i in kept])
