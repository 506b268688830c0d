"""Mixing sources to target weights by hash-threshold histograms.

Every row gets a 60-bit hash of its id and text. Word counts are summed by source and leading hash bits; the bucket in
which a source's budget runs out is found by a running sum over its buckets, and only that bucket is split by further bits
until it holds one row (or rows with one hash). Rows below the threshold are taken. Nothing is sorted but bucket sums, and
budgets are nested: a larger budget of a source takes every row that a smaller one takes.

Edge cases: a null text has size 0; a null source is a source of its own and the last one; a row of size 0 takes 0 words;
equal (id, text) rows have equal hashes and are taken together; an empty table gives an empty mix; columns other than the
three named ones are ignored by ``mix_sources`` and kept by ``apply_mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import cut, ranked, word_count

HASH_BITS, LEVEL_BITS = 60, 12


def row_hash(row_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of "<id>|<text>", as a long."""
    seen = F.concat(F.coalesce(row_id.cast("string"), F.lit("null")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(seen), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """sources (source, source_size) with ``target``: weights repeat over sources in order, and targets add up to share times
    all sizes, none above max_repeat times its source's size.

    The excess of capped sources is shared again by weight until none is above its cap. The driver gets one row of sums a
    round. A source is capped if weight * level exceeds its cap; the level only grows, so rounds end when it stands still.
    """
    ranks = ranked(sources, F.col("source").isNotNull().desc(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = cut(ranks.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_repeat)).alias("cap")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        capped, open_weight = rows.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if not open_weight:
            break
        new = (float(share) * total - (capped or 0.0)) / open_weight
        if new <= level:
            break
        level = new
    target = F.least(F.col("weight") * F.lit(level), F.col("cap"))
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with whole ``passes`` over each source and ``below``: rows whose hash is less are taken once more.

    rows has source, size and h. A source's budget beyond its whole passes is met to within half of the row at the
    threshold. Each round scans the narrow rows once and keeps a line for each source.
    """
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = cut(
        targets.withColumn("passes", ratio.cast("long")).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    )
    state = targets.filter("budget > 0").select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    shift = HASH_BITS
    sized = rows.filter("size > 0").select("source", "size", "h")
    while True:
        inside = F.shiftright("h", shift) == F.col("prefix")
        shift -= LEVEL_BITS
        own = state.withColumnRenamed("source", "own")
        sums = (
            sized.join(own, F.col("source").eqNullSafe(F.col("own")) & inside)
            .groupBy("source", "budget", "before", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        )
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        state = cut(
            sums.withColumn("reached", F.col("before") + F.sum("words").over(upto))
            .filter((F.col("reached") >= F.col("budget")) & (F.col("reached") - F.col("words") < F.col("budget")))
            .select("source", "budget", F.col("bucket").alias("prefix"), (F.col("reached") - F.col("words")).alias("before"), "words", "n")
        )
        if shift == 0 or (state.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    take = F.col("before") + F.col("words") - F.col("budget") < F.col("budget") - F.col("before")
    edge = state.select(F.col("source").alias("own"), F.shiftleft(F.col("prefix") + take.cast("long"), shift).alias("below"))
    return targets.join(edge, F.col("source").eqNullSafe(F.col("own")), "left").select(
        "source", "source_size", "target", "passes", F.coalesce("below", F.lit(0)).cast("long").alias("below")
    )


def _by_source(rows: DataFrame, lines: DataFrame, salts: int = 32) -> DataFrame:
    """rows with their source's line. Spark broadcasts lines if it measures them as small; otherwise a source's rows are dealt over salts."""
    left = rows.withColumn("salt__", F.pmod(F.col("h"), F.lit(salts)).cast("int"))
    right = lines.withColumnRenamed("source", "own__").withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    matched = left["source"].eqNullSafe(right["own__"]) & (left["salt__"] == right["salt__"])
    return left.join(right, matched).drop(left["salt__"]).drop(right["salt__"]).drop("own__")


def _decided(rows: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return thresholds(rows, source_targets(sources, weights, share, max_repeat))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_repeat: float = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """id, source, size, source_size, target, copies and taken of every row; copies is 0, 1 ... and taken = copies * size."""
    text = F.col(text_col)
    rows = cut(
        docs.select(F.col(id_col), F.col(source_col).alias("source"), word_count(text).alias("size"), row_hash(F.col(id_col), text).alias("h"))
    )
    lines = _decided(rows, weights, share, max_repeat)
    copies = F.col("passes") + (F.col("h") < F.col("below")).cast("long")
    return (
        _by_source(rows, lines)
        .withColumn("copies", copies)
        .select(id_col, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def apply_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_repeat: float = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: docs with each row as often as it is taken, all columns kept, whatever their names; rows taken 0 times go."""
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    row_id, text, source = (F.col(f"c{names.index(c)}") for c in (id_col, text_col, source_col))
    keys = {"source": source, "size": word_count(text), "h": row_hash(row_id, text)}
    lines = _decided(cut(docs.select(*[c.alias(n) for n, c in keys.items()])), weights, share, max_repeat)
    wide = docs.select(F.struct(*docs.columns).alias("row__"), keys["source"].alias("source"), keys["h"].alias("h"))
    copies = F.col("passes") + (F.col("h") < F.col("below")).cast("long")
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return (
        _by_source(wide, lines)
        .withColumn("copies", copies)
        .filter("copies > 0")
        .select("row__", again.alias("again__"))
        .select("row__.*")
        .toDF(*names)
    )
