"""Periodic runs of words by Baier grouping.

1. The words of a text become numbers, by first occurrence. Phase one of Baier's suffix sorter groups the suffixes: at first by
   their first word; then, from the highest group down, every suffix of a group points to the nearest suffix on its left that
   is in a lower group, and those pointed to are split from their groups by how often they were, their context extended to
   the end of what points to them. In the end the context of a suffix is the longest Lyndon word that begins there, so the
   contexts' lengths are the Lyndon array. The same with the order of words reversed gives the other array.
2. By the runs theorem, every run has a root in one of the two arrays: a Lyndon word as long as the run's period. A root is
   extended to the left and to the right by the longest common extension of its two ends. Extensions are found through names
   of all stretches of 1, 2, 4 ... words, equal names for equal stretches, so they are exact; roots whose first words do not
   repeat as often as is asked for are left out before that.
3. Equal runs from several roots become one. Of every run all words after its first period are dropped from the text.

A text is worked on whole, in memory that is linear in its words (about 400 bytes each, and four bytes each for every power of
two of names where a root repeats).

Edge cases: a null, empty or blank text has no word, no run and an empty collapsed text; a text without a run keeps its words,
joined by one space; rows are worked on one by one, so repeated rows and repeated or null ids each give their own result; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import WORD, bounded_batches

_words = re.compile(WORD).findall
RUN = "struct<start: long, length: long, period: long>"


def lyndon_array(ranks: Sequence[int]) -> list[int]:
    """The length of the longest Lyndon word that begins at each place, by grouping suffixes. ranks are 0, 1 ... without gaps."""
    n = len(ranks)
    if not n:
        return []
    members: list = [[] for _ in range(max(ranks) + 1)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    group = list(ranks)  # of each suffix
    size = list(map(len, members))
    below = list(range(-1, len(members) - 1))  # the next lower group of each
    above = [*range(1, len(members)), n * n + n]  # the highest has none: a number that no group gets
    length, left, done = [1] * n, [-1] * n, bytearray(n)

    def split(old: int, found: list[int]) -> None:
        """Moves the suffixes found from their group to a new one just above it."""
        new, up = len(members), above[old]
        members.append(found)
        size[old] -= len(found)
        size.append(len(found))
        for j in found:
            group[j] = new
        below.append(old)
        above.append(up)
        above[old] = new
        if up < new:
            below[up] = new

    now = len(members) - 1
    while now >= 0:
        own = members[now]
        members[now] = ()
        if size[now] == 1:
            i = own[0] if len(own) == 1 else next(i for i in own if group[i] == now)
            j = i - 1
            while j >= 0 and done[j]:
                j = left[j]
            left[i] = j
            done[i] = 1
            if j >= 0:
                length[j] = i + length[i] - j
                if size[group[j]] > 1:
                    split(group[j], [j])
        else:
            if len(own) > size[now]:
                own = [i for i in own if group[i] == now]
            own.sort()
            pointed: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and done[j]:
                    j = left[j]
                left[i] = j
                done[i] = 1
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
                    length[j] = i + length[i] - j
            by: dict[tuple[int, int], list[int]] = {}
            for j, times in pointed.items():
                by.setdefault((-times, group[j]), []).append(j)
            for _, old in sorted(by) if len(by) > 1 else by:
                found = by[_, old]
                if len(found) < size[old]:  # else the whole group is extended
                    split(old, found)
        now = below[now]
    return length


def stretch_names(words: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4 ... words that begin at each place, up to half of all; equal stretches have equal names."""
    levels, span = [words.astype(np.int32)], 1
    while 2 * span <= len(words):
        last = levels[-1].astype(np.int64)
        levels.append(np.unique(last[:-span] * (int(last.max()) + 1) + last[span:], return_inverse=True)[1].astype(np.int32))
        span *= 2
    return levels


def extensions(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from the places i and j on (forward) or just before them (otherwise) are equal; i < j."""
    i, j, n = i.copy(), j.copy(), len(levels[0])
    start = j.copy()
    for k in range(len(levels) - 1, -1, -1):
        span, names = 1 << k, levels[k]
        a, b = (i, j) if forward else (i - span, j - span)
        inside = (b + span <= n) if forward else (a >= 0)
        hit = np.zeros(len(i), bool)
        hit[inside] = names[a[inside]] == names[b[inside]]
        step = np.where(hit, span if forward else -span, 0)
        i, j = i + step, j + step
    return np.abs(j - start)


def find_runs(words: list[str], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words and ``times`` periods (two or more), by start and period."""
    n = len(words)
    if n < least:
        return []
    known: dict[str, int] = {}
    ranks = [known.setdefault(w, len(known)) for w in words]
    x = np.array(ranks, np.int64)
    top = len(known) - 1
    roots = []
    for order in (ranks, [top - r for r in ranks]):
        period = np.array(lyndon_array(order), np.int64)
        i = np.arange(n)
        far = (times - 2) * period
        i = i[far + period + i < n]
        for more in (np.zeros_like(period), far):  # the first root of a run extends beyond (times - 2) periods
            i = i[x[i + more[i]] == x[i + more[i] + period[i]]]
        roots.append(np.stack([i, period[i]], axis=1))
    found = np.unique(np.concatenate(roots), axis=0)
    if not len(found):
        return []
    i, p = found[:, 0], found[:, 1]
    levels = stretch_names(x)
    right = extensions(levels, i, i + p, True)
    left = extensions(levels, i, i + p, False)
    start, length = i - left, left + p + right
    kept = (length >= least) & (length >= times * p)
    return list(map(tuple, np.unique(np.stack([start, p, length], axis=1)[kept], axis=0)[:, [0, 2, 1]].tolist()))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """words without those after the first period of any run."""
    if not runs:
        return " ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return " ".join([words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """id, n_words, runs (start, length, period; by start, then period) and collapsed (the text without repeats) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch.column(1).to_pylist():
                words = _words(text) if text else []
                own = find_runs(words, least, times)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                texts.append(collapsed(words, own))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, n_words long, runs array<{RUN}>, collapsed string").withColumnRenamed("id", id_col)


def greatest_run(runs: Column) -> Column:
    """The run of the greatest length by period, compared exactly; the first by start and period among equals. Null without a run."""
    better = lambda a, b: a["length"] * b["period"] < b["length"] * a["period"]
    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | better(best, r), r).otherwise(best))


def planted(text: Column, row_id: Column) -> Column:
    """text with a stretch repeated to its end, in the rows that the checksum of their id picks; others as they are.

    With h the CRC-32 of the id as text and g = floor(h / 10): if h % 10 = 0 and there are n > 0 words, word i >= a becomes
    word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(row_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  value is computed once

    def build(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        return let(F.struct(a.alias("a"), (F.lit(1) + F.floor((n - a) / (3 + g % 8))).alias("p")), lambda v: F.concat(
            F.slice(w, F.lit(1), v["a"].cast("int")),
            F.transform(F.sequence(v["a"], n - 1), lambda i: F.element_at(w, (v["a"] + (i - v["a"]) % v["p"] + 1).cast("int"))),
        ))

    made = let(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.when(F.size(w) > 0, F.array_join(build(w), " ")).otherwise(text))
    return F.when((h % 10 == 0) & text.isNotNull(), made).otherwise(text)
