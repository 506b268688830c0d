"""Near-duplicate vectors by cross-polytope hashing.

Vectors with one label and equal components form a class. A class is rotated by three rounds of random signs and the fast
Hadamard transform; the axis of its largest coordinate, with its sign, is a hash, and the hashes of two rotations name a
bucket of a table; three in labels of over 40,000 rows and four in those of over two million, so that the chance company in a
bucket stays small as the rows grow. In each table a class enters its own bucket and those that it would have fallen into next
(multiprobe). Longer names get more tables and probes: two vectors of 64 components at a cosine of 0.98 share no bucket with
probability 1e-8 at each setting. Pairs within a bucket are verified in double precision. A pair that shares several buckets counts in the smallest of them, so links are counted without being
collected; a bucket of many classes is cut into blocks, and block pairs go to different groups. What leaves a group is a link
count for each class and a spanning forest, never the pairs.

Edge cases: a vector that is null, empty, zero, or holds null or non-finite components, or whose label is null, links with
nothing and is its own component; vectors of different lengths never link; equal vectors with one label link with each
other; rows may repeat, and a null id takes part without becoming the smallest; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, cut, looked_up
from brindle.llm.graph import connected

ROUNDS = 3
#: Hashes in a bucket's name: tables, and buckets that a class enters in each of them.
SETTINGS = {2: (6, 3), 3: (8, 4), 4: (8, 6)}
#: Rows of the largest label up to which so many hashes are taken; four beyond the last.
LABEL_ROWS = {2: 40_000, 3: 2_000_000}
#: Classes of a bucket in one block; larger buckets are dealt over pairs of blocks.
BLOCK = 512
PAIRS_AT_ONCE = 1 << 18


@lru_cache(maxsize=8)
def _signs(size: int, hashes: int) -> np.ndarray:
    return np.random.default_rng(size).choice(np.array([-1.0, 1.0]), (SETTINGS[hashes][0], hashes, ROUNDS, size))


def hashes_for(rows: int) -> int:
    """How many hashes name a bucket when the largest label has so many rows."""
    return next((k for k, most in LABEL_ROWS.items() if rows <= most), max(SETTINGS))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    size, h = x.shape[1], 1
    x = x.copy()
    while h < size:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), size)
        h *= 2
    return x / np.sqrt(size)


def buckets(vectors: np.ndarray, hashes: int = 2) -> np.ndarray:
    """The different bucket numbers of each row over all tables, sorted; rows have one length and are not zero."""
    n, d = vectors.shape
    size = max(2, 1 << (d - 1).bit_length())
    tables, probes = SETTINGS[hashes]
    probes = min(probes, min(3, size) ** hashes)
    x = np.zeros((n, size))
    x[:, :d] = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    out = np.empty((n, tables, probes), np.int64)
    for t, table in enumerate(_signs(size, hashes)):
        code, loss = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for rounds in table:
            y = x
            for s in rounds:
                y = hadamard(y * s)
            strong = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :3]
            value = np.take_along_axis(y, strong, axis=1)
            own, size_of = strong * 2 + (value > 0), np.abs(value)
            code = (code[:, :, None] * (2 * size) + own[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + ((size_of[:, :1] - size_of) ** 2)[:, None, :]).reshape(n, -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :probes]  # what is not among the best now cannot be later
            code, loss = np.take_along_axis(code, best, axis=1), np.take_along_axis(loss, best, axis=1)
        out[:, t, :] = code * tables + t
    return np.sort(out.reshape(n, -1), axis=1)


def _usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def class_buckets(rows: DataFrame, hashes: int = 2) -> DataFrame:
    """rows (id, label string, vector array<double>) with the key of each one's class and its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, vectors = batch.column(1).to_pylist(), [np.array(v) for v in batch.column(2).to_pylist()]
            keys = [hashlib.blake2b(v.tobytes(), digest_size=16, salt=hashlib.blake2b(la.encode(), digest_size=16).digest()).digest() for la, v in zip(labels, vectors, strict=True)]
            found: list = [None] * len(vectors)
            for d in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == d]
                matrix = np.array([vectors[i] for i in at])
                matrix /= np.abs(matrix).max(axis=1)[:, None]
                for i, b in zip(at, buckets(matrix, hashes), strict=True):
                    found[i] = b.tolist()
            columns = [*batch.columns, pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "vector", "key", "buckets"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, label string, vector array<double>, key binary, buckets array<long>")


def _linked(left: np.ndarray, right: np.ndarray, unit: np.ndarray, near: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
    """Which pairs reach the cosine and have their smallest common bucket here."""
    keep = np.zeros(len(left), bool)
    for at in range(0, len(left), PAIRS_AT_ONCE // 8):
        s = slice(at, at + PAIRS_AT_ONCE // 8)
        hit = np.flatnonzero(np.einsum("ij,ij->i", unit[left[s]], unit[right[s]]) >= least) + at
        for k in range(0, len(hit), 4096):
            h = hit[k : k + 4096]
            common = (near[left[h]][:, :, None] == near[right[h]][:, None, :]).any(axis=2)
            keep[h] = near[left[h], common.argmax(axis=1)] == own[h]
    return keep


def _pairs(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = left * right
    group = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return first[group] + k // right[group], second[group] + k % right[group]


def _count_links(key: list[bytes], weight: np.ndarray, vectors: np.ndarray, near: np.ndarray, groups: list[tuple[int, int, int, bool]], own: np.ndarray, least: float) -> list[tuple]:
    """Counts and forest edges of rows start..stop; a group's second block begins at middle, or there is one block."""
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    counts, links = np.zeros(len(key), np.int64), []
    parent = list(range(len(key)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def take(left: np.ndarray, right: np.ndarray) -> None:
        keep = _linked(left, right, unit, near, own[left], least)
        x, y = left[keep], right[keep]
        np.add.at(counts, x, weight[y])
        np.add.at(counts, y, weight[x])
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                links.append((key[i], key[j], 0))

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    pending = 0
    for start, middle, stop, crossed in groups:
        if crossed:
            x, y = np.repeat(np.arange(start, middle), stop - middle), np.tile(np.arange(middle, stop), middle - start)
        else:
            x, y = np.triu_indices(stop - start, 1)
            x, y = x + start, y + start
        waiting.append((x, y))
        pending += len(x)
        if pending >= PAIRS_AT_ONCE:
            take(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))
            waiting, pending = [], 0
    if pending:
        take(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))
    return links + [(key[i], None, int(counts[i])) for i in np.flatnonzero(counts)]


def near_vectors(rows: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id (smallest id reachable by links) and kept (id = component_id) of every row."""
    bounded_batches(rows.sparkSession)
    narrow = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = _usable(F.col("vector"), F.col("label"))
    most = narrow.filter("label IS NOT NULL").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    hashed = class_buckets(narrow.filter(usable), hashes_for(most))
    members = cut(hashed.select("id", "key"))
    same = [F.first(c).alias(c) for c in ("label", "vector", "buckets")]
    classes = cut(hashed.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), *same).withColumn("size", F.size("vector")))
    keyed = classes.select("label", "size", F.explode("buckets").alias("bucket"), "key")
    sizes = keyed.groupBy("label", "size", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    shared = keyed.join(sizes, ["label", "size", "bucket"]).withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "size", "bucket", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).alias("second"), "key")
    full = dealt.join(classes.select("key", "weight", "buckets", "vector"), "key")
    group = ["label", "size", "bucket", "low", "high"]
    spread = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    full = full.select(*group, "second", "key", "weight", "buckets", "vector").repartition(spread, *group).sortWithinPartitions(*group, "second", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rest: list[tuple]) -> Iterator[pa.RecordBatch]:
            for _, same_size in groupby(rest, key=lambda r: r[1]):
                part = list(same_size)
                groups, start = [], 0
                for k in range(1, len(part) + 1):
                    if k == len(part) or part[k][:5] != part[start][:5]:
                        crossed = part[start][3] != part[start][4]
                        middle = next((m for m in range(start, k) if part[m][5]), k) if crossed else start
                        groups.append((start, middle, k, crossed))
                        start = k
                found = _count_links(
                    [r[6] for r in part], np.array([r[7] for r in part], np.int64), np.array([r[9] for r in part]), np.array([r[8] for r in part], np.int64),
                    groups, np.array([r[2] for r in part], np.int64), least,
                )
                if found:
                    a, b, n = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(held) >= 2048:
                at = len(held)
                while at and held[at - 1][:5] == held[-1][:5]:
                    at -= 1
                yield from flush(held[:at])
                held = held[at:]
        yield from flush(held)

    found = cut(full.mapInArrow(run, "a binary, b binary, n long"))
    parts = connected(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "key")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    known = classes.select("key", "id", "weight").join(counts, "key", "left").join(parts, "key", "left")
    known = cut(known.select("key", "id", "weight", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "key").alias("part")))
    least_id = cut(known.groupBy("part").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    lines = cut(looked_up(known, least_id, "part").select("key", "n_links", "component_id", "weight"))
    linked = looked_up(members, lines, "key", "weight").select("id", "n_links", "component_id")
    alone = narrow.filter(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    done = linked.unionByName(alone)
    return done.select(F.col("id").alias(id_col), "n_links", F.col("component_id"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
