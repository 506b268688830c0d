"""Approximate nearest neighbours by learned partitions.

1. Equal vectors form a class with its smallest ids, so copies cost nothing further. SAMPLE classes at most, by a hash of their
   key, train the index in one task: nine tenths of them give a graph of nearest neighbours, which recursive bisection cuts
   into parts of equal size (a spectral start, then swaps of nodes that lessen the cut), and a small network learns how a
   vector's neighbours are spread over the parts. The last tenth are queries whose exact neighbours in the sample tell how many
   of the most probable parts must be searched to find the asked share of them.
2. Every class is indexed, in the part that the network gives most to. Parts follow the number of rows (ROWS_A_PART each, MOST
   at most), and a part's classes are cut into blocks of bounded size.
3. A query, once for each class, goes to its most probable parts and there to each block. A task holds one block as a matrix and
   streams the queries against it; what may be among the best is measured again on the original vectors, one component after
   the other, so that equal vectors get equal cosines wherever they meet.
4. A query's best of all blocks are merged by cosine and id; its own id goes.

Edge cases: a vector that is null, empty, zero, or holds null or non-finite components takes no part, nor does a row without an
id; vectors meet those of their own length only, and lengths other than the most frequent one are searched whole; rows of one
id are that id's own, so they are no candidates of each other; a query without a candidate has no row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import bounded_batches, cut, looked_up

#: Classes that train an index at most; rows a part, parts at least and at most; neighbours in the graph; numbers in a block.
SAMPLE, ROWS_A_PART, FEWEST, MOST, GRAPH, BLOCK_VALUES = 8192, 2048, 8, 256, 10, 1 << 21
HIDDEN, EPOCHS, BATCH, RATE = 128, 30, 256, 2e-3
#: Results of two vectors in matrix products differ by less.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by powers of two before, so that no square overflows."""
    v = scaled(vectors)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component under 1; cosines do not change."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, one component after the other, so that a pair's value depends on the pair alone."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, own: bool = False) -> np.ndarray:
    """Places of the k rows of largest dot product with each query; own leaves out the row of the query's number."""
    out = np.empty((len(queries), k), np.int64)
    for at in range(0, len(queries), 1024):
        near = queries[at : at + 1024] @ rows.T
        if own:
            near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
        out[at : at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def bisected(edges: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Two halves of n nodes, as booleans, with few of the edges (pairs of nodes) between them."""
    a, b = np.concatenate([edges, edges[:, ::-1]]).T
    degree = np.bincount(a, minlength=n) + 1.0
    x = np.random.default_rng(n).standard_normal(n)
    for _ in range(60):
        x = (np.bincount(a, x[b], n) + x) / degree
        x -= (x * degree).sum() / degree.sum()
        x /= np.abs(x).max() or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    cut_edges = lambda s: int((s[edges[:, 0]] != s[edges[:, 1]]).sum())
    now, share = cut_edges(side), 2
    for _ in range(rounds):
        across = np.bincount(a, side[a] != side[b], n)
        gain = 2 * across - (degree - 1)
        one, two = (np.flatnonzero(s)[np.argsort(-gain[s], kind="stable")] for s in (~side, side))
        m = min(len(one), len(two))
        good = int((gain[one[:m]] + gain[two[:m]] > 0).sum()) // share
        if not good:
            break
        trial = side.copy()
        trial[one[:good]], trial[two[:good]] = True, False
        then = cut_edges(trial)
        if then < now:
            side, now = trial, then
        else:
            share *= 2
    return side


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """A part of each node of a neighbour graph (rows of neighbours), of equal size but for one node a halving; parts is a power of two."""
    n = len(graph)
    edges = np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.reshape(-1)], axis=1)
    part = np.zeros(n, np.int64)
    while parts > 1:
        new, place = np.empty(n, np.int64), np.empty(n, np.int64)
        inside = edges[part[edges[:, 0]] == part[edges[:, 1]]]
        owner = part[inside[:, 0]]
        for p in np.unique(part):
            nodes = np.flatnonzero(part == p)
            place[nodes] = np.arange(len(nodes))
            new[nodes] = 2 * p + bisected(place[inside[owner == p]], len(nodes))
        part, parts = new, parts // 2
    return part


class Router:
    """A network of one hidden layer from vectors to parts, and how many parts a query searches."""

    def __init__(self, size: int, parts: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.probes = parts
        self.params = [rng.standard_normal((size, HIDDEN)) * np.sqrt(2 / size), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]

    def likely(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the parts for unit vectors, and the hidden values."""
        w, b, v, c = self.params
        h = np.maximum(x * np.sqrt(x.shape[1]) @ w + b, 0)
        z = h @ v + c
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), h

    def gradients(self, x: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy between target and the probabilities."""
        p, h = self.likely(x)
        dz = (p - target) / len(x)
        dh = (dz @ self.params[2].T) * (h > 0)
        return [np.sqrt(x.shape[1]) * x.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)]

    def learn(self, x: np.ndarray, target: np.ndarray) -> None:
        """Adam over shuffled minibatches."""
        rng = np.random.default_rng(11)
        mean, square = ([np.zeros_like(p) for p in self.params] for _ in "ab")
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                chosen = order[at : at + BATCH]
                step += 1
                for p, g, m, s in zip(self.params, self.gradients(x[chosen], target[chosen]), mean, square, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    def ranked_parts(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.likely(x)[0], axis=1, kind="stable")


def train(vectors: np.ndarray, parts: int, recall: float, k: int) -> Router:
    """A router over so many parts (fewer for a small sample), whose probes find the share ``recall`` of the k nearest of held-out queries."""
    x = unit(vectors)
    held = len(x) // 10
    queries, x = x[:held], x[held:]
    while parts > 1 and len(x) < 16 * parts:
        parts //= 2
    router = Router(x.shape[1], parts)
    if parts == 1:
        return router
    graph = nearest(x, x, GRAPH, own=True)
    part = balanced_parts(graph, parts)
    spread = np.zeros((len(x), parts))
    np.add.at(spread, (np.repeat(np.arange(len(x)), GRAPH), part[graph].reshape(-1)), 1 / (GRAPH + 1))
    spread[np.arange(len(x)), part] += 1 / (GRAPH + 1)
    router.learn(x, spread)
    if len(queries):
        placed = router.ranked_parts(x)[:, 0]
        order = np.argsort(router.ranked_parts(queries), axis=1)  # the rank of each part
        needed = np.sort(np.take_along_axis(order, placed[nearest(queries, x, k)], axis=1).reshape(-1))
        router.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return router


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def keyed(rows: DataFrame) -> DataFrame:
    """rows (id, vector) with a digest of the vector as key, and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [hashlib.blake2b(v.values.to_numpy().tobytes(), digest_size=16).digest() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["id", "vector", "key"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>, key binary").withColumn("size", F.size("vector"))


def fit(classes: DataFrame, size: int, parts: int, recall: float, k: int) -> Router:
    """A router for vectors of one size, from SAMPLE of the classes (key, vector, size) at most; trained in one task."""
    sample = classes.filter(F.col("size") == size).orderBy(F.xxhash64("key"), "key").select("key", "vector").limit(SAMPLE)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        vectors = np.array([v for _, v in rows])[np.random.default_rng(5).permutation(len(rows))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(vectors, parts, recall, k))], pa.binary())], names=["router"])

    return pickle.loads(bytes(sample.repartition(1).mapInArrow(learn, "router binary").first()[0]))


def routed(rows: DataFrame, size: int, router: Router, all_probes: bool) -> DataFrame:
    """rows with the array parts: the most probable one, or all that a query searches; of the one size's vectors, part 0 for others."""
    shared = rows.sparkSession.sparkContext.broadcast(router)  # size * HIDDEN + HIDDEN * parts numbers
    names = rows.columns
    at = names.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        most = own.probes if all_probes else 1
        for batch in batches:
            found = np.zeros((batch.num_rows, most), np.int64)
            fits = np.diff(batch.column(at).offsets.to_numpy()) == size
            if fits.any():
                found[fits] = own.ranked_parts(unit(_matrix(batch.column(at).filter(pa.array(fits)), size)))[:, :most]
            lists = pa.array([f.tolist() if ok else [0] for f, ok in zip(found, fits, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, "parts"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, parts array<long>")


def _best(queries: np.ndarray, rows: np.ndarray, first: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query, row, cosine) of the k best rows of each query, ties by the smaller first id; a few more may come along."""
    a, b = scaled(queries), scaled(rows)
    near = (a / np.sqrt((a * a).sum(axis=1))[:, None]) @ (b / np.sqrt((b * b).sum(axis=1))[:, None]).T
    least = np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(queries), -np.inf)
    x, y = np.nonzero(near >= (least - SLACK)[:, None])
    for at in range(0, len(x), 1 << 14):
        i, j = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
        u, v = a[i], b[j]
        near[i, j] = ordered_dot(u, v) / (np.sqrt(ordered_dot(u, u)) * np.sqrt(ordered_dot(v, v)))
    score = near[x, y]
    order = np.lexsort((first[y], -score, x))
    x, y, score = x[order], y[order], score[order]
    place = np.arange(len(x)) - np.searchsorted(x, x)
    for i in np.flatnonzero(place < k).tolist():
        yield int(x[i]), int(y[i]), float(score[i])


def nearest_rows(rows: DataFrame, is_query: Column, k: int = 5, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id and score of the k nearest rows found for each query among all rows but its own.

    is_query is a condition on rows; recall is the share of nearest rows that the probes find for held-out rows of the sample.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    narrow = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    usable = narrow.filter(_usable(F.col("vector")) & F.col("id").isNotNull())
    every = cut(keyed(usable.select("id", "vector")).select("id", "key"))
    kind = every.schema["id"].dataType.simpleString()
    few = every.distinct().withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("place") <= k + 1)
    ids = few.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 at most
    vectors = keyed(usable.select("id", "vector")).groupBy("key").agg(F.first("vector").alias("vector"), F.first("size").alias("size"))
    classes = cut(vectors.join(ids, "key"))
    sizes = classes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    wanted = max(FEWEST, min(MOST, sizes["n"] // ROWS_A_PART))
    router = fit(classes, sizes["size"], 1 << (wanted.bit_length() - 1), recall, k)

    placed = cut(routed(classes, sizes["size"], router, False).withColumn("part", F.col("parts")[0]).drop("parts"))
    cells = placed.groupBy("size", "part").agg(F.greatest(F.ceil(F.count(F.lit(1)) * F.col("size") / BLOCK_VALUES), F.lit(1)).cast("int").alias("blocks"))
    indexed = placed.join(cells, ["size", "part"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    asked = narrow.filter("asks").select("id").distinct()
    asking = cut(every.join(asked, "id", "left_semi"))
    counts = cut(asking.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    queries = routed(classes.join(counts, "key", "left_semi").select("key", "vector", "size"), sizes["size"], router, True)
    sent = queries.withColumn("part", F.explode("parts")).join(cells, ["size", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["size", "part", "block"]
    columns = [*cell, "asks", "key", "vector", "ids"]
    both = indexed.withColumn("asks", F.lit(False)).select(*columns).unionByName(sent.withColumn("asks", F.lit(True)).withColumn("ids", F.lit(None).cast(f"array<{kind}>")).select(*columns))
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = both.repartition(spread, *cell).sortWithinPartitions(*cell, "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, matrix, id_lists = None, [], []
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            at = 0
            while at < len(names):
                stop = at
                while stop < len(names) and names[stop] == names[at]:
                    stop += 1
                part = batch.slice(at, stop - at)
                size, *_, asks = names[at]
                if own != names[at][:3]:
                    own, matrix, id_lists = names[at][:3], [], []
                if not asks:
                    matrix.append(_matrix(part.column("vector"), size))
                    id_lists += part.column("ids").to_pylist()
                elif matrix:
                    matrix = [np.concatenate(matrix)] if len(matrix) > 1 else matrix
                    first = np.array([i[0] for i in id_lists])
                    keys, asked_rows = part.column("key").to_pylist(), _matrix(part.column("vector"), size)
                    for s in range(0, len(keys), 256):
                        found = [(keys[s + q], score, i) for q, r, score in _best(asked_rows[s : s + 256], matrix[0], first, k + 1) for i in id_lists[r]]
                        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate((pa.binary(), pa.float64(), part.schema.field("ids").type.value_type))], names=["key", "score", "id"])
                at = stop

    best = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    found = dealt.mapInArrow(run, f"key binary, score double, id {kind}").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    lists = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("found"))  # k + 1 at most
    lines = cut(lists.join(counts, "key"))
    answered = looked_up(asking.withColumnRenamed("id", "query_id"), lines, "key")
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    ranked = answered.select("query_id", F.posexplode(others).alias("rank", "near"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("near.id").alias(id_col), F.col("near.score").alias("score"))
