"""Connected components: small parts of the edges are joined in a task each, then large and small stars alternate over what is left.

The star rounds use joins that Spark can split when one node is hot. A table of at most LOCAL edges is one such part and needs
no shuffle and no round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut

#: Edges that one task joins in its memory.
LOCAL = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def _joined_in_tasks(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges (a, b) from every node but the smallest to the smallest node of its component, within what each task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):  # noqa: ANN001, ANN202
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        found = [(x, root(x)) for x in parent if root(x) != x]
        for at in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found[at : at + 10_000]], kind) for i in (0, 1)], names=["a", "b"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(tasks).mapInArrow(run, f"a {kind}, b {kind}")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable. Nodes may have any ordered type.

    Beyond LOCAL edges, a round replaces each edge by links to the smallest neighbour, first among larger nodes, then among
    smaller ones. Rounds end when the edges stand still: a star around each component's smallest node. The driver sees three
    sums a round.
    """
    now = cut(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    tasks = max(1, -(-now.count() // LOCAL))
    now = cut(_joined_in_tasks(now, tasks))
    state = _state(now) if tasks > 1 else (0,)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(least, "a")
        now = cut(
            kept.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        )
        new = _state(now)
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
