import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import neighbours
from brindle.llm.queries import op12_neighbours

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, k=5):
    """The k nearest rows of every query whose id is divisible by 50, by all cosines; (query, rank) to (id, score)."""
    usable = [(i, np.array(v, float) / max(map(abs, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in usable:
        if q % 50 == 0:
            near = {(-float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), i) for i, b in usable if i != q and len(b) == len(a)}
            out |= {(q, r): (i, -s) for r, (s, i) in enumerate(sorted((round(s, 12), i) for s, i in near)[:k], 1)}
    return out


def answers(df):
    return {(r.query_id, r.rank): (r.vec_id, r.score) for r in df.collect()}


def recall(got, want):
    sets = lambda d: {(q, v[0]) for (q, _), v in d.items()}
    return len(sets(got) & sets(want)) / len(sets(want))


def test_vectors_of_the_table(spark, llm_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{llm_dir}/embeddings.parquet").collect()]
    got, want = answers(op12_neighbours(spark, llm_dir)), plain(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    exact = {i: np.array(v, float) for i, v in rows}
    for (q, _), (i, s) in got.items():
        assert s == pytest.approx(float(exact[q] @ exact[i] / np.sqrt(exact[q] @ exact[q]) / np.sqrt(exact[i] @ exact[i])), abs=1e-12)


def test_clustered_vectors_need_few_parts(spark, monkeypatch):
    """Parts and blocks as in a large table; most parts are not searched."""
    monkeypatch.setattr(neighbours, "ROWS_A_PART", 128)
    monkeypatch.setattr(neighbours, "BLOCK_VALUES", 16 * 150)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16))
    x = centres[rng.integers(0, 60, 3000)] + 0.2 * rng.standard_normal((3000, 16))
    router = neighbours.train(x, 16, 0.95, 5)
    assert router.probes <= 6
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = answers(neighbours.nearest_rows(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), F.col("vec_id") % 50 == 0)), plain(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_copies_ties_and_odd_rows(spark):
    """Copies of one vector beyond k, scaled copies, other lengths, vectors that take no part, huge and tiny ones."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(45, 60)] + [(i, [2.0, 4.0, 6.0]) for i in range(60, 63)]
    rows += [(100, [1.0, 0.0, 0.0]), (101, [1e200, 1e190, 0.0]), (102, [1e-200, 0.0, 0.0]), (103, [0.0, 1.0, 0.0])]
    rows += [(150, [1.0, 1.0]), (151, [1.0, 0.9]), (200, [5.0]), (250, None), (251, []), (300, [0.0, 0.0, 0.0]), (350, [1.0, float("nan"), 0.0]), (400, [1.0, None, 2.0]), (401, [float("inf"), 0.0, 1.0]), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA).withColumn("score", F.lit("x")).withColumn("key", F.lit(1))
    got = answers(neighbours.nearest_rows(df, F.col("vec_id") % 50 == 0))
    want = plain(rows)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert [got[50, r][0] for r in range(1, 6)] == [45, 46, 47, 48, 49] and got[50, 1][1] == got[50, 5][1]
    assert (150, 2) not in got and (200, 1) not in got


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (1, [1.0, 0.1], 1)], SCHEMA)
    assert {k: v[0] for k, v in answers(neighbours.nearest_rows(df, F.col("vec_id") % 50 == 0)).items()} == {(0, 1): 1}
    for empty in (df.limit(0), spark.createDataFrame([(0, None, 1)], SCHEMA)):
        assert neighbours.nearest_rows(empty, F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.nearest_rows(df, F.lit(False)).count() == 0


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(2)
    x = neighbours.unit(np.repeat(rng.standard_normal((8, 12)), 40, axis=0) + 0.1 * rng.standard_normal((320, 12)))
    graph = neighbours.nearest(x, x, 6, own=True)
    part = neighbours.balanced_parts(graph, 8)
    assert np.bincount(part).tolist() == [40] * 8
    assert (part[:, None] == part[graph]).mean() > 0.95


def test_gradients_against_differences():
    rng = np.random.default_rng(9)
    router = neighbours.Router(6, 4)
    x, target = neighbours.unit(rng.standard_normal((5, 6))), rng.dirichlet(np.ones(4), 5)
    loss = lambda: float(-(target * np.log(router.likely(x)[0])).sum(axis=1).mean())
    for p, g in zip(router.params, router.gradients(x, target), strict=True):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(5)]:
            was, e = p[at], 1e-6
            p[at] = was + e
            up = loss()
            p[at] = was - e
            down = loss()
            p[at] = was
            assert g[at] == pytest.approx((up - down) / (2 * e), abs=1e-6)
