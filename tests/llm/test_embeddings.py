import numpy as np
import pytest

from brindle.llm import embeddings
from brindle.llm.queries import OP3_SQL, op3_embeddings


def test_query_equals_sql(spark, llm_dir, same_rows):
    same_rows(op3_embeddings(spark, llm_dir), OP3_SQL)


def brute_force(rows, least=0.98):
    ids, n = [r[0] for r in rows], len(rows)
    links = {i: set() for i in range(n)}
    usable = [i for i, r in enumerate(rows) if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    for k, i in enumerate(usable):
        for j in usable[:k]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        named = [ids[j] for j in seen if ids[j] is not None]
        out.append((ids[i], len(links[i]), min(named, default=None), ids[i] == min(named, default=None)))
    return sorted(out, key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, b"x") for r in rows], "vec_id long, embedding array<float>, label int, key binary")
    return sorted((tuple(r) for r in embeddings.near_vectors(frame).collect()), key=str)


def cloud(rng, centre, n, spread):
    return [(centre + spread * rng.standard_normal(len(centre))).astype(np.float32).tolist() for _ in range(n)]


@pytest.mark.parametrize("block", [512, 16])
def test_clouds_copies_and_labels(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(4):
        vectors += cloud(rng, rng.standard_normal(64), 25, 0.14)
    vectors += cloud(rng, rng.standard_normal(24), 10, 0.1) + [vectors[0]] * 5 + cloud(rng, np.zeros(64), 30, 1.0)
    rows = [(i, v, i % 2) for i, v in enumerate(vectors)]
    assert run(spark, rows) == brute_force(rows)


def test_unusable_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, [2.0, 4.0, 6.0], 0), (3, None, 0), (4, [], 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 3.0], 0), (7, [1.0, float("nan"), 3.0], 0)]
    rows += [(8, [float("inf"), 1.0, 1.0], 0), (9, v, None), (10, v, 1), (None, v, 0), (11, [5.0], 0), (12, [7.0], 0), (13, [-7.0], 0), (1, v, 0), (14, [1e38, 2e38, 3e38], 0)]
    got = run(spark, rows)
    assert got == brute_force(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("hashes", embeddings.SETTINGS)
def test_pairs_at_the_threshold_share_a_bucket(hashes):
    rng = np.random.default_rng(9)
    a = rng.standard_normal((20_000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o = rng.standard_normal(a.shape)
    o -= (o * a).sum(axis=1)[:, None] * a
    o /= np.linalg.norm(o, axis=1)[:, None]
    near = [embeddings.buckets(x, hashes) for x in (a, 0.98 * a + np.sqrt(1 - 0.98**2) * o)]
    assert all(len(np.unique(row)) == len(row) for row in near[0][:500])
    assert all((near[0][k : k + 2000, :, None] == near[1][k : k + 2000, None, :]).any(axis=(1, 2)).all() for k in range(0, 20_000, 2000))


@pytest.mark.parametrize("most", [{2: 5, 3: 1000}, {2: 5, 3: 6}])
def test_longer_names_find_the_same_links(spark, monkeypatch, most):
    monkeypatch.setattr(embeddings, "LABEL_ROWS", most)
    rng = np.random.default_rng(5)
    vectors = [v for _ in range(4) for v in cloud(rng, rng.standard_normal(64), 20, 0.14)]
    rows = [(i, v, i % 2) for i, v in enumerate(vectors + vectors[:3])]
    assert embeddings.hashes_for(42) == (3 if most[3] == 1000 else 4)
    assert run(spark, rows) == brute_force(rows)
