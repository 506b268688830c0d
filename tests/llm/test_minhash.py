import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import graph, minhash


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_force(rows):
    """component and set size of each id, by all pairs that share a shingle."""
    sets = {i: plain_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    seen = set()
    for group in by.values():
        for k, a in enumerate(group):
            for b in group[:k]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = brute_force(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_documents_against_brute_force(spark, llm_dir):
    from brindle.llm.queries import op8_minhash

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{llm_dir}/documents.parquet").collect()]
    want = brute_force(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op8_minhash(spark, llm_dir).collect()} == want


def test_chains_groups_and_short_texts(spark):
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words[k : k + 60]) for k in range(0, 200, 4)]  # neighbours are alike, ends are not
    texts = [None, "", " \n\t", "one", "ONE", "one two", "a b c d", "a b c d e", "A b\tC d  e", "a b c d é", "a b c d É", "x " * 50, "x " * 9]
    check(spark, list(enumerate(texts + chain + [" ".join(words) * 40])))


@pytest.mark.parametrize("n", range(10))
def test_batches_of_few_words(spark, n):
    """n words in all, in one text, spread over texts, or with empty ones around."""
    words = [f"w{k}" for k in range(n)]
    for texts in ([" ".join(words)], [*words] or [""], [" ".join(words[:2]), None, " ".join(words[2:]), ""]):
        assert [len(s) for _, s in minhash.shingle_sets(texts)] == [len(plain_set(t)) for t in texts]
    check(spark, [(0, " ".join(words))])
    check(spark, [(0, " ".join(words)), (1, " ".join(words).upper())])
    if n:
        rows = [(False, bytes([k]), bytes([k]), [k] * 16, " ".join(words)) for k in range(2)]
        assert minhash._cell_links(rows, 75, -1.0) == [(b"\x01", b"\x00")]


def test_words_that_collide_in_rolling_hashes(spark):
    """Words of 1,024 letters whose polynomials are equal modulo 2**64 for any base."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    two = "".join("ba"[bin(k).count("1") % 2] for k in range(1024))
    check(spark, [(0, f"a b c d {one} e f g h {two} i j"), (1, f"{one} q r s t"), (2, f"{two} q r s t")])


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(80)]
    texts = []
    for k in range(150):
        own = list(base)
        for j in rng.choice(80, int(rng.integers(1, 4)), replace=False):
            own[j] = f"v{k}"
        texts.append(" ".join(own))
    check(spark, list(enumerate(texts)))


def test_groups_of_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LARGE", 4)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "HEAD_ROUNDS", 1)
    rng = np.random.default_rng(8)
    base = [f"t{i}" for i in range(90)]
    texts = []
    for k in range(120):
        own = list(base)
        for j in rng.choice(90, int(rng.integers(1, 9)), replace=False):
            own[j] = f"v{rng.integers(40)}"
        texts.append(" ".join(own))
    check(spark, list(enumerate(texts)))


def test_repeated_rows_null_ids_and_other_columns(spark):
    rows = [(1, "a b c d e f", 7, 1), (1, "a b c d e f", 7, 1), (None, "a b c d e f", 7, 1), (None, None, 7, 1), (3, "q", 7, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, kept_id long")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [("1", 2, 1, True)] * 2 + [("3", 1, 3, True), ("None", 0, None, True), ("None", 2, 1, False)]
    assert sorted(str(r.doc_id) for r in minhash.keep_one(docs).collect()) == ["1", "3", "None", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0


def test_estimate_is_near_the_similarity(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for j in (0.1, 0.5, 0.75, 0.9):
        common = rng.integers(0, 1 << 63, int(2000 * j / (1 + j)), dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 1000 - len(common), dtype=np.uint64)]) for _ in "ab")
        bits = minhash.packed_bits(np.array([minhash.minima(a), minhash.minima(b)]))
        pairs.append((j, bits[0].tolist(), bits[1].tolist()))
    got = spark.createDataFrame(pairs, "j double, a array<long>, b array<long>").select("j", minhash.estimate(F.col("a"), F.col("b")).alias("e")).collect()
    for r in got:
        assert r.e == pytest.approx(r.j, abs=0.2)


def test_equal_word_sequences_have_one_key():
    keys = [k for k, _ in minhash.shingle_sets(["A b\tc d E  f", "a B c\x0bd e f\n", "a b c d e f\xa0", "a b c d e F\x1c", "ab c d e f", ""])]
    assert keys[0] == keys[1] and len(set(keys)) == 5 and keys[5] == b""


def test_lookup_splits_hot_keys_from_the_others(spark):
    from brindle.llm.common import looked_up

    rows = [(i, i % 3 if i < 3000 else i) for i in range(6000)] + [(6000, None), (6001, 99_999)]
    frame = spark.createDataFrame(rows, "id long, k long")
    lines = frame.filter("k < 9000").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = looked_up(frame, lines, "k")
    assert sorted(got.columns) == ["id", "k", "least"]
    assert sorted((r.id, r.least) for r in got.collect()) == [(i, i % 3 if i < 3000 else i) for i in range(6000)]
    assert looked_up(frame, lines.limit(0), "k").count() == 0


@pytest.mark.parametrize("local", [7, 200_000])
def test_components_of_a_long_path(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL", local)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in graph.connected(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert graph.connected(edges.limit(0)).count() == 0
