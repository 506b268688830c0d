from collections import defaultdict

import pytest

from brindle.llm import mixing
from brindle.llm.queries import OP10_SQL, op10_source_mixing


def test_query_equals_sql(spark, llm_dir, same_rows):
    same_rows(op10_source_mixing(spark, llm_dir), OP10_SQL)


def test_odd_rows(spark):
    rows = [(1, "a b c", None, 1), (2, None, "s", 2), (3, "", "s", 3), (4, " \t\n", "é", 4), (5, "w " * 5000, "s", 5), (None, "x y", "z", 6), (None, "x y", "z", 7)]
    rows += [(6, "one two", "s", 8)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r["size"]
        by[r.source].append(r)
    assert {r.taken for r in by["é"]} == {0}
    assert sum(r.source_size for r in {s: v[0] for s, v in by.items()}.values()) == sum(r["size"] for r in got)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_targets_stop_at_caps_and_add_up(spark):
    sizes = {"a": 10, "b": 1000, "c": 400, "d": 1, "e": 700, None: 300}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(frame, (5, 2, 1), 1.5, 2).collect()}
    weights = dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1]))
    want, left, open_ = {}, 1.5 * sum(sizes.values()), dict(weights)
    while True:
        level = left / sum(open_.values())
        over = [s for s in open_ if open_[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            del open_[s]
    want |= {s: w * level for s, w in open_.items()}
    assert got == pytest.approx(want)


def test_mix_repeats_and_drops_rows(spark, llm_dir):
    docs = spark.read.parquet(f"{llm_dir}/documents.parquet")
    taken = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect()}
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    got = defaultdict(int)
    for r in mixed.select("doc_id").collect():
        got[r.doc_id] += 1
    assert got == {k: n for k, n in taken.items() if n}


def test_taken_words_are_near_their_targets(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 7 as int)) text", "concat('s', id % 3 * id % 2) source")
    got = mixing.mix_sources(docs).groupBy("source", "target").sum("taken").collect()
    assert got
    for r in got:
        assert abs(r["sum(taken)"] - r.target) <= 4


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(docs).count() == 0 and mixing.apply_mix(docs).count() == 0
