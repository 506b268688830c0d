import zlib

import numpy as np
import pytest

from brindle.llm import toxicity


def test_windows_cover_every_word():
    for n in range(200):
        starts = toxicity.windows(n)
        covered = {i for s in starts for i in range(s, min(n, s + toxicity.SPAN))}
        assert covered == set(range(n)) and len(starts) >= 1
        assert all(b - a == toxicity.STEP for a, b in zip(starts, starts[1:], strict=False))


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    p = toxicity._start(3, rng)
    x = rng.standard_normal((5, 4, 3 * toxicity.HIDDEN)).astype(np.float32)
    y = rng.standard_normal((5, 4, 3 * toxicity.HIDDEN)).astype(np.float32)
    mask = (np.arange(5)[:, None] < np.array([5, 3, 1, 4])[None, :]).astype(np.float32)
    weigh = rng.standard_normal(4).astype(np.float32)
    tape = {}
    toxicity.forward(p, x, y, mask, tape)
    g, dx, dy = toxicity.backward(p, tape, weigh)
    value = lambda: float((toxicity.forward(p, x, y, mask) * weigh).sum())
    for array, grad in [(x, dx), (y, dy), *((p[k], g[k]) for k in ("uf", "ub", "wa", "ba", "va", "out", "bias"))]:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in array.shape)
            old = array[at]
            array[at] = old + 0.01
            up = value()
            array[at] = old - 0.01
            down = value()
            array[at] = old
            assert grad[at] == pytest.approx((up - down) / 0.02, abs=2e-3)


def test_network_finds_words_and_forms():
    rng = np.random.default_rng(2)
    plain = [f"{a}{b}" for a in ("an", "th", "er", "on", "st") for b in ("the", "ing", "ly", "or", "ed")]
    texts, labels = [], []
    for k in range(600):
        words = list(rng.choice(plain, int(rng.integers(10, 120))))
        if k % 3 == 0:
            for _ in range(3):
                words[int(rng.integers(len(words)))] = "zorgh" + rng.choice(plain) if k % 2 else "blotter"
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    model = toxicity.train(texts[:450], labels[:450], [1.0] * 450)
    got = toxicity.Scorer(model).score(texts[450:] + [None, "", "..."])
    assert np.mean((got[:150] >= 0.3) == np.array(labels[450:])) > 0.95
    assert got[150] == got[151] == got[152] == model.empty
    one_by_one = np.array([toxicity.Scorer(model).score([t])[0] for t in texts[450:470]])
    assert one_by_one == pytest.approx(got[:20], abs=1e-4)


def test_query_rows(spark, llm_dir):
    from brindle.llm.queries import op9_toxicity

    rows = op9_toxicity(spark, llm_dir).collect()
    assert len(rows) == spark.read.parquet(f"{llm_dir}/documents.parquet").count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "x", 5), (3, "a" * 5000, 5), (3, "a" * 5000, 5)], "doc_id long, text string, score int")
    no_labels = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, no_labels)
    assert all(0 <= r.score < 0.3 and r.predicted == 0 for r in toxicity.score_documents(docs, model).collect())  # predicted follows the score
    trained = toxicity.train(["good day", "bad blob"] * 20, [0, 1] * 20, [1.0] * 40)
    kept = toxicity.drop_toxic(docs, trained)
    assert kept.columns == docs.columns and kept.count() <= 5
    assert toxicity.score_documents(docs.limit(0), trained).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, 1), (3, 1)], [(k, 1) for k in range(40) if zlib.crc32(str(k).encode()) % 4 == 2]], ids=["empty", "null", "only 1", "held out"])
def test_no_document_goes_without_a_network(spark, tmp_path, rows):
    import corpus_pipeline

    docs = spark.createDataFrame([(k, f"text {k}" if k else None) for k in range(40)], "doc_id long, text string")
    spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 40
    scored = toxicity.score_documents(docs, toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    assert {r.predicted for r in scored.collect()} == {0}


def test_texts_without_a_word_stay_whatever_the_share(spark):
    model = toxicity.train(["good day", "bad blob"] * 20, [0, 1] * 20, [1.0] * 40)
    assert model.empty == 0.5
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "... !"), (4, "bad blob"), (5, "good day")], "doc_id long, text string")
    assert sorted(r.doc_id for r in toxicity.drop_toxic(docs, model).collect()) == [1, 2, 3, 5]
    for r in toxicity.score_documents(docs, model).collect():
        assert r.predicted == (r.score >= 0.3) == (r.doc_id == 4)


def test_steps_over_parts_of_a_batch_are_steps_over_the_batch(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["good", "plain", "day", "hill", "bad" if k % 2 else "well"], int(rng.integers(0, 400)))) for k in range(60)]
    labels = [k % 2 for k in range(60)]
    whole = toxicity.train(texts, labels, [1.0] * 60, epochs=1, least_steps=3)
    monkeypatch.setattr(toxicity, "WINDOWS", 7)
    parts = toxicity.train(texts, labels, [1.0] * 60, epochs=1, least_steps=3)
    assert whole.vocabulary == parts.vocabulary
    for name, value in whole.params.items():
        assert np.mean(np.abs(value - parts.params[name]) > 1e-3) < 0.01, name


def test_many_very_long_documents_in_one_batch():
    texts = ["good day " * 60_000, "bad blob " * 60_000] * 4
    model = toxicity.train(texts, [0, 1] * 4, [1.0] * 8, epochs=1, least_steps=1, batch=8)
    assert ((0 <= (found := toxicity.Scorer(model).score(texts))) & (found <= 1)).all()


def test_quality_on_held_out_rows(spark):
    """On sf0.1, whose held-out rows hold 120 toxic ones; sf0.01 has 14 and few labels to learn from (0.82 there)."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    tested = labels.filter(toxicity.held_out(labels.doc_id)).select("doc_id", "toxic")
    scored = toxicity.score_documents(docs.join(tested, "doc_id", "left_semi"), toxicity.fit(docs, labels)).join(tested, "doc_id")
    rows = [(r.score, r.toxic) for r in scored.collect()]
    bad, good = ([s for s, t in rows if t == k] for k in (1, 0))
    assert len(bad) >= 100 and np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good]) > 0.9


def test_repeated_ids_give_the_same_model(spark):
    rows = [(k % 60, f"{'bad blob' if k % 2 else 'good day'} {k} text of number {k}") for k in range(240)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    models = [toxicity.fit(spark.createDataFrame(order, "doc_id long, text string").repartition(n), labels) for order, n in ((rows, 1), (rows[::-1], 3))]
    assert models[0].vocabulary == models[1].vocabulary and models[0].shift == models[1].shift
