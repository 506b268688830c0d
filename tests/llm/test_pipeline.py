from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import bpe, mixing


def test_every_stage_takes_effect(spark, llm_dir, tmp_path):
    docs = spark.read.parquet(f"{llm_dir}/documents.parquet")
    columns, stages = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, llm_dir).write.parquet(f"{tmp_path}/{k}")
        docs = stages[name] = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
    start = spark.read.parquet(f"{llm_dir}/documents.parquet").count()
    clean, single, private, mix = (stages[n] for n in ("toxicity", "near duplicates", "personal data", "source mixing"))
    assert 0.7 * start < clean.count() <= start
    assert single.count() < clean.count() and single.select("text").distinct().count() == single.count()
    assert private.count() == single.count()
    before = {r.doc_id: r.text for r in single.collect()}
    changed = [r for r in private.collect() if r.text != before[r.doc_id]]
    assert changed and all(r.n_chars == len(r.text) for r in changed)
    want = {r.doc_id: r.copies for r in mixing.mix_sources(private).collect() if r.copies}
    assert Counter(r.doc_id for r in mix.collect()) == want
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = {r.doc_id: r.text for r in mix.collect()}
    for r in stages["byte-level BPE"].collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == plain.encode_ordinary(texts[r.doc_id])


def test_run_returns_the_last_stage(spark, llm_dir):
    got = corpus_pipeline.run(spark, llm_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and got.count() > 0


def test_stages_take_odd_rows_and_names(spark, llm_dir, tmp_path):
    """Null, empty, blank and very long texts, null ids and sources, repeated rows, other columns with dots and with names that the stages use, and an empty table."""
    copy = "the quick brown fox jumps over the lazy dog and runs far away from here " * 3
    rows = [(1, copy, "en", "a", 5), (1, copy, "en", "a", 5), (2, copy + "now", "en", "a", 5), (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \t\n", "en", "", 3)]
    rows += [(None, "no id but words enough to be read", "de", "b", 1), (6, "call +49 170 1234567 or write to a.b@example.org", "de", "b", 1), (7, "word " * 60_000 + "end", "en", "c", 1), (8, "é \U0001f600 \x00", "fr", "c", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(["odd.name", "a b", "size", "h", "row__", "key", "copies"]):
        docs = docs.withColumn(name, F.lit(k))
    columns = docs.columns
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    kept = spark.read.parquet(f"{tmp_path}/in")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        none = stage(spark, kept.limit(0), llm_dir)
        assert none.count() == 0
        before = kept.count()
        stage(spark, kept, llm_dir).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == columns == none.columns
        if k == 0:
            assert after.count() == before == len(rows)  # none of these is toxic
        if k == 1:
            assert Counter(r.doc_id for r in after.collect()) == {1: 1, 3: 1, 4: 1, 5: 1, None: 1, 6: 1, 7: 1, 8: 1}
        if k == 2:
            texts = {r.doc_id: r.text for r in after.collect()}
            assert "1234567" not in texts[6] and "a.b@example.org" not in texts[6] and texts[3] is None and texts[4] == "" and texts[5] == " \t\n"
        kept = after
    assert set(kept.columns) == {"doc_id", "n_tokens", "ids", "decoded_sha256"}
