import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def ids(texts):
    return [np.frombuffer(b, "<u4").tolist() for b in bpe.Encoder(PATH, public_tokenizers.PATTERN).encode(texts)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=8))
def test_ids_are_those_of_tiktoken(texts):
    assert ids(texts) == [PLAIN.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abnthe nio\n", max_size=300), max_size=4))
def test_ids_of_repetitive_texts(texts):
    assert ids(texts) == [PLAIN.encode_ordinary(t) for t in texts]


def test_a_lower_rank_formed_by_a_merge_goes_first():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"bc": 4, b"abc": 3}
    tokens = [b"a", b"b", b"c", b"abc", b"bc"]
    assert bpe.replay([b"abcbc", b"bcabc", b""], ranks, tokens) == [[3, 4], [4, 3], []]


def test_documents_round_trip(spark):
    long = "thisisaverylongwordwithoutblanks" * 3000
    texts = [None, "", "Hello  world's\n\n 123", long, "Hello  world's\n\n 123", " \t ", "üß 漢字 🙂"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a", "x")], "doc_id long, text string, ids string")
    rows = bpe.decode_documents(bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 1
    for i, t in enumerate(texts):
        want = PLAIN.encode_ordinary(t or "")
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == want and got[i].n_tokens == len(want)
        assert bytes(got[i].decoded) == (t or "").encode()


def test_query_against_brute_force(spark, llm_dir):
    from brindle.llm.queries import op4_byte_bpe

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{llm_dir}/documents.parquet").collect()}
    for r in op4_byte_bpe(spark, llm_dir).collect():
        want = PLAIN.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("bad", [50256, 4_000_000_000])
def test_unknown_ids_fail(spark, bad):
    coded = spark.createDataFrame([(1, 1, bytearray(np.array([bad], "<u4").tobytes()))], "doc_id long, n_tokens long, ids binary")
    with pytest.raises(Exception, match="IndexError"):
        bpe.decode_documents(coded, PATH).collect()
