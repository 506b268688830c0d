import re

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(token, pieces, longest, worst):
    """Tokens of the likeliest segmentation, by one table for each word."""
    best = [(0.0, 0)] + [None] * len(token)
    for i in range(1, len(token) + 1):
        size = len(token[i - 1].encode())
        ways = [(best[i - 1][0] + worst * size, -best[i - 1][1] - size)]
        ways += [(best[j][0] + pieces[token[j:i]], -best[j][1] - 1) for j in range(max(0, i - longest), i) if token[j:i] in pieces]
        s, n = max(ways)
        best[i] = (s, -n)
    return best[-1][1]


def count(text, pieces):
    longest, worst = max(map(len, pieces)), min(pieces.values()) - 10
    return sum(plain("▁" + w, pieces, longest, worst) for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="thesingofatrucki \n漢é🙂", max_size=60), max_size=5))
def test_counts_are_those_of_a_plain_table(texts):
    pieces = unigram.load_pieces(PATH)
    assert unigram.Counter(PATH).count(texts)[1] == [count(t, pieces) for t in texts]


def test_shared_prefixes_are_scored_once():
    trie = unigram.Trie({"▁a": -1.0, "b": -1.0, "ab": -1.5, "▁": -1.0})
    trie.insert("▁abab")
    nodes = len(trie.score)
    last = trie.insert("▁abb")
    assert len(trie.score) == nodes + 1 and trie.count[last] == 3


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"word{i} and others{i % 3}" for i in range(50)]
    want = unigram.Counter(PATH).count(texts)
    monkeypatch.setattr(unigram, "NODES", 20)
    monkeypatch.setattr(unigram, "WORDS", 5)
    small = unigram.Counter(PATH)
    assert [small.count([t]) for t in texts] == [([a], [b]) for a, b in zip(*want, strict=True)]


def test_query_against_a_plain_table(spark, llm_dir):
    from brindle.llm.queries import op6_unigram_counts

    pieces = unigram.load_pieces(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{llm_dir}/documents.parquet").collect()}
    rows = op6_unigram_counts(spark, llm_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == count(texts[r.doc_id], pieces)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, " \n", 9), (None, "a", 9), (4, "x" * 200_000, 9), (4, "a", 9)], "doc_id long, text string, n_words int")
    got = {(r.doc_id, r.n_words): r.n_tokens for r in unigram.count_tokens(docs, PATH).collect()}
    assert got[1, 0] == got[2, 0] == got[3, 0] == 0 and got[None, 1] == 1 and len(got) == 5
    assert unigram.count_tokens(docs.limit(0), PATH).count() == 0
