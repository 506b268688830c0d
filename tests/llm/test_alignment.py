import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from brindle.llm import alignment
from brindle.llm.queries import op13_alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plain(rows):
    """What the query says, with every pair of tokens compared."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters = alignment.byte_letters()
    linked, held = [], []
    for doc_id, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        x = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        y = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            held.append((doc_id, [], [], [], []))
            continue
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (x, y)]
        spans = [list(zip([0, *e[:-1]], e)) for e in ends]
        links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        held.append((doc_id, a, b, groups, [(a[i], b[j]) for i, j in links]))
    counts = Counter(p for h in held for p in set(h[4]))
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    for doc_id, a, b, groups, links in held:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        linked.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return linked


def test_gallop_finds_ranks():
    rng = np.random.default_rng(3)
    for _ in range(300):
        long = np.unique(rng.integers(0, 60, rng.integers(1, 40)))
        short = np.sort(rng.integers(0, long[-1] + 1, rng.integers(1, 20)))
        n = len(long)
        got = alignment.gallop(short, long, rng.integers(0, n, len(short)), np.zeros(len(short), np.int64), np.full(len(short), n - 1))
        assert got.tolist() == np.searchsorted(long, short).tolist()


def test_query_against_every_pair(spark, tmp_path):
    odd = [None, "", " ", "a", "\u2581 x", "<|endoftext|> <s> </s> <0x41>", "\u00e9\u65e5\u672c \U0001f600 tab\tline\n\n", "  lead and trail  ", "\ufb01 \u212b", "\x00", "aaaa" * 200]
    odd += [" \n  a b\n c \t d  ", "x\u0085 y\u00a0 z\u2003 w", "a\x1c b\x1f c", "don't  stop 12 3,4  '\u2019 ll", "a\u200b \u180e b \ufeff c", "\n", " \n ", "a " * 40 + " "]
    prose = ["the cat sat on the mat's edge " * k for k in range(1, 5)]
    rows = [(i, t) for i, t in enumerate(odd + prose)] + [(3, "a"), (None, "the cat")]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row long, pairs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op13_alignment(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("hot", [0, 50, 1 << 17])
def test_documents_with_and_without_frequent_pairs(spark, llm_dir, monkeypatch, hot):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{llm_dir}/documents.parquet").filter("length(text) < 1500").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = alignment.kept_table(alignment.align_documents(docs, A, B))
    counts = alignment.pair_counts(kept)
    got = {r.doc_id: (r.n_best, r.count_sum) for r in kept.join(alignment.link_sums(kept, counts, hot), "row").collect()}
    want = {r[0]: (r[5], r[6]) for r in plain(rows) if r[1]}
    assert got == want
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in kept.collect())


def test_segments_give_the_ids_of_whole_texts(llm_dir, spark):
    """Every code point of the lower planes beside letters, digits and blanks, and the texts of the table."""
    segments = alignment.Segments(*alignment._byte_level(A), *alignment._pieces(B))
    chars = [chr(c) for c in [*range(0x0, 0xD800, 7), *range(0xE000, 0x11000, 31)]]
    texts = [f"a{c} b {c}c 1{c} {c} {c}{c}  {c} x" for c in chars] + [r.text for r in spark.read.parquet(f"{llm_dir}/documents.parquet").collect() if r.text]
    encode_a, encode_b = segments.encode
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        right, ((a, n_a), (b, n_b)) = segments.encoded(part)
        kept = [t for t, r in zip(part, right, strict=True) if r]
        for want, ids, n in ((encode_a(kept), a, n_a), (encode_b(kept), b, n_b)):
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_statistics(docs, A, B).count() == 0
