import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from brindle.llm import periodic
from brindle.llm.queries import op11_periodic_runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def plain_lyndon(ranks):
    """The next smaller suffix of each place, by comparing suffixes."""
    out = []
    for i in range(len(ranks)):
        j = i + 1
        while j < len(ranks) and ranks[j:] > ranks[i:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(words, least=6, times=4):
    """Every stretch of equal words q apart, for every q."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            smaller = any(all(words[k] == words[k + d] for k in range(start, start + length - d)) for d in range(1, q))
            if length >= max(least, times * q) and not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    """What the query says of one document, by the contract's words."""
    words = WORDS(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, digest(lines), digest(" ".join(w for k, w in enumerate(words) if k not in dropped)))


@pytest.mark.parametrize("seed", range(4))
def test_lyndon_arrays_and_runs_against_plain_ones(seed):
    rng = random.Random(seed)
    for _ in range(600):
        words = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 36))]
        if words and rng.random() < 0.5:
            words = (words[: rng.randint(1, 6)] * 20)[: len(words)] + words[: rng.randint(0, 3)]
        known = {}
        ranks = [known.setdefault(w, len(known)) for w in words]
        top = len(known) - 1
        for order in (ranks, [top - r for r in ranks]):
            assert periodic.lyndon_array(order) == plain_lyndon(order)
        for least, times in ((6, 4), (2, 2), (4, 3)):
            assert periodic.find_runs(words, least, times) == plain_runs(words, least, times)


def test_runs_at_the_least_length_and_power():
    assert periodic.find_runs(list("aaaaa")) == []
    assert periodic.find_runs(list("aaaaaa")) == [(0, 6, 1)]
    assert periodic.find_runs(list("xababababy")) == [(1, 8, 2)] and periodic.find_runs(list("xabababay")) == []
    assert periodic.find_runs(list("abcabcabcabca")) == [(0, 13, 3)]
    assert periodic.collapsed(list("xababababy"), [(1, 8, 2)]) == "x a b y"


def test_nested_runs_and_a_very_long_text():
    block = ["a"] * 8 + ["b"]
    assert periodic.find_runs(block * 5) == plain_runs(block * 5)
    words = block * 20_000
    found = periodic.find_runs(words)
    assert len(found) == 20_001 and (0, len(words), 9) in found


def test_query_against_the_contract(spark, tmp_path):
    """Words of few letters, so that runs occur; rows whose id plants one, odd texts, repeated rows and other columns."""
    rng = random.Random(7)
    texts = [None, "", " \t\n", "one", "é é é é é é", "a\u00a0b " * 30, "x " * 3000]
    texts += [" ".join(rng.choice(["for", "to", "a"]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = [(i, t, "runs", 1) for i, t in enumerate(texts)] + [(5, texts[5], "runs", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, id long").write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_periodic_runs(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_row(r[0], r[1]) for r in rows), key=repr)
    assert sum(r.n_runs > 0 for r in got.collect()) > 20


def test_documents_against_the_contract(spark, llm_dir):
    rows = spark.read.parquet(f"{llm_dir}/documents.parquet").filter("length(text) < 4000").collect()
    want = {r.doc_id: plain_row(r.doc_id, r.text) for r in rows}
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, llm_dir).collect()}
    assert {k: got[k] for k in want} == want


def test_null_ids_and_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a a a a a a")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/one/documents.parquet")
    row = op11_periodic_runs(spark, f"{tmp_path}/one").first()
    assert (row.doc_id, row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (None, 1, 0, 6, 1, 6000)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
