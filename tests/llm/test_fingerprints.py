import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import fingerprints as fp
from brindle.llm.minhash import _mix, _power_tables


def plain_features(data):
    """Features of one text, window by window."""
    if not data:
        return []
    data = data.ljust(16, b"\0")
    ranks = []
    for i in range(len(data) - 63):
        counts = np.bincount(np.frombuffer(data[i : i + 64], np.uint8))
        ranks.append(fp._rank[1000 - (int(fp._whole[counts].sum()) * 1000) // int(fp._whole[64])])
    points = [0] * len(ranks)
    for i in range(len(ranks) - 63):
        own = [(r, i + k) for k, r in enumerate(ranks[i : i + 64]) if r >= 0]
        if own:
            points[min(own)[1]] += 1
    up, down = _power_tables(1)
    hashed = lambda w, extra: int(_mix(np.array([((np.frombuffer(w, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(w)]).sum(dtype=np.uint64) + np.uint64(extra)]))[0])
    out = [hashed(data[i : i + 64], 0) for i, n in enumerate(points) if n >= 16]
    if len(data) < 384:
        out += [hashed(data[i : i + 16], 16) for i in range(len(data) - 15)]
    return list(dict.fromkeys(out))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abcdefgh é\n", max_size=600), max_size=6), st.randoms())
def test_features_are_those_of_a_plain_walk(texts, rnd):
    texts = [t * rnd.choice([1, 2]) for t in texts]
    data = [t.encode() for t in texts]
    assert [f.tolist() for f in fp.text_features(data)] == [plain_features(d) for d in data]


def test_pieces_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 110, 3000, dtype=np.uint8))
    whole = fp.text_features([data])[0].tolist()
    monkeypatch.setattr(fp, "CORE", 256)
    assert fp.text_features([data, data[:700]])[0].tolist() == whole == plain_features(data)


def test_digest_round_trip_and_likeness():
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list("etaoinshr"), int(rng.integers(2, 9)))) for _ in range(int(n))) for n in rng.integers(3, 4000, 60)]
    chains = fp.fingerprints(texts)
    edits = fp.fingerprints([fp.edited(t, texts[k - 1]) for k, t in enumerate(texts)])
    for k, c in enumerate(chains):
        back = fp.parse_digest(fp.digest(*c))
        assert (back[0] == c[0]).all() and (back[1] == c[1]).all()
        assert fp.likeness(c, back) == 1.0
        assert fp.likeness(c, edits[k]) > fp.likeness(c, chains[k - 1]) + 0.1
    assert fp.likeness(*fp.fingerprints(["", None])) == 1.0 and fp.likeness(*fp.fingerprints(["", "x"])) == 0.0


def test_neighbours_against_a_sorted_list(spark, llm_dir):
    from brindle.llm.queries import op1_fingerprints

    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{llm_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in op1_fingerprints(spark, llm_dir).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        new = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        one, two, three = fp.fingerprints([t, new, after])
        assert (r.fingerprint, r.edited_fingerprint) == (fp.digest(*one), fp.digest(*two))
        assert (r.near_edited, r.near_next) == pytest.approx((fp.likeness(one, two), fp.likeness(one, three)))


def test_odd_rows(spark):
    run = lambda rows: sorted((str(r.doc_id), r.n_chars, r.near_next) for r in fp.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string, marker int")).collect())
    assert run([]) == []
    assert run([(5, "alone", 1)]) == [("5", 5, 1.0)]
    got = run([(5, "same", 1), (5, "same", 1), (None, None, 1), (-3, "", 1), (7, "x" * 300_000, 1)])
    assert [g[:2] for g in got] == [("-3", 0), ("5", 4), ("5", 4), ("7", 300_000), ("None", 0)]
    assert dict((g[0], g[2]) for g in got)["None"] == 1.0


def test_repeated_units_have_features():
    rng = np.random.default_rng(3)
    units = ["For ", "spam ", "0123456789 ", "buy now! ", "lorem ipsum ", "the cat sat on ", "x", "0123456789abcdef", "".join(map(chr, rng.integers(97, 110, 32))), "".join(map(chr, rng.integers(97, 110, 64)))]
    for size in (384, 385, 2000, 300_000):
        texts = [(u * size)[:size] for u in units]
        chains = fp.fingerprints(texts)
        assert all(len(c[0]) for c in chains)
        for k, c in enumerate(chains):
            assert fp.likeness(c, chains[k - 1]) < 0.6 and fp.likeness(c, fp.fingerprints([""])[0]) == 0.0
            assert fp.likeness(c, fp.fingerprints([fp.edited(texts[k], texts[k - 1])])[0]) > 0.6
    rare = bytes(np.where(rng.random(5000) < 0.01, 121, 120).astype(np.uint8))  # under the least entropy, yet no repetition
    assert all(len(f) for f in fp.text_features([rare, rare[:400]]))


def test_quiet_stretches_against_a_plain_walk(monkeypatch):
    rng = np.random.default_rng(4)
    prose = lambda n: bytes(rng.integers(97, 110, n, dtype=np.uint8))
    texts = [prose(700) + b"For " * 300 + prose(500) + b"x" * 400, b"abcde" * 90, prose(3000)]

    def plain_quiet(data):
        up, _ = _power_tables(1)
        small = lambda i: int(_mix(np.array([((np.frombuffer(data[i : i + 16], np.uint8).astype(np.uint64) + np.uint64(1)) * up[:16]).sum(dtype=np.uint64) + np.uint64(16)]))[0])
        _, at = fp._features([(data, 0, len(data))])[0]
        ends, out = [-1, *at.tolist(), len(data) - 63], []
        for a, b in zip(ends, ends[1:], strict=False):
            if b - a - 1 >= 160:
                hashes = [small(i) for i in range(a + 1, b + 48)]
                out += [min(hashes[i : i + 48]) for i in range(len(hashes) - 47)]
        return out

    want = [list(dict.fromkeys(plain_features(t) + plain_quiet(t))) for t in texts]
    assert [f.tolist() for f in fp.text_features(texts)] == want and len(want[0]) > len(plain_features(texts[0]))
    monkeypatch.setattr(fp, "CORE", 256)
    assert [f.tolist() for f in fp.text_features(texts)] == want
