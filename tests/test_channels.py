"""Bad channels, references, splines, scalp maps and thresholds against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import channels

SCHEMA = "rec string, ch string, block long, start long, signal array<double>"


def rows_of(signals, size):
    return [(r, c, k // size, k, x[k : k + size].tolist()) for (r, c), x in signals.items() for k in range(0, len(x), size)]


def plain_noisy(x, window, limit, least, share, rounds):
    """x: channels by samples. Flags after all rounds."""
    bad = np.zeros(len(x), bool)
    for _ in range(rounds):
        y = x - x[~bad].mean(axis=0)
        d = y.std(axis=1)
        mad = np.median(np.abs(d - np.median(d))) * 1.4826
        low = np.zeros(len(x))
        for w in range(x.shape[1] // window):
            c = np.abs(np.nan_to_num(np.corrcoef(y[:, w * window : (w + 1) * window])))
            np.fill_diagonal(c, 0)
            low += c.max(axis=1) < least
        now = bad | (d == 0) | (np.abs(d - np.median(d)) > limit * mad) | (low / (x.shape[1] // window) > share)
        if (now == bad).all():
            break
        bad = now
    return bad


def test_planted_bad_channels_are_found_over_blocks(spark):
    rng = np.random.default_rng(1)
    base = 2 * rng.standard_normal(1024)
    names = list(channels.PLACES)[:12]
    own = lambda: np.array([base * (-1) ** k * rng.uniform(1, 1.5) + 0.3 * rng.standard_normal(1024) for k in range(12)])
    x, other = own(), own()
    x[3] *= 40
    x[7] = 3 * rng.standard_normal(1024)
    signals = {("r", c): v for c, v in zip(names, x, strict=True)} | {(None, c): v for c, v in zip(names, other, strict=True)}
    df = spark.createDataFrame(rows_of(signals, 256), SCHEMA).repartition(3)
    got = {(r.rec, r.ch): r.bad for r in channels.noisy_channels(df, "rec", "ch", 64).collect()}
    for rec, y in (("r", x), (None, other)):
        assert [got[rec, c] for c in names] == plain_noisy(y, 64, 5.0, 0.4, 0.01, 4).tolist()
    assert got["r", names[3]] and got["r", names[7]]
    bad = spark.createDataFrame([(r, c) for (r, c), b in got.items() if b], "rec string, ch string")
    good = np.array([v for (r, c), v in signals.items() if r == "r" and not got[r, c]]).mean(axis=0)
    done = {(r.rec, r.ch, r.block): r.signal for r in channels.robust_reference(df, bad, "rec", "ch").collect()}
    assert len(done) == 2 * 12 * 4
    assert np.allclose(np.concatenate([done["r", names[0], b] for b in range(4)]), x[0] - good)


def test_splines_restore_smooth_fields(monkeypatch):
    places = np.array([channels.on_sphere(*np.array(p, float)) for p in channels.PLACES.values()])
    assert np.allclose(np.linalg.norm(places, axis=1), 1) and len(np.unique(places.round(6), axis=0)) == len(places)
    for k in range(len(places)):
        w = channels.spline_weights(np.delete(places, k, 0), places[k : k + 1])
        assert w.sum() == pytest.approx(1)
    field = lambda p: 1 + p @ np.array([0.5, -0.2, 0.7])
    centre = [list(channels.PLACES).index(c) for c in ("Cz", "C3", "Pz")]
    w = channels.spline_weights(np.delete(places, centre, 0), places[centre])
    assert np.allclose(w @ field(np.delete(places, centre, 0)), field(places[centre]), atol=0.1)
    monkeypatch.setattr(channels, "SMOOTHING", 0.0)
    assert np.allclose(channels.spline_weights(places, places), np.eye(len(places)), atol=1e-6)  # the spline goes through what is known


def test_restored_channels_against_a_direct_solve(spark):
    rng = np.random.default_rng(3)
    names = [*channels.PLACES, "ECG"]
    signals = {("r", c): rng.standard_normal(10) for c in names}
    df = spark.createDataFrame(rows_of(signals, 4), SCHEMA)
    bad = spark.createDataFrame([("r", "Cz"), ("r", "O1"), ("r", "ECG"), ("other", "F3")], "rec string, ch string")
    got = {}
    for r in channels.restored(df, bad, "rec", "ch").orderBy("block").collect():
        got.setdefault(r.ch, []).extend(r.signal)
    good = [c for c in channels.PLACES if c not in ("Cz", "O1")]
    place = lambda c: channels.on_sphere(*np.array(channels.PLACES[c], float))
    kernel = lambda a, b: sum((2 * n + 1) / (n * (n + 1)) ** 4 * np.polynomial.legendre.Legendre.basis(n)(float(np.clip(a @ b, -1, 1))) for n in range(1, 51)) / (4 * np.pi)
    system = np.array([[kernel(place(a), place(b)) + (1e-5 if a == b else 0) for b in good] + [1.0] for a in good] + [[1.0] * len(good) + [0.0]])
    for t in range(10):
        solved = np.linalg.solve(system, [signals["r", c][t] for c in good] + [0.0])
        for c in ("Cz", "O1"):
            assert got[c][t] == pytest.approx(sum(w * kernel(place(c), place(g)) for w, g in zip(solved, good, strict=False)) + solved[-1], abs=1e-6)
    assert got["F3"] == signals["r", "F3"].tolist() and got["ECG"] == signals["r", "ECG"].tolist()


def test_scalp_map_of_a_constant_and_of_nothing(spark):
    rows = [("a", c, 2.5) for c in channels.PLACES] + [("a", "ECG", 99.0), ("b", "ECG", 1.0), ("b", "Cz", None), (None, "Cz", 1.0)]
    got = channels.scalp_map(spark.createDataFrame(rows, "rec string, ch string, v double"), ["rec"], "ch", "v", 8).collect()
    assert {r.rec for r in got} == {"a", None} and all(abs(r.value - 2.5) < 1e-9 for r in got if r.rec == "a")
    assert len({(r.x, r.y) for r in got}) * 2 == len(got) and all(r.x**2 + r.y**2 <= 1 for r in got)


def test_thresholds_leave_out_planted_epochs(spark):
    rng = np.random.default_rng(5)
    wave = np.sin(np.arange(32) / 3)
    rows = []
    for ch in ("c", None):
        for e in range(60):
            x = wave + 0.3 * rng.standard_normal(32)
            if e % 10 == 3:
                x += np.where(np.arange(32) < 16, 30.0, 0.0) * rng.choice([-1, 1])
            rows.append((ch, e, e % 4, x.tolist()))
    df = spark.createDataFrame([*rows, ("d", 0, 0, [1.0]), ("c", 99, 0, None)], "ch string, e int, fold int, x array<double>")
    found = {r.ch: r.threshold for r in channels.rejection_thresholds(df, ["ch"], "e", "fold", "x").collect()}
    assert set(found) == {"c", None}  # one epoch has no training fold
    for ch, e, _, x in rows:
        assert (max(x) - min(x) > found[ch]) == (e % 10 == 3)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert channels.noisy_channels(df, "rec", "ch", 4).count() == 0
    assert channels.restored(df, df.select("rec", "ch"), "rec", "ch").count() == 0
    flat = spark.createDataFrame([("r", c, 0, 0, [0.0, 0.0, 0.0, 0.0]) for c in "ab"], SCHEMA)
    assert [r.bad for r in channels.noisy_channels(flat, "rec", "ch", 2).collect()] == [True, True]
    assert channels.robust_reference(flat, flat, "rec", "ch").select(F.explode("signal")).distinct().count() == 1
