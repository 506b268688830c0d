"""Toxicity of documents by a bidirectional gated recurrent network over word and character inputs, written in numpy.

A word is read as its own vector (words frequent in the training sample) joined with the mean vector of its character
n-grams, so that unseen forms of a word are read by their parts. Two gated recurrent units run over windows of 32 words, one
from either side; attention pools their states into the window's logit. Windows overlap by 8 words and cover every word of a
text. A document's logit is the log-sum-exp of its windows in training and the largest one in scoring, made a probability
by a logistic fit on labelled rows that were kept out of training.

Training takes at most ``per_class`` labelled rows of either label (the smallest hashes of their ids), and never a row whose
crc32(id as text) mod 4 is 2. Only texts and labels are read. It runs in one task, whose input that bound fixes; a step holds
``WINDOWS`` windows at most and adds up the gradients of longer batches. The driver sees only the model, of a fixed size,
and broadcasts it to the tasks.

Only what the network read in words can make a text toxic: texts without a word, and every text where no network could be
trained, are never predicted toxic and never dropped.

Edge cases: a null or empty text, or one without any word, gets the labelled rows' weighted share of label 1, kept under the threshold; a row with a null id is scored and
counts as not held out; repeated rows get equal scores, and of rows that share a labelled id the text of the smallest hash is learned from; without rows of both labels every score is the share of label 1
(0.5 without any label) and nothing is predicted toxic; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches

SPAN, STEP = 32, 24  # words in a window, and from one window's start to the next
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 8, 8, 12, 8
CHAR_ROWS = 1 << 14
REMEMBERED = 200_000  # distinct words whose inputs a task remembers
WINDOWS = 2048  # windows that a training step holds at once
PER_CLASS = 2000

_split = re.compile(r"\w+").findall
_word = re.compile(r"\w").search


def words_of(text: str | None) -> list[str]:
    return _split(text.lower()) if text else []


def char_rows(word: str) -> list[int]:
    """Rows of a word's character 3- to 5-grams, its ends marked."""
    marked = f"<{word}>"
    found = [zlib.crc32(marked[i : i + n].encode()) % CHAR_ROWS for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
    return found or [zlib.crc32(marked.encode()) % CHAR_ROWS]


def windows(length: int) -> list[int]:
    """Starts of the overlapping windows that cover a text of so many words; one start for an empty text."""
    return list(range(0, max(1, length - SPAN + STEP), STEP))


def _tanh_gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, rows, HIDDEN) of one direction; x holds the projected inputs, mask is 0 where a window has no word."""
    steps, rows, _ = x.shape
    h, out = np.zeros((rows, HIDDEN), np.float32), np.empty((steps, rows, HIDDEN), np.float32)
    for t in range(steps):
        p = h @ u
        g = _tanh_gate(x[t, :, : 2 * HIDDEN] + p[:, : 2 * HIDDEN])
        r, z, pn = g[:, :HIDDEN], g[:, HIDDEN:], p[:, 2 * HIDDEN :]
        n = np.tanh(x[t, :, 2 * HIDDEN :] + r * pn)
        m = mask[t][:, None]
        new = (n + z * (h - n)) * m
        if keep is not None:
            keep.append((h, r, z, n, pn, m))
        h = out[t] = new
    return out


def gru_back(grad: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u, given those of the states."""
    steps, rows, _ = grad.shape
    dx, du, dh = np.empty((steps, rows, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((rows, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, r, z, n, pn, m = kept[t]
        d = (dh + grad[t]) * m
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * pn * r * (1 - r)
        dp = np.concatenate([dr, dz, dn * r], axis=1)
        dx[t, :, : 2 * HIDDEN], dx[t, :, 2 * HIDDEN :] = dp[:, : 2 * HIDDEN], dn
        du += h.T @ dp
        dh = d * z + dp @ u.T
    return dx, du


def forward(p: dict[str, np.ndarray], xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """Logit of each window; xf and xb are the projected inputs in reading order for either direction."""
    kf, kb = ([], []) if tape is not None else (None, None)
    hf = gru(xf, mask, p["uf"], kf)
    hb = gru(xb[::-1], mask[::-1], p["ub"], kb)[::-1]
    h = np.concatenate([hf, hb], axis=2)
    a = np.tanh(h @ p["wa"] + p["ba"])
    e = a @ p["va"]
    e = np.where(mask > 0, e, np.float32(-30))
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    c = np.einsum("tb,tbh->bh", w, h)
    if tape is not None:
        tape |= {"kf": kf, "kb": kb, "h": h, "a": a, "w": w, "c": c}
    return c @ p["out"] + p["bias"][0]


def backward(p: dict[str, np.ndarray], tape: dict, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    h, a, w, c = (tape[k] for k in "hawc")
    g = {"out": c.T @ dlogit, "bias": dlogit.sum(keepdims=True)}
    dc = dlogit[:, None] * p["out"][None, :]
    dh = w[:, :, None] * dc[None]
    dw = np.einsum("bh,tbh->tb", dc, h)
    de = w * (dw - (w * dw).sum(axis=0))
    da = de[:, :, None] * p["va"] * (1 - a * a)
    g["va"] = np.einsum("tb,tba->a", de, a)
    g["wa"] = np.einsum("tbh,tba->ha", h, da, optimize=True)
    g["ba"] = da.sum(axis=(0, 1))
    dh = (dh + da @ p["wa"].T).astype(np.float32)
    dxf, g["uf"] = gru_back(dh[:, :, :HIDDEN], tape["kf"], p["uf"])
    dxb, g["ub"] = gru_back(dh[::-1, :, HIDDEN:], tape["kb"], p["ub"])
    return g, dxf, dxb[::-1]


@dataclass
class Model:
    """What scoring needs. empty: the score of texts without a word; base: that of every text where no network could be trained."""

    params: dict[str, np.ndarray]
    vocabulary: dict[str, int]
    slope: float = 1.0
    shift: float = 0.0
    empty: float = 0.5
    base: float | None = None


def _start(n_words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    return {
        "words": draw(0.1, n_words, WORD_DIM), "chars": draw(0.3, CHAR_ROWS, CHAR_DIM),
        "wf": draw(d**-0.5, d, 3 * h), "wb": draw(d**-0.5, d, 3 * h), "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32),
        "uf": draw(h**-0.5, h, 3 * h), "ub": draw(h**-0.5, h, 3 * h),
        "wa": draw(0.3, 2 * h, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": draw(0.5, ATTEND),
        "out": draw(0.3, 2 * h), "bias": np.zeros(1, np.float32),
    }


def _inputs(p: dict[str, np.ndarray], own: np.ndarray, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of words (row in words, n-gram rows from first on) and the numbers of n-grams."""
    counts = np.diff(np.append(first, len(flat)))
    chars = np.add.reduceat(p["chars"][flat], first, axis=0) / counts[:, None].astype(np.float32)
    return np.concatenate([p["words"][own], chars], axis=1), counts


def _counted(word: str, sizes: np.ndarray, at: int) -> list[int]:
    found = char_rows(word)
    sizes[at] = len(found)
    return found


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(rows, values[:, j], n) for j in range(values.shape[1])], axis=1).astype(np.float32)


def train(texts: list[str | None], labels: list[int], weights: list[float], epochs: int = 4, batch: int = 32, least_steps: int = 280, rate: float = 0.01, seed: int = 11) -> Model:
    """Fits the network on four fifths of the rows and its calibration on the others; weights are for calibration.

    Few rows are read in more epochs, so that there are at least least_steps updates.
    """
    y, weight = np.array(labels, np.float32), np.array(weights)
    if not len(y) or y.min() == y.max():
        return Model({}, {}, base=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    every: dict[str, int] = {}
    ids = [np.fromiter((every.setdefault(w, len(every)) for w in words_of(t)), np.int32) for t in texts]
    aside = np.arange(len(ids)) % 5 == 4
    seen = np.zeros(len(every), np.int32)
    for k in np.flatnonzero(~aside):
        seen[np.unique(ids[k])] += 1
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, i in every.items() if seen[i] >= 3))}
    own = np.fromiter((vocabulary.get(w, 0) for w in every), np.int32, len(every))
    sizes = np.zeros(len(every) + 1, np.int64)
    grams = np.fromiter((g for i, w in enumerate(every) for g in _counted(w, sizes, i + 1)), np.int32)
    ends = np.cumsum(sizes)
    del every
    p = _start(len(vocabulary) + 1, rng)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    tick = 0

    def laid_out(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of each window (windows, steps), -1 where there is none, and each document's number of windows."""
        starts = [windows(len(ids[k])) for k in chosen]
        grid = np.full((sum(map(len, starts)), SPAN), -1, np.int32)
        row = 0
        for k, own_starts in zip(chosen, starts, strict=True):
            for s in own_starts:
                part = ids[k][s : s + SPAN]
                grid[row, : len(part)] = part
                row += 1
        return grid, np.array([len(s) for s in starts])

    def project(grid: np.ndarray, hidden: np.ndarray) -> dict:
        """Projected inputs of some windows, with what their gradients need; words in hidden are read by their characters alone."""
        used, place = np.unique(grid, return_inverse=True)
        place, mask = place.reshape(grid.shape).T, (grid.T >= 0).astype(np.float32)
        if used[0] < 0:
            used, place = used[1:], np.maximum(place - 1, 0)
        if len(used):
            counts = sizes[used + 1]
            first = np.cumsum(counts) - counts
            flat = grams[np.repeat(ends[used] - first, counts) + np.arange(counts.sum())]
            rows = np.where(np.isin(used, hidden), 0, own[used])
            x, _ = _inputs(p, rows, flat, first)
        else:
            x, counts, flat, rows = np.zeros((1, WORD_DIM + CHAR_DIM), np.float32), np.ones(1, np.int64), np.zeros(1, np.int64), None
        made = {"x": x, "counts": counts, "flat": flat, "rows": rows, "place": place, "mask": mask}
        return made | {"xf": (x @ p["wf"] + p["bf"])[place], "xb": (x @ p["wb"] + p["bb"])[place]}

    def gradients(part: dict, tape: dict, dz: np.ndarray) -> dict[str, np.ndarray]:
        x, mask, rows, counts, d3 = part["x"], part["mask"], part["rows"], part["counts"], 3 * HIDDEN
        g, dxf, dxb = backward(p, tape, dz.astype(np.float32))
        at = part["place"].reshape(-1)
        sf, sb = (_scatter(at, (d * mask[:, :, None]).reshape(-1, d3), len(x)) for d in (dxf, dxb))
        g |= {"wf": x.T @ sf, "wb": x.T @ sb, "bf": sf.sum(axis=0), "bb": sb.sum(axis=0)}
        if rows is not None:
            dx = sf @ p["wf"].T + sb @ p["wb"].T
            g["words"] = _scatter(rows, dx[:, :WORD_DIM], len(p["words"]))
            g["words"][0] = 0
            g["chars"] = _scatter(part["flat"], np.repeat(dx[:, WORD_DIM:] / counts[:, None], counts, axis=0), CHAR_ROWS)
        return g

    def run(chosen: np.ndarray, learn: bool) -> np.ndarray:
        """The largest logit of each chosen document; learn takes a step. WINDOWS windows are held at once."""
        nonlocal tick
        grid, per = laid_out(chosen)
        hidden = np.flatnonzero(rng.random(len(own)) < 0.3) if learn else np.zeros(0, np.int64)  # as unseen words will be
        cuts = [slice(at, at + WINDOWS) for at in range(0, len(grid), WINDOWS)]
        z, kept = np.empty(len(grid), np.float32), None
        for cut in cuts:
            part, tape = project(grid[cut], hidden), {} if learn and len(cuts) == 1 else None
            z[cut] = forward(p, part["xf"], part["xb"], part["mask"], tape)
            kept = (part, tape)
        first = np.cumsum(per) - per
        top = np.maximum.reduceat(z, first)
        if not learn:
            return top
        share = np.exp(z - np.repeat(top, per))
        total = np.add.reduceat(share, first)
        dz = np.repeat(1 / (1 + np.exp(-top - np.log(total))) - y[chosen], per) * share / np.repeat(total, per) / len(chosen)
        if len(cuts) == 1:
            g = gradients(*kept, dz)
        else:
            g = {}
            for cut in cuts:
                part, tape = project(grid[cut], hidden), {}
                forward(p, part["xf"], part["xb"], part["mask"], tape)
                for k, grad in gradients(part, tape, dz[cut]).items():
                    g[k] = g[k] + grad if k in g else grad
        tick += 1
        for k, grad in g.items():
            m, v = moments[k]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            p[k] -= rate * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.99**tick)) + 1e-7)
        return top

    p["words"][0] = 0
    inside = np.flatnonzero(~aside)
    for _ in range(max(epochs, -(-least_steps * batch // len(inside)))):
        order = rng.permutation(inside)
        for at in range(0, len(order), batch):
            run(order[at : at + batch], True)
    held = np.flatnonzero(aside)
    if not 0 < y[held].sum() < len(held):
        held = np.arange(len(ids))
    top = np.concatenate([run(held[at : at + batch], False) for at in range(0, len(held), batch)]).astype(np.float64)
    slope, shift = calibrated(top, y[held], weight[held])
    return Model(p, vocabulary, slope, shift, empty=float((weight * y).sum() / weight.sum()))


def calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit of y on z, slightly drawn to (1, 0) so that separable rows have a fit too."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        r, v = weight * (q - y), weight * q * (1 - q)
        grad = np.array([(r * z).sum() + 0.5 * (slope - 1), r.sum() + 0.05 * shift])
        second = np.array([[(v * z * z).sum() + 0.5, (v * z).sum()], [(v * z).sum(), v.sum() + 0.05]])
        step = np.linalg.solve(second, grad)
        slope, shift = slope - float(np.clip(step[0], -1, 1)), shift - float(np.clip(step[1], -3, 3))
    return max(slope, 1e-3), shift


class Scorer:
    """Scores texts in a task; the projected inputs of distinct words are computed once and remembered."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.ready = np.zeros((4096, 6 * HIDDEN), np.float32)  # row 0 stands for no word; grows by doubling

    def learn(self, words: set[str]) -> None:
        if len(self.places) + len(words) > REMEMBERED and self.places:
            self.forget()
        fresh = list(words - self.places.keys())
        if not fresh:
            return
        p = self.model.params
        for at in range(0, len(fresh), 20_000):
            some = fresh[at : at + 20_000]
            grams = [char_rows(w) for w in some]
            first = np.cumsum([0, *map(len, grams)])[:-1]
            flat = np.fromiter((i for g in grams for i in g), np.int64)
            own = np.array([self.model.vocabulary.get(w, 0) for w in some], np.int64)
            x, _ = _inputs(p, own, flat, first)
            base = len(self.places) + 1
            if base + len(some) > len(self.ready):
                grown = np.zeros((max(2 * len(self.ready), base + len(some)), 6 * HIDDEN), np.float32)
                grown[:base] = self.ready[:base]
                self.ready = grown
            self.ready[base : base + len(some)] = np.concatenate([x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]], axis=1)
            self.places.update(zip(some, range(base, base + len(some)), strict=True))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.model.base is not None:
            return np.full(len(texts), self.model.base)
        docs = [words_of(t) for t in texts]
        self.learn({w for d in docs for w in d})
        get = self.places.__getitem__
        lengths = np.array([len(d) for d in docs])
        ids = np.zeros(lengths.sum() + SPAN, np.int32)
        ids[: lengths.sum()] = np.fromiter((get(w) for d in docs for w in d), np.int32, lengths.sum())
        begin = np.cumsum([0, *lengths])[:-1]
        per = np.array([len(windows(n)) for n in lengths])
        doc = np.repeat(np.arange(len(docs)), per)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * STEP
        left = lengths[doc] - start
        z = np.empty(len(doc), np.float32)
        for at in range(0, len(doc), 1024):
            s = slice(at, at + 1024)
            mask = np.arange(SPAN)[:, None] < left[s][None, :]
            place = np.where(mask, ids[(begin[doc[s]] + start[s])[None, :] + np.arange(SPAN)[:, None]], 0)
            x = self.ready[place]
            z[s] = forward(self.model.params, x[:, :, : 3 * HIDDEN], x[:, :, 3 * HIDDEN :], mask.astype(np.float32))
        top = np.maximum.reduceat(z, np.cumsum(per) - per).astype(np.float64) if len(doc) else z
        found = 1 / (1 + np.exp(-np.clip(self.model.slope * top + self.model.shift, -30, 30)))
        return np.where(lengths > 0, found, self.model.empty)

    def judge(self, texts: list[str | None], threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and which texts are toxic: those whose words the network read and gave threshold or more. All other scores are under it."""
        scores = self.score(texts)
        under = max(0.0, float(np.nextafter(threshold, -np.inf)))
        if self.model.base is not None:
            return np.minimum(scores, under), np.zeros(len(texts), bool)
        read = np.array([bool(t and _word(t)) for t in texts], bool)
        return np.where(read, scores, np.minimum(scores, under)), read & (scores >= threshold)


def held_out(row_id: Column) -> Column:
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled rows that are not held out, per_class of either label at most (bounded, so one task can hold them)."""
    open_rows = labels.filter(~held_out(F.col(id_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in open_rows.filter("label in (0, 1)").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("id"), F.col("id")]
    sample = open_rows.filter("label = 1").orderBy(*order).limit(per_class).unionByName(open_rows.filter("label = 0").orderBy(*order).limit(per_class))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    rows = found.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first")).select(F.crc32(F.col("id").cast("string").cast("binary")).alias("crc"), F.col("id").cast("string").alias("id"), "label", F.col("first.text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:3])
        taken = Counter(r[2] for r in every)
        weights = [totals[r[2]] / taken[r[2]] for r in every]
        scale = sum(weights) / max(1, len(weights))
        model = train([r[3] for r in every], [r[2] for r in every], [w / scale for w in weights])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = rows.repartition(1).mapInArrow(learn, "model binary").collect()  # 2 * per_class rows at most
    return pickle.loads(bytes(made[0][0])) if made else train([], [], [])


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) and predicted (1 if the network gave threshold or more) of every row."""
    bounded_batches(docs.sparkSession, 1)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: 16,384 n-gram rows and the sample's frequent words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores, toxic = scorer.judge(batch.column(1).to_pylist(), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(toxic.astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs without the rows that the network gave threshold or more; all columns kept, whatever their names, and no shuffle or join."""
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    bounded_batches(docs.sparkSession, 1)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(~scorer.judge(batch.column(place).to_pylist(), threshold)[1]))

    return docs.mapInArrow(run, docs.schema).toDF(*names)
