"""Small dense networks: trained in one task on a bounded sample, applied to all rows in Arrow batches.

A network is layers of weights with ReLU between them; the output is linear (mean squared error) or a sigmoid (binary cross
entropy). The sample is SAMPLE rows at most, those of the smallest hash of all their values, so it does not depend on how rows
are dealt, and what a task holds is bounded by that and the number of features.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.columns import quoted

#: Rows that a network learns from at most.
SAMPLE = 50_000


@dataclass
class Network:
    """Weights and biases by layer; binary: the output is a sigmoid. losses has the mean loss of each epoch."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    binary: bool = False
    losses: list[float] = field(default_factory=list)

    @classmethod
    def start(cls, sizes: list[int], binary: bool = False, seed: int = 42) -> Network:
        """Uniform weights within the inverse root of a layer's inputs, as dense layers usually begin."""
        rng = np.random.default_rng(seed)
        draw = lambda n, *shape: rng.uniform(-1, 1, shape) / np.sqrt(n)
        return cls([draw(a, a, b) for a, b in zip(sizes, sizes[1:], strict=False)], [draw(a, b) for a, b in zip(sizes, sizes[1:], strict=False)], binary)

    def values(self, x: np.ndarray, layers: int | None = None) -> list[np.ndarray]:
        """x and what each of the first layers makes of it; ReLU but for the last layer of the whole network, which is left linear."""
        out = [x]
        for k, (w, b) in enumerate(zip(self.weights[:layers], self.biases[:layers], strict=True)):
            z = out[-1] @ w + b
            out.append(z if k + 1 == len(self.weights) else np.maximum(z, 0))
        return out

    def output(self, x: np.ndarray) -> np.ndarray:
        z = self.values(x)[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))) if self.binary else z

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        p = self.output(x)
        if self.binary:
            p = np.clip(p, 1e-12, 1 - 1e-12)
            return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        return float(((p - y) ** 2).mean())

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of the mean loss, by layer."""
        seen = self.values(x)
        d = (self.output(x) - y) * (1.0 if self.binary else 2.0) / y.size
        ws, bs = [], []
        for k in range(len(self.weights) - 1, -1, -1):
            ws.append(seen[k].T @ d)
            bs.append(d.sum(axis=0))
            if k:
                d = (d @ self.weights[k].T) * (seen[k] > 0)
        return ws[::-1], bs[::-1]

    def learn(self, x: np.ndarray, y: np.ndarray, epochs: int = 50, batch: int = 32, rate: float = 1e-3, seed: int = 42) -> None:
        """Adam over minibatches in a seeded order that changes from epoch to epoch."""
        rng, step = np.random.default_rng(seed), 0
        params = [*self.weights, *self.biases]
        mean, square = ([np.zeros_like(p) for p in params] for _ in "ab")
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                total += self.loss(x[own], y[own]) * len(own)
                ws, bs = self.gradients(x[own], y[own])
                step += 1
                for p, g, m, s in zip(params, [*ws, *bs], mean, square, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            self.losses.append(total / max(1, len(x)))


def _vector(names: list[str]) -> Column:
    return F.array(*[quoted(c).cast("double") for c in names])


def _rows(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def trained(df: DataFrame, features: list[str], target: str | None, hidden: list[int], epochs: int = 50, batch: int = 32, rate: float = 1e-3, seed: int = 42, sample: int = SAMPLE) -> Network:
    """A classifier of a binary target, or without a target an autoencoder, with the hidden layers; rows with a gap are left out.

    Without a row the network is as it starts."""
    size = len(features)
    wanted = F.array(quoted(target).cast("double")) if target else _vector(features)
    values = df.select(_vector(features).alias("x"), wanted.alias("y"))
    whole = values.filter(~F.exists("x", lambda v: v.isNull()) & ~F.exists("y", lambda v: v.isNull()))
    rows = whole.orderBy(F.xxhash64("x", "y"), "x", "y").limit(sample)
    out = 1 if target else size

    def learn(batches):
        parts = [(_rows(b, 0, size), _rows(b, 1, out)) for b in batches if b.num_rows]
        made = Network.start([size, *hidden, out], bool(target), seed)
        if parts:
            x, y = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            order = np.lexsort((*y.T, *x.T))  # however the rows came
            made.learn(x[order], y[order], epochs, batch, rate, seed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["network"])

    made = rows.repartition(1).mapInArrow(learn, "network binary").first()
    return pickle.loads(bytes(made[0])) if made else Network.start([size, *hidden, out], bool(target), seed)


def applied(df: DataFrame, network: Network, features: list[str], name: str, layers: int | None = None) -> DataFrame:
    """df with the array ``name``: the network's output, or what its first ``layers`` make of the features; null where a feature is."""
    shared = df.sparkSession.sparkContext.broadcast(network)  # as many numbers as the layers have
    size, names = len(features), df.columns
    x = F.when(~F.exists(_vector(features), lambda v: v.isNull()), _vector(features))

    def run(batches):
        for batch in batches:
            found = batch.column(len(names))
            there = found.is_valid().to_numpy(zero_copy_only=False)
            values = _rows(pa.RecordBatch.from_arrays([found.filter(pa.array(there))], names=["x"]), 0, size)
            made = shared.value.output(values) if layers is None else shared.value.values(values, layers)[-1]
            out: list = [None] * len(there)
            for k, v in zip(np.flatnonzero(there).tolist(), made.tolist(), strict=True):
                out[k] = v
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, pa.list_(pa.float64()))], names=[*[f"c{i}" for i in range(len(names))], name])

    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema))
    ready = df.withColumn("x__", x).toDF(*[f"c{i}" for i in range(len(names))], "x__")
    return ready.mapInArrow(run, f"{kinds}, `{name}` array<double>").toDF(*names, name)


def coded(df: DataFrame, network: Network, features: list[str], name: str = "code") -> DataFrame:
    """df with the array ``name``: the narrowest layer of an autoencoder."""
    widths = [w.shape[1] for w in network.weights[:-1]]
    return applied(df, network, features, name, int(np.argmin(widths)) + 1)
