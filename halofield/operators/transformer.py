"""A masked-gene Transformer: a cell's genes predict each other; residuals are what is left.

Every gene is a token: its value (0 where masked) times a vector, plus the gene's embedding, plus a mask
vector where masked. A pre-norm encoder mixes the tokens, attention pooling gives the cell's embedding,
and a head reads token and cell. Training is data-parallel: each step broadcasts the weights (a few tens
of thousands of numbers, whatever the number of cells), every partition adds up the gradients of its
cells, the sums meet in an aggregation by place, and Adam moves the weights on the driver. Masks and
batches follow a hash of seed, epoch and cell, so a step doesn't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import random_mask


@dataclass(frozen=True)
class Model:
    genes: int
    width: int = 48
    inner: int = 96
    heads: int = 4
    layers: int = 2

    def __post_init__(self) -> None:
        if self.genes < 1 or self.width % self.heads:
            raise ValueError("the width must be a multiple of the heads")

    def shapes(self) -> dict[str, tuple[int, ...]]:
        d, f = self.width, self.inner
        out = {"value": (d,), "bias": (d,), "gene": (self.genes, d), "mask": (d,), "pool": (d,), "head_token": (d,), "head_cell": (d,), "head_bias": (1,)}
        for i in range(self.layers):
            out |= {f"{i}.{k}": s for k, s in (("g1", (d,)), ("b1", (d,)), ("q", (d, d)), ("k", (d, d)), ("v", (d, d)), ("o", (d, d)), ("g2", (d,)), ("b2", (d,)), ("in", (d, f)), ("in_b", (f,)), ("out", (f, d)), ("out_b", (d,)))}
        return out

    def start(self, seed: int) -> np.ndarray:
        """Weights as one flat array."""
        rng, parts = np.random.default_rng(seed), []
        for name, shape in self.shapes().items():
            kind = name.split(".")[-1]
            one = np.ones(shape) if kind in ("g1", "g2") else np.zeros(shape) if kind in ("b1", "b2", "in_b", "out_b", "head_bias", "bias") else rng.normal(0, shape[0] ** -0.5, shape)
            parts.append(one.ravel())
        return np.concatenate(parts)

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            n = int(np.prod(shape))
            out[name], at = flat[at : at + n].reshape(shape), at + n
        return out


class Var:
    """A value that remembers how it was made; grad() runs back through what it was made from."""

    def __init__(self, value: np.ndarray, parents: tuple[tuple[Var, Callable[[np.ndarray], np.ndarray]], ...] = ()):
        self.value, self.parents, self.slope = value, parents, None

    def __add__(self, o: Var) -> Var:
        return Var(self.value + o.value, ((self, lambda g: fit(g, self.value)), (o, lambda g: fit(g, o.value))))

    def __mul__(self, o: Var) -> Var:
        return Var(self.value * o.value, ((self, lambda g: fit(g * o.value, self.value)), (o, lambda g: fit(g * self.value, o.value))))

    def __matmul__(self, o: Var) -> Var:
        flip = lambda a: np.swapaxes(a, -1, -2)
        return Var(self.value @ o.value, ((self, lambda g: fit(g @ flip(o.value), self.value)), (o, lambda g: fit(flip(self.value) @ g, o.value))))

    def shaped(self, *shape: int) -> Var:
        return Var(self.value.reshape(shape), ((self, lambda g: g.reshape(self.value.shape)),))

    def swapped(self, a: int, b: int) -> Var:
        return Var(np.swapaxes(self.value, a, b), ((self, lambda g: np.swapaxes(g, a, b)),))

    def relu(self) -> Var:
        return Var(np.maximum(self.value, 0), ((self, lambda g: g * (self.value > 0)),))

    def softmax(self) -> Var:
        e = np.exp(self.value - self.value.max(-1, keepdims=True))
        p = e / e.sum(-1, keepdims=True)
        return Var(p, ((self, lambda g: p * (g - (g * p).sum(-1, keepdims=True))),))

    def normed(self) -> Var:
        c = self.value - self.value.mean(-1, keepdims=True)
        s = 1 / np.sqrt((c * c).mean(-1, keepdims=True) + 1e-5)
        n = c * s
        return Var(n, ((self, lambda g: s * (g - g.mean(-1, keepdims=True) - n * (g * n).mean(-1, keepdims=True))),))

    def grad(self, slope: np.ndarray) -> None:
        order, seen = [], set()

        def visit(v: Var) -> None:
            if id(v) not in seen:
                seen.add(id(v))
                for p, _ in v.parents:
                    visit(p)
                order.append(v)

        visit(self)
        self.slope = slope
        for v in reversed(order):
            for p, back in v.parents:
                g = back(v.slope)
                p.slope = g if p.slope is None else p.slope + g


def fit(g: np.ndarray, like: np.ndarray) -> np.ndarray:
    """g summed over the axes along which `like` was repeated."""
    g = g.sum(tuple(range(g.ndim - like.ndim))) if g.ndim > like.ndim else g
    axes = tuple(i for i, n in enumerate(like.shape) if n == 1 and g.shape[i] != 1)
    return g.sum(axes, keepdims=True) if axes else g


def forward(m: Model, w: dict[str, Var], x: np.ndarray, mask: np.ndarray) -> tuple[Var, Var]:
    """Predictions (cells x genes) and cell embeddings (cells x width)."""
    n, g = x.shape
    d, h = m.width, m.heads
    t = Var((x * ~mask)[..., None]) * w["value"] + w["bias"] + w["gene"] + Var(mask[..., None].astype(float)) * w["mask"]
    cut = lambda v: v.shaped(n, g, h, d // h).swapped(1, 2)
    for i in range(m.layers):
        a = t.normed() * w[f"{i}.g1"] + w[f"{i}.b1"]
        q, k, v = (cut(a @ w[f"{i}.{c}"]) for c in "qkv")
        p = (q @ k.swapped(-1, -2) * Var(np.array((d // h) ** -0.5))).softmax()
        t = t + (p @ v).swapped(1, 2).shaped(n, g, d) @ w[f"{i}.o"]
        a = t.normed() * w[f"{i}.g2"] + w[f"{i}.b2"]
        t = t + (a @ w[f"{i}.in"] + w[f"{i}.in_b"]).relu() @ w[f"{i}.out"] + w[f"{i}.out_b"]
    pool = (t @ w["pool"].shaped(d, 1)).shaped(n, 1, g).softmax()
    cell = (pool @ t).shaped(n, d)
    return (t @ w["head_token"].shaped(d, 1)).shaped(n, g) + cell @ w["head_cell"].shaped(d, 1) + w["head_bias"], cell


def loss_and_slopes(m: Model, flat: np.ndarray, x: np.ndarray, mask: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Sum of squared errors at masked entries, their number, and the slopes of the sum."""
    w = {k: Var(v) for k, v in m.split(flat).items()}
    out, _ = forward(m, w, x, mask)
    gap = (out.value - x) * mask
    out.grad(2 * gap)
    return float((gap * gap).sum()), float(mask.sum()), np.concatenate([(v.slope if v.slope is not None else np.zeros_like(v.value)).ravel() for v in w.values()])


def train(rows: DataFrame, m: Model, epochs: int, batches: int = 1, probability: float = 0.15, rate: float = 1e-3, seed: int = 168, at_once: int = 64) -> tuple[np.ndarray, list[float]]:
    """Weights and the loss of each epoch, from rows(cell, v) with standardized values.

    A step is one job over the cells of its batch; the loss is the mean square over masked entries.
    """
    flat, losses = m.start(seed), []
    first, second, step = np.zeros_like(flat), np.zeros_like(flat), 0
    held = rows.select("cell", "v").persist()
    for epoch in range(epochs):
        total = np.zeros(2)
        for b in range(batches):
            weights = rows.sparkSession.sparkContext.broadcast(flat)

            def add(frames: Iterator[pd.DataFrame], weights=weights) -> Iterator[pd.DataFrame]:
                sums = np.zeros(len(weights.value) + 2)
                for f in frames:
                    for a in range(0, len(f), at_once):
                        part = f.iloc[a : a + at_once]
                        mask = np.stack(part["mask"].to_numpy()).astype(bool)
                        error, n, slopes = loss_and_slopes(m, weights.value, np.stack(part["v"].to_numpy()).astype(float), mask)
                        sums += np.concatenate([[error, n], slopes])
                yield pd.DataFrame({"place": np.arange(len(sums)), "total": sums})

            batch = held.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "cell"), F.lit(batches)) == b)
            batch = batch.select("v", random_mask("cell", m.genes, probability, seed, epoch).alias("mask"))
            sums = batch.mapInPandas(add, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").toPandas()["total"].to_numpy()
            weights.unpersist()
            total, step = total + sums[:2], step + 1
            slopes = sums[2:] / (sums[1] + 1e-8)
            first, second = 0.9 * first + 0.1 * slopes, 0.999 * second + 0.001 * slopes**2
            flat = flat - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        losses.append(float(total[0] / (total[1] + 1e-8)))
    held.unpersist()
    return flat, losses


def infer(rows: DataFrame, m: Model, flat: np.ndarray, chunk: int = 8, at_once: int = 32) -> DataFrame:
    """(cell, embedding, reconstruction, residual): one pass without a mask gives the embedding; then genes
    are masked chunk by chunk and only the predictions of masked ones are kept."""
    weights = rows.sparkSession.sparkContext.broadcast(flat)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = {k: Var(v) for k, v in m.split(weights.value).items()}
        for f in frames:
            for a in range(0, len(f), at_once):
                part = f.iloc[a : a + at_once]
                x = np.stack(part["v"].to_numpy()).astype(float)
                _, cell = forward(m, w, x, np.zeros(x.shape, bool))
                made = np.zeros_like(x)
                for g in range(0, m.genes, chunk):
                    mask = np.zeros(x.shape, bool)
                    mask[:, g : g + chunk] = True
                    made[mask] = forward(m, w, x, mask)[0].value[mask]
                yield pd.DataFrame({"cell": part["cell"], "embedding": list(cell.value), "reconstruction": list(made), "residual": list(x - made)})

    kind = rows.schema["cell"].dataType.simpleString()
    return rows.select("cell", "v").mapInPandas(run, f"cell {kind}, embedding array<double>, reconstruction array<double>, residual array<double>")
