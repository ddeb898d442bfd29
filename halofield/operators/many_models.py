"""Receiver groups for several counts and folds at once: every step is one scan for all models together.

A model is a count of groups with a held-out fold (-1: none). What a scan needs of the models, their centres,
heats and effects, is some thousand numbers a model and goes out with the task; what comes back is a
row of sums a task, model and group, so neither side grows with the cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import draw
from ..sources.store import written
from .effects import SparseEffects, fit_group
from .matrix import unpack_gram
from .ordered import order_statistics

#: Rows that centres are first drawn from, and numbers of a task's sums at most (2 GB would be 256 million).
SAMPLE, MOST_SUMS = 5_000, 30_000_000


@dataclass(frozen=True)
class Model:
    count: int
    fold: int
    restart: int = 0


def squared(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((v - c) ** 2).sum(1) for c in centres], 1)


def first_centres(sample: np.ndarray, count: int, seed: int) -> np.ndarray:
    """k-means++ on a sample."""
    rng = np.random.default_rng(seed)
    chosen = [sample[rng.integers(len(sample))]]
    for _ in range(count - 1):
        gap = squared(sample, np.array(chosen)).min(1)
        chosen.append(sample[rng.choice(len(sample), p=gap / gap.sum()) if gap.sum() > 0 else rng.integers(len(sample))])
    return np.array(chosen)


def summed(rows: DataFrame, columns: list[str], add: Callable[[pd.DataFrame], dict[tuple[int, int], np.ndarray]]) -> DataFrame:
    """(model, part, sums) over all rows, of what add makes of a batch: an array for each (model, part)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for f in frames:
            if len(f):
                for key, sums in add(f).items():
                    total[key] = total[key] + sums if key in total else sums
        for (model, part), sums in total.items():
            yield pd.DataFrame({"model": model, "part": part, "at": np.arange(len(sums)), "value": sums})

    parts = rows.select(*columns).mapInPandas(run, "model int, part int, at int, value double").groupBy("model", "part", "at").agg(F.sum("value").alias("value"))
    return parts.groupBy("model", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("sums"))


def matrix_of(f: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack(f[column].to_numpy()).astype(float)


def fitted_centres(rows: DataFrame, models: list[Model], iterations: int = 100, seed: int = 168) -> list[np.ndarray]:
    """The centres of each model over rows(cell, fold, v) outside its fold, in the order of their coordinates.

    All models take their Lloyd steps in one scan a step, until no centre moves or iterations are done. They start from k-means++ on a
    sample of SAMPLE rows by hash; every step and the centres follow all rows. An empty group keeps its centre.
    """
    sample = rows.select("fold", "v", draw(seed, "cell").alias("h"), "cell").orderBy("h", "cell").limit(SAMPLE).collect()
    fold, v = np.array([r["fold"] for r in sample]), np.array([r["v"] for r in sample], float)
    centres = [first_centres(v[fold != m.fold], m.count, seed + m.count * 100 + m.fold + 7919 * m.restart) for m in models]
    moving = set(range(len(models)))
    for _ in range(iterations):
        at = {i: centres[i] for i in moving}

        def step(f: pd.DataFrame, at: dict = at) -> dict[tuple[int, int], np.ndarray]:
            v, fold, out = matrix_of(f, "v"), f["fold"].to_numpy(), {}
            for i, c in at.items():
                some = v[fold != models[i].fold]
                near = squared(some, c).argmin(1) if len(some) else np.zeros(0, int)
                for g in np.unique(near):
                    out[i, int(g)] = np.append((near == g).sum(), some[near == g].sum(0))
            return out

        new = {i: c.copy() for i, c in at.items()}
        for r in summed(rows, ["fold", "v"], step).collect():  # a row a model and group
            new[r["model"]][r["part"]] = np.array(r["sums"][1:]) / r["sums"][0]
        moving = {i for i in at if np.abs(new[i] - at[i]).max() > 1e-12}
        for i in at:
            centres[i] = new[i]
        if not moving:
            break
    return [np.array(sorted(c.tolist())) for c in centres]


def best_restarts(rows: DataFrame, models: list[Model], centres: list[np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """The centres with the least sum of squared distances of each (count, fold)."""

    def cost(f: pd.DataFrame) -> dict[tuple[int, int], np.ndarray]:
        v, fold = matrix_of(f, "v"), f["fold"].to_numpy()
        return {(i, 0): np.array([squared(v[fold != m.fold], c).min(1).sum()]) for i, (m, c) in enumerate(zip(models, centres))}

    loss = {r["model"]: r["sums"][0] for r in summed(rows, ["fold", "v"], cost).collect()}
    out: dict[tuple[int, int], int] = {}
    for i, m in enumerate(models):
        if (m.count, m.fold) not in out or loss[i] < loss[out[m.count, m.fold]]:
            out[m.count, m.fold] = i
    return {key: centres[i] for key, i in out.items()}


def heats(rows: DataFrame, centres: dict[tuple[int, int], np.ndarray], floor: float = 1e-3) -> dict[tuple[int, int], float]:
    """The heat of each model: the upper median of its training rows' gaps between the two least squared distances."""
    models = [k for k in centres if k[0] > 1]

    def gaps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v, fold = matrix_of(f, "v") if len(f) else None, f["fold"].to_numpy()
            for i, key in enumerate(models):
                some = v[fold != key[1]] if v is not None else []
                if len(some):
                    two = np.partition(squared(some, centres[key]), 1, axis=1)[:, :2]
                    yield pd.DataFrame({"model": i, "gap": two[:, 1] - two[:, 0]})

    out = dict.fromkeys(centres, floor)
    if models:
        all_gaps = written(rows.select("fold", "v").mapInPandas(gaps, "model int, gap double"))
        for r in order_statistics(all_gaps, "gap", lambda n: [F.floor(n / 2)], ["model"]).collect():
            out[models[r["model"]]] = max(r["at"][0], floor)
    return out


def memberships(v: np.ndarray, centres: np.ndarray, heat: float) -> np.ndarray:
    logits = -squared(v, centres) / heat
    e = np.exp(np.maximum(logits - logits.max(1, keepdims=True), -60))
    return e / e.sum(1, keepdims=True)


def judged(rows: DataFrame, centres: dict[tuple[int, int], np.ndarray], heat: dict[tuple[int, int], float], nx: int, ny: int, config: SparseEffects) -> DataFrame:
    """(count, fold, baseline_mse, physical_mse, active, minimum_mass) of each model on the fold it hasn't seen.

    rows(fold, v, x, y). One scan sums up the weighted moments of all groups of all models (several if they are more than
    MOST_SUMS numbers, whatever the number of rows), one task a model fits its effects, and one more scan predicts
    the held-out rows: the memberships' mean of the groups' predictions.
    """
    keys = list(centres)
    size = 1 + nx + ny + nx * nx + nx * ny + ny
    shares: list[list[int]] = [[]]
    for i, key in enumerate(keys):
        if shares[-1] and (sum(keys[j][0] for j in shares[-1]) + key[0]) * size > MOST_SUMS:
            shares.append([])
        shares[-1].append(i)

    def moments(share: list[int]) -> Callable[[pd.DataFrame], dict[tuple[int, int], np.ndarray]]:
        def add(f: pd.DataFrame) -> dict[tuple[int, int], np.ndarray]:
            v, x, y, fold, out = matrix_of(f, "v"), matrix_of(f, "x"), matrix_of(f, "y"), f["fold"].to_numpy(), {}
            for i in share:
                seen = fold != keys[i][1]
                xs, ys = x[seen], y[seen]
                for g, w in enumerate(memberships(v[seen], centres[keys[i]], heat[keys[i]]).T):
                    out[i, g] = np.concatenate([[w.sum()], w @ xs, w @ ys, ((xs * w[:, None]).T @ xs).ravel(), ((xs * w[:, None]).T @ ys).ravel(), w @ (ys * ys)])
            return out

        return add

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for group, sums in zip(f["part"], f["sums"]):
            if sums[0] > 0:
                e = fit_group(unpack_gram(np.asarray(sums), nx, ny), config)
                b = e[e["signed_beta"] != 0]
                out.append(pd.DataFrame({"source": b["source"], "target": b["target"], "value": b["signed_beta"], "group": group}))
                a = e.drop_duplicates("target")
                out.append(pd.DataFrame({"source": -1, "target": a["target"], "value": a["intercept"], "group": group}))
            out.append(pd.DataFrame({"source": [-2], "target": [-1], "value": [sums[0]], "group": [group]}))
        return pd.concat(out).assign(model=f["model"].iloc[0])[["model", "group", "source", "target", "value"]]

    parts = [summed(rows, ["fold", "v", "x", "y"], moments(share)) for share in shares]
    all_sums = parts[0]
    for p in parts[1:]:
        all_sums = all_sums.unionByName(p)
    found = written(all_sums.groupBy("model").applyInPandas(fit, "model int, group int, source int, target int, value double"))
    # non-zero effects: at most sources_per_target a target, group and model
    n = found.count()
    if n > MOST_SUMS:
        raise ValueError(f"{n} effects of all models are too many to go out with tasks")
    effects = found.toPandas()
    slopes, base = {}, {}
    for i, (count, _) in enumerate(keys):
        e = effects[effects["model"] == i]
        slopes[i], base[i] = [], np.zeros((count, ny))
        a = e[e["source"] == -1]
        base[i][a["group"], a["target"]] = a["value"]
        for g in range(count):
            b = e[(e["group"] == g) & (e["source"] >= 0)]
            slopes[i].append((b["source"].to_numpy(), b["target"].to_numpy(), b["value"].to_numpy()))

    def errors(f: pd.DataFrame) -> dict[tuple[int, int], np.ndarray]:
        v, x, y, fold, out = matrix_of(f, "v"), matrix_of(f, "x"), matrix_of(f, "y"), f["fold"].to_numpy(), {}
        for i, key in enumerate(keys):
            held = fold == key[1]
            if held.any():
                p = memberships(v[held], centres[key], heat[key])
                plain = p @ base[i]
                full = plain.copy()
                for g, (s, t, b) in enumerate(slopes[i]):
                    dense = np.zeros((nx, ny))
                    dense[s, t] = b
                    full += p[:, g : g + 1] * (x[held] @ dense)
                out[i, 0] = np.array([p.shape[0] * ny, ((y[held] - plain) ** 2).sum(), ((y[held] - full) ** 2).sum()])
        return out

    table = []
    for r in summed(rows, ["fold", "v", "x", "y"], errors).collect():  # a row a model
        e = effects[effects["model"] == r["model"]]
        n, plain, full = r["sums"]
        mass = e[e["source"] == -2]["value"]
        table.append((*keys[r["model"]], plain / n, full / n, float((e["source"] >= 0).sum()), float(mass.min())))
    return rows.sparkSession.createDataFrame(table, "count int, fold int, baseline_mse double, physical_mse double, active double, minimum_mass double")
