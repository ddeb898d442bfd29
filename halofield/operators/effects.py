"""Source-target effects: screening, sparse regression from sums, prediction, attribution.

Rows are wide for the fit: x (fields of all sources), y (residuals of all targets), p (membership).
With fixed weights everything a fit needs is in the weighted means, covariances and variances of its
group, so cells are read once however many targets and steps there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from .matrix import unpack_gram, weighted_gram

EFFECTS = "receiver_group int, source int, target int, screening_signed_effect double, screening_score double, signed_beta double, intercept double, training_improvement double"


@dataclass(frozen=True)
class SparseEffects:
    l1: float = 0.03
    l2: float = 0.05
    steps: int = 60
    tolerance: float = 1e-6
    sources_per_target: int = 8
    minimum_training_improvement: float = 0.0

    def __post_init__(self) -> None:
        if min(self.l1, self.l2, self.tolerance) < 0 or self.steps < 1 or self.sources_per_target < 1:
            raise ValueError("penalties must not be negative; steps and sources must be positive")


def descend(gram: np.ndarray, cross: np.ndarray, c: SparseEffects) -> np.ndarray:
    """Elastic-net coefficients by coordinate descent on a covariance matrix and a covariance vector."""
    b, diagonal = np.zeros(len(cross)), np.diag(gram)
    for _ in range(c.steps):
        largest = 0.0
        for j in range(len(b)):
            rho = cross[j] - gram[j] @ b + diagonal[j] * b[j]
            new = np.sign(rho) * max(abs(rho) - c.l1, 0.0) / max(c.l2 + diagonal[j], 1e-12)
            largest, b[j] = max(largest, abs(new - b[j])), new
        if largest < c.tolerance:
            break
    return b


def fit_group(m: dict[str, np.ndarray], c: SparseEffects) -> pd.DataFrame:
    """The effects of one group from its moments. A gene is no source of itself where both lists are one."""
    nx, ny = m["cross"].shape
    signed = m["cross"] / (np.diag(m["gram"]) + 1e-12)[:, None]
    score = np.abs(m["cross"]) / np.sqrt(np.diag(m["gram"]) + 1e-12)[:, None]
    if nx == ny:
        np.fill_diagonal(signed, 0.0)
        np.fill_diagonal(score, 0.0)
    beta, improvement = np.zeros((nx, ny)), np.zeros(ny)
    for t in range(ny):
        order = np.lexsort((np.arange(nx), -score[:, t]))
        chosen = [s for s in order if not (nx == ny and s == t)][: c.sources_per_target]
        g, x = m["gram"][np.ix_(chosen, chosen)], m["cross"][chosen, t]
        b = descend(g, x, c)
        v = m["variance_y"][t]
        improvement[t] = 1 - (v - 2 * b @ x + b @ g @ b) / v if v > 1e-12 else 0.0
        if improvement[t] >= c.minimum_training_improvement:
            beta[chosen, t] = b
    intercept = m["mean_y"] - m["mean_x"] @ beta
    s, t = np.indices((nx, ny)).reshape(2, -1)
    return pd.DataFrame({"source": s, "target": t, "screening_signed_effect": signed.ravel(), "screening_score": score.ravel(), "signed_beta": beta.ravel(), "intercept": intercept[t], "training_improvement": improvement[t]})


def fit_effects(rows: DataFrame, n_sources: int, n_targets: int, config: SparseEffects = SparseEffects()) -> DataFrame:
    """The effects of every (group, source, target) from rows(x, y, p); one task fits a group."""

    def fit(frames):
        for f in frames:
            for g, sums in zip(f["receiver_group"], f["sums"]):
                out = fit_group(unpack_gram(np.asarray(sums), n_sources, n_targets), config)
                out.insert(0, "receiver_group", g)
                yield out

    return weighted_gram(rows, n_sources, n_targets).mapInPandas(fit, EFFECTS)


def screen(long: DataFrame, by: list[str]) -> DataFrame:
    """signed effect cov / var and score |cov| / sqrt(var) of (by..., source, target) from rows(by..., source, target, x, y[, p])."""
    p = F.col("p") if "p" in long.columns else F.lit(1.0)
    w = lambda v: F.sum(p * v) / F.sum(p)
    x, y = F.col("x"), F.col("y")
    m = long.groupBy(*by, "source", "target").agg(w(x).alias("mx"), w(y).alias("my"), w(x * y).alias("xy"), w(x * x).alias("xx"))
    m = m.withColumn("cov", F.col("xy") - F.col("mx") * F.col("my")).withColumn("var", F.greatest(F.col("xx") - F.col("mx") * F.col("mx"), F.lit(0.0)) + 1e-12)
    return m.select(*by, "source", "target", (F.col("cov") / F.col("var")).alias("screening_signed_effect"), (F.abs("cov") / F.sqrt("var")).alias("screening_score"))


def with_attention(effects: DataFrame) -> DataFrame:
    """derived_attention: the share of |beta| in its group and target, 0 without any; selected: beta is not 0."""
    total = F.sum(F.abs("signed_beta")).over(Window.partitionBy("receiver_group", "target"))
    return effects.withColumn("derived_attention", F.when(total > 0, F.abs("signed_beta") / total).otherwise(0.0)).withColumn("selected", F.col("signed_beta") != 0)


def predict(fields: DataFrame, membership: DataFrame, effects: DataFrame) -> DataFrame:
    """(cell, target, predicted) from long fields(cell, gene, z), membership(cell, receiver_group, p) and effects."""
    slopes = membership.where("p > 0").join(fields.withColumnRenamed("gene", "source"), "cell").join(effects.where("signed_beta <> 0").select("receiver_group", "source", "target", "signed_beta"), ["receiver_group", "source"])
    sums = slopes.groupBy("cell", "target").agg(F.sum(F.col("p") * F.col("z") * F.col("signed_beta")).alias("s"))
    base = membership.where("p > 0").join(effects.select("receiver_group", "target", "intercept").distinct(), "receiver_group").groupBy("cell", "target").agg(F.sum(F.col("p") * F.col("intercept")).alias("a"))
    return base.join(sums, ["cell", "target"], "left").select("cell", "target", (F.col("a") + F.coalesce("s", F.lit(0.0))).alias("predicted"))


def contributions(fields: DataFrame, membership: DataFrame, effects: DataFrame) -> DataFrame:
    """(cell, source, target, effective_beta, contribution): the mean slope over a cell's groups, and slope times field."""
    b = membership.where("p > 0").join(effects.where("signed_beta <> 0"), "receiver_group").groupBy("cell", "source", "target").agg(F.sum(F.col("p") * F.col("signed_beta")).alias("effective_beta"))
    return b.join(fields.withColumnRenamed("gene", "source"), ["cell", "source"]).withColumn("contribution", F.col("effective_beta") * F.col("z")).select("cell", "source", "target", "effective_beta", "contribution")


def score_tables(effects: DataFrame, per_target: int = 10) -> tuple[DataFrame, DataFrame]:
    """target_scores and source_target_scores: ranks are row numbers, equal values in the order of genes."""
    e = with_attention(effects).withColumn("source_rank", F.row_number().over(Window.partitionBy("receiver_group", "target").orderBy(F.desc("screening_score"), "source")))
    best = e.where("source_rank = 1").select("receiver_group", "target", "training_improvement", F.col("source").alias("best_source"), F.col("screening_score").alias("best_source_score"))
    targets = best.withColumn("target_rank", F.row_number().over(Window.partitionBy("receiver_group").orderBy(F.desc("training_improvement"), "target")))
    sources = e.where(F.col("source_rank") <= per_target).join(targets.select("receiver_group", "target", "target_rank"), ["receiver_group", "target"])
    names = ["receiver_group", "target", "source", "target_rank", "source_rank", "screening_signed_effect", "screening_score", "signed_beta", "derived_attention", "selected", "training_improvement"]
    return targets.select("receiver_group", "target", "target_rank", "training_improvement", "best_source", "best_source_score"), sources.select(names)


def fold_moments(rows: DataFrame, folds: int, n_sources: int, n_targets: int) -> DataFrame:
    """Sums of every (fold, group), where rows also have `fold`: as groups fold * k + g."""
    k = F.size("p")
    spread = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: F.transform("p", lambda v: F.when(F.col("fold") == f, v).otherwise(0.0))))
    sums = weighted_gram(rows.select("x", "y", spread.alias("p")), n_sources, n_targets)
    groups = rows.select(k.alias("k")).limit(1)
    return sums.crossJoin(F.broadcast(groups)).select((F.col("receiver_group") / F.col("k")).cast("int").alias("fold"), (F.col("receiver_group") % F.col("k")).alias("receiver_group"), "sums")


def held_out_error(moments: DataFrame, n_sources: int, n_targets: int, config: SparseEffects | None = SparseEffects()) -> DataFrame:
    """(n, sse): values of all held-out folds and their squared error, each fold predicted by its group's fit on the others.

    moments as from fold_moments, of hard groups; config None predicts the groups' means. A group without a
    training cell predicts 0. A task has the folds of one group.
    """

    def judge(f: pd.DataFrame) -> pd.DataFrame:
        sums = {int(k): np.asarray(v, float) for k, v in zip(f["fold"], f["sums"])}
        total, n, sse = sum(sums.values()), 0.0, 0.0
        for held in sums.values():
            if held[0] <= 0:
                continue
            test, left = unpack_gram(held, n_sources, n_targets), total - held
            a, b = np.zeros(n_targets), np.zeros((n_sources, n_targets))
            if left[0] > 0.5:
                train = unpack_gram(left, n_sources, n_targets)
                if config is not None:
                    b = fit_group(train, config)["signed_beta"].to_numpy().reshape(n_sources, n_targets)
                a = train["mean_y"] - train["mean_x"] @ b
            gap = test["mean_y"] - a - test["mean_x"] @ b
            n += held[0] * n_targets
            sse += held[0] * (test["variance_y"] - 2 * (b * test["cross"]).sum(0) + (b * (test["gram"] @ b)).sum(0) + gap**2).sum()
        return pd.DataFrame({"n": [n], "sse": [sse]})

    return moments.groupBy("receiver_group").applyInPandas(judge, "n double, sse double").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"))


def held_out_triplets(moments: DataFrame, triplets: DataFrame, n_sources: int, n_targets: int, config: SparseEffects = SparseEffects()) -> DataFrame:
    """For each fold and triplet(receiver_group, source, target) the held-out error of the group's mean, of
    the fit, and of the fit without the source; and how much the source adds.

    The training sums of a fold are the total less the fold. A task has the folds of one group.
    """
    wanted = triplets.groupBy("receiver_group").agg(F.collect_set(F.struct("source", "target")).alias("triplets"))
    by_group = moments.groupBy("receiver_group").agg(F.collect_list(F.struct("fold", "sums")).alias("folds")).join(wanted, "receiver_group")

    def validate(frames):
        for f in frames:
            for g, folds, chosen in zip(f["receiver_group"], f["folds"], f["triplets"]):
                sums = {int(x["fold"]): np.asarray(x["sums"]) for x in folds}
                total, out = sum(sums.values()), []
                for fold, held in sorted(sums.items()):
                    if held[0] <= 0 or total[0] - held[0] <= 0:
                        continue
                    train, test = unpack_gram(total - held, n_sources, n_targets), unpack_gram(held, n_sources, n_targets)
                    score = np.abs(train["cross"]) / np.sqrt(np.diag(train["gram"]) + 1e-12)[:, None]
                    for s, t in sorted((int(x["source"]), int(x["target"])) for x in chosen):
                        order = [i for i in np.lexsort((np.arange(n_sources), -score[:, t])) if not (n_sources == n_targets and i == t)]
                        full = sorted({*order[: config.sources_per_target], s})
                        errors = []
                        for use in (full, [i for i in full if i != s]):
                            b = np.zeros(n_sources)
                            b[use] = descend(train["gram"][np.ix_(use, use)], train["cross"][use, t], config)
                            gap = test["mean_y"][t] - train["mean_y"][t] - (test["mean_x"] - train["mean_x"]) @ b
                            errors.append(test["variance_y"][t] - 2 * b @ test["cross"][:, t] + b @ test["gram"] @ b + gap * gap)
                        base = test["variance_y"][t] + (test["mean_y"][t] - train["mean_y"][t]) ** 2
                        out.append([g, s, t, fold, held[0], base, *errors, 1 - errors[0] / base if base > 0 else 0.0, (errors[1] - errors[0]) / base if base > 0 else 0.0])
                if out:
                    yield pd.DataFrame(out, columns=["receiver_group", "source", "target", "fold", "mass", "baseline_mse", "full_mse", "without_source_mse", "full_improvement", "incremental_improvement"])

    return by_group.mapInPandas(validate, "receiver_group int, source int, target int, fold int, mass double, baseline_mse double, full_mse double, without_source_mse double, full_improvement double, incremental_improvement double")


def stability(rows: DataFrame, triplets: DataFrame, repeats: int, fraction: float, seed: int, n_sources: int, n_targets: int, config: SparseEffects = SparseEffects()) -> DataFrame:
    """Refits on random parts of the cells: (repeat, triplet, signed_beta, source_rank), all repeats in one pass.

    A cell is in a repeat by a hash of seed, repeat and cell. rows also have `cell`.
    """
    k = rows.select(F.size("p").alias("k")).first()["k"]
    inside = lambda r: uniform(seed, r.cast("string"), "cell") < fraction
    spread = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(repeats)), lambda r: F.transform("p", lambda v: F.when(inside(r), v).otherwise(0.0))))
    effects = fit_effects(rows.select("x", "y", spread.alias("p")), n_sources, n_targets, config)
    e = effects.withColumn("repeat", (F.col("receiver_group") / k).cast("int") + 1).withColumn("receiver_group", F.col("receiver_group") % k)
    e = e.withColumn("source_rank", F.rank().over(Window.partitionBy("repeat", "receiver_group", "target").orderBy(F.desc(F.abs("signed_beta")))))
    return e.join(triplets, ["receiver_group", "source", "target"], "left_semi").select("repeat", "receiver_group", "source", "target", "signed_beta", "source_rank")
