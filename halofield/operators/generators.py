"""Seeded synthetic tissue with planted relations, for tests and recovery studies. Not for large inputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def radial_tissue(spark: SparkSession, n: int = 1000, groups: int = 12, markers: int = 3, noise: int = 12, sources: int = 6, targets: int = 6, reach: float = 0.32, seed: int = 168) -> dict[str, DataFrame]:
    """cells(cell, x, y, group), expression(cell, gene, value), truth(target, receiver_group, source, sender_group).

    Groups are sectors of a disc. Genes are markers of each group, noise, sources that one sender group
    expresses, and targets: in its receiver group a target rises with the Hill response of the field
    that its source's senders make within reach.
    """
    rng = np.random.default_rng(seed)
    angle, radius = rng.uniform(0, 2 * np.pi, n), np.sqrt(rng.random(n))
    x, y = radius * np.cos(angle), radius * np.sin(angle)
    group = (angle / (2 * np.pi) * groups).astype(int)
    level = rng.gamma(2.0, 0.1, (n, groups * markers + noise + sources + targets))
    for g in range(groups):
        level[group == g, g * markers : (g + 1) * markers] += rng.gamma(4.0, 0.5, ((group == g).sum(), markers))
    first = groups * markers + noise
    gap = np.hypot(x[:, None] - x[None], y[:, None] - y[None])
    near = (gap <= reach) & (gap > 0)
    truth = []
    for t in range(targets):
        s, sender, receiver = t % sources, (2 * t) % groups, (2 * t + 1) % groups
        level[group == sender, first + s] += rng.gamma(4.0, 0.5, (group == sender).sum())
        field = (near * np.exp(-gap / (reach / 3))) @ level[:, first + s]
        h = (field / np.median(field)) ** 1.5
        level[:, first + sources + t] += np.where(group == receiver, 3 * h / (1 + h), 0)
        truth.append((first + sources + t, receiver, first + s, sender))
    cells = spark.createDataFrame([(i, float(a), float(b), int(g)) for i, (a, b, g) in enumerate(zip(x, y, group))], "cell long, x double, y double, group int")
    wide = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(level)], "cell long, v array<double>")
    expression = wide.select("cell", F.posexplode("v").alias("gene", "value")).withColumn("gene", F.col("gene").cast("long"))
    return {"cells": cells, "expression": expression, "truth": spark.createDataFrame(truth, "target long, receiver_group int, source long, sender_group int")}


def hierarchical_counts(spark: SparkSession, n: int = 600, groups: int = 4, relations: int = 3, dropout: float = 0.2, seed: int = 0) -> dict[str, DataFrame]:
    """Negative-binomial counts of ligands, receptors and targets with planted chains between groups.

    cells, expression(cell, gene, value) with gene names, truth(sender_group, ligand, receptor,
    receiver_group, target, effect) and candidates(ligand, receptor), every ligand with every receptor.
    """
    rng = np.random.default_rng(seed)
    x, group = rng.uniform(0, 10, (n, 2)), rng.integers(0, groups, n)
    names = [f"{k}{i}" for k in ("ligand", "receptor", "target") for i in range(relations)]
    mean = np.full((n, len(names)), 2.0)
    gap = np.hypot(*(x[:, None] - x[None]).transpose(2, 0, 1))
    truth = []
    for i in range(relations):
        sender, receiver, effect = i % groups, (i + 1) % groups, 2.0 + i
        mean[group == sender, i] += 8
        mean[group == receiver, relations + i] += 6
        signal = np.exp(-gap) @ (mean[:, i] * (group == sender)) * (group == receiver)
        mean[:, 2 * relations + i] += effect * signal / max(signal.max(), 1e-9) * 5
        truth.append((sender, names[i], names[relations + i], receiver, names[2 * relations + i], effect))
    counts = rng.negative_binomial(2, 2 / (2 + mean)) * (rng.random(mean.shape) >= dropout)
    expression = [(i, g, float(counts[i, j])) for i in range(n) for j, g in enumerate(names) if counts[i, j]]
    pairs = [(a, b) for a in names[:relations] for b in names[relations : 2 * relations]]
    return {"cells": spark.createDataFrame([(i, float(a), float(b), int(g)) for i, ((a, b), g) in enumerate(zip(x, group))], "cell long, x double, y double, group int"), "expression": spark.createDataFrame(expression, "cell long, gene string, value double"), "truth": spark.createDataFrame(truth, "sender_group int, ligand string, receptor string, receiver_group int, target string, effect double"), "candidates": spark.createDataFrame(pairs, "ligand string, receptor string")}


def partial_pairs(pairs: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """A database with gaps: of the true pairs only every other one (in order), and all that aren't true."""
    from pyspark.sql import Window

    true = truth.select(*key).distinct()
    kept = true.withColumn("_r", F.row_number().over(Window.orderBy(*key))).where("_r % 2 = 1").drop("_r")
    return pairs.join(true, key, "left_anti").select(*key).unionByName(kept)


def least_correlated(fields: DataFrame, primary: int) -> int:
    """The gene whose field is least correlated (by absolute value) with the primary one; ties: the first."""
    p = fields.where(F.col("gene") == primary).select("cell", F.col("field").alias("p"))
    r = fields.where(F.col("gene") != primary).join(p, "cell").groupBy("gene").agg(F.round(F.abs(F.corr("field", "p")), 12).alias("r"))
    return r.orderBy("r", "gene").first()["gene"]


def matched_markers(expression: DataFrame, groups: DataFrame, targets: dict[int, int], markers: int = 3, share: float = 0.9, seed: int = 168, loadings: tuple[float, ...] = (0.95, 1.05, 1.1)) -> DataFrame:
    """(cell, group, marker, value): marker genes of each group whose spread follows its target gene, without its spatial order.

    expression(cell, gene, value) is long, groups(cell, group), targets the target gene of each group. A
    cell gets the target's values of two other cells of its group, one shared by all markers and one of
    the marker's own, in parts of the variance share and 1 - share; the permutations follow hashes. The
    sum has the mean and, but for the loading, the variance of the target; values below 0 become 0.
    """
    from pyspark.sql import Window

    from ..functions.scalars import draw

    spark = expression.sparkSession
    of = spark.createDataFrame(list(targets.items()), "group int, gene long")
    own = groups.select("cell", F.col("group").cast("int").alias("group")).join(of, "group").join(expression, ["cell", "gene"], "left")
    own = own.select("cell", "group", F.coalesce("value", F.lit(0.0)).alias("value"))
    mean = own.groupBy("group").agg(F.avg("value").alias("mean"))
    place = F.row_number().over(Window.partitionBy("group").orderBy("cell"))
    shuffled = lambda name: F.row_number().over(Window.partitionBy("group", "marker").orderBy(draw(seed, F.lit(name), "marker", "cell"), "cell"))
    kinds = lambda lo, hi: own.withColumn("marker", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    shared = kinds(0, 0).select("group", shuffled("shared").alias("at"), F.col("value").alias("a"))
    special = kinds(0, markers - 1).select("group", "marker", shuffled("own").alias("at"), F.col("value").alias("b"))
    cells = own.select("cell", "group", place.alias("at"))
    drawn = cells.join(shared, ["group", "at"]).join(special, ["group", "at"]).join(mean, "group")
    loading = F.element_at(F.array(*map(F.lit, loadings)), F.col("marker") % len(loadings) + 1)
    program = float(share) ** 0.5 * (F.col("a") - F.col("mean")) + (1 - float(share)) ** 0.5 * (F.col("b") - F.col("mean"))
    return drawn.select("cell", "group", "marker", F.greatest(F.col("mean") + loading * program, F.lit(0.0)).alias("value"))
