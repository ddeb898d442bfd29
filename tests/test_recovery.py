"""Planted relations are found again; graph clusters against plain computations."""

import numpy as np
from pyspark.sql import functions as F

from halofield.operators import effects, generators, graphs, spatial
from halofield.plans import recovery
from halofield.plans.analysis import Analysis, fit_rows, source_fields


def test_planted_relations_are_recovered(spark):
    t = generators.radial_tissue(spark, n=500, groups=4, noise=4, sources=3, targets=4)
    cells, expression = t["cells"], t["expression"].cache()
    first = 4 * 3 + 4
    sources = expression.where((F.col("gene") >= first) & (F.col("gene") < first + 3))
    targets = expression.where(F.col("gene") >= first + 3)
    means = targets.join(cells.select("cell", "group"), "cell").groupBy("gene", "group").agg(F.avg("value").alias("m"))
    residual = targets.join(cells.select("cell", "group"), "cell").join(means, ["gene", "group"]).select("cell", "gene", (F.col("value") - F.col("m")).alias("value"))
    p = cells.select("cell", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda g: F.when(F.col("group") == g, 1.0).otherwise(0.0)).alias("p"))
    a = Analysis(length_scale=0.1, radius=0.32, min_distance=0.01)
    rows = fit_rows(source_fields(cells, sources, a), residual, p, cells.select("cell"))
    e = effects.fit_effects(rows, 3, 4, effects.SparseEffects(l1=0.0)).select("receiver_group", (F.col("source") + first).alias("source"), (F.col("target") + first + 3).alias("target"), F.col("screening_score").alias("score"))
    truth = t["truth"].drop("sender_group")
    m = recovery.recovery(e, truth).first()
    assert m.source_mrr > 0.6 and m.target_mrr > 0.6
    groups = cells.select("cell", ((F.col("group") + 1) % 4).alias("inferred"), F.col("group").alias("true"))
    moved, agree = recovery.mapped_effects(e.withColumn("receiver_group", (F.col("receiver_group") + 1) % 4), groups)
    assert agree.first().adjusted_rand == 1.0
    assert sorted(map(tuple, recovery.truth_ranks(moved, truth).select("target", "source_rank").collect())) == sorted(map(tuple, recovery.truth_ranks(e, truth).select("target", "source_rank").collect()))


def test_hierarchical_counts_and_partial_pairs(spark):
    t = generators.hierarchical_counts(spark, n=80)
    truth = {(r.ligand, r.receptor) for r in t["truth"].collect()}
    part = {tuple(r) for r in generators.partial_pairs(t["candidates"], t["truth"], ["ligand", "receptor"]).collect()}
    assert len(truth) == 3 and len(part & truth) == 2 and len(part - truth) == 6
    assert t["expression"].where("value <= 0").count() == 0


def test_density_clusters(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(0, 0.3, (40, 2)), rng.normal(5, 0.3, (40, 2)), [[2.5, 2.5], [9, 9]]])
    cells = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "cell long, x double, y double")
    got = {r.cell: r.cluster for r in graphs.density_clusters(cells, 0.4, 4).collect()}
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    core = (d <= 0.4).sum(1) >= 4
    label = np.arange(len(p))
    for _ in p:
        label = np.array([min(label[j] for j in range(len(p)) if core[j] and d[i, j] <= 0.4) if core[i] else label[i] for i in range(len(p))])
    for i in range(len(p)):
        near = [j for j in range(len(p)) if core[j] and d[i, j] <= 0.4]
        assert got[i] == (label[min(near, key=lambda j: (d[i, j], j))] if near else None)


def test_label_propagation_finds_cliques(spark):
    pairs = [(a, b) for base in (0, 10) for a in range(base, base + 5) for b in range(base, base + 5) if a < b] + [(4, 10)]
    got = {r.node: r.label for r in graphs.propagated_labels(spark.createDataFrame(pairs, "receiver int, sender int")).collect()}
    assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(11, 15)}) == 1 and got[0] != got[12]


def test_least_correlated(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 3))
    x[:, 1] += 2 * x[:, 0]
    f = spark.createDataFrame([(i, g, float(x[i, g])) for i in range(100) for g in range(3)], "cell long, gene int, field double")
    assert generators.least_correlated(f, 0) == 2 and spatial.AXES == ("x", "y", "z")
