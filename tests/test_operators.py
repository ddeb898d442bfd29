"""Operators against NumPy on literals and random tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halofield.functions import names, scalars
from halofield.functions.kernels import ReactionDiffusion, bessel_k0
from halofield.operators import edges, effects, fields, groups, matrix, panel, ranking, sampling, spatial, stats
from halofield.plans.analysis import Analysis, with_folds
from halofield.sources import config, readers, writers

CELLS = "cell long, x double, y double"


def cells(spark, points):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], CELLS)


def random_cells(spark, n=200, seed=1, dims=2):
    p = np.random.default_rng(seed).uniform(0, 10, (n, dims))
    return p, spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], CELLS + (", z double" if dims == 3 else ""))


# --- kernels and fields


def test_kernel_falls_with_distance(spark):
    for dims in (2, 3):
        k = ReactionDiffusion(diffusion=2.0, decay=0.5, production=3.0, min_distance=0.1, dims=dims)
        v = spark.range(1).select(*(k.column(f"{d}D").alias(n) for d, n in ((0.5, "a"), (2.0, "b"), (0.0, "c"), (0.1, "d")))).first()
        assert v["a"] > v["b"] > 0 and v["c"] == v["d"] and k.length == 2.0
    for bad in ({"diffusion": 0}, {"decay": -1}, {"production": math.nan}, {"dims": 4}):
        with pytest.raises(ValueError):
            ReactionDiffusion(**bad)


def test_bessel_against_an_integral(spark):
    t = np.linspace(0, 30, 300_001)
    for x in (0.02, 0.5, 1.9, 2.1, 5.0):
        f = np.exp(-x * np.cosh(t))
        want = ((f[1:] + f[:-1]) / 2).sum() * (t[1] - t[0])
        assert spark.range(1).select(F.expr(bessel_k0(f"{x}D")).alias("v")).first()["v"] == pytest.approx(want, rel=2e-7)


def test_radius_join_literals(spark):
    c = cells(spark, [(0, 0), (1, 0), (1.5, 0), (10, 0)])
    got = {(r.receiver, r.sender) for r in spatial.radius_join(c, c, 2.0).collect()}
    assert {s for r, s in got if r == 0} == {1, 2} and not {s for r, s in got if r == 3}
    edge = cells(spark, [(0, 0), (2, 0)])
    assert spatial.radius_join(edge, edge, 2.0).count() == 2  # the radius belongs to it
    cap = cells(spark, [(0, 0), (2, 0), (1, 0)])
    assert [r.sender for r in spatial.nearest(spatial.radius_join(cap, cap, 3.0), 1).where("receiver = 0").collect()] == [2]


def test_knn_join_of_clusters_far_apart(spark):
    """Two dense clusters and outliers: right neighbours, and bins fit the clusters, not their box."""
    rng = np.random.default_rng(11)
    at = np.vstack([rng.normal(0, 1, (300, 2)), rng.normal(1000, 1, (300, 2)), [[500.0, 500.0], [-300.0, 40.0]]])
    c = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "cell int, x double, y double")
    got = {(r.receiver, r["rank"]): r.sender for r in spatial.knn_join(c, c, 5).collect()}
    d = np.linalg.norm(at[:, None] - at[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, r + 1): int(j) for i in range(len(at)) for r, j in enumerate(np.argsort(d[i])[:5])}
    assert spatial.candidates(c, c, 5).count() < 20 * 5 * len(at)


def test_covariance_with_large_means(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 3)) + np.array([1e8, -3e8, 5.0])
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    n, mean, cov = matrix.covariance(rows, "v", 3)
    assert n == 400
    np.testing.assert_allclose(mean, x.mean(0), rtol=1e-12)
    np.testing.assert_allclose(cov, np.cov(x.T), rtol=1e-6, atol=1e-7)


@pytest.mark.parametrize("dims", [2, 3])
def test_radius_and_knn_join(spark, dims):
    p, c = random_cells(spark, dims=dims)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    got = {(r.receiver, r.sender) for r in spatial.radius_join(c, c, 1.3, dims).collect()}
    assert got == {(i, j) for i in range(200) for j in range(200) if i != j and d[i, j] <= 1.3}
    np.fill_diagonal(d, np.inf)
    for start in (None, 0.05):
        near = {(r.receiver, r["rank"]): r.sender for r in spatial.knn_join(c, c, 5, dims, start=start).collect()}
        assert near == {(i, k + 1): j for i in range(200) for k, j in enumerate(np.argsort(d[i], kind="stable")[:5])}
    few = spatial.knn_join(c.limit(3), c.limit(3), 5, dims)
    assert few.groupBy("receiver").count().collect() and few.count() == 6


def test_field_forms_are_equal(spark):
    p, c = random_cells(spark, 150)
    v = np.random.default_rng(2).random((150, 3)) * (np.random.default_rng(3).random((150, 3)) > 0.5)
    k = ReactionDiffusion.of_length(1.0, min_distance=0.05)
    long = spark.createDataFrame([(i, g, float(v[i, g])) for i in range(150) for g in range(3)], "cell long, gene int, value double")
    a = {(r.cell, r.gene): r.field for r in fields.source_field(fields.weigh(spatial.radius_join(c, c, 2.1), k), long).collect()}
    wide = spark.createDataFrame([(i, v[i].tolist()) for i in range(150)], "cell long, v array<double>")
    b = {r.cell: r.field for r in fields.dense_field(c.join(wide, "cell"), k, 2.1, tiles=2, block=7).collect()}
    assert len(b) == 150
    for i in range(150):
        for g in range(3):
            assert b[i][g] == pytest.approx(a.get((i, g), 0.0), abs=1e-9)


def test_mask_removes_only_entries_above_the_threshold(spark):
    f = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)], "cell long, gene int, field double")
    e = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.5), (1, 1, 2.0)], "cell long, gene int, value double")
    m = fields.masked(f, e, 0.5)
    assert [r.field for r in m.orderBy("cell", "gene").collect()] == [0, 2, 3, 0]
    assert tuple(fields.mask_summary(m).first()) == (4, 2, 0.5)
    assert [r.field for r in fields.masked(f, e, 99).orderBy("cell", "gene").collect()] == [1, 2, 3, 4]


def test_smoothing_keeps_mass(spark):
    d = spark.createDataFrame([(0, 0, 4.0), (9, 3, 2.0)], "bx long, by long, density double")
    assert fields.smoothed(d, 1.0).agg(F.sum("density")).first()[0] == pytest.approx(6.0)


# --- groups and effects


def test_soft_membership_and_labels(spark):
    e = spark.createDataFrame([(i, [float(i % 2), float(i)]) for i in range(4)], "cell long, v array<double>")
    m, centres, heat = groups.receiver_groups(e, "v", 2, restarts=2)
    rows = m.orderBy("cell").collect()
    assert all(sum(r.p) == pytest.approx(1.0) for r in rows) and len(centres) == 2 and heat > 0
    assert all(r.maximum_probability == max(r.p) and r.p[r.receiver_group] == max(r.p) for r in rows)
    tie = spark.createDataFrame([([0.5, 0.5, 0.0],)], "p array<double>").select(scalars.last_argmax(F.col("p")).alias("k"))
    assert tie.first()["k"] == 1
    gaps = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double")
    assert groups.upper_median(gaps, "v") == 3.0 and groups.upper_median(gaps.limit(0), "v") == 1e-3


def test_count_choice(spark):
    rows = [(2, f, 1.0, 0.8 + 0.02 * f, 3.0, 40.0) for f in range(3)] + [(3, f, 1.0, 0.79 + 0.02 * f, 5.0, 40.0) for f in range(3)] + [(4, f, 1.0, 0.1, 5.0, 10.0) for f in range(3)]
    t = {r["count"]: r for r in groups.choose_count(spark.createDataFrame(rows, "count int, fold int, baseline_mse double, physical_mse double, active double, minimum_mass double")).collect()}
    assert not t[4].eligible and [c for c in t if t[c].selected] == [2]


def test_programs(spark):
    x = np.random.default_rng(0).random((40, 5))
    x[:, 1] = 2 * x[:, 0]
    x[:, 3] = -x[:, 1] + 1
    long = spark.createDataFrame([(i, g, float(x[i, g])) for i in range(40) for g in range(5)], "cell long, gene int, value double")
    got = groups.programs(matrix.gene_correlations(long, "value"), long.select("gene").distinct(), 0.99)
    assert sorted((r.program, r.gene) for r in got.collect()) == [(0, 0), (0, 1), (0, 3)]


def numpy_fit(x, y, p, c):
    """Coordinate descent over the rows themselves."""
    m = p.sum()
    xc, yc = x - (p @ x) / m, y - (p @ y) / m
    var, cov = (p @ (xc * xc)) / m, (xc * p[:, None]).T @ yc / m
    order = np.argsort(-np.abs(cov) / np.sqrt(var + 1e-12), kind="stable")[: c.sources_per_target]
    b = np.zeros(x.shape[1])
    for _ in range(c.steps):
        biggest = 0.0
        for j in order:
            rho = (p * xc[:, j]) @ (yc - xc @ b + xc[:, j] * b[j]) / m
            new = np.sign(rho) * max(abs(rho) - c.l1, 0) / max(c.l2 + var[j], 1e-12)
            biggest, b[j] = max(biggest, abs(new - b[j])), new
        if biggest < c.tolerance:
            break
    r = yc - xc @ b
    return b, 1 - (p @ (r * r)) / (p @ (yc * yc))


def test_effects_from_sums_are_those_from_rows(spark):
    rng = np.random.default_rng(5)
    x, p = rng.normal(size=(300, 6)), rng.random((300, 2))
    y = x[:, :4] @ rng.normal(size=(4, 3)) + rng.normal(size=(300, 3))
    rows = spark.createDataFrame([(x[i].tolist(), y[i].tolist(), p[i].tolist()) for i in range(300)], "x array<double>, y array<double>, p array<double>").repartition(5)
    c = effects.SparseEffects(sources_per_target=4)
    got = {(r.receiver_group, r.source, r.target): r for r in effects.fit_effects(rows, 6, 3, c).collect()}
    assert len(got) == 2 * 6 * 3
    for g in range(2):
        for t in range(3):
            b, gain = numpy_fit(x, y[:, t], p[:, g], c)
            assert [got[g, s, t].signed_beta for s in range(6)] == pytest.approx(b, abs=1e-9)
            assert got[g, 0, t].training_improvement == pytest.approx(gain, abs=1e-9)
            residual = y[:, t] - got[g, 0, t].intercept - x @ b
            assert p[:, g] @ residual / p[:, g].sum() == pytest.approx(0, abs=1e-8)
    gated = effects.fit_effects(rows, 6, 3, effects.SparseEffects(minimum_training_improvement=2.0)).collect()
    assert all(r.signed_beta == 0 for r in gated) and any(r.training_improvement > 0 for r in gated)


def test_attention_and_no_self_effect(spark):
    e = spark.createDataFrame([(0, s, 0, b) for s, b in enumerate((1.0, -2.0, 0.0))] + [(1, 0, 0, 0.0)], "receiver_group int, source int, target int, signed_beta double")
    a = {(r.receiver_group, r.source): r.derived_attention for r in effects.with_attention(e).collect()}
    assert a[0, 1] == pytest.approx(2 / 3) and sum(v for (g, _), v in a.items() if g == 0) == pytest.approx(1) and a[1, 0] == 0
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(v.tolist(), v.tolist(), [1.0]) for v in rng.normal(size=(60, 3))], "x array<double>, y array<double>, p array<double>")
    assert all(r.signed_beta == 0 for r in effects.fit_effects(rows, 3, 3).where("source = target").collect())


def test_held_out_moments_are_those_of_the_training_rows(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(200, 4)), rng.normal(size=(200, 2))
    y[:, 0] += x[:, 1]
    rows = spark.createDataFrame([(i % 4, x[i].tolist(), y[i].tolist(), [1.0]) for i in range(200)], "fold int, x array<double>, y array<double>, p array<double>")
    t = spark.createDataFrame([(0, 1, 0), (0, 2, 0)], "receiver_group int, source int, target int")
    got = effects.held_out_triplets(effects.fold_moments(rows, 4, 4, 2), t, 4, 2).collect()
    assert len(got) == 8
    for r in got:
        test = np.arange(200) % 4 == r.fold
        b, _ = numpy_fit(x[~test], y[~test, 0], np.ones((~test).sum()), effects.SparseEffects())
        gap = y[test, 0] - y[~test, 0].mean() - (x[test] - x[~test].mean(0)) @ b
        assert r.full_mse == pytest.approx((gap * gap).mean(), abs=1e-9)
        assert r.baseline_mse == pytest.approx(((y[test, 0] - y[~test, 0].mean()) ** 2).mean(), abs=1e-9)
    assert np.mean([r.incremental_improvement for r in got if r.source == 1]) > 0.2 > np.mean([r.incremental_improvement for r in got if r.source == 2])


def test_pca(spark):
    x = np.random.default_rng(8).normal(size=(300, 5)) @ np.random.default_rng(9).normal(size=(5, 5))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)], "cell long, v array<double>").repartition(4)
    mean, projection = matrix.whitened_pca(df, "v", 5, 3)
    z = np.array([r.projected for r in matrix.projected(df, "v", mean, projection).orderBy("cell").collect()])
    assert np.allclose(np.cov(z.T), np.eye(3), atol=1e-8) and np.allclose(z.mean(0), 0, atol=1e-9)


# --- samples, ranks, panels


def test_samples(spark):
    df = spark.createDataFrame([(i, 0 if i < 4 else 1) for i in range(6)], "cell long, g int")
    assert sorted(r.cell for r in sampling.balanced(df, "g", "cell", 4).collect()) == [0, 2, 4, 5]
    big = spark.range(100).select(F.col("id").alias("cell"), F.when(F.col("id") < 90, "large").otherwise("small").alias("sample"))
    draw = lambda epoch: [r.cell for r in sampling.epoch_sample(big, "sample", "cell", 20, 5, 42, epoch).collect()]
    a, b, again = draw(3), draw(4), draw(3)
    assert a == again and a != b and len(set(a)) == 20 and sum(c >= 90 for c in a) >= 5
    taken = [r.taken for r in sampling.permuted(big, "cell", 1).orderBy("cell").collect()]
    assert sorted(taken) == list(range(100)) and taken != sorted(taken)
    for n, most in ((100, 30), (100, 100), (7, 100)):
        got = sorted(r.cell for r in sampling.systematic(big.where(F.col("cell") < n), "cell", n, most).collect())
        assert got == sorted({i * n // most for i in range(most)} if n > most else range(n))


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n in (1, 3, 7):
        for _ in range(10):
            c = rng.integers(-9, 9, (n, n)).astype(float)
            a = panel.assignment(c)
            assert sorted(a) == list(range(n)) and sum(c[i, a[i]] for i in range(n)) == min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(n)))


def test_fisher(spark):
    t = spark.createDataFrame([(8, 2, 1, 9), (1, 9, 8, 2), (5, 5, 5, 5), (0, 0, 0, 0)], "a long, b long, c long, d long").select(stats.fisher_exact("a", "b", "c", "d").alias("p")).collect()
    assert t[0].p < 0.01 and t[0].p == pytest.approx(t[1].p) and t[2].p == pytest.approx(1.0) and t[3].p == 1.0
    total, want = math.comb(20, 9), 0
    for k in range(10):
        if (w := math.comb(10, k) * math.comb(10, 9 - k)) <= math.comb(10, 8) * math.comb(10, 1) * (1 + 1e-10):
            want += w / total
    assert t[0].p == pytest.approx(want)


def test_tie_averaged_metrics_are_the_mean_over_all_orders(spark):
    import itertools

    rows = [("a", 3.0, True), ("a", 2.0, False), ("a", 2.0, True), ("a", 2.0, True), ("a", 2.0, False), ("a", 1.0, True), ("b", 5.0, False), ("b", 5.0, False), ("b", 5.0, True), ("b", 4.0, True), ("c", 1.0, False)]
    got = {r.m: r for r in stats.tie_averaged(spark.createDataFrame(rows, "m string, score double, hit boolean"), ["m"], "score", "hit").collect()}
    for m in "ab":
        mine, sums, n = [r[1:] for r in rows if r[0] == m], [0.0, 0.0, 0.0], 0
        for order in itertools.permutations(mine):
            if [s for s, _ in order] == sorted((s for s, _ in order), reverse=True):
                ranks = [i for i, (_, hit) in enumerate(order, 1) if hit]
                n += 1
                for k, v in enumerate((sum((i + 1) / r for i, r in enumerate(ranks)) / len(ranks), 1 / ranks[0], sum(ranks) / len(ranks))):
                    sums[k] += v
        assert [round(x / n, 9) for x in sums] == [round(x, 9) for x in (got[m].average_precision, got[m].mrr, got[m].mean_rank)]
    assert (got["c"].average_precision, got["c"].mrr, got["c"].mean_rank) == (0, 0, 0)


def test_tie_averaged_metrics_without_ties_are_exact(spark):
    s = spark.createDataFrame([("m", float(i), i in (9, 7)) for i in range(10)], "m string, score double, hit boolean")
    r = stats.tie_averaged(s, ["m"], "score", "hit").first()
    assert (r.average_precision, r.mrr, r.mean_rank) == pytest.approx(((1 + 2 / 3) / 2, 1.0, 2.0))


def test_panels(spark):
    inter = spark.createDataFrame([("i", ["a", "b"], 2.0), ("j", ["c", "d", "e"], 1.0)], "interaction string, genes array<string>, score double")
    marks = spark.createDataFrame([("x", "m1", 3.0), ("x", "m2", 2.0), ("y", "n1", 1.0), ("y", "a", 9.0)], "label string, gene string, score double")
    rest = spark.createDataFrame([("s", 1.0)], "gene string, score double")
    got = [(r.gene, r.reason) for r in panel.greedy_panel(spark, inter, marks, rest, rest, 4).orderBy("position").collect()]
    assert got == [("a", "interaction"), ("b", "interaction"), ("m1", "marker"), ("n1", "marker")]


def test_panels_over_long_tables(spark):
    """More genes than the driver reads; only rows within the budget are collected."""
    n = panel.MOST + 50
    long = spark.range(n).select(F.format_string("g%06d", "id").alias("gene"), (F.col("id") % 1000).cast("double").alias("score"), F.concat(F.lit("r"), F.col("id") % 3).alias("role"), (F.col("id") % 2 == 0).alias("eligible"))
    by_score = sorted(range(n), key=lambda i: (-(i % 1000), i))
    name = lambda some: [f"g{i:06d}" for i in some]
    got = panel.quota_panel(spark, long, {"r1": 2, "r0": 1}, 5).orderBy("position").collect()
    able = [i for i in by_score if i % 2 == 0]
    want = [i for i in able if i % 3 == 1][:2] + [i for i in able if i % 3 == 0][:1]
    want += [i for i in able if i not in want][:2]
    assert [(r.gene, r.role) for r in got] == [(g, f"r{i % 3}") for g, i in zip(name(want), want)]
    # what doesn't fit comes first, and the last interaction fits only because it overlaps the first
    inter = spark.range(n).select(F.format_string("i%06d", "id").alias("interaction"), F.array(*(F.format_string(f"x%d-{k}", "id") for k in range(3))).alias("genes"), F.lit(1.0).alias("score"))
    inter = inter.unionByName(spark.createDataFrame([("a", ["x1-0", "x1-1"], 2.0), ("z", ["x1-1", "last"], 0.5)], inter.schema))
    marks = long.withColumnRenamed("role", "label").drop("eligible")
    got = [(r.gene, r.reason) for r in panel.greedy_panel(spark, inter, marks, long, long, 4).orderBy("position").collect()]
    assert got == [(g, "interaction") for g in ("x1-0", "x1-1", "x1-2", "last")]
    got = [(r.gene, r.reason) for r in panel.greedy_panel(spark, inter.where("score > 1"), marks, long, long, 5).orderBy("position").collect()]
    first = [next(i for i in by_score if i % 3 == k) for k in range(3)]
    assert got == [("x1-0", "interaction"), ("x1-1", "interaction"), *((g, "marker") for g in name(first))]


def test_joins_check_their_keys(spark):
    a, t = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="unknown k: 2"):
        ranking.looked_up(a, t, "k").collect()
    with pytest.raises(Exception, match="repeated k: 1"):
        ranking.many_to_one(a, t.union(t), "k").collect()


# --- scalars and names


def test_sign_convention(spark):
    v = spark.createDataFrame([(0.0,), (-0.0,), (2.0,), (-3.0,)], "v double").select(scalars.sign_or_one(F.col("v")).alias("s")).collect()
    assert [r.s for r in v] == [1.0, -1.0, 1.0, -1.0]


def test_clean_names(spark):
    v = spark.createDataFrame([("ＡＢ​c ",), (None,)], "v string").select(names.clean_name("v").alias("v")).collect()
    assert [r.v for r in v] == ["ABc", None]


def test_folds_fall_back_when_one_is_empty(spark):
    p, c = random_cells(spark, 60)
    assert {r.fold for r in with_folds(c, 5, 1.0).collect()} == set(range(5))
    assert {(r.cell, r.fold) for r in with_folds(c, 5, 1000.0).collect()} == {(i, i % 5) for i in range(60)}


# --- sources, sinks, settings


def test_matrix_readers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("1,0\n0,2\n")
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% note\n2 2 2\n1 1 1\n2 2 2\n")
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 3\n1 2 5\n2 1 7\n1 2 6\n")
    (tmp_path / "bad.mtx").write_text("%%MatrixMarket x\n2 3 2\n1 1 1\n2 2\n")
    get = lambda df: {(r.cell, r.gene): r.value for r in df.where("value <> 0").collect()}
    assert get(readers.read_expression(spark, f"{tmp_path}/d.csv", 2, 2)) == get(readers.read_expression(spark, f"{tmp_path}/m.mtx", 2, 2)) == {(0, 0): 1.0, (1, 1): 2.0}
    assert get(readers.read_matrix_market(spark, f"{tmp_path}/s.mtx", 2, 2)) == {(1, 0): 6.0, (0, 1): 7.0}  # square: genes x cells; the last entry wins
    assert get(readers.read_matrix_market(spark, f"{tmp_path}/s.mtx", 2, 2, "cells")) == {(0, 1): 6.0, (1, 0): 7.0}
    with pytest.raises(Exception, match="broken entry"):
        readers.read_matrix_market(spark, f"{tmp_path}/bad.mtx", 2, 3).collect()
    assert readers.read_matrix_market(spark, f"{tmp_path}/bad.mtx", 2, 3, strict=False).count() == 1
    with pytest.raises(ValueError, match="doesn't fit"):
        readers.read_matrix_market(spark, f"{tmp_path}/m.mtx", 5, 2)
    with pytest.raises(ValueError, match="columns"):
        readers.read_dense(spark, f"{tmp_path}/d.csv", 2, 3)


def test_ids_tables_and_writers(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("a,1\n\n b\tx\nc\n")
    ids = readers.read_ids(spark, f"{tmp_path}/ids.txt")
    assert sorted(map(tuple, ids.collect())) == [(0, "a"), (1, "b"), (2, "c")]
    writers.write_ids(ids, f"{tmp_path}/out", "cell", "cell_id")
    again = readers.read_ids(spark, f"{tmp_path}/out")
    assert writers.same_ids(ids, again) and not writers.same_ids(ids, again.limit(2))
    m = spark.createDataFrame([(1, [0.5, 2.0]), (0, [1.0, -3.25])], "cell long, v array<double>")
    writers.write_matrix(m, f"{tmp_path}/m")
    writers.write_matrix(m.withColumn("v", F.array(F.lit(9.0), F.lit(9.0))), f"{tmp_path}/m", once=True)
    assert [list(r.v) for r in readers.read_dense(spark, f"{tmp_path}/m", 2, 2).orderBy("cell").collect()] == [[1.0, -3.25], [0.5, 2.0]]
    long = spark.createDataFrame([(0, 1, 2.5), (2, 0, 1.0)], "cell long, gene long, value double")
    writers.write_matrix_market(long, f"{tmp_path}/x.mtx", 3, 2)
    assert sorted(map(tuple, readers.read_matrix_market(spark, f"{tmp_path}/x.mtx", 3, 2).collect())) == [(0, 1, 2.5), (2, 0, 1.0)]
    writers.save_checkpoint(spark, f"{tmp_path}/c", {"ids": ids}, {"seed": 3})
    tables, meta = writers.load_checkpoint(spark, f"{tmp_path}/c")
    assert meta["seed"] == 3 and writers.same_ids(ids, tables["ids"])
    np.save(tmp_path / "a.npy", np.eye(3))
    assert [list(r.v) for r in readers.read_npy(spark, f"{tmp_path}/a.npy").orderBy("cell").collect()] == np.eye(3).tolist()
    with pytest.raises(ValueError, match="missing column nope"):
        readers.read_headed(spark, f"{tmp_path}/ids.txt", "nope string")
    with pytest.raises(Exception, match="bad value in value"):
        readers.checked_finite(long.withColumn("value", F.lit(float("nan"))), ["value"]).collect()


def test_relations_and_betas(spark, tmp_path):
    t = spark.createDataFrame([("d1", "b; a", "c"), ("d2", "a;b", "c"), ("d1", "a", "zz"), ("d1", None, "c")], "database string, ligand_components string, receptor_components string")
    have = spark.createDataFrame([("a",), ("b",), ("c",)], "gene string")
    assert [(r.ligand, r.receptor, r.databases) for r in readers.relations(t, have).collect()] == [(["a", "b"], ["c"], ["d1", "d2"])]
    (tmp_path / "b.csv").write_text("receiver_group,source_gene,target_gene,signed_beta,selected\n0,a,b,0.5,true\n0,a,b,0.7,1\n0,a,c,0.1,false\n")
    assert [tuple(r) for r in readers.read_selected_betas(spark, f"{tmp_path}/b.csv").collect()] == [(0, "a", "b", 0.7)]
    (tmp_path / "e.csv").write_text("cluster,source_gene,target_gene,source_cell_id,receiver_cell_id,distance\n1,a,b,x,y,0.5\n")
    ids = spark.createDataFrame([(0, "x"), (1, "y")], "cell long, cell_id string")
    assert [tuple(r) for r in readers.read_edges(spark, f"{tmp_path}/e.csv", ids).collect()] == [(1, "a", "b", 0, 1, 0.5)]
    with pytest.raises(Exception, match="unknown cell_id: y"):
        readers.read_edges(spark, f"{tmp_path}/e.csv", ids.limit(1)).collect()
    p = readers.paths(spark.createDataFrame([(1, "A -> B -> C"), (2, " ")], "i int, path string"), "path")
    assert [(r.i, r.position, r.node) for r in p.orderBy("position").collect()] == [(1, 0, "A"), (1, 1, "B"), (1, 2, "C")]


def test_settings_are_strict():
    a = config.parse(Analysis, '{"radius": 0.3, "context_count": 7, "effect": {"l1": 0.2}, "mask_mode": "${M}"}', {"context_count": "receiver_group_count"}, {"M": "none"})
    assert (a.radius, a.receiver_group_count, a.effect.l1, a.mask_mode) == (0.3, 7, 0.2, "none")
    for bad in ('{"radios": 1}', '{"mask_mode": "x"}', '{"mask_mode": "${N}"}', '{"effect": {"l9": 1}}'):
        with pytest.raises(ValueError):
            config.parse(Analysis, bad)


def test_containment_join_is_the_plain_one(spark):
    rng = np.random.default_rng(12)
    pos = {i: sorted(map(int, rng.choice(8, rng.integers(1, 6), replace=False))) for i in range(20)}
    rel = {"p": ([0], [1]), "q": ([0, 2], [3]), "r": ([4, 5], [6, 7]), "s": ([1], [1])}
    e = [(f"{i}-{j}", i, j) for i in range(20) for j in range(0, 20, 3) if i != j]
    got = edges.supported_relations(spark.createDataFrame(e, "edge string, sender int, receiver int"), spark.createDataFrame(list(pos.items()), "cell int, genes array<int>"), spark.createDataFrame([(k, *v) for k, v in rel.items()], "relation string, ligand array<int>, receptor array<int>"))
    assert {tuple(r) for r in got.collect()} == {(x, k) for x, i, j in e for k, (a, b) in rel.items() if set(a) <= set(pos[i]) and set(b) <= set(pos[j])}


def test_assignment_is_the_first_of_the_best():
    from itertools import permutations

    rng = np.random.default_rng(9)
    for n in (3, 7, 8):
        for _ in range(6):
            cost = -rng.integers(0, 4, (n, n)).astype(float)
            want = min(permutations(range(n)), key=lambda p: sum(cost[i, j] for i, j in enumerate(p)))
            assert list(panel.assignment(cost)) == list(want)


def test_fisher_of_small_and_very_large_tables():
    import math
    import time

    rng = np.random.default_rng(10)
    choose = lambda n, k: math.comb(int(n), int(k))
    for _ in range(300):
        w, x, y, z = (int(v) for v in rng.integers(0, 12, 4))
        row, column, total = w + x, w + y, w + x + y + z
        p = {k: choose(row, k) * choose(total - row, column - k) / choose(total, column) for k in range(max(0, row + column - total), min(row, column) + 1)}
        assert stats.two_sided_fisher(w, x, y, z) == pytest.approx(min(1.0, sum(v for v in p.values() if v <= p[w] * (1 + 1e-10))), abs=1e-12)
    began = time.time()
    same = stats.two_sided_fisher(500_000_000, 500_000_000, 500_010_000, 499_990_000)
    assert time.time() - began < 2 and 0.5 < same < 0.8 and 2e-56 < stats.two_sided_fisher(10**9, 10**9, 10**9 + 10**6, 10**9) < 4e-56  # z is 15.8
