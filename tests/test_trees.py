"""Trees of bins: nearest neighbours and dense fields where cells crowd, lie far off or coincide."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halofield.functions.kernels import ReactionDiffusion
from halofield.operators import fields, graphs, panel, spatial, trees


def frame(spark, at, kind="long"):
    axes = ("x", "y", "z")[: at.shape[1]]
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], f"cell {kind}, " + ", ".join(f"{a} double" for a in axes))


def literal_nearest(receivers, senders, k, self_pairs=False, same=True):
    out = {}
    for i, p in enumerate(receivers):
        d = np.sqrt(((senders - p) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(senders)), d)) if self_pairs or not (same and i == j)][:k]
        out.update({(i, r + 1): (int(j), d[j]) for r, j in enumerate(order)})
    return out


def crowded(rng, dims=2):
    return np.vstack([rng.normal(0, 1, (150, dims)), rng.normal(0, 1e-6, (100, dims)) + 40, np.full((40, dims), 7.0), rng.uniform(-1e6, 1e6, (12, dims)), rng.normal(3, 1, (60, dims)) * ([1] + [0] * (dims - 1))])


@pytest.mark.parametrize("dims", [2, 3])
def test_nearest_neighbours_of_uneven_positions(spark, dims):
    at = crowded(np.random.default_rng(1), dims)
    c = frame(spark, at)
    got = {(r.receiver, r["rank"]): (r.sender, r.distance) for r in spatial.knn_join(c, c, 4, dims).collect()}
    want = literal_nearest(at, at, 4)
    assert set(got) == set(want)
    for key, (sender, distance) in want.items():
        assert got[key][1] == pytest.approx(distance, rel=1e-9, abs=1e-12)
        assert got[key][0] == sender or got[key][1] == pytest.approx(np.sqrt(((at[got[key][0]] - at[key[0]]) ** 2).sum()), rel=1e-9, abs=1e-12)


def test_two_tables_few_senders_and_equal_places(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0, 10, (90, 2)), np.vstack([rng.uniform(20, 30, (30, 2)), np.full((25, 2), 5.0)])
    got = {(r.receiver, r["rank"]): r.sender for r in spatial.knn_join(frame(spark, a), frame(spark, b), 6, self_pairs=True).collect()}
    assert got == {k: v[0] for k, v in literal_nearest(a, b, 6, self_pairs=True).items()}
    few = spatial.knn_join(frame(spark, a), frame(spark, b[:3]), 6, self_pairs=True)
    assert few.count() == 270
    same = frame(spark, np.zeros((30, 2)))
    assert {(r.receiver, r["rank"]): r.sender for r in spatial.knn_join(same, same, 3).collect()} == {k: v[0] for k, v in literal_nearest(np.zeros((30, 2)), np.zeros((30, 2)), 3).items()}
    assert spatial.knn_join(same.limit(0), same, 3).count() == 0 and spatial.knn_join(same, same.limit(0), 3).count() == 0


def test_outliers_cost_no_more_pairs_than_others(spark):
    """Two dense clusters far apart and scattered outliers: fewer than 20 k pairs a cell, the outliers' among them."""
    rng = np.random.default_rng(3)
    n, k = 4000, 8
    at = np.vstack([rng.normal(0, 1, (n // 2, 2)), rng.normal(1000, 1, (n // 2, 2)), rng.uniform(-2000, 3000, (40, 2))])
    pairs = spatial.candidates(frame(spark, at), frame(spark, at), k).groupBy(F.col("receiver") >= n).agg(F.count("*").alias("n")).collect()
    count = {r[0]: r["n"] for r in pairs}
    assert count[False] + count[True] < 20 * k * n and count[True] < 40 * 30 * k


def test_a_third_of_all_cells_in_one_tile(spark):
    """No task has more than its share, and the field is that of the edges."""
    rng = np.random.default_rng(4)
    at = np.vstack([rng.uniform(0, 30, (400, 2)), rng.uniform(0, 0.5, (250, 2)) + 10, np.full((60, 2), 3.0)])
    v = rng.random((len(at), 3))
    kernel, radius = ReactionDiffusion.of_length(1.0, min_distance=0.05), 1.5
    cells = spark.createDataFrame([(i, *map(float, p), w.tolist()) for i, (p, w) in enumerate(zip(at, v))], "cell long, x double, y double, v array<double>")
    placed, pairs = fields.field_tasks(cells, radius, 2, 4, 32, 64)
    keys = ["level", *trees.bin_keys(2), "part"]
    assert placed.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 60  # equal places are dealt by hash
    tasks = pairs.groupBy(*(f"r{k}" for k in keys), "bundle").agg(F.sum("sn").alias("n"))
    assert tasks.agg(F.max("n")).first()[0] <= 64 + 60
    got = {r.cell: r.field for r in fields.dense_field(cells, kernel, radius, receivers=32, senders=64, block=11).collect()}
    gap = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    weight = np.where((gap <= radius) & ~np.eye(len(at), dtype=bool), fields.kernel_values(kernel, np.where(gap > 0, gap, 0.05)), 0.0)
    assert len(got) == len(at)
    for i, want in enumerate(weight @ v):
        assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-12)


def literal_linkage(d):
    clusters, out = [[i] for i in range(len(d))], []
    while len(clusters) > 1:
        h, i, j = min((np.mean([d[a, b] for a in p for b in q]), i, j) for i, p in enumerate(clusters) for j, q in enumerate(clusters) if i < j)
        a, b = clusters[i], clusters.pop(j)
        out.append((min(min(a), min(b)), max(min(a), min(b)), round(h, 9), len(a) + len(b)))
        clusters[i] = a + b
    return sorted(out)


def test_average_linkage(spark):
    rng = np.random.default_rng(6)
    at = rng.normal(0, 1, (14, 3))
    d = np.linalg.norm(at[:, None] - at[None], axis=2)
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) if (i + j) % 2 else (j, i, float(d[i, j])) for i in range(14) for j in range(i)], "a int, b int, distance double")
    assert sorted((r["left"], r["right"], round(r["height"], 9), r["size"]) for r in graphs.average_linkage(pairs).collect()) == literal_linkage(d)
    assert graphs.average_linkage(pairs.limit(0)).collect() == []
    flat = spark.createDataFrame([(i, j, 1.0) for i in range(5) for j in range(i)], "a int, b int, distance double")
    assert sorted(r["size"] for r in graphs.average_linkage(flat).collect())[-1] == 5


def test_envelope_drops_small_components(spark):
    rng = np.random.default_rng(7)
    at = np.vstack([rng.uniform(0, 3, (400, 2)), rng.uniform(0, 0.2, (40, 2)) + 20])
    c = frame(spark, at)
    all_ = fields.envelope(c, 0.5, 0.5, 1, quantile=0.05)
    large = fields.envelope(c, 0.5, 0.5, 12, quantile=0.05)
    assert all_.select("component").distinct().count() == 2 and large.select("component").distinct().count() == 1
    assert all(r["bx"] < 10 and r["bins"] >= 12 for r in large.collect())


def literal_grid(table, size, starts, steps):
    sources, targets = sorted({s for s, _ in table}), sorted({t for _, t in table})
    m = np.array([[table.get((s, t), 0.0) for t in targets] for s in sources])
    first = lambda v: np.lexsort((np.arange(len(v)), -v))[:size]
    best = None
    for s in np.lexsort((np.arange(len(m)), -m.sum(1)))[:starts]:
        rows = np.array([s])
        for _ in range(steps):
            columns = first(m[rows].sum(0))
            new = first(m[:, columns].sum(1))
            if set(new) == set(rows):
                break
            rows = new
        if best is None or m[np.ix_(rows, columns)].sum() > best[0]:
            best = (m[np.ix_(rows, columns)].sum(), rows, columns)
    return {(sources[i], targets[j]): m[i, j] for i in best[1] for j in best[2]}


def test_dense_grid(spark):
    rng = np.random.default_rng(8)
    tables = {c: {(int(s), int(t)): float(rng.integers(-3, 30)) for s, t in rng.integers(0, 15, (60, 2))} for c in "ab"}
    tables["few"] = {(1, 2): 4.0, (3, 2): 5.0}
    df = spark.createDataFrame([(c, s, t, v) for c, x in tables.items() for (s, t), v in x.items()], "cluster string, source int, target int, score double")
    got = panel.dense_grid(df, size=3, starts=4).collect()
    for c, x in tables.items():
        assert {(r["source"], r["target"]): r["score"] for r in got if r["cluster"] == c} == literal_grid(x, 3, 4, 12)
