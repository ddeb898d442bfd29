"""Components and density clusters of crowded cells, without rows of pairs."""

import numpy as np
import pytest

from halofield.operators import graphs, spatial


def crowded(seed, n=700):
    rng = np.random.default_rng(seed)
    p = np.concatenate([rng.normal(0, 0.12, (n, 2)), rng.normal(0.9, 0.05, (n // 3, 2)), rng.uniform(-2, 3, (60, 2)), np.full((9, 2), 2.7)])
    return np.concatenate([p, p[:5]])


def components(p, radius, core=None):
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= radius * radius
    near = near if core is None else near & core[:, None] & core[None]
    label = np.arange(len(p))
    while True:
        new = np.array([label[n].min() if n.any() else label[i] for i, n in enumerate(near)])
        if (new == label).all():
            return label
        label = new


def table(spark, p):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "cell long, x double, y double")


@pytest.mark.parametrize("few, radius", [(256, 0.05), (0, 0.05), (256, 0.3), (8, 0.02)])
def test_components_within(spark, monkeypatch, few, radius):
    monkeypatch.setattr(graphs, "FEW", few)
    p = crowded(1)
    got = {r.node: r.label for r in graphs.components_within(table(spark, p), radius).collect()}
    assert got == dict(enumerate(components(p, radius).tolist()))


def test_meet_halves_what_boxes_leave_open():
    rng = np.random.default_rng(4)
    ring = lambda r, n: r * np.stack([np.cos(t := rng.uniform(0, 2 * np.pi, n)), np.sin(t)], 1)
    a, b = ring(1.0, 5000), ring(1.2, 5000)
    least = np.sqrt(min(((x - b) ** 2).sum(1).min() for x in a))
    assert graphs.meet(a, b, least * (1 + 1e-12)) and not graphs.meet(a, b, least * (1 - 1e-12))


def counting(monkeypatch):
    rows = []
    for module in (graphs, spatial):
        write = module.written
        monkeypatch.setattr(module, "written", lambda df, write=write: [out := write(df), rows.append(out.count())][0])
    return rows


def test_density_clusters_of_crowded_cells_write_no_pairs(spark, monkeypatch):
    rows, p = counting(monkeypatch), crowded(2)
    got = {r.cell: r.cluster for r in graphs.density_clusters(table(spark, p), 0.15, 4).collect()}
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    near = d2 <= 0.15 * 0.15
    core = near.sum(1) >= 4
    label = components(p, 0.15, core)
    want = {}
    for i in range(len(p)):
        at = [j for j in np.flatnonzero(near[i] & core)]
        want[i] = int(label[i] if core[i] else label[min(at, key=lambda j: (d2[i, j], j))]) if core[i] or at else None
    assert got == want and max(rows) < 5 * len(p) < near.sum() / 20


def test_densest_crop_of_crowded_cells_writes_no_pairs(spark, monkeypatch):
    rows, p = counting(monkeypatch), crowded(3)
    got = [(r.centre, r.node, r["rank"]) for r in graphs.densest_crop(table(spark, p), 0.15, 6).collect()]
    label = components(p, 0.15)
    names, sizes = np.unique(label, return_counts=True)
    best = None
    for i in np.flatnonzero(label == names[np.argmax(sizes)]):
        d = np.sqrt(((p - p[i]) ** 2).sum(1))
        at = sorted((d[j], j) for j in np.flatnonzero(d <= 0.15) if j != i)[:6]
        best = min(best or (1,), (-len(at), np.mean([x for x, _ in at]), int(i), [int(j) for _, j in at]))
    assert sorted(got, key=lambda g: g[2]) == [(best[2], j, k + 1) for k, j in enumerate(best[3])]
    assert max(rows) < 40 * len(p) < (((p[:, None] - p[None]) ** 2).sum(2) <= 0.15**2).sum()
