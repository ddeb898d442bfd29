"""The masked-gene model: slopes against differences, learning, masks, inference."""

import numpy as np

from halofield.operators import transformer as t
from halofield.operators.sampling import random_mask


def test_slopes_are_differences():
    m = t.Model(genes=4, width=6, inner=5, heads=2, layers=2)
    rng = np.random.default_rng(0)
    x, mask, flat = rng.normal(size=(3, 4)), rng.random((3, 4)) < 0.5, m.start(1) + 0.01 * rng.normal(size=m.start(1).size)
    _, _, slopes = t.loss_and_slopes(m, flat, x, mask)
    for i in rng.choice(len(flat), 60, replace=False):
        e = np.zeros_like(flat)
        e[i] = 1e-5
        numeric = (t.loss_and_slopes(m, flat + e, x, mask)[0] - t.loss_and_slopes(m, flat - e, x, mask)[0]) / 2e-5
        assert abs(slopes[i] - numeric) < 1e-5 * max(1, abs(numeric))


def test_masks_depend_on_seed_epoch_and_cell(spark):
    cells = spark.createDataFrame([(5,), (6,)], "cell long")
    of = lambda seed, epoch: {r.cell: r.m for r in cells.select("cell", random_mask("cell", 50, 0.3, seed, epoch).alias("m")).collect()}
    a = of(1, 2)
    assert a == of(1, 2) and a != of(1, 3) and a != of(2, 2) and a[5] != a[6]
    assert 10 < sum(a[5]) + sum(a[6]) < 50


def test_training_learns_and_inference_hides_the_gene(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 1))
    x = base @ np.ones((1, 5)) + 0.1 * rng.normal(size=(200, 5))
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(200)], "cell long, v array<double>")
    m = t.Model(genes=5, width=8, inner=8, heads=2, layers=1)
    flat, losses = t.train(rows.repartition(3), m, epochs=25, probability=0.3, rate=0.02, seed=4)
    again, same = t.train(rows.repartition(2), m, epochs=2, probability=0.3, rate=0.02, seed=4)
    assert losses[-1] < 0.3 * losses[0] and np.allclose(same, losses[:2])
    got = t.infer(rows, m, flat, chunk=1).orderBy("cell").collect()
    made = np.array([r.reconstruction for r in got])
    assert np.allclose(made + np.array([r.residual for r in got]), x) and len(got[0].embedding) == 8
    changed = x.copy()
    changed[:, 2] += 50
    other = t.infer(spark.createDataFrame([(i, changed[i].tolist()) for i in range(200)], "cell long, v array<double>"), m, flat, chunk=1).orderBy("cell").collect()
    assert np.allclose([r.reconstruction[2] for r in other], made[:, 2])
