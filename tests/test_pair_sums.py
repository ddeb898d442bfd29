"""Sums over all pairs within a radius give what edges give, and make no rows of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions
from pyspark.sql.functions import udf

import __spark_entry__  # noqa: F401  registers the queries
from halofield.functions.kernels import ReactionDiffusion
from halofield.operators import edges, fields, spatial
from halofield.plans import analysis, model_queries, registry


@pytest.fixture(scope="module")
def tissue(spark):
    rng = np.random.default_rng(5)
    at = [(f"c{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (90, 2)))] + [("far", 50.0, 50.0), ("twin", 50.0, 50.0)]
    value = [(c, g, float(v)) for c, _, _ in at for g, v in zip(("a", "b"), rng.choice([0.0, -1.5, 2.0], 2))] + [("c0", "n", float("nan")), ("far", "n", 1.0)]
    cells = spark.createDataFrame(at, "cell string, x double, y double")
    return cells, spark.createDataFrame(value, "cell string, gene string, value double")


def table(df):
    return {(x.cell, x.gene): None if np.isnan(x.field) else round(x.field, 9) for x in df.collect()}


@pytest.mark.parametrize("form", ["kernel", "uniform", "some senders", "self"])
def test_sent_field_is_the_field_of_the_edges(tissue, form):
    cells, expression = tissue
    k = ReactionDiffusion.of_length(0.4, min_distance=0.01)
    weight = lambda d: fields.kernel_values(k, d)
    some = cells.where("cell < 'c5'") if form == "some senders" else None
    near = spatial.radius_join(cells, cells if some is None else some, 1.3, self_pairs=form == "self")
    near = fields.uniform(near) if form == "uniform" else fields.weigh(near, k)
    got = fields.sent_field(cells, expression, None if form == "uniform" else weight, 1.3, self_pairs=form == "self", senders=some)
    want = table(fields.source_field(near, expression))
    assert table(got) == want and len(want) > 90


@pytest.mark.parametrize("name", ["fld03_uniform_field", "flt02_source_mask", "source_target_screening"])
def test_fields_make_no_edges(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("fraction, most", [(0.5, 7), (0.02, 300), (1.0, 10**9)])
def test_retained_edges_are_the_first_of_all(spark, fraction, most):
    rng = np.random.default_rng(3)
    rows = [(int(g), 1, 2, f"r{r}", f"s{s}", float(v)) for g in range(2) for r in range(40) for s, v in enumerate(rng.integers(1, 30, 8) * (1 + r % 3))]
    e = spark.createDataFrame(rows, "receiver_group int, source long, target long, receiver string, sender string, influence_score double")
    asked = []
    got = edges.retained(e, fraction, most, lambda leaders: asked.append(leaders.count()) or e.join(leaders.select(*edges.EDGE, "receiver"), [*edges.EDGE, "receiver"]))
    got = sorted((x.receiver_group, x.rank_within_triplet, x.receiver, x.sender, round(x.receiver_normalized_attribution, 9), x.n_supported) for x in got.collect())
    want = []
    for g in range(2):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[5], x[3], x[4]))
        total = {x[3]: sum(y[5] for y in own if y[3] == x[3]) for x in own}
        want += [(g, i + 1, x[3], x[4], round(x[5] / total[x[3]], 9), len(own)) for i, x in enumerate(own[: min(most, int(np.ceil(len(own) * fraction)))])]
    assert got == want and asked[0] <= min(80, 2 * most)


def test_nearest_within_radius_looks_at_few_pairs(spark):
    rng = np.random.default_rng(8)
    at = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 12, (300, 2)))]
    cells = spark.createDataFrame(at, "cell long, x double, y double")
    row = lambda df: sorted((x.receiver, x.sender, x["rank"]) for x in df.collect())
    want = row(spatial.nearest(spatial.radius_join(cells, cells, 2.0), 5))
    assert row(spatial.knn_join(cells, cells, 5, radius=2.0)) == want


def test_retained_edges_are_made_once_after_their_totals(spark):
    rows = [(0, 1, 2, f"r{r}", f"s{s}", float((r * 7 + s * 3) % 11 + 1)) for r in range(30) for s in range(20)]
    e = spark.createDataFrame(rows, "receiver_group int, source long, target long, receiver string, sender string, influence_score double")
    seen = spark.sparkContext.accumulator(0)

    def marked(x):
        seen.add(1)
        return x

    mark = udf(marked, "double").asNondeterministic()

    def of(leaders):
        return e.join(leaders, [*edges.EDGE, "receiver"]).withColumn("influence_score", mark("influence_score"))

    got = edges.retained(e, 1.0, 25, of)
    assert got.count() == 25 and {"n_supported", "rank_within_triplet"} <= set(got.columns) and got.columns.count("receiver") == 1
    assert seen.value <= len(rows)


def test_fields_of_several_uses_are_made_once(spark):
    sf = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" not in plan(model_queries.standard(spark, sf)[0])
    assert "FlatMapCoGroupsInArrow" not in plan(analysis.source_fields(registry.cells(spark, sf), registry.expression(spark, sf), model_queries.SETTINGS))


def test_what_moves_grows_as_the_cells(spark, monkeypatch):
    """Each cell goes to as many tasks among four times the cells, and a receiver has as many partial sums."""
    made, real = [], fields.field_tasks
    monkeypatch.setattr(fields, "field_tasks", lambda *a: made.append(real(*a)) or made[-1])
    copies, parts = [], []
    for n in (8192, 32768):
        at = [functions.pmod(functions.xxhash64("id", functions.lit(a)), functions.lit(10**6)) / 1e6 for a in (1, 2)]
        cells = spark.range(n).select(functions.col("id").alias("cell"), at[0].alias("x"), at[1].alias("y"), functions.array(functions.lit(1.0)).alias("v"))
        fields.pair_sums(cells, 0.5, fields.weighted(None))
        pairs = made[-1][1]
        copies.append(pairs.agg(functions.sum("sn")).first()[0] / n)
        parts.append(pairs.agg(functions.max("bundle")).first()[0])
    assert copies[1] < 1.2 * copies[0] and parts[1] <= parts[0]


def test_receivers_of_one_bin_are_dealt_to_tasks(spark):
    rng = np.random.default_rng(9)
    at = rng.uniform(0.1, 0.9, (9000, 2))
    cells = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "cell long, x double, y double")
    few, before = cells.where("cell < 3"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = spatial.radius_join(cells, few, 1.0).withColumn("task", functions.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    near = ((at[:, None] - at[None, :3]) ** 2).sum(2) <= 1.0
    assert sorted((x.receiver, x.sender) for x in got) == [(i, j) for i in range(len(at)) for j in range(3) if i != j and near[i, j]]
    assert len({x.task for x in got}) > 1
