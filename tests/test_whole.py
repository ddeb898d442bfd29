"""Whole tables go into results, and pairs of cells become rows only where they are the result."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from halofield.operators import edges, fields, spatial
from halofield.plans import analysis, registry


def test_an_analysis_is_fitted_on_all_cells(spark):
    """More cells than the 60,000 that a fit took before; odd and even neighbours lie in pairs, each pair far from the others."""
    n = 61_000
    rng = np.random.default_rng(1)
    value, noise = rng.uniform(0.5, 2, (n, 2)), rng.normal(0, 1, (n, 2))
    told = value[np.arange(n) ^ 1] + noise  # a residual follows what the other of the pair sends
    t = spark.createDataFrame(np.hstack([np.arange(n)[:, None], value, told]).tolist(), "cell double, a double, b double, c double, d double")
    t = t.withColumn("cell", F.col("cell").cast("long")).repartition(4).cache()
    half = F.floor(F.col("cell") / 2)
    cells = t.select("cell", (half % 175 * 0.3 + 0.1 * (F.col("cell") % 2)).alias("x"), (F.floor(half / 175) * 0.3).alias("y"))
    long = lambda *names: t.select("cell", F.posexplode(F.array(*names)).alias("gene", "value"))
    embedding = t.select("cell", F.array(F.lit(0.0)).alias("v"))
    out = analysis.analyse(cells, long("a", "b"), long("c", "d"), embedding, analysis.Analysis(receiver_group_count=1), centres=[[0.0]])
    got = {(r.source, r.target): r.screening_score for r in out["effects"].collect()}
    want = {(s, u): abs(np.corrcoef(value[np.arange(n) ^ 1, s], told[:, u])[0, 1]) for s in range(2) for u in range(2) if s != u}
    assert len(want) == 2 and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_relations_are_counted_without_edges(spark):
    rng = np.random.default_rng(4)
    cells = spark.createDataFrame([(f"c{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (80, 2)))], "cell string, x double, y double")
    genes = [(f"c{i}", f"g{g}") for i in range(78) for g in range(6) if rng.random() < 0.5] + [("c79", "g1")]
    positive = edges.positive_genes(spark.createDataFrame(genes, "cell string, gene string").withColumn("value", F.lit(1.0)))
    known = [("a", ["g1"], ["g2"]), ("b", ["g1", "g3"], ["g4", "g5"]), ("c", ["g0", "g0"], []), ("d", ["none"], ["g1"]), ("e", [], ["g1"]), ("f", ["g2"], ["none"])]
    relations = spark.createDataFrame(known, "relation string, ligand array<string>, receptor array<string>")
    e = spatial.radius_join(cells, cells, 1.1).withColumn("edge", F.struct("sender", "receiver"))
    want = edges.supported_relations(e.select("edge", "sender", "receiver"), positive, relations).groupBy("edge.receiver", "relation").count().collect()
    for at_once in (2, 64):
        got = edges.relation_counts(cells, positive, relations, 1.1, at_once=at_once)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 80
    assert edges.relation_counts(cells, positive, relations.limit(0), 1.1).collect() == []
    plan = registry.QUERIES["jn16_containment_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("dims, most, run", [(2, (16, 40), 300), (3, (4096, 8192), 1 << 22)])
def test_near_pairs_are_those_of_the_radius_join(spark, dims, most, run):
    rng = np.random.default_rng(8)
    at = [tuple(map(float, p)) for p in np.vstack([rng.normal(0, 1, (90, 3)), rng.normal(4, 0.01, (40, 3)), np.ones((20, 3)), [[0, 0.5, 0], [0, 1, 0]]])]
    odd = [(float("nan"), 0.0, 0.0), (None, 0.0, 0.0), (float("inf"), 0.0, 0.0)]
    cells = spark.createDataFrame([(f"c{i}", *p) for i, p in enumerate(at + odd)], "cell string, x double, y double, z double")
    some, others = cells.where("cell < 'c5'"), cells.where("cell > 'c12'")
    for r, s in ((cells, None), (some, others)):
        want = sorted(map(tuple, spatial.radius_join(*((r if t is None else t).where("coalesce(x, 0) < 1e300 or isnan(x)") for t in (r, s)), 0.5, dims).collect()))  # which fails on an infinite place
        for twins in (False, True) if s is None else (False,):
            assert sorted(map(tuple, fields.near_pairs(r, 0.5, dims, s, most=most, run=run, block=7, twins=twins).collect())) == want and len(want) > 500
    assert fields.near_pairs(cells.limit(0), 0.5, dims).collect() == []


@pytest.mark.parametrize("name, most", [("jn01_radius_join", 6), ("jn01_radius_join_3d", 6), ("jn04_radius_join_two_sets", 6), ("fld01_kernel_2d", 8), ("fld02_kernel_3d", 8)])
def test_pairs_take_few_bytes(spark, tmp_path, name, most):
    """In the order of receivers a pair took 10 bytes, eight of them its distance or weight."""
    v = np.random.default_rng(9).normal(0, 0.06, (2500, 64)).astype("float32")
    v[:, 3] = 1  # all express the first gene
    pq.write_table(pa.table({"vec_id": np.arange(2500), "embedding": list(v), "label": np.arange(2500, dtype="int32") % 5}), f"{tmp_path}/embeddings.parquet")
    registry.QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    files = [pq.read_metadata(f) for f in (tmp_path / "out").glob("*.parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.column(j).total_compressed_size for g in groups for j in range(3)) < most * sum(g.num_rows for g in groups) and sum(g.num_rows for g in groups) > 2_000_000
