"""Running sums, exact quantiles and ranks over ranges, against NumPy and literal computations; skewed tables included."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halofield.operators import edges, ordered, sampling, stats


@pytest.fixture
def many_ranges(spark):
    """Range exchanges keep their partitions, so that groups are parted."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_running_sums_cross_ranges(spark, many_ranges):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, int(rng.integers(1, 9))) for i in range(600)]
    df = spark.createDataFrame([(None if g is None else str(g), i, v) for g, i, v in rows], "g string, i long, v long").repartition(5)
    got = {r["i"]: r for r in ordered.running(df, ["g"], [F.desc("i")], {"before": F.col("v"), "n": F.lit(1)}).collect()}
    for g in ("hot", "a", "b", None):
        of = sorted(((i, v) for h, i, v in rows if h == g), reverse=True)
        total = 0
        for k, (i, v) in enumerate(of):
            assert (got[i]["before"], got[i]["n"], got[i]["n_all"]) == (total, k, len(of))
            total += v
        assert all(got[i]["before_all"] == total for i, _ in of)
    ranges = ordered.written(df.repartitionByRange("g", F.desc("i")).withColumn("p", F.spark_partition_id())).where("g = 'hot'")
    assert ranges.select("p").distinct().count() > 2
    assert ordered.running(df.limit(0), [], ["i"], {"b": F.lit(1)}).collect() == []


@pytest.mark.parametrize("limit, bins", [(10_000, 1024), (5, 8), (1, 2)])
def test_quantiles_are_numpy_s(spark, limit, bins):
    rng = np.random.default_rng(2)
    tables = {
        "normal": rng.normal(0, 1, 301),
        "ties": rng.integers(0, 4, 300).astype(float),
        "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 120), -(10.0 ** rng.uniform(-300, 300, 120)), np.zeros(40)]),
        "ends": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0, 1.0000000000000002]),
        "one": np.array([3.5]),
        "far": np.append(rng.normal(0, 1e-9, 200), 1e9),
    }
    rows = [(k, float(v)) for k, t in tables.items() for v in t] + [("none", None), ("normal", None), ("ties", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    p = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r["g"]: r["q"] for r in ordered.quantiles(df, "v", p, ["g"], limit, bins).collect()}
    assert got["none"] is None and set(got) == {*tables, "none"}
    for k, t in tables.items():
        s = sorted(t)
        for q, want in zip(got[k], p):
            at = want * (len(s) - 1)
            lo, hi = s[math.floor(at)], s[math.ceil(at)]
            assert q == pytest.approx(lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi, rel=1e-12, abs=0) or q == lo
    one = ordered.order_statistics(df.where("g = 'far'"), "v", lambda n: [F.lit(0), n - 1, F.floor(n / 2)], limit=limit, bins=bins).first()
    s = sorted(tables["far"])
    assert (one["n"], one["at"]) == (201, [s[0], s[-1], s[100]])
    empty = ordered.quantiles(df.limit(0), "v", [0.5]).first()
    assert (empty["n"], empty["q"]) == (0, None)


def test_infinite_values_have_a_place(spark):
    v = [float("-inf"), -1.0, 0.0, 2.0, float("inf"), float("inf")]
    df = spark.createDataFrame([(x,) for x in v * 3], "v double")
    at = ordered.order_statistics(df, "v", lambda n: [F.lit(i) for i in range(18)], limit=2, bins=4).first()["at"]
    assert at == sorted(v * 3)


def ranks(values):
    s = sorted(values)
    return {x: sum(i + 1 for i, y in enumerate(s) if y == x) / s.count(x) for x in set(s)}


def test_tied_ranks_are_carried_over_ranges(spark, many_ranges):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 4 else "x", float(rng.integers(0, 40)) if i % 3 else 7.0) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {(r["g"], r["v"]): r["rank"] for r in stats.tie_blocks(df, "v", ["g"]).collect()}
    want = {(g, v): k for g in ("hot", "x") for v, k in ranks([w for h, w in rows if h == g]).items()}
    assert got == want
    pairs = spark.createDataFrame([(g, v, float(rng.integers(0, 5))) for g, v in rows], "g string, a double, b double")
    for r in stats.spearman(pairs, "a", "b", ["g"]).collect():
        some = [(x["a"], x["b"]) for x in pairs.where(F.col("g") == r["g"]).collect()]
        ra, rb = ranks([a for a, _ in some]), ranks([b for _, b in some])
        assert r["spearman"] == pytest.approx(np.corrcoef([ra[a] for a, _ in some], [rb[b] for _, b in some])[0, 1], abs=1e-12)


def mann_whitney(a, b, continuity=0.0, ties=True):
    k = ranks([*a, *b])
    u = sum(k[x] for x in a) - len(a) * (len(a) + 1) / 2
    n, all_ = len(a) + len(b), [*a, *b]
    t = sum(all_.count(x) ** 3 - all_.count(x) for x in set(all_)) if ties else 0
    sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - t / (n * (n - 1))))
    gap = u - len(a) * len(b) / 2
    z = gap / sd if not continuity else (abs(gap) - continuity) / sd
    return u, z, min(1.0, math.erfc(abs(z) / math.sqrt(2)) if z >= 0 or not continuity else 2 - math.erfc(abs(z) / math.sqrt(2)))


def test_differential_compares_each_group_with_the_controls(spark, many_ranges):
    rng = np.random.default_rng(4)
    rows = [(gene, group, float(round(rng.gamma(1 + group * gene / 4), 1)) if rng.random() > 0.4 else 0.0) for gene in range(3) for group in range(3) for _ in range(40 if group else 70)]
    df = spark.createDataFrame([*rows, (0, None, 3.0), (0, 1, None)], "gene int, grp int, v double").repartition(4)
    for ties in (False, True):
        got = {(r["gene"], r["grp"]): r for r in stats.differential(df, "grp", 0, "v", ["gene"], ties=ties).collect()}
        assert len(got) == 6
        for (gene, group), r in got.items():
            a, b = ([v for g, h, v in rows if g == gene and h == k] for k in (group, 0))
            u, z, p = mann_whitney(a, b, ties=ties)
            assert (r["n"], r["n_control"]) == (40, 70) and r["u"] == pytest.approx(u) and r["z"] == pytest.approx(z) and r["p"] == pytest.approx(p)
            assert r["log_fold_change"] == pytest.approx(math.log2((math.expm1(np.mean(a)) + 1e-9) / (math.expm1(np.mean(b)) + 1e-9)))
        for group in (1, 2):
            p = sorted(got[gene, group]["p"] for gene in range(3))
            adjusted = [min(min(p[j] * 3 / (j + 1) for j in range(i, 3)), 1.0) for i in range(3)]
            assert sorted(got[gene, group]["p_adjusted"] for gene in range(3)) == pytest.approx(adjusted)
            assert all(got[gene, group]["significant"] == (got[gene, group]["p_adjusted"] < 0.05 and abs(got[gene, group]["log_fold_change"]) > 0.5) for gene in range(3))


def test_trends_over_ordered_levels(spark):
    rng = np.random.default_rng(5)
    shape = {"falls": (3, 2, 1), "rises": (1, 2, 3), "peaks": (1, 3, 1), "dips": (3, 1, 3), "silent": (0, 0, 0)}
    rows = [(g, lv, float(round(rng.poisson(m) / 2, 1))) for g, means in shape.items() for lv, m in enumerate(means) for _ in range(60)]
    df = spark.createDataFrame([*rows, ("falls", 9, 50.0)], "gene string, level int, v double")
    got = {r["gene"]: r for r in stats.level_trends(df, "level", (0, 1, 2), "v", ["gene"]).collect()}
    assert {g: r["trend"] for g, r in got.items()} == {"falls": "first", "rises": "last", "peaks": "middle", "dips": "none", "silent": "none"}
    for g in ("falls", "peaks", "dips"):
        a, b, c = ([v for h, lv, v in rows if h == g and lv == k] for k in range(3))
        assert got[g]["p_outer"] == pytest.approx(mann_whitney(a, c, 0.5)[2], abs=1e-9) and got[g]["p_middle"] == pytest.approx(mann_whitney(b, a + c, 0.5)[2], abs=1e-9)
    assert got["falls"]["score"] == pytest.approx(math.log2((got["falls"]["mean_0"] + 0.05) / (got["falls"]["mean_2"] + 0.05)))


def test_samples_over_ranges(spark, many_ranges):
    rows = spark.createDataFrame([(i, "big" if i % 10 else f"s{i % 30}") for i in range(500)], "cell long, sample string").repartition(3)
    part = sampling.stratified(rows, "sample", "cell", 0.1, 3)
    assert {r["sample"]: r["count"] for r in part.groupBy("sample").count().collect()} == {"big": 45, "s0": 2, "s10": 2, "s20": 2}
    epoch = sampling.epoch_sample(rows, "sample", "cell", 60, 5, 3, 1)
    again = sampling.epoch_sample(rows.repartition(9), "sample", "cell", 60, 5, 3, 1)
    counts = {r["sample"]: r["count"] for r in epoch.groupBy("sample").count().collect()}
    assert sum(counts.values()) == 60 and min(counts.values()) >= 5
    assert sorted(r.cell for r in epoch.collect()) == sorted(r.cell for r in again.collect()) != sorted(r.cell for r in sampling.epoch_sample(rows, "sample", "cell", 60, 5, 3, 2).collect())


def test_retained_ranks_a_triplet_in_parts(spark, many_ranges):
    e = spark.createDataFrame([(0 if i % 5 else 1, 1, 2, i % 40, i, float(i % 17)) for i in range(1, 400)], "receiver_group int, source int, target int, receiver long, sender long, influence_score double")
    got = edges.retained(e.where("influence_score > 0"), 0.2, 50).collect()
    want = []
    for g in (0, 1):
        of = sorted((-r["influence_score"], r["receiver"], r["sender"]) for r in e.where("influence_score > 0").collect() if r["receiver_group"] == g)
        want += [(g, receiver, sender, i + 1, len(of)) for i, (_, receiver, sender) in enumerate(of[: min(math.ceil(len(of) * 0.2), 50)])]
    assert sorted((r["receiver_group"], r["receiver"], r["sender"], r["rank_within_triplet"], r["n_supported"]) for r in got) == sorted(want)
