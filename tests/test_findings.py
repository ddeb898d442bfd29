"""First lines of folders, quantiles among ties, order among equal keys, averages over ties and permutations."""

import hashlib

import duckdb
import pytest

from halofield.operators import fields, sampling, stats
from halofield.operators.ordered import quantiles
from halofield.plans import file_queries, registry
from halofield.sources import readers


def test_a_folder_is_told_by_its_first_file(spark, tmp_path):
    (tmp_path / "part-0").write_text("%%MatrixMarket matrix coordinate real general\n40 2 80\n")
    (tmp_path / "part-1").write_text("".join(f"{i} {j} 1.5\n" for i in range(1, 41) for j in (1, 2)))
    assert readers.is_matrix_market(spark, str(tmp_path))
    assert readers.read_expression(spark, str(tmp_path), 40, 2).count() == 80


def test_quantiles_among_equal_values_are_the_value(spark):
    values = [25.1, 24.7, 0.1, 1 / 3, 1e308, -1e308]
    rows = spark.createDataFrame([(g, v) for g, v in enumerate(values) for _ in range(8)], "g int, v double")
    at = [i / 20 for i in range(1, 20)]
    for r in quantiles(rows, "v", at, ["g"]).collect():
        assert r["q"] == [values[r["g"]]] * len(at)
    wide = quantiles(spark.createDataFrame([(-1.5e308,), (1.5e308,)], "v double"), "v", [0.25]).first()["q"]
    assert wide == [-0.75e308]


def test_hotspot_with_negative_activity(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0, 2.0), (2, 0.1, 0.0, -3.0), (3, 5.0, 5.0, 1.5), (4, 5.1, 5.0, 0.0)], "cell long, x double, y double, a double")
    got = fields.hotspot(cells, cells["a"], 1.0).collect()
    assert [(r.cell, r.activity) for r in got] == [(3, 1.5)]


def test_of_equal_keys_the_first_row_of_the_table_wins(spark, tmp_path):
    rows = ", ".join(f"({5 - i // 40}, {3 * i}, 1, {(i * 7) % 31 + 1.0}, 'A', 'F')" for i in range(200))
    duck = duckdb.connect(config={"threads": 1})
    duck.execute(f"COPY (SELECT CAST(a AS BIGINT) AS l_orderkey, CAST(b AS BIGINT) AS l_partkey, CAST(c AS INTEGER) AS l_linenumber, CAST(q AS DOUBLE) AS l_quantity, f AS l_returnflag, s AS l_linestatus FROM (VALUES {rows}) t(a, b, c, q, f, s)) TO '{tmp_path}/lineitem.parquet'")
    want = duck.execute(registry.ORACLES["src09_selected_betas"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet'")).fetchall()
    got = file_queries.selected_betas(spark, str(tmp_path)).select("receiver_group", "source", "target", "signed_beta").collect()
    assert [tuple(r) for r in got] == want == [(1, "A", "F", 1.0)]


def test_places_of_tied_scores_are_no_rows(spark):
    rows = [("a", float(i % 3), i % 10 == 0) for i in range(3000)] + [("b", 1.0, False)]
    out = stats.tie_averaged(spark.createDataFrame(rows, "g string, s double, hit boolean"), ["g"], "s", "hit")
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.g: r for r in out.collect()}
    assert (got["b"].average_precision, got["b"].mrr, got["b"].mean_rank) == (0.0, 0.0, 0.0)
    # the first block alone: a hit's place is uniform, so the mean rank of all is the middle
    assert got["a"].mean_rank == pytest.approx(1500.5)


def test_a_block_larger_than_a_run_of_places():
    m = 200_000
    harmonic = sum(1 / j for j in range(1, m + 1))
    assert stats.place_sums(m, 1, 0, 0) == pytest.approx((harmonic / m, harmonic / m))
    assert stats.place_sums(m, m, 0, 0) == pytest.approx((m, 1.0))
    assert stats.place_sums(m, 0, 5, 0) == (0.0, 0.0)


@pytest.mark.parametrize("most", [5, 500_000])
def test_permutations_are_ranked_in_slots_of_hashes(spark, most):
    rows = [(k, float(k * 37 % 101), k % 7 == 0) for k in range(300)]

    def precision(order):
        hits = [i for i, r in enumerate(order) if r[2]]
        return sum((n + 1) / (i + 1) for n, i in enumerate(hits)) / len(hits)

    observed = precision(sorted(rows, key=lambda r: (-r[1], r[0])))
    null = [precision(sorted(rows, key=lambda r: hashlib.md5(f"3/{n}/{r[0]}".encode()).hexdigest())) for n in range(1, 21)]
    out = sampling.permutation_null(spark.createDataFrame(rows, "k long, s double, hit boolean"), "s", "hit", "k", 20, 3, most=most)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()  # a row is no row a repeat
    got = out.first()
    assert got.observed == pytest.approx(observed) and got.expected == pytest.approx(sum(null) / 20)
    assert got.p == pytest.approx((1 + sum(a >= observed for a in null)) / 21)
