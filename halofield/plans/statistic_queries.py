"""Queries over tests of differences: each gene against controls, and its course over ordered levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from .registry import CELLS, EXPR, cells, expression, query, r


def two_sided(z: str) -> str:
    """Two-sided p of z in SQL: 1 - erf by its series of positive terms, written with factorials; beyond z = 8 it is 0 to 15 places."""
    x = f"least(6e0, greatest(1e-300, abs({z}) / sqrt(2e0)))"
    terms = f"list_sum(list_transform(range(0, 220), lambda n: exp(n * ln(4e0) + lgamma(n + 1e0) + (2 * n + 1) * ln({x}) - lgamma(2 * n + 2e0))))"
    return f"greatest(0e0, 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {terms})"


def grouped(spark: SparkSession, sf: str) -> DataFrame:
    """(gene, group, value): the expression with each cell's group."""
    return expression(spark, sf).join(cells(spark, sf).select("cell", "group"), "cell").select("gene", "group", "value")


#: Each group with a copy of the controls, ranked on its own.
DIFFERENTIAL = f"""WITH {CELLS}, {EXPR}, e AS (SELECT gene, grp, ln(1 + value) AS v FROM expr JOIN cells USING (cell)),
u AS (SELECT gene, grp AS g, true AS inside, v FROM e WHERE grp <> 0 UNION ALL SELECT gene, g, false, v FROM e, (SELECT DISTINCT grp AS g FROM cells WHERE grp <> 0) WHERE grp = 0),
k AS (SELECT *, rank() OVER (PARTITION BY gene, g ORDER BY v) + (count(*) OVER (PARTITION BY gene, g, v) - 1) / 2.0e0 AS rank FROM u),
s AS (SELECT gene, g, CAST(count(*) FILTER (inside) AS DOUBLE) AS n, CAST(count(*) FILTER (NOT inside) AS DOUBLE) AS m, sum(CASE WHEN inside THEN rank END) AS rs, avg(v) FILTER (inside) AS a, avg(v) FILTER (NOT inside) AS b FROM k GROUP BY 1, 2),
z AS (SELECT *, rs - n * (n + 1) / 2 AS u, log2((exp(a) - 1 + 1e-9) / (exp(b) - 1 + 1e-9)) AS change FROM s),
w AS (SELECT *, (u - n * m / 2) / sqrt(n * m / 12 * (n + m + 1)) AS z FROM z),
p AS (SELECT *, {two_sided("z")} AS p FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, gene) AS i, count(*) OVER (PARTITION BY g) AS genes FROM p),
q AS (SELECT *, least(1, min(p * genes / i) OVER (PARTITION BY g ORDER BY i DESC)) AS fdr FROM o)
SELECT gene, g AS "group", n, m AS n_control, round(change, 6) + 0 AS log_fold_change, round(u, 2) + 0 AS u, round(z, 5) + 0 AS z, round(p, 6) + 0 AS p, round(fdr, 6) + 0 AS p_adjusted, fdr < 0.9e0 AND abs(change) > 0.05e0 AS significant FROM q"""


@query("agg29_differential", DIFFERENTIAL)
def differential(spark: SparkSession, sf: str) -> DataFrame:
    rows = grouped(spark, sf).withColumn("v", F.log1p("value"))
    t = stats.differential(rows, "group", 0, "v", ["gene"], alpha=0.9, least_change=0.05)
    return t.select("gene", "group", "n", "n_control", r("log_fold_change").alias("log_fold_change"), r("u", 2).alias("u"), r("z", 5).alias("z"), r("p").alias("p"), r("p_adjusted").alias("p_adjusted"), "significant")


LEVEL = "CASE WHEN grp < 3 THEN 0 WHEN grp < 7 THEN 1 ELSE 2 END"


def mann_whitney(name: str, rows: str, inside: str) -> str:
    """SQL tables of the p by gene of one test, corrected for ties and continuity."""
    return f"""{name}_k AS (SELECT gene, value, {inside} AS i, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0e0 AS rank FROM {rows}),
{name}_t AS (SELECT gene, sum(t * t * t - t) AS ties FROM (SELECT gene, value, CAST(count(*) AS DOUBLE) AS t FROM {name}_k GROUP BY 1, 2) GROUP BY 1),
{name}_s AS (SELECT gene, CAST(count(*) FILTER (i) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT i) AS DOUBLE) AS b, sum(CASE WHEN i THEN rank END) AS rs FROM {name}_k GROUP BY 1),
{name}_z AS (SELECT gene, (abs(rs - a * (a + 1) / 2 - a * b / 2) - 0.5e0) / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))) AS z FROM {name}_s JOIN {name}_t USING (gene)),
{name} AS (SELECT gene, least(1, {two_sided("z")}) AS p FROM {name}_z)"""


TRENDS = f"""WITH {CELLS}, {EXPR}, e AS (SELECT gene, value, {LEVEL} AS l FROM expr JOIN cells USING (cell)),
{mann_whitney("outer_", "(FROM e WHERE l <> 1)", "l = 0")}, {mann_whitney("middle_", "e", "l = 1")},
m AS (SELECT gene, {', '.join(f'avg(value) FILTER (l = {i}) AS m{i}, avg(CASE WHEN value > 0 THEN 1e0 ELSE 0 END) FILTER (l = {i}) AS f{i}' for i in range(3))} FROM e GROUP BY 1),
t AS (SELECT *, CASE WHEN greatest(f0, f1, f2) < 0.1e0 OR greatest(m0, m1, m2) < 0.01e0 THEN 'none' WHEN m0 > m1 AND m1 > m2 THEN 'first' WHEN m0 < m1 AND m1 < m2 THEN 'last' WHEN m1 > m0 AND m1 > m2 THEN 'middle' ELSE 'none' END AS trend FROM m)
SELECT gene, trend, round(CASE trend WHEN 'first' THEN log2((m0 + 0.05e0) / (m2 + 0.05e0)) WHEN 'last' THEN log2((m2 + 0.05e0) / (m0 + 0.05e0)) WHEN 'middle' THEN log2((m1 + 0.05e0) / (greatest(m0, m2) + 0.05e0)) ELSE 0 END, 6) + 0 AS score, {', '.join(f'round(m{i}, 6) + 0 AS mean_{i}, round(f{i}, 6) + 0 AS fraction_{i}' for i in range(3))}, round(outer_.p, 6) + 0 AS p_outer, round(middle_.p, 6) + 0 AS p_middle
FROM t JOIN outer_ USING (gene) JOIN middle_ USING (gene)"""


@query("agg30_level_trends", TRENDS)
def level_trends(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("group") < 3, 0).when(F.col("group") < 7, 1).otherwise(2)
    t = stats.level_trends(grouped(spark, sf).withColumn("level", level), "level", (0, 1, 2), "value", ["gene"], least_mean=0.01)
    return t.select("gene", "trend", *(r(c).alias(c) for c in t.columns if c not in ("gene", "trend")))
