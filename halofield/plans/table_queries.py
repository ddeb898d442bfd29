"""Queries over tables: projections, filters, joins, ranks, sets, aggregates, statistics, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, scalars
from ..functions.kernels import bessel_i0, bessel_k0
from ..operators import matrix, panel, ranking, sampling, stats
from ..operators.ordered import quantiles
from ..sources.store import written
from .registry import CELLS, EXPR, RELATIONS, RESIDUAL, cells, expression, query, r, relations, residual, table

# --- projections and filters


@query("prj01_gather_rows", f"WITH {EXPR} SELECT cell, gene, round(value, 6) + 0 AS value FROM expr WHERE cell IN (SELECT doc_id FROM labels WHERE quality = 1)")
def gather(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("cell"))
    return expression(spark, sf).join(wanted, "cell", "left_semi").withColumn("value", r("value"))


@query("prj02_complement", f"WITH {CELLS} SELECT cell FROM cells WHERE cell NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def complement(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).select("cell")
    return c.join(table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("cell")), "cell", "left_anti")


@query("prj03_gene_panel", f"WITH {EXPR}, panel(gene, position) AS (VALUES (7, 0), (2, 1), (11, 2)) SELECT cell, position, round(value, 6) + 0 AS value FROM expr JOIN panel USING (gene)")
def gene_panel(spark: SparkSession, sf: str) -> DataFrame:
    chosen = spark.createDataFrame([(7, 0), (2, 1), (11, 2)], "gene long, position int")
    return expression(spark, sf).join(chosen, "gene").select("cell", "position", r("value").alias("value"))


@query("prj04_one_hot", f"WITH {CELLS} SELECT cell, k AS receiver_group, CASE WHEN grp = k THEN 1e0 ELSE 0e0 END AS p FROM cells, (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS k)")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).select("cell", "group", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("receiver_group")).select("cell", "receiver_group", F.when(F.col("group") == F.col("receiver_group"), 1.0).otherwise(0.0).alias("p"))


@query("prj05_elementwise_residual", f"WITH {EXPR}, {RESIDUAL} SELECT cell, gene, round(a.value - b.value, 6) + 0 AS difference FROM expr a JOIN residual b USING (cell, gene)")
def elementwise(spark: SparkSession, sf: str) -> DataFrame:
    return expression(spark, sf).join(residual(spark, sf).withColumnRenamed("value", "other"), ["cell", "gene"]).select("cell", "gene", r(F.col("value") - F.col("other")).alias("difference"))


@query("prj06_scaled_positions", f"WITH {CELLS}, b AS (SELECT min(x) AS lx, min(y) AS ly, greatest(max(x) - min(x), max(y) - min(y)) AS side FROM cells) SELECT cell, round((x - lx) / side, 6) + 0 AS x, round((y - ly) / side, 6) + 0 AS y FROM cells, b")
def scaled(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.scaled_positions(cells(spark, sf)).select("cell", r("x").alias("x"), r("y").alias("y"))


@query("prj07_library_size", f"WITH {EXPR} SELECT cell, gene, round(CASE WHEN sum(value) OVER w > 0 THEN ln(1 + value * 10000e0 / sum(value) OVER w) ELSE 0 END, 6) + 0 AS value FROM expr WINDOW w AS (PARTITION BY cell)")
def library_size(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.library_size(expression(spark, sf)).select("cell", "gene", r("value").alias("value"))


@query("prj09_labels", f"WITH {RELATIONS} SELECT cluster, source, target, CAST(source AS VARCHAR) || ' -> ' || CAST(target AS VARCHAR) AS label, CASE WHEN score > 500000000 THEN 1 ELSE -1 END AS direction FROM relations")
def labels(spark: SparkSession, sf: str) -> DataFrame:
    return relations(spark, sf).select("cluster", "source", "target", F.concat_ws(" -> ", F.col("source").cast("string"), F.col("target").cast("string")).alias("label"), F.when(F.col("score") > 500000000, 1).otherwise(-1).alias("direction"))


@query("flt03_truthy", "SELECT p_partkey, lower(trim(p_brand)) IN ('true', '1', 'yes', 'brand#11', 'brand#23') AS flag FROM part")
def truthy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", scalars.truthy(F.col("p_brand"), ("true", "1", "yes", "brand#11", "brand#23")).alias("flag"))


QC = "qc AS (SELECT l_orderkey AS cell, sum(l_quantity) AS counts, count(DISTINCT l_linenumber) AS genes, sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END) / sum(l_quantity) AS part FROM lineitem GROUP BY 1)"


@query("flt04_cell_qc", f"WITH {QC}, cap AS (SELECT quantile_cont(counts, 0.999) AS c, quantile_cont(genes, 0.999) AS g FROM qc) SELECT cell, counts, genes FROM qc, cap WHERE counts >= 20 AND genes >= 2 AND counts <= c AND genes <= g AND part <= 0.5e0")
def cell_qc(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem")
    q = t.groupBy(F.col("l_orderkey").alias("cell")).agg(F.sum("l_quantity").alias("counts"), F.countDistinct("l_linenumber").alias("genes"), (F.sum(F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")).alias("part"))
    q = written(q)
    both = q.select(F.stack(F.lit(2), F.lit("counts"), F.col("counts"), F.lit("genes"), F.col("genes").cast("double")).alias("of", "value"))
    at = lambda of: F.max(F.when(F.col("of") == of, F.col("q")[0])).alias(of[0])
    cap = quantiles(both, "value", [0.999], ["of"]).agg(at("counts"), at("genes"))
    return q.crossJoin(F.broadcast(cap)).where("counts >= 20 and genes >= 2 and counts <= c and genes <= g and part <= 0.5").select("cell", "counts", "genes")


@query("flt05_gene_filter", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 20) AND NOT regexp_matches(p_type, '(?i)^(standard|small)')")
def gene_filter(spark: SparkSession, sf: str) -> DataFrame:
    common = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_orderkey").alias("n")).where("n >= 20")
    return table(spark, sf, "part").where(~F.col("p_type").rlike("(?i)^(standard|small)")).join(common, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("flt06_region_filter_audit", "SELECT o_orderstatus AS region, count(*) AS n, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS allowed, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS dropped FROM orders GROUP BY 1")
def region_audit(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("region")).agg(F.count("*").alias("n"), F.count_if(ok).alias("allowed"), F.count_if(~ok).alias("dropped"))


@query("flt07_technical_flag", "SELECT p_partkey, upper(p_type) LIKE 'STANDARD%' OR upper(p_type) LIKE '%BRASS%' OR upper(p_type) = 'SMALL PLATED TIN' AS technical FROM part")
def technical(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", names.flag_by_parts(F.col("p_type"), ("STANDARD",), ("BRASS",), ("SMALL PLATED TIN",)).alias("technical"))


@query("flt09_bounding_box", f"WITH {CELLS} SELECT cell FROM cells WHERE x BETWEEN -0.1e0 AND 0.1e0 AND y BETWEEN -0.05e0 AND 0.2e0")
def bounding_box(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).where(F.col("x").between(-0.1, 0.1) & F.col("y").between(-0.05, 0.2)).select("cell")


# --- joins on keys


@query("jn10_lookup", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def lookup(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return ranking.looked_up(items, table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey").select("l_orderkey", "l_linenumber", "p_name")


@query("jn11_inner_merge", f"WITH {RELATIONS} SELECT a.source, a.target, a.score AS score_a, b.score AS score_r FROM relations a JOIN relations b USING (source, target) WHERE a.cluster = 'A' AND b.cluster = 'R'")
def inner_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = relations(spark, sf)
    side = lambda c: e.where(F.col("cluster") == c.upper()).select("source", "target", F.col("score").alias(f"score_{c}"))
    return side("a").join(side("r"), ["source", "target"])


@query("jn12_left_merge", "SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic, quality IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.col("quality").isNull().alias("missing"))


@query("jn13_many_to_one", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def many_to_one(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return ranking.many_to_one(c, table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("c_custkey", "n_name")


@query("jn14_semi_anti", "SELECT c_custkey, 'with' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'without' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("kind", F.lit("with")).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("kind", F.lit("without")))


@query("jn15_candidate_product", "SELECT n_name, r_name FROM nation, region")
def candidate_product(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_name").crossJoin(F.broadcast(table(spark, sf, "region").select("r_name")))


@query("jn18_majority_mapping", f"WITH {CELLS}, n AS (SELECT CAST(cell % 10 AS INTEGER) AS inferred, grp, count(*) AS n FROM cells GROUP BY 1, 2) SELECT inferred, grp AS mapped, n FROM (SELECT *, row_number() OVER (PARTITION BY inferred ORDER BY n DESC, grp DESC) AS k FROM n) WHERE k = 1")
def majority_mapping(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).withColumn("inferred", (F.col("cell") % 10).cast("int"))
    return panel.majority_mapping(stats.contingency(c, "inferred", "group"), "inferred", "group")


def mapping_sql(groups: int) -> str:
    """The best assignment over sets of taken columns, a row a step; of equal sums the first path in order."""
    steps = ["s0 AS (SELECT 0 AS taken, 0 AS total, CAST([] AS INTEGER[]) AS path)"]
    for i in range(groups):
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT taken, total, path FROM (SELECT *, row_number() OVER (PARTITION BY taken ORDER BY total DESC, path) AS k FROM (SELECT taken | (1 << j) AS taken, total + n AS total, list_append(path, CAST(j AS INTEGER)) AS path FROM s{i}, b WHERE i = {i} AND (taken >> j) & 1 = 0)) WHERE k = 1)")
    return ", ".join(steps)


@query("jn19_optimal_mapping", f"WITH {CELLS}, g AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS j FROM (SELECT DISTINCT grp FROM cells)), n AS (SELECT CAST(cell % 10 AS INTEGER) AS i, grp, count(*) AS n FROM cells GROUP BY 1, 2), b AS MATERIALIZED (SELECT r.i, j, g.grp, coalesce(n, 0) AS n FROM range(10) r(i) CROSS JOIN g LEFT JOIN n ON n.i = r.i AND n.grp = g.grp), {mapping_sql(10)} SELECT CAST(b.i AS INTEGER) AS inferred, grp AS mapped, n FROM s10, b WHERE path[b.i + 1] = j")
def optimal_mapping(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).withColumn("inferred", (F.col("cell") % 10).cast("int"))
    return panel.optimal_mapping(spark, stats.contingency(c, "inferred", "group"), "inferred", "group")


# --- standardization


@query("la01_zscore", f"WITH {EXPR}, m AS (SELECT gene, avg(value) AS m, stddev_pop(value) AS s FROM expr GROUP BY 1) SELECT cell, gene, round((value - m) / greatest(s, 1e-8), 5) + 0 AS z FROM expr JOIN m USING (gene)")
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.standardized(expression(spark, sf), "value", ["gene"]).select("cell", "gene", r("z", 5).alias("z"))


@query("la02_zscore_on_subset", f"WITH {CELLS}, {EXPR}, m AS (SELECT gene, avg(value) AS m, stddev_pop(value) AS s FROM expr JOIN cells USING (cell) WHERE grp < 5 GROUP BY 1) SELECT cell, gene, round((value - m) / greatest(s, 1e-8), 5) + 0 AS z FROM expr JOIN m USING (gene)")
def zscore_subset(spark: SparkSession, sf: str) -> DataFrame:
    fit = cells(spark, sf).where("group < 5")
    return matrix.standardized(expression(spark, sf), "value", ["gene"], fit=fit).select("cell", "gene", r("z", 5).alias("z"))


@query("la03_moments", f"WITH {EXPR} SELECT gene, round(avg(value), 6) + 0 AS mean, round(stddev_pop(value), 6) + 0 AS sd FROM expr GROUP BY 1")
def moments(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.moments(expression(spark, sf), "value", ["gene"]).select("gene", r("mean").alias("mean"), r("sd").alias("sd"))


@query("la04_weighted_means", f"WITH {CELLS}, {EXPR} SELECT gene, round(sum(value * (z + 1)) / sum(z + 1), 6) + 0 AS mean FROM expr JOIN cells USING (cell) GROUP BY 1")
def weighted_means(spark: SparkSession, sf: str) -> DataFrame:
    e = expression(spark, sf).join(cells(spark, sf).select("cell", (F.col("z") + 1).alias("w")), "cell")
    return matrix.weighted_means(e, "value", "w", ["gene"]).select("gene", r("mean").alias("mean"))


@query("la10_centre_distances", f"WITH {CELLS} SELECT cell, k, round((x - cx) * (x - cx) + (y - cy) * (y - cy), 6) + 0 AS d2 FROM cells, (VALUES (0, 0e0, 0e0), (1, 0.1e0, -0.1e0), (2, -0.2e0, 0.05e0)) c(k, cx, cy)")
def centre_distances(spark: SparkSession, sf: str) -> DataFrame:
    d = matrix.squared_distances(cells(spark, sf).withColumn("v", F.array("x", "y")), "v", [[0.0, 0.0], [0.1, -0.1], [-0.2, 0.05]])
    return d.select("cell", F.posexplode("d2").alias("k", "d2")).withColumn("d2", r("d2"))


@query("la11_gene_correlations", f"WITH {EXPR} SELECT p.gene AS a, q.gene AS b, round(corr(p.value, q.value), 6) + 0 AS r FROM expr p JOIN expr q ON p.cell = q.cell AND p.gene < q.gene GROUP BY 1, 2")
def gene_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.gene_correlations(expression(spark, sf), "value").withColumn("r", r("r"))


# --- counts and agreement


@query("agg01_composition", "SELECT o_orderstatus, o_orderpriority, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) + 0 AS fraction FROM orders GROUP BY 1, 2")
def composition(spark: SparkSession, sf: str) -> DataFrame:
    return stats.composition(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").withColumn("fraction", r("fraction"))


@query("agg02_dominant", "WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY o_custkey) AS f FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderpriority AS dominant, round(f, 6) + 0 AS fraction FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS k FROM n) WHERE k = 1")
def dominant(spark: SparkSession, sf: str) -> DataFrame:
    return stats.dominant(table(spark, sf, "orders"), "o_custkey", "o_orderpriority").withColumn("fraction", r("fraction"))


@query("agg03_crosstab", "SELECT event_type, CAST(user_id % 5 AS BIGINT) AS cohort, count(*) AS n FROM events GROUP BY 1, 2")
def crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return stats.contingency(table(spark, sf, "events").withColumn("cohort", F.col("user_id") % 5), "event_type", "cohort")


@query("agg04_max_per_group", f"WITH {RELATIONS} SELECT cluster, source, max(score) AS best FROM relations GROUP BY 1, 2")
def max_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return relations(spark, sf).groupBy("cluster", "source").agg(F.max("score").alias("best"))


@query("agg05_named_aggregates", f"WITH {RELATIONS} SELECT cluster, target, round(avg(score), 3) + 0 AS mean, round(stddev_samp(score), 1) + 0 AS sd, count(*) AS n, count(DISTINCT source) AS sources, round(median(score), 3) + 0 AS median FROM relations GROUP BY 1, 2")
def named_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return relations(spark, sf).groupBy("cluster", "target").agg(r(F.avg("score"), 3).alias("mean"), r(F.stddev_samp("score"), 1).alias("sd"), F.count("*").alias("n"), F.countDistinct("source").alias("sources"), r(F.median("score"), 3).alias("median"))


@query("agg06_dominant_endpoint", f"WITH {RELATIONS}, s AS (SELECT source, cluster, sum(score) AS s FROM relations GROUP BY 1, 2) SELECT source, cluster, round(s, 2) + 0 AS influence FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(s, 2) DESC, cluster) AS k FROM s) WHERE k = 1")
def dominant_endpoint(spark: SparkSession, sf: str) -> DataFrame:
    s = relations(spark, sf).groupBy("source", "cluster").agg(r(F.sum("score"), 2).alias("influence"))
    return ranking.first_of(s, ["source"], [F.desc("influence"), "cluster"])


@query("agg07_best_of", f"WITH {RELATIONS}, b AS (SELECT cluster, target, max(score) AS best FROM relations GROUP BY 1, 2), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY best DESC, target) AS k FROM b) WHERE k <= 5) SELECT cluster, target, source, score FROM relations JOIN t USING (cluster, target) WHERE score = best")
def best_of(spark: SparkSession, sf: str) -> DataFrame:
    e = relations(spark, sf)
    best = ranking.top(e.groupBy("cluster", "target").agg(F.max("score").alias("best")), ["cluster"], "best", ["target"], 5)
    return e.join(best, ["cluster", "target"]).where("score = best").select("cluster", "target", "source", "score")


@query("agg08_membership_patterns", "WITH u AS (SELECT n_nationkey AS k FROM nation) SELECT k IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) AS in_rich, k IN (SELECT s_nationkey FROM supplier) AS in_supplier, k IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) AS in_region, count(*) AS n FROM u GROUP BY 1, 2, 3")
def membership_patterns(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey")
    rich = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return ranking.membership_patterns(n, "k", {"rich": rich, "supplier": table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), "region": n.where("n_regionkey < 2")})


@query("agg09_gene_metrics", f"WITH {EXPR} SELECT gene, round(avg(CASE WHEN value > 0 THEN 1e0 ELSE 0 END), 6) + 0 AS detection, round(avg(value), 6) + 0 AS mean, round(var_pop(value), 6) + 0 AS variance, round(avg(CASE WHEN value > 0 THEN value END), 6) + 0 AS mean_positive FROM expr GROUP BY 1")
def gene_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.gene_metrics(expression(spark, sf).where("value <> 0"), table(spark, sf, "embeddings").count())
    return m.select("gene", *(r(c).alias(c) for c in ("detection", "mean", "variance", "mean_positive")))


@query("agg10_specificity", f"WITH {CELLS}, {EXPR}, m AS (SELECT gene, grp, avg(value) AS m FROM expr JOIN cells USING (cell) GROUP BY 1, 2) SELECT gene, round((count(*) - sum(m) / max(m)) / (count(*) - 1), 6) + 0 AS tau, first(grp ORDER BY m DESC, grp) AS best_label FROM m GROUP BY 1")
def specificity(spark: SparkSession, sf: str) -> DataFrame:
    return stats.specificity(expression(spark, sf), cells(spark, sf).select("cell", F.col("group").alias("label"))).withColumn("tau", r("tau"))


@query("agg13_marker_scores", f"WITH {CELLS}, {EXPR}, g AS (SELECT gene, grp, sum(value) AS s, count(*) AS n, count(*) FILTER (value > 0) AS k FROM expr JOIN cells USING (cell) GROUP BY 1, 2), t AS (SELECT *, sum(s) OVER (PARTITION BY gene) AS t, sum(n) OVER (PARTITION BY gene) AS a FROM g) SELECT gene, grp AS label, round(log2((s / n + 0.05e0) / ((t - s) / (a - n) + 0.05e0)) * sqrt(k / n), 6) + 0 AS score FROM t")
def marker_scores(spark: SparkSession, sf: str) -> DataFrame:
    return stats.marker_scores(expression(spark, sf), cells(spark, sf).select("cell", F.col("group").alias("label"))).withColumn("score", r("score"))


METRICS = "metrics AS (SELECT l_partkey AS gene, avg(l_quantity) AS mean, var_pop(l_quantity) AS variance FROM lineitem GROUP BY 1)"


@query("agg14_variable_genes", f"WITH {METRICS}, b AS (SELECT *, ln(variance / mean) AS d FROM metrics WHERE mean > 0 AND variance > 0), q AS (SELECT {', '.join(f'quantile_cont(mean, {i / 20!r}) AS q{i}' for i in range(1, 20))} FROM b), n AS (SELECT gene, d, {' + '.join(f'CASE WHEN q{i} < mean THEN 1 ELSE 0 END' for i in range(1, 20))} AS bin FROM b, q) SELECT gene, CAST(bin AS INTEGER) AS bin, round(d, 5) + 0 AS dispersion, round(coalesce(CASE WHEN stddev_samp(d) OVER w > 0 THEN (d - avg(d) OVER w) / stddev_samp(d) OVER w END, 0), 4) + 0 AS normalized FROM n WINDOW w AS (PARTITION BY bin)")
def variable_genes(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.avg("l_quantity").alias("mean"), F.var_pop("l_quantity").alias("variance"))
    return stats.variable_genes(m).select("gene", "bin", r("dispersion", 5).alias("dispersion"), r("normalized", 4).alias("normalized"))


@query("agg15_pseudobulk", f"WITH {CELLS}, {EXPR}, s AS (SELECT grp, gene, sum(value) AS s FROM expr JOIN cells USING (cell) GROUP BY 1, 2), l AS (SELECT grp, gene, ln(1 + s * 1e6 / sum(s) OVER (PARTITION BY grp)) AS v FROM s), m AS (SELECT gene, avg(v) AS m, stddev_pop(v) AS d FROM l GROUP BY 1) SELECT grp AS cluster, gene, round((v - m) / greatest(d, 1e-8), 4) + 0 AS z FROM l JOIN m USING (gene)")
def pseudobulk(spark: SparkSession, sf: str) -> DataFrame:
    return bulk(spark, sf).select("cluster", "gene", r("z", 4).alias("z"))


def bulk(spark: SparkSession, sf: str) -> DataFrame:
    s = expression(spark, sf).join(cells(spark, sf).select("cell", F.col("group").alias("cluster")), "cell").groupBy("cluster", "gene").agg(F.sum("value").alias("value"))
    return matrix.standardized(matrix.library_size(s.withColumnRenamed("cluster", "cell"), 1e6).withColumnRenamed("cell", "cluster"), "value", ["gene"])


@query("agg16_module_labels", f"WITH {CELLS}, {EXPR}, s AS (SELECT grp AS cluster, gene, sum(value) AS v FROM expr JOIN cells USING (cell) GROUP BY 1, 2), t AS (SELECT *, sum(v) OVER (PARTITION BY cluster) AS total FROM s), n AS (SELECT cluster, gene, CASE WHEN total > 0 THEN ln(1 + v * 1e6 / total) ELSE 0 END AS v FROM t), z AS (SELECT cluster, gene, (v - avg(v) OVER w) / greatest(stddev_pop(v) OVER w, 1e-8) AS z FROM n WINDOW w AS (PARTITION BY gene)), m(gene, label, role) AS (VALUES (1, 'a', 'core'), (2, 'a', 'aux'), (3, 'a', 'anti'), (4, 'b', 'core'), (5, 'b', 'aux'), (6, 'c', 'core'), (7, 'c', 'anti')), sc AS (SELECT cluster, label, coalesce(avg(z) FILTER (role = 'core'), 0) + 0.5e0 * coalesce(avg(z) FILTER (role = 'aux'), 0) - 0.5e0 * coalesce(avg(z) FILTER (role = 'anti'), 0) AS score FROM z JOIN m USING (gene) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM sc WINDOW w AS (PARTITION BY cluster ORDER BY score DESC, label)) SELECT cluster, CASE WHEN second IS NULL OR score - second >= 0.25e0 THEN label ELSE 'unassigned' END AS label, round(score, 4) + 0 AS score FROM k WHERE r = 1")
def module_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, "a", "core"), (2, "a", "aux"), (3, "a", "anti"), (4, "b", "core"), (5, "b", "aux"), (6, "c", "core"), (7, "c", "anti")]
    m = spark.createDataFrame(rows, "gene long, label string, role string")
    return stats.module_scores(bulk(spark, sf), m).select("cluster", "label", r("score", 4).alias("score"))


@query("agg17_mse", f"WITH {EXPR}, {RESIDUAL} SELECT gene, round(avg((a.value - b.value) * (a.value - b.value)), 6) + 0 AS mse FROM expr a JOIN residual b USING (cell, gene) GROUP BY 1")
def mse(spark: SparkSession, sf: str) -> DataFrame:
    j = expression(spark, sf).join(residual(spark, sf).withColumnRenamed("value", "other"), ["cell", "gene"])
    return j.groupBy("gene").agg(r(F.avg((F.col("value") - F.col("other")) * (F.col("value") - F.col("other")))).alias("mse"))


@query("agg18_held_out_group_mean", f"WITH {CELLS}, {RESIDUAL}, s AS (SELECT grp, gene, cell % 5 AS fold, sum(value) AS s, count(*) AS n FROM residual JOIN cells USING (cell) GROUP BY 1, 2, 3) SELECT grp AS \"group\", gene, fold, round((sum(s) OVER w - s) / (sum(n) OVER w - n), 6) + 0 AS prediction FROM s WINDOW w AS (PARTITION BY grp, gene)")
def held_out_mean(spark: SparkSession, sf: str) -> DataFrame:
    s = residual(spark, sf).join(cells(spark, sf).select("cell", "group"), "cell").groupBy("group", "gene", (F.col("cell") % 5).alias("fold")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("group", "gene")
    return s.select("group", "gene", "fold", r((F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n"))).alias("prediction"))


@query("agg19_fold_errors", f"WITH {RESIDUAL}, f AS (SELECT gene, cell % 5 AS fold, avg(value) AS m FROM residual GROUP BY 1, 2) SELECT gene, round(stddev_samp(m), 6) + 0 AS sd, round(stddev_samp(m) / sqrt(count(*)), 6) + 0 AS se FROM f GROUP BY 1")
def fold_errors(spark: SparkSession, sf: str) -> DataFrame:
    f = residual(spark, sf).groupBy("gene", (F.col("cell") % 5).alias("fold")).agg(F.avg("value").alias("m"))
    return f.groupBy("gene").agg(r(F.stddev_samp("m")).alias("sd"), r(F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("se"))


AGREE = f"WITH {CELLS}, c AS (SELECT grp AS a, cell % 10 AS b, count(*) AS n FROM cells GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS r, max(n) AS t FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS r FROM c GROUP BY 1), s AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * (n - 1) / 2.0e0) FROM c) AS i, (SELECT sum(r * (r - 1) / 2.0e0) FROM ra) AS pa, (SELECT sum(r * (r - 1) / 2.0e0) FROM rb) AS pb, (SELECT sum(t) FROM ra) AS t)"


@query("agg20_adjusted_rand", AGREE + " SELECT round((i - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) + 0 AS adjusted_rand FROM s")
def adjusted_rand(spark: SparkSession, sf: str) -> DataFrame:
    return agreement(spark, sf).select(r("adjusted_rand").alias("adjusted_rand"))


def agreement(spark: SparkSession, sf: str) -> DataFrame:
    return stats.agreement(cells(spark, sf).withColumn("other", F.col("cell") % 10), "group", "other")


@query("agg21_mutual_information", AGREE + ", h AS (SELECT (SELECT -sum(ra.r / s.n * ln(ra.r / s.n)) FROM ra, s) AS ha, (SELECT -sum(rb.r / s.n * ln(rb.r / s.n)) FROM rb, s) AS hb, (SELECT sum(c.n / s.n * ln(c.n * s.n / (ra.r * rb.r))) FROM c JOIN ra USING (a) JOIN rb USING (b), s) AS mi) SELECT round(mi / sqrt(ha * hb), 6) + 0 AS normalized_mutual_information FROM h")
def mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    return agreement(spark, sf).select(r("normalized_mutual_information").alias("normalized_mutual_information"))


@query("agg22_purity", AGREE + " SELECT round(t / n, 6) + 0 AS purity FROM s")
def purity(spark: SparkSession, sf: str) -> DataFrame:
    return agreement(spark, sf).select(r("purity").alias("purity"))


@query("agg23_rank_metrics", f"WITH {RELATIONS}, k AS (SELECT *, rank() OVER (PARTITION BY cluster, target ORDER BY score DESC) AS rank FROM relations), t AS (SELECT * FROM k WHERE (source * 7 + target) % 10 = 0) SELECT cluster, round(avg(1.0e0 / rank), 6) + 0 AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1e0 ELSE 0 END), 6) + 0 AS hits_at_1, round(avg(CASE WHEN rank <= 5 THEN 1e0 ELSE 0 END), 6) + 0 AS hits_at_5, count(*) AS n FROM t GROUP BY 1")
def rank_metrics(spark: SparkSession, sf: str) -> DataFrame:
    k = ranking.competition_rank(relations(spark, sf), ["cluster", "target"], "score").where("(source * 7 + target) % 10 = 0")
    m = stats.rank_metrics(k, ["cluster"], (1, 5))
    return m.select("cluster", r("mrr").alias("mrr"), r("hits_at_1").alias("hits_at_1"), r("hits_at_5").alias("hits_at_5"), "n")


@query("agg24_average_precision", f"WITH {RELATIONS}, k AS (SELECT *, CASE WHEN (source * 7 + target) % 10 = 0 THEN 1 ELSE 0 END AS hit, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, source, target) AS r FROM relations), s AS (SELECT *, sum(hit) OVER (PARTITION BY cluster ORDER BY r) AS seen FROM k) SELECT cluster, CAST(sum(hit) AS BIGINT) AS n_positive, round(sum(CASE WHEN hit = 1 THEN seen / r END) / sum(hit), 6) + 0 AS average_precision, round(sum(hit / log2(r + 1)) / list_sum(list_transform(range(1, CAST(sum(hit) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))), 6) + 0 AS log_rank_gain FROM s GROUP BY 1")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    s = relations(spark, sf).withColumn("hit", (F.col("source") * 7 + F.col("target")) % 10 == 0)
    a = stats.average_precision(s, ["cluster"], "score", "hit", ["source", "target"])
    return a.select("cluster", "n_positive", r("average_precision").alias("average_precision"), r("log_rank_gain").alias("log_rank_gain"))


def ln_choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"


@query("agg25_tie_averaged", f"WITH {RELATIONS}, e AS (SELECT cluster, target, floor(score / 200000000) AS s, CASE WHEN (source * 7 + target) % 10 = 0 THEN 1 ELSE 0 END AS hit FROM relations), b AS (SELECT cluster, target, s, count(*) AS m, sum(hit) AS h FROM e GROUP BY 1, 2, 3), c AS (SELECT *, coalesce(sum(m) OVER w, 0) AS rows_, coalesce(sum(h) OVER w, 0) AS hits FROM b WINDOW w AS (PARTITION BY cluster, target ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), p AS (SELECT *, unnest(range(1, m + 1)) AS j FROM c), a AS (SELECT cluster, target, sum(h / m * (hits + 1 + CASE WHEN m > 1 THEN (j - 1) * (h - 1) / (m - 1) ELSE 0 END) / (rows_ + j)) AS ap, sum(CASE WHEN h > 0 AND hits = 0 AND j - 1 <= m - h THEN exp({ln_choose('m - j', 'h - 1')} - {ln_choose('m', 'h')}) / (rows_ + j) ELSE 0 END) AS rr FROM p GROUP BY 1, 2), n AS (SELECT cluster, target, greatest(sum(h), 1) AS n, sum(h * (rows_ + (m + 1) / 2)) AS ranks FROM c GROUP BY 1, 2) SELECT cluster, target, round(ap / n, 6) + 0 AS average_precision, round(rr, 6) + 0 AS mrr, round(ranks / n, 6) + 0 AS mean_rank FROM n JOIN a USING (cluster, target)")
def tie_averaged(spark: SparkSession, sf: str) -> DataFrame:
    s = relations(spark, sf).withColumn("hit", (F.col("source") * 7 + F.col("target")) % 10 == 0).withColumn("score", F.floor(F.col("score") / 200000000).cast("double"))
    return stats.tie_averaged(s, ["cluster", "target"], "score", "hit").select("cluster", "target", *(r(c).alias(c) for c in ("average_precision", "mrr", "mean_rank")))


@query("agg26_fisher_exact", f"WITH o AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus <> 'F') AS b FROM orders GROUP BY 1), t AS (SELECT *, CAST(sum(a) OVER () - a AS BIGINT) AS c, CAST(sum(b) OVER () - b AS BIGINT) AS d FROM o), q AS (SELECT *, a + b AS row_, a + c AS column_, a + b + c + d AS total FROM t), k AS (SELECT *, unnest(range(greatest(0, row_ + column_ - total), least(row_, column_) + 1)) AS k FROM q), p AS (SELECT *, exp({ln_choose('row_', 'k')} + {ln_choose('(total - row_)', 'column_ - k')} - {ln_choose('total', 'column_')}) AS pk FROM k), z AS (SELECT *, max(CASE WHEN k = a THEN pk END) OVER (PARTITION BY o_orderpriority) AS own FROM p) SELECT o_orderpriority, a, b, c, d, round(least(1, sum(CASE WHEN pk <= own * (1 + 1e-10) THEN pk ELSE 0 END)), 6) + 0 AS p FROM z GROUP BY 1, 2, 3, 4, 5")
def fisher(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") != "F").alias("b"))
    w = Window.partitionBy()
    t = t.withColumn("c", F.sum("a").over(w) - F.col("a")).withColumn("d", F.sum("b").over(w) - F.col("b"))
    return t.withColumn("p", r(stats.fisher_exact("a", "b", "c", "d")))


@query("agg27_benjamini_hochberg", f"WITH {RELATIONS}, p AS (SELECT cluster, source, target, 1 / (1 + score / 100000000e0) AS p FROM relations), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p, source, target) AS r, count(*) OVER (PARTITION BY cluster) AS n FROM p) SELECT cluster, source, target, round(least(min(p * n / r) OVER (PARTITION BY cluster ORDER BY r DESC), 1), 6) + 0 AS fdr FROM k")
def benjamini_hochberg(spark: SparkSession, sf: str) -> DataFrame:
    p = relations(spark, sf).select("cluster", "source", "target", (1 / (1 + F.col("score") / 100000000.0)).alias("p"))
    return stats.benjamini_hochberg(p, "p", ["cluster"], ["source", "target"]).select("cluster", "source", "target", r("fdr").alias("fdr"))


@query("agg28_log_odds", "SELECT o_orderpriority, round(log2((a + 0.5e0) * (d + 0.5e0) / ((b + 0.5e0) * (c + 0.5e0))), 6) + 0 AS log2_odds FROM (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b, count(*) FILTER (o_totalprice > 100000) AS c, count(*) FILTER (o_totalprice <= 100000) AS d FROM orders GROUP BY 1)")
def log_odds(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"), F.count_if(F.col("o_totalprice") > 100000).alias("c"), F.count_if(F.col("o_totalprice") <= 100000).alias("d"))
    return t.select("o_orderpriority", r(stats.log_odds(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).alias("log2_odds"))


AVERAGE_RANK = "rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0e0"


@query("agg29_rank_sum", f"WITH e AS (SELECT event_type, value, user_id % 2 = 0 AS inside FROM events), k AS (SELECT *, {AVERAGE_RANK.format(by='event_type', v='value')} AS rank FROM e), t AS (SELECT event_type, CAST(sum(t * t * t - t) AS DOUBLE) AS ties FROM (SELECT event_type, value, count(*) AS t FROM e GROUP BY 1, 2) GROUP BY 1), s AS (SELECT event_type, CAST(count(*) FILTER (inside) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT inside) AS DOUBLE) AS n2, sum(CASE WHEN inside THEN rank END) AS r1 FROM k GROUP BY 1) SELECT event_type, n1, n2, round(r1 - n1 * (n1 + 1) / 2, 2) + 0 AS u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 5) + 0 AS z FROM s JOIN t USING (event_type)")
def rank_sum(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", "value", (F.col("user_id") % 2 == 0).alias("inside"))
    return stats.rank_sum(e, "value", "inside", ["event_type"]).select("event_type", "n1", "n2", r("u", 2).alias("u"), r("z", 5).alias("z"))


@query("agg31_kruskal_wallis", f"WITH e AS (SELECT event_type, value, user_id % 4 AS g FROM events), k AS (SELECT *, {AVERAGE_RANK.format(by='event_type', v='value')} AS rank FROM e), t AS (SELECT event_type, CAST(sum(t * t * t - t) AS DOUBLE) AS ties FROM (SELECT event_type, value, count(*) AS t FROM e GROUP BY 1, 2) GROUP BY 1), s AS (SELECT event_type, g, CAST(count(*) AS DOUBLE) AS k, sum(rank) AS r FROM k GROUP BY 1, 2), h AS (SELECT event_type, sum(k) AS n, sum(r * r / k) AS s, count(*) - 1 AS df FROM s GROUP BY 1) SELECT event_type, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) + 0 AS h, df FROM h JOIN t USING (event_type)")
def kruskal(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", "value", (F.col("user_id") % 4).alias("g"))
    return stats.kruskal_wallis(e, "value", "g", ["event_type"]).withColumn("h", r("h", 4))


@query("agg31_chi_square", "WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS r FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS r FROM c GROUP BY 1) SELECT round((SELECT sum(n) FROM c) * (sum(n * n / CAST(ra.r * rb.r AS DOUBLE)) - 1), 5) + 0 AS chi2, ((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM rb) - 1) AS df FROM c JOIN ra USING (a) JOIN rb USING (b)")
def chi_square(spark: SparkSession, sf: str) -> DataFrame:
    return stats.chi_square(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").withColumn("chi2", r("chi2", 5))


@query("agg32_spearman", f"WITH k AS (SELECT l_returnflag, {AVERAGE_RANK.format(by='l_returnflag', v='l_quantity')} AS a, {AVERAGE_RANK.format(by='l_returnflag', v='l_extendedprice')} AS b FROM lineitem) SELECT l_returnflag, round(corr(a, b), 6) + 0 AS spearman FROM k GROUP BY 1")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return stats.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn("spearman", r("spearman"))


@query("agg33_positive_pearson", f"WITH {CELLS}, {EXPR}, {RESIDUAL}, c AS (SELECT grp, a.gene AS receptor, b.gene AS target, CASE WHEN stddev_pop(a.value) > 1e-9 AND stddev_pop(b.value) > 1e-9 THEN greatest(0, corr(a.value, b.value)) ELSE 0 END AS r FROM expr a JOIN residual b USING (cell) JOIN cells USING (cell) GROUP BY 1, 2, 3) SELECT grp AS \"group\", target, round(max(r), 6) + 0 AS score FROM c GROUP BY 1, 2")
def positive_pearson(spark: SparkSession, sf: str) -> DataFrame:
    j = expression(spark, sf).select("cell", F.col("gene").alias("receptor"), F.col("value").alias("a")).join(residual(spark, sf).select("cell", F.col("gene").alias("target"), F.col("value").alias("b")), "cell").join(cells(spark, sf).select("cell", "group"), "cell")
    c = j.groupBy("group", "receptor", "target").agg(F.when((F.stddev_pop("a") > 1e-9) & (F.stddev_pop("b") > 1e-9), F.greatest(F.lit(0.0), F.corr("a", "b"))).otherwise(0.0).alias("r"))
    return c.groupBy("group", "target").agg(r(F.max("r")).alias("score"))


@query("agg34_fold_regression", f"WITH {EXPR}, {RESIDUAL}, d AS (SELECT gene, cell % 5 AS fold, a.value AS x, b.value AS y FROM expr a JOIN residual b USING (cell, gene)), f AS (SELECT gene, r.fold, avg(x) FILTER (d.fold <> r.fold) AS mx, avg(y) FILTER (d.fold <> r.fold) AS my, covar_pop(y, x) FILTER (d.fold <> r.fold) AS c, var_pop(x) FILTER (d.fold <> r.fold) AS v, count(*) FILTER (d.fold <> r.fold) AS tn, count(*) FILTER (d.fold = r.fold) AS n FROM d, range(0, 5) r(fold) GROUP BY 1, 2), b AS (SELECT gene, fold, my, CASE WHEN v > 1e-12 THEN c / v ELSE 0 END AS b, mx FROM f WHERE tn >= 20 AND n >= 5), e AS (SELECT gene, fold, any_value(b) AS b, sum((y - my) * (y - my)) AS base, sum((y - my - b * (x - mx)) * (y - my - b * (x - mx))) AS fit FROM d JOIN b USING (gene, fold) GROUP BY 1, 2) SELECT gene, count(*) AS folds, round(1 - sum(fit) / sum(base), 6) + 0 AS mse_reduction, round(avg(b), 6) + 0 AS effect, round(abs(avg(sign(b))), 6) + 0 AS sign_agreement FROM e GROUP BY 1")
def fold_regression(spark: SparkSession, sf: str) -> DataFrame:
    d = expression(spark, sf).select("cell", "gene", F.col("value").alias("x"), (F.col("cell") % 5).alias("fold")).join(residual(spark, sf).withColumnRenamed("value", "y"), ["cell", "gene"])
    return stats.fold_regression(d, ["gene"], 5).select("gene", "folds", r("mse_reduction").alias("mse_reduction"), r("effect").alias("effect"), r("sign_agreement").alias("sign_agreement"))


@query("agg35_dose_response", f"WITH {EXPR}, {RESIDUAL}, d AS (SELECT a.value AS dose, b.value AS y FROM expr a JOIN residual b USING (cell, gene) WHERE gene = 1 AND a.value > 0), q AS (SELECT {', '.join(f'quantile_cont(dose, {i / 5!r}) AS q{i}' for i in range(1, 5))} FROM d) SELECT CAST({' + '.join(f'CASE WHEN q{i} < dose THEN 1 ELSE 0 END' for i in range(1, 5))} AS INTEGER) AS bin, count(*) AS n, round(avg(y), 6) + 0 AS mean, round(avg(CASE WHEN y > 0 THEN 1e0 ELSE 0 END), 6) + 0 AS positive, round(1.96e0 * stddev_samp(y) / sqrt(count(*)), 6) + 0 AS error FROM d, q GROUP BY 1")
def dose_response(spark: SparkSession, sf: str) -> DataFrame:
    d = expression(spark, sf).where("gene = 1 and value > 0").withColumnRenamed("value", "dose").join(residual(spark, sf).withColumnRenamed("value", "y"), ["cell", "gene"])
    return stats.dose_response(d, "dose", "y", 5).select("bin", "n", r("mean").alias("mean"), r("positive").alias("positive"), r("error").alias("error"))


@query("agg36_clipped", f"WITH {EXPR}, q AS (SELECT gene, quantile_cont(value, 0.98) AS q FROM expr GROUP BY 1) SELECT cell, gene, round(least(value, q), 6) + 0 AS value FROM expr JOIN q USING (gene)")
def clipped(spark: SparkSession, sf: str) -> DataFrame:
    return stats.clipped(expression(spark, sf), "value", 0.98, ["gene"]).select("cell", "gene", r("value").alias("value"))


@query("agg37_transition_score", f"WITH {CELLS}, {EXPR} SELECT gene, round((avg(value) FILTER (grp < 5) - avg(value) FILTER (grp >= 5)) / greatest(sqrt((var_pop(value) FILTER (grp < 5) + var_pop(value) FILTER (grp >= 5)) / 2), 1e-6), 6) + 0 AS score FROM expr JOIN cells USING (cell) GROUP BY 1")
def transition_score(spark: SparkSession, sf: str) -> DataFrame:
    j = expression(spark, sf).join(cells(spark, sf).select("cell", "group"), "cell")
    v = lambda c: F.when(F.col("group") < 5, F.col("value")) if c else F.when(F.col("group") >= 5, F.col("value"))
    pooled = F.greatest(F.sqrt((F.var_pop(v(1)) + F.var_pop(v(0))) / 2), F.lit(1e-6))
    return j.groupBy("gene").agg(r((F.avg(v(1)) - F.avg(v(0))) / pooled).alias("score"))


@query("agg38_source_totals", f"WITH {RELATIONS} SELECT source, round(sum(greatest(score - 300000000, 0)), 2) + 0 AS total, count(DISTINCT target) FILTER (score > 300000000) AS targets FROM relations GROUP BY 1")
def source_totals(spark: SparkSession, sf: str) -> DataFrame:
    over = F.greatest(F.col("score") - 300000000, F.lit(0.0))
    return relations(spark, sf).groupBy("source").agg(r(F.sum(over), 2).alias("total"), F.countDistinct(F.when(F.col("score") > 300000000, F.col("target"))).alias("targets"))


@query("agg40_expression_fraction", "SELECT p_partkey, round(n / (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R'), 6) + 0 AS fraction FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON p_partkey = l_partkey")
def expression_fraction(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    n = c.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_orderkey").alias("n"))
    return table(spark, sf, "part").select("p_partkey").join(n, "p_partkey", "left").crossJoin(F.broadcast(c.agg(F.countDistinct("l_orderkey").alias("t")))).select("p_partkey", r(F.col("n") / F.col("t")).alias("fraction"))


@query("agg41_dominant_type", f"WITH {CELLS}, {EXPR}, m AS (SELECT gene, grp, avg(value) AS m FROM expr JOIN cells USING (cell) GROUP BY 1, 2) SELECT gene, first(grp ORDER BY round(m, 9) DESC, grp) AS type FROM m GROUP BY 1")
def dominant_type(spark: SparkSession, sf: str) -> DataFrame:
    m = expression(spark, sf).join(cells(spark, sf).select("cell", "group"), "cell").groupBy("gene", "group").agg(F.round(F.avg("value"), 9).alias("m"))
    return ranking.first_of(m, ["gene"], [F.desc("m"), "group"]).select("gene", F.col("group").alias("type"))


@query("agg42_weighted_detection", f"WITH {CELLS}, {EXPR}, d AS (SELECT gene, grp, avg(CASE WHEN value > 0 THEN 1e0 ELSE 0 END) AS d, count(*) AS n FROM expr JOIN cells USING (cell) GROUP BY 1, 2), w AS (SELECT gene, sum(d * n) / sum(n) AS w, max(d) AS top FROM d WHERE grp IN (1, 3, 5) GROUP BY 1) SELECT gene, round(w, 6) + 0 AS detection, CASE WHEN w >= 0.5e0 THEN 'common' WHEN top >= 0.5e0 THEN 'specific' ELSE 'rare' END AS rule FROM w")
def weighted_detection(spark: SparkSession, sf: str) -> DataFrame:
    d = expression(spark, sf).join(cells(spark, sf).select("cell", "group"), "cell").groupBy("gene", "group").agg(F.avg(F.when(F.col("value") > 0, 1.0).otherwise(0.0)).alias("d"), F.count("*").alias("n"))
    w = d.where("group in (1, 3, 5)").groupBy("gene").agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("w"), F.max("d").alias("top"))
    return w.select("gene", r("w").alias("detection"), F.when(F.col("w") >= 0.5, "common").when(F.col("top") >= 0.5, "specific").otherwise("rare").alias("rule"))


@query("agg43_winsorized", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.01) AS l, quantile_cont(c_acctbal, 0.99) AS h FROM customer), v AS (SELECT c_custkey, least(greatest(c_acctbal, l), h) AS v FROM customer, q), m AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM v) SELECT c_custkey, round((v - m) / s, 6) + 0 AS z FROM v, m")
def winsorized(spark: SparkSession, sf: str) -> DataFrame:
    return stats.winsorized_score(table(spark, sf, "customer"), "c_acctbal").select("c_custkey", r("z").alias("z"))


@query("agg44_constraints", "WITH n AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT t.p_size, least_n, coalesce(n, 0) AS n, coalesce(n, 0) >= least_n AS met FROM (VALUES (1, 5), (2, 50), (99, 1)) t(p_size, least_n) LEFT JOIN n ON n.p_size = t.p_size")
def constraints(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.createDataFrame([(1, 5), (2, 50), (99, 1)], "p_size int, least_n int")
    n = table(spark, sf, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    return t.join(n, "p_size", "left").na.fill(0, ["n"]).withColumn("met", F.col("n") >= F.col("least_n"))


@query("agg46_pivot", "SELECT o_orderstatus, coalesce(max(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 0) AS urgent, coalesce(max(o_totalprice) FILTER (o_orderpriority = '5-LOW'), 0) AS low FROM orders GROUP BY 1")
def pivot(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.max("o_totalprice")).na.fill(0.0)
    return p.select("o_orderstatus", F.col("1-URGENT").alias("urgent"), F.col("5-LOW").alias("low"))


@query("agg47_replicates", f"WITH {CELLS}, {RESIDUAL}, m AS (SELECT grp, gene, cell % 4 AS seed, avg(value) AS m FROM residual JOIN cells USING (cell) GROUP BY 1, 2, 3) SELECT grp AS \"group\", gene, round(avg(m), 6) + 0 AS mean, round(stddev_samp(m), 6) + 0 AS sd, (grp, gene) IN ((1, 2), (3, 4)) AS planted FROM m GROUP BY 1, 2")
def replicates(spark: SparkSession, sf: str) -> DataFrame:
    m = residual(spark, sf).join(cells(spark, sf).select("cell", "group"), "cell").groupBy("group", "gene", (F.col("cell") % 4).alias("seed")).agg(F.avg("value").alias("m"))
    planted = spark.createDataFrame([(1, 2, True), (3, 4, True)], "group int, gene long, planted boolean")
    g = m.groupBy("group", "gene").agg(r(F.avg("m")).alias("mean"), r(F.stddev_samp("m")).alias("sd"))
    return g.join(planted, ["group", "gene"], "left").na.fill(False, ["planted"])


# --- ranks, top-k, sets


@query("win01_row_number", f"WITH {RELATIONS} SELECT cluster, source, target, row_number() OVER (PARTITION BY cluster, target ORDER BY score DESC, source) AS rank FROM relations")
def row_number(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.ranked(relations(spark, sf), ["cluster", "target"], "score", ["source"]).select("cluster", "source", "target", F.col("rank").cast("long").alias("rank"))


@query("win02_competition_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS rank FROM lineitem")
def competition_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.competition_rank(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("win05_first_n", f"WITH {RELATIONS} SELECT cluster, source, target, score FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, source, target) AS k FROM relations) WHERE k <= 8")
def first_n(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top(relations(spark, sf), ["cluster"], "score", ["source", "target"], 8).drop("rank")


@query("win06_group_transform", f"WITH {RELATIONS} SELECT cluster, source, target, round(score - avg(score) OVER w, 3) + 0 AS centred, round(stddev_samp(score) OVER w, 1) + 0 AS sd FROM relations WINDOW w AS (PARTITION BY cluster, target)")
def group_transform(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("cluster", "target")
    return relations(spark, sf).select("cluster", "source", "target", r(F.col("score") - F.avg("score").over(w), 3).alias("centred"), r(F.stddev_samp("score").over(w), 1).alias("sd"))


@query("win07_share", f"WITH {RELATIONS} SELECT cluster, source, target, round(abs(score) / sum(abs(score)) OVER (PARTITION BY cluster, target), 8) + 0 AS share FROM relations")
def share(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.share(relations(spark, sf), ["cluster", "target"], "score").select("cluster", "source", "target", r("share", 8).alias("share"))


@query("win09_cumulative_recall", f"WITH {RELATIONS}, k AS (SELECT *, CASE WHEN (source * 7 + target) % 10 = 0 THEN 1 ELSE 0 END AS h, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, source, target) AS rank FROM relations) SELECT cluster, rank, CAST(sum(h) OVER (PARTITION BY cluster ORDER BY rank) AS BIGINT) AS hits, round(sum(h) OVER (PARTITION BY cluster ORDER BY rank) / sum(h) OVER (PARTITION BY cluster), 6) + 0 AS recall FROM k")
def cumulative_recall(spark: SparkSession, sf: str) -> DataFrame:
    s = relations(spark, sf).withColumn("hit", (F.col("source") * 7 + F.col("target")) % 10 == 0)
    return ranking.cumulative_hits(s, ["cluster"], "score", ["source", "target"], "hit").select("cluster", F.col("rank").cast("long").alias("rank"), "hits", r("recall").alias("recall"))


@query("win12_top_two_margin", f"WITH {RELATIONS} SELECT cluster, target, source, round(score - next, 2) + 0 AS margin FROM (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS next FROM relations WINDOW w AS (PARTITION BY cluster, target ORDER BY score DESC, source)) WHERE k = 1")
def top_two_margin(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_two_margin(relations(spark, sf), ["cluster", "target"], "score", ["source"]).select("cluster", "target", "source", r("margin", 2).alias("margin"))


@query("win13_keep_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.first_of(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("win14_nested_top", f"WITH {RELATIONS}, b AS (SELECT cluster, target, max(score) AS best FROM relations GROUP BY 1, 2), t AS (SELECT cluster, target, row_number() OVER (PARTITION BY cluster ORDER BY best DESC, target) AS target_rank FROM b), s AS (SELECT cluster, target, target_rank, source, row_number() OVER (PARTITION BY cluster, target ORDER BY score DESC, source) AS source_rank FROM relations JOIN t USING (cluster, target) WHERE target_rank <= 4) SELECT * FROM s WHERE source_rank <= 3")
def nested_top(spark: SparkSession, sf: str) -> DataFrame:
    n = ranking.nested_top(relations(spark, sf), "cluster", "target", "source", "score", 4, 3)
    return n.select("cluster", "target", F.col("target_rank").cast("long").alias("target_rank"), "source", F.col("source_rank").cast("long").alias("source_rank"))


@query("win15_shared_top", f"WITH {RELATIONS}, s AS (SELECT cluster, target, sum(score) AS s FROM relations GROUP BY 1, 2), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(s, 2) DESC, target) AS k FROM s) WHERE k <= 10) SELECT cluster, target, count(*) OVER (PARTITION BY target) AS groups FROM t")
def shared_top(spark: SparkSession, sf: str) -> DataFrame:
    s = relations(spark, sf).groupBy("cluster", "target").agg(F.round(F.sum("score"), 2).alias("s"))
    return ranking.shared_top(s, "cluster", "target", "s", 10).select("cluster", "target", "groups")


@query("top01_bounded_top_k", f"WITH {RELATIONS} SELECT cluster, source, target, score FROM relations ORDER BY score DESC, cluster, source, target LIMIT 50")
def bounded_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return relations(spark, sf).orderBy(F.desc("score"), "cluster", "source", "target").limit(50)


@query("top02_top_fraction", f"WITH {RELATIONS} SELECT cluster, source, target, score FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, source, target) AS k, count(*) OVER (PARTITION BY cluster) AS n FROM relations) WHERE k <= least(ceil(n * 0.05e0), 40)")
def top_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_fraction(relations(spark, sf), ["cluster"], "score", ["source", "target"], 0.05, 40).drop("rank")


@query("top06_greedy_panel")
def greedy_panel(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    name = F.col("p_partkey").cast("string")
    inter = p.groupBy(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("interaction")).agg(F.array_sort(F.collect_set(name)).alias("genes"), F.sum("p_retailprice").alias("score"))
    return panel.greedy_panel(spark, inter, p.select(F.col("p_brand").alias("label"), name.alias("gene"), F.col("p_retailprice").alias("score")), p.select(name.alias("gene"), F.col("p_size").alias("score")), p.select(name.alias("gene"), F.col("p_retailprice").alias("score")), 120)


@query("top07_quota_panel")
def quota_panel(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("gene"), F.substring_index("p_type", " ", 1).alias("role"), F.col("p_retailprice").alias("score"), (F.col("p_size") > 10).alias("eligible"))
    return panel.quota_panel(spark, p, {"ECONOMY": 10, "PROMO": 5}, 30)


def grid_sql(size: int, starts: int, steps: int) -> str:
    """The alternating choice unrolled step by step; a choice that no longer changes stays as it is."""
    def chosen(name: str, given: str, of: str, to: str) -> str:
        return (f"{name} AS MATERIALIZED (SELECT cluster, start, {to} FROM (SELECT *, row_number() OVER (PARTITION BY cluster, start ORDER BY s DESC, {to}) AS k FROM ("
                f"SELECT r.cluster, r.start, n.{to}, coalesce(sum(score), 0) AS s FROM runs r JOIN (SELECT DISTINCT cluster, {to} FROM relations) n USING (cluster) LEFT JOIN (SELECT g.cluster, g.start, t.{to}, t.score FROM {given} g JOIN relations t ON t.cluster = g.cluster AND t.{of} = g.{of}) j ON j.cluster = r.cluster AND j.start = r.start AND j.{to} = n.{to} GROUP BY 1, 2, 3)) WHERE k <= {size})")  # fmt: skip

    first = f"r0 AS MATERIALIZED (SELECT cluster, k AS start, source FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, source) AS k FROM (SELECT cluster, source, sum(score) AS s FROM relations GROUP BY 1, 2)) WHERE k <= {starts}), runs AS MATERIALIZED (SELECT cluster, start FROM r0)"
    steps_ = [x for i in range(steps) for x in (chosen(f"c{i}", f"r{i}", "source", "target"), chosen(f"r{i + 1}", f"c{i}", "target", "source"))]
    grid = f"grid AS (SELECT a.cluster, a.start, a.source, b.target, coalesce(score, 0) AS score FROM r{steps} a JOIN c{steps - 1} b USING (cluster, start) LEFT JOIN relations t ON t.cluster = a.cluster AND t.source = a.source AND t.target = b.target)"
    return ", ".join([first, *steps_, grid, "best AS (SELECT cluster, start FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, start) AS k FROM (SELECT cluster, start, sum(score) AS s FROM grid GROUP BY 1, 2)) WHERE k = 1)"])


@query("top08_dense_grid", f"WITH {RELATIONS}, {grid_sql(5, 5, 12)} SELECT cluster, source, target, round(score, 2) + 0 AS score FROM grid JOIN best USING (cluster, start)")
def dense_grid(spark: SparkSession, sf: str) -> DataFrame:
    return panel.dense_grid(relations(spark, sf)).withColumn("score", r("score", 2))


@query("set01_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'all', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersection', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'difference', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT 'distinct', count(DISTINCT c_nationkey) FROM customer")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    c, s, n = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier"), table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    k = s.select(F.col("s_nationkey").alias("k"))
    parts = {"union": c.union(k).distinct(), "all": c.union(k), "intersection": c.intersect(k), "difference": n.subtract(s.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))), "distinct": c.distinct()}
    out = None
    for op, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("set06_every_other", "SELECT n_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS k FROM (SELECT DISTINCT n_name FROM nation)) WHERE k % 2 = 1")
def every_other(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.every_other(table(spark, sf, "nation"), "n_name")


# --- samples


@query("smp01_balanced_subset", f"WITH {CELLS}, k AS (SELECT cell, grp, row_number() OVER (PARTITION BY grp ORDER BY cell) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n FROM cells), t AS (SELECT *, least(n, 200 // (SELECT count(DISTINCT grp) FROM cells)) AS take FROM k) SELECT cell, grp AS \"group\" FROM t WHERE list_contains(list_transform(range(0, take), lambda i: i * n // take), r)")
def balanced(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.balanced(cells(spark, sf).select("cell", "group"), "group", "cell", 200)


@query("smp02_systematic_subset", "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT vec_id FROM embeddings, n WHERE list_contains(list_transform(range(0, 70), lambda i: i * n // 70), vec_id)")
def systematic(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id")
    return sampling.systematic(e, "vec_id", e.count(), 70)


@query("smp03_stratified_sample", f"WITH {CELLS}, k AS (SELECT cell, grp, row_number() OVER (PARTITION BY grp ORDER BY md5('7/' || cell), cell) AS r, count(*) OVER (PARTITION BY grp) AS n FROM cells) SELECT cell, grp AS \"group\" FROM k WHERE r <= greatest(1, round(n * 0.3e0))")
def stratified(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified(cells(spark, sf).select("cell", "group"), "group", "cell", 0.3, 7)


@query("smp04_epoch_sample", f"WITH {CELLS}, k AS (SELECT cell, cell % 4 AS sample, md5('42/3/' || cell) AS h FROM cells), o AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY h, cell) > 20 AS late FROM k) SELECT cell, sample FROM o ORDER BY late, h, cell LIMIT 200")
def epoch_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.epoch_sample(cells(spark, sf).select("cell", (F.col("cell") % 4).alias("sample")), "sample", "cell", 200, 20, 42, 3)


@query("smp05_permuted_rows", f"WITH {CELLS} SELECT cell, row_number() OVER (ORDER BY md5('11/' || cell), cell) - 1 AS taken FROM cells")
def permuted(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.permuted(cells(spark, sf).select("cell"), "cell", 11)


POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


@query("smp06_bootstrap", f"WITH {CELLS}, {EXPR}, u AS (SELECT cell, n, CAST('0x' || substr(md5('5/' || n || '/' || cell), 1, 7) AS BIGINT) / 268435456e0 AS u FROM cells, range(1, 201) t(n)), w AS (SELECT cell, n, {' + '.join(f'CASE WHEN u >= {e!r} THEN 1 ELSE 0 END' for e in POISSON)} AS w FROM u), m AS (SELECT gene, n, sum(w * value) / sum(w) AS m FROM expr JOIN w USING (cell) GROUP BY 1, 2), q AS (SELECT gene, quantile_cont(m, {(1 - 0.95) / 2!r}) AS low, quantile_cont(m, {1 - (1 - 0.95) / 2!r}) AS high FROM m GROUP BY 1) SELECT gene, round(avg(value), 6) + 0 AS mean, round(any_value(low), 6) + 0 AS low, round(any_value(high), 6) + 0 AS high FROM expr JOIN q USING (gene) GROUP BY 1")
def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    e = expression(spark, sf).withColumnRenamed("cell", "key")
    return sampling.bootstrap(e, "value", ["gene"], 200, 5).select("gene", *(r(c).alias(c) for c in ("mean", "low", "high")))


@query("smp07_permutation_null", "WITH p AS (SELECT p_partkey AS k, p_retailprice AS score, CASE WHEN p_size <= 5 THEN 1 ELSE 0 END AS hit FROM part), o AS (SELECT n, hit, row_number() OVER w AS r, sum(hit) OVER w AS seen FROM p, range(0, 101) t(n) WINDOW w AS (PARTITION BY n ORDER BY CASE WHEN n = 0 THEN score ELSE 0 END DESC, CASE WHEN n > 0 THEN md5('3/' || n || '/' || k) END, k)), a AS (SELECT n, avg(CASE WHEN hit = 1 THEN seen / r END) AS ap FROM o GROUP BY 1), b AS (SELECT ap AS observed FROM a WHERE n = 0) SELECT round(observed, 6) + 0 AS observed, round(avg(ap), 6) + 0 AS expected, round((1 + count(*) FILTER (ap >= observed)) / (count(*) + 1), 6) + 0 AS p FROM a, b WHERE n > 0 GROUP BY observed")
def permutation_null(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("score"), (F.col("p_size") <= 5).alias("hit"))
    return sampling.permutation_null(p, "score", "hit", "p_partkey", 100, 3).select(*(r(c).alias(c) for c in ("observed", "expected", "p")))


# --- scalar functions


@query("fn01_bessel", f"SELECT c_custkey, round({bessel_k0('x')}, 9) + 0 AS k0, round({bessel_i0('x')} / exp(x), 9) + 0 AS scaled_i0 FROM (SELECT c_custkey, abs(c_acctbal) / 1000 + 0.01e0 AS x FROM customer)")
def bessel(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "customer").select("c_custkey", (F.abs("c_acctbal") / 1000 + 0.01).alias("x"))
    return t.select("c_custkey", r(F.expr(bessel_k0("x")), 9).alias("k0"), r(F.expr(bessel_i0("x")) / F.exp("x"), 9).alias("scaled_i0"))


@query("fn03_soft_threshold", "SELECT c_custkey, round(CASE WHEN abs(v) > 0.3e0 THEN sign(v) * (abs(v) - 0.3e0) ELSE 0 END, 6) + 0 AS soft FROM (SELECT c_custkey, c_acctbal / 10000 AS v FROM customer)")
def soft_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", r(scalars.soft_threshold(F.col("c_acctbal") / 10000, 0.3)).alias("soft"))


@query("fn04_softmax", "WITH l AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 9)) AS i)), e AS (SELECT vec_id, i, exp(greatest(v - max(v) OVER (PARTITION BY vec_id), -60)) AS e FROM l) SELECT vec_id, CAST(i - 1 AS INTEGER) AS k, round(e / sum(e) OVER (PARTITION BY vec_id), 6) + 0 AS p FROM e")
def softmax(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.posexplode(scalars.softmax(F.col("v"))).alias("k", "p")).withColumn("p", r("p"))


@query("fn05_hill", f"WITH {EXPR} SELECT cell, gene, round(pow(value / 0.1e0, 1.5e0) / (1 + pow(value / 0.1e0, 1.5e0)), 6) + 0 AS response FROM expr")
def hill(spark: SparkSession, sf: str) -> DataFrame:
    return expression(spark, sf).select("cell", "gene", r(scalars.hill(F.col("value"), 0.1)).alias("response"))


FOLD = "xor(CAST(floor(x / 0.1e0) AS BIGINT) * 73856093, CAST(floor(y / 0.1e0) AS BIGINT) * 19349663)"


@query("fn06_spatial_folds", f"WITH {CELLS} SELECT cell, (({FOLD} % 5) + 5) % 5 AS floor_fold, abs({FOLD}) % 5 AS absolute_fold FROM cells")
def spatial_folds(spark: SparkSession, sf: str) -> DataFrame:
    b = [F.floor(F.col(a) / 0.1).cast("long") for a in ("x", "y")]
    return cells(spark, sf).select("cell", scalars.fold_id(b, 5).cast("long").alias("floor_fold"), scalars.fold_id(b, 5, "absolute").cast("long").alias("absolute_fold"))


@query("fn09_text_functions", "SELECT p_partkey, upper(trim(p_name)) AS up, split_part(p_type, ' ', 2) AS middle, len(string_split(p_name, ' ')) AS words, starts_with(p_brand, 'Brand#1') AS first, replace(p_type, ' ', '_') AS joined FROM part")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.upper(F.trim("p_name")).alias("up"), F.split_part("p_type", F.lit(" "), F.lit(2)).alias("middle"), F.size(F.split("p_name", " ")).cast("long").alias("words"), F.col("p_brand").startswith("Brand#1").alias("first"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("joined"))


@query("fn10_regex", "SELECT p_partkey, regexp_matches(p_type, '(?i)^(promo|economy)') AS hit, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits FROM part")
def regex(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.col("p_type").rlike("(?i)^(promo|economy)").alias("hit"), F.regexp_replace("p_brand", "[^0-9]", "").alias("digits"))


@query("fn11_clean_names", "SELECT p_partkey, trim(p_name) AS name FROM part")
def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", names.clean_name("p_name").alias("name"))


@query("fn12_symbol_mapping", "WITH known AS (SELECT n_name AS symbol FROM nation), names(name) AS (VALUES ('NATION_3'), ('nation_4'), ('Holland'), ('nowhere')) SELECT name, coalesce((SELECT symbol FROM known WHERE symbol = name), CASE WHEN name = 'Holland' THEN 'NATION_7' END, (SELECT max(symbol) FROM known WHERE lower(symbol) = lower(name))) AS mapped, CASE WHEN name IN (SELECT symbol FROM known) THEN 'exact' WHEN name = 'Holland' THEN 'alias' WHEN lower(name) IN (SELECT lower(symbol) FROM known) THEN 'case' ELSE 'absent' END AS status FROM names")
def symbol_mapping(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "nation").select(F.col("n_name").alias("symbol"))
    asked = spark.createDataFrame([("NATION_3",), ("nation_4",), ("Holland",), ("nowhere",)], "name string")
    return names.map_names(asked, known, spark.createDataFrame([("Holland", "NATION_7")], "alias string, symbol string"))


@query("fn13_label_rules", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)brass') THEN 'brass' WHEN regexp_matches(p_type, '(?i)^promo') THEN 'promo' ELSE 'other' END AS label FROM part")
def label_rules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", names.label_by_rules(F.col("p_type"), [("brass", "brass"), ("^promo", "promo")], "other").alias("label"))


@query("fn15_list_functions", "SELECT l_orderkey, len(list_distinct(list(l_partkey))) AS parts, list_contains(list(l_linenumber), 3) AS third, max(l_quantity) > 40 AS any_large, min(l_quantity) > 10 AS all_large FROM lineitem GROUP BY 1")
def list_functions(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("p"), F.collect_list("l_linenumber").alias("n"), F.collect_list("l_quantity").alias("q"))
    return g.select("l_orderkey", F.size(F.array_distinct("p")).cast("long").alias("parts"), F.array_contains("n", 3).alias("third"), F.exists("q", lambda v: v > 40).alias("any_large"), F.forall("q", lambda v: v > 10).alias("all_large"))
