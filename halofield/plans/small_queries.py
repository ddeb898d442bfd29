"""Queries over single rules: hashes, keys, ranks, parameters, small graphs, and parts of the fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels, scalars
from ..operators import effects, fields, generators, graphs, groups, matrix, ranking, sampling, spatial
from ..sources import readers
from .model_queries import CENTRES, HARD, SCREEN, embedding, fitted, joined, standard
from .registry import CELLS, EDGES, EXPR, GAP3, RADIUS, RELATIONS, cells, expression, knn, query, r, relations, table


@query("flt08_selected_relations", f"WITH {RELATIONS} SELECT cluster, source, target FROM relations WHERE (source * 7 + target) % 10 = 0")
def selected_relations(spark: SparkSession, sf: str) -> DataFrame:
    flagged = relations(spark, sf).withColumn("selected", F.when((F.col("source") * 7 + F.col("target")) % 10 == 0, "True").otherwise("no"))
    return flagged.where(scalars.truthy(F.col("selected"))).select("cluster", "source", "target")


@query("win03_minimum_rank", f"WITH {RELATIONS} SELECT cluster, source, target, rank() OVER (PARTITION BY cluster ORDER BY round(score / 1e8)) AS rank FROM relations")
def minimum_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Rising ranks; equal scores share the smallest."""
    s = relations(spark, sf).withColumn("falling", -F.round(F.col("score") / 1e8))
    return ranking.competition_rank(s, ["cluster"], "falling").select("cluster", "source", "target", F.col("rank").cast("long").alias("rank"))


@query("win10_running_minimum", f"WITH {RELATIONS} SELECT cluster, source, target, min(score) OVER (PARTITION BY cluster, target ORDER BY source DESC) AS least FROM relations")
def running_minimum(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest score from the end of each list up to the row."""
    from_end = Window.partitionBy("cluster", "target").orderBy(F.desc("source")).rowsBetween(Window.unboundedPreceding, 0)
    return relations(spark, sf).select("cluster", "source", "target", F.min("score").over(from_end).alias("least"))


@query("top03_screened_sources", f"WITH {SCREEN} SELECT receiver_group, target, source, k AS rank FROM (SELECT grp AS receiver_group, target, source, row_number() OVER (PARTITION BY grp, target ORDER BY abs(c) / sqrt(v) DESC, source) AS k FROM k) WHERE k <= 8")
def screened_sources(spark: SparkSession, sf: str) -> DataFrame:
    s = effects.screen(joined(spark, sf), ["group"]).withColumnRenamed("group", "receiver_group")
    top = ranking.top(s, ["receiver_group", "target"], "screening_score", ["source"], 8)
    return top.select("receiver_group", "target", "source", F.col("rank").cast("long").alias("rank"))


@query("top04_mixed_order", f"WITH {RELATIONS} SELECT cluster, source, target, row_number() OVER (ORDER BY cluster, score DESC, target DESC, source) - 1 AS place FROM relations")
def mixed_order(spark: SparkSession, sf: str) -> DataFrame:
    """Rising and falling keys together; places come from ranges, not from one task."""
    out = readers.numbered(relations(spark, sf), [F.col("cluster"), F.desc("score"), F.desc("target"), F.col("source")], "place")
    return out.select("cluster", "source", "target", "place")


@query("top09_densest_crop", f"WITH RECURSIVE {CELLS}, {EDGES}, reach(a, b) AS (SELECT receiver, sender FROM edges WHERE distance <= 0.05e0 UNION SELECT reach.a, edges.sender FROM reach JOIN edges ON reach.b = edges.receiver AND edges.distance <= 0.05e0), label AS (SELECT a, least(a, min(b)) AS label FROM reach GROUP BY 1), big AS (SELECT label FROM label GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1), k AS (SELECT *, row_number() OVER (PARTITION BY receiver ORDER BY distance, sender) AS rank FROM edges JOIN label ON a = receiver JOIN big USING (label) WHERE distance <= 0.05e0), t AS (SELECT * FROM k WHERE rank <= 14), c AS (SELECT receiver FROM t GROUP BY 1 ORDER BY count(*) DESC, avg(distance), receiver LIMIT 1) SELECT receiver AS centre, sender AS node, rank FROM t JOIN c USING (receiver)")
def densest_crop(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    crop = graphs.densest_crop(c, 0.05, 14)
    return crop.withColumn("rank", F.col("rank").cast("long"))


@query("set05_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_partkey % 20 AS part FROM lineitem")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_partkey") % 20).alias("part")).distinct()


@query("fn07_fnv1a", "SELECT DISTINCT p_name AS name, CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, b: (xor(h, b) * CAST(1099511628211 AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT)) AS VARCHAR) AS hash FROM part")
def fnv1a(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_name").alias("name"), scalars.fnv1a("p_name").cast("string").alias("hash")).distinct()


@query("fn14_natural_order", "SELECT p_brand, row_number() OVER (ORDER BY CAST(substr(p_brand, 7) AS INTEGER)) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def natural_order(spark: SparkSession, sf: str) -> DataFrame:
    """Brands in the order of their numbers; they are few, so one window ranks them."""
    brands = table(spark, sf, "part").select("p_brand").distinct()
    return brands.select("p_brand", F.row_number().over(Window.orderBy(scalars.natural_key("p_brand"))).cast("long").alias("place"))


@query("fn16_json_columns", "SELECT p_partkey, p_name AS name, p_size AS size, p_size * 2 AS twice FROM part")
def json_columns(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_size").alias("size"), F.array("p_size", F.col("p_size") * 2).alias("sizes")).alias("more"))).alias("j"))
    back = p.select("p_partkey", F.from_json("j", "name string, more struct<size: int, sizes: array<int>>").alias("v"))
    return back.select("p_partkey", F.col("v.name").alias("name"), F.col("v.more.size").alias("size"), F.col("v.more.sizes")[1].alias("twice"))


@query("fn18_distance", f"WITH {CELLS} SELECT a.cell, b.cell AS other, round(sqrt({GAP3}), 6) + 0 AS distance FROM cells a JOIN cells b ON b.cell = a.cell + 1")
def distance(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    pairs = c.join(c.select((F.col("cell") - 1).alias("cell"), *(F.col(a).alias(f"o{a}") for a in "xyz")), "cell")
    gap = scalars.euclid([F.col(a) - F.col(f"o{a}") for a in "xyz"])
    return pairs.select("cell", (F.col("cell") + 1).alias("other"), r(gap).alias("distance"))


@query("fld05_exponential_field_3d", f"WITH {CELLS}, {EXPR} SELECT a.cell, gene, round(sum(value * exp(-sqrt({GAP3}) / 0.05e0)), 6) + 0 AS field FROM cells a JOIN cells b ON {GAP3} <= 0.15e0 * 0.15e0 JOIN expr ON expr.cell = b.cell WHERE value <> 0 GROUP BY 1, 2")
def exponential_field_3d(spark: SparkSession, sf: str) -> DataFrame:
    f = fields.exponential_field(cells(spark, sf), expression(spark, sf), None, 0.05, RADIUS, dims=3)
    return f.select("cell", "gene", r("field").alias("field"))


@query("fld08_kernel_parameters", "SELECT c_custkey, c_acctbal > 0 AND c_nationkey % 7 > 0 AND c_nationkey % 4 + 1 BETWEEN 2 AND 3 AS valid FROM customer")
def kernel_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """Which rows would make a kernel: diffusion, decay and dimensions from a table."""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", kernels.valid_parameters(F.col("c_acctbal"), (F.col("c_nationkey") % 7).cast("double"), F.col("c_nationkey") % 4 + 1).alias("valid"))


@query("la08_projected", "SELECT vec_id AS cell, CAST(c AS INTEGER) AS component, round(list_sum(list_transform(range(0, 4), lambda i: (CAST(embedding[28 + i] AS DOUBLE) - 0.01e0 * i) * (i + 1) / (c + 2))), 6) + 0 AS value FROM embeddings, range(0, 2) t(c)")
def projected(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell"), F.slice("embedding", 28, 4).cast("array<double>").alias("v"))
    p = matrix.projected(e, "v", np.arange(4) * 0.01, np.outer(np.arange(1, 5), 1 / np.arange(2, 4)))
    return p.select("cell", F.posexplode("projected").alias("component", "value")).withColumn("value", r("value"))


@query("ml07_hard_groups", "WITH v AS (SELECT vec_id, embedding[28:64] AS v FROM embeddings), d AS (SELECT vec_id, k, list_sum(list_transform(v, lambda x: (CAST(x AS DOUBLE) - c) * (CAST(x AS DOUBLE) - c))) AS d FROM v, (VALUES (0, 0e0), (1, 0.05e0), (2, -0.05e0)) t(k, c)), e AS (SELECT vec_id, k, exp(greatest((min(d) OVER (PARTITION BY vec_id) - d) / 0.1e0, -60)) AS e FROM d), p AS (SELECT vec_id, k, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k DESC) AS n FROM p) SELECT vec_id AS cell, k AS receiver_group, round(p, 6) + 0 AS maximum_probability FROM b WHERE n = 1")
def hard_groups(spark: SparkSession, sf: str) -> DataFrame:
    m = groups.soft_membership(embedding(spark, sf), "v", CENTRES, 0.1)
    return m.select("cell", F.col("receiver_group").cast("int").alias("receiver_group"), r("maximum_probability").alias("maximum_probability"))


@query("ml05_reduced_groups")
def reduced_groups(spark: SparkSession, sf: str) -> DataFrame:
    """A second clustering: restarts of k-means on the leading axes; its sizes."""
    g = groups.reduced_groups(embedding(spark, sf), "v", 37, 5, 4, restarts=3)
    return g.groupBy("group").agg(F.count("*").alias("n"))


@query("ml10_training_improvement", f"WITH RECURSIVE {HARD} SELECT DISTINCT CAST(pid // 100 AS INTEGER) AS receiver_group, target, round(imp, 5) + 0 AS training_improvement, round(intercept, 5) + 0 AS intercept FROM eff JOIN ic USING (pid)")
def training_improvement(spark: SparkSession, sf: str) -> DataFrame:
    return fitted(spark, sf).select("receiver_group", "target", r("training_improvement", 5).alias("training_improvement"), r("intercept", 5).alias("intercept")).distinct()


@query("ml13_effect_records", f"WITH RECURSIVE {HARD} SELECT CAST(pid // 100 AS INTEGER) AS receiver_group, s AS source, target, round(beta, 5) + 0 AS signed_beta, beta > 0 AS rises FROM eff WHERE beta <> 0")
def effect_records(spark: SparkSession, sf: str) -> DataFrame:
    e = fitted(spark, sf).where("signed_beta <> 0")
    return e.select("receiver_group", "source", "target", r("signed_beta", 5).alias("signed_beta"), (F.col("signed_beta") > 0).alias("rises"))


@query("ml15_manual_count", "SELECT CAST(count(DISTINCT label) AS INTEGER) AS selected, 0 AS candidates FROM embeddings")
def manual_count(spark: SparkSession, sf: str) -> DataFrame:
    """A manual number of groups, that of the labels, is taken and nothing is fitted."""
    def never() -> DataFrame:
        raise AssertionError("nothing must be fitted")

    labels = table(spark, sf, "embeddings").agg(F.countDistinct("label").alias("n")).first()["n"]
    count, candidates = groups.group_count(labels, never)
    return spark.createDataFrame([(count, 0 if candidates is None else candidates.count())], "selected int, candidates int")


@query("ml26_shortest_paths", f"WITH RECURSIVE {CELLS}, k AS {knn(1)}, e AS (SELECT receiver AS a, sender AS b FROM k UNION SELECT sender, receiver FROM k), p(source, node, steps) AS (SELECT cell, cell, 0 FROM cells UNION SELECT source, b, steps + 1 FROM p JOIN e ON node = a WHERE steps < 30) SELECT source, node, CAST(min(steps) AS INTEGER) AS steps FROM p GROUP BY 1, 2")
def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of the graph of nearest neighbours, whose components are small."""
    c = cells(spark, sf)
    e = spatial.knn_join(c, c, 1).select(F.col("receiver").alias("a"), F.col("sender").alias("b"))
    return graphs.shortest_paths(e, c.select(F.col("cell").alias("node")), 30)


@query("smp08_random_mask", f"WITH {CELLS} SELECT cell, count(*) FILTER (CAST('0x' || substr(md5('168/1/' || cell || '/' || g), 1, 7) AS BIGINT) / 268435456e0 < 0.15e0) AS masked FROM cells, range(0, 12) t(g) GROUP BY 1")
def random_mask(spark: SparkSession, sf: str) -> DataFrame:
    """How many genes are masked for each cell in one epoch."""
    mask = sampling.random_mask("cell", 12, 0.15, 168, 1)
    return cells(spark, sf).select("cell", F.size(F.filter(mask, lambda m: m)).cast("long").alias("masked"))


@query("gen02_partner_source", f"WITH {HARD.split(', member AS')[0].removeprefix('WITH ')} SELECT b.gene FROM zf a JOIN zf b USING (cell) WHERE a.gene = 3 AND b.gene <> 3 GROUP BY 1 ORDER BY round(abs(corr(a.z, b.z)), 12), b.gene LIMIT 1")
def partner_source(spark: SparkSession, sf: str) -> DataFrame:
    x, _ = standard(spark, sf)
    return spark.createDataFrame([(generators.least_correlated(x.select("cell", "gene", "field"), 3),)], "gene long")


@query("gen03_matched_markers", f"""WITH {CELLS}, {EXPR}, own AS (SELECT cell, grp, value FROM cells JOIN expr USING (cell) WHERE gene = grp + 1), m AS (SELECT grp, avg(value) AS mean FROM own GROUP BY 1), c AS (SELECT cell, grp, row_number() OVER (PARTITION BY grp ORDER BY cell) AS place FROM own), a AS (SELECT grp, value AS a, row_number() OVER (PARTITION BY grp ORDER BY md5('168/shared/0/' || cell), cell) AS place FROM own), b AS (SELECT grp, k, value AS b, row_number() OVER (PARTITION BY grp, k ORDER BY md5('168/own/' || k || '/' || cell), cell) AS place FROM own, range(0, 3) r(k)) SELECT cell, grp AS "group", CAST(k AS INTEGER) AS marker, round(greatest(mean + [0.95e0, 1.05e0, 1.1e0][k + 1] * (sqrt(0.9e0) * (a - mean) + sqrt(1 - 0.9e0) * (b - mean)), 0), 6) + 0 AS value FROM c JOIN a USING (grp, place) JOIN b USING (grp, place) JOIN m USING (grp)""")
def matched_markers(spark: SparkSession, sf: str) -> DataFrame:
    g = cells(spark, sf).select("cell", "group")
    m = generators.matched_markers(expression(spark, sf), g, {i: i + 1 for i in range(10)})
    return m.select("cell", "group", "marker", r("value").alias("value"))

