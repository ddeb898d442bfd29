"""Queries over neighbourhoods and fields."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import ReactionDiffusion
from ..operators import fields, spatial, stats
from ..operators.ordered import quantiles
from .registry import CELLS, EDGES, EXPR, GAP2, GAP3, LENGTH, MIN_DISTANCE, RADIUS, cells, expression, knn, query, r

KERNEL = ReactionDiffusion.of_length(LENGTH, min_distance=MIN_DISTANCE)
KERNEL3 = ReactionDiffusion.of_length(LENGTH, min_distance=MIN_DISTANCE, dims=3)
WEIGHED = f"{CELLS}, {EXPR}, {EDGES}, weighed AS (SELECT *, {KERNEL.sql('distance')} AS weight FROM edges)"
FIELD = f"{WEIGHED}, field AS (SELECT receiver AS cell, gene, sum(weight * value) AS field FROM weighed JOIN expr ON sender = expr.cell WHERE value <> 0 GROUP BY 1, 2)"


def kernel(distance: np.ndarray) -> np.ndarray:
    return fields.kernel_values(KERNEL, distance)


def field(spark: SparkSession, sf: str) -> DataFrame:
    return fields.sent_field(cells(spark, sf), expression(spark, sf), kernel, RADIUS)


@query("jn01_radius_join", f"WITH {CELLS}, {EDGES} SELECT receiver, sender, round(distance, 6) + 0 AS distance FROM edges")
def radius_join(spark: SparkSession, sf: str) -> DataFrame:
    return fields.near_pairs(cells(spark, sf), RADIUS).select("receiver", "sender", r("distance").alias("distance"))


@query("jn01_radius_join_3d", f"WITH {CELLS} SELECT a.cell AS receiver, b.cell AS sender, round(sqrt({GAP3}), 6) + 0 AS distance FROM cells a JOIN cells b ON a.cell <> b.cell AND {GAP3} <= 0.2e0 * 0.2e0")
def radius_join_3d(spark: SparkSession, sf: str) -> DataFrame:
    return fields.near_pairs(cells(spark, sf), 0.2, 3).select("receiver", "sender", r("distance").alias("distance"))


@query("jn02_nearest_within_radius", f"WITH {CELLS}, {EDGES} SELECT receiver, sender, rank FROM (SELECT *, row_number() OVER (PARTITION BY receiver ORDER BY distance, sender) AS rank FROM edges) WHERE rank <= 5")
def nearest_within_radius(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return spatial.knn_join(c, c, 5, radius=RADIUS).select("receiver", "sender", F.col("rank").cast("long").alias("rank"))


@query("jn03_knn_join", f"WITH {CELLS} SELECT receiver, sender, round(distance, 6) + 0 AS distance, rank FROM {knn(6)}")
def knn_join(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return spatial.knn_join(c, c, 6).select("receiver", "sender", r("distance").alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("jn04_radius_join_two_sets", f"WITH {CELLS}, {EXPR} SELECT a.cell AS receiver, b.cell AS sender, round(sqrt({GAP2}), 6) + 0 AS distance FROM (SELECT * FROM cells WHERE grp < 5) a JOIN (SELECT * FROM cells WHERE cell IN (SELECT cell FROM expr WHERE gene = 1 AND value > 0)) b ON a.cell <> b.cell AND {GAP2} <= 0.15e0 * 0.15e0")
def two_sets(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    senders = c.join(expression(spark, sf).where("gene = 1 and value > 0"), "cell", "left_semi")
    return fields.near_pairs(c.where("group < 5"), RADIUS, senders=senders).select("receiver", "sender", r("distance").alias("distance"))


@query("jn05_nearest_distance", f"WITH {CELLS} SELECT receiver, round(distance, 6) + 0 AS distance FROM {knn(1)}")
def nearest_distance(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return spatial.nearest_distance(c, c).select("receiver", r("distance").alias("distance"))


@query("jn06_neighbour_context", f"WITH {CELLS}, seeds AS (SELECT * FROM cells WHERE grp = 3) SELECT DISTINCT sender AS cell FROM {knn(12, 'seeds')} WHERE distance <= 0.1e0 UNION SELECT cell FROM seeds")
def neighbour_context(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return spatial.context(c.where("group = 3"), c, 12, 0.1)


@query("jn07_other_sample_neighbours", f"WITH {CELLS} SELECT receiver, count(*) FILTER (receiver % 4 <> sender % 4) AS n_other FROM {knn(12)} GROUP BY 1")
def other_sample(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.other_sample_neighbours(cells(spark, sf).withColumn("sample", F.col("cell") % 4), 12, "sample")


@query("jn08_exponential_field", f"WITH {CELLS}, {EXPR} SELECT a.cell, round(sum(value * exp(-sqrt({GAP2}) / 0.1e0)), 6) + 0 AS field FROM cells a JOIN cells b ON {GAP2} <= 0.5e0 * 0.5e0 JOIN expr ON b.cell = expr.cell AND gene = 3 AND value <> 0 GROUP BY 1")
def exponential_field(spark: SparkSession, sf: str) -> DataFrame:
    return fields.exponential_field(cells(spark, sf), expression(spark, sf), 3, 0.1, 0.5).select("cell", r("field").alias("field"))


@query("jn09_truth_edges", f"WITH {CELLS}, {EXPR}, planted(source, target, sg, rg) AS (VALUES (1, 2, 0, 1), (3, 4, 2, 3), (5, 6, 4, 4)) SELECT source, target, sg AS sender_group, rg AS receiver_group, b.cell AS sender, a.cell AS receiver, round(sqrt({GAP2}), 6) + 0 AS distance FROM planted JOIN cells b ON b.grp = sg JOIN expr eb ON eb.cell = b.cell AND eb.gene = source AND eb.value > 0 JOIN cells a ON a.grp = rg AND a.cell <> b.cell AND {GAP2} <= 0.15e0 * 0.15e0 JOIN expr ea ON ea.cell = a.cell AND ea.gene = target AND ea.value > 0")
def truth_edges(spark: SparkSession, sf: str) -> DataFrame:
    planted = spark.createDataFrame([(1, 2, 0, 1), (3, 4, 2, 3), (5, 6, 4, 4)], "source int, target int, sender_group int, receiver_group int")
    return spatial.truth_edges(cells(spark, sf), planted, expression(spark, sf), RADIUS).withColumn("distance", r("distance"))


@query("jn20_region_labels", f"WITH {CELLS}, votes AS (SELECT floor(x / 0.1e0) AS bx, floor(y / 0.1e0) AS b_y, grp, count(*) AS n FROM cells GROUP BY 1, 2, 3), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bx, b_y ORDER BY n DESC, grp) AS k FROM votes) WHERE k = 1 AND n >= 2) SELECT cell, best.grp AS region FROM cells LEFT JOIN best ON bx = floor(x / 0.1e0) AND b_y = floor(y / 0.1e0)")
def region_labels(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return spatial.bin_labels(c.select("cell", "x", "y"), c.withColumnRenamed("group", "label"), 0.1, 2).select("cell", "region")


@query("fld01_kernel_2d", f"WITH {WEIGHED} SELECT receiver, sender, round(weight, 6) + 0 AS weight FROM weighed")
def kernel_2d(spark: SparkSession, sf: str) -> DataFrame:
    return fields.weigh(fields.near_pairs(cells(spark, sf), RADIUS, twins=True), KERNEL).select("receiver", "sender", r("weight").alias("weight"))


@query("fld02_kernel_3d", f"WITH {CELLS}, edges AS (SELECT a.cell AS receiver, b.cell AS sender, sqrt({GAP3}) AS distance FROM cells a JOIN cells b ON a.cell <> b.cell AND {GAP3} <= 0.2e0 * 0.2e0) SELECT receiver, sender, round({KERNEL3.sql('distance')}, 6) + 0 AS weight FROM edges")
def kernel_3d(spark: SparkSession, sf: str) -> DataFrame:
    return fields.weigh(fields.near_pairs(cells(spark, sf), 0.2, 3, twins=True), KERNEL3).select("receiver", "sender", r("weight").alias("weight"))


@query("fld03_uniform_field", f"WITH {CELLS}, {EXPR}, {EDGES}, n AS (SELECT receiver, count(*) AS n FROM edges GROUP BY 1) SELECT receiver AS cell, gene, round(sum(value * (1.0e0 / n)), 6) + 0 AS field FROM edges JOIN n USING (receiver) JOIN expr ON sender = cell WHERE value <> 0 GROUP BY 1, 2")
def uniform_field(spark: SparkSession, sf: str) -> DataFrame:
    return fields.sent_field(cells(spark, sf), expression(spark, sf), None, RADIUS).withColumn("field", r("field"))


@query("fld04_gaussian_knn_field", f"WITH {CELLS}, {EXPR}, e AS (SELECT *, exp(-distance * distance / (2 * 0.1e0 * 0.1e0)) AS w FROM {knn(12)}), t AS (SELECT receiver, sum(w) AS t FROM e GROUP BY 1) SELECT receiver AS cell, gene, round(sum(w / t * value), 6) + 0 AS field FROM e JOIN t USING (receiver) JOIN expr ON sender = cell WHERE value <> 0 GROUP BY 1, 2")
def gaussian_knn_field(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return fields.source_field(fields.gaussian_knn(c, c, 12, 0.1), expression(spark, sf)).withColumn("field", r("field"))


@query("fld06_source_field", f"WITH {FIELD} SELECT cell, gene, round(field, 5) + 0 AS field FROM field")
def source_field(spark: SparkSession, sf: str) -> DataFrame:
    return field(spark, sf).withColumn("field", r("field", 5))


@query("fld07_tiled_field", f"WITH {FIELD} SELECT cell, gene, round(field, 5) + 0 AS field FROM field")
def tiled_field(spark: SparkSession, sf: str) -> DataFrame:
    wide = expression(spark, sf).groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("gene", "value"))), lambda s: s["value"]).alias("v"))
    out = fields.dense_field(cells(spark, sf).join(wide, "cell"), KERNEL, RADIUS)
    return out.select("cell", F.posexplode("field").alias("g", "field")).where("field <> 0").select("cell", (F.col("g") + 1).cast("long").alias("gene"), r("field", 5).alias("field"))


@query("flt01_receiver_mask", f"WITH {FIELD} SELECT f.cell, f.gene, round(CASE WHEN e.value > 0.05e0 THEN 0 ELSE field END, 5) + 0 AS field, e.value > 0.05e0 AS masked FROM field f JOIN expr e USING (cell, gene)")
def receiver_mask(spark: SparkSession, sf: str) -> DataFrame:
    return fields.masked(field(spark, sf), expression(spark, sf), 0.05).select("cell", "gene", r("field", 5).alias("field"), "masked")


@query("flt01_mask_summary", f"WITH {FIELD}, m AS (SELECT e.value > 0.05e0 AS masked FROM field f JOIN expr e USING (cell, gene)) SELECT count(*) AS total, count(*) FILTER (masked) AS n_masked, round(count(*) FILTER (masked) / count(*), 6) + 0 AS fraction FROM m")
def mask_summary(spark: SparkSession, sf: str) -> DataFrame:
    return fields.mask_summary(fields.masked(field(spark, sf), expression(spark, sf), 0.05)).withColumn("fraction", r("fraction"))


@query("flt02_source_mask", f"WITH {CELLS}, {EXPR}, {EDGES} SELECT receiver AS cell, gene, round(sum(value * {KERNEL.sql('distance')}), 5) + 0 AS field FROM edges JOIN expr ON sender = cell WHERE value <> 0 AND sender IN (SELECT cell FROM expr WHERE gene = 1 AND value > 0) GROUP BY 1, 2")
def source_mask(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    flagged = c.join(expression(spark, sf).where("gene = 1 and value > 0"), "cell", "left_semi")
    return fields.sent_field(c, expression(spark, sf), kernel, RADIUS, senders=flagged).withColumn("field", r("field", 5))


BOX = "box AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM cells), grid AS (SELECT CAST(i * 21 + j AS BIGINT) AS cell, lx + (hx - lx) * i / 20 AS x, ly + (hy - ly) * j / 20 AS y FROM box, (SELECT unnest(range(0, 21)) AS i), (SELECT unnest(range(0, 21)) AS j))"


@query("fld09_grid_field", f"WITH {CELLS}, {EXPR}, {BOX} SELECT a.cell, gene, round(sum(value * {KERNEL.sql(f'sqrt({GAP2})')}), 5) + 0 AS field FROM grid a JOIN cells b ON {GAP2} <= 0.15e0 * 0.15e0 JOIN expr ON expr.cell = b.cell AND value <> 0 GROUP BY 1, 2")
def grid_field(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    e = spatial.radius_join(fields.grid_points(c, 20), c, RADIUS, self_pairs=True)
    return fields.source_field(fields.weigh(e, KERNEL), expression(spark, sf)).withColumn("field", r("field", 5))


PULL = f"pull AS (SELECT a.cell, gene, sum(value / (({GAP2} + 0.0004e0) * sqrt({GAP2} + 0.0004e0)) * (b.x - a.x)) AS fx, sum(value / (({GAP2} + 0.0004e0) * sqrt({GAP2} + 0.0004e0)) * (b.y - a.y)) AS fy, sum(abs(value) / ({GAP2} + 0.0004e0)) AS density FROM grid a JOIN cells b ON {GAP2} <= 0.15e0 * 0.15e0 JOIN expr ON expr.cell = b.cell AND gene <= 2 GROUP BY 1, 2)"


def pull(spark: SparkSession, sf: str, gene: int) -> DataFrame:
    c = cells(spark, sf)
    charged = c.join(expression(spark, sf).where(F.col("gene") == gene).select("cell", F.col("value").alias("charge")), "cell")
    return fields.vector_field(fields.grid_points(c, 20), charged, RADIUS, 0.02)


@query("fld10_vector_field", f"WITH {CELLS}, {EXPR}, {BOX}, {PULL} SELECT cell, round(fx, 3) + 0 AS fx, round(fy, 3) + 0 AS fy, round(density, 3) + 0 AS density FROM pull WHERE gene = 1")
def vector_field(spark: SparkSession, sf: str) -> DataFrame:
    return pull(spark, sf, 1).select("cell", r("fx", 3).alias("fx"), r("fy", 3).alias("fy"), r("density", 3).alias("density"))


@query("fld11_field_agreement", f"WITH {CELLS}, {EXPR}, {BOX}, {PULL}, both_ AS (SELECT sqrt(a.fx * a.fx + a.fy * a.fy) * sqrt(b.fx * b.fx + b.fy * b.fy) AS w, a.fx * b.fx + a.fy * b.fy AS dot FROM pull a JOIN pull b ON a.cell = b.cell AND a.gene = 1 AND b.gene = 2) SELECT round(sum(dot) / sum(w), 5) + 0 AS agreement, count(*) AS n FROM both_ WHERE w > 0 AND w >= (SELECT quantile_cont(w, 0.35) FROM both_)")
def field_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return fields.field_agreement(pull(spark, sf, 1), pull(spark, sf, 2)).withColumn("agreement", r("agreement", 5))


VECTORS = f"{WEIGHED}, vectors AS (SELECT receiver, a.grp, a.x, a.y, weight, a.x - b.x AS dx, a.y - b.y AS dy, sqrt({GAP2}) AS d FROM weighed JOIN cells a ON a.cell = receiver JOIN cells b ON b.cell = sender)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return fields.direction_sums(c, KERNEL, RADIUS).join(c.select("cell", "x", "y", "group"), "cell")


@query("fld12_mean_direction", f"WITH {VECTORS}, m AS (SELECT grp, sum(weight * dx / d) / sum(weight) AS mx, sum(weight * dy / d) / sum(weight) AS my, count(*) AS n FROM vectors WHERE d > 0 GROUP BY 1) SELECT grp AS \"group\", round(mx, 5) + 0 AS mx, round(my, 5) + 0 AS my, n, round(sqrt(mx * mx + my * my), 5) + 0 AS enrichment FROM m")
def mean_direction(spark: SparkSession, sf: str) -> DataFrame:
    return fields.mean_direction(vectors(spark, sf), ["group"]).select("group", r("mx", 5).alias("mx"), r("my", 5).alias("my"), "n", r("enrichment", 5).alias("enrichment"))


@query("fld13_binned_vectors", f"WITH {VECTORS}, m AS (SELECT CAST(floor(x / 0.1e0) AS BIGINT) AS bx, CAST(floor(y / 0.1e0) AS BIGINT) AS \"by\", sum(weight * dx / d) / sum(weight) AS mx, sum(weight * dy / d) / sum(weight) AS my, sum(weight) AS weight, count(DISTINCT receiver) AS receivers FROM vectors WHERE d > 0 GROUP BY 1, 2) SELECT bx, \"by\", round(mx, 5) + 0 AS mx, round(my, 5) + 0 AS my, receivers FROM m ORDER BY round(-weight * sqrt(mx * mx + my * my), 9), bx, \"by\" LIMIT 20")
def binned_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return fields.binned_vectors(vectors(spark, sf), 0.1, 20).select("bx", "by", r("mx", 5).alias("mx"), r("my", 5).alias("my"), "receivers")


@query("fld14_hotspot", f"WITH {CELLS}, {EXPR} SELECT a.cell, round(sum(value), 6) + 0 AS activity FROM cells a JOIN cells b ON {GAP2} <= 0.15e0 * 0.15e0 JOIN expr ON expr.cell = b.cell AND gene = 2 AND value > 0 GROUP BY 1 ORDER BY round(-sum(value), 9), 1 LIMIT 1")
def hotspot(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).join(expression(spark, sf).where("gene = 2"), "cell")
    return fields.hotspot(c, F.col("value"), RADIUS).select("cell", r("activity").alias("activity"))


@query("fld15_density", f"WITH {CELLS} SELECT CAST(floor(x / 0.05e0) AS BIGINT) AS bx, CAST(floor(y / 0.05e0) AS BIGINT) AS \"by\", CAST(count(*) AS DOUBLE) AS density FROM cells GROUP BY 1, 2")
def density(spark: SparkSession, sf: str) -> DataFrame:
    return fields.density(cells(spark, sf), 0.05)


def gauss(sigma: float, reach: int) -> str:
    """SQL rows (o, w): the weights of a Gaussian over bins."""
    return f"(SELECT o, exp(-0.5e0 * o * o / ({sigma!r} * {sigma!r})) / sum(exp(-0.5e0 * o * o / ({sigma!r} * {sigma!r}))) OVER () AS w FROM (SELECT unnest(range(-{reach}, {reach + 1})) AS o))"


#: Both axes at once; components by closure over faces.
ENVELOPE = f"""WITH RECURSIVE {CELLS}, h AS (SELECT CAST(floor(x / 0.05e0) AS BIGINT) AS bx, CAST(floor(y / 0.05e0) AS BIGINT) AS b_y, count(*) AS n FROM cells GROUP BY 1, 2),
s AS (SELECT bx + p.o AS bx, b_y + q.o AS b_y, sum(n * p.w * q.w) AS density FROM h, {gauss(1.0, 3)} p, {gauss(1.0, 3)} q GROUP BY 1, 2),
c AS (SELECT (SELECT quantile_cont(density, 0.12) FROM cells JOIN s ON bx = CAST(floor(x / 0.05e0) AS BIGINT) AND b_y = CAST(floor(y / 0.05e0) AS BIGINT)) AS low, (SELECT max(density) FROM s) AS top),
k AS (SELECT bx, b_y, density, row_number() OVER (ORDER BY bx, b_y) AS i FROM s, c WHERE density >= low AND density >= top * 0.055e0),
e AS (SELECT a.i AS a, b.i AS b FROM k a JOIN k b ON abs(a.bx - b.bx) + abs(a.b_y - b.b_y) <= 1),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
l AS (SELECT a, min(b) AS l FROM reach GROUP BY 1), z AS (SELECT l, count(*) AS bins FROM l GROUP BY 1)
SELECT bx, b_y AS "by", round(density, 6) + 0 AS density, bins FROM k JOIN l ON a = i JOIN z USING (l) WHERE bins >= 6"""


@query("fld15_envelope", ENVELOPE)
def envelope(spark: SparkSession, sf: str) -> DataFrame:
    return fields.envelope(cells(spark, sf), 0.05, 1.0, 6).select("bx", "by", r("density").alias("density"), "bins")


@query("fld16_complex_expression", f"WITH {EXPR}, parts(complex, gene) AS (VALUES ('a', 1), ('a', 2), ('b', 3), ('c', 4), ('c', 5), ('c', 6)), need AS (SELECT complex, count(*) AS need FROM parts GROUP BY 1) SELECT cell, complex, round(exp(sum(ln(1 + value)) / count(*)) - 1, 6) + 0 AS value FROM expr JOIN parts USING (gene) JOIN need USING (complex) WHERE value > 0 GROUP BY cell, complex, need HAVING count(*) = need")
def complex_expression(spark: SparkSession, sf: str) -> DataFrame:
    parts = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), ("c", 5), ("c", 6)], "complex string, gene long")
    return fields.complex_expression(expression(spark, sf), parts).withColumn("value", r("value"))


@query("fld17_voxel_ratio", f"WITH {CELLS}, {EXPR} SELECT CAST(floor(x / 0.1e0) AS BIGINT) AS bx, CAST(floor(y / 0.1e0) AS BIGINT) AS \"by\", CAST(floor(z / 0.1e0) AS BIGINT) AS bz, round(sum(value) / count(*), 6) + 0 AS ratio FROM cells JOIN expr USING (cell) WHERE gene = 1 GROUP BY 1, 2, 3")
def voxel_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return fields.voxel_ratio(cells(spark, sf).join(expression(spark, sf).where("gene = 1"), "cell"), 0.1, "value").withColumn("ratio", r("ratio"))


@query("fld18_windows", f"WITH {CELLS}, c AS (SELECT grp AS target, avg(x) AS x, avg(y) AS y FROM cells GROUP BY 1) SELECT target, round(x - 0.1e0, 6) + 0 AS lox, round(x + 0.1e0, 6) + 0 AS hix, round(y - 0.1e0, 6) + 0 AS loy, round(y + 0.1e0, 6) + 0 AS hiy FROM c")
def windows(spark: SparkSession, sf: str) -> DataFrame:
    centres = cells(spark, sf).groupBy(F.col("group").alias("target")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return fields.windows_around(centres, 0.1).select("target", *(r(c).alias(c) for c in ("lox", "hix", "loy", "hiy")))


@query("agg11_moran", f"WITH {CELLS}, {EXPR}, e AS {knn(6)}, m AS (SELECT gene, avg(value) AS m, sum(value * value) - count(*) * avg(value) * avg(value) AS v, count(*) AS n FROM expr GROUP BY 1), t AS (SELECT a.gene, sum((a.value - m) * (b.value - m)) AS s, count(*) AS w FROM e JOIN expr a ON a.cell = receiver JOIN expr b ON b.cell = sender AND a.gene = b.gene JOIN m ON m.gene = a.gene GROUP BY 1) SELECT gene, round(n / w * s / v, 6) + 0 AS moran FROM t JOIN m USING (gene)")
def moran(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return stats.moran(c, spatial.knn_join(c, c, 6), expression(spark, sf), c.count()).withColumn("moran", r("moran"))


@query("agg12_spatial_autocorrelation", f"WITH {CELLS}, {EXPR}, n AS (SELECT receiver AS cell, gene, avg(value) AS near FROM {knn(6)} JOIN expr ON sender = cell GROUP BY 1, 2) SELECT gene, round(corr(value, near), 6) + 0 AS autocorrelation FROM expr JOIN n USING (cell, gene) GROUP BY 1")
def autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    c, e = cells(spark, sf), expression(spark, sf)
    near = spatial.knn_join(c, c, 6).join(e.withColumnRenamed("cell", "sender"), "sender").groupBy(F.col("receiver").alias("cell"), "gene").agg(F.avg("value").alias("near"))
    return e.join(near, ["cell", "gene"]).groupBy("gene").agg(r(F.corr("value", "near")).alias("autocorrelation"))


@query("agg39_neighbour_entropy", f"WITH {CELLS}, n AS (SELECT receiver, grp, count(*) AS n FROM {knn(20)} JOIN cells ON sender = cell GROUP BY 1, 2), p AS (SELECT receiver, n / sum(n) OVER (PARTITION BY receiver) AS p FROM n) SELECT receiver, round(-sum(p * ln(p + 1e-12)), 6) + 0 AS entropy FROM p GROUP BY 1")
def neighbour_entropy(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return stats.neighbour_entropy(spatial.knn_join(c, c, 20), c.select("cell", F.col("group").alias("label"))).withColumn("entropy", r("entropy"))


@query("agg45_dataset_summary", f"WITH {CELLS} SELECT (SELECT count(*) FROM cells) AS n, (SELECT count(DISTINCT grp) FROM cells) AS groups, (SELECT round(min(x), 6) + 0 FROM cells) AS min_x, (SELECT round(max(y), 6) + 0 FROM cells) AS max_y, (SELECT round(median(distance), 6) + 0 FROM {knn(1)}) AS median_gap")
def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    one = c.agg(F.count("*").alias("n"), F.countDistinct("group").alias("groups"), r(F.min("x")).alias("min_x"), r(F.max("y")).alias("max_y"))
    return one.crossJoin(F.broadcast(quantiles(spatial.nearest_distance(c, c), "distance", [0.5]).select(r(F.col("q")[0]).alias("median_gap"))))


