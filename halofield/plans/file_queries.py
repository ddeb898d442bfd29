"""Queries over readers and writers: a given table is written in a format and read again, or a fixed file is read."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges as edge_ops
from ..operators import effects
from ..sources import config, readers, writers
from ..sources.store import new_path
from .analysis import wide
from .model_queries import ATTRIBUTED, triplet_edges
from .registry import CELLS, EXPR, cells, expression, query, r, table


def text_file(df: DataFrame, key: Column | str, line: Column, name: str, head: str | None = None, falling: list[str] | None = None) -> str:
    """The path of a text file with a line for each row, in the order of key, under a first line; of equal keys in falling order of further columns."""
    falling = falling or []
    rows = df.select(F.col(key).cast("long").alias("k") if isinstance(key, str) else key.cast("long").alias("k"), line.alias("value"), *falling)
    if head is not None:
        rows = rows.unionByName(df.sparkSession.createDataFrame([(-1, head)], "k long, value string"), allowMissingColumns=True)
    path = new_path(df.sparkSession, name)
    writers.write_ids(rows, path, ["k", *(F.desc(c) for c in falling)], "value")
    return path


@query("src01_ids", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS cell, p_name AS cell_id FROM part WHERE p_size >= 3")
def ids(spark: SparkSession, sf: str) -> DataFrame:
    """Names with blanks around them and text behind a comma or tab; every line of a small part is blank."""
    name = F.concat(F.lit("  "), "p_name", F.when(F.col("p_size") % 2 == 0, F.lit(" ,x")).otherwise(F.lit("\tx,y")))
    return readers.read_ids(spark, text_file(table(spark, sf, "part"), "p_partkey", F.when(F.col("p_size") < 3, F.lit(" ")).otherwise(name), "ids"))


@query("src02_dense", "SELECT vec_id AS cell, k - 1 AS gene, round(CAST(embedding[k] AS DOUBLE), 6) + 0 AS value FROM embeddings, (SELECT unnest(range(1, 7)) AS k)")
def dense(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers between commas, tabs and blanks; the sizes are checked."""
    e = table(spark, sf, "embeddings")
    part = lambda i: F.element_at("embedding", i).cast("string")
    line = F.concat(part(1), F.lit(","), part(2), F.lit("\t"), part(3), F.lit(" "), part(4), F.lit(", "), part(5), F.lit("\t\t"), part(6))
    back = readers.read_dense(spark, text_file(e, "vec_id", line, "dense"), e.count(), 6)
    return back.select("cell", F.posexplode("v").alias("gene", "value")).select("cell", F.col("gene").cast("long").alias("gene"), r(F.col("value").cast("double")).alias("value"))


def market(spark: SparkSession, sf: str, transposed: bool = False) -> tuple[str, int]:
    """The path of the positive expression as a MatrixMarket file, and the number of cells."""
    e, path = expression(spark, sf).where("value > 0").withColumn("gene", F.col("gene") - 1), new_path(spark, "market")
    n = table(spark, sf, "embeddings").count()
    if transposed:
        writers.write_matrix_market(e.select(F.col("gene").alias("cell"), F.col("cell").alias("gene"), "value"), path, 12, n)
    else:
        writers.write_matrix_market(e, path, n, 12)
    return path, n


@query("src03_matrix_market", f"WITH {EXPR} SELECT o AS orientation, cell, gene - 1 AS gene, round(value, 6) + 0 AS value FROM expr, (VALUES ('cells'), ('genes')) t(o) WHERE value > 0")
def matrix_market(spark: SparkSession, sf: str) -> DataFrame:
    """Both orientations, recognized by their sizes."""
    frames = []
    for kind in ("cells", "genes"):
        path, n = market(spark, sf, kind == "genes")
        frames.append(({"orientation": kind}, readers.read_matrix_market(spark, path, n, 12).select("cell", "gene", r(F.col("value").cast("double")).alias("value"))))
    return readers.tagged(frames).select("orientation", "cell", "gene", "value")


@query("src04_sniffed_format", f"WITH {EXPR} SELECT f AS format, f = 'market' AS recognized, gene - 1 AS gene, round(sum(value), 4) + 0 AS total, count(*) FILTER (value > 0) AS positive FROM expr, (VALUES ('dense'), ('market')) t(f) GROUP BY 1, 2, 3")
def sniffed(spark: SparkSession, sf: str) -> DataFrame:
    plain = new_path(spark, "plain")
    writers.write_matrix(wide(expression(spark, sf), "value", "v"), plain)
    path, n = market(spark, sf)
    frames = [({"format": k, "recognized": readers.is_matrix_market(spark, p)}, readers.read_expression(spark, p, n, 12)) for k, p in (("dense", plain), ("market", path))]
    return readers.tagged(frames).groupBy("format", "recognized", "gene").agg(r(F.sum(F.col("value").cast("double")), 4).alias("total"), F.count_if(F.col("value") > 0).alias("positive"))


@query("src05_positive_genes", f"WITH {EXPR} SELECT cell, array_to_string(list_sort(list(gene - 1)), ';') AS genes FROM expr WHERE CAST(value AS FLOAT) > CAST(0.05 AS FLOAT) AND gene IN (2, 3, 6, 10) GROUP BY 1")
def positive_genes(spark: SparkSession, sf: str) -> DataFrame:
    path, _ = market(spark, sf, transposed=True)
    return readers.read_positive_genes(spark, path, [1, 2, 5, 9], 0.05, "genes").select("cell", F.array_join("genes", ";").alias("genes"))


@query("src06_coordinates", f"WITH {CELLS} SELECT cell, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y FROM cells")
def coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """The first two of three columns."""
    c = cells(spark, sf)
    path = text_file(c, "cell", F.concat_ws(",", *(F.col(a).cast("string") for a in "xyz")), "coordinates")
    return readers.read_coordinates(spark, path, c.count()).select("cell", r("x").alias("x"), r("y").alias("y"))


@query("src07_edges", "SELECT l_linenumber AS cluster, l_returnflag AS source, l_linestatus AS target, s_suppkey AS sender, l_partkey % 5 AS receiver, l_quantity AS distance FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def edges(spark: SparkSession, sf: str) -> DataFrame:
    """A headed edge table whose cell ids are names of suppliers."""
    named, path = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell"), F.concat(F.lit("cell "), "s_suppkey").alias("cell_id")), new_path(spark, "edges")
    e = table(spark, sf, "lineitem").join(named, F.col("cell") == F.col("l_suppkey"))
    e = e.select(F.col("l_linenumber").alias("cluster"), F.col("l_returnflag").alias("source_gene"), F.col("l_linestatus").alias("target_gene"), F.col("cell_id").alias("source_cell_id"), F.concat(F.lit("cell "), F.col("l_partkey") % 5).alias("receiver_cell_id"), F.col("l_quantity").alias("distance"), F.lit("left out").alias("note"))
    writers.write_table(e, path, form="csv")
    return readers.read_edges(spark, path, named).withColumn("cluster", F.col("cluster").cast("int"))


@query("src09_selected_betas", "SELECT l_linenumber AS receiver_group, l_returnflag AS source, l_linestatus AS target, max_by(l_quantity, l_orderkey * 10 + l_linenumber) AS signed_beta FROM lineitem WHERE l_partkey % 3 < 2 GROUP BY 1, 2, 3")
def selected_betas(spark: SparkSession, sf: str) -> DataFrame:
    """Of repeated keys the last selected line wins; of rows with one order number that is the table's first, as max_by keeps it."""
    items = table(spark, sf, "lineitem").select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    chosen = F.element_at(F.array(F.lit("true"), F.lit("1"), F.lit("no")), (F.col("l_partkey") % 3 + 1).cast("int"))
    line = F.concat_ws(",", "l_returnflag", "l_linenumber", chosen, "l_linestatus", "l_quantity")
    path = text_file(items, F.col("l_orderkey") * 10 + F.col("l_linenumber"), line, "betas", "source_gene,receiver_group,selected,target_gene,signed_beta", ["_file", "_row"])
    return readers.read_selected_betas(spark, path)


@query("src10_truth", "SELECT n_name AS target_gene, CAST(n_regionkey AS INTEGER) AS receiver_group, 'g' || n_nationkey AS source_gene, CAST(n_nationkey % 3 AS INTEGER) AS sender_group FROM nation")
def truth(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "truth")
    n = table(spark, sf, "nation")
    writers.write_table(n.select(F.lit("x").alias("extra"), (F.col("n_nationkey") % 3).alias("sender_group"), F.col("n_name").alias("target_gene"), F.concat(F.lit("g"), "n_nationkey").alias("source_gene"), F.col("n_regionkey").alias("receiver_group")), path, form="csv")
    return readers.read_headed(spark, path, "target_gene string, receiver_group int, source_gene string, sender_group int")


@query("src11_group_labels", "SELECT vec_id AS cell, label FROM embeddings")
def group_labels(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return readers.read_labels(spark, text_file(e, "vec_id", F.concat(F.lit(" "), F.col("label").cast("string")), "labels"), e.count(), "int")


@query("src12_annotations", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS cell, c_mktsegment AS label FROM customer")
def annotations(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return readers.read_labels(spark, text_file(c, "c_custkey", F.concat("c_mktsegment", F.lit(" ")), "annotations"), c.count())


SETTINGS = '{"l1": 0.01, "top": 4, "steps": ${STEPS}}'


@query("src13_settings", "SELECT * FROM (VALUES ('l1', 0.01e0), ('l2', 0.05e0), ('minimum_training_improvement', 0e0), ('sources_per_target', 4e0), ('steps', CAST((SELECT count(*) FROM nation) AS DOUBLE)), ('tolerance', 1e-6)) t(name, value)")
def settings(spark: SparkSession, sf: str) -> DataFrame:
    """Strict settings: an old name, a value filled in from a table, and defaults for the rest."""
    c = config.parse(effects.SparseEffects, SETTINGS, {"top": "sources_per_target"}, {"STEPS": str(table(spark, sf, "nation").count())})
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(vars(c).items())], "name string, value double")


@query("src14_filled_settings", "SELECT r_name, '{\"l1\": 0.01, \"top\": 4, \"steps\": ' || count(n_nationkey) || '}' AS text FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def filled_settings(spark: SparkSession, sf: str) -> DataFrame:
    """One template, filled in for each region with its number of nations."""
    n = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("n"))
    return spark.createDataFrame([(x["r_name"], config.fill(SETTINGS, {"STEPS": str(x["n"])})) for x in n.collect()], "r_name string, text string")


@query("src16_arrays", "WITH m AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS cell, unnest([0, 1, 2]) AS gene, unnest([n_nationkey / 2e0, n_regionkey / 2e0, length(n_name) / 2e0]) AS value FROM nation) SELECT 'dense' AS kind, cell, CAST(gene AS BIGINT) AS gene, value FROM m UNION ALL SELECT 'sparse', cell, gene, value FROM m WHERE value <> 0")
def arrays(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers of the nations, which are few, in a NumPy file and in one of a compressed sparse row matrix."""
    numbers = table(spark, sf, "nation").orderBy("n_nationkey").select("n_nationkey", "n_regionkey", F.length("n_name")).collect()
    m, at = np.array(numbers, float) / 2, new_path(spark, "arrays")
    dense_file, sparse_file = io.BytesIO(), io.BytesIO()
    np.save(dense_file, m)
    there = m != 0
    np.savez(sparse_file, data=m[there], indices=np.nonzero(there)[1], indptr=np.concatenate([[0], np.cumsum(there.sum(1))]), shape=np.array(m.shape))
    writers.write_bytes(f"{at}/m.npy", dense_file.getvalue())
    writers.write_bytes(f"{at}/m.npz", sparse_file.getvalue())
    one = readers.read_npy(spark, f"{at}/m.npy").select("cell", F.posexplode("v").alias("gene", "value")).withColumn("gene", F.col("gene").cast("long"))
    return readers.tagged([({"kind": "dense"}, one), ({"kind": "sparse"}, readers.read_npz_sparse(spark, f"{at}/m.npz"))]).select("kind", "cell", "gene", "value")


@query("src17_zip_member", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS line, n_name AS value FROM nation")
def zip_member(spark: SparkSession, sf: str) -> DataFrame:
    """The names of the nations, which are few, in a member of an archive."""
    names = [x["n_name"] for x in table(spark, sf, "nation").orderBy("n_nationkey").select("n_name").collect()]
    held, path = io.BytesIO(), f"{new_path(spark, 'zip')}/a.zip"
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("other.txt", "x")
        z.writestr("names.txt", "\n".join(names) + "\n")
    writers.write_bytes(path, held.getvalue())
    return readers.from_zip(spark, path, "names.txt")


@query("src20_ligand_receptors", "WITH g AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS gene FROM part WHERE p_size < 30 UNION SELECT DISTINCT p_type FROM part), t AS (SELECT DISTINCT p_type AS ligand, string_split(p_name, ' ') AS receptor FROM part), m AS (SELECT lower(gene) AS folded, min(gene) AS gene FROM g GROUP BY 1) SELECT l.gene AS ligand, a.gene || ';' || b.gene AS receptor FROM t JOIN m l ON l.folded = lower(ligand) JOIN m a ON a.folded = lower(receptor[1]) JOIN m b ON b.folded = lower(receptor[2])")
def ligand_receptors(spark: SparkSession, sf: str) -> DataFrame:
    """Tab-separated pairs in other cases than the measured names."""
    p, path = table(spark, sf, "part"), new_path(spark, "pairs")
    measured = p.where("p_size < 30").select(F.explode(F.split("p_name", " ")).alias("gene")).union(p.select("p_type")).distinct()
    pairs = p.select(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("receptor"), F.lower("p_type").alias("ligand"), F.lit(1).alias("evidence"))
    pairs.write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_ligand_receptors(spark, path, measured).select("ligand", F.array_join("receptor", ";").alias("receptor"))


@query("snk02_ids", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line, p_name AS value FROM part")
def written_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "ids")
    writers.write_ids(table(spark, sf, "part"), path, "p_partkey", "p_name")
    return readers.lines(spark, path)


@query("snk03_written_once", f"WITH {EXPR} SELECT cell, gene - 1 AS gene, round(value, 4) + 0 AS value FROM expr")
def written_once(spark: SparkSession, sf: str) -> DataFrame:
    """A second matrix under the same name is not written."""
    v, path = wide(expression(spark, sf), "value", "v"), new_path(spark, "once")
    writers.write_matrix(v, path, once=True)
    writers.write_matrix(v.withColumn("v", F.transform("v", lambda x: x + 1.0)), path, once=True)
    return readers.read_dense(spark, path).select("cell", F.posexplode("v").alias("gene", "value")).select("cell", F.col("gene").cast("long").alias("gene"), r(F.col("value").cast("double"), 4).alias("value"))


@query("snk04_composition_table", "SELECT c_nationkey AS nation, c_mktsegment AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey), 4) + 0 AS fraction FROM customer GROUP BY 1, 2")
def composition_table(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import stats

    path = new_path(spark, "composition")
    c = stats.composition(table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("label")), "nation", "label")
    writers.write_table(c, path, {"fraction": 4}, "csv")
    return readers.read_headed(spark, path, "nation long, label string, count long, fraction double").withColumnRenamed("count", "n")


@query("snk05_edge_tables", f"WITH {ATTRIBUTED}, k AS (SELECT *, row_number() OVER (PARTITION BY receiver_group, source, target ORDER BY influence DESC, receiver, sender) AS rank, count(*) OVER (PARTITION BY receiver_group, source, target) AS n FROM s) SELECT receiver_group, CAST(source AS BIGINT) AS source, CAST(target AS BIGINT) AS target, max(n) AS supported_edges, count(*) AS retained_edges, round(sum(influence), 4) + 0 AS influence FROM k WHERE rank <= least(ceil(n * 0.5e0), 300) AND receiver_group < 2 GROUP BY 1, 2, 3")
def edge_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two of the groups, of which only their partitions are read, beside the summary."""
    kept, _ = triplet_edges(spark, sf)
    path = new_path(spark, "cell-edges")
    writers.write_edges(kept, edge_ops.summary(kept), path)
    key = ["receiver_group", "source", "target"]
    e = spark.read.parquet(f"{path}/edges").where("receiver_group < 2").groupBy(*key).agg(r(F.sum("influence_score"), 4).alias("influence"))
    return spark.read.parquet(f"{path}/summary").select(*key, "supported_edges", "retained_edges").join(e, key)


@query("snk06_quoted_csv", "SELECT c_custkey AS id, c_name || ', \"' || c_mktsegment || '\"' || chr(10) || 'x' AS text FROM customer")
def quoted_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Commas, quotes and line ends inside fields."""
    path = new_path(spark, "quoted")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"\nx')).alias("text"))
    writers.write_table(c, path, form="csv")
    return readers.read_headed(spark, path, "id long, text string")


@query("snk07_metadata", "SELECT 'cells' AS name, CAST(count(*) AS VARCHAR) AS value FROM embeddings UNION ALL SELECT * FROM (VALUES ('genes', '[\"a\", \"b\"]'), ('radius', '0.15'), ('seed', '168'))")
def metadata(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "metadata")
    writers.write_metadata(spark, path, {"seed": 168, "radius": 0.15, "genes": ["a", "b"], "cells": table(spark, sf, "embeddings").count()})
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in writers.read_metadata(spark, path).items()], "name string, value string")


@query("snk08_checkpoint", "SELECT 'customer' AS name, count(*) AS n, round(sum(c_acctbal), 2) + 0 AS total, 3 AS epoch FROM customer UNION ALL SELECT 'supplier', count(*), round(sum(s_acctbal), 2) + 0, 3 FROM supplier")
def checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "model")
    writers.save_checkpoint(spark, path, {t: table(spark, sf, t) for t in ("customer", "supplier")}, {"epoch": 3})
    tables, meta = writers.load_checkpoint(spark, path)
    frames = [({"name": n}, t.agg(F.count("*").alias("n"), r(F.sum(f"{n[0]}_acctbal"), 2).alias("total"))) for n, t in tables.items()]
    return readers.tagged(frames).select("name", "n", "total", F.lit(meta["epoch"]).alias("epoch"))


@query("snk09_equal_ids", "SELECT * FROM (VALUES ('reordered', true), ('renamed', false), ('short', false)) t(kind, same)")
def equal_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A checkpoint's ids against the same in another order, against others, and against fewer."""
    ids = table(spark, sf, "part").select("p_partkey", "p_name")
    others = {"reordered": ids.repartition(3), "renamed": ids.withColumn("p_name", F.upper("p_name")), "short": ids.where("p_partkey > 0")}
    return spark.createDataFrame([(k, writers.same_ids(ids, o)) for k, o in others.items()], "kind string, same boolean")


@query("snk10_matrix_market_lines", f"WITH {EXPR}, n AS (SELECT count(*) AS n FROM expr WHERE value > 0), c AS (SELECT count(*) AS c FROM embeddings) SELECT 0 AS line, '%%MatrixMarket matrix coordinate real general' AS value UNION ALL SELECT 1, c || ' 12 ' || n FROM n, c UNION ALL SELECT 1 + row_number() OVER (ORDER BY cell, gene), (cell + 1) || ' ' || gene FROM expr WHERE value > 0")
def matrix_market_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The header, the sizes, and the entries' places in order."""
    path, _ = market(spark, sf)
    return readers.lines(spark, path).select("line", F.when(F.col("line") < 2, F.col("value")).otherwise(F.regexp_extract("value", r"^\S+ \S+", 0)).alias("value"))
