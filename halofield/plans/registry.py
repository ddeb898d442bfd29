"""Registered queries: each operator bound to the given tables, with SQL for the same rows where SQL can say it.

Binding: `embeddings` are cells. Coordinates are their first three dimensions, expression of twelve
genes the positive part of the next twelve, residuals of twelve genes the twelve after those; `label`
is the receiver group. `lineitem` and `orders` serve as tables of scored relations and annotations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
GENES, RADIUS, LENGTH, MIN_DISTANCE = 12, 0.15, 0.05, 0.002


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), F.col("label").alias("group"))


def long(spark: SparkSession, sf_dir: str, first: int, positive: bool) -> DataFrame:
    one = lambda k: F.element_at("embedding", first + k).cast("double")
    values = F.array(*(F.greatest(one(k), F.lit(0.0)) if positive else one(k) for k in range(1, GENES + 1)))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.posexplode(values).alias("gene", "value"))
    return rows.select("cell", (F.col("gene") + 1).cast("long").alias("gene"), "value")


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(spark, sf_dir, 3, True)


def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(spark, sf_dir, 15, False)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored relations (cluster, source, target, score) from line items."""
    t = table(spark, sf_dir, "lineitem")
    whole = lambda c: F.round(F.col(c) * 100).cast("long")  # noqa: E731  sums of whole numbers don't depend on their order
    score = F.sum(whole("l_extendedprice") * (100 - whole("l_discount"))).cast("double")
    return t.groupBy(F.col("l_returnflag").alias("cluster"), F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 50).alias("target")).agg(score.alias("score"))


CELLS = "cells AS (SELECT vec_id AS cell, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label AS grp FROM embeddings)"
EXPR = "expr AS (SELECT vec_id AS cell, k AS gene, CAST(greatest(embedding[3 + k], 0) AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(1, 13)) AS k))"
RESIDUAL = "residual AS (SELECT vec_id AS cell, k AS gene, CAST(embedding[15 + k] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(1, 13)) AS k))"
GAP2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
GAP3 = f"{GAP2} + (a.z - b.z) * (a.z - b.z)"
EDGES = f"edges AS (SELECT a.cell AS receiver, b.cell AS sender, sqrt({GAP2}) AS distance FROM cells a JOIN cells b ON a.cell <> b.cell AND {GAP2} <= 0.15e0 * 0.15e0)"
RELATIONS = "relations AS (SELECT l_returnflag AS cluster, l_suppkey AS source, l_partkey % 50 AS target, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS DOUBLE) AS score FROM lineitem GROUP BY 1, 2, 3)"


def knn(k: int, of: str = "cells", to: str = "cells", gap: str = GAP2) -> str:
    """SQL rows (receiver, sender, distance, rank) of the k nearest."""
    return f"(SELECT * FROM (SELECT a.cell AS receiver, b.cell AS sender, sqrt({gap}) AS distance, row_number() OVER (PARTITION BY a.cell ORDER BY sqrt({gap}), b.cell) AS rank FROM {of} a JOIN {to} b ON a.cell <> b.cell) WHERE rank <= {k})"
