"""Standardization, moments and small linear algebra over long or wide tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import zscore

SHIFT_ROWS = 100


def moments(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def standardized(df: DataFrame, value: str, by: list[str], fit: DataFrame | None = None, floor: float = 1e-8, one_below: bool = False) -> DataFrame:
    """df with z; mean and population SD come from all rows, or from the rows of the fit cells only."""
    base = df if fit is None else df.join(fit.select("cell").distinct(), "cell", "left_semi")
    scale = moments(base, value, by)
    return df.join(scale, by).withColumn("z", zscore(F.col(value), F.col("mean"), F.col("sd"), floor, one_below)).drop("mean", "sd")


def weighted_means(df: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("mean"))


def scaled_positions(cells: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Positions from 0, divided by the longest side of the bounding box."""
    box = cells.agg(*(F.min(a).alias(f"lo{a}") for a in axes), *(F.max(a).alias(f"hi{a}") for a in axes))
    side = F.greatest(*(F.col(f"hi{a}") - F.col(f"lo{a}") for a in axes)) if len(axes) > 1 else F.col(f"hi{axes[0]}") - F.col(f"lo{axes[0]}")
    out = cells.crossJoin(F.broadcast(box)).withColumn("side", side)
    return out.select(*[c for c in cells.columns if c not in axes], *(F.when(F.col("side") > 0, (F.col(a) - F.col(f"lo{a}")) / F.col("side")).otherwise(0.0).alias(a) for a in axes))


def library_size(expression: DataFrame, target: float = 1e4, log: bool = True) -> DataFrame:
    """Values scaled to a common total for each cell; a cell without counts stays 0."""
    total = expression.groupBy("cell").agg(F.sum("value").alias("total"))
    v = F.when(F.col("total") > 0, F.col("value") * target / F.col("total")).otherwise(0.0)
    return expression.join(total, "cell").withColumn("value", F.log1p(v) if log else v).drop("total")


def weighted_gram(rows: DataFrame, width_x: int, width_y: int) -> DataFrame:
    """Weighted sums for each group from rows(x array, y array, p array of group weights), in one pass.

    Returns group and the flat sums: mass, sum x, sum y, sum xx', sum xy', sum yy. Every partition adds
    up its own and sends one row a group; the rest is a sum of arrays.
    """
    schema = "receiver_group int, part int, total double"

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: np.ndarray | None = None
        for f in frames:
            if not len(f):
                continue
            x, y, p = (np.stack(f[c].to_numpy()).astype(float) for c in ("x", "y", "p"))
            got = np.stack([np.concatenate([[w.sum()], w @ x, w @ y, ((x * w[:, None]).T @ x).ravel(), ((x * w[:, None]).T @ y).ravel(), w @ (y * y)]) for w in p.T])
            sums = got if sums is None else sums + got
        if sums is not None:
            for g, s in enumerate(sums):
                yield pd.DataFrame({"receiver_group": g, "part": np.arange(len(s)), "total": s})

    parts = rows.select("x", "y", "p").mapInPandas(add, schema).groupBy("receiver_group", "part").agg(F.sum("total").alias("total"))
    return parts.groupBy("receiver_group").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "total"))), lambda s: s["total"]).alias("sums"))


def unpack_gram(sums: np.ndarray, nx: int, ny: int) -> dict[str, np.ndarray]:
    """Weighted means, covariances and variances from the flat sums of one group."""
    m, at = sums[0], 1
    take = lambda n: sums[at : at + n]
    sx = take(nx); at += nx  # noqa: E702
    sy = take(ny); at += ny  # noqa: E702
    xx = take(nx * nx).reshape(nx, nx); at += nx * nx  # noqa: E702
    xy = take(nx * ny).reshape(nx, ny); at += nx * ny  # noqa: E702
    yy = take(ny)
    mx, my = sx / m, sy / m
    return {"mass": m, "mean_x": mx, "mean_y": my, "gram": xx / m - np.outer(mx, mx), "cross": xy / m - np.outer(mx, my), "variance_y": yy / m - my * my}


def covariance(rows: DataFrame, column: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sample covariance (n - 1) of an array column; one pass, sums of partitions.

    Values are taken from near their mean, that of a few rows, or large means would cost the digits of
    small spreads. Which rows these are doesn't matter for the result.
    """
    few = rows.select(column).limit(SHIFT_ROWS).collect()
    shift = np.mean([r[0] for r in few], axis=0, dtype=float) if few else np.zeros(width)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, np.zeros(width), np.zeros((width, width))
        for f in frames:
            if len(f):
                x = np.stack(f[column].to_numpy()).astype(float) - shift
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        v = np.concatenate([[n], s, ss.ravel()])
        yield pd.DataFrame({"part": np.arange(len(v)), "total": v})

    total = rows.select(column).mapInPandas(add, "part int, total double").groupBy("part").agg(F.sum("total").alias("total")).orderBy("part").toPandas()["total"].to_numpy()
    n, s, ss = total[0], total[1 : width + 1], total[width + 1 :].reshape(width, width)
    return int(n), s / n + shift, (ss - np.outer(s, s) / n) / max(n - 1, 1)


def whitened_pca(rows: DataFrame, column: str, width: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and a projection (width x components) onto the leading axes, each scaled to unit variance.

    The matrix to decompose is width x width. An axis is scaled by at least sqrt(1e-10 times the first
    variance); each axis points so that its largest entry is positive.
    """
    _, mean, cov = covariance(rows, column, width)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return mean, vectors / np.sqrt(np.maximum(values, 1e-10 * values[0]))


def projected(rows: DataFrame, column: str, mean: np.ndarray, projection: np.ndarray, out: str = "projected") -> DataFrame:
    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.to_numpy()).astype(float) - mean) @ projection)) if len(v) else pd.Series([], dtype=object)

    return rows.withColumn(out, project(column))


def gene_correlations(long: DataFrame, value: str) -> DataFrame:
    """(a, b, r) with a < b: Pearson correlation of every two genes over the cells that have both."""
    p = long.select("cell", F.col("gene").alias("a"), F.col(value).alias("va"))
    q = long.select("cell", F.col("gene").alias("b"), F.col(value).alias("vb"))
    return p.join(q, "cell").where("a < b").groupBy("a", "b").agg(F.corr("va", "vb").alias("r"))


def squared_distances(rows: DataFrame, column: str, centres: list[list[float]], out: str = "d2") -> DataFrame:
    """Squared distances to each of a few centres, as an array; stays in the JVM."""
    each = [F.aggregate(F.zip_with(column, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centres]
    return rows.withColumn(out, F.array(*each))
