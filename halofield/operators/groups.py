"""Receiver groups: clustering of embeddings, soft membership, choice of their number, gene programs."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import last_argmax, softmax
from ..sources.store import written
from .matrix import projected, squared_distances, whitened_pca
from .ordered import order_statistics


def kmeans(rows: DataFrame, column: str, k: int, restarts: int = 5, iterations: int = 100, seed: int = 168) -> list[list[float]]:
    """Centres of the best of several runs by their cost, in the order of their coordinates."""
    data = rows.select(array_to_vector(F.col(column)).alias("features")).persist()
    best = min((KMeans(k=k, maxIter=iterations, seed=seed + i).fit(data) for i in range(restarts)), key=lambda m: m.summary.trainingCost)
    data.unpersist()
    return sorted([float(v) for v in c] for c in best.clusterCenters())


def upper_median(df: DataFrame, value: str, floor: float = 1e-3) -> float:
    """Element n / 2 of the sorted values, not below floor."""
    middle = order_statistics(df, value, lambda n: [F.floor(n / 2)]).first()["at"]
    return max(float(middle[0]), floor) if middle else floor


def temperature(rows: DataFrame, column: str, centres: list[list[float]]) -> float:
    """Upper median of the gaps between the two nearest centres' squared distances, at least 1e-3."""
    if len(centres) < 2:
        return 1e-3
    two = squared_distances(rows, column, centres).select(F.slice(F.sort_array("d2"), 1, 2).alias("t"))
    return upper_median(two.select((F.col("t")[1] - F.col("t")[0]).alias("gap")), "gap")


def soft_membership(rows: DataFrame, column: str, centres: list[list[float]], heat: float) -> DataFrame:
    """rows with p (softmax of -d2 / heat), receiver_group (last of equal maxima) and maximum_probability."""
    out = squared_distances(rows, column, centres).withColumn("_logits", F.transform("d2", lambda d: -d / F.lit(heat)))
    out = out.withColumn("p", softmax(F.col("_logits"))).drop("_logits", "d2")
    return out.withColumn("receiver_group", last_argmax(F.col("p"))).withColumn("maximum_probability", F.array_max("p"))


def receiver_groups(rows: DataFrame, column: str, k: int, **fit: int) -> tuple[DataFrame, list[list[float]], float]:
    centres = kmeans(rows, column, k, **fit)
    heat = temperature(rows, column, centres)
    return soft_membership(rows, column, centres, heat), centres, heat


def choose_count(folds: DataFrame, least_mass: float = 30.0) -> DataFrame:
    """The table of candidate counts from per-fold errors, the chosen one marked.

    folds(count, fold, baseline_mse, physical_mse, active, minimum_mass). A count is eligible if the mean
    over the folds of its smallest training mass reaches least_mass; of the eligible ones (of all, if none is) the
    smallest whose mean improvement is within one standard error of the best is selected. One row a count.
    """
    gain = (F.col("baseline_mse") - F.col("physical_mse")) / F.greatest("baseline_mse", F.lit(1e-12))
    t = folds.withColumn("gain", gain).groupBy("count").agg(
        F.avg("baseline_mse").alias("baseline_mse"), F.avg("physical_mse").alias("physical_mse"), F.avg("gain").alias("improvement_fraction"),
        F.coalesce(F.stddev_samp("gain") / F.sqrt(F.count("*")), F.lit(0.0)).alias("improvement_standard_error"), F.avg("active").alias("mean_active_effects"), F.avg("minimum_mass").alias("minimum_effective_train_mass"),
    )
    t = t.withColumn("eligible", F.col("minimum_effective_train_mass") >= least_mass)
    pool = t.crossJoin(t.agg(F.max("eligible").alias("_any"))).where(F.col("eligible") | ~F.col("_any"))
    best = pool.agg(F.max(F.struct("improvement_fraction", "count", "improvement_standard_error")).alias("b"))
    bar = F.col("b.improvement_fraction") - F.col("b.improvement_standard_error")
    pick = pool.crossJoin(best).where(F.col("improvement_fraction") >= bar).agg(F.min("count").alias("pick"))
    return t.crossJoin(pick).withColumn("selected", F.coalesce(F.col("count") == F.col("pick"), F.lit(False))).drop("pick")


def programs(correlations: DataFrame, genes: DataFrame, threshold: float) -> DataFrame:
    """(program, gene): components of the graph of |r| >= threshold with two genes or more.

    Minimum labels with pointer jumping over at most genes^2 edges; programs are numbered by falling
    size, then by their first gene.
    """
    edge = correlations.where(F.abs("r") >= threshold).select("a", "b")
    both = written(edge.union(edge.select("b", "a")).distinct())
    label = written(genes.select(F.col("gene").alias("node"), F.col("gene").alias("label")).distinct())
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = label.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("m", "label")).alias("to"))
        jumped = step.join(label.select(F.col("node").alias("to"), F.col("label").alias("beyond")), "to")
        new = written(jumped.select("node", "was", F.least("to", "beyond").alias("label")))
        label = new.select("node", "label")
        if not new.where("label <> was").take(1):
            break
    sizes = label.groupBy("label").agg(F.count("*").alias("size")).where("size > 1")
    order = sizes.select("label", F.struct((-F.col("size")).alias("s"), "label").alias("k"))
    number = order.alias("p").join(order.alias("q"), F.col("q.k") < F.col("p.k"), "left").groupBy(F.col("p.label").alias("label")).agg(F.count("q.label").alias("program"))
    return label.join(number, "label").select("program", F.col("node").alias("gene"))


def reduced_groups(rows: DataFrame, column: str, width: int, components: int, k: int, restarts: int = 12, seed: int = 168) -> DataFrame:
    """rows with `group`: k-means with many restarts on the leading axes of an array column; no soft membership."""
    mean, projection = whitened_pca(rows, column, width, components)
    placed = projected(rows, column, mean, projection)
    centres = kmeans(placed, "projected", k, restarts, seed=seed)
    d2 = squared_distances(placed, "projected", centres)
    return d2.withColumn("group", (F.array_position("d2", F.array_min("d2")) - 1).cast("int")).drop("projected", "d2")


def group_count(manual: int | None, candidates) -> tuple[int, DataFrame | None]:
    """The number of groups and the table of candidates: a manual number is taken as it is, and nothing is fitted.

    candidates() makes the table (see choose_count) where there is none.
    """
    if manual is not None:
        if manual < 1:
            raise ValueError("a manual number of groups must be positive")
        return manual, None
    table = written(candidates())
    chosen = table.where("selected").first()
    if chosen is None:
        raise ValueError("no candidate count is eligible")
    return chosen["count"], table
