"""Ranks, top-k, shares and sets. Every order has a tie key, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], score: str, tie: list[str], out: str = "rank") -> DataFrame:
    """Row numbers by falling score."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *tie)))


def competition_rank(df: DataFrame, by: list[str], score: str, out: str = "rank") -> DataFrame:
    """1 + how many of the group score strictly more."""
    return df.withColumn(out, F.rank().over(Window.partitionBy(*by).orderBy(F.desc(score))))


def top(df: DataFrame, by: list[str], score: str, tie: list[str], n: int) -> DataFrame:
    """The first n of each group; Catalyst limits each group before the exchange."""
    return ranked(df, by, score, tie).where(F.col("rank") <= n)


def top_fraction(df: DataFrame, by: list[str], score: str, tie: list[str], fraction: float, most: int) -> DataFrame:
    """The first ceil(n * fraction) of each group of n, at most `most`."""
    n = F.count("*").over(Window.partitionBy(*by))
    return ranked(df, by, score, tie).withColumn("_n", n).where(F.col("rank") <= F.least(F.ceil(F.col("_n") * F.lit(fraction)), F.lit(most))).drop("_n")


def share(df: DataFrame, by: list[str], value: str, out: str = "share", absolute: bool = True) -> DataFrame:
    """The part that each row's value has in its group's sum; 0 where the sum is 0."""
    v = F.abs(value) if absolute else F.col(value)
    total = F.sum(v).over(Window.partitionBy(*by))
    return df.withColumn(out, F.when(total > 0, v / total).otherwise(0.0))


def first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def nested_top(df: DataFrame, cluster: str, target: str, source: str, score: str, targets: int, sources: int) -> DataFrame:
    """The top targets of each cluster by their best score, and the top sources of each of those."""
    best = df.groupBy(cluster, target).agg(F.max(score).alias("best"))
    chosen = top(best, [cluster], "best", [target], targets).select(cluster, target, F.col("rank").alias("target_rank"))
    return top(df.join(chosen, [cluster, target]), [cluster, target], score, [source], sources).withColumnRenamed("rank", "source_rank")


def shared_top(df: DataFrame, by: str, item: str, score: str, n: int) -> DataFrame:
    """The top items of each group and in how many groups each is at the top."""
    best = top(df, [by], score, [item], n)
    return best.withColumn("groups", F.count("*").over(Window.partitionBy(item)))


def cumulative_hits(df: DataFrame, by: list[str], score: str, tie: list[str], hit: str) -> DataFrame:
    """Hits so far and recall along the ranks."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    total = F.sum(F.col(hit).cast("int")).over(Window.partitionBy(*by))
    out = df.withColumn("rank", F.row_number().over(order)).withColumn("hits", F.sum(F.col(hit).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("recall", F.when(total > 0, F.col("hits") / total).otherwise(0.0))


def top_two_margin(df: DataFrame, by: list[str], score: str, tie: list[str]) -> DataFrame:
    """The best row of each group and its lead over the second (null if alone)."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    return df.withColumn("_r", F.row_number().over(order)).withColumn("margin", F.col(score) - F.lead(score).over(order)).where("_r = 1").drop("_r")


def membership_patterns(universe: DataFrame, key: str, sets: dict[str, DataFrame]) -> DataFrame:
    """How many keys belong to exactly which sets."""
    out = universe.select(key).distinct()
    for name, members in sets.items():
        out = out.join(members.select(key, F.lit(True).alias(f"in_{name}")).distinct(), key, "left").na.fill(False, [f"in_{name}"])
    return out.groupBy(*(f"in_{name}" for name in sets)).agg(F.count("*").alias("n"))


def every_other(df: DataFrame, item: str) -> DataFrame:
    """Each second of the sorted distinct items, from the first on. One partition: for small lists of names."""
    return df.select(item).distinct().withColumn("_r", F.row_number().over(Window.orderBy(item))).where("_r % 2 = 1").drop("_r")


def looked_up(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """df with the columns of table by key; a key that table lacks is an error where the row is read."""
    return df.join(table.withColumn("_found", F.lit(True)), key, "left").withColumn("_found", F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string")))).otherwise(True)).where("_found").drop("_found")


def many_to_one(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join; a key that table has twice is an error."""
    once = table.withColumn("_n", F.count("*").over(Window.partitionBy(key))).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col(key).cast("string")))).otherwise(F.col("_n"))).where("_n = 1").drop("_n")
    return df.join(once, key, "left")
