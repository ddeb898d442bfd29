"""Trees of bins over positions: bins that hold too much are halved along each axis until they don't.

Level 0 has bins of a given width; a leaf is the first bin down from there that isn't crowded.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import written

AXES = ("x", "y", "z")
#: Levels below level 0, and levels counted in one scan.
DEPTH, STRIDE = 40, 6


def bin_keys(dims: int) -> list[str]:
    return [f"k_{a}" for a in AXES[:dims]]


def finest(points: DataFrame, width: float, dims: int) -> DataFrame:
    """points with their bins f_x, f_y, ... on the last level below bins of a width."""
    return points.withColumns({f"f_{a}": F.floor(F.col(a) / F.lit(width / 2**DEPTH)).cast("long") for a in AXES[:dims]})


def code(dims: int, level: str | int) -> list[Column]:
    """The bin on a level, as k_x, k_y, ...; a level halves the width of the one before."""
    return [F.expr(f"shiftright(f_{a}, {DEPTH} - {level})").alias(f"k_{a}") for a in AXES[:dims]]


def crowded_bins(fine: DataFrame, dims: int, most: int, depth: int = DEPTH) -> tuple[DataFrame, int]:
    """(level, k_...) of the bins from level 0 on that hold more than most points, and how many levels have any.

    fine is as from finest. A crowded bin lies in a crowded one, so counting goes on in crowded bins alone, STRIDE
    levels a scan; even density costs one. They are at most points / most a level.
    """
    found, base = [], 0
    while base < depth:
        inside = fine
        if base:
            inside = fine.select("*", *code(dims, base - 1)).join(found[-1].where(F.col("level") == base - 1), bin_keys(dims), "left_semi").drop("level", *bin_keys(dims))
        last = min(base + STRIDE, depth)
        each = inside.select(*(f"f_{a}" for a in AXES[:dims]), F.explode(F.sequence(F.lit(base), F.lit(last - 1))).alias("level"))
        found.append(written(each.groupBy("level", *code(dims, "level")).agg(F.count("*").alias("n")).where(F.col("n") > most).drop("n")))
        deepest = found[-1].agg(F.max("level")).first()[0]
        if deepest is None or deepest < last - 1:
            return reduce(DataFrame.unionByName, found), base if deepest is None else deepest + 1
        base = last
    return reduce(DataFrame.unionByName, found), depth


def leaf_of(fine: DataFrame, crowded: DataFrame, levels: int, dims: int) -> DataFrame:
    """Points with their leaf (level, k_...): the first bin down from level 0 that isn't crowded."""
    keys, out = bin_keys(dims), fine.withColumn("level", F.lit(0))
    for level in range(levels):
        # adaptive execution broadcasts a small side and splits a bin that holds a large part of the points
        over = crowded.where(F.col("level") == level).select(*keys, F.lit(1).alias("_c"))
        out = out.select("*", *code(dims, level)).join(over, keys, "left").withColumn("level", F.col("level") + F.coalesce("_c", F.lit(0))).drop("_c", *keys)
    return out.select("*", *code(dims, "level")).drop(*(f"f_{a}" for a in AXES[:dims]))


def counted(placed: DataFrame, dims: int) -> DataFrame:
    """(level, k_..., n, lo_..., hi_...) of each leaf: its points and the box around them."""
    box = [f(a).alias(f"{s}_{a}") for a in AXES[:dims] for s, f in (("lo", F.min), ("hi", F.max))]
    return placed.groupBy("level", *bin_keys(dims)).agg(F.count("*").alias("n"), *box)


def nodes_above(leaves: DataFrame, top: int, dims: int) -> DataFrame:
    """All nodes from the leaves (as from counted) up to the level top, with `leaf`. Levels above 0 are negative."""
    sides = [f"{s}_{a}" for a in AXES[:dims] for s in ("lo", "hi")]
    up = leaves.select(F.col("level").alias("_l"), *bin_keys(dims), "n", *sides, F.explode(F.sequence(F.lit(top), F.col("level"))).alias("level"))
    box = [(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in sides]
    code_ = [F.expr(f"shiftright({k}, _l - level)").alias(k) for k in bin_keys(dims)]
    return up.groupBy("level", *code_).agg(F.sum("n").alias("n"), *box, F.max(F.col("level") == F.col("_l")).alias("leaf"))


def root_level(low: list[float], high: list[float], width: float, most: int = 256) -> int:
    """The last level, from 0 up, on which a box meets at most so many bins."""
    level = 0
    while math.prod(math.floor(h / (width * 2.0**-level)) - math.floor(lo / (width * 2.0**-level)) + 1 for lo, h in zip(low, high)) > most:
        level -= 1
    return level


def even_width(n: int, sides: list[float], held: float) -> float:
    """The width of bins that would hold so many of n points spread evenly over a box."""
    long = [s for s in sides if s > 0]
    return (math.prod(long) * held / n) ** (1 / len(long)) if long else 1.0
