"""Clusters on neighbour graphs: density clusters and label propagation; steps are written tables."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .spatial import bins, gaps, knn_join, radius_join
from .trees import AXES

#: Pairs of bins with at most this many pairs of cells are joined; others are tried by halving, nearest parts first.
FEW = 256


def least_reachable(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable over undirected edges(a, b); minimum labels, pointer jumping."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = label.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("to"))
        new = written(step.join(label.select(F.col("node").alias("to"), F.col("label").alias("beyond")), "to").select("node", "was", F.least("to", "beyond").alias("label")))
        label = new.select("node", "label")
        if not new.where("label <> was").take(1):
            return label


def close_bins(cells: DataFrame, radius: float, dims: int) -> DataFrame:
    """cells with their bin, so small that all cells of one bin lie within the radius of each other."""
    return cells.select("cell", *(F.col(x).cast("double").alias(x) for x in AXES[:dims])).select("*", *bins(cells, radius / dims**0.5 * (1 - 1e-9), dims))


def meet(a: np.ndarray, b: np.ndarray, radius: float) -> bool:
    """Whether a point of a lies within the radius of one of b. Only parts whose boxes leave it open are halved, near ones first."""
    open_ = [(0.0, a, b)]
    while open_:
        _, a, b = open_.pop()
        (la, ha), (lb, hb) = ((x.min(0), x.max(0)) for x in (a, b))
        if (np.maximum(np.maximum(lb - ha, la - hb), 0.0) ** 2).sum() > radius * radius * (1 + 1e-9):
            continue
        if len(a) * len(b) <= 4096:
            if (sum((p[:, None] - q[None]) ** 2 for p, q in zip(a.T, b.T)) <= radius * radius).any():
                return True
            continue
        swap = len(a) < 2 or (len(b) > 1 and (hb - lb).max() > (ha - la).max())
        x, y = (b, a) if swap else (a, b)
        axis = int(np.argmax(x.max(0) - x.min(0)))
        cut = np.argpartition(x[:, axis], len(x) // 2)
        gap = lambda p: float((np.maximum(np.maximum(y.min(0) - p.max(0), p.min(0) - y.max(0)), 0.0) ** 2).sum())
        halves = sorted(((gap(h), h) for h in (x[cut[: len(x) // 2]], x[cut[len(x) // 2 :]])), key=lambda h: -h[0])
        open_ += [(g, y, h) if swap else (g, h, y) for g, h in halves]
    return False


def components_within(cells: DataFrame, radius: float, dims: int = 2) -> DataFrame:
    """node, label: the smallest cell reachable in steps of at most the radius, the cell itself included.

    Pairs of cells grow with the square of the cells, so bins are linked instead: all cells of a bin (see close_bins) are
    within reach of each other, and two bins are linked if any of their cells are. Boxes decide most pairs of bins,
    the others go by their cells, of which each bin's distinct places travel to the bins around it.
    """
    axes = AXES[:dims]
    keys = [f"b{x}" for x in axes]
    placed = written(close_bins(cells, radius, dims))
    box = [f(x).alias(f"{e}_{x}") for x in axes for e, f in (("lo", F.min), ("hi", F.max))]
    place = placed.groupBy(*keys, *axes).agg(F.min("cell").alias("cell"))
    nodes = written(place.groupBy(*keys).agg(F.min("cell").alias("node"), F.count("*").alias("n"), *box))
    later = [o for o in product(range(-2, 3), repeat=dims) if o > (0,) * dims]
    around = F.explode(F.array(*(F.struct(*(F.lit(o).cast("long").alias(f"d{k}") for k, o in zip(keys, offset))) for offset in later))).alias("o")
    side = lambda e: [F.col(c).alias(f"{e}{c}") for c in nodes.columns if c not in keys]
    a = nodes.select(*side("a"), *(F.col(k).alias(f"a{k}") for k in keys), around).select("*", *((F.col(f"a{k}") + F.col(f"o.d{k}")).alias(k) for k in keys)).drop("o")
    least, most = gaps("a", "b", dims)
    pairs = a.join(nodes.select(*side("b"), *keys), keys).where(least <= radius * radius * (1 + 1e-9))
    pairs = written(pairs.select("anode", "bnode", "an", "bn", (most <= radius * radius).alias("sure"), *(f"a{k}" for k in keys), *keys))
    links = [nodes.select(F.col("node").alias("a"), F.col("node").alias("b")), pairs.where("sure").select(F.col("anode").alias("a"), F.col("bnode").alias("b"))]
    unsure = pairs.where("not sure").withColumn("few", F.col("an") * F.col("bn") <= FEW)
    own = place.select(*(F.col(k).alias(f"a{k}") for k in keys), *(F.col(x).alias(f"a{x}") for x in axes))
    sent = place.select(*keys, *axes)
    met = unsure.where("few").join(own, [f"a{k}" for k in keys]).join(sent, keys)
    near = sum(((F.col(f"a{x}") - F.col(x)) * (F.col(f"a{x}") - F.col(x)) for x in axes[1:]), (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")))
    links.append(met.where(near <= radius * radius).select(F.col("anode").alias("a"), F.col("bnode").alias("b")).distinct())

    def linked(mine: pa.Table, other: pa.Table) -> pa.Table:
        here = np.stack([mine[f"a{x}"].to_numpy() for x in axes], 1)
        there, to = np.stack([other[x].to_numpy() for x in axes], 1), other["bnode"]
        code = to.combine_chunks().dictionary_encode()
        index = code.indices.to_numpy()
        found = [i for i in range(len(code.dictionary)) if meet(here, there[index == i], radius)] if len(here) else []
        return pa.table({"a": other["anode"].take(pa.array([0] * len(found), pa.int64())), "b": code.dictionary.take(pa.array(found, pa.int64()))})

    many = unsure.where("not few")
    kind = cells.schema["cell"].dataType.simpleString()
    crowded = own.join(many.select(*(f"a{k}" for k in keys)).distinct(), [f"a{k}" for k in keys])
    tried = crowded.groupBy(*(f"a{k}" for k in keys)).cogroup(many.select("anode", "bnode", *(f"a{k}" for k in keys), *keys).join(sent, keys).groupBy(*(f"a{k}" for k in keys)))
    links.append(tried.applyInArrow(linked, f"a {kind}, b {kind}"))
    label = least_reachable(reduce(DataFrame.unionByName, links))
    return placed.join(nodes.select(*keys, "node"), keys).select("cell", "node").join(label, "node").select(F.col("cell").alias("node"), "label")


def density_clusters(cells: DataFrame, radius: float, least: int, dims: int = 2) -> DataFrame:
    """(cell, cluster): cells with `least` cells within the radius (themselves included) are cores; cores
    within the radius share a cluster, named by its smallest core; other cells join the nearest core
    within the radius (ties: smallest), or have a null cluster.

    Where a bin of close cells holds `least` all are cores. The others are fewer than that a bin, so what they meet
    grows with the cells, wherever these lie; cores are linked by components_within.
    """
    keys = [f"b{x}" for x in AXES[:dims]]
    placed = close_bins(cells, radius, dims)
    full = placed.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*keys)
    placed = written(placed.join(full.withColumn("_full", F.lit(True)), keys, "left").withColumn("full", F.coalesce("_full", F.lit(False))).drop("_full"))
    thin = placed.where("not full")
    some = radius_join(thin, placed, radius, dims, self_pairs=True).groupBy(F.col("receiver").alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cell", F.lit(True).alias("_core"))
    placed = written(placed.join(some, "cell", "left").withColumn("core", F.col("full") | F.coalesce("_core", F.lit(False))))
    core = placed.where("core").select("cell", *AXES[:dims])
    label = written(components_within(core, radius, dims))
    near = radius_join(placed.where("not core"), core, radius, dims)
    nearest = near.groupBy(F.col("receiver").alias("cell")).agg(F.min(F.struct("distance", "sender")).alias("x")).select("cell", F.col("x.sender").alias("node"))
    named = nearest.join(label, "node").select("cell", F.col("label").alias("cluster")).unionByName(label.select(F.col("node").alias("cell"), F.col("label").alias("cluster")))
    return cells.select("cell").join(named, "cell", "left")


def propagated_labels(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, label) after rounds in which every node takes the label that most of its neighbours have
    (ties: smallest). edges(receiver, sender). Another algorithm than modularity clustering."""
    both = written(edges.select(F.col("receiver").alias("a"), F.col("sender").alias("b")).union(edges.select("sender", "receiver")).distinct())
    label = written(both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
    for _ in range(rounds):
        votes = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.count("*").alias("n"))
        best = votes.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "label"))).where("r = 1").select("node", F.col("label").alias("to"))
        step = written(label.join(best, "node").select("node", F.col("label").alias("was"), F.col("to").alias("label")))
        label = step.select("node", "label")
        if not step.where("label <> was").take(1):
            break
    return label


def shortest_paths(edges: DataFrame, sources: DataFrame, most: int = 10) -> DataFrame:
    """(source, node, steps): fewest undirected edges(a, b) from each source(node) to the nodes within `most` steps.

    Each round extends only the pairs found last, so a round costs their number times the degree.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    found = written(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("steps")).distinct())
    last = found
    for step in range(1, most + 1):
        reached = last.join(both, F.col("node") == F.col("a")).select("source", F.col("b").alias("node")).distinct()
        last = written(reached.join(found, ["source", "node"], "left_anti").withColumn("steps", F.lit(step)))
        if not last.take(1):
            break
        found = found.unionByName(last)
    return found


def densest_crop(cells: DataFrame, radius: float, size: int = 14, dims: int = 2) -> DataFrame:
    """(centre, node, rank): of the largest component of cells linked within the radius the cell whose
    `size` nearest neighbours within it lie closest together, and these neighbours. Ties: the smallest cell.

    Closeness is the mean distance to the neighbours; cells with fewer than `size` come after all others. Neither the
    component nor the nearest need the pairs within the radius (see components_within and knn_join).
    """
    label = written(components_within(cells, radius, dims))
    largest = label.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1)
    inside = written(cells.join(label.join(F.broadcast(largest), "label", "left_semi").select(F.col("node").alias("cell")), "cell", "left_semi"))
    ranked = written(knn_join(inside, inside, size, dims, radius=radius))
    centre = ranked.groupBy("receiver").agg(F.count("*").alias("n"), F.avg("distance").alias("mean")).orderBy(F.desc("n"), "mean", "receiver").limit(1)
    return ranked.join(F.broadcast(centre.select("receiver")), "receiver", "left_semi").select(F.col("receiver").alias("centre"), F.col("sender").alias("node"), "rank")


def average_linkage(distances: DataFrame) -> DataFrame:
    """(left, right, height, size): the merges of average linkage over items with distances(a, b, distance) between all.

    Each pair is given once, either way round. Clusters are named by their smallest item, and left < right.
    In each round all pairs merge that are each other's nearest (of equal ones the smallest name): with
    average linkage no other order gives other heights, as a merge never brings a cluster nearer to a third.
    Where distances tie, pairs of smaller names merge first. Distances between merged clusters are means weighted
    by sizes, from the table of the round before, so a round is two joins over items^2 rows or fewer.
    """
    both = distances.select("a", "b", F.col("distance").cast("double").alias("d"))
    d = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).where("a <> b"))
    size = written(d.select(F.col("a").alias("node")).distinct().withColumn("n", F.lit(1).cast("long")))
    merges = []
    while d.take(1):
        near = d.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.d").alias("d"))
        back = near.select(F.col("b").alias("a"), F.col("a").alias("b"))
        pairs = written(near.join(back, ["a", "b"]).where("a < b"))
        merges.append(pairs.join(size.withColumnsRenamed({"node": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"node": "b", "n": "nb"}), "b").select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("d").alias("height"), (F.col("na") + F.col("nb")).alias("size")))
        to = size.join(pairs.select(F.col("b").alias("node"), F.col("a").alias("into")), "node", "left").select("node", "n", F.coalesce("into", "node").alias("into"))
        to = written(to)
        sums = d.join(to.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("into").alias("ia")), "a").join(to.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("into").alias("ib")), "b").where("ia <> ib")
        weight = F.col("na") * F.col("nb")
        d = written(sums.groupBy(F.col("ia").alias("a"), F.col("ib").alias("b")).agg((F.sum(weight * F.col("d")) / F.sum(weight)).alias("d")))
        size = written(to.groupBy(F.col("into").alias("node")).agg(F.sum("n").alias("n")))
    return reduce(DataFrame.unionByName, merges) if merges else distances.select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("distance").cast("double").alias("height"), F.lit(2).cast("long").alias("size")).limit(0)
