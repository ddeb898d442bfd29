"""Neighbour joins over positions. Tables have a key column `cell` and coordinates x, y (and z).

A radius join compares nothing but cells in adjacent grid bins: both sides get the bin of their
position, one side is repeated once for each neighbouring bin, and the bins meet in an equi-join, so
Catalyst picks a hash or sort-merge join and adaptive execution splits bins that hold too many cells.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .trees import AXES, STRIDE, bin_keys, counted, crowded_bins, even_width, finest, leaf_of, nodes_above, root_level

#: Levels of a tree that are gone down before the pairs of nodes are written.
LEVELS_AT_ONCE = 3

#: Receivers of a bin that one task joins at most.
DEALT = 2048


def bins(df: DataFrame, width: float, dims: int) -> list[Column]:
    return [F.floor(F.col(a) / F.lit(width)).cast("long").alias(f"b{a}") for a in AXES[:dims]]


def radius_join(receivers: DataFrame, senders: DataFrame, radius: float, dims: int = 2, self_pairs: bool = False) -> DataFrame:
    """(receiver, sender, distance) for all pairs at most radius apart, the radius included.

    The senders are repeated over the adjacent bins, so filter them first. Where a bin has many receivers they are
    dealt by hash, and the senders go to each part: such bins are few bytes, too few to be split as skewed, and
    many pairs. Receivers and senders may be one table; a cell is paired with itself only with self_pairs.
    """
    axes = AXES[:dims]
    # Positions are few bytes and their pairs many rows, and a small table is one file and one task; so both
    # sides are dealt out evenly first. The join's own exchange, if it has one, can still be split by skew.
    n = int(receivers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    receivers, senders = receivers.select("cell", *axes).repartition(n), senders.select("cell", *axes).repartition(n)
    r = receivers.select(F.col("cell").alias("receiver"), *(F.col(a).cast("double").alias(f"r{a}") for a in axes), *bins(receivers, radius, dims))
    near = F.array(*(F.struct(*(F.lit(o).cast("long").alias(f"d{a}") for a, o in zip(axes, offset))) for offset in product((-1, 0, 1), repeat=dims)))
    s = senders.select(F.col("cell").alias("sender"), *(F.col(a).cast("double").alias(f"s{a}") for a in axes), *bins(senders, radius, dims), F.explode(near).alias("o"))
    s = s.select("sender", *(f"s{a}" for a in axes), *((F.col(f"b{a}") + F.col(f"o.d{a}")).alias(f"b{a}") for a in axes))
    squared = reduce(lambda p, q: p + q, ((F.col(f"r{a}") - F.col(f"s{a}")) * (F.col(f"r{a}") - F.col(f"s{a}")) for a in axes))
    keys = [f"b{a}" for a in axes]
    crowded = r.groupBy(*keys).agg(F.ceil(F.count("*") / DEALT).alias("_parts")).where("_parts > 1")
    r = r.join(crowded, keys, "left").withColumn("part", F.pmod(F.xxhash64("receiver"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    s = s.join(crowded, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    met = r.join(s, [*keys, "part"]).withColumn("d2", squared).where(F.col("d2") <= radius * radius)
    if not self_pairs:
        met = met.where("receiver <> sender")
    return met.select("receiver", "sender", F.sqrt("d2").alias("distance"))


def radius_pairs(receivers: DataFrame, senders: DataFrame, radius: float, dims: int = 2, on: tuple[str, ...] = (), self_pairs: bool = False) -> DataFrame:
    """receivers(receiver, x, y[, z], ...) beside each of senders(sender, x, y[, z], ...) at most a radius away and equal in `on`, with distance.

    What both carry is at hand where they meet, so pairs can be filtered and added up before anything moves.
    """
    axes, width = AXES[:dims], radius / 2 * (1 + 1e-9)
    n = int(receivers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, sent = ([c for c in t.columns if c not in axes] for t in (receivers, senders))
    at = lambda t, k: [*(F.col(a).cast("double").alias(f"{k}{a}") for a in axes), *bins(t, width, dims)]
    near = F.array(*(F.struct(*(F.lit(o).cast("long").alias(f"d{a}") for a, o in zip(axes, offset))) for offset in product(range(-2, 3), repeat=dims)))
    r = receivers.repartition(n).select(*own, *at(receivers, "r"))
    s = senders.repartition(n).select(*sent, *at(senders, "s"), F.explode(near).alias("o"))
    s = s.select(*sent, *(f"s{a}" for a in axes), *((F.col(f"b{a}") + F.col(f"o.d{a}")).alias(f"b{a}") for a in axes))
    squared = reduce(lambda p, q: p + q, ((F.col(f"r{a}") - F.col(f"s{a}")) * (F.col(f"r{a}") - F.col(f"s{a}")) for a in axes))
    met = r.join(s, [*(f"b{a}" for a in axes), *on]).where(squared <= radius * radius)
    met = met if self_pairs else met.where("receiver <> sender")
    return met.select(*own, *(c for c in sent if c not in on), F.sqrt(squared).alias("distance"))


def nearest(edges: DataFrame, n: int) -> DataFrame:
    """The n nearest senders of each receiver, ties by sender."""
    order = Window.partitionBy("receiver").orderBy("distance", "sender")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def gaps(a: str, b: str, dims: int) -> tuple[Column, Column]:
    """Squared least and largest distance between points of two boxes, columns <a>lo_x, <a>hi_x, ... and <b>lo_x, ..."""
    low, high = [], []
    for x in AXES[:dims]:
        la, ha, lb, hb = (F.col(f"{s}{e}_{x}") for s in (a, b) for e in ("lo", "hi"))
        apart = F.greatest(lb - ha, la - hb, F.lit(0.0))
        across = F.greatest(hb - la, ha - lb)
        low.append(apart * apart)
        high.append(across * across)
    return reduce(lambda p, q: p + q, low), reduce(lambda p, q: p + q, high)


def node_columns(dims: int) -> list[str]:
    return ["level", *bin_keys(dims), "n", *(f"{s}_{a}" for a in AXES[:dims] for s in ("lo", "hi")), "leaf"]


def descended(receivers: DataFrame, senders: DataFrame, need: int, top: int, levels: int, dims: int) -> DataFrame:
    """Pairs of a receiver leaf and a sender leaf that may hold one of its points' `need` nearest, with `bound`, their squared distance at most.

    Both trees (nodes as from nodes_above) are gone down together. For the boxes that a receiver node still has, those
    with the least largest distance that hold need senders bound the distance of its points' nearest, and
    boxes beyond the bound are left out; then both nodes give way to their halves. A node keeps some
    tens of boxes, so a level costs some tens of rows a node, whatever the density and however far an outlier lies.
    """
    columns, keys = node_columns(dims), ["level", *bin_keys(dims)]

    def below(nodes: DataFrame, side: str) -> DataFrame:
        """Nodes by the one they come from; a leaf stands in for its own halves, too."""
        half = nodes.where(F.col("level") > top).withColumns({"p_level": F.col("level") - 1} | {f"p_{k}": F.shiftright(k, 1) for k in keys[1:]})
        same = nodes.where("leaf").withColumns({f"p_{k}": F.col(k) for k in keys})
        both = half.unionByName(same)
        return both.select(*(F.col(f"p_{k}").alias(f"{side}p_{k}") for k in keys), *(F.col(c).alias(f"{side}{c}") for c in columns))

    def pruned(pairs: DataFrame) -> DataFrame:
        least, most = gaps("r", "s", dims)
        node = Window.partitionBy(*(f"r{k}" for k in keys))
        nearer = node.orderBy("_most").rowsBetween(Window.unboundedPreceding, 0)
        pairs = pairs.withColumn("_least", least).withColumn("_most", most).withColumn("_have", F.sum("sn").over(nearer))
        bound = F.coalesce(F.min(F.when(F.col("_have") >= need, F.col("_most"))).over(node), F.lit(float("inf")))
        return pairs.withColumn("bound", bound).where(F.col("_least") <= F.col("bound") * (1 + 1e-12)).drop("_least", "_most", "_have")

    named = lambda nodes, side: nodes.where(F.col("level") == top).select(*(F.col(c).alias(f"{side}{c}") for c in columns))
    # at most 256 roots a side
    pairs = pruned(named(receivers, "r").crossJoin(F.broadcast(named(senders, "s"))))
    lower = {"r": below(receivers, "r"), "s": below(senders, "s")}
    for i in range(levels):
        for side in ("r", "s"):
            above = [f"{side}p_{k}" for k in keys]
            pairs = pairs.drop(*(f"{side}{c}" for c in columns if c not in keys)).withColumnsRenamed({f"{side}{k}": f"{side}p_{k}" for k in keys})
            pairs = pairs.join(lower[side], above).drop(*above)
        pairs = pruned(pairs.drop("bound"))
        if i % LEVELS_AT_ONCE == LEVELS_AT_ONCE - 1 or i == levels - 1:
            pairs = written(pairs)
    return pairs


def candidates(receivers: DataFrame, senders: DataFrame, k: int, dims: int = 2, start: float | None = None, self_pairs: bool = False) -> DataFrame | None:
    """(receiver, sender, d2) of pairs among which are all that a k-nearest join needs; None without a sender or receiver.

    Of senders at one place only the first k + 1 count. Bins of their tree hold at most 2 k of them; receivers
    lie in the bins of the same tree. start is the width of the bins that halving starts from; by default it
    follows the mean density of the senders' bounding box.
    """
    axes, most, need = AXES[:dims], 2 * k, k if self_pairs else k + 1
    position = [F.col(a).cast("double").alias(a) for a in axes]
    r, s = receivers.select("cell", *position), senders.select("cell", *position)
    both = s.withColumn("_s", F.lit(1)).unionByName(r.withColumn("_s", F.lit(0)))
    ends = [f(F.when(F.col("_s") == 1, F.col(a)) if own else F.col(a)).alias(f"{e}{a}{own}") for own in (0, 1) for a in axes for e, f in (("lo", F.min), ("hi", F.max))]
    box = both.agg(F.sum("_s").alias("n"), F.count("*").alias("all"), *ends).first()
    if not box["n"] or box["n"] == box["all"]:
        return None
    width = start or even_width(box["n"], [box[f"hi{a}1"] - box[f"lo{a}1"] for a in axes], most / 2)
    top = root_level([box[f"lo{a}0"] for a in axes], [box[f"hi{a}0"] for a in axes], width)
    first = s.withColumn("_at", F.row_number().over(Window.partitionBy(*axes).orderBy("cell"))).where(F.col("_at") <= k + 1).drop("_at")
    fine = written(finest(first, width, dims))
    crowded, levels = crowded_bins(fine, dims, most)
    sp, rp = leaf_of(fine, crowded, levels, dims), leaf_of(finest(r, width, dims), crowded, levels, dims)
    if levels > STRIDE:
        sp, rp = written(sp), written(rp)
    rt, st = (written(nodes_above(counted(p, dims), top, dims)) for p in (rp, sp))
    pairs = descended(rt, st, need, top, levels - top, dims)
    keys = ["level", *bin_keys(dims)]
    met = rp.select(F.col("cell").alias("receiver"), *(F.col(a).alias(f"lo_{a}") for a in axes), *(F.col(a).alias(f"hi_{a}") for a in axes), *(F.col(c).alias(f"r{c}") for c in keys))
    met = met.join(pairs.select(*(f"r{c}" for c in keys), *(f"s{c}" for c in keys), *(f"s{e}_{a}" for a in axes for e in ("lo", "hi")), "bound"), [f"r{c}" for c in keys])
    met = met.where(gaps("", "s", dims)[0] <= F.col("bound") * (1 + 1e-12)).select("receiver", *(F.col(f"lo_{a}").alias(f"r{a}") for a in axes), *(f"s{c}" for c in keys))
    met = met.join(sp.select(F.col("cell").alias("sender"), *(F.col(a).alias(f"s{a}") for a in axes), *(F.col(c).alias(f"s{c}") for c in keys)), [f"s{c}" for c in keys])
    return met.select("receiver", "sender", reduce(lambda p, q: p + q, ((F.col(f"r{a}") - F.col(f"s{a}")) * (F.col(f"r{a}") - F.col(f"s{a}")) for a in axes)).alias("d2"))


def knn_join(receivers: DataFrame, senders: DataFrame, k: int, dims: int = 2, start: float | None = None, self_pairs: bool = False, radius: float | None = None) -> DataFrame:
    """(receiver, sender, distance, rank) of the k nearest senders, ties by sender; with a radius of those within it.

    Trees of bins follow the density of both sides, so dense clusters, thin regions and outliers cost
    each receiver some 10 k pairs alike. Receivers get all senders where there are fewer than k.
    """
    pairs = candidates(receivers, senders, k, dims, start, self_pairs)
    if pairs is None:
        return radius_join(receivers, senders, 1.0, dims, self_pairs).withColumn("rank", F.lit(1)).limit(0)
    if not self_pairs:
        pairs = pairs.where("receiver <> sender")
    if radius is not None:
        pairs = pairs.where(F.col("d2") <= radius * radius)
    return nearest(pairs.select("receiver", "sender", F.sqrt("d2").alias("distance")), k)


def nearest_distance(receivers: DataFrame, senders: DataFrame, dims: int = 2, self_pairs: bool = False) -> DataFrame:
    """receiver and the distance to its nearest sender."""
    return knn_join(receivers, senders, 1, dims, self_pairs=self_pairs).select("receiver", "distance")


def context(seeds: DataFrame, cells: DataFrame, k: int, limit: float, dims: int = 2) -> DataFrame:
    """The seeds and, of each seed's k nearest cells, those within the limit; each cell once."""
    near = knn_join(seeds, cells, k, dims).where(F.col("distance") <= limit)
    return near.select(F.col("sender").alias("cell")).union(seeds.select("cell")).distinct()


def other_sample_neighbours(cells: DataFrame, k: int, sample: str, dims: int = 2) -> DataFrame:
    """For each cell, how many of its k nearest neighbours belong to another sample."""
    of = cells.select("cell", F.col(sample).alias("s"))
    edges = knn_join(cells, cells, k, dims).join(of.select(F.col("cell").alias("receiver"), F.col("s").alias("rs")), "receiver").join(of.select(F.col("cell").alias("sender"), F.col("s").alias("ss")), "sender")
    return edges.groupBy("receiver").agg(F.count_if(F.col("rs") != F.col("ss")).alias("n_other"))


def truth_edges(cells: DataFrame, relations: DataFrame, expression: DataFrame, radius: float, dims: int = 2, active: float = 0.0) -> DataFrame:
    """(source, target, sender, receiver, distance) of every planted relation that is active somewhere.

    relations(source, target, sender_group, receiver_group); cells has `group`; expression is long. The
    sender expresses the source gene above active, the receiver expresses the target gene.
    """
    on = expression.where(F.col("value") > active)
    sender = relations.join(cells.withColumnRenamed("group", "sender_group"), "sender_group").join(on.select("cell", F.col("gene").alias("source")), ["cell", "source"])
    receiver = relations.join(cells.withColumnRenamed("group", "receiver_group"), "receiver_group").join(on.select("cell", F.col("gene").alias("target")), ["cell", "target"])
    pairs = radius_join(receiver.select("cell", *AXES[:dims]).distinct(), sender.select("cell", *AXES[:dims]).distinct(), radius, dims)
    key = ["source", "target", "sender_group", "receiver_group"]
    out = pairs.join(sender.select(F.col("cell").alias("sender"), *key), "sender").join(receiver.select(F.col("cell").alias("receiver"), *key), ["receiver", *key])
    return out.select(*key, "sender", "receiver", "distance")


def bin_labels(points: DataFrame, labelled: DataFrame, width: float, least: int, dims: int = 2) -> DataFrame:
    """points with the label that most labelled cells in their bin have (ties: smallest); null below least."""
    keys = [f"b{a}" for a in AXES[:dims]]
    votes = labelled.select("label", *bins(labelled, width, dims)).groupBy(*keys, "label").agg(F.count("*").alias("n"))
    top = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("t")).where(-F.col("t.n") >= least).select(*keys, F.col("t.label").alias("region"))
    return points.select("*", *bins(points, width, dims)).join(top, keys, "left").drop(*keys)
