"""Samples and permutations. Random ones follow a hash of seed and key, so they don't depend on partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import draw, uniform
from ..sources.store import written
from .ordered import running


def spread(n, take):
    """Places floor(k * n / take) for k below take, as an array of longs."""
    return F.transform(F.sequence(F.lit(0).cast("long"), take - 1), lambda k: F.floor(k * n / take))


def balanced(df: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """At most most / groups rows of each group, evenly spaced in the order of key.

    Places inside a group come from ranges of (group, key) and the sizes of groups and of their parts in
    each range, so a group that holds most rows is dealt over many tasks. A null group is one of its own
    for its size, but not counted as a group.
    """
    n_groups = df.agg(F.countDistinct(group).alias("groups"))
    placed = written(df.repartitionByRange(group, key).withColumn("_p", F.spark_partition_id()))
    # one row for each group and range that it reaches into: at most groups + ranges rows
    sizes = placed.groupBy(F.col(group).alias("_g"), F.col("_p").alias("_q")).agg(F.count("*").alias("_k"))
    before = Window.partitionBy("_g").orderBy("_q")
    sizes = sizes.withColumn("_n", F.sum("_k").over(Window.partitionBy("_g"))).withColumn("_b", F.sum("_k").over(before) - F.col("_k"))
    inside = F.row_number().over(Window.partitionBy("_p", group).orderBy(key)) - 1
    sized = placed.withColumn("_i", inside).join(sizes, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    sized = sized.withColumn("_r", F.col("_b") + F.col("_i")).crossJoin(F.broadcast(n_groups))
    take = F.least(F.col("_n"), F.greatest(F.floor(F.lit(most) / F.col("groups")), F.lit(1)).cast("long"))
    # k exists with floor(k * n / take) = r exactly if the smallest k with k * n >= r * take gives r
    first = F.ceil(F.col("_r") * F.col("_take") / F.col("_n"))
    kept = sized.withColumn("_take", take).where((first < F.col("_take")) & (F.floor(first * F.col("_n") / F.col("_take")) == F.col("_r")))
    return kept.select(df.columns)


def systematic(df: DataFrame, index: str, total: int, most: int) -> DataFrame:
    """The rows with index floor(i * total / most) for i below most; index runs from 0 without gaps."""
    if total <= most:
        return df
    first = F.ceil(F.col(index) * F.lit(most) / F.lit(total))
    return df.where((first < most) & (F.floor(first * F.lit(total) / F.lit(most)) == F.col(index)))


def stratified(df: DataFrame, group: str, key: str, fraction: float, seed: int) -> DataFrame:
    """max(1, round(n * fraction)) random rows of each group, placed in ranges of (group, hash)."""
    placed = running(df.withColumn("_h", draw(seed, key)), [group], ["_h", key], {"_r": F.lit(1)})
    return placed.where(F.col("_r") < F.greatest(F.lit(1), F.round(F.col("_r_all") * F.lit(fraction)))).select(df.columns)


def epoch_sample(df: DataFrame, sample: str, key: str, limit: int, least: int, seed: int, epoch: int) -> DataFrame:
    """limit rows for an epoch, at least `least` of each sample where it has them; another seed or epoch gives others.

    Rows that a sample is owed come first, the rest by hash. Both places, in the sample and over all, come
    from ranges, so no task sees a whole sample, and the rows taken stay spread.
    """
    hashed = df.withColumn("_h", draw(seed, F.lit(str(epoch)), key))
    owed = running(hashed, [sample], ["_h", key], {"_r": F.lit(1)}).withColumn("_late", F.col("_r") >= least)
    return running(owed.drop("_r", "_r_all"), [], ["_late", "_h", key], {"_i": F.lit(1)}).where(F.col("_i") < limit).select(df.columns)


def permuted(df: DataFrame, index: str, seed: int) -> DataFrame:
    """(index, taken): a permutation of an index that runs from 0; for control runs over one table of cells.

    The n-th index by hash takes n. Places come from the ranges of a range exchange.
    """
    from ..sources.readers import numbered

    shuffled = numbered(df.select(index).withColumn("_h", draw(seed, index)), ["_h", index], "taken")
    return shuffled.select(index, "taken")


def bootstrap(df: DataFrame, value: str, by: list[str], replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """Mean of each group with a percentile interval from Poisson(1) weights, a set of weights a replicate.

    A row's weight in a replicate is a function of seed, replicate and the row's key `key`. Sums are
    partial before the exchange, so a replicate costs one row a group and partition.
    """
    u = uniform(seed, "replicate", "key")
    edges = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = sum((F.when(u >= e, 1).otherwise(0) for e in edges[1:]), F.when(u >= edges[0], 1).otherwise(0))
    drawn = df.select(*by, "key", value, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).withColumn("w", weight)
    means = drawn.groupBy(*by, "replicate").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    side = (1 - level) / 2
    ci = means.groupBy(*by).agg(F.percentile("m", F.lit(side)).alias("low"), F.percentile("m", F.lit(1 - side)).alias("high"))
    return df.groupBy(*by).agg(F.avg(value).alias("mean")).join(ci, by)


def permutation_null(df: DataFrame, score: str, hit: str, key: str, repeats: int, seed: int, most: int = 500_000) -> DataFrame:
    """Average precision of df's ranking, its mean under permuted hits, and p = (1 + as good) / (repeats + 1).

    A repeat's order is that of a hash (see draw), which is spread evenly, so its first bits part a repeat into slots of
    some `most` rows without a look at the rows. A row moves once a repeat, as the 16 bytes of its hash; a task ranks a
    slot's hits in it, and ranks and hits so far are carried from slot to slot. Rows are dealt out before they
    are repeated, as a small table is one task.
    """
    base = df.select(key, (-F.col(score)).alias("_o"), F.col(hit).cast("int").alias("hit"))
    ranked = running(base, [], ["_o", key], {"r": F.lit(1), "seen": F.col("hit")}).where("hit = 1")
    observed = ranked.agg(F.avg((F.col("seen") + 1) / (F.col("r") + 1)).alias("observed"))
    bits = min(16, max(0, math.ceil(math.log2(max(1, df.count()) / most))))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails, hits = [t.encode() for t in batch["tail"].to_pylist()], batch["hit"].to_numpy(zero_copy_only=False).astype(np.uint8)
            slots, packed = [], []
            for repeat in range(1, repeats + 1):
                start = f"{seed}/{repeat}".encode()
                rows = np.frombuffer(b"".join([md5(start + t).digest() for t in tails]), np.uint8).reshape(-1, 16)
                slot = ((rows[:, 0].astype(np.int64) << 8) | rows[:, 1]) >> (16 - bits)
                order = np.argsort(slot, kind="stable")
                rows, slot = np.hstack([rows, hits[:, None]])[order], slot[order]
                ends = [0, *(np.flatnonzero(np.diff(slot)) + 1), len(slot)] if len(slot) else []
                for i, j in zip(ends, ends[1:]):
                    slots.append((repeat << bits) + int(slot[i]))
                    packed.append(rows[i:j].tobytes())
            yield pa.record_batch({"slot": pa.array(slots, pa.int64()), "rows": pa.array(packed, pa.binary())})

    def ranks(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table["rows"].to_pylist()), np.uint8).reshape(-1, 17)
        high, low = (np.ascontiguousarray(rows[:, i : i + 8]).view(">u8").ravel().astype(np.uint64) for i in (0, 8))
        at = np.flatnonzero(rows[np.lexsort((low, high)), 16]) + 1
        return pa.table({"slot": table["slot"].slice(0, 1), "n": pa.array([len(rows)], pa.int64()), "ranks": pa.array([at], pa.list_(pa.int64()))})

    tail = F.concat_ws("/", F.lit(""), key).alias("tail")
    dealt = base.select(tail, (F.coalesce("hit", F.lit(0)) == 1).alias("hit")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slots = written(dealt.mapInArrow(hashed, "slot long, rows binary").groupBy("slot").applyInArrow(ranks, "slot long, n long, ranks array<long>"))
    before = Window.partitionBy("repeat").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = slots.select("slot", "n", F.size("ranks").alias("k"), F.shiftright("slot", bits).alias("repeat"))
    carried = sizes.select("slot", "repeat", "k", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "k")))
    precisions = F.transform("ranks", lambda r, i: (F.col("k_before") + i + 1) / (F.col("n_before") + r))
    part = slots.select("slot", "ranks").join(carried, "slot").select("repeat", "k", F.aggregate(precisions, F.lit(0.0), lambda s, x: s + x).alias("s"))
    ap = part.groupBy("repeat").agg(F.try_divide(F.sum("s"), F.sum("k")).alias("ap"))
    return ap.crossJoin(F.broadcast(observed)).where("observed is not null").groupBy("observed").agg(F.avg("ap").alias("expected"), ((1 + F.count_if(F.col("ap") >= F.col("observed"))) / (F.count("*") + 1)).alias("p"))


def random_mask(key: str, width: int, probability: float, seed: int, epoch: int) -> Column:
    """An array of booleans of a row: each place true with the probability, by seed, epoch, key and place alone."""
    places = F.sequence(F.lit(0), F.lit(width - 1))
    return F.transform(places, lambda g: uniform(seed, F.lit(str(epoch)), key, g.cast("string")) < probability)
