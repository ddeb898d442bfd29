"""Order over whole tables without a task that holds a group: running sums and exact order statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

LIMIT, BINS = 10_000, 1024


def met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys, null equal to null; without keys b must be one row."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    other = b.withColumnsRenamed({k: f"{k}_r" for k in keys})
    return a.join(other, reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys))).drop(*(f"{k}_r" for k in keys))


def running(df: DataFrame, by: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum over the rows before it in its group, and that of the whole group as name_all.

    order must tell the rows of a group apart, else it is open which of two equal ones comes first. Rows
    lie in ranges of (by, order); each range adds up on its own, and one row a group and range carries
    sums over range ends, so a group is spread over as many tasks as it has ranges.
    """
    names = list(sums)
    placed = df.select("*", *(c.alias(f"_v{i}") for i, c in enumerate(sums.values())))
    # a written table, so that the sums and the rows come from the same ranges, whatever is lost meanwhile
    placed = written(placed.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    parts = placed.groupBy("_p", *by).agg(*(F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(names))))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_p", *by, *(F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_c{i}") for i in range(len(names))), *(F.sum(f"_s{i}").over(group).alias(f"{n}_all") for i, n in enumerate(names)))
    inside = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("*", *(F.coalesce(F.sum(f"_v{i}").over(inside), F.lit(0)).alias(f"_i{i}") for i in range(len(names))))
    out = met(placed, carried, ["_p", *by])
    return out.select(*df.columns, *((F.col(f"_c{i}") + F.col(f"_i{i}")).alias(n) for i, n in enumerate(names)), *(f"{n}_all" for n in names))


def scale(v: Column, log: Column) -> Column:
    """A rising function of v: itself, or its logarithm counted from the smallest double on, with its sign."""
    magnitude = F.least(F.ln(F.abs(v)) + 746.0, F.lit(2000.0))
    return F.when(~log, v).when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * magnitude)


def bracketed(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose value lies in a bracket of their group, as _m. A group has a bracket a wanted rank at most."""
    held = brackets.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi", "log")).alias("_b"))
    inside = F.filter("_b", lambda b: (F.col("_v") >= b["lo"]) & (F.col("_v") <= b["hi"]))
    return met(rows, held, keys).withColumn("_m", F.try_element_at(inside, F.lit(1))).where("_m is not null").select(*keys, "_v", "_m.*")


def narrowed(rows: DataFrame, brackets: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """For each wanted rank the histogram bin of its bracket that holds it, as a bracket of its own."""
    inside = bracketed(rows, brackets, keys)
    low, high = scale(F.col("lo"), F.col("log")), scale(F.col("hi"), F.col("log"))
    bin_ = F.when(high > low, F.least(F.floor((scale(F.col("_v"), F.col("log")) - low) / (high - low) * bins), F.lit(bins - 1))).otherwise(0)
    counts = inside.groupBy(*keys, "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    before = Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    wanted = brackets.select(*keys, "lo", "hi", "m", "log", F.explode("wanted").alias("w"))
    found = met(wanted, counts, [*keys, "lo", "hi"]).where((F.col("w.at") >= F.col("_before")) & (F.col("w.at") < F.col("_before") + F.col("_n")))
    # values that crowd in one bin are told apart by the other scale; one too wide for a difference has the logarithm alone
    crowded = F.col("_n") > F.col("m") / 8
    log = F.when(F.abs(F.col("_hi") - F.col("_lo")) == float("inf"), True).otherwise(F.col("log") != crowded)
    return found.groupBy(*keys, F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_n").alias("m"), log.alias("log")).agg(F.collect_list(F.struct((F.col("w.at") - F.col("_before")).alias("at"), F.col("w.id").alias("id"))).alias("wanted"))


def order_statistics(df: DataFrame, value: str, ranks: Callable[[Column], list[Column]], by: list[str] | tuple = (), limit: int = LIMIT, bins: int = BINS) -> DataFrame:
    """by..., n and `at`: the values at the given ranks (from 0) of each group's n sorted values.

    ranks makes the ranks from the column n. Null and NaN are no values; a group without any has a null
    in `at`. Selection by histograms: a bracket that holds a wanted rank is cut into bins, counted, and
    the rank's bin is the next bracket, until it holds one value or at most limit values, which are
    sorted. The counts of a round are bins x brackets rows, and no task holds more than a bracket.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    v = F.col(value).cast("double")
    rows = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), F.when(~F.isnan(v), v).alias("_v"))
    sizes = written(rows.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    rows = rows.where("_v is not null")
    wanted = F.array(*(F.struct(F.greatest(F.least(r.cast("long"), F.col("n") - 1), F.lit(0)).alias("at"), F.lit(i).alias("id")) for i, r in enumerate(ranks(F.col("n")))))
    brackets = sizes.where("n > 0").select(*keys, "lo", "hi", F.col("n").alias("m"), (F.abs(F.col("hi") - F.col("lo")) == float("inf")).alias("log"), wanted.alias("wanted"))
    settled = []
    while True:
        settled.append(brackets.where((F.col("m") <= limit) | (F.col("lo") == F.col("hi"))))
        large = brackets.where((F.col("m") > limit) & (F.col("lo") < F.col("hi")))
        if not large.take(1):
            break
        brackets = written(narrowed(rows, large, keys, bins))
    last = reduce(DataFrame.unionByName, settled)
    single = last.where("lo = hi").select(*keys, F.explode("wanted").alias("w"), F.col("lo").alias("_at"))
    open_ = last.where("lo < hi")
    values = bracketed(rows, open_, keys).groupBy(*keys, "lo", "hi").agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    picked = met(open_.select(*keys, "lo", "hi", F.explode("wanted").alias("w")), values, [*keys, "lo", "hi"]).select(*keys, "w", F.element_at("_s", (F.col("w.at") + 1).cast("int")).alias("_at"))
    each = single.unionByName(picked).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("w.id").alias("id"), "_at"))), lambda s: s["_at"]).alias("at"))
    found = sizes.select(*keys, "n")
    if not keys:
        # one row each; without any value there are no ranks to look up
        return found.crossJoin(F.broadcast(each.select(F.when(F.size("at") > 0, F.col("at")).alias("at"))))
    names = [F.col(k).alias(b) for b, k in zip(by, keys)]
    return met(found.where("n > 0"), each, keys).select(*names, "n", "at").unionByName(found.where("n = 0").select(*names, "n", F.lit(None).cast("array<double>").alias("at")))


def quantiles(df: DataFrame, value: str, probabilities: list[float], by: list[str] | tuple = (), limit: int = LIMIT, bins: int = BINS) -> DataFrame:
    """by..., n and `q`: the exact quantiles of each group in the order of probabilities, linear between neighbours."""
    place = lambda n, p: F.lit(float(p)) * (n - 1)
    at = order_statistics(df, value, lambda n: [f(place(n, p)) for p in probabilities for f in (F.floor, F.ceil)], by, limit, bins)

    def between(i: int, p: float) -> Column:
        low, high, where = F.col("at")[2 * i], F.col("at")[2 * i + 1], place(F.col("n"), p)
        part, gap = where - F.floor(where), high - low
        # equal neighbours give their own value to the last digit; two that lie too far apart for a difference are weighed
        return F.when(part == 0, low).when(F.abs(gap) == float("inf"), (1 - part) * low + part * high).otherwise(low + gap * part)

    q = F.when(F.col("at").isNotNull(), F.array(*(between(i, p) for i, p in enumerate(probabilities))))
    return at.select(*by, "n", q.alias("q"))


def average_ranks(blocks: DataFrame, value: str, by: list[str], size: str) -> DataFrame:
    """blocks(by..., value, size: how many rows share the value) with `rank`, the mean of their ranks from 1 in the group."""
    return running(blocks, by, [value], {"_before": F.col(size)}).withColumn("rank", F.col("_before") + (F.col(size) + 1) / 2.0).drop("_before", "_before_all")
