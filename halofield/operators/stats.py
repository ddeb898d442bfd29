"""Counts, agreement, tests and scores. All return DataFrames; nothing is collected."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.store import written
from .ordered import average_ranks, met, quantiles, running


def composition(df: DataFrame, group: str, label: str) -> DataFrame:
    """count of each label in each group and its share of the group."""
    n = df.groupBy(group, label).agg(F.count("*").alias("count"))
    return n.withColumn("fraction", F.col("count") / F.sum("count").over(Window.partitionBy(group)))


def dominant(df: DataFrame, group: str, label: str) -> DataFrame:
    """The most frequent label of each group (ties: the smallest) and its share."""
    order = Window.partitionBy(group).orderBy(F.desc("count"), label)
    return composition(df, group, label).withColumn("r", F.row_number().over(order)).where("r = 1").select(group, F.col(label).alias("dominant"), F.col("fraction"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index, normalized mutual information (geometric mean) and purity of a by b.

    The index is 1 where both groupings leave nothing to chance; the information is 0 where one of
    them has a single group.
    """
    c = contingency(df, a, b)
    rows, columns = c.groupBy(a).agg(F.sum("n").alias("ra"), F.max("n").alias("top")), c.groupBy(b).agg(F.sum("n").alias("rb"))
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2.0)
    total = c.agg(F.sum("n").cast("double").alias("n"), pairs("n").alias("index"))
    left = rows.agg(pairs("ra").alias("pa"), F.sum("top").cast("double").alias("tops"))
    right = columns.agg(pairs("rb").alias("pb"))
    n = F.broadcast(total.select(F.col("n").alias("all")))
    joint = c.join(rows, a).join(columns, b).crossJoin(n).agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("ra") * F.col("rb")))).alias("mi"))
    entropy = lambda t, k, out: t.crossJoin(n).agg((-F.sum(F.col(k) / F.col("all") * F.ln(F.col(k) / F.col("all")))).alias(out))
    one = total.crossJoin(left).crossJoin(right).crossJoin(joint).crossJoin(entropy(rows, "ra", "ha")).crossJoin(entropy(columns, "rb", "hb"))
    chance = F.col("pa") * F.col("pb") / (F.col("n") * (F.col("n") - 1) / 2.0)
    most = (F.col("pa") + F.col("pb")) / 2
    ari = F.when(F.abs(most - chance) < 1e-12, 1.0).otherwise((F.col("index") - chance) / (most - chance))
    nmi = F.when(F.col("ha") * F.col("hb") > 0, F.col("mi") / F.sqrt(F.col("ha") * F.col("hb"))).otherwise(0.0)
    return one.select(ari.alias("adjusted_rand"), nmi.alias("normalized_mutual_information"), (F.col("tops") / F.col("n")).alias("purity"))


def rank_metrics(ranks: DataFrame, by: list[str], cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Mean reciprocal rank and hits at each cutoff of ranks(by..., rank); rank null: not found."""
    hits = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hits_at_{k}") for k in cutoffs]
    return ranks.groupBy(*by).agg(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), *hits, F.count("*").alias("n"))


def average_precision(scores: DataFrame, by: list[str], score: str, positive: str, tie: list[str]) -> DataFrame:
    """Average precision and the normalized log-rank gain of each group; equal scores in the order of tie."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    ranked = scores.select(*by, F.col(positive).cast("int").alias("hit"), F.row_number().over(order).alias("r"), F.sum(F.col(positive).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("seen"))
    gain = F.sum(F.col("hit") / F.log2(F.col("r") + 1.0))
    out = ranked.groupBy(*by).agg(F.sum("hit").alias("n_positive"), F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("r"))).alias("s"), gain.alias("g"))
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n_positive"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    none = F.col("n_positive") == 0
    return out.select(*by, "n_positive", F.when(none, 0.0).otherwise(F.col("s") / F.col("n_positive")).alias("average_precision"), F.when(none, 0.0).otherwise(F.col("g") / best).alias("log_rank_gain"))


def tie_averaged(scores: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Average precision, MRR and mean rank of the positives, their mean over all orders of equal scores.

    The mean has a closed form for each place of a block of m equal scores with h positives, of which
    `rows` rows with `hits` positives come before: the place holds a positive in h of m orders, and then
    has (j - 1)(h - 1)/(m - 1) more of its own block before it; it holds the first positive of all, if
    hits is 0, with the probability that none of the j - 1 places before does. Groups without a
    positive give zeros.

    Blocks are ranked in ranges, and a block stays one row: its places are gone through inside place_sums.
    """
    block = scores.groupBy(*by, F.col(score).alias("_s")).agg(F.count("*").alias("_m"), F.sum(F.col(positive).cast("int")).alias("_h"))
    block = running(block, by, [F.desc("_s")], {"_rows": F.col("_m"), "_hits": F.col("_h")})
    block = block.withColumn("_sums", block_sums("_m", F.coalesce("_h", F.lit(0).cast("long")), "_rows", "_hits"))
    ranks = F.col("_h") * (F.col("_rows") + (F.col("_m") + 1) / 2.0)
    total = block.groupBy(*by).agg(F.greatest(F.sum("_h"), F.lit(1)).alias("_n"), F.sum(ranks).alias("_ranks"), F.sum("_sums.ap").alias("_ap"), F.sum("_sums.rr").alias("_rr"))
    return total.select(*by, (F.col("_ap") / F.col("_n")).alias("average_precision"), F.col("_rr").alias("mrr"), (F.col("_ranks") / F.col("_n")).alias("mean_rank"))


def place_sums(m: int, h: int, rows: int, hits: int) -> tuple[float, float]:
    """What a block adds to the sum of precisions and to MRR (see tie_averaged), over its places in runs of 65,536."""
    ap, rr, missed = 0.0, 0.0, float(hits == 0)
    for at in range(0, m if h else 0, 1 << 16):
        j = np.arange(at + 1, min(m, at + (1 << 16)) + 1, dtype=float)
        ap += h / m * float(((hits + 1 + (j - 1) * (h - 1) / max(m - 1, 1)) / (rows + j)).sum())
        if missed > 0:
            left = m - j + 1  # places from this one on; none before holds a positive with the probability `before`
            stay = np.cumprod(np.maximum(left - h, 0) / left)
            before = missed * np.concatenate([[1.0], stay[:-1]])
            rr += float((before * h / left / (rows + j)).sum())
            missed *= float(stay[-1])
    return ap, rr


@F.pandas_udf(StructType([StructField("ap", DoubleType()), StructField("rr", DoubleType())]))
def block_sums(m: pd.Series, h: pd.Series, rows: pd.Series, hits: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([place_sums(*map(int, b)) for b in zip(m, h, rows, hits)], columns=["ap", "rr"])


def falling_sum(first: int, step: int, last: int, row: int, column: int, total: int) -> float:
    """Sum of the hypergeometric terms from first on in steps of 1 or -1, in units of the first, until they vanish.

    Terms fall along the way, each by its ratio to the one before; a sum takes some standard deviations of
    terms, however large the table is.
    """
    out, term, at = 1.0, 1.0, first
    while at != last and term > 1e-18 * out:
        k = np.arange(at, at + step * min(4096, abs(last - at)), step, dtype=float)
        up = (row - k) * (column - k) / ((k + 1) * (total - row - column + k + 1)) if step > 0 else k * (total - row - column + k) / ((row - k + 1) * (column - k + 1))
        terms = term * np.cumprod(up)
        out, term, at = out + terms.sum(), float(terms[-1]), at + step * len(k)
    return out


def two_sided_fisher(w: int, x: int, y: int, z: int) -> float:
    """Two-sided p of the table [[w, x], [y, z]]: all tables at most as likely, with a relative slack of 1e-10."""
    row, column, total = w + x, w + y, w + x + y + z
    low, high = max(0, row + column - total), min(row, column)
    g = math.lgamma

    def log(k: int) -> float:
        return g(row + 1) - g(k + 1) - g(row - k + 1) + g(total - row + 1) - g(column - k + 1) - g(total - row - column + k + 1) - (g(total + 1) - g(column + 1) - g(total - column + 1))

    mode = min(max((row + 1) * (column + 1) // (total + 2), low), high)
    limit, p = log(w) + 1e-10, 0.0
    for step, end in ((-1, low), (1, high)):
        # the table nearest the mode on this side that is at most as likely; likelihood falls from the mode on
        near, far = (mode, end) if step < 0 else (min(mode + 1, high + 1), end)
        if (near - far) * step > 0 or log(far) > limit:
            continue
        while near != far:
            middle = near + (far - near) // 2 if step > 0 else near - (near - far) // 2
            if log(middle) <= limit:
                far = middle
            else:
                near = middle + step
        p += math.exp(log(near)) * falling_sum(near, step, end, row, column, total)
    return min(1.0, p)


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """two_sided_fisher of each row."""
    return pd.Series([two_sided_fisher(*map(int, t)) for t in zip(a, b, c, d)], dtype=float)


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], tie: list[str], out: str = "fdr") -> DataFrame:
    """df with the adjusted p within each group."""
    up = Window.partitionBy(*by).orderBy(p, *tie)
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = df.withColumn("_r", F.row_number().over(up)).withColumn("_q", F.col(p) * n / F.col("_r"))
    down = Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.min("_q").over(down), F.lit(1.0))).drop("_r", "_q")


def log_odds(a: Column, b: Column, c: Column, d: Column) -> Column:
    """log2 of the odds ratio with 0.5 added to each count."""
    return F.log2((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))


def tie_blocks(df: DataFrame, value: str, by: list[str], **counts: Column) -> DataFrame:
    """by..., value, n, the given counts and `rank` of each block of equal values; null values have no rank.

    Rows are counted up to blocks before they move, so a value that many share is one row a task, and a
    group's blocks are ranked in ranges.
    """
    blocks = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in counts.items()))
    return average_ranks(blocks, value, by, "n")


def cubed(n: Column) -> Column:
    """n^3 - n in doubles, the share of a block in the correction for ties."""
    x = n.cast("double")
    return x * x * x - x


def rank_sum(df: DataFrame, value: str, inside: str, by: list[str]) -> DataFrame:
    """Mann-Whitney U of the rows with `inside` against the others, with its z (ties corrected) and two-sided p."""
    b = tie_blocks(df, value, by, n1=F.count_if(inside))
    n = b.groupBy(*by).agg(F.sum("n1").cast("double").alias("n1"), F.sum(F.col("n") - F.col("n1")).cast("double").alias("n2"), F.sum(F.col("n1") * F.col("rank")).alias("r1"), F.sum(cubed(F.col("n"))).alias("ties"))
    n = n.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).withColumn("n", F.col("n1") + F.col("n2"))
    variance = F.col("n1") * F.col("n2") / 12 * (F.col("n") + 1 - F.col("ties") / (F.col("n") * (F.col("n") - 1)))
    z = F.when((F.col("n") > 1) & (variance > 0), (F.col("u") - F.col("n1") * F.col("n2") / 2) / F.sqrt(variance)).otherwise(0.0)
    return n.withColumn("z", z).withColumn("p", two_sided("z")).select(*by, "n1", "n2", "u", "z", "p")


def differential(rows: DataFrame, group: str, control, value: str, by: list[str], alpha: float = 0.05, least_change: float = 0.5, ties: bool = False) -> DataFrame:
    """Rank-sum test of each group against the control rows: by..., group, n, n_control, log_fold_change, u, z, p, p_adjusted, significant.

    rows(by..., group, value) holds log1p values, zeros included; by is the gene. Groups share one order
    of (by, value) in which only control rows are counted: U is the sum over a group's rows of the control
    rows below plus half of those level with it, so control rows are never repeated for a group. p is
    adjusted over the genes of a group (Benjamini-Hochberg); with ties the variance is corrected for them.
    """
    is_control = F.col(group).eqNullSafe(F.lit(control))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value, group).agg(F.count("*").alias("n"))
    blocks = counts.groupBy(*by, value).agg(F.coalesce(F.sum(F.when(is_control, F.col("n"))), F.lit(0)).alias("c"), F.array_compact(F.collect_list(F.when(~is_control & F.col(group).isNotNull(), F.struct(group, "n")))).alias("groups"))
    placed = running(blocks, by, [value], {"below": F.col("c"), "control_ties": cubed(F.col("c")), "control_value": F.col("c") * F.col(value)})
    each = placed.select(*by, value, "c", "below", "below_all", "control_ties_all", "control_value_all", F.explode("groups").alias("g")).select("*", "g.*")
    n, c, level = F.col("n"), F.col("c"), cubed(F.col("n") + F.col("c")) - cubed(F.col("c"))
    t = each.groupBy(*by, group).agg(F.sum(n).cast("double").alias("n"), F.max("below_all").cast("double").alias("n_control"), F.sum(n * (F.col("below") + c / 2)).alias("u"), (F.max("control_ties_all") + F.sum(level)).alias("t"), (F.sum(n * F.col(value)) / F.sum(n)).alias("mean"), (F.max("control_value_all") / F.max("below_all")).alias("mean_control"))
    n1, n2 = F.col("n"), F.col("n_control")
    all_ = n1 + n2
    variance = n1 * n2 / 12 * ((all_ + 1) - (F.when(all_ > 1, F.col("t") / (all_ * (all_ - 1))).otherwise(0.0) if ties else F.lit(0.0)))
    t = t.withColumn("z", F.when(variance > 0, (F.col("u") - n1 * n2 / 2) / F.sqrt(variance)).otherwise(0.0)).withColumn("p", two_sided("z"))
    t = t.withColumn("log_fold_change", F.log2((F.expm1("mean") + 1e-9) / (F.expm1("mean_control") + 1e-9)))
    t = benjamini_hochberg(t, "p", [group], by, "p_adjusted")
    significant = (F.col("p_adjusted") < alpha) & (F.abs("log_fold_change") > least_change)
    return t.select(*by, group, "n", "n_control", "log_fold_change", "u", "z", "p", "p_adjusted", significant.alias("significant"))


def level_trends(rows: DataFrame, level: str, levels: tuple, value: str, by: list[str], pad: float = 0.05, least_fraction: float = 0.1, least_mean: float = 0.05) -> DataFrame:
    """The trend of each gene over three ordered levels, with rank-sum tests of the outer ones and of the middle against both.

    by..., trend ('first', 'middle', 'last' or 'none': where the mean is highest in a monotone or peaked
    course), score (log2 of the means), the means and positive fractions of the levels, p_outer and
    p_middle (two-sided, corrected for ties and continuity). A gene that no level expresses enough has no
    trend. Both tests come from one order of (by, value).
    """
    at = [F.count_if(F.col(level) == x) for x in levels]
    known = rows.where(F.col(level).isin(*levels) & F.col(value).isNotNull())
    blocks = known.groupBy(*by, value).agg(*(c.alias(f"n{i}") for i, c in enumerate(at)))
    n0, n1, n2 = (F.col(f"n{i}") for i in range(3))
    placed = running(blocks, by, [value], {"b2": n2, "b02": n0 + n2})
    v, positive = F.col(value), F.col(value) > 0
    t = placed.groupBy(*by).agg(*(F.sum(f"n{i}").cast("double").alias(f"k{i}") for i in range(3)), *((F.sum(F.col(f"n{i}") * v) / F.sum(f"n{i}")).alias(f"mean_{i}") for i in range(3)), *((F.sum(F.when(positive, F.col(f"n{i}")).otherwise(0)) / F.sum(f"n{i}")).alias(f"fraction_{i}") for i in range(3)),
        F.sum(n0 * (F.col("b2") + n2 / 2)).alias("u_outer"), F.sum(n1 * (F.col("b02") + (n0 + n2) / 2)).alias("u_middle"), F.sum(cubed(n0 + n2)).alias("t_outer"), F.sum(cubed(n0 + n1 + n2)).alias("t_middle"))

    def p(u: str, a: Column, b: Column, ties: str) -> Column:
        n = a + b
        variance = a * b / 12 * (n + 1 - F.col(ties) / (n * (n - 1)))
        # the larger of both U less the correction, as the test is two-sided
        return F.least(F.lit(1.0), two_sided(F.when((n > 1) & (variance > 0), (F.abs(F.col(u) - a * b / 2) - 0.5) / F.sqrt(variance)).otherwise(0.0)))

    m = [F.col(f"mean_{i}") for i in range(3)]
    enough = (F.greatest(*(F.col(f"fraction_{i}") for i in range(3))) >= least_fraction) & (F.greatest(*m) >= least_mean)
    trend = F.when(~enough, "none").when((m[0] > m[1]) & (m[1] > m[2]), "first").when((m[0] < m[1]) & (m[1] < m[2]), "last").when((m[1] > m[0]) & (m[1] > m[2]), "middle").otherwise("none")
    ratio = lambda a, b: F.log2((a + pad) / (b + pad))
    score = F.when(F.col("trend") == "first", ratio(m[0], m[2])).when(F.col("trend") == "last", ratio(m[2], m[0])).when(F.col("trend") == "middle", ratio(m[1], F.greatest(m[0], m[2]))).otherwise(0.0)
    t = t.withColumn("trend", trend).withColumn("p_outer", p("u_outer", F.col("k0"), F.col("k2"), "t_outer")).withColumn("p_middle", p("u_middle", F.col("k1"), F.col("k0") + F.col("k2"), "t_middle"))
    return t.select(*by, "trend", score.alias("score"), *(f"mean_{i}" for i in range(3)), *(f"fraction_{i}" for i in range(3)), "p_outer", "p_middle")


@F.pandas_udf(DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))


def kruskal_wallis(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """H over the groups, corrected for ties, and its degrees of freedom."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value, group).agg(F.count("*").alias("k"))
    blocks = counts.groupBy(*by, value).agg(F.sum("k").alias("n"), F.collect_list(F.struct(F.col(group).alias("g"), "k")).alias("groups"))
    ranked = average_ranks(blocks, value, by, "n")
    ties = ranked.groupBy(*by).agg(F.sum(cubed(F.col("n"))).alias("ties"))
    each = ranked.select(*by, "rank", F.inline("groups")).groupBy(*by, "g").agg(F.sum("k").cast("double").alias("k"), F.sum(F.col("k") * F.col("rank")).alias("r"))
    h = met(each.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("k")).alias("s"), F.count("*").alias("groups")), ties, by)
    n = F.col("n")
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return h.select(*by, (raw / (1 - F.col("ties") / (n * n * n - n))).alias("h"), (F.col("groups") - 1).alias("df"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's chi-square of a contingency table and its degrees of freedom; empty cells count."""
    c = contingency(df, a, b)
    rows, columns = c.groupBy(a).agg(F.sum("n").alias("ra")), c.groupBy(b).agg(F.sum("n").alias("rb"))
    seen = c.join(rows, a).join(columns, b).agg(F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("rb")).cast("double")).alias("s"), F.sum("n").alias("n"))
    size = rows.agg(F.count("*").alias("k")).crossJoin(columns.agg(F.count("*").alias("l")))
    return seen.crossJoin(size).select((F.col("n") * (F.col("s") - 1)).alias("chi2"), ((F.col("k") - 1) * (F.col("l") - 1)).alias("df"))


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Correlation of the average ranks of a and b in each group, over the rows that have both.

    Equal pairs are counted up first; ranks are looked up for distinct pairs, and the sums weigh them.
    """
    pairs = written(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_w")))
    for v in ("_a", "_b"):
        ranks = average_ranks(pairs.groupBy(*by, v).agg(F.sum("_w").alias("_n")), v, by, "_n").select(*by, v, F.col("rank").alias(f"{v}r"))
        pairs = met(pairs, ranks, [*by, v])
    w, x, y = F.col("_w"), F.col("_ar"), F.col("_br")
    s = pairs.groupBy(*by).agg(F.sum(w).cast("double").alias("n"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.sum(w * x * y).alias("xy"))
    n = F.col("n")
    vx, vy = F.col("xx") - F.col("x") * F.col("x") / n, F.col("yy") - F.col("y") * F.col("y") / n
    return s.select(*by, F.when((vx > 0) & (vy > 0), (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(vx * vy)).alias("spearman"))


def moran(cells: DataFrame, edges: DataFrame, expression: DataFrame, n_cells: int) -> DataFrame:
    """Moran's I of each gene on a directed graph with equal weights; expression holds no zeros."""
    mean = expression.groupBy("gene").agg((F.sum("value") / n_cells).alias("m"), F.sum(F.col("value") * F.col("value")).alias("q"))
    weights = edges.agg(F.count("*").cast("double").alias("w"))
    out = edges.groupBy("receiver").agg(F.count("*").alias("k"))
    into = edges.groupBy("sender").agg(F.count("*").alias("k"))
    xx = edges.join(expression.select(F.col("cell").alias("receiver"), "gene", F.col("value").alias("a")), "receiver").join(expression.select(F.col("cell").alias("sender"), "gene", F.col("value").alias("b")), ["sender", "gene"]).groupBy("gene").agg(F.sum(F.col("a") * F.col("b")).alias("xwx"))
    rx = expression.join(out, F.col("cell") == F.col("receiver")).groupBy("gene").agg(F.sum(F.col("k") * F.col("value")).alias("rx"))
    cx = expression.join(into, F.col("cell") == F.col("sender")).groupBy("gene").agg(F.sum(F.col("k") * F.col("value")).alias("cx"))
    all_ = mean.join(xx, "gene", "left").join(rx, "gene", "left").join(cx, "gene", "left").na.fill(0.0, ["xwx", "rx", "cx"]).crossJoin(F.broadcast(weights))
    spread = F.col("q") - n_cells * F.col("m") * F.col("m")
    top = F.col("xwx") - F.col("m") * (F.col("rx") + F.col("cx")) + F.col("m") * F.col("m") * F.col("w")
    return all_.select("gene", F.when(spread > 0, n_cells / F.col("w") * top / spread).otherwise(0.0).alias("moran"))


def neighbour_entropy(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Entropy of the labels among each receiver's senders."""
    n = edges.join(labels.select(F.col("cell").alias("sender"), "label"), "sender").groupBy("receiver", "label").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("receiver"))
    return n.withColumn("p", p).groupBy("receiver").agg((-F.sum(F.col("p") * F.ln(F.col("p") + 1e-12))).alias("entropy"))


def gene_metrics(expression: DataFrame, n_cells: int) -> DataFrame:
    """Detection, mean, variance (n) and mean of the positive values of each gene; zeros may be left out."""
    positive = F.when(F.col("value") > 0, F.col("value"))
    g = expression.groupBy("gene").agg(F.count(positive).alias("k"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.avg(positive).alias("mean_positive"))
    mean = F.col("s") / n_cells
    return g.select("gene", (F.col("k") / n_cells).alias("detection"), mean.alias("mean"), (F.col("q") / n_cells - mean * mean).alias("variance"), "mean_positive")


def specificity(expression: DataFrame, labels: DataFrame) -> DataFrame:
    """tau of each gene over the label means, and the label with the largest mean (ties: smallest)."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    mean = expression.join(labels, "cell").groupBy("gene", "label").agg(F.sum("value").alias("s")).join(sizes, "label").withColumn("mean", F.col("s") / F.col("size"))
    k = sizes.agg(F.count("*").alias("k"))
    top = mean.groupBy("gene").agg(F.max("mean").alias("top"), F.sum("mean").alias("total"), F.min(F.struct((-F.col("mean")).alias("m"), "label")).alias("x")).crossJoin(F.broadcast(k))
    tau = F.when((F.col("top") > 0) & (F.col("k") > 1), (F.col("k") - F.col("total") / F.col("top")) / (F.col("k") - 1)).otherwise(0.0)
    return top.select("gene", tau.alias("tau"), F.col("x.label").alias("best_label"))


def marker_scores(expression: DataFrame, labels: DataFrame, pad: float = 0.05) -> DataFrame:
    """log2((mean inside + pad) / (mean outside + pad)) * sqrt(detection inside) for each gene and label."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    n = sizes.agg(F.sum("size").alias("n"))
    g = expression.join(labels, "cell").groupBy("gene", "label").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("k"))
    g = g.join(sizes, "label").crossJoin(F.broadcast(n)).withColumn("t", F.sum("s").over(Window.partitionBy("gene")))
    inside, outside = F.col("s") / F.col("size"), (F.col("t") - F.col("s")) / (F.col("n") - F.col("size"))
    return g.select("gene", "label", (F.log2((inside + pad) / (outside + pad)) * F.sqrt(F.col("k") / F.col("size"))).alias("score"))


def variable_genes(metrics: DataFrame, bins: int = 20) -> DataFrame:
    """log dispersion of each gene, standardized among the genes of similar mean (equal-count bins by quantiles)."""
    base = metrics.where("mean > 0 and variance > 0").withColumn("dispersion", F.ln(F.col("variance") / F.col("mean")))
    edges = quantiles(base, "mean", [i / bins for i in range(1, bins)]).select(F.col("q").alias("edges"))
    binned = base.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("mean"))))
    w = Window.partitionBy("bin")
    sd = F.stddev_samp("dispersion").over(w)
    return binned.select("gene", "bin", "dispersion", F.coalesce(F.when(sd > 0, (F.col("dispersion") - F.avg("dispersion").over(w)) / sd), F.lit(0.0)).alias("normalized"))


def module_scores(z: DataFrame, markers: DataFrame, margin: float = 0.25) -> DataFrame:
    """The label of each cluster by its markers(gene, label, role): core + aux / 2 - anti / 2, best over second by a margin."""
    means = z.join(markers, "gene").groupBy("cluster", "label").agg(*(F.coalesce(F.avg(F.when(F.col("role") == r, F.col("z"))), F.lit(0.0)).alias(r) for r in ("core", "aux", "anti")))
    score = means.withColumn("score", F.col("core") + 0.5 * F.col("aux") - 0.5 * F.col("anti"))
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), "label")
    top = score.withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).where("r = 1")
    clear = F.col("second").isNull() | (F.col("score") - F.col("second") >= margin)
    return top.select("cluster", F.when(clear, F.col("label")).otherwise("unassigned").alias("label"), "score", (F.col("score") - F.col("second")).alias("margin"))


def fold_regression(rows: DataFrame, by: list[str], folds: int, least_train: int = 20, least_test: int = 5) -> DataFrame:
    """Held-out fit of y on x from sums of the folds: MSE reduction, mean effect and sign agreement.

    rows(by..., fold, x, y). The training sums of a fold are the totals less its own, so rows are read
    once. Folds with too few rows are passed over.
    """
    s = rows.groupBy(*by, "fold").agg(F.count("*").cast("double").alias("n"), *(F.sum(e).alias(k) for k, e in (("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") * F.col("x")), ("xy", F.col("x") * F.col("y")), ("yy", F.col("y") * F.col("y")))))
    w = Window.partitionBy(*by)
    t = s.select("*", *((F.sum(k).over(w) - F.col(k)).alias(f"t{k}") for k in ("n", "x", "y", "xx", "xy")))
    t = t.where((F.col("tn") >= least_train) & (F.col("n") >= least_test))
    vx = F.col("txx") / F.col("tn") - (F.col("tx") / F.col("tn")) ** 2
    slope = F.when(vx > 1e-12, (F.col("txy") / F.col("tn") - F.col("tx") * F.col("ty") / F.col("tn") ** 2) / vx).otherwise(0.0)
    t = t.withColumn("b", slope).withColumn("m", F.col("ty") / F.col("tn")).withColumn("a", F.col("m") - F.col("b") * F.col("tx") / F.col("tn"))
    base = F.col("yy") - 2 * F.col("m") * F.col("y") + F.col("n") * F.col("m") ** 2
    fit = F.col("yy") + F.col("n") * F.col("a") ** 2 + F.col("b") ** 2 * F.col("xx") - 2 * F.col("a") * F.col("y") - 2 * F.col("b") * F.col("xy") + 2 * F.col("a") * F.col("b") * F.col("x")
    g = t.withColumn("base", base).withColumn("fit", fit).groupBy(*by).agg(F.count("*").alias("folds"), (1 - F.sum("fit") / F.sum("base")).alias("mse_reduction"), F.avg("b").alias("effect"), F.abs(F.avg(F.signum("b"))).alias("sign_agreement"))
    return g


def dose_response(df: DataFrame, dose: str, response: str, bins: int) -> DataFrame:
    """Mean, positive share and 1.96 standard errors of the response in quantile bins of the dose."""
    edges = quantiles(df, dose, [i / bins for i in range(1, bins)]).select(F.col("q").alias("edges"))
    binned = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(dose))))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(response).alias("mean"), F.avg(F.when(F.col(response) > 0, 1.0).otherwise(0.0)).alias("positive"), (1.96 * F.stddev_samp(response) / F.sqrt(F.count("*"))).alias("error"))


def clipped(df: DataFrame, value: str, quantile: float, by: list[str]) -> DataFrame:
    """df with the value cut off at its quantile within each group."""
    cut = quantiles(df, value, [quantile], by).select(*by, F.col("q")[0].alias("_cut"))
    return met(df, cut, by).withColumn(value, F.least(value, "_cut")).drop("_cut")


def winsorized_score(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """df with z of the value cut off at both quantiles (sample SD; 0 where it doesn't vary)."""
    q = quantiles(df, value, [low, high]).select(F.col("q").alias("_q"))
    cut = df.crossJoin(F.broadcast(q)).withColumn("_v", F.least(F.greatest(F.col(value), F.col("_q")[0]), F.col("_q")[1]))
    scale = cut.agg(F.avg("_v").alias("_m"), F.stddev_samp("_v").alias("_s"))
    return cut.crossJoin(F.broadcast(scale)).withColumn("z", F.when(F.col("_s") > 0, (F.col("_v") - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_q", "_v", "_m", "_s")
