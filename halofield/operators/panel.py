"""Gene panels and label matching: greedy choices over tables of genes of any length.

Spark cuts each list to what a choice can ever use: every gene that a list gives up is in the panel
afterwards, so no list is read beyond as many distinct genes as the budget. The choice itself goes one
gene after the other over budget x lists rows. The table of counts of a matching has at most MOST
rows; a longer one is an error, not a cut.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .ranking import top

MOST = 100_000


def read_bounded(df: DataFrame, order: list) -> list:
    rows = df.orderBy(*order).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rows")
    return rows


def best_genes(df: DataFrame, by: list[str], most: int) -> list:
    """(by..., gene, score): of each list the `most` best distinct genes, best first."""
    order = [F.desc("score"), F.col("gene")]
    best = df.groupBy(*by, "gene").agg(F.max("score").alias("score"))
    if by:
        return best.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= most).drop("_r").orderBy(*order).collect()
    return best.orderBy(*order).limit(most).collect()


def greedy_panel(spark: SparkSession, interactions: DataFrame, markers: DataFrame, spatial: DataFrame, variable: DataFrame, budget: int) -> DataFrame:
    """(gene, position, reason): complete interactions first, then markers in turn, then spatial, then variable genes.

    interactions(interaction, genes array, score) enter whole or not at all; markers(label, gene, score)
    give each label its next best gene in turn; spatial and variable are (gene, score).
    """
    chosen: dict[str, str] = {}

    def add(genes: list[str], reason: str) -> None:
        new = [g for g in dict.fromkeys(genes) if g not in chosen]
        if len(chosen) + len(new) <= budget:
            chosen.update(dict.fromkeys(new, reason))

    # Each round reads the first interactions that bring a gene and still fit. What doesn't fit never will
    # again, and the first of a round always enters, so there are at most `budget` rounds.
    kind = interactions.schema["genes"].dataType
    while len(chosen) < budget:
        new = F.size(F.array_except("genes", F.array(*map(F.lit, chosen)).cast(kind)))
        some = interactions.where((new > 0) & (new <= budget - len(chosen))).orderBy(F.desc("score"), "interaction").limit(budget).collect()
        for r in some:
            add(list(r["genes"]), "interaction")
        if len(some) < budget:
            break
    lists: dict[str, list[str]] = {}
    for r in best_genes(markers, ["label"], budget):
        lists.setdefault(r["label"], []).append(r["gene"])
    while any(lists.values()) and len(chosen) < budget:
        for label in sorted(lists):
            while lists[label] and lists[label][0] in chosen:
                lists[label].pop(0)
            if lists[label]:
                add([lists[label].pop(0)], "marker")
    for table, reason in ((spatial, "spatial"), (variable, "variable")):
        for r in best_genes(table, [], budget):
            add([r["gene"]], reason)
    return spark.createDataFrame([(g, i, why) for i, (g, why) in enumerate(chosen.items())], "gene string, position int, reason string")


def quota_panel(spark: SparkSession, genes: DataFrame, quotas: dict[str, int], budget: int) -> DataFrame:
    """(gene, role, position): the best of each role up to its quota in the order given, then the best of the rest.

    genes(gene, role, score, eligible); a gene enters once.
    """
    able = genes.where("eligible")
    rows = best_genes(able.where(F.col("role").isin(*quotas)), ["role"], budget)
    chosen: dict[str, str] = {}
    for role, n in quotas.items():
        for r in [r for r in rows if r["role"] == role and r["gene"] not in chosen][:n]:
            if len(chosen) < budget:
                chosen[r["gene"]] = role
    # the role of a gene is that of its best row
    own = able.groupBy("gene", "score").agg(F.min("role").alias("role")).groupBy("gene").agg(F.max(F.struct("score", "role")).alias("best"))
    for r in own.select("gene", "best.*").orderBy(F.desc("score"), "gene").limit(budget).collect():
        if r["gene"] not in chosen and len(chosen) < budget:
            chosen[r["gene"]] = r["role"]
    return spark.createDataFrame([(g, role, i) for i, (g, role) in enumerate(chosen.items())], "gene string, role string, position int")


def dense_grid(scores: DataFrame, size: int = 5, starts: int = 5, steps: int = 12) -> DataFrame:
    """For each cluster the sources and targets of a dense part of its score table(cluster, source, target, score).

    Alternating choice: the best `size` targets for the sources, then the best sources for those
    targets, from the `starts` sources with the largest sums; the start with the largest sum wins (of equal
    ones the first), and equal sums go by name. A pair without a score counts as 0. All clusters and starts take a step together, as a join
    with the few chosen names and a top-k, until no choice changes or steps are done.
    """
    table = written(scores.groupBy("cluster", "source", "target").agg(F.max("score").alias("score")))
    begun = top(table.groupBy("cluster", "source").agg(F.sum("score").alias("sum")), ["cluster"], "sum", ["source"], starts)
    rows = written(begun.select("cluster", F.col("rank").alias("start"), "source"))
    names = {side: written(table.select("cluster", side).distinct()) for side in ("source", "target")}
    runs = rows.select("cluster", "start").distinct()

    def chosen(given: DataFrame, of: str, to: str) -> DataFrame:
        sums = given.join(table, ["cluster", of]).groupBy("cluster", "start", to).agg(F.sum("score").alias("sum"))
        zeros = runs.join(names[to], "cluster").join(sums, ["cluster", "start", to], "left_anti").withColumn("sum", F.lit(0.0))
        best = top(sums.unionByName(zeros), ["cluster", "start"], "sum", [to], size)
        return written(best.select("cluster", "start", to))

    columns = rows
    for _ in range(steps):
        columns = chosen(rows, "source", "target")
        new = chosen(columns, "target", "source")
        changed = new.join(rows, ["cluster", "start", "source"], "left_anti").take(1) or rows.join(new, ["cluster", "start", "source"], "left_anti").take(1)
        rows = new
        if not changed:
            break
    grid = rows.join(columns, ["cluster", "start"]).join(table, ["cluster", "source", "target"], "left").na.fill(0.0, ["score"])
    best = grid.groupBy("cluster", "start").agg(F.sum("score").alias("total")).groupBy("cluster").agg(F.max(F.struct("total", (-F.col("start")).alias("s"))).alias("b"))
    return grid.join(best.select("cluster", (-F.col("b.s")).alias("start")), ["cluster", "start"], "left_semi").select("cluster", "source", "target", "score")


def majority_mapping(counts: DataFrame, inferred: str, true: str) -> DataFrame:
    """The true group that most of each inferred group belong to; of equal ones the last."""
    from .ranking import first_of

    return first_of(counts, [inferred], [F.desc("n"), F.desc(true)]).select(inferred, F.col(true).alias("mapped"), "n")


def optimal_mapping(spark: SparkSession, counts: DataFrame, inferred: str, true: str) -> DataFrame:
    """One-to-one mapping of groups with the largest total count, from the table of counts (groups x groups)."""
    rows = read_bounded(counts, [inferred, true])
    a, b = sorted({r[inferred] for r in rows}), sorted({r[true] for r in rows})
    table = np.zeros((max(len(a), len(b)),) * 2)
    for r in rows:
        table[a.index(r[inferred]), b.index(r[true])] = r["n"]
    to = assignment(-table)
    return spark.createDataFrame([(x, b[to[i]], int(table[i, to[i]])) for i, x in enumerate(a) if to[i] < len(b)], f"{inferred} {counts.schema[inferred].dataType.simpleString()}, mapped {counts.schema[true].dataType.simpleString()}, n long")


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row in a square assignment of least cost, of equal ones the first in lexical order.

    Exact, O(n^3) by shortest augmenting paths; then the first order among the edges that cost nothing beyond the duals.
    """
    n = len(cost)
    if n <= 6:
        return list(min(permutations(range(n)), key=lambda p: sum(cost[i, j] for i, j in enumerate(p))))
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, n)
    for row in range(n):
        match[n], column = row, n
        least, came, done = np.full(n + 1, np.inf), np.full(n + 1, n), np.zeros(n + 1, bool)
        while True:
            done[column] = True
            gap = cost[match[column]] - u[match[column]] - v[:n]
            better = ~done[:n] & (gap < least[:n])
            least[:n][better], came[:n][better] = gap[better], column
            step = np.where(done[:n], np.inf, least[:n])
            to = int(step.argmin())
            u[match[done]] += step[to]
            v[done] -= step[to]
            least[~done] -= step[to]
            column = to
            if match[column] == n:
                break
        while column != n:
            match[column] = match[came[column]]
            column = came[column]
    out = [0] * n
    for j in range(n):
        out[match[j]] = j
    return first_in_order(np.abs(cost - u[:n, None] - v[None, :n]) <= 1e-9 * max(1.0, float(np.abs(cost).max())), out)


def first_in_order(tight: np.ndarray, out: list[int]) -> list[int]:
    """The lexically first perfect matching of a graph, from one of them: each row in turn takes its least
    column that leaves the later rows a matching."""
    n = len(out)
    owner = [0] * n
    for i, j in enumerate(out):
        owner[j] = i

    def moved(row: int, free: int, above: int, seen: set[int]) -> bool:
        """Give row another column, the rows up to above keeping theirs, so that free is taken."""
        for j in np.flatnonzero(tight[row]).tolist():
            if j in seen or owner[j] <= above and j != free:
                continue
            seen.add(j)
            if j == free or moved(owner[j], free, above, seen):
                owner[j], out[row] = row, j
                return True
        return False

    for i in range(n):
        for j in np.flatnonzero(tight[i]).tolist():
            if j == out[i]:
                break
            if owner[j] < i:
                continue
            free, other = out[i], owner[j]
            if moved(other, free, i, {j}):
                owner[j], out[i] = i, j
                break
    return out
