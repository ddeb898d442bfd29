"""How well an analysis finds planted relations: groups, targets, sources, and what each part of the model adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import effects, panel, stats
from ..operators.effects import SparseEffects
from ..sources.store import written


def mapped_effects(effects: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Effects with the inferred groups renamed to the true ones that most of their cells have, and the agreement.

    groups(cell, inferred, true). Of several inferred groups with one true group the larger score counts.
    """
    to = panel.majority_mapping(stats.contingency(groups, "inferred", "true"), "inferred", "true").select(F.col("inferred").alias("receiver_group"), "mapped")
    e = effects.join(to, "receiver_group").groupBy(F.col("mapped").alias("receiver_group"), "source", "target").agg(F.max("score").alias("score"))
    return e, stats.agreement(groups, "inferred", "true")


def truth_ranks(effects: DataFrame, truth: DataFrame) -> DataFrame:
    """For each planted relation its source's rank within target and group, its target's within the group
    (by its best source), and its rank among all relations of the group; null where the effects lack it."""
    best = effects.groupBy("receiver_group", "target").agg(F.max("score").alias("best"))
    targets = best.withColumn("target_rank", F.rank().over(Window.partitionBy("receiver_group").orderBy(F.desc("best"))))
    e = effects.withColumn("source_rank", F.rank().over(Window.partitionBy("receiver_group", "target").orderBy(F.desc("score"))))
    e = e.withColumn("joint_rank", F.rank().over(Window.partitionBy("receiver_group").orderBy(F.desc("score"))))
    return truth.join(e, ["receiver_group", "source", "target"], "left").join(targets.drop("best"), ["receiver_group", "target"], "left")


def recovery(effects: DataFrame, truth: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row of metrics over truth_ranks: of sources, of targets, and both at once."""
    ranks = truth_ranks(effects, truth).withColumn("all", F.lit(1))
    out = None
    for kind in ("source_rank", "target_rank", "joint_rank"):
        m = stats.rank_metrics(ranks.select("all", F.col(kind).alias("rank")), ["all"], cutoffs)
        m = m.select("all", *(F.col(c).alias(f"{kind[:-5]}_{c}") for c in ("mrr", *(f"hits_at_{k}" for k in cutoffs))))
        out = m if out is None else out.join(m, "all")
    return out.drop("all")


def component_errors(predictions: dict[str, DataFrame], observed: DataFrame) -> DataFrame:
    """(method, mse, improvement over the first): errors of several predictions(cell, target, predicted)."""
    out = None
    for i, (name, p) in enumerate(predictions.items()):
        one = observed.join(p, ["cell", "target"]).agg(F.avg((F.col("value") - F.col("predicted")) ** 2).alias("mse")).select(F.lit(i).alias("place"), F.lit(name).alias("method"), "mse")
        out = one if out is None else out.unionByName(one)
    first = out.where("place = 0").select(F.col("mse").alias("base"))
    return out.crossJoin(F.broadcast(first)).select("place", "method", "mse", (1 - F.col("mse") / F.col("base")).alias("improvement"))


#: Name, what is predicted beyond the base, the base itself counted in or not, fields, grouping; None: no fit.
METHODS = (
    ("mean_baseline", "observed", None, "expression_group"),
    ("transformer_only", "residual", None, None),
    ("transformer_whitened_only", "residual", None, None),
    ("physical_only", "observed", "field", "expression_group"),
    ("transformer_physical", "residual", "field", "model_group"),
    ("transformer_whitened_physical", "residual", "field", "whitened_group"),
    ("transformer_permuted_physical", "residual", "permuted", "model_group"),
    ("transformer_whitened_permuted_physical", "residual", "permuted", "whitened_group"),
)


def component_benchmark(rows: DataFrame, folds: int, config: SparseEffects = SparseEffects()) -> DataFrame:
    """(place, method, mse, improvement over the mean baseline) of the eight methods over held-out folds.

    rows(cell, fold, field, permuted, observed, residual: arrays; expression_group, model_group,
    whitened_group: from 0 without gaps). residual is observed less the reconstruction, so its error is that of the sum.
    permuted are the fields of other cells, the control. Each method's fits come from the sums of its folds and groups: one scan a
    method, and fits from as many rows as there are groups and folds.
    """
    rows = written(rows)
    sizes = rows.select(F.size("field").alias("x"), F.size("observed").alias("y")).first()
    if sizes is None:
        raise ValueError("no cells to judge on")
    out = None
    for place, (name, outcome, fields, group) in enumerate(METHODS):
        if group is None:
            one = rows.select(F.aggregate(outcome, F.lit(0.0), lambda s, v: s + v * v).alias("e")).agg((F.count("*") * sizes["y"]).cast("double").alias("n"), F.sum("e").alias("sse"))
        else:
            k = rows.agg(F.max(group).alias("k")).first()["k"] + 1
            p = F.transform(F.sequence(F.lit(0), F.lit(int(k) - 1)), lambda g: F.when(F.col(group) == g, 1.0).otherwise(0.0))
            moments = effects.fold_moments(rows.select(F.col(fields or "field").alias("x"), F.col(outcome).alias("y"), p.alias("p"), "fold"), folds, sizes["x"], sizes["y"])
            one = effects.held_out_error(moments, sizes["x"], sizes["y"], config if fields else None)
        one = one.select(F.lit(place).alias("place"), F.lit(name).alias("method"), (F.col("sse") / F.col("n")).alias("mse"))
        out = one if out is None else out.unionByName(one)
    out = written(out)
    first = out.where("place = 0").select(F.col("mse").alias("base"))
    return out.crossJoin(F.broadcast(first)).select("place", "method", "mse", (1 - F.col("mse") / F.col("base")).alias("improvement"))
