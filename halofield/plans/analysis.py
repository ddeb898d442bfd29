"""The analyses as a whole, from tables to tables. Each takes long or wide tables keyed by cell and gene."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import ReactionDiffusion
from ..functions.scalars import fold_id
from ..operators import edges as edge_ops
from ..operators import effects, fields, groups, many_models, matrix, spatial
from ..operators.effects import SparseEffects
from ..sources.store import written


@dataclass(frozen=True)
class Analysis:
    """Settings of a source-target analysis. max_neighbors 9999 means no limit; fits take all cells."""

    length_scale: float = 0.05
    radius: float = 0.15
    min_distance: float = 0.002
    dims: int = 2
    max_neighbors: int = 9999
    receiver_group_count: int = 5
    mask_mode: str = "none"
    mask_threshold: float = 0.0
    per_target: int = 10
    seed: int = 168
    effect: SparseEffects = field(default_factory=SparseEffects)

    def __post_init__(self) -> None:
        if self.mask_mode not in ("none", "hard_expression"):
            raise ValueError(f"unknown mask mode {self.mask_mode}")
        if self.receiver_group_count < 1 or self.radius <= 0:
            raise ValueError("the count of groups and the radius must be positive")

    @property
    def kernel(self) -> ReactionDiffusion:
        return ReactionDiffusion.of_length(self.length_scale, min_distance=self.min_distance, dims=self.dims)


#: Names of settings in older configurations.
ALIASES = {"context_count": "receiver_group_count", "neighbors": "max_neighbors"}


def weighed_edges(cells: DataFrame, a: Analysis, senders: DataFrame | None = None) -> DataFrame:
    senders = cells if senders is None else senders
    e = spatial.radius_join(cells, senders, a.radius, a.dims) if a.max_neighbors == 9999 else spatial.knn_join(cells, senders, a.max_neighbors, a.dims, radius=a.radius)
    return fields.weigh(e, a.kernel)


def plain_fields(cells: DataFrame, expression: DataFrame, a: Analysis, senders: DataFrame | None = None) -> DataFrame:
    """(cell, gene, field) of the cells that something reaches. Without a limit of neighbours no edge becomes a row."""
    if a.max_neighbors == 9999:
        return fields.sent_field(cells, expression, lambda d, k=a.kernel: fields.kernel_values(k, d), a.radius, a.dims, senders=senders)
    return fields.source_field(weighed_edges(cells, a, senders), expression)


def source_fields(cells: DataFrame, expression: DataFrame, a: Analysis) -> DataFrame:
    """(cell, gene, field) for every cell and gene of the expression, masked as set; written, as each use would make it anew."""
    f = fields.filled(plain_fields(cells, expression, a), cells, expression.select("gene").distinct())
    return written(fields.masked(f, expression, a.mask_threshold).drop("masked") if a.mask_mode == "hard_expression" else f)


def wide(long: DataFrame, value: str, out: str) -> DataFrame:
    """cell and an array of the values in the order of genes."""
    return long.groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("gene", value))), lambda s: s[value]).alias(out))


def fit_rows(field_: DataFrame, residual: DataFrame, membership: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """Wide rows (cell, x, y, p) of all cells, or of the fit cells; fields and residuals standardized on them."""
    of = lambda df: df if fit is None else df.join(fit.select("cell"), "cell", "left_semi")
    x = of(matrix.standardized(field_, "field", ["gene"], fit=fit))
    y = of(matrix.standardized(residual, "value", ["gene"], fit=fit))
    return wide(x, "z", "x").join(wide(y, "z", "y"), "cell").join(membership.select("cell", "p"), "cell")


def analyse(cells: DataFrame, expression: DataFrame, residual: DataFrame, embedding: DataFrame, a: Analysis = Analysis(), centres: list[list[float]] | None = None) -> dict[str, DataFrame]:
    """receiver_group_assignments, effects, target_scores and source_target_scores.

    cells(cell, x, y[, z]); expression, residual (cell, gene, value); embedding(cell, v array<double>).
    centres, if given, stand for fitted ones.
    """
    if centres is None:
        member, _, _ = groups.receiver_groups(embedding, "v", a.receiver_group_count, seed=a.seed)
    else:
        member = groups.soft_membership(embedding, "v", centres, groups.temperature(embedding, "v", centres))
    member = written(member.select("cell", "p", "receiver_group", "maximum_probability"))
    n = expression.select("gene").distinct().count()
    rows = fit_rows(source_fields(cells, expression, a), residual, member)
    e = written(effects.fit_effects(rows, n, residual.select("gene").distinct().count(), a.effect))
    targets, sources = effects.score_tables(e, a.per_target)
    return {"receiver_group_assignments": member.select("cell", "receiver_group", "maximum_probability"), "effects": e, "target_scores": targets, "source_target_scores": sources}


def long_membership(member: DataFrame) -> DataFrame:
    return member.select("cell", F.posexplode("p").alias("receiver_group", "p"))


def supported_edges(cells: DataFrame, expression: DataFrame, residual: DataFrame, membership: DataFrame, triplets: DataFrame, a: Analysis, fit: DataFrame | None = None) -> Callable[[DataFrame | None], DataFrame]:
    """All supported edges of the triplets, or those of some receivers(receiver_group, source, target, receiver, ...), with their columns.

    Receivers and senders carry what an edge needs, so edges are judged where their ends meet and none moves by itself.
    """
    expression = expression.join(triplets.select(F.col("source").alias("gene")).distinct(), "gene", "left_semi")
    senders = cells.join(expression.where("value > 0").select("cell").distinct(), "cell", "left_semi")
    base = cells if fit is None else fit
    field_ = fields.filled(plain_fields(cells, expression, a, senders), cells, expression.select("gene").distinct())
    scale = matrix.moments(field_.join(base.select("cell"), "cell", "left_semi"), "field", ["gene"]).select(F.col("gene").alias("source"), F.greatest("sd", F.lit(1e-8)).alias("sd"))
    z = matrix.standardized(residual, "value", ["gene"], fit=base).select("cell", "gene", "z")
    got, sent = edge_ops.ends(triplets, expression, membership, z, scale)
    got = written(got)

    def of(some: DataFrame | None = None) -> DataFrame:
        wanted = got if some is None else got.join(some, [*edge_ops.EDGE, "receiver"])
        if a.max_neighbors != 9999:
            e = weighed_edges(cells, a, senders).join(wanted, "receiver").join(sent, ["sender", "source"])
        else:
            place = lambda t, key: t.join(cells.select(F.col("cell").alias(key), *spatial.AXES[: a.dims]), key)
            e = spatial.radius_pairs(place(wanted, "receiver"), place(sent, "sender"), a.radius, a.dims, ("source",))
            # exploded, these are computed once; else every condition on the influence repeats the kernel, in code too long to be compiled
            e = e.withColumn("distance", F.explode(F.array("distance"))).withColumn("weight", F.explode(F.array(a.kernel.column("distance"))))
        return edge_ops.supported(e)

    return of


def cell_edges(cells: DataFrame, expression: DataFrame, residual: DataFrame, membership: DataFrame, triplets: DataFrame, a: Analysis, fit: DataFrame | None = None, fraction: float = 1.0, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Edges of the triplets(receiver_group, source, target, signed_beta) and their summary.

    membership(cell, receiver_group, p) is long. Scales come from the fit cells, or from all.
    """
    edges = supported_edges(cells, expression, residual, membership, triplets, a, fit)
    kept = written(edge_ops.retained(edges(None), fraction, most, edges))
    return kept, edge_ops.summary(kept)


def relation_enrichment(kept: DataFrame, cells: DataFrame, expression: DataFrame, relations: DataFrame, radius: float, tolerance: float = 0.1, seed: int = 168) -> DataFrame:
    """How often the relations support a triplet's edges, against edges of equal length from other senders.

    relations(relation, ligand, receptor) with arrays of genes.
    """
    positive = edge_ops.positive_genes(expression)
    triplet = F.concat_ws("/", *(F.col(c).cast("string") for c in ("receiver_group", "source", "target")))
    e = kept.select(triplet.alias("triplet"), "source", "sender", "receiver", "distance").withColumn("edge", F.concat_ws("/", "triplet", "sender", "receiver"))
    able = expression.where("value > 0").select("cell", F.col("gene").alias("source"))
    back = edge_ops.matched_background(e, cells, able, radius, tolerance, seed)
    of = e.select("edge", "triplet")
    count = lambda pairs: edge_ops.supported_relations(pairs, positive, relations).join(of, "edge").groupBy("triplet", "relation").agg(F.count("*").alias("n"))
    sizes = e.groupBy("triplet").agg(F.count("*").alias("model_edges")).join(back.join(of, "edge").groupBy("triplet").agg(F.count("*").alias("background_edges")), "triplet")
    return edge_ops.enrichment(count(e.select("edge", "sender", "receiver")), count(back), sizes, relations)


def with_folds(cells: DataFrame, folds: int, width: float, dims: int = 2) -> DataFrame:
    """cells with a fold of spatial blocks; where a fold stays empty, all go by the cell's number."""
    by_block = cells.withColumn("fold", fold_id(spatial.bins(cells, width, dims), folds).cast("int"))
    if by_block.agg(F.countDistinct("fold").alias("n")).first()["n"] < folds:
        return cells.withColumn("fold", (F.col("cell") % folds).cast("int"))
    return by_block


def validate(cells: DataFrame, rows: DataFrame, triplets: DataFrame, n_sources: int, n_targets: int, folds: int = 5, width: float = 0.3, config: SparseEffects = SparseEffects()) -> DataFrame:
    """Held-out results of the triplets over spatial folds; rows as from fit_rows."""
    placed = rows.join(with_folds(cells, folds, width).select("cell", "fold"), "cell")
    return effects.held_out_triplets(effects.fold_moments(placed, folds, n_sources, n_targets), triplets, n_sources, n_targets, config)


def count_selection(cells: DataFrame, embedding: DataFrame, field_: DataFrame, residual: DataFrame, counts: list[int], folds: int = 5, width: float = 0.3, a: Analysis = Analysis(), restarts: int = 2, centres: dict[int, list[list[float]]] | None = None) -> DataFrame:
    """The table of candidate counts: groups and effects are fitted without a fold and judged on it.

    field_(cell, gene, z) and residual(cell, gene, z) are standardized. All counts and folds go through each scan
    together (see many_models); centres, if given, stand for the fitted ones of a count.
    """
    placed = with_folds(cells, folds, width).select("cell", "fold")
    rows = wide(field_, "z", "x").join(wide(residual, "z", "y"), "cell").join(embedding.select("cell", "v"), "cell").join(placed, "cell")
    rows = written(rows)
    first = rows.select(F.size("x").alias("nx"), F.size("y").alias("ny")).first()
    if first is None:
        raise ValueError("no cell has a field, a residual and an embedding")
    pairs = [(count, fold) for count in counts for fold in range(folds)]
    if centres is None:
        models = [many_models.Model(*pair, restart) for pair in pairs for restart in range(restarts)]
        best = many_models.best_restarts(rows, models, many_models.fitted_centres(rows, models, seed=a.seed))
    else:
        best = {pair: np.array(centres[pair[0]], float) for pair in pairs}
    return groups.choose_count(many_models.judged(rows, best, many_models.heats(rows, best), first["nx"], first["ny"], a.effect))
