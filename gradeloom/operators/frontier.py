"""Cost/quality frontiers, near-best bands and best-cell picks over aggregated cells.

Cells number categories x models x levers, whatever the size of the fact table.  Dominance is
decided by one ordered window (best quality at or below each cost), not by comparing pairs.
``frontier_points`` does the same for raw rows, whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom import constants as K
from gradeloom.operators.ordered import running_least


def _partition(by: list[str] | None) -> list[Column]:
    return [F.col(c) for c in by] if by else [F.lit(0)]


def frontier(cells_df: DataFrame, by: list[str] | None = None, quality: str = "mean_score", cost: str = "mean_cost") -> DataFrame:
    """Flag the points nothing dominates and name the strongest dominator of the others.

    A point dominates another if it is at least as good on both axes and better on one.  The
    strongest dominator has the highest quality, then the lowest cost, then the first name.
    """
    w = (Window.partitionBy(*_partition(by)).orderBy(F.col(cost))
         .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    best = F.min(F.struct((-F.col(quality)).alias("nq"), F.col(cost).alias("c"), F.col("model").alias("m"),
                          F.col("lever").alias("l"))).over(w)
    df = cells_df.withColumn("_best", best)
    better = -F.col("_best.nq") > F.col(quality)
    cheaper = (-F.col("_best.nq") == F.col(quality)) & (F.col("_best.c") < F.col(cost))
    dominated = better | cheaper
    return df.withColumns({
        "pareto_optimal": ~dominated,
        "dominated_by_model": F.when(dominated, F.col("_best.m")),
        "dominated_by_lever": F.when(dominated, F.col("_best.l")),
        "dominator_quality": F.when(dominated, -F.col("_best.nq")),
        "dominator_cost": F.when(dominated, F.col("_best.c")),
    }).drop("_best")


def frontier_points(points: DataFrame, by: list[str], label: list[str], quality: str = "quality", cost: str = "cost", slices: int | None = None) -> DataFrame:
    """``frontier`` for raw points, with groups of any size: every point, whether nothing dominates it, and its strongest dominator.

    Points are ordered by cost and falling quality.  All that can dominate a point come before it, so the
    best so far (highest quality, lowest cost, first label) decides, by a prefix scan over range slices that no
    group is too large for.  ``dominated_by`` is that point's label, a struct of ``label``, NULL on the frontier.
    Equal points do not dominate each other; points with a NULL or NaN on either axis are left out.
    """
    known = points.where(F.col(quality).isNotNull() & F.col(cost).isNotNull() & ~F.isnan(F.col(quality).cast("double")) & ~F.isnan(F.col(cost).cast("double")))
    best = F.struct((-F.col(quality)).alias("nq"), F.col(cost).alias("c"), F.struct(*label).alias("label"))
    df = running_least(known.withColumn("_nq", -F.col(quality)), by, [cost, "_nq", *label], best, "_best", slices).drop("_nq")
    dominated = (-F.col("_best.nq") > F.col(quality)) | ((-F.col("_best.nq") == F.col(quality)) & (F.col("_best.c") < F.col(cost)))
    return df.withColumns({
        "pareto_optimal": ~dominated, "dominated_by": F.when(dominated, F.col("_best.label")),
        "dominator_quality": F.when(dominated, -F.col("_best.nq")), "dominator_cost": F.when(dominated, F.col("_best.c")),
    }).drop("_best")


def _cell(quality: str, cost: str) -> Column:
    return F.struct("model", "lever", F.col(quality).alias("quality"), F.col(cost).alias("cost"))


def _best_order(quality: str, cost: str) -> Column:
    return F.struct((-F.col(quality)).alias("a"), F.col(cost).alias("b"), "model", "lever")


def _cheap_order(quality: str, cost: str) -> Column:
    return F.struct(F.col(cost).alias("a"), (-F.col(quality)).alias("b"), "model", "lever")


def frontier_listing(cells_df: DataFrame, by: list[str] | None = None, quality: str = "mean_score", cost: str = "mean_cost") -> DataFrame:
    """Frontier points with their quality and cost as a share of the best cell's; NULL where that is 0."""
    best = F.min_by(_cell(quality, cost), _best_order(quality, cost)).over(Window.partitionBy(*_partition(by)))
    df = frontier(cells_df, by, quality, cost).withColumn("_b", best)
    return (df.where("pareto_optimal").withColumns({
        "quality_share": F.try_divide(F.col(quality), F.col("_b.quality")), "cost_share": F.try_divide(F.col(cost), F.col("_b.cost")),
    }).drop("_b", "dominated_by_model", "dominated_by_lever", "dominator_quality", "dominator_cost", "pareto_optimal"))


def near_best(cells_df: DataFrame, frac: float = K.NEAR_BEST_FRACTION, by: list[str] | None = None, quality: str = "mean_score") -> DataFrame:
    """Cells whose quality reaches a fraction of the best in their group."""
    best = F.max(quality).over(Window.partitionBy(*_partition(by)))
    return cells_df.withColumn("best_quality", best).where(F.col(quality) >= F.lit(float(frac)) * F.col("best_quality"))


def cost_sensitivity(cells_df: DataFrame, frac: float = K.NEAR_BEST_FRACTION, by: list[str] = ("task_category",),
                     quality: str = "mean_score", cost: str = "mean_cost") -> DataFrame:
    """Cost range of the near-best cells of each group; the ratio is infinite if the cheapest is free."""
    band = near_best(cells_df, frac, list(by), quality)
    dear = F.struct((-F.col(cost)).alias("a"), (-F.col(quality)).alias("b"), "model", "lever")
    out = band.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_near_best"), F.min(cost).alias("min_cost"), F.max(cost).alias("max_cost"),
        F.min_by(F.struct("model", "lever"), _cheap_order(quality, cost)).alias("_cheap"),
        F.min_by(F.struct("model", "lever"), dear).alias("_dear"))
    ratio = F.when(F.col("min_cost") > 0, F.col("max_cost") / F.col("min_cost")).otherwise(F.lit(float("inf")))
    return out.select(*by, "n_near_best", "min_cost", "max_cost", ratio.alias("cost_ratio"),
                      F.col("_cheap.model").alias("cheapest_model"), F.col("_cheap.lever").alias("cheapest_lever"),
                      F.col("_dear.model").alias("dearest_model"), F.col("_dear.lever").alias("dearest_lever"))


def headline_scalars(cells_df: DataFrame, frac: float = K.NEAR_BEST_FRACTION, quality: str = "mean_score", cost: str = "mean_cost") -> DataFrame:
    """One row: the best cell, the cheapest near-best one, and how they compare (NULL for a share of 0)."""
    near = F.col(quality) >= F.lit(float(frac)) * F.col("_top")
    df = (cells_df.withColumn("_top", F.max(quality).over(Window.partitionBy(F.lit(0))))
          .agg(F.min_by(_cell(quality, cost), _best_order(quality, cost)).alias("best"),
               F.min_by(F.when(near, _cell(quality, cost)), F.when(near, _cheap_order(quality, cost))).alias("cheap")))
    return df.select(
        F.col("best.model").alias("best_model"), F.col("best.lever").alias("best_lever"),
        F.col("best.quality").alias("best_quality"), F.col("best.cost").alias("best_cost"),
        F.col("cheap.model").alias("cheap_model"), F.col("cheap.lever").alias("cheap_lever"),
        F.col("cheap.quality").alias("cheap_quality"), F.col("cheap.cost").alias("cheap_cost"),
        F.try_divide(F.col("cheap.quality"), F.col("best.quality")).alias("quality_share"),
        F.try_divide(F.col("cheap.cost"), F.col("best.cost")).alias("cost_share"),
        F.try_divide(F.col("best.cost"), F.col("cheap.cost")).alias("cost_multiple"),
    )


def extreme_cells(cells_df: DataFrame, by: list[str] | None = None, quality: str = "mean_score", cost: str = "mean_cost") -> DataFrame:
    """Cheapest and highest-quality cell of each group."""
    keys = list(by or [])
    out = cells_df.groupBy(*keys).agg(
        F.min_by(_cell(quality, cost), _cheap_order(quality, cost)).alias("c"),
        F.min_by(_cell(quality, cost), _best_order(quality, cost)).alias("b"))
    return out.select(*keys, *[F.col(f"{s}.{f}").alias(f"{n}_{f}") for s, n in (("c", "cheapest"), ("b", "best"))
                               for f in ("model", "lever", "quality", "cost")])


def best_excluding(cells_df: DataFrame, model: str, lever: str = "baseline", by: list[str] = ("task_category",),
                   quality: str = "mean_score", cost: str = "mean_cost") -> DataFrame:
    """Margin of one cell over the best cell of any other model."""
    own = F.max(F.when((F.col("model") == model) & (F.col("lever") == lever), F.col(quality)))
    rival = F.min_by(F.when(F.col("model") != model, _cell(quality, cost)),
                     F.when(F.col("model") != model, _best_order(quality, cost)))
    out = cells_df.groupBy(*by).agg(own.alias("own_quality"), rival.alias("r"))
    return out.select(*by, "own_quality", F.col("r.model").alias("rival_model"), F.col("r.lever").alias("rival_lever"),
                      F.col("r.quality").alias("rival_quality"), (F.col("own_quality") - F.col("r.quality")).alias("margin"))
