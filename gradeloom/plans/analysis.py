"""Published tables: lever matrix, frontier, category breakdown, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom import constants as K
from gradeloom.functions import text as T
from gradeloom.operators import cells as C, effects, frontier as P
from gradeloom.session import checkpointed

RATES = ["pass_rate_all", "pass_rate_applicable"]


def model_cells(cells_df: DataFrame) -> DataFrame:
    return C.with_rates(C.roll_up(cells_df, ["model", "lever"]))


def category_cells(cells_df: DataFrame) -> DataFrame:
    return C.with_rates(C.roll_up(cells_df, ["task_category", "lever"]))


def lever_matrix(results: DataFrame) -> DataFrame:
    """(model, lever) cells against each model's baseline."""
    df = C.vs_baseline(C.with_rates(C.cells(results, ["model", "lever"])), ["model"])
    return df.select("model", "lever", "n_rows", "mean_score", "mean_cost", *RATES, "delta_score", "cost_ratio",
                     "delta_pass_rate_all", "delta_pass_rate_applicable")


def category_breakdown(results: DataFrame) -> DataFrame:
    """(category, lever) cells against the category's baseline; NULL rate where no check applies."""
    df = C.vs_baseline(C.with_rates(C.cells(results, ["task_category", "lever"])), ["task_category"])
    return df.select("task_category", "lever", "n_rows", "mean_score", "mean_cost",
                     F.col("pass_rate_applicable_or_null").alias("pass_rate_applicable"), "delta_score")


def cost_quality_frontier(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(model, lever) points, overall or per ``by`` group, with the frontier flag and strongest dominator."""
    cells_df = C.with_rates(C.cells(results, [*(by or []), "model", "lever"]))
    df = P.frontier(cells_df, by)
    return df.select(*(by or []), "model", "lever", "n_rows", "mean_score", "mean_cost", "pareto_optimal",
                     "dominated_by_model", "dominated_by_lever")


def lever_range(matrix: DataFrame) -> DataFrame:
    """Per lever: range over models of cost ratio, cost saving and score delta."""
    return matrix.groupBy("lever").agg(
        F.min("cost_ratio").alias("cost_ratio_min"), F.max("cost_ratio").alias("cost_ratio_max"),
        (F.lit(1.0) - F.max("cost_ratio")).alias("saving_min"), (F.lit(1.0) - F.min("cost_ratio")).alias("saving_max"),
        F.min("delta_score").alias("delta_min"), F.max("delta_score").alias("delta_max"))


def _long(df: DataFrame, name: Column, value: str, label: Column | None = None) -> DataFrame:
    return df.select(name.alias("name"), F.col(value).cast("double").alias("value"),
                     (F.lit(None).cast("string") if label is None else label).alias("label"))


def _spread(df: DataFrame, prefix: Column, columns: list[str]) -> DataFrame:
    """One finding per listed column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in columns]))
    return df.select(prefix.alias("p"), pairs.alias("x")).select(
        F.concat_ws("_", "p", "x.k").alias("name"), F.col("x.v").alias("value"), F.lit(None).cast("string").alias("label"))


def findings(results: DataFrame, first: str = K.TEST_MODELS[0], second: str = K.TEST_MODELS[2], cell_table: DataFrame | None = None) -> DataFrame:
    """Long table (name, value, label) of everything a report cites.

    All of it comes from the (category, model, lever) cells and, for the pass-set overlap, from
    one grouping of the rows.  The cells are few and are checkpointed, so that the many parts
    below do not read the rows again; pass a stored ``cell_table`` to skip even that.
    """
    fine = checkpointed(C.cells(results)) if cell_table is None else cell_table
    fine_rates = C.with_rates(fine)
    by_model = model_cells(fine)
    matrix = C.vs_baseline(by_model, ["model"])
    by_category = C.vs_baseline(category_cells(fine), ["task_category"])
    head = P.headline_scalars(by_model)
    cell = lambda m, lv: F.concat_ws("/", m, lv)
    parts = [
        _spread(lever_range(matrix).where("lever <> 'baseline'"), F.col("lever"),
                ["cost_ratio_min", "cost_ratio_max", "saving_min", "saving_max", "delta_min", "delta_max"]),
        _long(by_category.where("lever <> 'baseline'"), F.concat_ws("_", F.lit("cat"), "task_category", "lever", F.lit("delta_score")), "delta_score"),
        _long(by_category.where("lever = 'baseline'"), F.concat_ws("_", F.lit("cat"), "task_category", F.lit("baseline_score")), "mean_score"),
        _long(by_category, F.concat_ws("_", F.lit("cat"), "task_category", "lever", F.lit("pass_rate_applicable")), "pass_rate_applicable"),
        _long(fine_rates, F.concat_ws("_", F.lit("cell"), "task_category", T.friendly_model(F.col("model")), "lever", F.lit("score")), "mean_score"),
        _long(P.best_excluding(fine_rates, first), F.concat_ws("_", F.lit("margin"), "task_category"), "margin", cell("rival_model", "rival_lever")),
        _long(C.pair_gap(fine_rates, first, second), F.concat_ws("_", F.lit("gap"), "task_category", "lever"), "gap"),
        _long(C.pair_gap(fine_rates, first, second), F.concat_ws("_", F.lit("widening"), "task_category", "lever"), "widening"),
        _long(head, F.lit("best_score"), "best_quality", cell("best_model", "best_lever")),
        _long(head, F.lit("best_cost"), "best_cost", cell("best_model", "best_lever")),
        _long(head, F.lit("cheap_score_share"), "quality_share", cell("cheap_model", "cheap_lever")),
        _long(head, F.lit("cheap_cost_share"), "cost_share", cell("cheap_model", "cheap_lever")),
        _spread(P.cost_sensitivity(fine_rates), F.concat_ws("_", F.lit("near_best"), "task_category"),
                ["n_near_best", "cost_ratio", "min_cost", "max_cost"]),
        _spread(C.pass_set_diff(results), F.concat_ws("_", F.lit("passes"), T.friendly_model(F.col("model"))),
                ["pass_a", "pass_b", "both"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lever_effects(results: DataFrame) -> DataFrame:
    """Range and exact median of every lever / baseline ratio."""
    return effects.ratio_summary(results)
