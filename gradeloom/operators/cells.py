"""Cost/quality cells and comparisons between them.

The fact table is aggregated once, to the finest cell; coarser grains are rolled up from the
sums and counts the cells carry, never from averages.  Baselines are carried along by
conditional aggregation over the cells, so no join touches the fact table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom import constants as K
from gradeloom.functions import text as T

CELL_KEYS = ["task_category", "model", "lever"]
_COUNTS = [f"n_{s}" for s in K.STATUSES]
_SUMS = ["n_rows", "sum_score", "sum_cost", *_COUNTS]


def tier2(results: DataFrame, score: str = "canonical_score") -> DataFrame:
    """Rows that carry a quality score."""
    return results.where(F.col(score).isNotNull())


def judgeable(results: DataFrame) -> DataFrame:
    """Responses a judge can read: no call error, compression available."""
    status = F.col("tier_1_status")
    return results.where(F.col("error").isNull() & (status.isNull() | (status != "compression_unavailable")))


def in_scope(results: DataFrame, runs: list[str] | None = None, categories: list[str] | None = None,
             levers: list[str] | None = None) -> DataFrame:
    """Filter on run, category and lever lists; all three reach the scan."""
    for column, values in (("run_id", runs), ("task_category", categories), ("optimisation_lever", levers)):
        if values is not None:
            results = results.where(F.col(column).isin(values))
    return results


def exclude_experimental(results: DataFrame) -> DataFrame:
    """Drop rows whose configuration marks a side experiment."""
    flag = F.get_json_object("optimisation_config", "$.experimental_comparison")
    return results.where(~flag.eqNullSafe(F.lit("true")))


def cells(results: DataFrame, by: list[str] = CELL_KEYS) -> DataFrame:
    """Additive cells: row count, score and cost sums, one count per status."""
    df = tier2(results).withColumnRenamed("optimisation_lever", "lever")
    status = F.col("tier_1_status")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("canonical_score").alias("sum_score"),
        F.sum("cost_usd").alias("sum_cost"),
        *[F.count_if(status == s).alias(f"n_{s}") for s in K.STATUSES],
    )


def roll_up(cells_df: DataFrame, by: list[str]) -> DataFrame:
    """Coarser cells from finer ones."""
    return cells_df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS])


def with_rates(cells_df: DataFrame) -> DataFrame:
    """Means and pass rates of additive cells.

    ``pass_rate_applicable`` counts pass, fail_format, fail_content and truncated and is 0.0
    when none apply; ``pass_rate_applicable_or_null`` is NULL then.
    """
    applicable = reduce(Column.__add__, [F.col(f"n_{s}") for s in K.APPLICABLE_STATUSES])
    share = F.try_divide(F.col("n_pass"), applicable)
    return cells_df.withColumns({
        "mean_score": F.col("sum_score") / F.col("n_rows"),
        "mean_cost": F.col("sum_cost") / F.col("n_rows"),
        "n_applicable": applicable,
        "pass_rate_all": F.coalesce(F.try_divide(F.col("n_pass"), F.col("n_rows")), F.lit(0.0)),
        "pass_rate_applicable": F.coalesce(share, F.lit(0.0)),
        "pass_rate_applicable_or_null": share,
    })


def cell_cube(results: DataFrame) -> DataFrame:
    """The three published grains in one frame, from one pass over the results.

    The grouping sets expand the finest cells, not the rows.
    """
    sums = ", ".join(f"sum({c}) AS {c}" for c in _SUMS)
    fine = cells(results)
    return with_rates(fine.sparkSession.sql(
        f"SELECT task_category, model, lever, grouping_id(task_category, model, lever) AS grain, {sums} FROM {{fine}} "
        "GROUP BY GROUPING SETS ((task_category, model, lever), (task_category, lever), (model, lever))",
        fine=fine,
    ))


def vs_baseline(cells_df: DataFrame, within: list[str], lever: str = "baseline") -> DataFrame:
    """Add each cell's baseline (same ``within`` keys) and the differences to it.

    Cells without a baseline get NULLs; ``missing_baseline`` lists them.
    """
    w = Window.partitionBy(*within)
    at_base = {
        c: F.max(F.when(F.col("lever") == lever, F.col(c))).over(w)
        for c in ("mean_score", "mean_cost", "pass_rate_all", "pass_rate_applicable")
    }
    df = cells_df.withColumns({f"base_{c}": v for c, v in at_base.items()})
    return df.withColumns({
        "delta_score": F.col("mean_score") - F.col("base_mean_score"),
        "cost_ratio": F.when(F.col("base_mean_cost") == 0, F.lit(0.0)).otherwise(F.col("mean_cost") / F.col("base_mean_cost")),
        "delta_pass_rate_all": F.col("pass_rate_all") - F.col("base_pass_rate_all"),
        "delta_pass_rate_applicable": F.col("pass_rate_applicable") - F.col("base_pass_rate_applicable"),
    })


def missing_baseline(cells_df: DataFrame, within: list[str], lever: str = "baseline") -> DataFrame:
    """Groups that have cells but no baseline cell."""
    return (cells_df.groupBy(*within).agg(F.bool_or(F.col("lever") == lever).alias("has_baseline"))
            .where(~F.col("has_baseline")).select(*within))


def screen(df: DataFrame, lever: str, column: str, above: float | None = None, below: float | None = None) -> DataFrame:
    """Cells of one lever whose value lies above or below a limit (both strict)."""
    df = df.where(F.col("lever") == lever)
    if above is not None:
        df = df.where(F.col(column) > F.lit(float(above)))
    if below is not None:
        df = df.where(F.col(column) < F.lit(float(below)))
    return df


def status_wide(results: DataFrame, by: list[str]) -> DataFrame:
    """Count of each status per group, one column per status, zeros filled."""
    df = tier2(results).withColumnRenamed("optimisation_lever", "lever")
    return df.groupBy(*by).agg(*[F.count_if(F.col("tier_1_status") == s).alias(s) for s in K.STATUSES])


def cell_sizes(cells_df: DataFrame) -> DataFrame:
    """How many cells have each row count; one row means the grid is uniform."""
    return cells_df.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_cells"))


def publish(df: DataFrame, scores: list[str] = (), costs: list[str] = ()) -> DataFrame:
    """Round to the published precision: 4 decimals for scores and rates, 6 for costs."""
    return df.withColumns({**{c: T.half_up(F.col(c), 4) for c in scores}, **{c: T.half_up(F.col(c), 6) for c in costs}})


def lever_spread(cells_df: DataFrame) -> DataFrame:
    """Gap between the best and the worst lever of each category."""
    return cells_df.groupBy("task_category").agg(
        F.max("mean_score").alias("best"), F.min("mean_score").alias("worst"),
        (F.max("mean_score") - F.min("mean_score")).alias("spread"),
    ).orderBy(F.desc("spread"), "task_category")


def lever_ranking(cells_df: DataFrame, reference: list[str] = K.GLOBAL_LEVER_ORDER) -> DataFrame:
    """Levers of each category in order of mean score, and whether that differs from the reference order."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("mean_score")).alias("s"),
                                             F.array_position(F.array(*map(F.lit, K.LEVERS)), F.col("lever")).alias("i"),
                                             F.col("lever")))),
        lambda x: x["lever"])
    return (cells_df.groupBy("task_category").agg(ordered.alias("levers"))
            .withColumn("differs", F.col("levers") != F.array(*map(F.lit, reference))))


def pair_gap(cells_df: DataFrame, first: str, second: str) -> DataFrame:
    """Score gap of two models per category and lever, and how much it widened against the baseline."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("mean_score")))
    gaps = (cells_df.groupBy("task_category", "lever")
            .agg((pick(first) - pick(second)).alias("gap")).where(F.col("gap").isNotNull()))
    base = F.max(F.when(F.col("lever") == "baseline", F.col("gap"))).over(Window.partitionBy("task_category"))
    return gaps.withColumn("widening", F.col("gap") - base)


def status_of_other(results: DataFrame, a: str = "baseline", b: str = "batch") -> DataFrame:
    """Per (model, prompt, category): status under two levers, from one grouping of the rows."""
    df = tier2(results).where(F.col("optimisation_lever").isin(a, b))
    pick = lambda lv: F.max(F.when(F.col("optimisation_lever") == lv, F.col("tier_1_status")))
    return df.groupBy("model", "prompt_id", "task_category").agg(pick(a).alias("status_a"), pick(b).alias("status_b"))


def pass_set_diff(results: DataFrame, a: str = "baseline", b: str = "batch") -> DataFrame:
    """Per model: how the sets of passing prompts under two levers overlap."""
    df = tier2(results).where(F.col("optimisation_lever").isin(a, b))
    passed = lambda lv: F.bool_or((F.col("optimisation_lever") == lv) & F.col("tier_1_status").eqNullSafe("pass"))
    s = df.groupBy("model", "prompt_id", "task_category").agg(passed(a).alias("in_a"), passed(b).alias("in_b"))
    both, only_a, only_b = F.col("in_a") & F.col("in_b"), F.col("in_a") & ~F.col("in_b"), F.col("in_b") & ~F.col("in_a")
    out = s.groupBy("model").agg(
        F.count_if("in_a").alias("pass_a"), F.count_if("in_b").alias("pass_b"), F.count_if(both).alias("both"),
        F.count_if(only_a).alias("only_a"), F.count_if(only_b).alias("only_b"))
    return out.withColumn("identical", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def pass_set_samples(results: DataFrame, a: str = "baseline", b: str = "batch", k: int = 3) -> DataFrame:
    """First ``k`` prompts per model and side that pass under one lever only."""
    s = status_of_other(results, a, b)
    in_a, in_b = F.col("status_a").eqNullSafe("pass"), F.col("status_b").eqNullSafe("pass")
    s = s.where(in_a != in_b).withColumn("side", F.when(in_a, F.lit(a)).otherwise(F.lit(b)))
    w = Window.partitionBy("model", "side").orderBy("prompt_id", "task_category")
    s = s.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    other = F.coalesce(F.when(F.col("side") == a, F.col("status_b")).otherwise(F.col("status_a")), F.lit("?"))
    return s.select("model", "side", F.col("pos").cast("long").alias("pos"), "prompt_id", "task_category",
                    other.alias("other_status"))


def lever_ratios(results: DataFrame, lever: str | None = None) -> DataFrame:
    """Row-level lever / baseline ratios of cost, tokens and latency per (run, prompt, model).

    Failed calls have no ratio and are no baseline.  Baselines are reduced to one row per key first; both join sides are then hashed on the
    same key and a hot key is split by the adaptive skew join.  Batch latency is stored as 0
    and yields NULL.
    """
    key = ["run_id", "prompt_id", "model"]
    measures = ["cost_usd", "input_tokens", "output_tokens", "latency_ms"]
    results = results.where(F.col("error").isNull()) if "error" in results.columns else results
    base = (results.where(F.col("optimisation_lever") == "baseline").groupBy(*key)
            .agg(F.max_by(F.struct(*measures), F.struct("run_attempt", "result_id")).alias("base")))
    rows = results.where(F.col("optimisation_lever") != "baseline" if lever is None else F.col("optimisation_lever") == lever)
    df = rows.select(*key, "optimisation_lever", *measures).join(base, key)
    floored = lambda c: F.greatest(F.col(f"base.{c}"), F.lit(1))
    latency = F.when(F.col("optimisation_lever") != "batch", F.col("latency_ms") / floored("latency_ms"))
    return df.select(
        *key, F.col("optimisation_lever").alias("lever"),
        F.when(F.col("base.cost_usd") > 0, F.col("cost_usd") / F.col("base.cost_usd")).alias("cost_mult"),
        (F.col("input_tokens") / floored("input_tokens")).alias("input_mult"),
        (F.col("output_tokens") / floored("output_tokens")).alias("output_mult"),
        latency.alias("latency_mult"),
    )
