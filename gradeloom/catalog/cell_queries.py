"""Cells, baselines, frontiers, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom import constants as K
from gradeloom.catalog import query
from gradeloom.catalog.grid import grid_sql, prompts, results
from gradeloom.functions import text as T
from gradeloom.operators import audits, cells as C, frontier as P
from gradeloom.plans import analysis as A

APPLICABLE = "('pass', 'fail_format', 'fail_content', 'truncated')"


def r9(df: DataFrame, *columns: str) -> DataFrame:
    """Round float aggregates, whose last digits depend on summation order."""
    return df.withColumns({c: F.round(F.col(c), 9) for c in columns})


def rates_sql(by: str, name: str = "cells", source: str = "results") -> str:
    return (f"{name} AS (SELECT {by}, count(*) AS n_rows, avg(canonical_score) AS mean_score, avg(cost_usd) AS mean_cost, "
            "count(*) FILTER (WHERE tier_1_status = 'pass') AS n_pass, "
            f"count(*) FILTER (WHERE tier_1_status IN {APPLICABLE}) AS n_app "
            f"FROM (SELECT *, optimisation_lever AS lever FROM {source}) WHERE canonical_score IS NOT NULL GROUP BY {by})")


RATE_ALL = "CAST(n_pass AS DOUBLE) / n_rows"
RATE_APP = "coalesce(CAST(n_pass AS DOUBLE) / nullif(n_app, 0), 0.0)"


def _base(value: str, within: str) -> str:
    return f"max(CASE WHEN lever = 'baseline' THEN {value} END) OVER (PARTITION BY {within})"


MATRIX_SQL = (
    "matrix AS (SELECT model, lever, n_rows, mean_score, mean_cost, rate_all AS pass_rate_all, rate_app AS pass_rate_applicable, "
    f"mean_score - {_base('mean_score', 'model')} AS delta_score, mean_cost / {_base('mean_cost', 'model')} AS cost_ratio, "
    f"rate_all - {_base('rate_all', 'model')} AS delta_pass_rate_all, rate_app - {_base('rate_app', 'model')} AS delta_pass_rate_applicable "
    f"FROM (SELECT *, {RATE_ALL} AS rate_all, {RATE_APP} AS rate_app FROM cells))"
)
_MATRIX_FLOATS = ["mean_score", "mean_cost", "pass_rate_all", "pass_rate_applicable", "delta_score", "cost_ratio",
                  "delta_pass_rate_all", "delta_pass_rate_applicable"]


def _rounded(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in columns)


@query("lever_matrix", grid_sql(f"SELECT model, lever, n_rows, {_rounded(_MATRIX_FLOATS)} FROM matrix",
                                rates_sql("model, lever"), MATRIX_SQL))
def lever_matrix(spark, sf):
    return r9(A.lever_matrix(results(spark, sf)), *_MATRIX_FLOATS)


@query("published_matrix", grid_sql(
    "SELECT model, lever, CAST(round(CAST(mean_score AS DECIMAL(38,12)), 4) AS DOUBLE) AS mean_score, "
    "CAST(round(CAST(mean_cost AS DECIMAL(38,12)), 6) AS DOUBLE) AS mean_cost FROM cells", rates_sql("model, lever")))
def published_matrix(spark, sf):
    return C.publish(A.lever_matrix(results(spark, sf)).select("model", "lever", "mean_score", "mean_cost"), ["mean_score"], ["mean_cost"])


@query("category_breakdown", grid_sql(
    "SELECT task_category, lever, n_rows, round(mean_score, 9) AS mean_score, round(mean_cost, 9) AS mean_cost, "
    "round(CAST(n_pass AS DOUBLE) / nullif(n_app, 0), 9) AS pass_rate_applicable, "
    f"round(mean_score - {_base('mean_score', 'task_category')}, 9) AS delta_score FROM cells", rates_sql("task_category, lever")))
def category_breakdown(spark, sf):
    return r9(A.category_breakdown(results(spark, sf)), "mean_score", "mean_cost", "pass_rate_applicable", "delta_score")


@query("category_model_lever", grid_sql(
    "SELECT task_category, model, lever, n_rows, round(mean_score, 9) AS mean_score, round(mean_cost, 9) AS mean_cost, "
    f"round({RATE_ALL}, 9) AS pass_rate_all FROM cells", rates_sql("task_category, model, lever")))
def category_model_lever(spark, sf):
    df = C.with_rates(C.cells(results(spark, sf)))
    return r9(df.select("task_category", "model", "lever", "n_rows", "mean_score", "mean_cost", "pass_rate_all"),
              "mean_score", "mean_cost", "pass_rate_all")


@query("cell_cube", grid_sql(
    "SELECT task_category, model, lever, grouping(task_category, model, lever) AS grain, count(*) AS n_rows, "
    "round(avg(canonical_score), 9) AS mean_score, round(avg(cost_usd), 9) AS mean_cost, "
    "count(*) FILTER (WHERE tier_1_status = 'pass') AS n_pass FROM (SELECT *, optimisation_lever AS lever FROM results) "
    "WHERE canonical_score IS NOT NULL "
    "GROUP BY GROUPING SETS ((model, lever), (task_category, lever), (task_category, model, lever))"))
def cell_cube(spark, sf):
    df = C.cell_cube(results(spark, sf)).select("task_category", "model", "lever", F.col("grain").cast("long").alias("grain"),
                                                "n_rows", "mean_score", "mean_cost", "n_pass")
    return r9(df, "mean_score", "mean_cost")


@query("status_distribution", grid_sql(
    "SELECT model, lever, " + ", ".join(f'count(*) FILTER (WHERE tier_1_status = \'{s}\') AS "{s}"' for s in K.STATUSES)
    + " FROM (SELECT *, optimisation_lever AS lever FROM results) WHERE canonical_score IS NOT NULL GROUP BY model, lever"))
def status_distribution(spark, sf):
    return C.status_wide(results(spark, sf), ["model", "lever"])


@query("cell_size_check", grid_sql("SELECT n_rows, count(*) AS n_cells FROM cells GROUP BY n_rows", rates_sql("model, lever")))
def cell_size_check(spark, sf):
    return C.cell_sizes(C.cells(results(spark, sf), ["model", "lever"]))


@query("missing_baseline", grid_sql(
    "SELECT task_category, model FROM (SELECT * FROM results WHERE NOT (optimisation_lever = 'baseline' AND model = 'claude-haiku-4-5' "
    "AND task_category = 'reasoning')) WHERE canonical_score IS NOT NULL GROUP BY task_category, model "
    "HAVING count(*) FILTER (WHERE optimisation_lever = 'baseline') = 0"))
def missing_baseline(spark, sf):
    gone = (F.col("optimisation_lever") == "baseline") & (F.col("model") == "claude-haiku-4-5") & (F.col("task_category") == "reasoning")
    return C.missing_baseline(C.cells(results(spark, sf).where(~gone)), ["task_category", "model"])


DOMINANCE_SQL = (
    "dominance AS (SELECT q.*, p.model AS dm, p.lever AS dl, row_number() OVER (PARTITION BY {part} q.model, q.lever "
    "ORDER BY p.mean_score DESC, p.mean_cost, p.model, p.lever) AS rk FROM cells q LEFT JOIN cells p ON {match} "
    "p.mean_score >= q.mean_score AND p.mean_cost <= q.mean_cost AND (p.mean_score > q.mean_score OR p.mean_cost < q.mean_cost))"
)


@query("frontier", grid_sql(
    "SELECT model, lever, n_rows, round(mean_score, 9) AS mean_score, round(mean_cost, 9) AS mean_cost, dm IS NULL AS pareto_optimal, "
    "dm AS dominated_by_model, dl AS dominated_by_lever FROM dominance WHERE rk = 1",
    rates_sql("model, lever"), DOMINANCE_SQL.format(part="", match="")))
def frontier(spark, sf):
    return r9(A.cost_quality_frontier(results(spark, sf)), "mean_score", "mean_cost")


@query("frontier_points", grid_sql(
    "SELECT task_category, CASE WHEN -b.nq > q OR (-b.nq = q AND b.c < c) THEN b.l END AS dominator, count(*) AS n, round(sum(q), 6) AS sum_quality FROM "
    "(SELECT *, min({'nq': -q, 'c': c, 'l': result_id}) OVER (PARTITION BY task_category ORDER BY c RANGE UNBOUNDED PRECEDING) AS b FROM "
    "(SELECT task_category, result_id, canonical_score AS q, cost_usd AS c FROM results WHERE canonical_score IS NOT NULL AND cost_usd IS NOT NULL)) GROUP BY 1, 2"))
def frontier_points(spark, sf):
    """The frontier of all calls, not of cells: how many calls each frontier call is the strongest dominator of (NULL: the frontier itself)."""
    points = P.frontier_points(results(spark, sf).select("task_category", "result_id", "canonical_score", "cost_usd"), ["task_category"], ["result_id"], "canonical_score", "cost_usd")
    return points.groupBy("task_category", F.col("dominated_by.result_id").alias("dominator")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("canonical_score"), 6).alias("sum_quality"))


@query("frontier_by_category", grid_sql(
    "SELECT task_category, model, lever, n_rows, round(mean_score, 9) AS mean_score, round(mean_cost, 9) AS mean_cost, "
    "dm IS NULL AS pareto_optimal, dm AS dominated_by_model, dl AS dominated_by_lever FROM dominance WHERE rk = 1",
    rates_sql("task_category, model, lever"),
    DOMINANCE_SQL.format(part="q.task_category,", match="p.task_category = q.task_category AND")))
def frontier_by_category(spark, sf):
    return r9(A.cost_quality_frontier(results(spark, sf), ["task_category"]), "mean_score", "mean_cost")


@query("frontier_listing", grid_sql(
    "SELECT task_category, model, lever, round(mean_score / bq, 9) AS quality_share, round(mean_cost / bc, 9) AS cost_share FROM dominance "
    "JOIN (SELECT task_category AS tc, max(mean_score) AS bq, arg_max(mean_cost, mean_score) AS bc FROM cells GROUP BY 1) ON tc = task_category "
    "WHERE rk = 1 AND dm IS NULL", rates_sql("task_category, model, lever"),
    DOMINANCE_SQL.format(part="q.task_category,", match="p.task_category = q.task_category AND")))
def frontier_listing(spark, sf):
    df = P.frontier_listing(C.with_rates(C.cells(results(spark, sf))), ["task_category"])
    return r9(df.select("task_category", "model", "lever", "quality_share", "cost_share"), "quality_share", "cost_share")


_NEAR = ("near AS (SELECT * FROM (SELECT *, max(mean_score) OVER (PARTITION BY task_category) AS best FROM cells) "
         "WHERE mean_score >= CAST(0.9 AS DOUBLE) * best)")


@query("near_best_band", grid_sql("SELECT task_category, model, lever, round(mean_score / best, 9) AS quality_share FROM near",
                                  rates_sql("task_category, model, lever"), _NEAR))
def near_best_band(spark, sf):
    df = P.near_best(C.with_rates(C.cells(results(spark, sf))), by=["task_category"])
    return df.select("task_category", "model", "lever", F.round(F.col("mean_score") / F.col("best_quality"), 9).alias("quality_share"))


@query("cost_sensitivity", grid_sql(
    "SELECT task_category, count(*) AS n_near_best, round(max(mean_cost) / min(mean_cost), 9) AS cost_ratio, "
    "arg_min(model, mean_cost) AS cheapest_model, arg_min(lever, mean_cost) AS cheapest_lever, arg_max(model, mean_cost) AS dearest_model, "
    "arg_max(lever, mean_cost) AS dearest_lever FROM near GROUP BY task_category", rates_sql("task_category, model, lever"), _NEAR))
def cost_sensitivity(spark, sf):
    return r9(P.cost_sensitivity(C.with_rates(C.cells(results(spark, sf)))).drop("min_cost", "max_cost"), "cost_ratio")


_HEAD = ("head AS (SELECT b.model AS best_model, b.lever AS best_lever, b.mean_score AS best_quality, b.mean_cost AS best_cost, "
         "c.model AS cheap_model, c.lever AS cheap_lever, c.mean_score AS cheap_quality, c.mean_cost AS cheap_cost FROM "
         "(SELECT * FROM cells ORDER BY mean_score DESC, mean_cost LIMIT 1) b CROSS JOIN (SELECT * FROM cells WHERE mean_score >= "
         "CAST(0.9 AS DOUBLE) * (SELECT max(mean_score) FROM cells) ORDER BY mean_cost LIMIT 1) c)")


@query("headline_scalars", grid_sql(
    "SELECT best_model, best_lever, round(best_quality, 9) AS best_quality, round(best_cost, 9) AS best_cost, cheap_model, cheap_lever, "
    "round(cheap_quality, 9) AS cheap_quality, round(cheap_cost, 9) AS cheap_cost, round(cheap_quality / best_quality, 9) AS quality_share, "
    "round(cheap_cost / best_cost, 9) AS cost_share, round(best_cost / cheap_cost, 9) AS cost_multiple FROM head",
    rates_sql("model, lever"), _HEAD))
def headline_scalars(spark, sf):
    df = P.headline_scalars(C.with_rates(C.cells(results(spark, sf), ["model", "lever"])))
    return r9(df, "best_quality", "best_cost", "cheap_quality", "cheap_cost", "quality_share", "cost_share", "cost_multiple")


@query("extreme_cells", grid_sql(
    "SELECT task_category, arg_min(model, mean_cost) AS cheapest_model, arg_min(lever, mean_cost) AS cheapest_lever, "
    "arg_max(model, mean_score) AS best_model, arg_max(lever, mean_score) AS best_lever FROM cells GROUP BY task_category",
    rates_sql("task_category, model, lever")))
def extreme_cells(spark, sf):
    df = P.extreme_cells(C.with_rates(C.cells(results(spark, sf))), ["task_category"])
    return df.select("task_category", "cheapest_model", "cheapest_lever", "best_model", "best_lever")


@query("best_excluding", grid_sql(
    "SELECT task_category, arg_max(model, mean_score) FILTER (WHERE model <> 'claude-sonnet-4-6') AS rival_model, "
    "arg_max(lever, mean_score) FILTER (WHERE model <> 'claude-sonnet-4-6') AS rival_lever, "
    "round(max(mean_score) FILTER (WHERE model = 'claude-sonnet-4-6' AND lever = 'baseline') "
    "- max(mean_score) FILTER (WHERE model <> 'claude-sonnet-4-6'), 9) AS margin FROM cells GROUP BY task_category",
    rates_sql("task_category, model, lever")))
def best_excluding(spark, sf):
    df = P.best_excluding(C.with_rates(C.cells(results(spark, sf))), "claude-sonnet-4-6")
    return r9(df.select("task_category", "rival_model", "rival_lever", "margin"), "margin")


@query("lever_ranking", grid_sql(
    "SELECT task_category, string_agg(lever, '>' ORDER BY mean_score DESC) AS ranking, "
    "string_agg(lever, '>' ORDER BY mean_score DESC) <> 'baseline>batch>output_cap>compression' AS differs FROM cells GROUP BY task_category",
    rates_sql("task_category, lever")))
def lever_ranking(spark, sf):
    df = C.lever_ranking(C.with_rates(C.cells(results(spark, sf), ["task_category", "lever"])))
    return df.select("task_category", F.array_join("levers", ">").alias("ranking"), "differs")


@query("lever_spread", grid_sql(
    "SELECT task_category, round(max(mean_score), 9) AS best, round(min(mean_score), 9) AS worst, "
    "round(max(mean_score) - min(mean_score), 9) AS spread FROM cells GROUP BY task_category", rates_sql("task_category, lever")))
def lever_spread(spark, sf):
    return r9(C.lever_spread(C.with_rates(C.cells(results(spark, sf), ["task_category", "lever"]))), "best", "worst", "spread")


@query("threshold_screens", grid_sql(
    f"SELECT task_category, lever, round(d, 9) AS delta_score FROM (SELECT *, mean_score - {_base('mean_score', 'task_category')} AS d FROM cells) "
    "WHERE (lever = 'compression' AND d > CAST(-0.05 AS DOUBLE)) OR (lever = 'batch' AND d < CAST(-0.02 AS DOUBLE))",
    rates_sql("task_category, lever")))
def threshold_screens(spark, sf):
    df = C.vs_baseline(C.with_rates(C.cells(results(spark, sf), ["task_category", "lever"])), ["task_category"])
    safe = C.screen(df, "compression", "delta_score", above=-0.05)
    drop = C.screen(df, "batch", "delta_score", below=-0.02)
    return r9(safe.unionByName(drop).select("task_category", "lever", "delta_score"), "delta_score")


@query("pair_gap", grid_sql(
    "SELECT task_category, lever, round(gap, 9) AS gap, round(gap - max(CASE WHEN lever = 'baseline' THEN gap END) "
    "OVER (PARTITION BY task_category), 9) AS widening FROM (SELECT task_category, lever, max(CASE WHEN model = 'claude-sonnet-4-6' "
    "THEN mean_score END) - max(CASE WHEN model = 'gpt-5.4-2026-03-05' THEN mean_score END) AS gap FROM cells GROUP BY task_category, lever)",
    rates_sql("task_category, model, lever")))
def pair_gap(spark, sf):
    return r9(C.pair_gap(C.with_rates(C.cells(results(spark, sf))), "claude-sonnet-4-6", "gpt-5.4-2026-03-05"), "gap", "widening")


_SIDES = ("sides AS (SELECT model, prompt_id, task_category, max(CASE WHEN optimisation_lever = 'baseline' THEN tier_1_status END) AS sa, "
          "max(CASE WHEN optimisation_lever = 'batch' THEN tier_1_status END) AS sb FROM results WHERE canonical_score IS NOT NULL "
          "AND optimisation_lever IN ('baseline', 'batch') GROUP BY 1, 2, 3), "
          "marked AS (SELECT *, coalesce(sa = 'pass', false) AS in_a, coalesce(sb = 'pass', false) AS in_b FROM sides)")
_DIFF = ("diff AS (SELECT model, count(*) FILTER (WHERE in_a) AS pass_a, count(*) FILTER (WHERE in_b) AS pass_b, "
         "count(*) FILTER (WHERE in_a AND in_b) AS both, count(*) FILTER (WHERE in_a AND NOT in_b) AS only_a, "
         "count(*) FILTER (WHERE in_b AND NOT in_a) AS only_b FROM marked GROUP BY model)")


@query("pass_set_diff", grid_sql("SELECT *, only_a = 0 AND only_b = 0 AS identical FROM diff", _SIDES, _DIFF))
def pass_set_diff(spark, sf):
    return C.pass_set_diff(results(spark, sf))


@query("pass_set_samples", grid_sql(
    "SELECT model, side, pos, prompt_id, task_category, coalesce(other_status, '?') AS other_status FROM (SELECT *, "
    "row_number() OVER (PARTITION BY model, side ORDER BY prompt_id, task_category) AS pos FROM (SELECT model, prompt_id, task_category, "
    "CASE WHEN in_a THEN 'baseline' ELSE 'batch' END AS side, CASE WHEN in_a THEN sb ELSE sa END AS other_status FROM marked "
    "WHERE in_a <> in_b)) WHERE pos <= 3", _SIDES))
def pass_set_samples(spark, sf):
    return C.pass_set_samples(results(spark, sf))


@query("pass_set_operations", grid_sql(
    "SELECT 'both' AS part, count(*) AS n FROM (SELECT model, prompt_id FROM p_a INTERSECT SELECT model, prompt_id FROM p_b) UNION ALL "
    "SELECT 'baseline only', count(*) FROM (SELECT model, prompt_id FROM p_a EXCEPT SELECT model, prompt_id FROM p_b) UNION ALL "
    "SELECT 'batch only', count(*) FROM (SELECT model, prompt_id FROM p_b EXCEPT SELECT model, prompt_id FROM p_a)",
    "p_a AS (SELECT * FROM results WHERE canonical_score IS NOT NULL AND tier_1_status = 'pass' AND optimisation_lever = 'baseline'), "
    "p_b AS (SELECT * FROM results WHERE canonical_score IS NOT NULL AND tier_1_status = 'pass' AND optimisation_lever = 'batch')"))
def pass_set_operations(spark, sf):
    passed = C.tier2(results(spark, sf)).where(F.col("tier_1_status") == "pass")
    a = passed.where(F.col("optimisation_lever") == "baseline").select("model", "prompt_id")
    b = passed.where(F.col("optimisation_lever") == "batch").select("model", "prompt_id")
    n = lambda df, part: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.exceptAll(b), "baseline only")).unionByName(n(b.exceptAll(a), "batch only"))


@query("distinct_dimensions", grid_sql(
    "SELECT 'status' AS kind, tier_1_status AS value FROM results GROUP BY 2 UNION ALL SELECT 'category', task_category FROM results GROUP BY 2"))
def distinct_dimensions(spark, sf):
    df = results(spark, sf)
    pairs = F.array(F.struct(F.lit("status").alias("kind"), F.col("tier_1_status").alias("value")),
                    F.struct(F.lit("category").alias("kind"), F.col("task_category").alias("value")))
    return df.select(F.explode(pairs).alias("p")).select("p.*").distinct()


@query("lever_ranges", grid_sql(
    "SELECT lever, round(min(cost_ratio), 9) AS cost_ratio_min, round(max(cost_ratio), 9) AS cost_ratio_max, round(1 - max(cost_ratio), 9) AS saving_min, "
    "round(1 - min(cost_ratio), 9) AS saving_max, round(min(delta_score), 9) AS delta_min, round(max(delta_score), 9) AS delta_max FROM matrix GROUP BY lever",
    rates_sql("model, lever"), MATRIX_SQL))
def lever_ranges(spark, sf):
    df = A.lever_range(A.lever_matrix(results(spark, sf)))
    return r9(df, "cost_ratio_min", "cost_ratio_max", "saving_min", "saving_max", "delta_min", "delta_max")


_ROUND_NAME = "regexp_replace({m}, '-\\d{{4}}-\\d{{2}}-\\d{{2}}$', '')"
FRIENDLY_SQL = ("CASE {m} WHEN 'claude-sonnet-4-6' THEN 'sonnet' WHEN 'claude-haiku-4-5' THEN 'haiku' ELSE " + _ROUND_NAME + " END")


@query("findings", grid_sql(
    "SELECT name, round(CAST(value AS DOUBLE), 9) AS value, label FROM ("
    + " UNION ALL ".join(
        [f"SELECT lever || '_{n}' AS name, {v} AS value, NULL AS label FROM matrix WHERE lever <> 'baseline' GROUP BY lever" for n, v in (
            ("cost_ratio_min", "min(cost_ratio)"), ("cost_ratio_max", "max(cost_ratio)"), ("saving_min", "1 - max(cost_ratio)"),
            ("saving_max", "1 - min(cost_ratio)"), ("delta_min", "min(delta_score)"), ("delta_max", "max(delta_score)"))]
        + ["SELECT 'cat_' || task_category || '_' || lever || '_delta_score', d, NULL FROM cat WHERE lever <> 'baseline'",
           "SELECT 'cat_' || task_category || '_baseline_score', mean_score, NULL FROM cat WHERE lever = 'baseline'",
           f"SELECT 'cat_' || task_category || '_' || lever || '_pass_rate_applicable', {RATE_APP}, NULL FROM cat",
           "SELECT 'cell_' || task_category || '_' || " + FRIENDLY_SQL.format(m="model") + " || '_' || lever || '_score', mean_score, NULL FROM fine",
           "SELECT 'margin_' || task_category, max(mean_score) FILTER (WHERE model = 'claude-sonnet-4-6' AND lever = 'baseline') - "
           "max(mean_score) FILTER (WHERE model <> 'claude-sonnet-4-6'), arg_max(model || '/' || lever, mean_score) "
           "FILTER (WHERE model <> 'claude-sonnet-4-6') FROM fine GROUP BY task_category",
           "SELECT 'gap_' || task_category || '_' || lever, gap, NULL FROM gaps",
           "SELECT 'widening_' || task_category || '_' || lever, gap - max(CASE WHEN lever = 'baseline' THEN gap END) OVER (PARTITION BY task_category), NULL FROM gaps",
           "SELECT 'best_score', best_quality, best_model || '/' || best_lever FROM head",
           "SELECT 'best_cost', best_cost, best_model || '/' || best_lever FROM head",
           "SELECT 'cheap_score_share', cheap_quality / best_quality, cheap_model || '/' || cheap_lever FROM head",
           "SELECT 'cheap_cost_share', cheap_cost / best_cost, cheap_model || '/' || cheap_lever FROM head"]
        + [f"SELECT 'near_best_' || task_category || '_{n}', {v}, NULL FROM near GROUP BY task_category" for n, v in (
            ("n_near_best", "CAST(count(*) AS DOUBLE)"), ("cost_ratio", "max(mean_cost) / min(mean_cost)"), ("min_cost", "min(mean_cost)"), ("max_cost", "max(mean_cost)"))]
        + ["SELECT 'passes_' || " + FRIENDLY_SQL.format(m="model") + f" || '_{n}', CAST(\"{n}\" AS DOUBLE), NULL FROM diff" for n in ("pass_a", "pass_b", "both")]
    ) + ")",
    rates_sql("model, lever"), MATRIX_SQL, _HEAD, rates_sql("task_category, lever", "cat0"),
    f"cat AS (SELECT *, mean_score - {_base('mean_score', 'task_category')} AS d FROM cat0)",
    rates_sql("task_category, model, lever", "fine"),
    "gaps AS (SELECT task_category, lever, max(CASE WHEN model = 'claude-sonnet-4-6' THEN mean_score END) - "
    "max(CASE WHEN model = 'gpt-5.4-2026-03-05' THEN mean_score END) AS gap FROM fine GROUP BY 1, 2)",
    _NEAR.replace("FROM cells", "FROM fine"), _SIDES, _DIFF))
def findings(spark, sf):
    return r9(A.findings(results(spark, sf)), "value")


@query("cell_spot_samples", grid_sql(
    "SELECT tier_1_status, pos, prompt_id, task_category, round(canonical_score, 9) AS canonical_score, "
    "replace(substr(response_text, 1, 150), chr(10), '⏎') AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY tier_1_status ORDER BY prompt_id) AS pos "
    "FROM results WHERE canonical_score IS NOT NULL AND model = 'claude-sonnet-4-6' AND optimisation_lever = 'compression') "
    "WHERE (tier_1_status IN ('fail_content', 'pass') AND pos <= 2) OR (tier_1_status = 'fail_format' AND pos <= 1)"))
def cell_spot_samples(spark, sf):
    df = C.tier2(results(spark, sf)).where((F.col("model") == "claude-sonnet-4-6") & (F.col("optimisation_lever") == "compression"))
    df = audits.sample_per(df, ["tier_1_status"], ["prompt_id"], {"fail_content": 2, "pass": 2, "fail_format": 1})
    return df.select("tier_1_status", F.col("pos").cast("long").alias("pos"), "prompt_id", "task_category",
                     F.round("canonical_score", 9).alias("canonical_score"), T.snippet(F.col("response_text")).alias("snippet"))


@query("scoped_results", grid_sql(
    "SELECT run_id, task_category, optimisation_lever, count(*) AS n, count(*) FILTER (WHERE error IS NULL AND tier_1_status <> 'compression_unavailable') AS n_judgeable "
    "FROM results WHERE run_id IN ('run-1', 'run-3') AND task_category IN ('rag_qa', 'reasoning') AND optimisation_lever IN ('baseline', 'compression') GROUP BY 1, 2, 3"))
def scoped_results(spark, sf):
    df = C.in_scope(results(spark, sf), ["run-1", "run-3"], ["rag_qa", "reasoning"], ["baseline", "compression"])
    ok = F.col("error").isNull() & (F.col("tier_1_status") != "compression_unavailable")
    return df.groupBy("run_id", "task_category", "optimisation_lever").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_judgeable"))


@query("judgeable_responses", grid_sql(
    "SELECT model, optimisation_lever AS lever, count(*) AS n FROM results WHERE error IS NULL AND (tier_1_status IS NULL OR "
    "tier_1_status <> 'compression_unavailable') GROUP BY 1, 2"))
def judgeable_responses(spark, sf):
    return C.judgeable(results(spark, sf)).groupBy("model", F.col("optimisation_lever").alias("lever")).agg(F.count(F.lit(1)).alias("n"))


@query("without_experiments", grid_sql(
    "SELECT model, count(*) AS n, round(avg(canonical_score), 9) AS mean_score FROM results WHERE optimisation_config IS NULL "
    "OR optimisation_config NOT LIKE '%\"experimental_comparison\": true%' GROUP BY model"))
def without_experiments(spark, sf):
    df = C.exclude_experimental(results(spark, sf)).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("canonical_score").alias("mean_score"))
    return r9(df, "mean_score")


@query("model_names", grid_sql(
    "SELECT model, CASE WHEN model LIKE 'claude%' THEN 'Anthropic' WHEN model LIKE 'gpt%' THEN 'OpenAI' ELSE 'Other' END AS family, "
    + FRIENDLY_SQL.format(m="model") + " AS friendly, count(*) AS n FROM results GROUP BY model"))
def model_names(spark, sf):
    return results(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n")).select(
        "model", T.provider_of(F.col("model")).alias("family"), T.friendly_model(F.col("model")).alias("friendly"), "n")


@query("category_from_id", grid_sql(
    "SELECT CASE split_part(prompt_id, '-', 1) WHEN 'cs' THEN 'customer_support' WHEN 'rag' THEN 'rag_qa' WHEN 'rea' THEN 'reasoning' "
    "WHEN 'sum' THEN 'summarisation' ELSE '?' END AS category, count(*) AS n FROM prompts GROUP BY 1"))
def category_from_id(spark, sf):
    return prompts(spark, sf).groupBy(T.category_of(F.col("prompt_id")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("signed_deltas", grid_sql(
    "SELECT model, lever, CASE WHEN round(delta_score, 3) = 0 THEN '0.000' ELSE printf('%+.3f', round(delta_score, 3)) END AS delta_text FROM matrix",
    rates_sql("model, lever"), MATRIX_SQL))
def signed_deltas(spark, sf):
    return A.lever_matrix(results(spark, sf)).select("model", "lever", T.fmt_delta(F.col("delta_score")).alias("delta_text"))
