"""Costs, spend, lever effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom import constants as K
from gradeloom.catalog import query
from gradeloom.catalog.cell_queries import r9, rates_sql
from gradeloom.catalog.grid import grid_sql, prompts, results, table, wide
from gradeloom.functions import scores as S
from gradeloom.operators import cells as C, costs, effects
from gradeloom.plans import analysis

PRICES_SQL = ("prices AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE), CAST({r} AS DOUBLE), CAST({c} AS DOUBLE))" for m, i, o, r, c in K.PRICES)
    + ") AS p(model, in_rate, out_rate, read_mult, create_mult))")
# two of the four models priced, so that the rest is reported
_KNOWN = [r for r in K.PRICES if not r[0].startswith("gpt-5.4-mini")]


@query("call_costs", grid_sql(
    "SELECT model, lever, count(*) AS n, round(sum(usd), 9) AS cost_usd, round(sum(usd) / CAST(1.27 AS DOUBLE), 9) AS cost_gbp, round(max(usd), 9) AS max_usd, "
    "round(max(abs(usd - cost_usd)), 9) AS max_gap FROM (SELECT r.model, optimisation_lever AS lever, cost_usd, (input_tokens * in_rate + "
    "cached_tokens * in_rate * read_mult + cache_creation_tokens * in_rate * create_mult + output_tokens * out_rate) / CAST(1000000 AS DOUBLE) * "
    "CASE WHEN optimisation_lever = 'batch' THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS usd FROM results r JOIN prices USING (model)) GROUP BY 1, 2", PRICES_SQL))
def call_costs(spark, sf):
    df = costs.with_cost(results(spark, sf).withColumnRenamed("cost_usd", "stored"), costs.pricing(spark))
    out = df.groupBy("model", F.col("optimisation_lever").alias("lever")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_usd"), 9).alias("cost_usd"), F.round(F.sum("cost_gbp"), 9).alias("cost_gbp"),
        F.max("cost_usd").alias("max_usd"), F.max(F.abs(F.col("cost_usd") - F.col("stored"))).alias("max_gap"))
    return r9(out, "max_usd", "max_gap")


@query("unpriced_calls", grid_sql(
    "SELECT model, count(*) AS n FROM results WHERE model NOT IN (SELECT model FROM prices WHERE model NOT LIKE 'gpt-5.4-mini%') GROUP BY 1", PRICES_SQL))
def unpriced_calls(spark, sf):
    return costs.unpriced(results(spark, sf), costs.pricing(spark, _KNOWN)).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


_ESTIMATES = "CASE task_category " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in K.OUTPUT_TOKEN_ESTIMATES.items()) + " ELSE 500 END"
_THRESHOLDS = "CASE model " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in K.CACHE_MIN_TOKENS.items()) + " ELSE 1000000 END"


@query("cost_estimates", grid_sql(
    "SELECT task_category, model, CAST(sum(tin) AS BIGINT) AS est_input_tokens, CAST(sum(tout) AS BIGINT) AS est_output_tokens, "
    "round(sum((tin * in_rate + tout * out_rate) / CAST(1000000 AS DOUBLE) / CAST(1.27 AS DOUBLE)), 6) AS est_cost_gbp FROM (SELECT *, greatest(1, length(system_text || chr(10) || user_text) // 4) AS tin, "
    + _ESTIMATES + " AS tout FROM prompts) CROSS JOIN prices GROUP BY 1, 2", PRICES_SQL))
def cost_estimates(spark, sf):
    df = costs.with_estimates(prompts(spark, sf)).groupBy("task_category", "model").agg(
        F.sum("est_input_tokens").alias("est_input_tokens"), F.sum("est_output_tokens").alias("est_output_tokens"),
        F.round(F.sum("est_cost_gbp"), 6).alias("est_cost_gbp"))
    return df


@query("document_cost_estimates", "WITH " + PRICES_SQL + (
    " SELECT lang, model, count(*) AS n, CAST(sum(tin) AS BIGINT) AS tokens, count(*) FILTER (WHERE tin >= " + _THRESHOLDS + ") AS n_cacheable FROM "
    "(SELECT lang, greatest(1, length(text) // 4) AS tin FROM documents) CROSS JOIN prices GROUP BY 1, 2"))
def document_cost_estimates(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "text", F.lit("summarisation").alias("task_category"))
    df = costs.with_estimates(docs, text=F.col("text"))
    return df.groupBy("lang", "model").agg(F.count(F.lit(1)).alias("n"), F.sum("est_input_tokens").alias("tokens"),
                                           F.count_if("cache_engages").alias("n_cacheable"))


# ---- spend: every order customer segment is a run of calls --------------------------------------
_CAP = 60.0


def runs_of(rows: DataFrame, cap: float = _CAP) -> DataFrame:
    """Run headers of the grid; the recorded spend of one run is off by a penny."""
    per_run = rows.groupBy("run_id").agg(F.sum("cost_usd").alias("usd"))
    off = F.when(F.col("run_id") == "run-2", F.lit(0.01)).otherwise(F.lit(0.0))
    return per_run.select("run_id", (S.to_gbp(F.col("usd")) + off).alias("cost_so_far_gbp"), F.lit(cap).alias("cost_cap_gbp"))


_CURVE = (f"curve AS (SELECT *, sum(cost_usd) OVER (PARTITION BY run_id ORDER BY ts, result_id ROWS UNBOUNDED PRECEDING) / CAST(1.27 AS DOUBLE) AS spent, "
          f"CAST({_CAP} AS DOUBLE) AS cap FROM results)")


@query("spend_curve", grid_sql(
    "SELECT run_id, count(*) AS n, count(*) FILTER (WHERE spent > cap) AS n_over, round(max(spent), 6) AS spent_gbp FROM curve GROUP BY 1", _CURVE))
def spend_curve(spark, sf):
    rows = results(spark, sf)
    df = costs.spend_curve(rows, runs_of(rows))
    return df.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("over_cap").alias("n_over"),
                                    F.round(F.max("spent_gbp"), 6).alias("spent_gbp"))


@query("first_breach", grid_sql(
    "SELECT run_id, arg_min(result_id, rn) AS result_id, round(arg_min(spent, rn), 6) AS spent_gbp FROM (SELECT *, row_number() OVER "
    "(PARTITION BY run_id ORDER BY ts, result_id) AS rn FROM curve) WHERE spent > cap GROUP BY 1", _CURVE))
def first_breach(spark, sf):
    rows = results(spark, sf)
    return costs.first_breach(rows, runs_of(rows)).select("run_id", "result_id", F.round("spent_gbp", 6).alias("spent_gbp"))


@query("spend_reconciliation", grid_sql(
    "SELECT run_id, round(usd / CAST(1.27 AS DOUBLE), 6) AS actual_gbp, run_id <> 'run-2' AS ok FROM (SELECT run_id, sum(cost_usd) AS usd FROM results GROUP BY 1)"))
def spend_reconciliation(spark, sf):
    rows = results(spark, sf)
    return costs.reconcile_spend(rows, runs_of(rows)).select("run_id", F.round("actual_gbp", 6).alias("actual_gbp"), "ok")


@query("budget_tiers", """
SELECT c_mktsegment, tier, count(*) AS n, CAST(sum(CASE tier WHEN '60-subset' THEN 60 WHEN '30-subset' THEN 30 WHEN 'operator-call' THEN 15 WHEN 'skip' THEN 0 END) AS BIGINT) AS prompts FROM
 (SELECT c_mktsegment, CASE WHEN p > CAST(0.60 AS DOUBLE) THEN 'full' WHEN p > CAST(0.40 AS DOUBLE) THEN '60-subset' WHEN p > CAST(0.27 AS DOUBLE) THEN '30-subset'
  WHEN p > CAST(0.13 AS DOUBLE) THEN 'operator-call' ELSE 'skip' END AS tier FROM (SELECT c_mktsegment, (300.0::DOUBLE - (c_custkey % 301)) / 300.0::DOUBLE AS p FROM customer)) GROUP BY 1, 2""")
def budget_tiers(spark, sf):
    runs = table(spark, sf, "customer").select("c_mktsegment", F.lit(300.0).alias("cost_cap_gbp"), (F.col("c_custkey") % 301).cast("double").alias("cost_so_far_gbp"))
    return costs.with_budget_tier(runs).groupBy("c_mktsegment", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("subset_size").alias("prompts"))


@query("cache_prediction", grid_sql(
    "SELECT model, round(avg(share * read_mult + 1 - share), 9) AS predicted_mult FROM (SELECT r.model, read_mult, input_tokens * in_rate / (input_tokens * in_rate + "
    "output_tokens * out_rate) AS share FROM results r JOIN prices USING (model) WHERE optimisation_lever = 'baseline') GROUP BY 1", PRICES_SQL))
def cache_prediction(spark, sf):
    rows = results(spark, sf).where(F.col("optimisation_lever") == "baseline")
    return r9(costs.predicted_cache_multiplier(rows, costs.pricing(spark)).groupBy("model").agg(F.avg("predicted_mult").alias("predicted_mult")), "predicted_mult")


@query("routing_policy", grid_sql(
    "SELECT policy, round(cost, 9) AS cost, round(quality, 9) AS quality, round(cost / max(CASE WHEN policy = 'single' THEN cost END) OVER (), 9) AS cost_ratio FROM ("
    "SELECT 'routed' AS policy, sum(w * mean_cost) / sum(w) AS cost, sum(w * mean_score) / sum(w) AS quality FROM cells JOIN mix USING (task_category) "
    "WHERE lever = 'batch' AND model = CASE WHEN task_category = 'summarisation' THEN 'gpt-5.4-2026-03-05' ELSE 'gpt-5.4-mini-2026-03-17' END UNION ALL "
    "SELECT 'single', sum(w * mean_cost) / sum(w), sum(w * mean_score) / sum(w) FROM cells JOIN mix USING (task_category) WHERE lever = 'baseline' AND model = 'gpt-5.4-2026-03-05')",
    rates_sql("task_category, model, lever"),
    "mix AS (SELECT task_category, CAST(count(*) AS DOUBLE) AS w FROM prompts WHERE task_category <> 'extraction' GROUP BY 1)"))
def routing_policy(spark, sf):
    mix = prompts(spark, sf).where(F.col("task_category") != "extraction").groupBy("task_category").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    small, large = "gpt-5.4-mini-2026-03-17", "gpt-5.4-2026-03-05"
    policy = spark.createDataFrame([(c, large if c == "summarisation" else small, "batch") for c in K.JUDGED_CATEGORIES],
                                   "task_category string, model string, lever string")
    df = costs.routing_cost(C.with_rates(C.cells(results(spark, sf))), mix, policy, (large, "baseline"))
    return r9(df, "cost", "quality", "cost_ratio")


# ---- lever effects ------------------------------------------------------------------------------
_RATIOS = (
    "ratios AS (SELECT r.run_id, r.prompt_id, r.model, r.optimisation_lever AS lever, CASE WHEN b.cost_usd > 0 THEN r.cost_usd / b.cost_usd END AS cost_mult, "
    "CAST(r.input_tokens AS DOUBLE) / greatest(b.input_tokens, 1) AS input_mult, CAST(r.output_tokens AS DOUBLE) / greatest(b.output_tokens, 1) AS output_mult, "
    "CASE WHEN r.optimisation_lever <> 'batch' THEN CAST(r.latency_ms AS DOUBLE) / greatest(b.latency_ms, 1) END AS latency_mult FROM results r JOIN results b "
    "ON r.prompt_id = b.prompt_id AND r.model = b.model AND r.run_id = b.run_id AND b.optimisation_lever = 'baseline' AND b.error IS NULL WHERE r.optimisation_lever <> 'baseline' AND r.error IS NULL)")


@query("lever_ratios", grid_sql(
    "SELECT model, lever, count(*) AS n, round(avg(cost_mult), 9) AS cost_mult, round(avg(input_mult), 9) AS input_mult, round(avg(output_mult), 9) AS output_mult, "
    "round(avg(latency_mult), 9) AS latency_mult FROM ratios GROUP BY 1, 2", _RATIOS))
def lever_ratios(spark, sf):
    df = C.lever_ratios(results(spark, sf)).groupBy("model", "lever").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("cost_mult", "input_mult", "output_mult", "latency_mult")])
    return r9(df, "cost_mult", "input_mult", "output_mult", "latency_mult")


@query("lever_effects", grid_sql(
    "SELECT lever, measure, count(*) AS n, round(min(value), 9) AS min, round(max(value), 9) AS max, round(median(value), 9) AS median FROM "
    "(UNPIVOT ratios ON cost_mult, input_mult, output_mult, latency_mult INTO NAME measure VALUE value) GROUP BY 1, 2", _RATIOS))
def lever_effects(spark, sf):
    return r9(analysis.lever_effects(results(spark, sf)), "min", "max", "median")


def caching_calls(spark, sf) -> DataFrame:
    """Baseline rows of the grid plus a cache-write and a cache-read call for long prompts."""
    base = wide(spark, sf).where("lever = 'baseline'")
    phases = F.explode(F.array(F.lit("baseline"), F.lit("write"), F.lit("read"))).alias("phase")
    df = base.select("*", phases).where("phase = 'baseline' OR in0 >= 1024")
    return df.selectExpr(
        "run_id", "prompt_id", "task_category", "model", "provider", "CASE WHEN phase = 'baseline' THEN 'baseline' ELSE 'caching' END AS optimisation_lever",
        "result_id || phase AS result_id", "CAST(1 AS BIGINT) AS run_attempt",
        "CASE WHEN phase <> 'baseline' THEN '{\"cache_phase\": \"' || phase || '\"}' END AS optimisation_config",
        *[f"{e} AS {c}" for c, e in CACHE_RULES.items()])


CACHE_RULES = {
    "cached_tokens": "CASE WHEN phase = 'read' AND h1 % 7 <> 0 THEN in0 WHEN phase = 'write' AND provider = 'anthropic' AND h1 % 17 = 1 THEN 5 ELSE 0 END",
    "cache_creation_tokens": "CASE WHEN phase = 'write' AND provider = 'anthropic' AND h1 % 13 <> 0 THEN in0 ELSE 0 END",
    "latency_ms": "CASE phase WHEN 'baseline' THEN 300 + (h2 * 7) % 5000 WHEN 'write' THEN 400 + (h2 * 11) % 5000 ELSE 200 + (h2 * 5) % 3000 END",
    "cost_usd": "CASE phase WHEN 'baseline' THEN CAST(in0 AS DOUBLE) WHEN 'write' THEN CAST(in0 * 5 AS DOUBLE) / 4 ELSE CAST(in0 + h1 AS DOUBLE) / 10 END / CAST(100000 AS DOUBLE)",
}
_CACHE_SQL = (
    "phased AS (SELECT *, CASE WHEN phase = 'baseline' THEN 'baseline' ELSE 'caching' END AS opt FROM wide CROSS JOIN (VALUES ('baseline'), ('write'), ('read')) AS f(phase) "
    "WHERE lever = 'baseline' AND (phase = 'baseline' OR in0 >= 1024)), "
    "ccalls AS (SELECT run_id, prompt_id, model, provider, phase, " + ", ".join(f"{e} AS {c}" for c, e in CACHE_RULES.items()) + " FROM phased), "
    "trio AS (SELECT b.run_id, b.prompt_id, b.model, CASE WHEN w.phase IS NULL THEN 'prompt below the caching threshold' "
    "WHEN w.provider = 'anthropic' AND w.cache_creation_tokens = 0 THEN 'cache write created no cache tokens' "
    "WHEN w.provider = 'anthropic' AND w.cached_tokens <> 0 THEN 'cache write read from a warm cache' "
    "WHEN coalesce(r.cached_tokens, 0) = 0 THEN 'cache read hit no cache tokens' END AS skip_reason, "
    "w.cost_usd / b.cost_usd AS cost_write_mult, r.cost_usd / b.cost_usd AS cost_read_mult, CAST(w.latency_ms AS DOUBLE) / greatest(b.latency_ms, 1) AS latency_write_mult, "
    "CAST(r.latency_ms AS DOUBLE) / greatest(b.latency_ms, 1) AS latency_read_mult FROM (SELECT * FROM ccalls WHERE phase = 'baseline') b "
    "LEFT JOIN (SELECT * FROM ccalls WHERE phase = 'write') w USING (run_id, prompt_id, model) LEFT JOIN (SELECT * FROM ccalls WHERE phase = 'read') r USING (run_id, prompt_id, model))")


@query("cache_effects", grid_sql(
    "SELECT model, n_available, n_unavailable, measure, round(min(value), 9) AS min, round(max(value), 9) AS max, round(median(value), 9) AS median FROM "
    "(UNPIVOT (SELECT * FROM trio WHERE skip_reason IS NULL) ON cost_write_mult, cost_read_mult, latency_write_mult, latency_read_mult INTO NAME measure VALUE value) "
    "JOIN (SELECT model, count(*) FILTER (WHERE skip_reason IS NULL) AS n_available, count(skip_reason) AS n_unavailable FROM trio GROUP BY 1) USING (model) GROUP BY 1, 2, 3, 4", _CACHE_SQL))
def cache_effects(spark, sf):
    return r9(effects.cache_effects(caching_calls(spark, sf)), "min", "max", "median")


@query("cache_skip_reasons", grid_sql("SELECT model, skip_reason, count(*) AS n FROM trio WHERE skip_reason IS NOT NULL GROUP BY 1, 2", _CACHE_SQL))
def cache_skip_reasons(spark, sf):
    return effects.skip_reasons(caching_calls(spark, sf))


@query("engagement", grid_sql(
    "SELECT run_id, count(*) FILTER (WHERE phase = 'write') AS n_writes, count(*) FILTER (WHERE phase = 'write' AND (provider = 'openai' OR cache_creation_tokens > 0)) AS n_writes_engaged, "
    "count(*) FILTER (WHERE phase = 'read') AS n_reads, count(*) FILTER (WHERE phase = 'read' AND cached_tokens > 0) AS n_reads_engaged, n_compressions, n_compressed, n_counts_missing FROM ccalls JOIN "
    "(SELECT run_id, count(*) AS n_compressions, count(*) FILTER (WHERE compressed_tokens < original_tokens) AS n_compressed, CAST(0 AS BIGINT) AS n_counts_missing FROM wide WHERE lever = 'compression' GROUP BY 1) USING (run_id) "
    "GROUP BY run_id, n_compressions, n_compressed, n_counts_missing", _CACHE_SQL))
def engagement(spark, sf):
    calls = caching_calls(spark, sf)
    compressions = results(spark, sf).where("optimisation_lever = 'compression'").select(*[c for c in calls.columns if c in results(spark, sf).columns])
    return effects.engagement(calls.unionByName(compressions, allowMissingColumns=True))


@query("compression_effects", grid_sql(
    "SELECT model, count(*) AS n, count(*) FILTER (WHERE compressed_tokens < original_tokens) AS n_reduced, round(avg(CAST(compressed_tokens AS DOUBLE) / original_tokens), 9) AS counted_ratio, "
    "round(avg(CAST(input_tokens AS DOUBLE) / original_tokens), 9) AS billed_ratio, round(avg((1 - CAST(compressed_tokens AS DOUBLE) / original_tokens) * 100), 9) AS reduction_pct "
    "FROM wide WHERE lever = 'compression' GROUP BY 1"))
def compression_effects(spark, sf):
    df = effects.compression_effects(results(spark, sf))
    out = df.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("compressed_tokens") < F.col("original_tokens")).alias("n_reduced"),
                                  *[F.avg(c).alias(c) for c in ("counted_ratio", "billed_ratio", "reduction_pct")])
    return r9(out, "counted_ratio", "billed_ratio", "reduction_pct")


@query("compression_availability", grid_sql(
    "SELECT model, compressed_tokens < original_tokens AS available, CASE WHEN compressed_tokens >= original_tokens THEN printf('no reduction: %d >= %d (%.3fx)', compressed_tokens, "
    "original_tokens, CAST(compressed_tokens AS DOUBLE) / original_tokens) END AS reason, count(*) AS n FROM wide WHERE lever = 'compression' GROUP BY 1, 2, 3"))
def compression_availability(spark, sf):
    df = effects.compression_effects(results(spark, sf)).withColumn("s", effects.compression_status(F.col("original_tokens"), F.col("compressed_tokens")))
    return df.groupBy("model", "s.available", "s.reason").agg(F.count(F.lit(1)).alias("n"))


@query("cap_violations", grid_sql("SELECT model, count(*) AS n FROM results WHERE optimisation_lever = 'output_cap' AND output_tokens > 150 GROUP BY 1"))
def cap_violations(spark, sf):
    return effects.cap_violations(results(spark, sf), 150).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("contaminated_baselines", grid_sql(
    "SELECT model, task_category, count(*) AS n FROM results WHERE optimisation_lever = 'baseline' AND error IS NULL AND cached_tokens > 0 GROUP BY 1, 2"))
def contaminated_baselines(spark, sf):
    return effects.contaminated_baselines(results(spark, sf)).groupBy("model", "task_category").agg(F.count(F.lit(1)).alias("n"))


@query("warm_calls", """
SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE ts - prev <= INTERVAL 2 HOUR) AS n_warm FROM
 (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events) GROUP BY 1, 2""")
def warm_calls(spark, sf):
    df = effects.warm_calls(table(spark, sf, "events"), 7200, ["user_id", "event_type"], tie="event_id")
    return df.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("warm").alias("n_warm"))


@query("annotated_configs", grid_sql(
    "SELECT model, optimisation_lever AS lever, count(*) FILTER (WHERE model LIKE 'gpt-5.4%') AS n_annotated, count(*) FILTER (WHERE model NOT LIKE 'gpt-5.4%' AND optimisation_config IS NULL) AS n_null, "
    "CASE WHEN model LIKE 'claude-%' THEN model ELSE 'claude-sonnet-4-6' END AS reference FROM results GROUP BY 1, 2, 5"))
def annotated_configs(spark, sf):
    df = results(spark, sf).withColumn("c", S.annotate_config(F.col("optimisation_config"), F.col("model")))
    return df.groupBy("model", F.col("optimisation_lever").alias("lever")).agg(
        F.count_if(F.get_json_object("c", "$.reasoning_effort") == "medium").alias("n_annotated"), F.count_if(F.col("c").isNull()).alias("n_null"),
    ).withColumn("reference", S.count_reference_model(F.col("model")))
