"""Prices, costs, estimates and spend against a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gradeloom import constants as K
from gradeloom.functions import scores as S
from gradeloom.operators.ordered import running_total


def pricing(spark: SparkSession, rows: list[tuple] = K.PRICES) -> DataFrame:
    """Price dimension: one row per model, USD per million tokens."""
    return spark.createDataFrame(rows, "model string, in_rate double, out_rate double, read_mult double, create_mult double")


def with_cost(results: DataFrame, prices: DataFrame, fx: float = K.GBP_USD_RATE, name: str = "cost_usd") -> DataFrame:
    """Cost of each call from its tokens; calls of unpriced models drop out (see ``unpriced``).

    The price table holds one row per model.
    """
    df = results.join(F.broadcast(prices), "model")
    cost = S.token_cost(F.col("in_rate"), F.col("out_rate"), F.col("read_mult"), F.col("create_mult"),
                        F.col("input_tokens"), F.col("output_tokens"), F.col("cached_tokens"),
                        F.col("cache_creation_tokens"), F.col("optimisation_lever") == "batch")
    df = df.withColumn(name, cost).withColumn(name.replace("usd", "gbp"), S.to_gbp(F.col(name), fx))
    return df.drop("in_rate", "out_rate", "read_mult", "create_mult")


def unpriced(results: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls of models the price table does not know."""
    return results.join(F.broadcast(prices.select("model")), "model", "left_anti")


def with_estimates(prompts: DataFrame, rows: list[tuple] = K.PRICES, text: Column | None = None) -> DataFrame:
    """Planned cost of each prompt on each priced model, before any call.

    Input tokens are a quarter of the characters, output tokens the category's estimate.  The
    price rows are configuration and become an array literal, so no prompt is shuffled.
    """
    body = F.concat_ws("\n", "system_text", "user_text") if text is None else text
    names = ["model", "in_rate", "out_rate", "read_mult", "create_mult"]
    models = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, r)]) for r in rows])
    df = prompts.withColumns({
        "est_input_tokens": S.input_token_estimate(body), "est_output_tokens": S.output_token_estimate(F.col("task_category")),
    }).withColumn("_p", F.explode(models)).select("*", "_p.*").drop("_p")
    cost = S.token_cost(F.col("in_rate"), F.col("out_rate"), F.col("read_mult"), F.col("create_mult"), F.col("est_input_tokens"),
                        F.col("est_output_tokens"), F.lit(0), F.lit(0), F.lit(False))
    return df.withColumns({
        "est_cost_gbp": S.to_gbp(cost),
        "cache_min_tokens": S.cache_min_tokens(F.col("model")),
        "cache_engages": F.col("est_input_tokens") >= S.cache_min_tokens(F.col("model")),
    }).drop("in_rate", "out_rate", "read_mult", "create_mult")


def spend_curve(results: DataFrame, runs: DataFrame, fx: float = K.GBP_USD_RATE, slices: int | None = None) -> DataFrame:
    """Every call with the run's spend up to it, and whether that exceeds the cap.

    ``runs`` carries run_id and cost_cap_gbp.  A run of any size is cut into slices, so that no
    single task orders it.
    """
    calls = results.select("run_id", "ts", "result_id", "cost_usd")
    df = running_total(calls, ["run_id"], ["ts", "result_id"], {"spent_usd": F.col("cost_usd")}, slices)
    df = df.join(F.broadcast(runs.select("run_id", "cost_cap_gbp")), "run_id")
    return df.withColumn("spent_gbp", S.to_gbp(F.col("spent_usd"), fx)).withColumn(
        "over_cap", F.col("spent_gbp") > F.col("cost_cap_gbp")).drop("spent_usd")


def first_breach(results: DataFrame, runs: DataFrame, fx: float = K.GBP_USD_RATE, bucket: str = "day",
                 slices: int | None = None) -> DataFrame:
    """First call of each run at which spend exceeds the cap; runs within the cap do not appear.

    Spend is summed per time bucket first.  Only the bucket in which a run crosses its cap is
    looked at call by call.
    """
    calls = results.select("run_id", "ts", "result_id", "cost_usd").withColumn("_b", F.date_trunc(bucket, "ts"))
    per_bucket = calls.groupBy("run_id", "_b").agg(F.sum("cost_usd").alias("_sum"))
    w = Window.partitionBy("run_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = per_bucket.withColumn("_upto", F.sum("_sum").over(w)).join(runs.select("run_id", "cost_cap_gbp"), "run_id")
    crossing = (cum.where(S.to_gbp(F.col("_upto"), fx) > F.col("cost_cap_gbp"))
                .groupBy("run_id").agg(F.min_by(F.struct("_b", (F.col("_upto") - F.col("_sum")).alias("before"),
                                                         "cost_cap_gbp"), "_b").alias("x"))
                .select("run_id", "x.*"))
    inside = calls.join(crossing, ["run_id", "_b"])
    df = running_total(inside, ["run_id"], [F.col("ts"), F.col("result_id")], {"_run": F.col("cost_usd")}, slices)
    spent = S.to_gbp(F.col("before") + F.col("_run"), fx)
    return (df.withColumn("spent_gbp", spent).where(F.col("spent_gbp") > F.col("cost_cap_gbp"))
            .groupBy("run_id").agg(F.min_by(F.struct("ts", "result_id", "spent_gbp", "cost_cap_gbp"),
                                            F.struct("ts", "result_id")).alias("x")).select("run_id", "x.*"))


def first_refused(calls: DataFrame, runs: DataFrame, fx: float = K.GBP_USD_RATE, slices: int | None = None) -> DataFrame:
    """First call of each run that the cap refuses: spend before it plus its own estimate (est_cost_gbp) is over the cap."""
    rows = calls.select("run_id", "ts", "result_id", "cost_usd", "est_cost_gbp")
    df = running_total(rows, ["run_id"], ["ts", "result_id"], {"_upto": F.col("cost_usd")}, slices)
    df = df.join(F.broadcast(runs.select("run_id", "cost_cap_gbp")), "run_id").withColumn("spent_gbp", S.to_gbp(F.col("_upto") - F.col("cost_usd"), fx))
    over = df.where(would_exceed(F.col("spent_gbp"), F.col("est_cost_gbp"), F.col("cost_cap_gbp")))
    return over.groupBy("run_id").agg(F.min_by(F.struct("ts", "result_id", "spent_gbp", "est_cost_gbp", "cost_cap_gbp"), F.struct("ts", "result_id")).alias("x")).select("run_id", "x.*")


def would_exceed(spent_gbp: Column, estimate_gbp: Column, cap_gbp: Column) -> Column:
    """Cap test before a call: strictly above the cap."""
    return spent_gbp + estimate_gbp > cap_gbp


def reconcile_spend(results: DataFrame, runs: DataFrame, fx: float = K.GBP_USD_RATE,
                    tolerance: float = K.SPEND_TOLERANCE_GBP) -> DataFrame:
    """Recorded spend of each run against the sum of its calls."""
    actual = results.groupBy("run_id").agg(F.sum("cost_usd").alias("_usd"))
    df = runs.join(actual, "run_id", "left").withColumn("actual_gbp", S.to_gbp(F.coalesce(F.col("_usd"), F.lit(0.0)), fx))
    gap = F.abs(F.col("cost_so_far_gbp") - F.col("actual_gbp"))
    return df.withColumns({"gap_gbp": gap, "ok": gap <= F.lit(tolerance)}).drop("_usd")


def with_budget_tier(runs: DataFrame) -> DataFrame:
    """Budget tier and subset size of each run by the headroom left."""
    tier = S.budget_tier(F.col("cost_cap_gbp"), F.col("cost_so_far_gbp"))
    return runs.withColumn("headroom_gbp", F.col("cost_cap_gbp") - F.col("cost_so_far_gbp")).withColumn(
        "tier", tier).withColumn("subset_size", S.budget_tier_size(F.col("tier")))


def predicted_cache_multiplier(results: DataFrame, prices: DataFrame) -> DataFrame:
    """Expected cost multiplier of a cache read: discounted input share plus output share; NULL for a call that costs nothing."""
    df = results.join(F.broadcast(prices), "model")
    cost_in, cost_out = F.col("input_tokens") * F.col("in_rate"), F.col("output_tokens") * F.col("out_rate")
    share = F.try_divide(cost_in, cost_in + cost_out)
    return df.withColumn("input_share", share).withColumn(
        "predicted_mult", F.col("input_share") * F.col("read_mult") + (F.lit(1.0) - F.col("input_share"))
    ).drop("in_rate", "out_rate", "read_mult", "create_mult")


def routing_cost(cells_df: DataFrame, mix: DataFrame, policy: DataFrame, fallback: tuple[str, str],
                 cost: str = "mean_cost", quality: str = "mean_score") -> DataFrame:
    """Blended cost and quality of a traffic mix under a routing policy, against one cell for all.

    ``mix`` (task_category, weight), ``policy`` (task_category, model, lever).
    """
    routed = mix.join(policy, "task_category").join(cells_df, ["task_category", "model", "lever"])
    single = mix.join(cells_df.where((F.col("model") == fallback[0]) & (F.col("lever") == fallback[1])), "task_category")
    w = F.col("weight")

    def total(df: DataFrame, name: str) -> DataFrame:
        return df.agg((F.sum(w * F.col(cost)) / F.sum(w)).alias("cost"), (F.sum(w * F.col(quality)) / F.sum(w)).alias("quality")) \
            .withColumn("policy", F.lit(name))

    both = total(routed, "routed").unionByName(total(single, "single"))
    base = F.max(F.when(F.col("policy") == "single", F.col("cost"))).over(Window.partitionBy(F.lit(0)))
    return both.withColumn("cost_ratio", F.col("cost") / base).select("policy", "cost", "quality", "cost_ratio")
