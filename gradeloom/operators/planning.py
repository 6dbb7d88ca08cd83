"""Which work is missing, done or next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gradeloom import constants as K


def expected_grid(prompts: DataFrame, models: list[str] = K.TEST_MODELS, levers: list[str] = K.LEVERS) -> DataFrame:
    """Every (prompt, model, lever) that should be measured.

    Models and levers are configuration: they expand each prompt row in place.
    """
    df = prompts.select("prompt_id", F.explode(F.array(*map(F.lit, models))).alias("model"))
    return df.select("*", F.explode(F.array(*map(F.lit, levers))).alias("lever"))


def coverage_gap(results: DataFrame, prompts: DataFrame, models: list[str] = K.TEST_MODELS, levers: list[str] = K.LEVERS,
                 run_id: str | None = None) -> DataFrame:
    """Expected measurements that have no row."""
    have = results if run_id is None else results.where(F.col("run_id") == run_id)
    have = have.select("prompt_id", "model", F.col("optimisation_lever").alias("lever"))
    return expected_grid(prompts, models, levers).join(have, ["prompt_id", "model", "lever"], "left_anti")


def gap_by_lever(gap: DataFrame) -> DataFrame:
    return gap.groupBy("lever").agg(F.count(F.lit(1)).alias("n_missing"))


def not_done(planned: DataFrame, results: DataFrame) -> DataFrame:
    """Planned work without a successful row under the same key, run included."""
    done = results.where(F.col("error").isNull()).select(*K.RESULT_KEY)
    return planned.join(done, K.RESULT_KEY, "left_anti")


def next_attempt(results: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Next attempt number per (prompt, model, lever, config) over all runs; 1 for ``planned`` keys that never ran."""
    key = ["prompt_id", "model", "optimisation_lever", "config_hash"]
    ran = results.groupBy(*key).agg((F.max("run_attempt") + 1).alias("next_attempt"))
    if planned is None:
        return ran
    return planned.select(*key).distinct().join(ran, key, "left").fillna(1, ["next_attempt"])


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Most recent live batch job per (run, provider, model, lever).

    An aggregate, so that older submissions are dropped before the shuffle.
    """
    key = ["run_id", "provider", "model", "lever"]
    rest = [c for c in jobs.columns if c not in key]
    live = jobs.where(F.col("status").isin(K.LIVE_JOB_STATUSES))
    return live.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("submitted_at", "batch_id")).alias("j")).select(*key, "j.*")


def timed_out_jobs(jobs: DataFrame, now, seconds: int = K.JOB_TIMEOUT_SECONDS) -> DataFrame:
    """Open jobs older than the limit at ``now`` (a timestamp Column)."""
    age = F.unix_timestamp(now) - F.unix_timestamp("submitted_at")
    return jobs.where(F.col("status").isin(K.OPEN_JOB_STATUSES)).withColumn("age_s", age).where(F.col("age_s") > seconds)


def stratified_subset(prompts: DataFrame, n: int) -> DataFrame:
    """``n / 5`` prompts of each category, easiest first, then by id."""
    if n % len(K.CATEGORIES):
        raise ValueError(f"subset size {n} must be divisible by {len(K.CATEGORIES)}")
    rank = F.array_position(F.array(*map(F.lit, K.COMPLEXITIES)), F.col("complexity"))
    order = F.when(rank > 0, rank).otherwise(F.lit(99))
    w = Window.partitionBy("task_category").orderBy(order, "prompt_id")
    return prompts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n // len(K.CATEGORIES)).drop("_r")
