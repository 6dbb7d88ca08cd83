"""Audits of scores and judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom import constants as K
from gradeloom.functions import scores as S, text as T
from gradeloom.operators.ordered import exact_median, nearest_rank, running_total

# fixed values: lower bounds and labels of the score buckets
SCORE_BUCKETS = [(1.0, "1.00"), (0.8, "0.80–0.99"), (0.6, "0.60–0.79"), (0.4, "0.40–0.59"), (0.2, "0.20–0.39")]
LOWEST_BUCKET = "0.00–0.19"


def status_counts(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """Count and percent of each status, overall or within groups."""
    by = list(by)
    df = scored.groupBy(*by, "tier_1_status").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*([F.col(c) for c in by] or [F.lit(0)])))
    return df.withColumn("pct", F.lit(100.0) * F.col("n") / total)


def pass_rate_scored(scored: DataFrame, by: list[str]) -> DataFrame:
    """Pass percentage over rows that are not n/a, unavailable or errors; schema failures count. NaN when none."""
    off = F.col("tier_1_status").isin("not_applicable", "compression_unavailable", "error")
    df = scored.groupBy(*by).agg(F.count_if(F.col("tier_1_status") == "pass").alias("n_pass"), F.count_if(~off).alias("n_applicable"))
    rate = F.when(F.col("n_applicable") > 0, F.lit(100.0) * F.col("n_pass") / F.col("n_applicable")).otherwise(F.lit(float("nan")))
    return df.withColumn("pass_pct", rate)


def step_counts(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """How often each normalisation step changed a response."""
    return (scored.select(*by, F.explode("normalisation_steps_applied").alias("step"))
            .groupBy(*by, "step").agg(F.count(F.lit(1)).alias("n")))


def sample_per(df: DataFrame, by: list[str], order: list, quota: int | dict[str, int]) -> DataFrame:
    """First rows of each group along an order: the same number for all, or one per value of the last key.

    The rank limit is pushed below the shuffle, so each task sends at most that many rows per group.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("pos", F.row_number().over(w))
    if isinstance(quota, int):
        return ranked.where(F.col("pos") <= quota)
    most = max(quota.values())
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col(by[-1]))
    return ranked.where(F.col("pos") <= most).where(F.col("pos") <= limit)


def top_rows(df: DataFrame, order: list[Column], k: int, name: str = "pos") -> DataFrame:
    """The first ``k`` rows along an order, with their position from 1; each task sends at most ``k`` rows."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def spot_check(results: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` random rows, always the same for a seed, with the score the rule gives them and whether it is the stored one."""
    expected = S.mean_of_both(F.col("judge_a_score"), F.col("judge_b_score"))
    df = results.where((F.col("judge_disagreement_flag") == 0) & expected.isNotNull())
    df = df.withColumn("expected_score", expected)
    return df.withColumn("ok", F.abs(F.col("canonical_score") - F.col("expected_score")) < 1e-9).orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), "result_id"), 256), "result_id").limit(k)


def judge_summary(scores: DataFrame, fx: float = K.GBP_USD_RATE, slices: int | None = None) -> DataFrame:
    """Rows, errors, cost and exact latency percentiles of each judge."""
    ranks = {"p50_ms": F.floor(F.col("n") / 2), "p95_ms": F.floor(F.col("n") * F.lit(0.95))}
    also = {"n_errors": F.count_if(F.col("judge_error").isNotNull()), "cost_usd": F.sum("cost_usd")}
    also["n_scored"] = F.count(F.lit(1))
    df = nearest_rank(scores, "latency_ms", ranks, ["judge"], slices, also).drop("n")
    return df.withColumn("cost_gbp", S.to_gbp(F.col("cost_usd"), fx))


def approx_percentiles(df: DataFrame, column: str, points: dict[str, float], by: list[str], accuracy: int = 10_000) -> DataFrame:
    """Percentiles from a mergeable sketch: one pass and no order, with a rank error of at most 1 / accuracy."""
    found = F.percentile_approx(column, F.array(*map(F.lit, points.values())), accuracy)
    out = df.groupBy(*by).agg(found.alias("_p"), F.count(column).alias("n"))
    return out.select(*by, "n", *[F.get(F.col("_p"), F.lit(i)).alias(name) for i, name in enumerate(points)])


def score_range(scores: DataFrame) -> DataFrame:
    """One row: count, share in [0, 1], min, max, mean."""
    df = scores.where(F.col("score").isNotNull())
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score").between(0.0, 1.0)).alias("n_in_range"),
                  F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))


def score_bucket(score: Column) -> Column:
    out = None
    for low, label in SCORE_BUCKETS:
        hit = score == low if low == 1.0 else score >= low
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(LOWEST_BUCKET))


def score_buckets(scores: DataFrame) -> DataFrame:
    """Scores per labelled bucket with their percentage."""
    df = scores.where(F.col("score").isNotNull()).groupBy(score_bucket(F.col("score")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return df.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def disagreement_summary(pairs: DataFrame) -> DataFrame:
    """One row: pairs, complete pairs, flagged pairs and their share of the complete ones."""
    complete = F.col("judge_a_score").isNotNull() & F.col("judge_b_score").isNotNull()
    df = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(complete).alias("n_complete"),
                   F.count_if(F.col("is_disagreement")).alias("n_disagree"))
    return df.withColumn("disagree_pct", F.try_divide(F.lit(100.0) * F.col("n_disagree"), F.col("n_complete")))


def calibration(pairs: DataFrame) -> DataFrame:
    """Mean score per provider family and judge, and their difference."""
    df = pairs.groupBy(T.provider_of(F.col("model")).alias("family")).agg(
        F.avg("judge_a_score").alias("mean_a"), F.count("judge_a_score").alias("n_a"),
        F.avg("judge_b_score").alias("mean_b"), F.count("judge_b_score").alias("n_b"))
    gap = F.col("mean_a") - F.col("mean_b")
    return df.withColumns({"delta": gap, "flagged": F.abs(gap) > F.lit(K.SELF_BIAS_FLAG)})


def slot_occupancy(positions: DataFrame) -> DataFrame:
    """How often each model sat in each slot, and the even share."""
    df = positions.select(F.explode("position_to_model").alias("label", "model"))
    out = df.groupBy("model").agg(*[F.count_if(F.col("label") == x).alias(x) for x in K.POSITION_LABELS],
                                  F.count(F.lit(1)).alias("n_calls"))
    return out.withColumn("expected", F.col("n_calls") / F.lit(float(len(K.POSITION_LABELS))))


def position_bias(scores: DataFrame) -> DataFrame:
    """Mean score per model and slot, per judge and pooled, against the mean of the slot means.

    Slot sums are kept per judge and rolled up, so pooling does not read the rows again.
    """
    fine = scores.where(F.col("score").isNotNull()).groupBy("judge", "model", "position").agg(
        F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
    pooled = fine.groupBy("model", "position").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("judge", F.lit("pooled"))
    df = fine.unionByName(pooled).withColumn("slot_mean", F.col("s") / F.col("n"))
    df = df.withColumn("row_mean", F.avg("slot_mean").over(Window.partitionBy("judge", "model")))
    dev = F.col("slot_mean") - F.col("row_mean")
    return df.withColumns({"deviation": dev, "flagged": F.abs(dev) > F.lit(K.POSITION_BIAS_FLAG)}).drop("s")


def canonical_check(results: DataFrame) -> DataFrame:
    """One row: totals that must agree after the canonical scores are filled in."""
    both = F.col("judge_a_score").isNotNull() & F.col("judge_b_score").isNotNull()
    score = F.col("canonical_score")
    return results.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(both).alias("n_tier2"),
        F.count_if(both & score.isNull()).alias("n_tier2_null"), F.count(score).alias("n_populated"),
        F.count_if(score.isNull()).alias("n_left_null"))


def canonical_stats(results: DataFrame, slices: int | None = None) -> DataFrame:
    """Score statistics overall and per agreement flag."""
    df = results.where(F.col("canonical_score").isNotNull())
    label = F.when(F.col("judge_disagreement_flag") == 1, F.lit("disagreement")).otherwise(F.lit("agreement"))
    # both grains from one count of distinct scores: few values, whatever the row count
    df = df.groupBy(label.alias("part"), "canonical_score").agg(F.count(F.lit(1)).alias("w"))
    df = df.unionByName(df.groupBy("canonical_score").agg(F.sum("w").alias("w")).withColumn("part", F.lit("all")))
    s, w = F.col("canonical_score"), F.col("w")
    agg = df.groupBy("part").agg(F.sum("w").alias("n"), F.min(s).alias("min_score"), F.max(s).alias("max_score"),
                                 (F.sum(s * w) / F.sum(w)).alias("mean_score"), F.sum(s * w).alias("_s"), F.sum(s * s * w).alias("_q"))
    var = (F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")) / (F.col("n") - 1)
    agg = agg.withColumn("stdev", F.when(F.col("n") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))))
    ranked = running_total(df, ["part"], [s], {"hi": w}, slices).join(agg.select("part", "n"), "part")
    at = lambda r: F.max(F.when((F.col("hi") > r) & (F.col("hi") - w <= r), s))
    mid = ranked.groupBy("part").agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"))
    return agg.join(mid, "part").select("part", "n", "min_score", "max_score", "mean_score", "median", "stdev")


def histogram(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Counts in ``n`` equal buckets of [0, 1]; 1.0 falls in the last, empty buckets are listed."""
    bucket = F.least(F.floor(F.col(column) * n), F.lit(n - 1)).cast("long")
    counts = df.where(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(n).withColumnRenamed("id", "bucket")
    out = every.join(counts, "bucket", "left")
    return out.select("bucket", (F.col("bucket") / n).alias("low"), ((F.col("bucket") + 1) / n).alias("high"),
                      F.coalesce("n", F.lit(0)).alias("n"))


def method_counts(cases: DataFrame) -> DataFrame:
    """Cases per arbitration method."""
    return cases.groupBy("arbitration_method").agg(F.count(F.lit(1)).alias("n"))


def sweep_summary(calls: DataFrame, by: list[str], wall_ms: Column) -> DataFrame:
    """Ran, skipped and errored calls, summed latency and the speed-up over running them one by one."""
    skipped, errored = F.coalesce(F.col("skipped"), F.lit(False)), F.col("error").isNotNull()
    df = calls.groupBy(*by).agg(
        F.count_if(~skipped & ~errored).alias("n_ran"), F.count_if(skipped).alias("n_skipped"), F.count_if(errored).alias("n_errored"),
        F.sum("latency_ms").alias("sum_latency_ms"), F.max(wall_ms).alias("wall_ms"))
    return df.withColumn("speed_up", F.col("sum_latency_ms") / F.greatest(F.col("wall_ms"), F.lit(1)))


def median_of(df: DataFrame, column: str, by: list[str], slices: int | None = None) -> DataFrame:
    return exact_median(df, column, by, slices=slices)
