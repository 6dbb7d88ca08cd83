"""What each lever did: caching, compression, output cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom import constants as K
from gradeloom.operators.cells import lever_ratios
from gradeloom.operators.ordered import nearest_rank, range_ranks

PAIR = ["run_id", "prompt_id", "model"]


def write_problem(provider: Column, cached: Column, created: Column) -> Column:
    """Why a cache-write call did not engage; NULL if it did or cannot be told."""
    return F.when(
        provider == "anthropic",
        F.when(F.coalesce(created, F.lit(0)) == 0, F.lit("cache write created no cache tokens"))
        .when(F.coalesce(cached, F.lit(0)) != 0, F.lit("cache write read from a warm cache")))


def read_problem(cached: Column) -> Column:
    return F.when(F.coalesce(cached, F.lit(0)) == 0, F.lit("cache read hit no cache tokens"))


def cache_phases(results: DataFrame) -> DataFrame:
    """Baseline, write and read call of each (run, prompt, model) side by side, with the skip reason.

    Failed calls take no part.  One grouping pivots the three phases; a pair without write call was below the model's
    minimum prompt length.
    """
    phase = F.when(F.col("optimisation_lever") == "baseline", F.lit("baseline")).when(
        F.col("optimisation_lever") == "caching", F.get_json_object("optimisation_config", "$.cache_phase"))
    call = F.struct("cost_usd", "latency_ms", "cached_tokens", "cache_creation_tokens", "provider")
    results = results.where(F.col("error").isNull()) if "error" in results.columns else results
    df = results.where(F.col("optimisation_lever").isin("baseline", "caching")).withColumn("_phase", phase)
    pick = lambda p: F.max_by(call, F.when(F.col("_phase") == p, F.struct("run_attempt", "result_id"))).alias(p)
    df = df.groupBy(*PAIR).agg(pick("baseline"), pick("write"), pick("read")).where(F.col("baseline").isNotNull())
    reason = (
        F.when(F.col("write").isNull(), F.lit("prompt below the caching threshold"))
        .when(write_problem(F.col("write.provider"), F.col("write.cached_tokens"), F.col("write.cache_creation_tokens")).isNotNull(),
              write_problem(F.col("write.provider"), F.col("write.cached_tokens"), F.col("write.cache_creation_tokens")))
        .otherwise(read_problem(F.col("read.cached_tokens"))))
    return df.withColumn("skip_reason", reason)


def cache_multipliers(results: DataFrame) -> DataFrame:
    """Per-pair write and read multipliers of cost and latency; NULL where caching was unavailable or the baseline was free."""
    df = cache_phases(results)
    ok = F.col("skip_reason").isNull()
    cost = lambda p: F.when(ok, F.try_divide(F.col(f"{p}.cost_usd"), F.col("baseline.cost_usd")))
    lat = lambda p: F.when(ok, F.col(f"{p}.latency_ms") / F.greatest(F.col("baseline.latency_ms"), F.lit(1)))
    return df.select(*PAIR, "skip_reason", cost("write").alias("cost_write_mult"), cost("read").alias("cost_read_mult"),
                     lat("write").alias("latency_write_mult"), lat("read").alias("latency_read_mult"))


def cache_effects(results: DataFrame, by: list[str] = ("model",), slices: int | None = None) -> DataFrame:
    """Minimum, median and maximum of each multiplier (long form) with available / unavailable counts."""
    by = list(by)
    m = cache_multipliers(results)
    ok = F.col("skip_reason").isNull()
    n = m.groupBy(*by).agg(F.count_if(ok).alias("n_available"), F.count_if(~ok).alias("n_unavailable"))
    names = ["cost_write_mult", "cost_read_mult", "latency_write_mult", "latency_read_mult"]
    long = m.where(ok).unpivot(by, names, "measure", "value")
    stats = nearest_rank(long, "value", range_ranks(), [*by, "measure"], slices)
    stats = stats.select(*by, "measure", "min", "max", ((F.col("_low") + F.col("_high")) / 2).alias("median"))
    return n.join(stats, by, "left")


def skip_reasons(results: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """How often each reason made caching unavailable."""
    df = cache_phases(results).where(F.col("skip_reason").isNotNull())
    return df.groupBy(*by, "skip_reason").agg(F.count(F.lit(1)).alias("n"))


def compression_status(original: Column, compressed: Column) -> Column:
    """``struct(available, ratio, reason)`` of a compression: unavailable unless it saved tokens."""
    ratio = compressed / F.greatest(original, F.lit(1))
    gone = compressed >= original
    return F.struct(
        (~gone).alias("available"), F.round(ratio, 4).alias("ratio"),
        F.when(gone, F.format_string("no reduction: %d >= %d (%.3fx)", compressed, original, ratio)).alias("reason"))


def compression_effects(results: DataFrame) -> DataFrame:
    """Original, compressed and billed tokens of each compression call with their ratios."""
    df = results.where(F.col("optimisation_lever") == "compression")
    cfg = F.try_parse_json("optimisation_config")
    df = df.select("run_id", "prompt_id", "model", "provider", "input_tokens", cfg.alias("_c"))
    df = df.withColumns({
        "original_tokens": F.try_variant_get("_c", "$.original_input_tokens", "bigint"),
        "compressed_tokens": F.try_variant_get("_c", "$.compressed_input_tokens", "bigint"),
    }).drop("_c")
    base = F.greatest(F.col("original_tokens"), F.lit(1))
    return df.withColumns({
        "counted_ratio": F.col("compressed_tokens") / base,
        "billed_ratio": F.col("input_tokens") / base,
        "reduction_pct": (F.lit(1.0) - F.col("compressed_tokens") / base) * F.lit(100.0),
    })


def cap_violations(results: DataFrame, cap: int = K.OUTPUT_CAP_TOKENS) -> DataFrame:
    """Capped calls that returned more than the cap; there should be none."""
    return results.where((F.col("optimisation_lever") == "output_cap") & (F.coalesce("output_tokens", F.lit(0)) > cap))


def contaminated_baselines(results: DataFrame) -> DataFrame:
    """Baseline calls that were served from a warm cache."""
    return results.where((F.col("optimisation_lever") == "baseline") & F.col("error").isNull() & (F.col("cached_tokens") > 0))


def warm_calls(calls: DataFrame, ttl: int = K.CACHE_LIFETIME_SECONDS, key: list[str] = ("model", "prompt_id"),
               ts: str = "ts", tie: str = "result_id") -> DataFrame:
    """Calls made within a cache lifetime of an earlier call on the same key.

    Time is cut into lifetime-long buckets, so the previous call is either in the same bucket
    or the last call of the bucket before it: a hot key is spread over its buckets, and only
    one row per bucket crosses over.
    """
    key = list(key)
    df = calls.withColumn(ts, F.col(ts).cast("timestamp"))
    df = df.withColumn("_b", F.floor(F.unix_micros(ts) / F.lit(ttl * 1_000_000)))
    w = Window.partitionBy(*key, "_b").orderBy(ts, tie)
    df = df.withColumn("_prev", F.lag(ts).over(w))
    last = df.groupBy(*key, "_b").agg(F.max(ts).alias("_last")).withColumn("_b", F.col("_b") + 1)
    df = df.join(last, [*key, "_b"], "left")
    prev = F.coalesce("_prev", "_last")
    gap = F.unix_micros(ts) - F.unix_micros(prev)
    return df.withColumns({"previous_ts": F.when(gap <= ttl * 1_000_000, prev),
                           "warm": F.coalesce(gap <= ttl * 1_000_000, F.lit(False))}).drop("_b", "_prev", "_last")


def engagement_measures() -> list[Column]:
    """Cache writes and reads and compressions that took effect, out of how many."""
    cfg = lambda k: F.get_json_object("optimisation_config", f"$.{k}")
    caching, compressing = F.col("optimisation_lever") == "caching", F.col("optimisation_lever") == "compression"
    write, read = caching & (cfg("cache_phase") == "write"), caching & (cfg("cache_phase") == "read")
    wrote = ((F.col("provider") == "anthropic") & (F.col("cache_creation_tokens") > 0)) | (F.col("provider") == "openai")
    original, compressed = cfg("original_input_tokens").cast("long"), cfg("compressed_input_tokens").cast("long")
    return [
        F.count_if(write).alias("n_writes"), F.count_if(write & wrote).alias("n_writes_engaged"),
        F.count_if(read).alias("n_reads"), F.count_if(read & (F.col("cached_tokens") > 0)).alias("n_reads_engaged"),
        F.count_if(compressing).alias("n_compressions"), F.count_if(compressing & (compressed < original)).alias("n_compressed"),
        F.count_if(compressing & (original.isNull() | compressed.isNull())).alias("n_counts_missing")]


def engagement(results: DataFrame) -> DataFrame:
    """The measures of ``engagement_measures`` per run."""
    return results.groupBy("run_id").agg(*engagement_measures())


def ratio_summary(results: DataFrame, by: list[str] = ("lever",), slices: int | None = None) -> DataFrame:
    """Minimum, exact median and maximum of every row-level lever / baseline ratio."""
    by = list(by)
    long = lever_ratios(results).unpivot(by, ["cost_mult", "input_mult", "output_mult", "latency_mult"], "measure", "value")
    stats = nearest_rank(long, "value", range_ranks(), [*by, "measure"], slices)
    return stats.withColumn("median", (F.col("_low") + F.col("_high")) / 2).drop("_low", "_high")
