"""Event-time windows.  Each function takes a batch or a streaming frame and gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom import constants as K


def _timed(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    """Cast to a zoned timestamp (watermarks reject others) and set the watermark on streams."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, delay) if delay and df.isStreaming else df


def phase_counts(log: DataFrame, width: str = "10 minutes", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Events and error events per phase and tumbling window; rows later than the watermark are dropped."""
    df = _timed(log, ts, delay).groupBy(F.window(ts, width), "phase").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event") == "error").alias("n_errors"))
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "phase", "n_events", "n_errors")


def rolling_cells(results: DataFrame, width: str, slide: str, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Rows, pass rate and cost per (model, lever) over sliding windows."""
    df = _timed(results, ts, delay).groupBy(F.window(ts, width, slide), "model", F.col("optimisation_lever").alias("lever")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("tier_1_status") == "pass").alias("n_pass"), F.sum("cost_usd").alias("sum_cost"))
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "model", "lever",
                     "n_rows", "n_pass", (F.col("n_pass") / F.col("n_rows")).alias("pass_rate"), "sum_cost")


def warm_sessions(calls: DataFrame, keys: list[str], gap_seconds: int = K.CACHE_LIFETIME_SECONDS, delay: str = "10 minutes",
                  ts: str = "ts") -> DataFrame:
    """Sessions of calls on one key closer together than the cache lifetime; all but the first call are warm."""
    df = _timed(calls, ts, delay).groupBy(F.session_window(ts, f"{gap_seconds} seconds"), *keys).agg(F.count(F.lit(1)).alias("n_calls"))
    return df.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys,
                     "n_calls", (F.col("n_calls") - 1).alias("n_warm"))


def spend_by_run(calls: DataFrame, caps: DataFrame, fx: float = K.GBP_USD_RATE) -> DataFrame:
    """Spend of each run so far and whether it is over its cap.

    No watermark: a late call still costs money.  Streams run it in update mode.
    """
    df = calls.join(caps, "run_id").groupBy("run_id", "cost_cap_gbp").agg((F.sum("cost_usd") / F.lit(fx)).alias("spent_gbp"))
    return df.withColumn("over_cap", F.col("spent_gbp") > F.col("cost_cap_gbp"))


#: Width of the time buckets that a key's calls are dealt over, and tasks that share a bucket.
BUCKET_SECONDS, SALTS = 3600, 8


def session_parts(calls: DataFrame, keys: list[str], gap_seconds: int = K.CACHE_LIFETIME_SECONDS, delay: str = "10 minutes", ts: str = "ts",
                  bucket_seconds: int = BUCKET_SECONDS, salts: int = SALTS) -> DataFrame:
    """Sessions inside a share of a key's calls: its time bucket and a salt.  First step of ``hot_sessions``.

    Every call covers its own time and the gap after it.  A part is a stretch that calls of one
    share cover without a break, so the parts of a key cover exactly what its sessions do.
    """
    share = F.struct(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / bucket_seconds).alias("bucket"), F.pmod(F.xxhash64(*calls.columns), F.lit(salts)).alias("salt"))
    df = _timed(calls.withColumn("_share", share), ts, delay).groupBy(F.session_window(ts, f"{gap_seconds} seconds"), *keys, "_share").agg(F.count(F.lit(1)).alias("n_calls"))
    return df.select(F.col("session_window.start").alias("part_start"), F.col("session_window.end").alias("part_end"), *keys, "n_calls")


def hot_sessions(parts: DataFrame, keys: list[str], gap_seconds: int = K.CACHE_LIFETIME_SECONDS, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """The sessions of ``warm_sessions`` from the parts of ``session_parts``, whose ends meet here.

    A part is a session whose gap is its own length, so parts that overlap merge and those that do not
    stay apart.  What comes in has one row a part instead of one a call, so a hot key is no large group.
    A stream of parts (a second query over what the first one wrote) waits for a bucket and two gaps: a part
    starts at most a bucket and a gap before it ends.
    """
    delay = f"{bucket_seconds + 2 * gap_seconds} seconds"
    length = F.make_interval(secs=(F.unix_micros("part_end") - F.unix_micros("part_start")).cast("decimal(18,6)") / F.lit(1000000).cast("decimal(18,6)"))
    df = _timed(parts, "part_start", delay).groupBy(F.session_window("part_start", length), *keys).agg(F.sum("n_calls").alias("n_calls"))
    return df.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n_calls", (F.col("n_calls") - 1).alias("n_warm"))
