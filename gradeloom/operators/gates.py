"""Pass/fail checks of a run's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom import constants as K

CRITICAL = ["result_id", "run_id", "model_version", "response_text", "cost_usd"]


def gap_measures(columns: list[str] = CRITICAL) -> list[Column]:
    """Rows, error rows, rows with a NULL in a critical column, compressions without token counts."""
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    cfg = lambda k: F.get_json_object("optimisation_config", f"$.{k}")
    bare = (F.col("optimisation_lever") == "compression") & (
        cfg("original_input_tokens").isNull() | cfg("compressed_input_tokens").isNull())
    return [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("error").isNotNull()).alias("n_errors"),
            F.count_if(null).alias("n_null_critical"), F.count_if(bare).alias("n_config_missing")]


def critical_gaps(results: DataFrame, columns: list[str] = CRITICAL) -> DataFrame:
    """The measures of ``gap_measures`` per run."""
    return results.groupBy("run_id").agg(*gap_measures(columns))


def phase_log_audit(log: DataFrame, expected: list[str] = K.EXPECTED_PHASES) -> DataFrame:
    """Per run: events, error events, phases seen and expected phases missing."""
    seen = F.collect_set("phase")
    df = log.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event") == "error").alias("n_errors"),
                                   F.array_sort(seen).alias("phases"))
    return df.withColumn("missing_phases", F.array_sort(F.array_except(F.array(*map(F.lit, expected)), F.col("phases"))))

