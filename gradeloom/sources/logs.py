"""Append-only JSON-lines logs and CSV tables of published results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PHASE_SCHEMA = "ts timestamp, run_id string, phase string, event string, payload string"
POSITION_SCHEMA = "prompt_id string, lever string, seed bigint, position_to_model map<string,string>, run_id string, ts timestamp"
# fixed values: columns of the published tables
LEVER_MATRIX_SCHEMA = (
    "model string, lever string, n_rows bigint, mean_canonical_score double, mean_cost_usd double, tier_1_pass_rate_all double, "
    "tier_1_pass_rate_applicable double, delta_canonical_vs_baseline double, cost_ratio_vs_baseline double, "
    "delta_t1_pass_rate_all_vs_baseline double, delta_t1_pass_rate_applicable_vs_baseline double")
SCATTER_SCHEMA = ("model string, lever string, n_rows bigint, mean_canonical_score double, mean_cost_usd double, "
                  "pareto_optimal int, dominated_by_model string, dominated_by_lever string")
CATEGORY_SCHEMA = ("task_category string, lever string, n_rows bigint, mean_canonical_score double, mean_cost_usd double, "
                   "tier_1_pass_rate_applicable double, delta_canonical_vs_category_baseline double")
CELL_SCHEMA = ("task_category string, model string, lever string, n_rows bigint, mean_canonical_score double, "
               "mean_cost_usd double, tier_1_pass_rate_all double")


def read_phase_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Phase log rows; a line that is no JSON keeps its text in ``bad_line``."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(PHASE_SCHEMA + ", bad_line string").option("columnNameOfCorruptRecord", "bad_line").json(path)


def read_position_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSITION_SCHEMA).json(path)


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; times keep their microseconds."""
    df.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Write a table as CSV with header, as many files as the frame has partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed CSV reader; 'n/a' reads as NULL."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "n/a").csv(path)


def n_a(column: str) -> Column:
    """Column text with NULL written as n/a."""
    return F.coalesce(F.col(column).cast("string"), F.lit("n/a"))
