"""Prompt files: arrays of nested JSON objects with a closed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom import constants as K
from gradeloom.functions import jsonvalues as J
from gradeloom.sources.ranges import json_items

# fixed values: the keys each object may have
TOP_KEYS = ["prompt_id", "task_category", "complexity", "input", "scoring", "metadata"]
INPUT_KEYS = ["system", "user"]
SCORING_KEYS = ["tier_1_deterministic", "tier_2_judge"]
TIER1_KEYS = ["expected"]
TIER2_KEYS = ["criteria"]
METADATA_KEYS = ["input_tokens_approx", "notes"]


def _absent(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _text(value: Column) -> Column:
    """TRUE for a non-empty JSON string."""
    return J.is_text(value) & F.coalesce(F.length(value.try_cast("string")) > 0, F.lit(False))


def _object(value: Column, keys: list[str]) -> Column:
    """TRUE for a JSON object without keys beyond ``keys``."""
    extra = F.size(F.array_except(F.map_keys(J.entries(value)), F.array(*map(F.lit, keys))))
    return F.coalesce(extra == 0, F.lit(False))


def _problems(v: Column) -> Column:
    at = lambda path: J.field(v, path)
    t1, t2 = at("$.scoring.tier_1_deterministic"), at("$.scoring.tier_2_judge")
    tokens = at("$.metadata.input_tokens_approx")
    notes = at("$.metadata.notes")
    one_of = lambda path, names: J.is_text(at(path)) & F.coalesce(at(path).try_cast("string").isin(names), F.lit(False))
    rules = {
        "not an object, or unknown keys": _object(v, TOP_KEYS),
        "prompt_id": _text(at("$.prompt_id")),
        "task_category": one_of("$.task_category", K.CATEGORIES),
        "complexity": one_of("$.complexity", K.COMPLEXITIES),
        "input": _object(at("$.input"), INPUT_KEYS) & _text(at("$.input.system")) & _text(at("$.input.user")),
        "scoring": _object(at("$.scoring"), SCORING_KEYS),
        "at least one tier": ~(_absent(t1) & _absent(t2)),
        "tier_1_deterministic": _absent(t1) | (_object(t1, TIER1_KEYS) & J.entries(J.field(t1, "$.expected")).isNotNull()),
        "tier_2_judge": _absent(t2) | (_object(t2, TIER2_KEYS) & _text(J.field(t2, "$.criteria"))),
        "metadata": _object(at("$.metadata"), METADATA_KEYS)
        & F.coalesce((J.kind_of(tokens) == "int") & (tokens.try_cast("long") >= 0), F.lit(False))
        & (_absent(notes) | J.is_text(notes)),
    }
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def check_prompts(objects: DataFrame, value: str = "value", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Split prompt objects (VARIANT) into valid prompts and rejected ones with their reasons.

    ``expected`` stays a VARIANT: JSON text would lose the difference between 249 and 249.0.
    Ids must be unique over all sources; every copy of a repeated id is rejected.
    """
    df = objects.withColumn("reasons", F.when(F.col(value).isNull(), F.array(F.lit("unreadable file"))).otherwise(_problems(F.col(value))))
    df = df.withColumn("prompt_id", J.field(F.col(value), "$.prompt_id").try_cast("string"))
    repeats = (df.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("_n"))
               .where((F.col("_n") > 1) & F.col("prompt_id").isNotNull()))
    df = df.join(repeats, "prompt_id", "left")
    twice = F.when(F.col("_n").isNotNull(), F.array(F.lit("duplicate prompt_id"))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("reasons", F.concat("reasons", twice))
    get = lambda path, kind="string": J.field(F.col(value), path, kind)
    valid = df.where(F.size("reasons") == 0).select(
        "prompt_id", get("$.task_category").alias("task_category"), get("$.complexity").alias("complexity"),
        get("$.input.system").alias("system_text"), get("$.input.user").alias("user_text"),
        get("$.scoring.tier_1_deterministic.expected", "variant").alias("expected"),
        get("$.scoring.tier_2_judge.criteria").alias("criteria"),
        get("$.metadata.input_tokens_approx", "bigint").alias("input_tokens_approx"), get("$.metadata.notes").alias("notes"))
    rejected = df.where(F.size("reasons") > 0).select(source, "prompt_id", "reasons", F.to_json(F.col(value)).alias("object"))
    return valid, rejected


def read_prompts(spark: SparkSession, *paths: str, ranges: bool = False) -> tuple[DataFrame, DataFrame]:
    """Read JSON array files; an unreadable file becomes one rejected row, not an error.

    A file is read by one task, or with ``ranges`` by as many tasks as it has byte ranges, in two passes.
    """
    if ranges:
        return check_prompts(json_items(spark, *paths))
    files = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    arrays = files.select("source", F.from_json("value", "array<variant>").alias("a"))
    return check_prompts(arrays.select("source", F.explode_outer("a").alias("value")))
